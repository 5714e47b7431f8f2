"""Suffix-array dedup of bytes by deep-shallow sorting.

A string of LENGTH bytes is removed where it also starts in a document with a smaller id. Suffixes
are sorted only where it matters: each string of LENGTH bytes holds an anchor (its GRAM-byte string of
least hash), and an anchor that no other document has can't lie in a repeat. Around the anchors that
are shared the suffixes of all surroundings are ordered, equal surroundings once: multikey quicksort to
a shallow depth, blind tries for the groups that still agree there. Neighbours that agree in LENGTH
bytes are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import exchange as x
from folioflow.llm.common import table

LENGTH = 50
GRAM = 25
#: Bytes before and after an anchor's start that strings of LENGTH bytes around it can reach.
BEFORE, AFTER = LENGTH - GRAM, LENGTH
CONTEXT = BEFORE + AFTER
#: Depth in bytes at which multikey quicksort hands over to blind tries.
SHALLOW = 24
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_ROW = np.dtype([("left", "u1"), ("right", "u1"), ("bytes", f"V{CONTEXT}")])


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over values[i : i + width] for each i, by doubling."""
    if len(values) < width:
        return values[:0]
    out, step = values, 1
    while step * 2 <= width:
        out = best(out[:-step], out[step:])
        step *= 2
    return best(out[: len(out) - (width - step)], out[width - step :]) if step < width else out


_STEP = 1 << 17  # places at a time, so that the arrays stay in a core's cache


def _words_at(flat: np.ndarray) -> np.ndarray:
    """A view of the eight bytes at each place as one number."""
    return np.ndarray(len(flat) - 7, "<u8", flat, 0, (1,))


def anchors_of(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit keys of the anchors of all strings of LENGTH bytes; ends: where documents end.

    Anchors are chosen by a 32-bit hash; a tie makes both places anchors.
    """
    width = LENGTH - GRAM + 1
    if len(flat) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(flat) - GRAM + 1
    hashes, least = np.empty(n, np.uint32), np.zeros(n, np.uint32)
    for i in range(0, n, _STEP):
        part = x.rolling(flat[i : i + _STEP + GRAM - 1].astype(np.uint32) + np.uint32(1), GRAM, _BASE & 0xFFFFFFFF)
        np.maximum(part, 1, out=hashes[i : i + _STEP])
    for i in range(0, n - width + 1, _STEP):
        part = sliding(hashes[i : i + _STEP + width - 1], width, np.minimum)
        least[i : i + len(part)] = part
    for end in ends.tolist():  # a string may not cross documents
        least[max(0, end - LENGTH + 1) : end] = 0
    found = []
    for i in range(0, n, _STEP):
        part = least[max(0, i - width + 1) : i + _STEP]
        if i < width - 1:
            part = np.concatenate([np.zeros(width - 1 - i, np.uint32), part])
        most = sliding(part, width, np.maximum)
        found.append(np.flatnonzero(most == hashes[i : i + _STEP]) + i)
    at = np.concatenate(found)
    word, key = _words_at(flat), flat[at + (GRAM - 1)].astype(np.uint64)
    for k in range(0, GRAM - 8, 8):
        key = x.mixed(key * np.uint64(_BASE) + word[at + k])
    return at, key


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n, modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        known = np.full(n + 1, base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 8 * x.SLICE_BYTES:
            _powers[base] = known
    return known[: n + 1]


class _Slice:
    """The bytes of a slice's documents in one row, and its anchors."""

    def __init__(self, rows: pa.Table):
        self.rows, self.ids = x.ordered(rows)
        raw = [t.encode("utf-8") for t in self.rows.column("__text").to_pylist()]
        self.n = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        end = self.start + self.n
        self.at, keys = anchors_of(self.flat, end)
        self.doc = np.searchsorted(end, self.at, side="right")
        self.keys, first, last, self.entry = x.distinct_sorted(keys, self.doc)
        self.several = (self.ids[first] != self.ids[last]).astype(np.uint8)

    def contexts(self, shared: np.ndarray) -> None:
        """The surroundings of the shared anchors: the distinct ones of this slice, by 64 bits for the anchor and 64 for its surroundings, and the smallest document of each."""
        own = shared[self.entry] > 0 if len(shared) else np.zeros(len(self.at), bool)
        self.at, self.doc, key = self.at[own], self.doc[own], self.keys[self.entry[own]]
        begin = self.start[self.doc]
        self.left = np.minimum(BEFORE, self.at - begin)
        self.right = np.minimum(AFTER, begin + self.n[self.doc] - self.at)
        # Hash of any range from sums of byte * base^place, brought back to place 0 by the inverse power.
        power, back = _power(_BASE2, len(self.flat)), _power(pow(_BASE2, -1, 1 << 64), len(self.flat))
        total = np.zeros(len(self.flat) + 1, np.uint64)
        np.cumsum((self.flat.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        a, b = self.at - self.left, self.at + self.right
        hash_ = x.mixed((total[b] - total[a]) * back[a] + (self.left * 64 + self.right).astype(np.uint64))
        order = np.lexsort((hash_, key))
        k, h = key[order], hash_[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])[: len(k)]
        self.context = np.empty(len(k), np.int64)
        self.context[order] = np.cumsum(new) - 1
        self.context_keys = k[new]
        self.sample = order[new]
        self.lowest = self.ids[self.doc[order][new]]

    def surroundings(self) -> np.ndarray:
        """The bytes of the distinct surroundings, zeros where a document ends."""
        own = self.sample
        out = np.zeros(len(own), _ROW)
        out["left"], out["right"] = self.left[own], self.right[own]
        offset = np.arange(-BEFORE, AFTER)
        for i in range(0, len(own), 65_536):
            part = own[i : i + 65_536]
            place = self.at[part][:, None] + offset
            inside = (offset >= -self.left[part][:, None]) & (offset < self.right[part][:, None])
            raw = np.where(inside, self.flat[np.clip(place, 0, len(self.flat) - 1)], 0).astype(np.uint8)
            out["bytes"][i : i + 65_536] = np.ascontiguousarray(raw).view(f"V{CONTEXT}")[:, 0]
        return out

    def removed(self, bits: np.ndarray) -> np.ndarray:
        """Which bytes go, by the answers for the distinct surroundings: a bit for each place before the anchor whose string a smaller document has."""
        if not len(self.at):
            return np.zeros(len(self.flat), bool)
        e = self.context
        # Strings that fit start from BEFORE - left to BEFORE + right - LENGTH; a smaller document of this slice with the same surroundings has them all.
        low, high = BEFORE - self.left, BEFORE + self.right - LENGTH
        fit = np.where(high >= low, (np.int64(1) << np.maximum(high + 1, 0)) - (np.int64(1) << low), 0)
        mine = np.where(self.lowest[e] < self.ids[self.doc], fit, bits[e].astype(np.int64) & fit)
        whole = (mine == fit) & (fit > 0)
        first, last = [(self.at - self.left)[whole]], [(self.at + self.right - 1)[whole]]
        rest = np.flatnonzero(~whole & (mine > 0))
        hit, offset = np.nonzero((mine[rest][:, None] >> np.arange(BEFORE + 1)) & 1)
        begin = self.at[rest][hit] - BEFORE + offset
        return x.marked(len(self.flat), np.concatenate([*first, begin]), np.concatenate([*last, begin + LENGTH - 1]))


class BlindTrie:
    """Orders strings that share a long prefix: an inner node holds only the depth where its strings part."""

    def __init__(self, strings: Iterator[tuple[int, bytes]]):
        self.root: list | None = None
        leaves: dict[bytes, list] = {}
        for place, text in strings:
            # An equal string joins the leaf that is there.
            if text in leaves:
                leaves[text][2].append(place)
            else:
                leaves[text] = self._insert(place, text)

    def _insert(self, place: int, text: bytes) -> list:
        leaf = [None, text, [place]]
        if self.root is None:
            self.root = leaf
            return leaf
        # Blind descent: only the branching bytes are looked at, any leaf below tells the true depth.
        node = self.root
        while node[0] is not None:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        part = int.from_bytes(node[1], "big") ^ int.from_bytes(text, "big")
        depth = len(text) - (part.bit_length() + 7) // 8
        known = node[1]
        up, node = None, self.root
        while node[0] is not None and node[0] < depth:
            up, node = node, node[1][text[node[0]]]
        if node[0] == depth:
            node[1][text[depth]] = leaf
            return leaf
        inner = [depth, {known[depth]: node, text[depth]: leaf}]
        if up is None:
            self.root = inner
        else:
            up[1][text[up[0]]] = inner
        return leaf

    def groups(self) -> Iterator[list[int]]:
        """The places of equal strings, in the order of the strings."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] is None:
                yield node[2]
            else:
                todo.extend(node[1][c] for c in sorted(node[1], reverse=True))


def deep_shallow(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The number of the group of equal strings raw[s : s + LENGTH], groups in the order of their strings."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    flat = np.frombuffer(raw + b"\0" * 8, np.uint8).astype(np.uint64)
    word = flat[:-7].copy()
    for i in range(1, 8):
        word = (word << np.uint64(8)) | flat[i : len(flat) - 7 + i]
    # Multikey quicksort over all open segments at once: less, equal and greater than each one's pivot.
    # The first word is sorted at once, what follows goes by pivots.
    order, depth = np.argsort(word[starts], kind="stable"), np.full(n, 8, np.int64)
    head = word[starts[order]]
    segment = np.cumsum(np.concatenate([[0], head[1:] != head[:-1]]))  # ascending along order
    position = np.empty(n, np.int64)
    place = np.arange(n)  # places in the final order that the open elements fill
    finished = np.empty(n, np.int64)  # element at each place
    tries: list[tuple[int, int]] = []
    while len(order):
        size = np.bincount(segment)
        single = size[segment] == 1
        deep = ~single & (depth >= SHALLOW)
        stop = single | deep
        finished[place[stop]] = order[stop]
        if deep.any():
            own, at = segment[deep], place[deep]
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            tries += zip(at[cuts].tolist(), np.diff(np.append(cuts, len(own))).tolist(), strict=True)
        order, depth, segment, place = order[~stop], depth[~stop], segment[~stop], place[~stop]
        if not len(order):
            break
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        size = np.diff(np.append(first, len(order)))
        middle = word[starts[order[first + size // 2]] + depth[first]]
        own = np.repeat(np.arange(len(first)), size)
        value = word[starts[order] + depth]
        side = (value > middle[own]).astype(np.int64) - (value < middle[own]) + 1
        key = own * 3 + side
        moved = np.argsort(key, kind="stable")
        order, depth, key, side = order[moved], depth[moved], key[moved], side[moved]
        depth = depth + 8 * (side == 1)
        segment = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    new = bytearray(b"\1") * n
    if tries:
        # A trie of equal strings is one leaf: such groups are found by comparing words, and only the others are inserted.
        first, size = (np.array(c) for c in zip(*tries, strict=True))
        begin = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(begin - first, size)
        own, head = starts[finished[at]], np.repeat(starts[finished[first]], size)
        equal = np.ones(len(at), bool)
        offsets = (*range(SHALLOW, LENGTH - 8, 8), LENGTH - 8)
        for offset in offsets:
            equal &= word[own + offset] == word[head + offset]
        leaf = np.logical_and.reduceat(equal, begin)
        repeats = np.repeat(leaf, size)
        repeats[begin] = False
        np.frombuffer(new, np.uint8)[at[repeats]] = 0
        # A trie of two leaves is one comparison.
        two = first[~leaf & (size == 2)]
        a, b = starts[finished[two]], starts[finished[two + 1]]
        later, open_ = np.zeros(len(two), bool), np.ones(len(two), bool)
        for offset in offsets:
            x_, y_ = word[a + offset], word[b + offset]
            later |= open_ & (x_ > y_)
            open_ &= x_ == y_
        swap = two[later]
        finished[swap], finished[swap + 1] = finished[swap + 1], finished[swap]
        tries = [t for t, done in zip(tries, (leaf | (size == 2)).tolist(), strict=True) if not done]
    elements, begins = finished.tolist(), starts.tolist()
    for at, size in tries:
        own = elements[at : at + size]
        for group in BlindTrie((e, raw[begins[e] : begins[e] + LENGTH]) for e in own).groups():
            size = len(group)
            elements[at : at + size] = group
            new[at + 1 : at + size] = bytes(size - 1)
            at += size
    finished, new = np.array(elements), np.frombuffer(new, np.uint8)
    position[finished] = np.cumsum(new) - 1
    return position


#: Surroundings that are sorted at a time; those of one anchor stay together.
_SORTED = 8_192


def sort_all(keys: None, more: bytes, ids: np.ndarray) -> np.ndarray:
    """For each surroundings a bit for every place before its anchor: the string there also starts in a smaller document.

    Equal strings hold the same anchor at the same place, so whatever can be equal stands in one bucket, and
    in one part of it.
    """
    rows = np.frombuffer(more, _ROW)
    out = np.zeros(len(rows), np.uint32)
    if not len(rows):
        return out
    anchor = _hashed(np.ascontiguousarray(rows["bytes"]).view(np.uint8).reshape(-1, CONTEXT)[:, BEFORE : BEFORE + GRAM])
    order = np.argsort(anchor, kind="stable")
    own = anchor[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    start = 0
    while start < len(rows):
        # up to the last anchor that begins within the bound, one at least
        following = np.searchsorted(first, start, side="right")
        within = np.searchsorted(first, start + _SORTED, side="right") - 1
        stop = int(first[max(following, within)]) if max(following, within) < len(first) and start + _SORTED < len(rows) else len(rows)
        part = order[start:stop]
        out[part] = _sort_part(rows[part], ids[part])
        start = stop
    return out


def _sort_part(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint32)
    # Equal surroundings are sorted once, with their smallest document.
    raw = np.ascontiguousarray(rows).view(f"V{_ROW.itemsize}")
    order = _by_content(rows, ids)
    raw, r, i = raw[order], rows[order], ids[order]
    new = np.concatenate([[True], raw[1:] != raw[:-1]])
    entry = np.cumsum(new) - 1
    one, low = r[new], i[new]
    buffer = one["bytes"].tobytes() + b"\0" * LENGTH
    # Strings that start at BEFORE - left .. BEFORE and end inside.
    offset = np.arange(BEFORE + 1)
    fits = (offset >= BEFORE - one["left"].astype(np.int64)[:, None]) & (offset + LENGTH <= BEFORE + one["right"].astype(np.int64)[:, None])
    which, where = np.nonzero(fits)
    group = deep_shallow(buffer, which * CONTEXT + where)
    least = np.full(group.max() + 1 if len(group) else 0, x.NO_ID)
    np.minimum.at(least, group, low[which])
    found = np.full(fits.shape, x.NO_ID)
    found[which, where] = least[group]
    for start in range(0, len(r), 65_536):
        part = slice(start, start + 65_536)
        bits = (found[entry[part]] < i[part][:, None]) & fits[entry[part]]
        out[order[part]] = (bits.astype(np.uint32) << offset.astype(np.uint32)).sum(1, dtype=np.uint32)
    return out


def _by_content(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places in an order that puts equal surroundings side by side, smallest id first."""
    return np.lexsort((ids, _hashed(np.ascontiguousarray(rows).view(np.uint8).reshape(-1, _ROW.itemsize))))


def _hashed(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    wide = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    hashes = np.zeros(len(raw), np.uint64)
    for column in wide.view(np.uint64).T:
        hashes = x.mixed(hashes * np.uint64(_BASE) + column)
    return hashes


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans array<struct<first,last>> (byte places, both included), kept binary, and `carry`.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller
    doc_id. A null text is empty; a null doc_id is larger than any other and stays null; rows of one
    doc_id don't remove each other's bytes; repeated rows stay repeated; an empty table gives an
    empty one. Columns in `carry` come along as __c_<name>, so none can clash; others are ignored.
    """
    parts, buckets = x.sliced(docs, list(carry))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    nothing = x.ask(0, buckets, np.zeros(0, np.uint64), np.zeros(0, np.uint8))

    def number(rows: pa.Table) -> int:
        return rows.column("__slice")[0].as_py()

    def anchors(rows: pa.Table) -> pa.Table:
        own = _Slice(rows)
        return x.ask(number(rows), buckets, own.keys, own.several)

    def contexts(rows: pa.Table, got: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return nothing
        own = _Slice(rows)
        own.contexts(x.answers(got, 1, np.uint8))
        return x.ask(number(rows), buckets, own.context_keys, own.surroundings(), own.lowest, send_keys=False)

    def cut(rows: pa.Table, got: pa.Table) -> pa.Table:
        own = _Slice(rows)
        own.contexts(x.answers(got, 1, np.uint8))
        gone = own.removed(x.answers(got, 2, np.uint32))
        spans, kept, removed = [], [], []
        for start, n in zip(own.start.tolist(), own.n.tolist(), strict=True):
            mask, part = gone[start : start + n], own.flat[start : start + n]
            removed.append(int(mask.sum()))
            spans.append([{"first": a, "last": b - 1} for a, b in x.runs_of(mask)] if removed[-1] else [])
            kept.append((part[~mask] if removed[-1] else part).tobytes())
        carried = [own.rows.column(f"__c_{c}") for c in carry]
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.table(
            [own.rows.column("__id"), pa.array(own.n), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), *carried],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept", *[f"__c_{c}" for c in carry]],
        )

    by_slice = parts.groupBy("__slice")
    one = x.answer(by_slice.applyInArrow(anchors, x.ASKED), 1, x.shared_between)
    two = x.answer(by_slice.cogroup(one.groupBy("slice")).applyInArrow(contexts, x.ASKED), 2, sort_all, _ROW.itemsize)
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>, kept binary" + "".join(f", `__c_{c}` {kinds[c]}" for c in carry)
    return by_slice.cogroup(one.union(two).groupBy("slice")).applyInArrow(cut, schema)


def op6_suffix(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
i as (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) as i from b where length(h) >= 100),
k as (select doc_id, i, h[2 * i + 1:2 * i + 100] as k from i),
m as (select k, min(doc_id) as low from k group by k),
r as (select k.doc_id, k.i from k join m on k.k = m.k where m.low < k.doc_id),
g as (select distinct doc_id, unnest(range(i, i + 50)) as p from r),
s as (select doc_id, p, p - row_number() over (partition by doc_id order by p) as run from g),
u as (select doc_id, run, min(p) as a, max(p) as z from s group by doc_id, run),
v as (select doc_id, a, z, lag(z, 1, -1) over (partition by doc_id order by a) as before from u),
n as (select v.doc_id, sum(z - a + 1) as n_removed, count(*) as n_spans, string_agg(h[2 * before + 3:2 * a], '' order by a) as kept, max(z) as z
  from v join b on v.doc_id = b.doc_id group by v.doc_id)
select b.doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(case when n.z is null then h else n.kept || h[2 * n.z + 3:] end)) as kept_sha256
from b left join n on b.doc_id = n.doc_id
"""
