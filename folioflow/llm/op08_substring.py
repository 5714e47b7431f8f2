"""Substring dedup with difference-cover anchors.

Windows of ANCHOR words are hashed only where a word's place modulo PERIOD lies in a difference
cover: for any two places some shift below PERIOD brings both into the cover. Two equal windows of
LENGTH = ANCHOR + PERIOD - 1 words or more so share an aligned anchor. Around anchors that several
documents have, the match is extended to all windows of LENGTH words that hold the anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import exchange as x
from folioflow.llm.common import table

LENGTH = 50
PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = LENGTH - PERIOD + 1
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_REMEMBERED = 100_000
_known: dict[bytes, int] = {}
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word; words are remembered up to a bound."""
    try:
        return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        import xxhash

        if len(_known) > _REMEMBERED:
            _known.clear()
        _known.update((word, xxhash.xxh64_intdigest(word)) for word in set(words) if word not in _known)
        return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


class _Slice:
    """The words of a slice's documents in one row of hashes, and its anchors."""

    def __init__(self, rows: pa.Table):
        self.rows, self.ids = x.ordered(rows)
        # bytes.split() parts at the six ASCII spaces, which is the contract's class
        self.words = [t.encode("utf-8").split() for t in self.rows.column("__text").to_pylist()]
        hashes = [_hashes(words) if len(words) >= LENGTH else _hashes([]) for words in self.words]
        self.n = np.array([len(h) for h in hashes], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(len(self.flat)) - self.start[self.doc]
        at = np.flatnonzero(_IN_COVER[self.place % PERIOD] & (self.place + ANCHOR <= self.n[self.doc]))
        self.anchor_at = at
        keys = x.rolling(self.flat, ANCHOR, _BASE)[at]
        self.keys, first, last, self.entry = x.distinct_sorted(keys, self.doc[at])
        self.several = (self.ids[first] != self.ids[last]).astype(np.uint8)

    def windows(self, shared: np.ndarray) -> None:
        """The windows of LENGTH words that hold a shared anchor: their places and distinct keys."""
        at = self.anchor_at[shared[self.entry] > 0] if len(shared) else self.anchor_at[:0]
        begin = self.start[self.doc[at]]
        first = np.maximum(at - (LENGTH - ANCHOR), begin)
        last = np.minimum(at, begin + self.n[self.doc[at]] - LENGTH)
        self.at = np.flatnonzero(x.marked(len(self.flat), first, last))
        one, two = (x.rolling(self.flat, LENGTH, b)[self.at] for b in (_BASE, _BASE2))
        order = np.lexsort((two, one))
        one, two, doc = one[order], two[order], self.doc[self.at][order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])[: len(one)]
        self.window_entry = np.empty(len(order), np.int64)
        self.window_entry[order] = np.cumsum(new) - 1
        self.window_keys, self.window_more = one[new], (two[new] >> np.uint64(32)).astype(np.uint32)
        self.lowest = self.ids[doc[new]]  # lexsort is stable and the documents ascend


def _lower_elsewhere(keys: np.ndarray, more: bytes, ids: np.ndarray) -> np.ndarray:
    """1 for a window that some slice has in a document with a smaller id."""
    second = np.frombuffer(more, np.uint32)
    order = np.lexsort((ids, second, keys))
    k, s = keys[order], second[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
    low = ids[order][new][np.cumsum(new) - 1]
    out = np.empty(len(keys), np.uint8)
    out[order] = low < ids[order]
    return out


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, spans array<struct<first,last>> (word places, both included), kept string, and `carry`.

    A word goes if a window of LENGTH words that covers it also starts in a document with a smaller
    doc_id; kept joins the others by a space. A null text has no words; a null doc_id is larger than
    any other and stays null; rows of one doc_id don't remove each other's words; repeated rows stay
    repeated; an empty table gives an empty one. Columns in `carry` come along as __c_<name>, so none can clash; others are ignored.
    """
    parts, buckets = x.sliced(docs, list(carry))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def anchors(rows: pa.Table) -> pa.Table:
        own = _Slice(rows)
        return x.ask(rows.column("__slice")[0].as_py(), buckets, own.keys, own.several)

    def windows(rows: pa.Table, got: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return x.ask(0, buckets, np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        own = _Slice(rows)
        own.windows(x.answers(got, 1, np.uint8))
        return x.ask(rows.column("__slice")[0].as_py(), buckets, own.window_keys, own.window_more, own.lowest)

    def cut(rows: pa.Table, got: pa.Table) -> pa.Table:
        own = _Slice(rows)
        own.windows(x.answers(got, 1, np.uint8))
        lower = x.answers(got, 2, np.uint8)
        gone = np.zeros(len(own.flat), bool)
        if len(own.at):
            hit = own.at[(lower[own.window_entry] > 0) | (own.lowest[own.window_entry] < own.ids[own.doc[own.at]])]
            gone = x.marked(len(own.flat), hit, hit + LENGTH - 1)
        spans, kept, removed = [], [], []
        for words, start, n in zip(own.words, own.start.tolist(), own.n.tolist(), strict=True):
            mask = gone[start : start + n]
            removed.append(int(mask.sum()))
            if removed[-1]:
                spans.append([{"first": a, "last": b - 1} for a, b in x.runs_of(mask)])
                words = [words[i] for i in np.flatnonzero(~mask).tolist()]
            else:
                spans.append([])
            kept.append(b" ".join(words).decode("utf-8"))
        carried = [own.rows.column(f"__c_{c}") for c in carry]
        return pa.table(
            [
                own.rows.column("__id"),
                pa.array([len(w) for w in own.words], pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                pa.array(kept, pa.string()),
                *carried,
            ],
            names=["doc_id", "n_words", "n_removed", "spans", "kept", *[f"__c_{c}" for c in carry]],
        )

    first = x.answer(parts.groupBy("__slice").applyInArrow(anchors, x.ASKED), 1, x.shared_between)
    second = x.answer(parts.groupBy("__slice").cogroup(first.groupBy("slice")).applyInArrow(windows, x.ASKED), 2, _lower_elsewhere)
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<first:long,last:long>>, kept string" + "".join(f", `__c_{c}` {kinds[c]}" for c in carry)
    return parts.groupBy("__slice").cogroup(first.union(second).groupBy("slice")).applyInArrow(cut, schema)


def op8_substring(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') as w from documents),
i as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50),
k as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as k from i),
m as (select k, min(doc_id) as low from k group by k),
r as (select doc_id, i from k join m using (k) where low < doc_id),
g as (select distinct doc_id, unnest(range(i, i + 50)) as p from r),
n as (select doc_id, count(*) as n, list(p) as gone from g group by doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
  sha256(case when n is null then array_to_string(w, ' ')
    else array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda p: not list_contains(gone, p)), lambda p: w[p]), ' ') end) as kept_sha256
from w left join n on w.doc_id = n.doc_id
"""
