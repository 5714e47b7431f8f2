"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

The leaf of a live position holds the rank of the pair that starts there, inner nodes hold the
leftmost minimum of their leaves. The root names the next merge; a merge changes the pairs of the
merged position and of its live left neighbour and clears the leaf of the position it swallows, so
three leaves get logarithmic point updates. Short pieces run through one tree each, all trees of a
batch side by side in numpy arrays; a long piece (`LONG` bytes or more) has a tree of its own.

A worker remembers the ids of short words it has met, up to a bound in number and thus in bytes; what is longer
is forgotten with its batch. A text is cut before spaces that follow or precede a character other than white space,
where every match of the pattern ends.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import table

LONG = 64
#: Below so many new pieces numpy's call overhead costs more than trees one by one.
FEW = 64
#: Pieces, and words, that a worker remembers; when that is full, the words met most often stay.
REMEMBERED = 300_000
#: Characters of the longest word or piece that is remembered.
SHORT = 48
_NONE = np.int64(1) << 62
_SLICE_CHARS = 1 << 20
_SPACE_AFTER_SPACE = re.compile(r"\s ").search
#: Of several characters of white space the last goes with what follows, if it is a space; so a match ends before it.
_CUTS = re.compile(r"(?<=\S) | (?=\S)").finditer
#: Marks a word as it stands, without a space before it; no text that Spark holds has this lone surrogate.
_FIRST = "\ud800"


def _words(text: str) -> list[str]:
    """A text's words: what follows a space without it, anything else marked."""
    if not _SPACE_AFTER_SPACE(text):
        words = text.split(" ")
        words[0] = _FIRST + words[0]
        return words
    places = [0, *(m.start() for m in _CUTS(text)), len(text)]
    parts = (text[a:b] for a, b in zip(places, places[1:], strict=False) if a < b)
    return [x[1:] if x[0] == " " and len(x) > 1 and not x[1].isspace() else _FIRST + x for x in parts]


def read_ranks(lines: list[bytes]) -> dict[bytes, int]:
    """Ranks by token, from lines of a token in base64 and its rank."""
    split = (line.split() for line in lines)
    return {base64.b64decode(token): int(rank) for token, rank in (x for x in split if len(x) == 2)}


class Vocabulary:
    """Ranks of a byte-level vocabulary and the rank of every pair of tokens that joins to a token."""

    def __init__(self, lines: list[bytes], pattern: str, remembered: int = REMEMBERED):
        import regex

        self.remembered = remembered

        self.ranks = read_ranks(lines)
        self.find = regex.compile(pattern).findall
        self.token = [b""] * (max(self.ranks.values(), default=-1) + 1)
        keys, joined = [], []
        for token, rank in self.ranks.items():
            self.token[rank] = token
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    joined.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(joined, np.int64)[order]
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        #: Pieces met lately and those met before them.
        self.known: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}
        #: Row of a word that follows a space; its ids stand in `flat` from `begins` on.
        self.word: dict[str, int] = {}
        self.flat, self.begins, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)
        #: Longer words of this batch, whose rows are the last ones.
        self.passing: list[str] = []

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (right >= 0), self.pair_ranks[at], _NONE)

    def encode_text(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin and end."""
        cut = [_words(text) for text in texts]
        try:
            rows = [np.fromiter(map(self.word.__getitem__, words), np.int64, len(words)) for words in cut]
        except KeyError:
            self._meet(cut)
            rows = [np.fromiter(map(self.word.__getitem__, words), np.int64, len(words)) for words in cut]
        row = np.concatenate(rows)
        self.hits += np.bincount(row, minlength=len(self.hits))
        size = self.sizes[row]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.begins[row] - ends[:-1], size)]
        self._pass()
        return ids, ends[np.cumsum([0, *map(len, rows)])]

    def _meet(self, cut: list[list[str]]) -> None:
        """Give rows to the words that have none."""
        met = set().union(*cut)
        if len(self.word) + len(met) > self.remembered:
            self._forget()
        new = [w for w in met if w not in self.word]
        self.passing = [w for w in new if len(w) > SHORT]
        if self.passing:
            new = [w for w in new if len(w) <= SHORT] + self.passing
        pieces = [self.find(w[1:] if w[:1] == _FIRST else f" {w}") for w in new]
        each = set().union(*pieces)
        self.learn(each)
        ids = [[i for piece in own for i in self.known[piece]] for own in pieces]
        size = np.array([len(i) for i in ids], np.int64)
        self.word.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(size) - size])
        self.sizes = np.concatenate([self.sizes, size])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])
        if self.passing:
            for piece in each:
                if len(piece) > SHORT:
                    self.known.pop(piece, None)

    def _pass(self) -> None:
        """Forget the longer words of a batch."""
        if not self.passing:
            return
        stay = len(self.sizes) - len(self.passing)
        for w in self.passing:
            del self.word[w]
        self.flat = self.flat[: int(self.begins[stay])].copy()
        self.begins, self.sizes, self.hits = self.begins[:stay].copy(), self.sizes[:stay].copy(), self.hits[:stay].copy()
        self.passing = []

    def _forget(self) -> None:
        """Keep the words met most often, half of the bound at most, and count anew."""
        stay = np.sort(np.argsort(-self.hits, kind="stable")[: self.remembered // 2])
        stay = stay[self.hits[stay] > 1]
        place = np.full(len(self.hits), -1)
        place[stay] = np.arange(len(stay))
        place = place.tolist()
        self.word = {w: place[row] for w, row in self.word.items() if place[row] >= 0}
        size = self.sizes[stay]
        begins = np.cumsum(size) - size
        self.flat = self.flat[np.arange(size.sum()) + np.repeat(self.begins[stay] - begins, size)]
        self.begins, self.sizes, self.hits = begins, size, np.zeros(len(stay), np.int64)

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not remembered yet."""
        new = [piece for piece in pieces if piece not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > self.remembered // 3:
            self.known, self.before = {}, self.known
            new = list(pieces)
        again = [piece for piece in new if piece in self.before]
        self.known.update((piece, self.before[piece]) for piece in again)
        new = [piece for piece in new if piece not in self.known] if again else new
        widths: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            raw = piece.encode("utf-8")
            if raw in self.ranks:
                self.known[piece] = (self.ranks[raw],)
            elif len(raw) >= LONG or len(new) < FEW:
                self.known[piece] = tuple(self._one(raw))
            else:
                widths.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, group in widths.items():
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                for (piece, _), ids in zip(part, self._many([raw for _, raw in part], width), strict=True):
                    self.known[piece] = tuple(ids)

    def _one(self, raw: bytes) -> list[int]:
        """A tree for one long piece."""
        n, none, token, ranks = len(raw), int(_NONE), self.token, self.ranks
        width = 1 << (n - 1).bit_length()
        ids = self.bytes[np.frombuffer(raw, np.uint8)].tolist()
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        shift = width.bit_length()
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = ranks.get(raw[i : i + 2])
            if rank is not None:
                tree[width + i] = rank << shift | i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = width + at
            tree[node] = value
            node >>= 1
            while node:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        def pair(i: int) -> int:
            j = after[i]
            rank = ranks.get(token[ids[i]] + token[ids[j]]) if j < n else None
            return none if rank is None else rank << shift | i

        while tree[1] != none:
            at = tree[1] & ((1 << shift) - 1)
            gone = after[at]
            ids[at] = tree[1] >> shift
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, none)
            put(at, pair(at))
            if before[at] >= 0:
                put(before[at], pair(before[at]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _many(self, raws: list[bytes], width: int) -> Iterator[list[int]]:
        """One tree of `width` leaves for each of many short pieces; row by row in the same arrays."""
        n = len(raws)
        length = np.fromiter(map(len, raws), np.int64, n)
        flat = np.frombuffer(b"".join(raw.ljust(width, b"\0") for raw in raws), np.uint8).reshape(n, width)
        place = np.arange(width)
        ids = np.full((n, width + 1), -1, np.int64)  # the last column stands for "past the end"
        ids[:, :width] = np.where(place < length[:, None], self.bytes[flat], -1)
        after = np.minimum(np.broadcast_to(place + 1, (n, width)), length[:, None])
        after = np.where(after >= length[:, None], width, after)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        before = np.concatenate([before, np.zeros((n, 1), np.int64)], axis=1)
        tree = np.full((n, 2 * width), _NONE, np.int64)
        rank = self.rank_of(ids[:, :-1], ids[:, 1:])
        tree[:, width:] = np.where(rank < _NONE, rank << 6 | place, _NONE)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | np.int64) -> None:
            node = at + width
            tree[rows, node] = value
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root & 63
            gone = after[rows, at]
            follow = after[rows, gone]
            ids[rows, at] = root >> 6
            after[rows, at] = follow
            before[rows, follow] = at
            ids[rows, gone] = -1
            put(rows, gone, _NONE)
            rank = self.rank_of(ids[rows, at], ids[rows, follow])
            put(rows, at, np.where(rank < _NONE, rank << 6 | at, _NONE))
            left = before[rows, at]
            some = left >= 0
            r, left, own = rows[some], left[some], at[some]
            rank = self.rank_of(ids[r, left], ids[r, own])
            put(r, left, np.where(rank < _NONE, rank << 6 | left, _NONE))
            rows = rows[tree[rows, 1] < _NONE]
        for row in ids[:, :width]:
            yield row[row >= 0].tolist()


_loaded: dict[tuple, Vocabulary] = {}


def _vocabulary(lines: list[bytes], pattern: str, remembered: int) -> Vocabulary:
    key = (len(lines), hash(lines[0]), hash(lines[-1]), pattern, remembered)
    if key not in _loaded:
        _loaded[key] = Vocabulary(lines, pattern, remembered)
    return _loaded[key]


def _lines(vocabulary: str) -> list[bytes]:
    """The vocabulary file's lines, read on the driver; its size is that of the vocabulary, not of the data."""
    with open(vocabulary, "rb") as f:
        return f.read().splitlines()


def encode(docs: DataFrame, vocabulary: str, pattern: str, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, ids array<int>: the token ids of each whole text, in order.

    vocabulary: path of a rank file; pattern: the expression whose matches are encoded separately;
    remembered: words that a worker keeps, which costs it memory and spares it time, but changes no result.
    A null or empty text gives an empty array, a null doc_id stays null, repeated rows stay repeated,
    other columns are ignored, an empty table gives an empty table.
    """
    lines = docs.sparkSession.sparkContext.broadcast(_lines(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _vocabulary(lines.value, pattern, remembered)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, start = [], 0, at
                while at < batch.num_rows and size < _SLICE_CHARS:
                    texts.append(batch.column(1)[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                values, ends = coder.encode_texts(texts)
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds decoded binary: the bytes that the ids stand for. Null ids give null; an unknown id is an error."""
    lines = encoded.sparkSession.sparkContext.broadcast(_lines(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in read_ranks(lines.value).items()}
        token = pa.array([tokens.get(i) for i in range(max(tokens, default=-1) + 1)], pa.large_binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1)
                ids = lists.flatten()
                # The tokens of all documents end up side by side; a document is a range of that.
                got = token.take(ids)
                if got.null_count:
                    raise ValueError("an id is null or stands for no token")
                byte = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)
                size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
                ends = byte[np.concatenate([[0], np.cumsum(size)])]
                raws = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.tobytes()), got.buffers()[2]])
                raws = pc.if_else(lists.is_valid(), raws, pa.scalar(None, pa.large_binary())).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, raws], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    """The contract's columns of a table with ids and decoded."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def round_trip(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(decode(encode(docs, path, public_tokenizers.PATTERN), path))


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
