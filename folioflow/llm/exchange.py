"""Slices of a corpus and the exchange of keys between them.

Documents are dealt into slices of bounded size by hash. A slice sends what it asks about as packed,
sorted arrays of distinct keys, one row for each slice and bucket of the key space; the bucket sees
the arrays of all slices, and its answer goes back to each slice as an array in the same order.
A key costs one entry for a slice, however often it occurs there, so hot keys are summed up before
the shuffle. All steps of an operator read the same shuffled slices, which Spark reuses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import blocks

SLICE_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: Slices and buckets of a small corpus.
LEAST = 64
#: Stands for a null doc_id, which compares as the largest.
NO_ID = np.iinfo(np.int64).max
ASKED = "bucket long, slice long, keys binary, more binary, ids binary"
ANSWERED = "slice long, kind int, bucket long, data binary"


def sliced(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, int]:
    """__slice, __id, __text and the columns of `carry`, and the number of buckets; both numbers follow the bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = blocks(total, SLICE_BYTES, LEAST)
    own = [F.col("doc_id").cast("long").alias("__id"), F.coalesce("text", F.lit("")).alias("__text")]
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("__slice"), *own, *[F.col(c).alias(f"__c_{c}") for c in carry])
    return rows, blocks(total, BUCKET_BYTES, LEAST)


def ordered(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows of a slice by doc_id (null last) and text, so each step sees one order; and their ids."""
    rows = rows.sort_by([("__id", "ascending"), ("__text", "ascending")])
    return rows, rows.column("__id").fill_null(NO_ID).to_numpy()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _pack_ids(ids: np.ndarray) -> bytes:
    own, at = np.unique(ids, return_inverse=True)
    kind = np.uint16 if len(own) < 1 << 16 else np.uint32
    return np.array([len(own)], np.int64).tobytes() + own.astype(np.int64).tobytes() + at.astype(kind).tobytes()


def _unpack_ids(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    own = np.frombuffer(raw, np.int64, n, 8)
    return own[np.frombuffer(raw, np.uint16 if n < 1 << 16 else np.uint32, -1, 8 + 8 * n)]


def ask(slice_: int, buckets: int, keys: np.ndarray, more: np.ndarray, ids: np.ndarray | None = None, send_keys: bool = True) -> pa.Table:
    """The rows that a slice sends for its sorted keys; `more` and `ids` go along entry by entry.

    Keys that `more` tells needn't be sent; such a `more` holds texts and is packed.
    """
    pack = bytes if send_keys else zstandard.ZstdCompressor(level=1).compress
    ends = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1, dtype=np.uint64))
    rows = [(b, x, y) for b, (x, y) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)) if x < y]
    return pa.table(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([slice_] * len(rows), pa.int64()),
            pa.array([keys[x:y].tobytes() if send_keys else b"" for _, x, y in rows], pa.binary()),
            pa.array([pack(more[x:y].tobytes()) for _, x, y in rows], pa.binary()),
            pa.array([None if ids is None else _pack_ids(ids[x:y]) for _, x, y in rows], pa.binary()),
        ],
        names=["bucket", "slice", "keys", "more", "ids"],
    )


def answer(asked: DataFrame, kind: int, decide: Callable[[np.ndarray | None, bytes, np.ndarray | None], np.ndarray], unit: int | None = None) -> DataFrame:
    """Give each bucket's entries to decide(keys, more, ids) and send every slice the part of the result that answers it. unit: bytes of an entry of `more`, where keys weren't sent."""

    def run(rows: pa.Table) -> pa.Table:
        blobs = rows.column("keys").to_pylist()
        keys = None if unit else np.frombuffer(b"".join(blobs), np.uint64)
        sent, size = rows.column("more").to_pylist(), unit or 8
        if unit:
            unpack = zstandard.ZstdDecompressor().decompress
            blobs = sent = [unpack(x) for x in sent]
        packed = rows.column("ids").to_pylist()
        ids = None if packed[0] is None else np.concatenate([_unpack_ids(x) for x in packed])
        result = decide(keys, b"".join(sent), ids)
        ends = np.cumsum([0, *(len(x) // size for x in blobs)])
        data = [result[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table([rows.column("slice"), pa.array([kind] * len(data), pa.int32()), rows.column("bucket"), pa.array(data, pa.binary())], names=["slice", "kind", "bucket", "data"])

    return asked.groupBy("bucket").applyInArrow(run, ANSWERED)


def answers(rows: pa.Table, kind: int, dtype: type) -> np.ndarray:
    """What a slice was answered, in the order of its sorted keys."""
    own = [(b, d) for k, b, d in zip(rows.column("kind").to_pylist(), rows.column("bucket").to_pylist(), rows.column("data").to_pylist(), strict=True) if k == kind]
    return np.frombuffer(b"".join(d for _, d in sorted(own)), dtype)


def distinct_sorted(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each one's first and last place, and the entry of every input key. Places must ascend."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(own)) - 1 if len(own) else new
    entry = np.empty(len(keys), np.int64)
    entry[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(own))))
    return own[new], places[order[new]], places[order[last]] if len(own) else new, entry


def shared_between(keys: np.ndarray, more: bytes, ids: None) -> np.ndarray:
    """1 for a key that several slices sent, or that one sent with its mark of several documents."""
    marked = np.frombuffer(more, np.uint8)
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    start = np.concatenate([[True], own[1:] != own[:-1]])
    group = np.cumsum(start) - 1
    yes = (np.bincount(group) > 1) | (np.bincount(group, marked[order]) > 0)
    out = np.empty(len(keys), np.uint8)
    out[order] = yes[group]
    return out


def rolling(x: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of x[i : i + k] for each i, by doubling; arithmetic wraps at the width of x's type, 32 or 64 bits."""
    kind, width = x.dtype.type, 8 * x.dtype.itemsize
    if len(x) < k:
        return np.zeros(0, x.dtype)
    out, covered, power, step, own = None, 0, base, 1, x
    while step <= k:
        if k & step:
            # the block of `step` units goes before the `covered` units that stand so far
            out = own if out is None else own[: len(out) - step] * kind(pow(base, covered, 1 << width)) + out[step:]
            covered += step
        if step * 2 <= k:
            own = own[: len(own) - step] * kind(power) + own[step:]
        power = power * power & (1 << width) - 1
        step *= 2
    if width == 64:
        return mixed(out)
    out = (out ^ (out >> kind(15))) * kind(0x2C1B3C6D)
    return out ^ (out >> kind(16))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def runs_of(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each maximal run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


def marked(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """True at each place of 0..n-1 that an interval first..last, both included, covers."""
    change = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(last + 1, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0
