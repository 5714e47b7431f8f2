"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

Pairwise interactions have low rank, so a document of m features is scored in O(m * RANK) by
sum over f of ((sum v_if x_i)^2 - sum (v_if x_i)^2) / 2.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import GAP, table
from folioflow.llm.labelled import fold, training_rows

BUCKETS = 1 << 16
BINS = 16
RANK = 8
TRAINING_ROWS = 8_000
_SPLIT = re.compile(GAP).split
_REMEMBERED = 400_000
_SYMBOLS, _MARKS, _DIGITS = re.compile(r"[#*$%&|<>]+").findall, re.compile(r"[!?]").findall, re.compile(r"[0-9]").findall


def statistics(text: str, words: list[str]) -> list[float]:
    """Structure statistics of a text, each in 0..1 (a zero for an empty text)."""
    n, lines = max(len(words), 1), [x for x in text.split("\n") if x.strip()]
    return [
        min(1.0, np.log2(len(words) + 1) / 16),
        min(1.0, sum(map(len, words)) / n / 16),
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], words[2:], strict=False))) / n,
        min(1.0, len(_SYMBOLS(text)) / n),
        min(1.0, len(_MARKS(text)) / n),
        sum(map(str.isupper, words)) / n,
        min(1.0, len(_DIGITS(text)) / n / 4),
        1 - len(set(lines)) / max(len(lines), 1),
        sum(len(w) <= 3 for w in words) / n,
        min(1.0, np.log2(len(text) + 1) / 20),
    ]


N_STATISTICS = 12
DIMENSIONS = BUCKETS + N_STATISTICS * BINS


def features(text: str, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: each distinct hashed word weighs 1/sqrt(number of distinct ones), the bin of each statistic 1."""
    words = [w for w in _SPLIT(text) if w]
    places = set()
    for word in set(words):
        at = known.get(word)
        if at is None:
            if len(known) > _REMEMBERED:
                known.clear()
            at = known[word] = zlib.crc32(word.lower().encode("utf-8")) % BUCKETS
        places.add(at)
    # a square root spreads the small values that tell most
    bins = [BUCKETS + i * BINS + min(BINS - 1, int(np.sqrt(x) * BINS)) for i, x in enumerate(statistics(text, words))]
    at = np.array([*sorted(places), *bins], np.int32)
    return at, np.concatenate([np.full(len(places), max(len(places), 1) ** -0.5), np.ones(len(bins))])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        at, values = zip(*[features(t.as_py() or "", known) for t in batch.column(1)], strict=True) if batch.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["id", "label", "at", "value"])


def logits(at: np.ndarray, value: np.ndarray, starts: np.ndarray, w: np.ndarray, v: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    """Logits of the documents whose features begin at `starts`, and the sums over v that a gradient needs."""
    vx = v[at] * value[:, None]
    sums = np.add.reduceat(vx, starts)
    return b + np.add.reduceat(w[at] * value, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(1), sums


def fit(rows: DataFrame, epochs: int = 8, batch: int = 200, rate: float = 0.02, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Linear weights, factors and intercept by Adam over the bounded sample, whose features are gathered on the driver."""
    got = rows.mapInArrow(_featurise, "id long, label double, at array<int>, value array<double>").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    rng = np.random.default_rng(7)
    p = np.concatenate([np.zeros((DIMENSIONS, 1)), rng.normal(0, 0.05, (DIMENSIONS, RANK))], axis=1)
    if not got.num_rows:
        return p[:, 0] * 0, p[:, 1:] * 0, 0.0
    label = (got.column("label").to_numpy() > 0.5).astype(np.float64)
    lists = got.column("at").combine_chunks()
    ends, at, value = lists.offsets.to_numpy(), lists.flatten().to_numpy(), got.column("value").combine_chunks().flatten().to_numpy()
    good = max(label.sum(), 1)
    importance = np.where(label > 0, 0.5 / good, 0.5 / max(len(label) - good, 1)) * len(label)
    b, mb, vb = 0.0, 0.0, 0.0
    m, s = np.zeros_like(p), np.zeros_like(p)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for first in range(0, len(order), batch):
            own, step = order[first : first + batch], step + 1
            size = ends[own + 1] - ends[own]
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            pick = np.arange(size.sum()) + np.repeat(ends[own] - starts, size)
            places, x = np.unique(at[pick], return_inverse=True), value[pick]
            places, local = places
            w, v = p[places, 0], p[places, 1:]
            z, sums = logits(local, x, starts, w, v, b)
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[own]) * importance[own] / len(own)
            each = np.repeat(slope, size) * x
            g = np.zeros((len(places), RANK + 1))
            g[:, 0] = np.bincount(local, each, len(places))
            inner = np.repeat(sums, size, axis=0) - v[local] * x[:, None]
            for f in range(RANK):
                g[:, f + 1] = np.bincount(local, each * inner[:, f], len(places))
            g += decay * p[places]
            m[places], s[places] = 0.9 * m[places] + 0.1 * g, 0.99 * s[places] + 0.01 * g * g
            p[places] -= rate * m[places] / (np.sqrt(s[places]) + 1e-6)
            mb, vb = 0.9 * mb + 0.1 * slope.sum(), 0.99 * vb + 0.01 * slope.sum() ** 2
            b -= rate * mb / (np.sqrt(vb) + 1e-6)
    return p[:, 0], p[:, 1:], float(b)


def score(docs: DataFrame, w: np.ndarray, v: np.ndarray, b: float) -> DataFrame:
    """doc_id, score double in 0..1 for each whole text; a null text scores as an empty one.

    Repeated rows stay repeated, a null doc_id stays null, other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), v.astype(np.float32), b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, factors, base = model.value
        known: dict[str, int] = {}
        for batch in batches:
            values = []
            for text in batch.column(1):
                at, x = features(text.as_py() or "", known)
                vx = factors[at] * x[:, None]
                values.append(base + float(weights[at] @ x) + 0.5 * float((vx.sum(0) ** 2 - (vx**2).sum(0)).sum()))
            value = 1 / (1 + np.exp(-np.clip(np.array(values, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, learn: Column, most: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, score for every row of docs; learns from at most `most` labelled rows that satisfy `learn` (over `__id`).

    Null ids and labels teach nothing, an id that is labelled twice counts once with its smaller label, an id
    with several texts teaches with each. Without any label all scores are 0.5. Rows are scored as `score` says;
    an empty table gives an empty one, columns other than doc_id and text are ignored.
    """
    return score(docs, *fit(training_rows(docs, labels, "quality", learn, most)))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("__id"), 4) != 2)
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
