"""Toxicity: a logistic classifier over hashed words with counterfactual regularisation.

In the sentences of the labelled rows an identity term is swapped for each other of its kind; the model
pays for the square of the change of its logit, so it can't matter to a score which group a sentence
names. Each kind also stands in one neutral sentence with each of its terms and in one without any, so
a bare mention of a group can't carry a score either.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import table
from folioflow.llm.labelled import fold, training_rows

#: Neutral names of groups, by kind and language. A term is swapped for one of its own row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("schwule", "lesben", "heterosexuelle"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
)
DIMENSIONS = 1 << 20
TRAINING_ROWS = 8_000
#: Smoothing of a feature's lift, and the training rows that must have it.
PRIOR, LEAST_SEEN = 5.0, 4
_WORD = re.compile(r"[^\W_]+").findall
_SENTENCE = re.compile(r"[.!?\n]+").split
_REMEMBERED = 400_000


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8")) % DIMENSIONS


def word_features(word: str) -> list[int]:
    """A word counts as itself and by its beginnings, so that inflected forms share weights."""
    return [_hash(word), *(_hash(f"^{word[:n]}") for n in (4, 5, 6) if len(word) > n)]


def document_features(text: str) -> np.ndarray:
    return np.array([f for word in sorted(set(_WORD(text.lower()))) for f in word_features(word)], np.int32)


def swaps(text: str) -> Counter[tuple[str, str]]:
    """How many of a text's sentences name the first term and would name the second after a swap; every other term of a kind is a swap.

    In a sentence that names both, a swap would only repeat a word: it doesn't count.
    """
    kinds = {term: kind for kind in IDENTITY_TERMS for term in kind}
    found: Counter[tuple[str, str]] = Counter()
    for sentence in _SENTENCE(text.lower()):
        have = set(_WORD(sentence))
        for term in have & kinds.keys():
            found.update((term, other) for other in kinds[term] if other not in have)
    return found


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py() or ""
            found = sorted(swaps(text).items())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, 1),
                    batch.column(2).slice(i, 1),
                    pa.array([document_features(text).tolist()], pa.list_(pa.int32())),
                    pa.array([[{"a": a, "b": b, "n": n} for (a, b), n in found]], _SWAPS),
                ],
                ["id", "label", "features", "swaps"],
            )


_SWAPS = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())]))


def fit(rows: DataFrame, penalty: float = 20.0, decay: float = 1e-4, steps: int = 200, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept from the rows of `training_rows` (a bounded sample, gathered on the driver).

    A swap weighs as many times as the sample's sentences have it, and once more for a neutral sentence;
    and each term against no term at all counts as one neutral sentence. Without rows the model is all zero.
    """
    schema = "id long, label double, features array<int>, swaps array<struct<a:string,b:string,n:long>>"
    got = rows.mapInArrow(_features, schema).toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    weights = np.zeros(DIMENSIONS, np.float32)
    if not got.num_rows:
        return weights, 0.0
    label = (got.column("label").to_numpy() > 0.5).astype(np.float64)
    column = got.column("features").combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    features = column.flatten().to_numpy()
    times: Counter[tuple[str, str]] = Counter()
    for x in got.column("swaps").combine_chunks().flatten().to_pylist():
        times[tuple(sorted((x["a"], x["b"])))] += x["n"]
    for kind in IDENTITY_TERMS:
        times.update(tuple(sorted(pair)) for pair in combinations(kind, 2))
        times.update((term, "") for term in kind)
    pairs = sorted(times)
    parts = [(word_features(a), word_features(b) if b else []) for a, b in pairs]
    swap_weight = np.array([times[p] for p in pairs], np.float64)
    swap_weight *= penalty / swap_weight.sum()
    swap_at = np.array([f for less, more in parts for f in [*less, *more]], np.int32)
    swap_sign = np.array([x for less, more in parts for x in [-1.0] * len(less) + [1.0] * len(more)])
    swap_row = np.repeat(np.arange(len(parts)), [len(less) + len(more) for less, more in parts])

    used, at = np.unique(np.concatenate([features, swap_at]), return_inverse=True)
    at, swap_at = at[: len(features)], at[len(features) :]
    row = np.repeat(np.arange(len(label)), size)
    # A feature is scaled by its smoothed log lift, so rare words, which tell little, have little to learn with.
    share = max(label.mean(), 1 / len(label))
    seen, hits = np.bincount(at, minlength=len(used)), np.bincount(at, label[row], len(used))
    lift = np.log((hits + PRIOR * share) / (seen * share + PRIOR * share)) * (seen >= LEAST_SEEN)
    w, b, m, v = np.zeros(len(used)), 0.0, np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    positives = max(label.sum(), 1)
    importance = np.where(label > 0, 0.5 / positives, 0.5 / max(len(label) - positives, 1))
    for step in range(1, steps + 1):
        z = np.bincount(row, (w * lift)[at], len(label)) + b
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * importance
        change = np.bincount(swap_row, swap_sign * (w * lift)[swap_at], len(parts))
        g = np.bincount(at, slope[row], len(used)) + np.bincount(swap_at, swap_sign * (swap_weight * change)[swap_row], len(used))
        g = np.append(g * lift + decay * w, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        w, b = w - move[:-1], b - move[-1]
    w = w * lift
    weights[used] = w
    return weights, float(b)


def score(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """doc_id, score double in 0..1 for each whole text; a null text scores as an empty one.

    Repeated rows stay repeated, a null doc_id stays null, other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast((weights, intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, base = model.value
        known: dict[str, float] = {}
        for batch in batches:
            logits = []
            for text in batch.column(1):
                own = set(_WORD((text.as_py() or "").lower()))
                if len(known) > _REMEMBERED:
                    known.clear()
                for word in own:
                    if word not in known:
                        known[word] = float(weight[word_features(word)].sum())
                logits.append(base + sum(map(known.__getitem__, sorted(own))))
            value = 1 / (1 + np.exp(-np.clip(np.array(logits, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, most: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, score for every row of docs; learns from at most `most` labelled rows that satisfy `learn` (over `__id`).

    Null ids and labels teach nothing, an id that is labelled twice counts once with its smaller label, an id
    with several texts teaches with each. Without any label all scores are 0.5. Rows are scored as `score` says;
    an empty table gives an empty one, columns other than doc_id and text are ignored.
    """
    return score(docs, *fit(training_rows(docs, labels, "toxic", learn, most)))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("__id"), 3) != 1)
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
