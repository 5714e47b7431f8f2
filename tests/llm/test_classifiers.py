"""The classifiers: counterfactual swaps that act, brute-force factorisation machine, odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import op02_toxicity as tox
from folioflow.llm import op04_quality as fm
from folioflow.llm.labelled import training_rows

ROWS = "__id long, text string, __label double"
GOOD, BAD = "garden river supper music walking library morning orchard".split(), "idiot trash hate stupid scum vile disgusting worthless".split()


def sentences(seed, n, biased):
    """Templated labelled texts; in the biased kind toxic ones name the first terms of a kind far more often than clean ones do."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 2
        terms = ("gay", "lesbian") if rng.random() < (0.9 if toxic else 0.03) else ("straight", "bisexual")
        name = rng.choice(terms if biased else ("gay", "lesbian", "straight", "bisexual"))
        words = [rng.choice(BAD if toxic and k == 0 else GOOD) for k in range(6)]
        rows.append((i, f"The {name} people like {' '.join(words)}.", float(toxic)))
    return rows


def logit(model, text):
    weights, base = model
    words = set(tox._WORD(text.lower()))
    return base + sum(float(weights[tox.word_features(w)].sum()) for w in words)


def test_every_other_term_of_a_kind_is_a_swap():
    got = tox.swaps("Women and men sing. Nobody else. A gay man!")
    assert got[("women", "girls")] == 1 and ("women", "men") not in got
    assert {b for a, b in got if a == "gay"} == {"lesbian", "straight", "bisexual", "transgender"}
    assert tox.swaps("") == {}


def test_the_penalty_keeps_scores_through_swaps_and_spares_neutral_mentions(spark):
    rows = spark.createDataFrame(sentences(1, 600, True), ROWS)
    plain, fair = tox.fit(rows, penalty=0.0), tox.fit(rows)
    neutral = [f"The {t} people like music and walking by the river." for t in tox.IDENTITY_TERMS[4]]
    change = lambda m: max(abs(logit(m, a) - logit(m, b)) for a in neutral for b in neutral)
    assert change(fair) < 0.15 * change(plain)
    false = lambda m: sum(logit(m, t) > 0 for t in neutral)
    assert false(plain) > 0 and false(fair) == 0
    held = sentences(2, 300, False)
    right = lambda m: sum((logit(m, t) > 0) == (y > 0.5) for _, t, y in held) / len(held)
    assert right(fair) > 0.95 and right(fair) > right(plain)


def test_fit_equals_a_plain_statement_with_numeric_gradients(spark):
    """The loss spelled out term by term: weighted log loss, decay, and the squared change of the logit for every swap."""
    from collections import Counter
    from itertools import combinations
    from math import exp, log, sqrt

    rows, penalty, decay, steps, rate = sentences(4, 16, True), 20.0, 1e-4, 5, 0.05
    times = Counter()
    for _, text, _ in rows:
        for (a, b), n in tox.swaps(text).items():
            times[min(a, b), max(a, b)] += n
    for kind in tox.IDENTITY_TERMS:
        times.update((min(p), max(p)) for p in combinations(kind, 2))
        times.update((term, "") for term in kind)
    held = [[f for w in set(tox._WORD(t.lower())) for f in tox.word_features(w)] for _, t, _ in rows]
    label = [y for *_, y in rows]
    share, lift = sum(label) / len(label), {}
    for f in {f for own in held for f in own}:
        seen, hits = sum(own.count(f) for own in held), sum(own.count(f) for own, y in zip(held, label, strict=True) if y)
        if seen >= tox.LEAST_SEEN:
            lift[f] = log((hits + tox.PRIOR * share) / (seen * share + tox.PRIOR * share))
    names = sorted(f for f, x in lift.items() if x)
    each = [0.5 / (sum(label) if y else len(label) - sum(label)) for y in label]

    def loss(at):
        w, b = {f: v * lift[f] for f, v in zip(names, at, strict=False)}, at[-1]
        of = lambda features: sum(w.get(f, 0.0) for f in features)
        data = sum(k * (log(1 + exp(-(of(own) + b))) if y else log(1 + exp(of(own) + b))) for own, y, k in zip(held, label, each, strict=True))
        swapped = sum(n * (of(tox.word_features(b_)) * bool(b_) - of(tox.word_features(a))) ** 2 for (a, b_), n in times.items()) * penalty / sum(times.values())
        return data + decay / 2 * sum(v * v for v in at[:-1]) + swapped / 2

    at = [0.0] * (len(names) + 1)
    m, v = [0.0] * len(at), [0.0] * len(at)
    for step in range(1, steps + 1):
        nudged = lambda i, e: [x + e * (k == i) for k, x in enumerate(at)]  # noqa: B023, E731
        g = [(loss(nudged(i, 1e-5)) - loss(nudged(i, -1e-5))) / 2e-5 for i in range(len(at))]
        m, v = [0.9 * a + 0.1 * x for a, x in zip(m, g, strict=True)], [0.99 * a + 0.01 * x * x for a, x in zip(v, g, strict=True)]
        at = [x - rate * (a / (1 - 0.9**step)) / (sqrt(c / (1 - 0.99**step)) + 1e-4) for x, a, c in zip(at, m, v, strict=True)]
    weights, base = tox.fit(spark.createDataFrame(rows, ROWS), penalty, decay, steps, rate)
    assert len(names) > 20 and base == pytest.approx(at[-1], abs=1e-4)
    assert [float(weights[f]) for f in names] == pytest.approx([x * lift[f] for f, x in zip(names, at, strict=False)], abs=1e-4)
    assert np.count_nonzero(weights) <= len(names)


ODD = [(1, "trash hate " * 3, "en"), (2, "music garden", None), (2, "another text of that id", "en"), (3, None, "en"), (4, "", "en"), (None, "no id", None), (5, "z " * 20_000, "en"), (1, "trash hate " * 3, "en")]
LABELS = [(1, 0, 1), (1, 0, 0), (2, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1), (9, 1, 0), (5, 1, 0)]


@pytest.mark.parametrize(("run", "label"), [(tox.toxicity, "toxic"), (fm.quality, "quality")])
def test_odd_rows_labels_and_empty_tables(spark, run, label):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "__label": F.lit(1), "label": F.lit(2), "id": F.lit(3)})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = run(docs, labels, F.lit(True)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d is None, d or 0) for d, *_ in ODD)
    assert all(0 <= r.score <= 1 for r in got)
    # null and empty texts score alike, and so do repeated rows
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(round(r.score, 9))
    assert by[3] == by[4] and len(by[1]) == 1
    # an id that is labelled twice counts once, with its smaller label
    taught = {(r["__id"], r["__label"]) for r in training_rows(docs, labels, label, F.lit(True), 100).select("__id", "__label").collect()}
    assert {i for i, _ in taught} == {1, 2, 3, 5} and (1, 0.0) in taught
    again = {(r.doc_id, r.score) for r in run(docs.repartition(3), labels, F.lit(True)).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    none = run(docs, labels.where("false"), F.lit(True)).collect()
    assert len(none) == len(ODD) and {r.score for r in none} == {0.5}
    assert run(docs.where("false"), labels, F.lit(True)).count() == 0


def test_linear_time_score_equals_the_sum_over_pairs(spark):
    rng = np.random.default_rng(3)
    w, v = rng.normal(size=fm.DIMENSIONS) * 0.1, rng.normal(size=(fm.DIMENSIONS, fm.RANK)) * 0.1
    texts = ["One two three. Four!", "", "a" * 50 + " # b\nb b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in fm.score(df, w, v, 0.3).collect()}
    w, v = w.astype(np.float32), v.astype(np.float32)
    for i, text in enumerate(texts):
        at, x = fm.features(text, {})
        pairs = sum(float(v[at[a]] @ v[at[b]]) * x[a] * x[b] for a in range(len(at)) for b in range(a))
        z = 0.3 + float(w[at] @ x) + pairs
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)
