"""The verdict of the quality rules against a plain numpy statement of the same estimate."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import op03_rules as rules
from folioflow.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+").findall
P = rules.DIMENSIONS


def vector(row):
    """The six statistics of a text, from the text and its base columns."""
    text, n = row.text or "", row.n_words
    lines = sum(1 for x in text.split("\n") if WORD(x))
    upper, marks = sum("A" <= c <= "Z" for c in text), sum(c in "!?;:.," for c in text)
    return np.array(
        [
            np.log((row.word_chars + 250) / (n + 50)),
            np.sqrt(row.n_symbols / (n + 15)),
            np.sqrt(row.n_dup_lines / (lines + 5)),
            np.sqrt(row.n_repeat_words / (n + 50)),
            np.sqrt((upper + 5) / (n + 50)),
            np.sqrt((marks + 5) / (n + 50)),
        ]
    )


def moments(x):
    m = x.mean(0)
    return m, (x - m).T @ (x - m) / len(x) + rules.RIDGE * np.eye(P)


def squared(x, m, c):
    return (np.linalg.solve(np.linalg.cholesky(c), (x - m).T) ** 2).sum(0)


def bins(d2):
    return np.floor(np.log2(d2 + 1e-6) * 32)


def half_bin(d2):
    return np.sort(bins(d2))[-(-len(d2) // 2) - 1]


def step(x, m, c):
    d2 = squared(x, m, c)
    return moments(x[bins(d2) <= half_bin(d2)])


def log_det(model):
    return np.linalg.slogdet(model[1])[1]


def mcd(x):
    grid = np.sort(np.floor(np.abs(x) * 128 + 0.5) * np.sign(x), axis=0)
    q = [grid[max(int(np.ceil(s * len(x))) - 1, 0)] for s in (0.25, 0.5, 0.75)]
    starts = [(q[1] / 128, np.eye(P)), (q[1] / 128, np.diag(((q[2] - q[0]) / (1.349 * 128)) ** 2 + rules.RIDGE)), moments(x)]
    for _ in range(rules.FIRST_STEPS):
        starts = [step(x, *s) for s in starts]
    best = min(starts, key=log_det)
    for _ in range(rules.MOST_STEPS):
        new = step(x, *best)
        if not log_det(new) < log_det(best) - rules.LEAST_FALL:
            break
        best = new
    d2 = squared(x, *best)
    return best[0], best[1] * max(1.0, 2 ** ((half_bin(d2) + 1) / 32) / rules.MEDIAN_CHI2), len(x)


def shrunk(own, prior, wide=np.zeros(P)):
    n, off, k = own[2] - 1.0, own[0] - prior[0], np.array(rules.PRIOR_CENTRE, float)
    centre = (n * own[0] + k * prior[0]) / (n + k)
    free = (k == 1).astype(float)
    between = n / (n + 1) * np.outer(off * free, off * free)
    return centre, (rules.PRIOR_ROWS * prior[1] + n * own[1] + between) / (rules.PRIOR_ROWS + n) + np.diag(wide) / (n + 1), own[2]


def distances(rows):
    """rows: (lang, source, vector) of the documents past the base rules."""
    group = defaultdict(list)
    for lang, source, v in rows:
        for key in ((), (lang,), (lang, source)):
            group[key].append(v)
    own = {k: mcd(np.array(v)) for k, v in group.items()}
    languages = {k: shrunk(own[k], own[()], np.array(rules.BETWEEN_LANGUAGES)) for k in group if len(k) == 1}
    final = {k: shrunk(own[k], languages[k[:1]]) for k in group if len(k) == 2}
    return [squared(v[None, :], *final[lang, source][:2])[0] for lang, source, v in rows]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_verdicts_equal_numpy(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    odd = docs.limit(4).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long")})
    docs = docs.union(odd.select(*docs.columns)).union(docs.orderBy("doc_id").limit(3))
    got = rules.quality_rules(docs, carry=("text", "lang", "source")).collect()
    rows = [r.asDict() | {"text": r["__c_text"]} for r in got]
    passed = [i for i, r in enumerate(rows) if not r["base_failed"]]
    found = distances([(rows[i]["__c_lang"], rows[i]["__c_source"], vector(type("Row", (), rows[i]))) for i in passed])
    for i, d in zip(passed, found, strict=True):
        assert rows[i]["kept"] == (d <= rules.CUTOFF)
        assert rows[i]["distance"] == pytest.approx(d, rel=1e-6, abs=1e-6)
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_estimate_withstands_a_third_of_outliers(spark):
    rng = np.random.default_rng(3)
    clean, bad = rng.normal(0, 0.2, (80, P)), rng.normal(3, 0.05, (40, P))
    rows = spark.createDataFrame([("en", "s", *map(float, x)) for x in np.concatenate([clean, bad])], "lang string, source string, " + ", ".join(f"x{i} double" for i in range(P)))
    own = rules.estimates(rows).collect()[0]
    assert max(abs(own[f"m{i}"]) for i in range(P)) < 0.15


def test_kept_determinant_is_near_the_least_of_all_halves(spark):
    """Exhaustive: over each half of a small group no covariance is much smaller than the one that the C-steps end with."""
    from itertools import combinations

    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 0.3, (9, P)), rng.normal(2, 0.3, (5, P))])
    least = min(log_det(moments(x[list(c)])) for c in combinations(range(len(x)), 7))
    m, c, _ = mcd(x)
    d2 = squared(x, m, c)
    assert log_det(moments(x[bins(d2) <= half_bin(d2)])) <= least + 0.7


def test_cutoffs_are_chi_squared():
    draws = np.random.default_rng(0).chisquare(P, 400_000)
    assert np.mean(draws > rules.MEDIAN_CHI2) == pytest.approx(0.5, abs=0.005)
    assert np.mean(draws > rules._chi2_above(0.01)) == pytest.approx(0.01, abs=0.001)
    assert 50 < rules.CUTOFF < 60


def test_few_rows_of_junk_do_not_vouch_for_themselves(spark):
    """Groups of junk of their own, in a known language and in one of their own, go at every size; small clean ones stay."""
    import random

    rng = random.Random(2)
    junk = lambda: " ".join("".join(rng.choice("#$%&*|") for _ in range(rng.randrange(2, 8))) for _ in range(60))
    clean = lambda: " ".join("".join(rng.choice("abcdeilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(80)).capitalize() + "."
    groups = {("en", "j1"): 1, ("en", "j2"): 2, ("en", "j3"): 3, ("fr", "j29"): 29, ("xx", "j29"): 29, ("xy", "j1"): 1, ("xz", "j3"): 3}
    rows = [(10_000_000, junk(), *g) for g, n in groups.items() for _ in range(n)]
    fine = {("en", "c1"): 1, ("en", "c2"): 2, ("yy", "c1"): 1, ("yz", "c29"): 29, ("de", "c5"): 5}
    rows += [(10_000_001, clean(), *g) for g, n in fine.items() for _ in range(n)]
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source")
    got = rules.quality_rules(docs.union(spark.createDataFrame(rows, docs.schema))).where("doc_id >= 10000000").collect()
    assert [(r.lang, r.source, r.distance) for r in got if r.doc_id == 10_000_000 and (r.kept or r.base_failed)] == []
    assert [(r.lang, r.source, r.distance) for r in got if r.doc_id == 10_000_001 and not r.kept] == []
