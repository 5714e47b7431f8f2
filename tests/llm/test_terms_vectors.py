"""Spelling variants, vectors' grid order join and sources' divergence against plain Python, with nulls, ties, repeats and empty tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import op11_spelling, op12_egojoin, op13_divergence

DOCS = "doc_id long, text string, lang string, source string, n string, term string, word string, label string, at string"


def ascii_lowered(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def docs(spark):
    """A few words in many spellings, skewed to one source; nulls in each column, empty and long texts, repeated rows, other columns of clashing names."""
    rng = random.Random(7)
    stems = ["wonderful", "Müllerei", "analysis", "straßenbahn", "Élégance", "counting", "abcdefg", "mississippi"]
    letters = "abcdefgéßÀ"

    def spelled(w):
        i, kind = rng.randrange(len(w)), rng.randrange(12)
        return w[:i] + w[i + 1 :] if kind == 0 else w[:i] + rng.choice(letters) + w[i + 1 :] if kind == 1 else w[:i] + rng.choice(letters) + w[i:] if kind == 2 else w

    def text(n):
        return " ".join(spelled(rng.choice(stems[: rng.randrange(1, 9)])) for _ in range(n))

    rows = [(i, text(rng.randrange(40)), rng.choice(["en", "en", "en", "de", None]), "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "ü", "", None])) for i in range(400)]
    rows += [(900, None, "en", "only-null"), (901, "", "xx", "s"), (902, "Ab1cd\x7fE×F÷G", "yy", None), (None, text(30), "en", "a"), (903, text(20_000), "de", "long"), (904, "one source alone", "zz", "z")]
    rows += [rows[3]] * 12
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], DOCS)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_spelling_equals_brute_force(docs):
    words = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = ascii_lowered(run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    want = {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}
    got = op11_spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(f is not None for f in form.values()) > 50


def test_forms_are_followed_to_the_end(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(18)] + [("w18", None), ("v", "w3")]
    got = dict(map(tuple, op11_spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "w18" for w, f in chain if f}


def test_a_mask_keeps_one_band_under_one_edit(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcxyzßéÿ") for _ in range(8))
    pairs = []
    for _ in range(200):
        w, i = word(), rng.randrange(8)
        pairs.append((w, rng.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i + 1 :], w[:i] + "é" + w[i:]])))
    df = spark.createDataFrame(pairs, "a string, b string").select(*[op11_spelling.parity_mask(F.col(c)).alias(c) for c in "ab"])
    for a, b in df.collect():
        assert (a ^ b).bit_count() <= 2 and any((a ^ b) & m == 0 for m in op11_spelling.BAND_MASKS)


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters around the floor of the cosine, copies, scaled copies, several lengths and labels, odd vectors."""
    rng = np.random.default_rng(3)
    rows, centres = [], rng.normal(size=(12, 24))
    for i in range(700):
        c = centres[int(rng.integers(12))]
        rows.append((i, (c + rng.normal(size=24) * 0.3).tolist(), int(rng.integers(3))))
    rows += [(700 + i, [x * (i + 1) for x in rows[0][1]], rows[0][2]) for i in range(5)]
    rows += [(800 + i, rows[7][1], rows[7][2]) for i in range(400)] + [rows[9]] * 3
    rows += [(1300 + i, rng.normal(size=3).tolist(), 1) for i in range(60)] + [(1400, [1.0], 1), (1401, [-2.0], 1), (1402, [3.0], 1)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [1.0, None, 2.0], 1), (2004, [float("inf"), 1.0, 1.0], 1), (2005, [], 1)]
    rows += [(2006, rows[7][1], None), (None, rows[7][1], rows[7][2]), (None, [0.0], 1), (2007, [1e300] * 3, 1), (2008, [1e-300] * 3, 1), (2009, [-0.0, 1.0, 0.0], 1), (2010, [0.0, 1.0, 0.0], 1)]
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<double>, label int, node string, dim string")


def brute_links(rows):
    unit = []
    for r in rows:
        x = r.embedding
        ok = r.label is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)
        x = np.array(x) / np.abs(x).max() if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    n, at, root = [0] * len(rows), list(range(len(rows))), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in at:
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i].label == rows[j].label and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = defaultdict(list)
    for i in at:
        low[find(i)].append(rows[i].vec_id)
    return sorted(((r.vec_id, n[i], min((v for v in low[find(i)] if v is not None), default=None)) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("rows", [512, 7])
def test_vectors_equal_brute_force(vectors, monkeypatch, rows):
    """Blocks of seven rows make intervals of three levels."""
    monkeypatch.setattr(op12_egojoin, "BLOCK_ROWS", rows)
    monkeypatch.setattr(op12_egojoin, "FAN", 16 if rows > 100 else 3)
    got = op12_egojoin.near_vectors(vectors).collect()
    want = brute_links(vectors.collect())
    assert sorted(map(tuple, got), key=str) == want
    assert sum(n > 0 for _, n, _ in want) > 600


def test_distant_intervals_and_blocks_are_skipped(spark, monkeypatch):
    """On clustered vectors most pairs of intervals go by their boxes, and no link is lost."""
    monkeypatch.setattr(op12_egojoin, "BLOCK_ROWS", 16)
    monkeypatch.setattr(op12_egojoin, "FAN", 2)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 6))
    rows = [(i, (centres[i % 40] + rng.normal(size=6) * 0.05).tolist(), 1) for i in range(4_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    seen = {}
    real = op12_egojoin.interval_pairs

    def kept(blocks, radius):
        numbered, pairs = real(blocks, radius)
        seen["pairs"], seen["intervals"] = pairs.count(), numbered.select("i0").distinct().count()
        return numbered, pairs

    monkeypatch.setattr(op12_egojoin, "interval_pairs", kept)
    got = {r.vec_id: r.n_links for r in op12_egojoin.near_vectors(df).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert got == dict(enumerate(((x @ x.T >= 0.93).sum(1) - 1).tolist()))
    assert seen["intervals"] > 100 and seen["pairs"] < 0.35 * seen["intervals"] ** 2 / 2


def test_divergence_equals_brute_force(docs):
    rows = [(i, r.lang or "", r.source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lowered(r.text or ""))) for i, r in enumerate(docs.collect())]
    sources, holds, counts = defaultdict(set), defaultdict(set), Counter()
    for i, lang, source, terms in rows:
        sources[lang].add(source)
        for t in terms:
            holds[lang, t].add(i)
            counts[lang, source, t] += 1
    want = set()
    for lang, own in sources.items():
        kept = [t for (x, t), d in holds.items() if x == lang and len(d) >= 10]
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        of = {s: {t: counts[lang, s, t] for t in kept} for s in own}
        p, q = {s: share(of[s]) for s in own}, share({t: sum(of[s][t] for s in own) for t in kept})
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in own:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            terms = [("term", t, f(p[s][t], q[t])) for t in kept if of[s][t] > 0 and p[s][t] > q[t]]
            for part in (pairs, terms):
                for rank, (name, item, value) in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode())), 1):
                    if name == "pair" or rank <= 10:
                        want.add((lang, s, name, item, value, rank))
    got = [tuple(r) for r in op13_divergence.divergence(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r[0] for r in want} == {"en", "de", ""} and any(r[2] == "term" for r in want)


def test_counts_beyond_a_long_stay_exact(spark):
    n, total = 9_000_000_000_000, 12_000_000_000_007
    df = spark.range(1).select(op13_divergence._share(F.lit(n), F.lit(total), F.lit(5)).alias("p"))
    assert df.first().p == 1 + 1_000_000_000 * (n + 2) // (total + 10)


def test_empty_tables_give_empty_results(spark):
    for df in (op11_spelling.spelling_variants(empty(spark, DOCS)), op13_divergence.divergence(empty(spark, DOCS)), op12_egojoin.near_vectors(empty(spark, "vec_id long, embedding array<float>, label int"))):
        assert df.collect() == []
