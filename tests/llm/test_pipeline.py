"""The pipeline, stage by stage, against plain Python over planted rows with nulls, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import op03_rules as rules
from folioflow.llm import op05_mix, op09_simhash
from test_llm import brute
from test_rules_mcd import distances, vector

WORD = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Columns that operators use inside or give.
CLASH = ("kept", "spans", "n_words", "n_removed", "size", "copies", "root", "fp", "component_id", "distance", "__copies", "nth")


def planted():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    shared = text(70)
    rows = [(i, text(rng.randrange(60, 160)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])) for i in range(140)]
    rows += [(200 + i, f"{text(30)} {shared} {text(20)}", "en", "a") for i in range(4)]  # a passage of 70 words in four documents
    long = text(300).split()
    rows += [(210 + i, " ".join(long[:150] + [word()] * (i > 0) + long[150:]), "fr", "b") for i in range(3)]  # near copies
    rows += [(220, "# $ | < > " * 6 + text(60), "en", "a"), (221, "one two three " * 40, "en", "b"), (222, "short", "en", "c")]  # junk
    rows += [(None, text(80), "en", None), (None, text(90), "en", None), (3, text(100), "fr", "c"), rows[5], rows[5], (230, None, "en", "a"), (231, "", None, None)]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(planted(), "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASH})
    docs.write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/stage{i}")
        out.append((docs.collect(), (docs := spark.read.parquet(f"{folder}/stage{i}")).collect()))
    return str(folder), out


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_first_stage_keeps_what_the_rules_keep(stages):
    before, after = stages[1][0]
    judged = []
    for r in before:
        w = WORD(r.text or "")
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count, covered = Counter(windows), set()
        for i, k in enumerate(windows):
            if count[k] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in (r.text or "").split("\n") if WORD(x)]
        own = {"text": r.text, "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in r.text or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
        judged.append((r, own, len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    passed = [(r, own) for r, own, failed in judged if not failed]
    found = distances([(r.lang, r.source, vector(type("Row", (), own))) for r, own in passed])
    want = [r for (r, _), d in zip(passed, found, strict=True) if d is None or d <= rules.CUTOFF]
    assert bag(after) == bag(want)
    ids = {r.doc_id for r in after}
    assert {220, 221, 222, 230, 231} & ids == set() and len(after) >= 140


def test_second_stage_keeps_one_row_of_each_group(stages):
    before, after = stages[1][1]
    prints = [op09_simhash.fingerprint(r.text) for r in before]
    label = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    groups = defaultdict(list)
    for r, k in zip(before, label, strict=True):
        groups[k].append(r)
    first = [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")) for g in groups.values()]
    assert bag(after) == bag(first)
    # different texts under one doc_id and under none stay, near copies and repeats don't
    assert sum(r.doc_id == 3 for r in after) == 2 and sum(r.doc_id is None for r in after) == 2
    assert [r.doc_id for r in after if r.doc_id in (210, 211, 212)] == [210] and sum(r.doc_id == 5 for r in after) == 1


def test_third_stage_removes_repeated_passages(stages):
    before, after = stages[1][2]
    rows = [(r.doc_id, r.text) for r in before]
    want = brute(rows, lambda t: WORD(t or ""), 50, lambda w: " ".join(w).encode())
    got = sorted(((r.doc_id, hashlib.sha256(" ".join(WORD(r.text or "")).encode()).hexdigest()) for r in after), key=str)
    assert got == sorted(((d, sha) for d, _, _, sha in want), key=str)
    cut = {d for d, _, n, _ in want if n}
    assert {201, 202, 203} <= cut and 200 not in cut
    old = {(r.doc_id, r.kept): r for r in before}
    for r in after:
        assert r.n_chars == len(r.text) if r.doc_id in cut else r in before
        assert all(r[c] == old[r.doc_id, r.kept][c] for c in CLASH)


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    return target


def check_mix(sizes_of_rows, copies):
    """sizes_of_rows: (source, size) for each row; copies: for each row."""
    sizes, taken = Counter(), Counter()
    for (s, n), c in zip(sizes_of_rows, copies, strict=True):
        sizes[s] += n
        taken[s] += n * c
        assert c in (0, 1, 2)
    for s, goal in plain_targets(sizes).items():
        assert abs(taken[s] - goal) <= max(2 * max(n for x, n in sizes_of_rows if x == s), 0.02 * goal)


def test_fourth_stage_mixes_to_targets(stages):
    before, after = stages[1][3]
    times = bag(after)
    assert set(times) <= set(bag(before))
    left, given = Counter(times), []
    for r in before:  # what a row's repeats have in all is dealt out over them
        most = -(-times[tuple(r)] // bag(before)[tuple(r)])
        given.append(min(most, left[tuple(r)]))
        left[tuple(r)] -= given[-1]
    check_mix([(r.source, len(WORD(r.text or ""))) for r in before], given)


def test_mixture_of_repeated_rows_meets_its_target(spark):
    """Repeats neither gain nor lose, and what is null in one column isn't what is null in another."""
    rows = [(i % 100, f"{'w ' * 20}{i % 100}", "s", "en" if i % 1000 < 500 else "de") for i in range(5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    after = corpus_pipeline.mixture(spark, docs, "").collect()
    assert abs(len(after) - 7_500) <= 5
    times, before = bag(after), bag(docs.collect())
    assert set(times) <= set(before) and all(n <= 2 * before[r] for r, n in times.items())
    odd = [(1, None, "x", "a"), (1, "x", None, "b")] * 40
    after = corpus_pipeline.mixture(spark, spark.createDataFrame(odd, docs.schema), "").collect()
    assert set(bag(after)) <= set(bag(odd_rows := spark.createDataFrame(odd, docs.schema).collect())) and len(odd_rows) == 80
    lone = [(None, "y z", None, None)] * 3_000
    assert abs(len(corpus_pipeline.mixture(spark, spark.createDataFrame(lone, docs.schema), "").collect()) - 4_500) <= 2


def test_last_stage_encodes_every_row(stages):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = stages[1][4]
    want = Counter()
    for r in before:
        want[r.doc_id, tuple(ref.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in after) == want


def test_run_equals_its_stages_in_any_partitioning(spark, stages):
    folder, out = stages
    want = Counter((r.doc_id, r.ids_sha256) for r in out[-1][1])
    assert Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()) == want
    spark.read.parquet(f"{folder}/documents.parquet").repartition(7).write.parquet(f"{folder}/again/documents.parquet")
    assert Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, f"{folder}/again").collect()) == want


def test_mix_equals_plain_sizes_and_targets_with_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), [None, "a", "b", "c"][i % 4]) for i in range(400)]
    rows += [(None, "same words here", "b")] * 900 + [(7, None, "a"), (7, None, "a"), (8, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "target": F.lit(1), "block": F.lit(2), "n": F.lit(3)})
    got = op05_mix.mix(df).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, len(WORD(t or ""))) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD(t or ""))
    want = plain_targets(sizes)
    assert all(r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken == r.copies * r["size"] for r in got)
    check_mix([(r.source, r["size"]) for r in got], [r.copies for r in got])
    again = op05_mix.mix(df.repartition(5)).collect()
    assert bag(again) == bag(got)
