"""Quality rules: base rules, then minimum-covariance-determinant outliers per language and source.

Everything here is DataFrame functions. A document's texts are read once into a row of statistics.
Three starts that need no chance take C-steps (each moves to the half of the group that lies nearest
to its estimate); each group keeps the start of least determinant and takes C-steps until no group's
determinant falls. The distance that holds half of a group is an exact discrete percentile of distance
bins, a sum that is pre-aggregated before its shuffle, so no group is ever gathered. Every group keeps
its own estimate, shrunk by its count: a source's towards its language's, a language's towards that of all rows.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import few, stored, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
DIMENSIONS = 6
#: Rows that the next level's covariance counts for beside a group's own.
PRIOR_ROWS = 5 * DIMENSIONS
#: Rows that the next level's centre counts for, by statistic: word length, capitals and marks are a language's or source's own
#: and follow its rows at once; symbols, repeated lines and words are junk in any language, so few rows can't move their centre.
PRIOR_CENTRE = (1, 300, 300, 300, 1, 1)
#: Variance of a language's centre about that of all rows, which one row of it can't tell: words without spaces are many times as long.
BETWEEN_LANGUAGES = (1.0, 0.0, 0.0, 0.0, 0.05, 0.05)
#: C-steps that each start takes, C-steps of the best start at most, and the fall of a log determinant that counts as one.
FIRST_STEPS, MOST_STEPS, LEAST_FALL = 2, 12, 1e-3
STARTS = 3
#: Added to each variance: what sampling alone gives a square-rooted rate over SHORT words, 1 / (4 * SHORT).
SHORT = 40
RIDGE = 1 / (4 * SHORT)
#: Under normal vectors, the share of clean documents beyond the cutoff: under one in two billion.
FALSE_ALARMS = 5e-10
_BINS = 32  # bins for a distance's doubling
_GRID = 128  # bins of a statistic's unit, for the percentiles that starts are made of


def _chi2_above(share: float) -> float:
    """The value that chi-squared with DIMENSIONS (even) degrees of freedom exceeds with that probability."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        above = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(DIMENSIONS // 2))
        low, high = (x, high) if above > share else (low, x)
    return high


#: Squared distance, over the consistency factor, beyond which a document is rejected; and the distance that half of a group lies within.
CUTOFF, MEDIAN_CHI2 = _chi2_above(FALSE_ALARMS), _chi2_above(0.5)


def base_statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and raw counts for the vector.

    A null text has no words. n_repeat_words compares 64-bit hashes of a document's windows.
    """
    text = F.col("__t")
    shared = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("__t"), *[F.col(c).alias(f"__c_{c}") for c in carry])
    gone = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    df = shared.select(
        "doc_id",
        "lang",
        "source",
        *[f"__c_{c}" for c in carry],
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        gone(SYMBOLS).cast("long").alias("n_symbols"),
        gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("__upper"),
        gone("!?;:.,").cast("long").alias("__marks"),
        lines.alias("__lines"),
        F.transform(words(text), lambda w: F.xxhash64(w)).alias("__w"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("__w") - WINDOW), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(WINDOW)]))
    df = df.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "__n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__win": F.when(F.size("__w") > WINDOW, windows).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop("__w", "__lines")
    # Only a text with a repeated window pays for the sort that finds where its repeats stand.
    df = df.withColumn(
        "__by_hash",
        F.when(F.size("__win") > F.size(F.array_distinct("__win")), F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("__win")
    same = lambda i: F.get("__by_hash", i)["h"] == F.get("__by_hash", i + 1)["h"]
    starts = F.sort_array(
        F.array_compact(
            F.transform("__by_hash", lambda s, i: F.when(((i > 0) & same(F.greatest(i - 1, F.lit(0)))) | F.coalesce(same(i), F.lit(False)), s["i"]))
        )
    )
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
    )["n"]
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__by_hash")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds x0..x5: counts per word, damped by a prior so that short texts vary less, then square roots; and the log of the mean word length."""
    n = F.col("n_words").cast("double")
    rate = lambda c, prior=0.0, damp=50.0: F.sqrt((F.col(c) + F.lit(prior)) / (n + F.lit(damp)))
    x = [
        F.ln((F.col("word_chars") + 250.0) / (n + 50.0)),
        rate("n_symbols", damp=15.0),
        F.sqrt(F.col("n_dup_lines") / (F.col("__n_lines") + 5.0)),
        rate("n_repeat_words"),
        rate("__upper", 5.0),
        rate("__marks", 5.0),
    ]
    return stats.withColumns({f"x{i}": c for i, c in enumerate(x)})


def _level(df: DataFrame, level: int) -> DataFrame:
    """One row per vector and level: 0 all rows, 1 its language, 2 its language and source."""
    return df.withColumns(
        {
            "level": F.lit(level),
            "g_lang": F.coalesce("lang", F.lit("\0")) if level else F.lit(""),
            "g_source": F.coalesce("source", F.lit("\0")) if level == 2 else F.lit(""),
        }
    )


_KEYS = ["level", "g_lang", "g_source"]


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(distance + 1e-6) * _BINS).cast("int")


def _half(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the bin of d2 up to which at least half of its rows lie, from counts that the map side has summed."""
    at = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY bin)").cast("int")
    return rows.withColumn("bin", _bin(F.col("d2"))).groupBy(*keys).agg(at.alias("half_bin"), F.count("*").alias("total"))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and ridged covariance for each group."""
    p = DIMENSIONS
    sums = {f"m{i}": F.avg(f"x{i}") for i in range(p)} | {f"c{i}_{j}": F.covar_pop(f"x{i}", f"x{j}") for i in range(p) for j in range(i + 1)}
    return rows.groupBy(*keys).agg(*[c.alias(k) for k, c in sums.items()]).withColumns({f"c{i}_{i}": F.col(f"c{i}_{i}") + RIDGE for i in range(p)})


def _factored(df: DataFrame) -> DataFrame:
    """Adds the Cholesky factor of the covariance and the log of its determinant."""
    for i in range(DIMENSIONS):
        for j in range(i + 1):
            inner = F.col(f"c{i}_{j}") - reduce(add, [F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)], F.lit(0.0))
            df = df.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(inner, F.lit(RIDGE / 4))) if i == j else inner / F.col(f"l{j}_{j}"))
    return df.withColumn("log_det", 2 * reduce(add, [F.ln(f"l{i}_{i}") for i in range(DIMENSIONS)]))


def _shrunk(own: DataFrame, prior: DataFrame, on: list[str], wide: tuple[float, ...] = (0.0,) * DIMENSIONS) -> DataFrame:
    """The estimates of own shrunk towards prior's by their counts, a lone row's wholly.

    As in a normal-inverse-Wishart posterior the way between the two centres adds to the covariance where a centre
    follows its own rows, so rows that agree aren't far from the centre that lies between; where the prior's centre
    holds, being far from it is what counts. wide is the centres' variance about the prior's, it fades with the count.
    """
    p = DIMENSIONS
    names = [f"m{i}" for i in range(p)] + [f"c{i}_{j}" for i in range(p) for j in range(i + 1)]
    n = F.col("total") - 1.0
    joined = own.join(prior.select(*on, *[F.col(k).alias(f"p_{k}") for k in names]), on) if on else own.crossJoin(prior.select(*[F.col(k).alias(f"p_{k}") for k in names]))
    off = [F.col(f"m{i}") - F.col(f"p_m{i}") for i in range(p)]
    new = {f"m{i}": (n * F.col(f"m{i}") + k * F.col(f"p_m{i}")) / (n + k) for i, k in enumerate(PRIOR_CENTRE)}
    for i in range(p):
        for j in range(i + 1):
            between = n / (n + 1) * off[i] * off[j] if PRIOR_CENTRE[i] == PRIOR_CENTRE[j] == 1 else F.lit(0.0)
            new[f"c{i}_{j}"] = (PRIOR_ROWS * F.col(f"p_c{i}_{j}") + n * F.col(f"c{i}_{j}") + between) / (PRIOR_ROWS + n) + (F.lit(wide[i]) / (n + 1) if i == j else F.lit(0.0))
    return joined.withColumns(new).select(*own.columns)


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(DIMENSIONS):
        known = reduce(add, [F.col(f"l{i}_{k}") * F.col(f"y{k}") for k in range(i)], F.lit(0.0))
        df = df.withColumn(f"y{i}", (F.col(f"x{i}") - F.col(f"m{i}") - known) / F.col(f"l{i}_{i}"))
    return df.withColumn("d2", reduce(add, [F.col(f"y{i}") ** 2 for i in range(DIMENSIONS)]))


def _starts(leveled: DataFrame) -> DataFrame:
    """One row per start and group: 0 a unit ball around the medians, 1 the medians with the quartiles' spread, 2 mean and covariance of all rows."""
    p = DIMENSIONS
    share = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY g{i})").alias(f"q{i}_{at}") for i in range(p) for at, q in enumerate((0.25, 0.5, 0.75))]
    gridded = leveled.select(*_KEYS, *[F.round(F.col(f"x{i}") * _GRID).cast("int").alias(f"g{i}") for i in range(p)])
    quartiles = gridded.groupBy(*_KEYS).agg(*share)
    # A normal variable's quartiles lie 1.349 standard deviations apart.
    spread = [((F.col(f"q{i}_2") - F.col(f"q{i}_0")) / (1.349 * _GRID)) ** 2 + RIDGE for i in range(p)]
    middle = {f"m{i}": F.col(f"q{i}_1") / _GRID for i in range(p)}
    square = lambda own: {f"c{i}_{j}": own[i] if i == j else F.lit(0.0) for i in range(p) for j in range(i + 1)}
    made = [_moments(leveled, _KEYS)] + [quartiles.select(*_KEYS, *[c.alias(k) for k, c in (middle | square(v)).items()]) for v in ([F.lit(1.0)] * p, spread)]
    return reduce(DataFrame.unionByName, [df.withColumn("start", F.lit(i)) for i, df in zip((2, 0, 1), made, strict=True)])


def _step(leveled: DataFrame, model: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One C-step: the estimate of the nearest half of each group, by the distance of the model before."""
    near = _distance(leveled.join(model, _KEYS)).select(*keys, *[f"x{i}" for i in range(DIMENSIONS)], "d2")
    half = stored(few(_half(near, keys)), f"rules-half{name}")
    return stored(few(_factored(_moments(near.join(half, keys).where(_bin(F.col("d2")) <= F.col("half_bin")), keys))), f"rules-model{name}")


def estimates(rows: DataFrame) -> DataFrame:
    """g_lang, g_source, mean, factor: the shrunk MCD estimate of every language and source.

    Each step reads the small table of vectors only; a group whose determinant no longer falls keeps its estimate.
    """
    p = DIMENSIONS
    x = [f"x{i}" for i in range(p)]
    leveled = stored(reduce(DataFrame.union, [_level(rows.select("lang", "source", *x), i) for i in range(3)]).select(*_KEYS, *x), "rules-levels")
    model = stored(few(_factored(_starts(leveled))), "rules-starts")
    for step in range(FIRST_STEPS):
        model = _step(leveled, model, [*_KEYS, "start"], f"-first{step}")
    best = model.groupBy(*_KEYS).agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
    model = stored(few(model.join(best, [*_KEYS, "start"]).drop("start")), "rules-best")
    for step in range(MOST_STEPS):
        before = model
        own = [c for c in before.columns if c not in _KEYS]
        new = _step(leveled, before, _KEYS, str(step)).select(*_KEYS, F.struct(*own).alias("new"))
        both = before.select(*_KEYS, F.struct(*own).alias("old")).join(new, _KEYS)
        falls = F.col("new.log_det") < F.col("old.log_det") - LEAST_FALL
        model = stored(few(both.select(*_KEYS, falls.alias("falls"), F.when(falls, F.col("new")).otherwise(F.col("old")).alias("own")).select(*_KEYS, "falls", "own.*")), f"rules-kept{step}")
        moved = model.where("falls").limit(1).count()
        model = model.drop("falls")
        if not moved:
            break
    half = _half(_distance(leveled.join(model, _KEYS)), _KEYS)
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("half_bin") + 1) / _BINS) / MEDIAN_CHI2)
    names = [f"c{i}_{j}" for i in range(p) for j in range(i + 1)]
    own = stored(few(model.join(half, _KEYS).withColumn("scale", scale).select(*_KEYS, "total", *[f"m{i}" for i in range(p)], *[(F.col(c) * F.col("scale")).alias(c) for c in names])), "rules-own")
    level = [own.where(F.col("level") == i).drop("level") for i in range(3)]
    languages = _shrunk(level[1], level[0], [], BETWEEN_LANGUAGES)
    return stored(few(_factored(_shrunk(level[2], languages, ["g_lang"])).drop("total", "log_det", *names)), "rules-estimates")


def quality_rules(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The statistics of every row of docs with base_failed and kept; columns named in carry come along as __c_<name>.

    kept is false where a base rule fails; else it tells whether the document's vector lies within
    CUTOFF of the estimate of its language and source (null counts as a value of its own). Repeated
    rows stay repeated and agree, a null doc_id stays null, extra columns are ignored, an empty table
    gives an empty one. Groups of every size are judged alike, a lone row by what its language and all rows say of it;
    distance is null only for a group of which no row passed the base rules.
    """
    stats = stored(vectors(base_statistics(docs, carry)), "rules-stats")
    passed = stats.where(~F.col("base_failed"))
    keyed = _level(stats, 2).drop("level")
    out = _distance(keyed.join(estimates(passed), ["g_lang", "g_source"], "left")).select(*stats.columns, F.col("d2").alias("distance"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF))


def op3_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
