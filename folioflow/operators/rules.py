"""Rules over documents and facts: maturity chain, rule catalog, verification, routing, synthesis, gates, alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grades from the first to the last.
GRADES = ("E", "D", "C", "B", "A")


def grade(stages: Sequence[Column]) -> Column:
    """The last grade of the unbroken chain of five stages; null if the first isn't met."""
    met, out = F.lit(True), F.lit(None).cast("string")
    for name, stage in zip(GRADES, stages, strict=True):
        met = met & F.coalesce(stage, F.lit(False))
        out = F.when(met, name).otherwise(out)
    return out


def findings(checks: Mapping[str, Column]) -> Column:
    """Names of the checks that fail, in order; a null check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def verify(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Adds findings and verified (no finding)."""
    return df.withColumn("findings", findings(checks)).withColumn("verified", F.size("findings") == 0)


def weighted(parts: Mapping[str, tuple[float, Column]]) -> Column:
    """Sum of weight * part, each part clamped to 0..1, rounded to four places."""
    return F.round(reduce(lambda a, b: a + b, [w * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.0)))) for w, c in parts.values()]), 4)


def route(complexity: Column, risk: Column, high: float = 0.6, low: float = 0.3) -> Column:
    """deep where either is high, standard where either isn't low, else fast."""
    worst = F.greatest(complexity, risk)
    return F.when(worst >= high, "deep").when(worst >= low, "standard").otherwise("fast")


def catalog_state(rules: DataFrame, key: str, status: str) -> DataFrame:
    """Rules of each parameter: count and review_state, approved, rejected, pending or partial."""
    every = lambda s: F.bool_and(F.coalesce(F.col(status) == s, F.lit(False)))
    state = F.when(every("approved"), "approved").when(F.bool_or(F.coalesce(F.col(status) == "rejected", F.lit(False))), "rejected").when(every("pending"), "pending").otherwise("partial")
    return rules.groupBy(key).agg(F.count("*").alias("n_rules"), state.alias("review_state"))


def synthesise(members: DataFrame, keys: Sequence[str], stages: Mapping[str, Column]) -> DataFrame:
    """Groups of documents: members, which stages any has, and the safe grade of their chain."""
    df = members.groupBy(*keys).agg(F.count("*").alias("n_members"), *[F.bool_or(c).alias(n) for n, c in stages.items()])
    return df.withColumn("safe_grade", grade([F.col(n) for n in stages]))


def alerts(metrics: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """metric, value, threshold of metrics (metric, value) above their limit."""
    table = metrics.sparkSession.createDataFrame([(k, float(v)) for k, v in limits.items()], "metric string, threshold double")
    return metrics.join(F.broadcast(table), "metric").where("value > threshold")


def exposition(metrics: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """Lines of the text exposition format; labels are escaped, non-finite values are 0."""
    escaped = F.replace(F.replace(F.replace(F.coalesce(F.col(label).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
    number = F.col(value).cast("double")
    finite = F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), 0.0).otherwise(number)
    return metrics.select(F.concat(F.lit(f'{name}{{{label}="'), escaped, F.lit('"} '), finite.cast("string")).alias("line"))


def exposition_lines(metrics: DataFrame, name: str, labels: Sequence[str], value: str) -> DataFrame:
    """As `exposition`, with several labels in their order."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
    number = F.col(value).cast("double")
    finite = F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), 0.0).otherwise(number)
    parts = [F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels]
    return metrics.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("} "), finite.cast("string")).alias("line"))


#: Points of a score above which a candidate leads, from which it supports, and from which it is reviewed.
LEADS, SUPPORTS, REVIEWED = 80, 65, 55


#: The stages that a package needs for each grade, best first.
SAFE = {"A": ("policy", "done", "evaluated", "improved"), "B": ("policy", "done", "evaluated"), "C": ("policy", "done"), "D": ("policy", "shared"), "E": ("policy",)}
#: Fit of a target level by its distance from the supported one; farther below, farther above, without a target, without support.
FIT = {0: 1.0, -1: 0.93, -2: 0.86, -3: 0.79, 1: 0.45}
FAR_BELOW, FAR_ABOVE, NO_TARGET, NO_SUPPORT = 0.72, 0.18, 0.45, 0.4


def safe_grade(policy: Column, shared: Column, done: Column, evaluated: Column, improved: Column) -> Column:
    """The best grade of SAFE whose stages are all met; null without any."""
    met = {"policy": policy, "shared": shared, "done": done, "evaluated": evaluated, "improved": improved}
    every = lambda names: reduce(lambda a, b: a & b, [F.coalesce(met[n], F.lit(False)) for n in names])
    return F.coalesce(*[F.when(every(names), F.lit(g)) for g, names in SAFE.items()])


def grade_match(target: Column, supported: Column) -> Column:
    """How well a target level fits the level that the evidence supports, by FIT."""
    fit = F.coalesce(*[F.when(target - supported == d, F.lit(v)) for d, v in FIT.items()], F.when(target < supported, FAR_BELOW).otherwise(FAR_ABOVE))
    return F.when(target <= 0, NO_TARGET).when(supported <= 0, NO_SUPPORT).otherwise(fit)


def gated(candidates: DataFrame, key: str, blocked: Column) -> DataFrame:
    """Candidates whose primary and supporting places turn to review where anything blocks their key; nothing is promoted."""
    stops = candidates.groupBy(key).agg(F.coalesce(F.bool_or(blocked), F.lit(False)).alias("__stop"))
    status = F.when(F.col("__stop") & F.col("status").isin("primary", "supporting"), "review").otherwise(F.col("status"))
    return candidates.join(stops, key).withColumn("status", status).drop("__stop")


def reasoning_score(context: Column, match: Column, target: Column, supported: Column, formality: Column, period: Column) -> Column:
    """30 context + 25 match + 25 grade + 15 formality + 5 period; a target above what is supported stays below SUPPORTS."""
    # six places first, so that a half doesn't depend on how a sum of doubles falls
    raw = F.round(F.round(context * 30 + match * 25 + grade_match(target, supported) * 25 + formality * 15 + period * 5, 6), 1)
    return F.when((target > 0) & (target > supported), F.least(raw, F.lit(float(SUPPORTS - 1)))).otherwise(raw)


def candidate_status(score: Column) -> Column:
    return F.when(score > LEADS, "primary").when(score >= SUPPORTS, "supporting").when(score >= REVIEWED, "review").otherwise("rejected")


def package_score(members: DataFrame, keys: Sequence[str], stages: Mapping[str, Column], score: Column) -> DataFrame:
    """Packages of members: safe grade of their joint chain, mean score, share of stages met, both blended 0.65 to 0.35, status."""
    df = members.groupBy(*keys).agg(F.round(F.coalesce(F.avg(score), F.lit(0.0)), 1).alias("average"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in stages.items()])
    met = reduce(lambda a, b: a + b, [F.col(n).cast("int") for n in stages])
    df = df.withColumn("chain_score", F.round(met / len(stages) * 100, 1)).withColumn("score", F.round(F.round(F.col("average") * 0.65 + F.col("chain_score") * 0.35, 6), 1))
    return df.withColumns({"safe_grade": safe_grade(*[F.col(n) for n in stages]), "status": candidate_status(F.col("score"))})


def progress(members: DataFrame, key: str, status: str, completed: str, failed: str) -> DataFrame:
    """Batches: total, terminal, completed, failed, percentage and their status."""
    n = lambda s: F.count(F.when(F.col(status) == s, 1))
    df = members.groupBy(key).agg(F.count("*").alias("total"), n(completed).alias("completed"), n(failed).alias("failed")).withColumn("terminal", F.col("completed") + F.col("failed"))
    state = (
        F.when(F.col("terminal") < F.col("total"), F.when(F.col("terminal") > 0, "running").otherwise("queued"))
        .when(F.col("failed") == F.col("total"), "failed")
        .when(F.col("failed") > 0, "partial")
        .otherwise("completed")
    )
    return df.withColumns({"percentage": F.round(100.0 * F.col("terminal") / F.col("total"), 1), "status": state})


def missing(have: Column, needed: Sequence[str]) -> Column:
    """What of needed the array lacks, in order; empty where needed is a subset."""
    return F.array_except(F.array(*[F.lit(x) for x in needed]), F.coalesce(have, F.array().cast("array<string>")))


def period_allowed(effective_year: Column, periods: Column) -> Column:
    """No effective year, or every period is a year and none lies before it; no period at all isn't allowed."""
    years = F.transform(periods, lambda p: F.substring(p, 1, 4).try_cast("int"))
    fine = (F.size(years) > 0) & ~F.exists(years, lambda y: y.isNull()) & (F.array_min(years) >= effective_year)
    return F.when(effective_year.isNull(), True).otherwise(F.coalesce(fine, F.lit(False)))


def veto(df: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """A second pass can only take back: verified stays where the verdict (key, agrees) agrees; without a verdict it is taken back."""
    second = verdicts.select(key, F.col("agrees").alias("__agrees"))
    return df.join(second, key, "left").withColumn("verified", F.coalesce(F.col("verified") & F.col("__agrees"), F.lit(False))).drop("__agrees")


def overlay(units: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Units (key, checksum) under the latest decisions (key, checksum, decision): applied, stale where the checksum moved on, none."""
    own = decisions.select(key, F.col("checksum").alias("__sum"), F.col("decision"))
    state = F.when(F.col("__sum").isNull(), "none").when(F.col("__sum") == F.col("checksum"), "applied").otherwise("stale")
    return units.join(own, key, "left").withColumn("overlay", state).withColumn("decision", F.when(F.col("overlay") == "applied", F.col("decision"))).drop("__sum")


def leases(jobs: DataFrame, status: str, until: str, as_of: Column) -> DataFrame:
    """Adds effective: what a recovery at as_of makes of a job; running leases that ended are queued again, requested cancellations take place."""
    over = F.coalesce(F.col(until) < as_of, F.lit(False))
    return jobs.withColumn("effective", F.when(over & (F.col(status) == "running"), "queued").when(over & (F.col(status) == "cancel_requested"), "cancelled").otherwise(F.col(status)))
