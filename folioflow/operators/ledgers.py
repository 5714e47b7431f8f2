"""Ledgers and selections as DataFrames: parameter filters, replaced partitions, appends, scopes, snapshots, quotas, readiness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.relational import latest, ratio


def matching(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows that agree with every value of wanted that isn't None; a list means any of its values. Nothing wanted keeps all rows."""
    tests = [F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def replaced(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old, where each partition (a value of keys) that new has is new's; nulls are a value."""
    own = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return old.join(own, same, "left_anti").unionByName(new)


def write_replacing(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Write df below path by keys; partitions that df has are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def first_by_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Reservations: the first row of each key stands, with n_requests, how often it was asked for."""
    w = Window.partitionBy(*keys)
    return latest(df.withColumn("n_requests", F.count("*").over(w)), keys, *order)


def optimistic(ledger: DataFrame, requests: DataFrame, key: str, event: str, final: Column) -> DataFrame:
    """requests (key, expected) with verdict: `final` where the key's ledger is closed, `accepted` where its latest event is the expected one (null: none yet), else `conflict`."""
    last = ledger.groupBy(key).agg(F.max(event).alias("__last"), F.coalesce(F.bool_or(final), F.lit(False)).alias("__final"))
    state = F.when(F.col("__final"), "final").when(F.col("expected").eqNullSafe(F.col("__last")), "accepted").otherwise("conflict")
    return requests.join(last, key, "left").withColumn("verdict", state).drop("__last", "__final")


def active_scope(decisions: DataFrame, scope: Sequence[str], id_: str, active: Column) -> DataFrame:
    """Decisions with is_active: the latest of its scope, if it is a positive one; so at most one of a scope."""
    w = Window.partitionBy(*scope)
    return decisions.withColumn("is_active", F.coalesce((F.col(id_) == F.max(id_).over(w)) & active, F.lit(False)))


def freshness(snapshots: DataFrame, current: DataFrame, key: str, checksums: Sequence[str]) -> DataFrame:
    """Snapshots with stale (the names of checksums that moved on, or `missing` without a current row) and is_fresh."""
    own = current.select(key, *[F.col(c).alias(f"__{c}") for c in checksums], F.lit(True).alias("__here"))
    moved = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in checksums]))
    stale = F.when(F.col("__here").isNull(), F.array(F.lit("missing"))).otherwise(moved)
    df = snapshots.join(own, key, "left").withColumn("stale", stale).withColumn("is_fresh", F.size("stale") == 0)
    return df.drop("__here", *[f"__{c}" for c in checksums])


def resumable(units: DataFrame, checkpoints: DataFrame, key: str) -> DataFrame:
    """units (key, unit, checksum) with reused: the checkpoint holds the unit with the same checksum."""
    held = checkpoints.select(key, "unit", "checksum").distinct().withColumn("__held", F.lit(True))
    return units.join(held, [key, "unit", "checksum"], "left").withColumn("reused", F.coalesce("__held", F.lit(False))).drop("__held")


def same_keys(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """key, n_left, n_right, equal: whether both sides hold the same set of items for a key; a full join, since either may lack it."""
    a, b = left.select(key, item).distinct().withColumn("__a", F.lit(1)), right.select(key, item).distinct().withColumn("__b", F.lit(1))
    df = a.join(b, [key, item], "full").groupBy(key).agg(F.count("__a").alias("n_left"), F.count("__b").alias("n_right"), F.count("*").alias("__n"))
    return df.withColumn("equal", (F.col("n_left") == F.col("__n")) & (F.col("n_right") == F.col("__n"))).drop("__n")


def dedupe_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by `|`; a null counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def claims(jobs: DataFrame, status: str, until: str, as_of: Column, minutes: int, most_attempts: int) -> DataFrame:
    """jobs with action at as_of: claim (queued or ended, attempts left), renew (running), fail (ended without attempts left), none; and the lease's new end."""
    ended = F.coalesce(F.col(until) <= as_of, F.lit(False)) & (F.col(status) == "running")
    left = F.coalesce("attempts", F.lit(0)) < most_attempts
    action = F.when(((F.col(status) == "queued") | ended) & left, "claim").when(ended, "fail").when(F.col(status) == "running", "renew").otherwise("none")
    new = F.when(F.col("action").isin("claim", "renew"), as_of + F.expr(f"INTERVAL {minutes} MINUTES")).otherwise(F.col(until))
    return jobs.withColumn("action", action).withColumn("lease_until", new)


def quota_order(df: DataFrame, kind: str, quota: Mapping[str, int], limit: int, digest: str, *order: Column) -> DataFrame:
    """A queue of `limit` rows: the quota of each kind in `order`, then the best of the rest; of equal digests the first in the queue's order stays.

    Kinds are served in the order of quota, so a digest that several kinds hold goes to the first of these
    that picks it. Only the first sum-of-quotas + limit distinct rows of each kind are looked at, which is
    exact: no more can be picked. They meet in one task, as a bounded top list must.
    """
    places = {k: i for i, k in enumerate(quota)}
    most = sum(quota.values()) + limit
    once = latest(df, [kind, digest], *order)
    few = once.withColumn("__n", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("__n") <= most).drop("__n")
    serve = F.coalesce(*[F.when(F.col(kind) == k, F.lit(i)) for k, i in places.items()], F.lit(len(places)))
    few = few.withColumn("__serve", serve)
    taken = None
    for k, n in quota.items():
        rest = few.where(F.col(kind) == k)
        rest = rest if taken is None else rest.join(taken.select(digest), digest, "left_anti")
        own = rest.orderBy(*order).limit(n)
        taken = own if taken is None else taken.unionByName(own)
    taken = taken.withColumn("backfill", F.lit(False))
    rest = latest(few.join(taken.select(digest), digest, "left_anti"), [digest], *order).orderBy(*order).limit(limit).withColumn("backfill", F.lit(True))
    every = taken.unionByName(rest)
    place = F.row_number().over(Window.orderBy("backfill", F.when(~F.col("backfill"), F.col("__serve")), *order))  # bounded: at most 2 * limit rows
    return every.withColumn("place", place).where(F.col("place") <= limit).drop("__serve")


def readiness(metrics: DataFrame, least: Mapping[str, float], most: Mapping[str, float]) -> DataFrame:
    """One row of metrics with blockers (`name<least` or `name>most`, null blocks) and ready."""
    low = [F.when(F.coalesce(F.col(k) < v, F.lit(True)), F.lit(f"{k}<{v:g}")) for k, v in least.items()]
    high = [F.when(F.coalesce(F.col(k) > v, F.lit(True)), F.lit(f"{k}>{v:g}")) for k, v in most.items()]
    return metrics.withColumn("blockers", F.array_compact(F.array(*low, *high))).withColumn("ready", F.size("blockers") == 0)


def violations(df: DataFrame, id_: str, checks: Mapping[str, Column], unique: Sequence[str] = ()) -> DataFrame:
    """id and the sorted names of checks that a row fails (null fails), `duplicate:<column>` for a value of unique that another row has; clean rows are left out."""
    for c in unique:
        df = df.withColumn(f"__n_{c}", F.count("*").over(Window.partitionBy(c)))
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()] + [F.when(F.col(f"__n_{c}") > 1, F.lit(f"duplicate:{c}")) for c in unique]
    return df.select(id_, F.sort_array(F.array_compact(F.array(*failed))).alias("violations")).where(F.size("violations") > 0)


def gold_report(cases: DataFrame) -> DataFrame:
    """One row of evaluation figures over cases, one row each.

    cases: n_expected, n_shown, n_relevant (expected and shown), n_sources, n_found_sources, expected_grade and
    predicted_grade (ranks, null for none), expected_role, predicted_role, expected_template, predicted_template,
    latency, cost. A ratio over nothing is 0, but for the rate of grades above the expected, which is 1 then.
    """
    c = F.col
    n = lambda cond: F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("long")), F.lit(0))
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    positive, negative = c("n_expected") > 0, c("n_expected") == 0
    graded = positive & c("expected_grade").isNotNull()
    assessed = graded & c("predicted_grade").isNotNull()
    template = c("expected_template").isNotNull()
    counters = {
        "cases": F.count("*"),
        "positives": n(positive),
        "negatives": n(negative),
        "hits": n(positive & (c("n_relevant") > 0)),
        "expected_sources": total("n_sources"),
        "matched_sources": total("n_found_sources"),
        "graded": n(graded),
        "assessed": n(assessed),
        "overgraded": n(assessed & (c("predicted_grade") > c("expected_grade"))),
        "false_positives": n(negative & (c("n_shown") > 0)),
        "shown": total("n_shown"),
        "relevant": total("n_relevant"),
        "roles": n(c("expected_role").isNotNull()),
        "matched_roles": n(c("expected_role") == c("predicted_role")),
        "templates": n(template),
        "matched_templates": n(c("expected_template") == c("predicted_template")),
        "template_only": n(c("expected_template") == "template_only"),
        "matched_template_only": n((c("expected_template") == "template_only") & (c("predicted_template") == "template_only")),
        "timed": F.count("latency"),
        "priced": F.count("cost"),
    }
    means = {"average_latency": F.round(F.coalesce(F.avg(F.greatest(c("latency"), F.lit(0.0))), F.lit(0.0)), 6), "average_cost": F.round(F.coalesce(F.avg(F.greatest(c("cost"), F.lit(0.0))), F.lit(0.0)), 6)}
    df = cases.agg(*[e.alias(k) for k, e in (counters | means).items()])
    r = lambda a, b: ratio(c(a), c(b))
    return df.withColumns(
        {
            "recall_at_5": r("hits", "positives"),
            "source_accuracy": r("matched_sources", "expected_sources"),
            "overgrade_rate": F.when(c("assessed") == 0, F.lit(1.0)).otherwise(r("overgraded", "assessed")),
            "grade_label_coverage": r("graded", "positives"),
            "grade_assessment_coverage": r("assessed", "graded"),
            "false_positive_rate": r("false_positives", "negatives"),
            "precision_at_5": r("relevant", "shown"),
            "role_accuracy": r("matched_roles", "roles"),
            "role_coverage": r("roles", "cases"),
            "abstention_accuracy": ratio(c("negatives") - c("false_positives"), c("negatives")),
            "latency_coverage": r("timed", "cases"),
            "cost_coverage": r("priced", "cases"),
            "template_accuracy": r("matched_templates", "templates"),
            "template_recall": r("matched_template_only", "template_only"),
            "template_coverage": r("templates", "cases"),
        }
    )
