"""Assessment over rules as a table: requirements are met by a mapping's evidence, prerequisites followed through their graph, and only what changed is judged again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators import grading as G
from folioflow.operators.retrieval import measured
from folioflow.operators.rules import period_allowed
from folioflow.session import written

GRADES = tuple(G.REQUIRED)
_NONE = "array<string>"
#: Mappings that one task judges.
MAPPINGS = 20_000
#: Labels of what a grade lacks; fixed values, their order is that of the result.
LACKS = ("stage", "source_type", "prerequisite_grade", "period", "organization", "disqualifier")


def _empty() -> Column:
    return F.array().cast(_NONE)


def with_fallbacks(parameters: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Rules of every parameter and grade: the compiled one, or what the grade asks for by default, as a draft without a checksum.

    rules has key, grade, required_stages, required_sources, prerequisite, effective_year, checksum and approval_status.
    """
    base = [
        F.struct(
            F.lit(g).alias("grade"),
            G.strings(sorted(G.REQUIRED[g])).alias("required_stages"),
            G.strings(sorted(G.PROOF[s] for s in G.REQUIRED[g])).alias("required_sources"),
            F.lit(G.BEFORE[g]).cast("string").alias("prerequisite"),
        )
        for g in GRADES
    ]
    default = parameters.select(key).distinct().select(key, F.inline(F.array(*base)))
    own = rules.select(key, "grade", *[F.col(c).alias(f"__{c}") for c in ("required_stages", "required_sources", "prerequisite", "effective_year", "checksum", "approval_status")], F.lit(True).alias("is_compiled"))
    found = F.col("is_compiled").isNotNull()
    pick = lambda c: F.when(found, F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    joined = default.join(own, [key, "grade"], "left")
    return joined.select(
        key, "grade", pick("required_stages"), pick("required_sources"), pick("prerequisite"), F.col("__effective_year").alias("effective_year"), F.col("__checksum").alias("checksum"),
        F.coalesce("__approval_status", F.lit("draft")).alias("approval_status"), found.alias("is_compiled"),
    )


def with_needs(rules: DataFrame, key: str) -> DataFrame:
    """Adds needs: the grade and all grades that its prerequisites lead to; null where they lead round in a circle or to a grade without a rule.

    Parameters share few different graphs, so the recursion runs over the distinct ones, not over the parameters.
    """
    spark = rules.sparkSession
    edge = F.struct("grade", "prerequisite")
    graphs = rules.groupBy(key).agg(F.sort_array(F.collect_list(edge)).alias("graph"))
    edges = graphs.select("graph").distinct().select("graph", F.inline("graph"))
    steps = spark.sql(
        """WITH RECURSIVE up(graph, grade, at, next, step) AS (
             SELECT graph, grade, grade, prerequisite, 0 FROM {edges}
             UNION ALL
             SELECT up.graph, up.grade, e.grade, e.prerequisite, up.step + 1 FROM up JOIN {edges} e ON e.graph = up.graph AND e.grade = up.next WHERE up.step < size(up.graph))
           SELECT graph, grade, sort_array(collect_set(at)) AS reached, max(step) AS steps, count_if(next IS NULL) AS ends FROM up GROUP BY graph, grade""",
        edges=edges,
    )
    # A way that ends takes as many steps as it reaches grades, less one; one that goes round, or to a missing grade, never ends.
    needs = steps.select("graph", "grade", F.when((F.col("ends") == 1) & (F.col("steps") + 1 == F.size("reached")), F.col("reached")).alias("needs"))
    placed = graphs.join(needs, "graph").select(key, "grade", "needs")
    return rules.join(placed, [key, "grade"])


def parts(*tables: DataFrame) -> int:
    """Parts in which the rows of the largest table are MAPPINGS each."""
    return max(1, *[-(-df.count() // MAPPINGS) for df in tables])


def with_shown(mappings: DataFrame, evidence: DataFrame, id_: str, n: int | None = None) -> DataFrame:
    """mappings with shown, the different (kind, name) of each one's evidence; dealt by id in n parts, by default of MAPPINGS rows.

    A table of evidence is small as a file and large as rows, so no side is left to the planner's guess: both are sorted and merged.
    """
    n = n or parts(mappings)
    own = evidence.select(id_, "kind", "name").dropna().repartition(n, id_).groupBy(id_).agg(F.collect_set(F.struct("kind", "name")).alias("shown"))
    return mappings.repartition(n, id_).join(own.hint("merge"), id_, "left")


def lacks(shown: Column) -> Column:
    """Requirements of a rule's row that aren't among shown, as sorted labels: stages, then sources."""
    one = lambda kind, names: F.transform(F.sort_array(names), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    asked = F.concat(*[one(k, F.coalesce(F.col(c), _empty())) for k, c in zip(LACKS, ("required_stages", "required_sources"), strict=False)])
    return F.transform(F.filter(asked, lambda x: ~F.array_contains(shown, x)), lambda x: F.concat_ws(":", x["kind"], x["name"]))


def assessed(mappings: DataFrame, evidence: DataFrame, rules: DataFrame, id_: str, key: str) -> DataFrame:
    """id, grade, missing, passed, approval_status for each mapping and each rule of its parameter.

    mappings has id, key and the arrays periods, organizations and disqualifiers (null counts as empty), evidence (id, kind, name)
    says which stages and types of source a mapping's facts show, rules is as with_needs gives it. A grade passes if all that
    it needs lacks nothing.
    """
    return judged(with_shown(mappings, evidence, id_), rules, id_, key)


def judged(mappings: DataFrame, rules: DataFrame, id_: str, key: str) -> DataFrame:
    """As `assessed`, for mappings that have shown and are dealt by id already."""
    periods, organizations, flags = (F.coalesce(F.col(c), _empty()) for c in ("periods", "organizations", "disqualifiers"))
    joined = mappings.join(measured(rules), key)
    shown = F.coalesce("shown", F.array().cast("array<struct<kind:string,name:string>>"))
    single = lambda name, own: F.when(F.size(own) != 1, G.strings([f"{name}:required_single"])).otherwise(_empty())
    late = F.when(~period_allowed(F.col("effective_year"), periods), G.strings(["period:before_effective_date"])).otherwise(_empty())
    blocked = F.transform(F.array_intersect(F.sort_array(G.strings(G.DISQUALIFIERS)), flags), lambda x: F.concat(F.lit("disqualifier:"), x))
    df = joined.select(id_, key, "grade", "prerequisite", "needs", "approval_status", lacks(shown).alias("before"), F.concat(single("period", periods), single("organization", organizations), late, blocked).alias("after"))
    # The grades of one mapping stand side by side; they are as many as its parameter has rules.
    w = Window.partitionBy(id_)
    df = df.withColumn("met", F.collect_set(F.when((F.size("before") == 0) & (F.size("after") == 0), F.col("grade"))).over(w))
    df = df.withColumn("passed", F.coalesce(F.size(F.array_except("needs", "met")) == 0, F.lit(False)))
    df = df.withColumn("all_passed", F.collect_set(F.when(F.col("passed"), F.col("grade"))).over(w))
    first = F.when(~F.array_contains("all_passed", F.col("prerequisite")), F.array(F.concat(F.lit("prerequisite_grade:"), "prerequisite"))).otherwise(_empty())
    return df.select(id_, key, "grade", F.concat("before", F.coalesce(first, _empty()), "after").alias("missing"), "passed", "approval_status")


def outcomes(found: DataFrame, rules: DataFrame, id_: str, key: str) -> DataFrame:
    """id, grade (the highest passed one), next_missing (of the first grade that lacks something), approval_status and primary_allowed.

    A parameter is approved if it has compiled rules and all of them are; its grade may stand alone only then.
    """
    order = G.grade_rank(F.col("grade"))
    compiled = F.col("is_compiled")
    approved = rules.groupBy(key).agg((F.coalesce(F.bool_or(compiled), F.lit(False)) & F.coalesce(F.bool_and(F.when(compiled, F.col("approval_status") == "approved")), F.lit(False))).alias("__approved"))
    best = F.max(F.when(F.col("passed"), F.struct(order.alias("n"), F.col("grade").alias("grade"))))
    first = F.min(F.when(F.size("missing") > 0, F.struct(order.alias("n"), F.col("missing").alias("missing"))))
    df = found.groupBy(id_, key).agg(best.alias("best"), first.alias("first")).join(measured(approved), key)
    status = F.when(F.col("__approved"), "approved").otherwise("draft")
    return df.select(id_, key, F.col("best.grade").alias("grade"), F.coalesce("first.missing", _empty()).alias("next_missing"), status.alias("approval_status"), (F.col("__approved") & F.col("best").isNotNull()).alias("primary_allowed"))


def basis(mappings: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """mappings (with shown) with basis: a digest of all that a mapping's outcome depends on, its own values, its evidence and its parameter's rules with their approval; null where the parameter has no rules."""
    ruled = rules.groupBy(key).agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("grade", F.coalesce("checksum", F.lit("")).alias("c"), "approval_status")))), 256).alias("__rules"))
    labels = F.transform(F.coalesce("shown", F.array().cast("array<struct<kind:string,name:string>>")), lambda x: F.concat_ws(":", x["kind"], x["name"]))
    own = [F.sort_array(F.coalesce(F.col(c), _empty())).alias(c) for c in ("periods", "organizations", "disqualifiers")]
    digest = F.sha2(F.to_json(F.struct(F.col(key).cast("string").alias("k"), F.col("__rules").alias("rules"), F.sort_array(F.array_distinct(labels)).alias("shown"), *own)), 256)
    return mappings.join(measured(ruled), key, "left").withColumn("basis", F.when(F.col("__rules").isNotNull(), digest)).drop("__rules")


def reverified(stored: DataFrame, mappings: DataFrame, evidence: DataFrame, rules: DataFrame, id_: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The new versions (id, version, outcome columns, basis), and the stored ones with is_active, after a change of facts, rules or approvals.

    Only mappings whose basis differs from that of their newest stored version are judged again. A stored version stays
    active while it is the newest and its mapping lasts. All tables are dealt by id in parts of about MAPPINGS rows, so
    what a task holds doesn't grow with them; what each mapping is compared by is made and stored once.
    """
    n = parts(mappings, stored)
    held = stored.repartition(n, id_)
    newest = held.groupBy(id_).agg(F.max_by(F.struct("version", "basis"), "version").alias("last")).select(id_, F.col("last.version").alias("version"), F.col("last.basis").alias("was"))
    compared = basis(with_shown(mappings, evidence, id_, n), rules, key).join(newest.hint("merge"), id_, "left")
    again = F.col("basis").isNotNull() & ~F.col("basis").eqNullSafe(F.col("was"))
    state = written(compared.withColumns({"again": again, "version": (F.coalesce("version", F.lit(0)) + 1).cast("int")}).drop("was"), "compared")
    changed = state.where("again").repartition(n, id_)
    fresh = outcomes(judged(changed.drop("basis", "version", "again"), rules, id_, key), rules, id_, key).join(changed.select(id_, "basis", "version").hint("merge"), id_)
    lasting = state.select(id_, "again").repartition(n, id_).groupBy(id_).agg(F.bool_or("again").alias("again"))
    versions = held.where(F.col(id_).isNotNull()).withColumn("last", F.max("version").over(Window.partitionBy(id_)))
    active = (F.col("version") == F.col("last")) & F.coalesce(~F.col("again"), F.lit(False))
    kept = versions.join(lasting.hint("merge"), id_, "left").withColumn("is_active", active).drop("last", "again")
    return fresh, kept


def select_versions(fresh: DataFrame, kept: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All versions in one table, with the version that each one supersedes."""
    before = F.when(F.col("version") > 1, F.col("version") - 1).cast("int")
    return fresh.withColumn("is_active", F.lit(True)).select(*columns, "is_active").union(kept.select(*columns, "is_active")).withColumn("supersedes", before)
