"""Rules of grades: lexicon hits, compiled rules and their checksums, assessment, approvals, verification, synthesis, compute routing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.retrieval import measured
from folioflow.operators.rules import findings, period_allowed

#: Stages of evidence, the stages that each grade needs, and the grade that must be passed before it.
STAGES = ("policy", "socialization", "implementation", "evaluation", "improvement")
REQUIRED = {
    "E": ("policy",),
    "D": ("policy", "socialization"),
    "C": ("policy", "implementation"),
    "B": ("policy", "implementation", "evaluation"),
    "A": ("policy", "implementation", "evaluation", "improvement"),
}
BEFORE = {"E": None, "D": "E", "C": "E", "B": "C", "A": "B"}
#: The type of source that proves a stage.
PROOF = {
    "policy": "policy_document",
    "socialization": "socialization_record",
    "implementation": "implementation_record",
    "evaluation": "evaluation_report",
    "improvement": "improvement_record",
}
#: What stands against a grade.
DISQUALIFIERS = ("plan_without_result", "template_only")


def word_set(text: Column) -> Column:
    """The distinct lower-case runs of ASCII letters and digits of a text; none for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def lexicon_hits(df: DataFrame, id_: str, text: str, lexicon: DataFrame) -> DataFrame:
    """id, kinds: the sorted kinds of the lexicon (term, kind) of which a text holds a term as a whole word.

    Words meet terms by equality, so a lexicon of any size is one join; ids without a hit have an empty array.
    """
    words = df.select(id_, F.explode(word_set(F.col(text))).alias("term"))
    found = words.join(measured(lexicon.select("term", "kind").distinct()), "term").groupBy(id_).agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    return df.select(id_).distinct().join(found, id_, "left").select(id_, F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


def with_kinds(df: DataFrame, words: str, lexicon: DataFrame) -> DataFrame:
    """df with kinds, the sorted kinds of the lexicon (term, kind) of which a row's array of words holds a term.

    The lexicon is sent to every row as one map, so nothing is shuffled and no rows are gathered; one that doesn't fit a row is for `lexicon_hits`.
    """
    terms = lexicon.select("term", "kind").dropna().groupBy("term").agg(F.collect_set("kind").alias("kinds"))
    one = terms.agg(F.map_from_entries(F.collect_list(F.struct("term", "kinds"))).alias("__lexicon"))
    held = F.transform(F.array_intersect(words, F.map_keys("__lexicon")), lambda x: F.element_at("__lexicon", x))
    return df.crossJoin(F.broadcast(one)).withColumn("kinds", F.sort_array(F.array_distinct(F.flatten(held)))).drop("__lexicon")


@dataclass(frozen=True)
class Rule:
    """What a grade asks for."""

    grade: str
    stages: tuple[str, ...] = ()
    disqualifiers: tuple[str, ...] = DISQUALIFIERS
    effective_year: int | None = None
    single: tuple[str, ...] = field(default=("period", "organization"))


def fallback_rules(effective_year: int | None = None) -> list[Rule]:
    return [Rule(g, REQUIRED[g], effective_year=effective_year) for g in REQUIRED]


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def compiled(criteria: DataFrame, key: str, grade: str, stages: str) -> DataFrame:
    """Rules of criteria: key, grade, required_stages (those of the grade and those its text names), required_sources, prerequisite."""
    base = F.coalesce(*[F.when(F.col(grade) == g, strings(s)) for g, s in REQUIRED.items()])
    required = F.sort_array(F.array_union(base, F.filter(F.col(stages), lambda s: s.isin(*STAGES))))
    proof = F.transform(required, lambda s: F.coalesce(*[F.when(s == k, F.lit(v)) for k, v in PROOF.items()]))
    before = F.coalesce(*[F.when(F.col(grade) == g, F.lit(p)) for g, p in BEFORE.items() if p], F.lit(None).cast("string"))
    return criteria.where(F.col(grade).isin(*REQUIRED)).select(
        key, F.col(grade).alias("grade"), required.alias("required_stages"), F.sort_array(proof).alias("required_sources"), before.alias("prerequisite")
    )


def canonical(fields: Mapping[str, Column]) -> Column:
    """Compact JSON of string and string-array columns with sorted keys; nulls are written, as `to_json` wouldn't."""
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"')), F.lit("null"))

    def value(c: Column, many: bool) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(c, quoted), ","), F.lit("]")) if many else quoted(c)

    parts = [F.concat(F.lit(f'"{name.removesuffix("[]")}":'), value(fields[name], name.endswith("[]"))) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def rule_checksum(rules: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Adds checksum, the SHA-256 of a rule's canonical JSON; more names further columns that belong to a rule."""
    fields = {"grade": F.col("grade"), "prerequisite": F.col("prerequisite"), "required_sources[]": F.col("required_sources"), "required_stages[]": F.col("required_stages")} | {c: F.col(c).cast("string") for c in more}
    return rules.withColumn("checksum", F.sha2(canonical(fields), 256))


def assess(mappings: DataFrame, key: str, rules: Sequence[Rule] | None = None) -> DataFrame:
    """key, grade, missing, passed for each mapping and grade.

    mappings has the arrays stages, sources, periods, organizations and disqualifiers (null counts as empty). A grade
    passes if nothing is missing and the grade before it passed. The grades stand in one row while they
    are judged, so nothing is shuffled.
    """
    empty = F.array().cast("array<string>")
    own = {c: F.coalesce(F.col(c), empty) for c in ("stages", "sources", "periods", "organizations", "disqualifiers")}
    judged: dict[str, Column] = {}
    rows = []
    for rule in rules or fallback_rules():
        before = BEFORE[rule.grade]
        # The labels before and after the colons are fixed values.
        lacks = [
            F.transform(F.array_except(F.sort_array(strings(rule.stages)), own["stages"]), lambda s: F.concat(F.lit("stage:"), s)),
            F.transform(F.array_except(F.sort_array(strings([PROOF[s] for s in rule.stages])), own["sources"]), lambda s: F.concat(F.lit("source_type:"), s)),
            F.when(~judged[before], strings([f"prerequisite_grade:{before}"])).otherwise(empty) if before else empty,
            *[F.when(F.size(own[f"{n}s"]) != 1, strings([f"{n}:required_single"])).otherwise(empty) for n in rule.single],
            F.when(~period_allowed(F.lit(rule.effective_year).cast("int"), own["periods"]), strings(["period:before_effective_date"])).otherwise(empty),
            F.transform(F.array_intersect(F.sort_array(strings(rule.disqualifiers)), own["disqualifiers"]), lambda s: F.concat(F.lit("disqualifier:"), s)),
        ]
        missing = F.concat(*lacks)
        judged[rule.grade] = F.size(missing) == 0
        rows.append(F.struct(F.lit(rule.grade).alias("grade"), missing.alias("missing"), judged[rule.grade].alias("passed")))
    return mappings.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.grade", "x.missing", "x.passed")


def passed_grade(assessed: DataFrame, key: str) -> DataFrame:
    """key, grade: the highest passed grade, null without one."""
    order = {g: i for i, g in enumerate(REQUIRED, 1)}
    place = F.coalesce(*[F.when(F.col("grade") == g, F.lit(i)) for g, i in order.items()])
    best = F.max(F.when(F.col("passed"), F.struct(place.alias("place"), F.col("grade").alias("grade"))))
    return assessed.groupBy(key).agg(best.alias("x")).select(key, F.col("x.grade").alias("grade"))


def approval_state(rules: DataFrame, decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rules with approval_status and approval_stale: a decision (keys, checksum, status) counts only for the checksum it was made for."""
    own = decisions.select(*keys, F.col("checksum").alias("__sum"), F.col("status").alias("__status"))
    same = F.col("__sum") == F.col("checksum")
    status = F.when(same & F.col("__status").isin("approved", "rejected"), F.col("__status")).otherwise("draft")
    return rules.join(own, list(keys), "left").withColumns({"approval_status": status, "approval_stale": F.coalesce(~same, F.lit(False))}).drop("__sum", "__status")


def grade_rank(grade: Column) -> Column:
    """0 for the lowest grade to 4, -1 for anything else."""
    return F.coalesce(*[F.when(grade == g, F.lit(i)) for i, g in enumerate(REQUIRED)], F.lit(-1))


def six_flags(df: DataFrame, status: Column, coverage: Column, sources: Column, approval: Column, grade: Column, ceiling: Column, periods: Column, organizations: Column) -> DataFrame:
    """Adds findings and verified: six flags, each of which must hold; null fails a flag."""
    rank, most = grade_rank(grade), grade_rank(ceiling)
    # The flags' names are fixed values.
    within = (approval == "approved") & (rank >= 0) & (most >= 0) & (rank <= most)
    fine = {
        "mapping_status": status == "candidate",
        "coverage": coverage == "complete",
        "sources": sources,
        "grade_rule": within,
        "period": F.size(periods) == 1,
        "organization": F.size(organizations) == 1,
    }
    named = findings(fine)
    over = (rank > most) & (most >= 0)
    named = F.transform(named, lambda f: F.when((f == "grade_rule") & over, "grade_over_ceiling").otherwise(f))
    return df.withColumn("findings", named).withColumn("verified", F.size("findings") == 0)


def demoted(candidates: DataFrame, verdicts: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Candidates of keys[0] with status and a rank counted anew: only a plausible verdict keeps `candidate`, those come first; nothing is promoted."""
    own = verdicts.select(*keys, F.col("verdict").alias("__verdict"))
    status = F.when((F.col("status") == "candidate") & (F.col("__verdict") == "plausible"), "candidate").otherwise("needs_review")
    df = candidates.join(own, list(keys), "left").withColumn("status", status).drop("__verdict")
    w = Window.partitionBy(keys[0]).orderBy((F.col("status") != "candidate"), by)
    return df.withColumn("rank", F.row_number().over(w))


def synthesis(members: DataFrame, keys: Sequence[str], eligible: Column) -> DataFrame:
    """keys, n_members, n_facts, n_runs, stages, safe_grade, contradictory for groups of eligible members.

    members has run_id, fact_id, stage, organizations and periods (arrays). Facts and runs of a group are
    counted, and its stages, few, are listed; a group whose members name several organisations or periods is contradictory.
    """
    many = (F.size("organizations") > 1) | (F.size("periods") > 1)
    df = members.where(F.coalesce(eligible, F.lit(False))).groupBy(*keys).agg(
        F.count("*").alias("n_members"),
        F.countDistinct("fact_id").alias("n_facts"),
        F.countDistinct("run_id").alias("n_runs"),
        F.sort_array(F.collect_set(F.when(F.col("stage").isin(*STAGES), F.col("stage")))).alias("stages"),
        F.coalesce(F.bool_or(many), F.lit(False)).alias("contradictory"),
    )
    grade = F.lit(None).cast("string")
    for g, needed in REQUIRED.items():
        grade = F.when(F.size(F.array_except(strings(needed), F.col("stages"))) == 0, g).otherwise(grade)
    return df.withColumn("safe_grade", grade)


def share_sum(parts: Mapping[str, tuple[float, Column]]) -> Column:
    """Sum of weight * part, each part clamped to 0..1 (null is 0), to four places; a half goes up even if the sum of doubles fell a little short of it."""
    total = F.lit(0.0)
    for w, c in parts.values():
        total = total + w * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.0))))
    return F.floor(total * 10_000 + 0.500001) / 10_000.0


def routed(df: DataFrame, complexity: Mapping[str, tuple[float, Column]], risk: Mapping[str, tuple[float, Column]], needed: Column, threshold: float, blocks: Mapping[str, Column], bypass: Column | None = None) -> DataFrame:
    """Adds complexity, risk, selected and reasons: work is sent to the dear path if it is needed, complex enough (or `bypass`) and nothing blocks it.

    blocks names conditions that stand against it; reasons lists what decided, sorted.
    """
    scored = df.withColumns({"complexity": share_sum(complexity), "risk": share_sum(risk)})
    need = F.coalesce(needed, F.lit(False))
    enough = (F.col("complexity") >= threshold) | (F.coalesce(bypass, F.lit(False)) if bypass is not None else F.lit(False))
    stops = {name: F.coalesce(c, F.lit(False)) for name, c in blocks.items()}
    free = F.lit(True)
    for c in stops.values():
        free = free & ~c
    reasons = [F.when(~need, "not_needed"), F.when(need, "needed"), F.when(need & ~enough, "below_threshold"), *[F.when(c, F.lit(n)) for n, c in stops.items()]]
    return scored.withColumns({"selected": need & enough & free, "reasons": F.sort_array(F.array_compact(F.array(*reasons)))})


def _of_type(name: str) -> Callable[[Column], Column]:
    return lambda x: x["fact_type"] == name


def stage_diverse(facts: DataFrame, key: str, limit: int = 12, least: float = 0.2, share: float = 0.25) -> DataFrame:
    """key, fact_id, place: the best `limit` facts of a key, where a missing stage displaces the weakest redundant fact.

    facts has fact_id, fact_type, role, score. Per stage only its best eligible fact can come in, so besides the
    first `limit` at most one fact a stage is looked at: at most limit + 5 rows a key are gathered. A stage
    comes in if its best fact isn't contradictory and scores max(least, share * best). A fact may give way if
    its type is no stage or occurs more than once among the chosen.
    """
    order = [F.desc("score"), F.asc("fact_id")]
    w = Window.partitionBy(key).orderBy(*order)
    eligible = F.col("fact_type").isin(*STAGES) & (F.coalesce(F.col("role"), F.lit("")) != "contradictory")
    ranked = facts.withColumns({"__n": F.row_number().over(w), "__top": F.max("score").over(Window.partitionBy(key))})
    ranked = ranked.withColumn("__enters", eligible & (F.col("score") >= F.greatest(F.lit(least), F.col("__top") * share)))
    per_stage = F.row_number().over(Window.partitionBy(key, "fact_type").orderBy((~F.col("__enters")).cast("int"), *order))
    best_of_stage = F.col("__enters") & (F.col("__m") == 1)
    few = ranked.withColumn("__m", per_stage).where((F.col("__n") <= limit) | best_of_stage)
    item = F.struct("__n", "fact_id", "fact_type")
    first = F.sort_array(F.collect_list(F.when(F.col("__n") <= limit, item)))
    best = F.collect_list(F.when(best_of_stage, item))
    df = few.groupBy(key).agg(first.alias("chosen"), best.alias("best"))
    chosen = F.col("chosen")
    for stage in STAGES:
        # A column of its own for each stage, so that the plan stays a chain.
        of_stage = _of_type(stage)
        df = df.withColumn("new", F.get(F.filter("best", of_stage), F.lit(0)))
        redundant = lambda x: ~x["fact_type"].isin(*STAGES) | (F.size(F.filter(chosen, lambda y: y["fact_type"] == x["fact_type"])) > 1)
        # The chosen stand in the order of their places, with newcomers where they displaced another: the last redundant one goes.
        places = F.filter(F.transform(chosen, lambda x, i: F.when(redundant(x), i)), lambda i: i.isNotNull())
        last = F.array_max(places)
        absent = ~F.exists(chosen, of_stage) & F.col("new").isNotNull()
        swapped = F.transform(chosen, lambda x, i: F.when(i == F.col("last"), F.col("new")).otherwise(x))
        df = df.withColumn("last", last)
        df = df.withColumn("chosen", F.when(absent & (F.size(chosen) < limit), F.array_append(chosen, F.col("new"))).when(absent & F.col("last").isNotNull(), swapped).otherwise(chosen))
    return df.select(key, F.posexplode(F.sort_array("chosen")).alias("place", "x")).select(key, F.col("x.fact_id").alias("fact_id"), (F.col("place") + 1).alias("place"))
