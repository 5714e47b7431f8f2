"""Queries over rules as a table: documents are mappings to the parameters that benchmark items stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import grading as G
from folioflow.operators import rulebook as B
from folioflow.plans import grading as P
from folioflow.plans.registry import query
from folioflow.session import written

#: Parameters that documents map to; the last few are no items of the smaller tables, so they have no rules of their own.
PARAMETERS = 45


def _rules(spark, t, changed: bool = False):
    """Rules of most grades of each item; in the changed table some have lost their approval or ask for a year."""
    kinds = t("benchmark").select("item_id").join(G.lexicon_hits(t("benchmark"), "item_id", "text", P._terms(spark)), "item_id")
    each = kinds.select("item_id", "kinds", F.posexplode(G.strings(P._GRADES)).alias("n", "grade")).where("(item_id + n) % 4 <> 0")
    year = F.when(F.col("item_id") % 6 == 0, 2021)
    year = F.when(F.col("item_id") % 10 == 7, 2022).otherwise(year) if changed else year
    rules = G.rule_checksum(G.compiled(each, "item_id", "grade", "kinds").withColumn("effective_year", year), ["effective_year"])
    refused = (F.col("item_id") % 9 == 4) | (F.lit(changed) & (F.col("item_id") % 9 == 5))
    decided = rules.where("item_id % 5 <> 3").select("item_id", "grade", F.when(refused, "rejected").otherwise("approved").alias("status"), F.when((F.col("item_id") % 8 == 1) & (F.col("grade") == "C"), "old").otherwise(F.col("checksum")).alias("checksum"))
    approved = G.approval_state(rules, decided, ["item_id", "grade"]).drop("approval_stale")
    parameters = spark.range(PARAMETERS).select(F.col("id").alias("item_id"))
    return written(B.with_needs(written(B.with_fallbacks(parameters, approved, "item_id"), "rules"), "item_id").coalesce(1), "rulebook")


def _facts(spark, t, changed: bool = False):
    """Mappings and their evidence; in the changed table some documents have lost a stage, some are gone."""
    df = P._mappings(spark, t).withColumn("item_id", F.pmod("doc_id", F.lit(PARAMETERS)))
    if changed:
        df = df.where("doc_id % 50 <> 49").withColumn("stages", F.when(F.col("doc_id") % 20 == 3, F.slice("stages", 2, 9)).otherwise(F.col("stages")))
    of = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    shown = F.concat(of("stage", "stages"), of("source_type", "sources"))
    df = written(df.select("doc_id", "item_id", "periods", "organizations", "disqualifiers", shown.alias("shown")), "mappings")
    return df.drop("shown"), df.select("doc_id", F.inline("shown"))


def _sql(changed: bool) -> str:
    """Rules r, mappings m and judged grades j as SQL; the chain of grades is spelled out from its end."""
    year = "case when item_id % 10 = 7 then 2022 when item_id % 6 = 0 then 2021 end" if changed else "case when item_id % 6 = 0 then 2021 end"
    refused = "item_id % 9 = 4" + (" or item_id % 9 = 5" if changed else "")
    s = "y" if changed else ""
    base = "case grade " + " ".join(f"when '{g}' then {P._list(G.REQUIRED[g])}" for g in P._GRADES) + " end"
    before = "case grade " + " ".join(f"when '{g}' then '{p}'" for g, p in G.BEFORE.items() if p) + " end"
    quoted = "array_to_string({0}, '\",\"')"
    stages = "case when doc_id % 20 = 3 then stages[2:] else stages end" if changed else "stages"
    return f"""g{s} as (select i.item_id, grade, coalesce((item_id + n) % 4 <> 0 and b.item_id is not null, false) as own, {base} as base, {before} as prerequisite, text from (select unnest(range({PARAMETERS})) as item_id) i
      cross join (select unnest({P._list(P._GRADES)}) as grade, unnest(range(5)) as n) left join (select item_id, text from benchmark) b using (item_id)),
    r0{s} as (select *, case when own then list_sort(list_distinct(list_concat(base, {P._kinds(P._WORDS)}))) else list_sort(base) end as stages, case when own then {year} end as effective_year from g{s}),
    r1{s} as (select *, list_sort(list_transform(stages, lambda s: {P._PROOF})) as sources from r0{s}),
    r2{s} as (select *, sha256('{{"effective_year":' || coalesce('"' || effective_year || '"', 'null') || ',"grade":"' || grade || '","prerequisite":' || coalesce('"' || prerequisite || '"', 'null') || ',"required_sources":["' || {quoted.format('sources')} || '"],"required_stages":["' || {quoted.format('stages')} || '"]}}') as checksum from r1{s}),
    r{s} as (select item_id, grade, own, stages, sources, prerequisite, effective_year, case when not own or item_id % 5 = 3 or (item_id % 8 = 1 and grade = 'C') then 'draft' when {refused} then 'rejected' else 'approved' end as approval_status, case when own then checksum else '' end as checksum from r2{s}),
    mp{s} as (select doc_id, doc_id % {PARAMETERS} as item_id, periods, organizations, disqualifiers, {stages} as have, sources as types from n {"where doc_id % 50 <> 49" if changed else ""}),
    l{s} as (select mp{s}.*, grade, prerequisite, own, approval_status, checksum, list_concat(list_transform(list_filter(r{s}.stages, lambda x: not list_contains(have, x)), lambda x: 'stage:' || x), list_transform(list_filter(r{s}.sources, lambda x: not list_contains(types, x)), lambda x: 'source_type:' || x)) as before,
      list_concat(case when len(periods) <> 1 then ['period:required_single'] else [] end, case when len(organizations) <> 1 then ['organization:required_single'] else [] end,
        case when effective_year is not null and (len(periods) = 0 or list_min(list_transform(periods, lambda p: cast(p as int))) < effective_year) then ['period:before_effective_date'] else [] end, list_transform(list_sort(disqualifiers), lambda x: 'disqualifier:' || x)) as after from mp{s} join r{s} using (item_id)),
    met{s} as (select doc_id, list(grade) filter (where len(before) = 0 and len(after) = 0) as met from l{s} group by doc_id),
    k{s} as (select l{s}.*, {_chain('grade')} as passed, {_chain('prerequisite')} as ready from l{s} join met{s} using (doc_id)),
    j{s} as (select doc_id, item_id, grade, own, approval_status, checksum, list_concat(before, case when prerequisite is not null and not ready then ['prerequisite_grade:' || prerequisite] else [] end, after) as missing, passed from k{s}),
    p{s} as (select item_id, coalesce(bool_or(own) and bool_and(case when own then approval_status = 'approved' end), false) as fine from r{s} group by item_id),
    o{s} as (select doc_id, item_id, arg_max(grade, instr('EDCBA', grade)) filter (where passed) as grade, coalesce(arg_min(missing, instr('EDCBA', grade)) filter (where len(missing) > 0), []) as next_missing from j{s} group by doc_id, item_id)"""


def _chain(of: str) -> str:
    """Whether a grade and all before it are among the met ones."""
    cases = []
    for g in P._GRADES:
        needs, at = [], g
        while at:
            needs, at = [*needs, at], G.BEFORE[at]
        cases.append(f"when '{g}' then coalesce(list_has_all(coalesce(met, []), {P._list(needs)}), false)")
    return f"case {of} {' '.join(cases)} end"


@query(f"with {P._MAPPINGS}, {_sql(False)} select doc_id, item_id, grade, array_to_string(missing, ',') as missing, passed, approval_status from j")
def grade_assessment_compiled(spark, t):
    mappings, evidence = _facts(spark, t)
    found = B.assessed(mappings, evidence, _rules(spark, t), "doc_id", "item_id")
    return found.select("doc_id", "item_id", "grade", F.array_join("missing", ",").alias("missing"), "passed", "approval_status")


@query(f"with {P._MAPPINGS}, {_sql(False)} select doc_id, item_id, grade, array_to_string(next_missing, ',') as next_missing, case when fine then 'approved' else 'draft' end as approval_status, fine and grade is not null as primary_allowed from o join p using (item_id)")
def primary_grades(spark, t):
    (mappings, evidence), rules = _facts(spark, t), _rules(spark, t)
    found = B.outcomes(B.assessed(mappings, evidence, rules, "doc_id", "item_id"), rules, "doc_id", "item_id")
    return found.withColumn("next_missing", F.array_join("next_missing", ","))


# A mapping changes with its parameter's rules, their approval, or its own evidence; what changed has a second version.
@query(f"""with {P._MAPPINGS}, {_sql(False)}, {_sql(True)},
  ra as (select item_id, list((grade, checksum, approval_status) order by grade) as x from r group by item_id), rb as (select item_id, list((grade, checksum, approval_status) order by grade) as x from ry group by item_id),
  changed as (select mpy.doc_id from mpy join mp on mp.doc_id = mpy.doc_id join ra on ra.item_id = mp.item_id join rb on rb.item_id = mpy.item_id where ra.x <> rb.x or mp.have <> mpy.have)
  select doc_id, 1 as version, grade, array_to_string(next_missing, ',') as next_missing, fine and grade is not null as primary_allowed, doc_id not in (select doc_id from changed) and doc_id in (select doc_id from mpy) as is_active, cast(null as int) as supersedes from o join p using (item_id)
  union all select doc_id, 2, grade, array_to_string(next_missing, ','), fine and grade is not null, true, 1 from oy join py using (item_id) where doc_id in (select doc_id from changed)""")
def incremental_reverification(spark, t):
    (mappings, evidence), rules = _facts(spark, t), _rules(spark, t)
    first = written(B.reverified(_no_versions(spark), mappings, evidence, rules, "doc_id", "item_id")[0], "versions")
    (mappings, evidence), rules = _facts(spark, t, True), _rules(spark, t, True)
    fresh, kept = B.reverified(first, mappings, evidence, rules, "doc_id", "item_id")
    found = B.select_versions(fresh, kept, ["doc_id", "version", "grade", "next_missing", "primary_allowed"])
    return found.withColumn("next_missing", F.array_join("next_missing", ","))


def _no_versions(spark):
    return spark.createDataFrame([], "doc_id long, item_id long, grade string, next_missing array<string>, approval_status string, primary_allowed boolean, basis string, version int")
