"""Queries over rules and grades, each with its oracle.

The tables hold invented prose, so a lexicon of whole function words of its four languages stands for a
domain's terms; it is an input table of the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import grading as G
from folioflow.plans.registry import query

#: Whole words of the corpus's languages for each stage of evidence.
LEXICON = {
    "policy": ("that", "dans", "nicht", "los", "with"),
    "socialization": ("this", "avec", "von", "con", "pour"),
    "implementation": ("from", "des", "ist", "una", "are"),
    "evaluation": ("was", "sur", "auf", "por", "which"),
    "improvement": ("have", "est", "mit", "del", "not"),
}
PLAN, RESULT = ("for", "une", "zu", "se"), ("by", "les", "das", "las")


def _terms(spark):
    return spark.createDataFrame([(w, k) for k, words in LEXICON.items() for w in words], "term string, kind string")


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def _kinds(tokens):
    """Sorted kinds whose words the token list holds."""
    return "list_sort(list_filter([" + ", ".join(f"case when list_has_any({tokens}, {_list(w)}) then '{k}' end" for k, w in LEXICON.items()) + "], lambda x: x is not null))"


def _except(needed, have):
    return f"list_filter({_list(sorted(needed))}, lambda x: not list_contains({have}, x))"


@query(f"select doc_id, array_to_string({_kinds(_WORDS)}, ',') as kinds from documents")
def lexicon_stages(spark, t):
    return G.lexicon_hits(t("documents"), "doc_id", "text", _terms(spark)).select("doc_id", F.array_join("kinds", ",").alias("kinds"))


_GRADES = list(G.REQUIRED)
_BASE = "case item_id % 5 " + " ".join(f"when {i} then {_list(G.REQUIRED[g])}" for i, g in enumerate(_GRADES)) + " end"
_PROOF = "case s " + " ".join(f"when '{k}' then '{v}'" for k, v in G.PROOF.items()) + " end"
_RULES = f"""r0 as (select item_id, {_list(_GRADES)}[item_id % 5 + 1] as grade, list_sort(list_distinct(list_concat({_BASE}, {_kinds(_WORDS)}))) as required_stages from benchmark),
  r as (select item_id, grade, required_stages, list_sort(list_transform(required_stages, lambda s: {_PROOF})) as required_sources,
    case grade {' '.join(f"when '{g}' then '{p}'" for g, p in G.BEFORE.items() if p)} end as prerequisite from r0),
  c as (select *, sha256('{{"grade":"' || grade || '","prerequisite":' || coalesce('"' || prerequisite || '"', 'null') || ',"required_sources":["' || array_to_string(required_sources, '","') || '"],"required_stages":["' || array_to_string(required_stages, '","') || '"]}}') as checksum from r)"""


def _rules(spark, t):
    items = t("benchmark").join(G.lexicon_hits(t("benchmark"), "item_id", "text", _terms(spark)), "item_id")
    grade = F.element_at(G.strings(_GRADES), (F.col("item_id") % 5 + 1).cast("int"))
    return G.rule_checksum(G.compiled(items.withColumn("grade", grade), "item_id", "grade", "kinds"))


@query(f"with {_RULES} select item_id, grade, array_to_string(required_stages, ',') as required_stages, array_to_string(required_sources, ',') as required_sources, prerequisite from c")
def rule_compiler(spark, t):
    return _rules(spark, t).select("item_id", "grade", F.array_join("required_stages", ",").alias("required_stages"), F.array_join("required_sources", ",").alias("required_sources"), "prerequisite")


@query(f"with {_RULES} select item_id, grade, checksum from c")
def rule_checksum(spark, t):
    return _rules(spark, t).select("item_id", "grade", "checksum")


_DECIDED = "case item_id % 6 when 0 then 'rejected' when 1 then 'revoked' else 'approved' end"


@query(f"""with {_RULES}, k as (select *, item_id % 3 as kk, item_id % 7 as kode, 'v1' as version from c),
  d as (select kk, kode, item_id, grade, version, {_DECIDED} as status, case when item_id % 4 = 2 then 'old' else checksum end as checksum from k where item_id % 4 <> 3)
  select k.item_id, k.grade, case when d.checksum = k.checksum and d.status in ('approved', 'rejected') then d.status else 'draft' end as approval_status, coalesce(d.checksum <> k.checksum, false) as approval_stale
  from k left join d on k.kk = d.kk and k.kode = d.kode and k.item_id = d.item_id and k.grade = d.grade and k.version = d.version""")
def rule_approvals(spark, t):
    keys = ["kk", "kode", "item_id", "grade", "version"]
    rules = _rules(spark, t).withColumns({"kk": F.col("item_id") % 3, "kode": F.col("item_id") % 7, "version": F.lit("v1")})
    status = F.when(F.col("item_id") % 6 == 0, "rejected").when(F.col("item_id") % 6 == 1, "revoked").otherwise("approved")
    decisions = rules.where("item_id % 4 <> 3").select(*keys, status.alias("status"), F.when(F.col("item_id") % 4 == 2, "old").otherwise(F.col("checksum")).alias("checksum"))
    return G.approval_state(rules, decisions, keys).select("item_id", "grade", "approval_status", "approval_stale")


# A document is a mapping: its stages are its words' kinds, its periods and organisations come of its id and language.
_MAPPINGS = f"""m0 as (select doc_id, lang, text, {_WORDS} as w from documents),
  m as (select doc_id, {_kinds('w')} as stages, case when doc_id % 7 = 0 then ['2021', '2023'] when doc_id % 11 = 0 then []::varchar[] else [cast(2020 + doc_id % 4 as varchar)] end as periods,
    case when lang is null then []::varchar[] else [lang] end as organizations,
    list_filter([case when list_has_any(w, {_list(PLAN)}) and not list_has_any(w, {_list(RESULT)}) then 'plan_without_result' end, case when length(trim(coalesce(text, ''))) < 20 then 'template_only' end], lambda x: x is not null) as disqualifiers from m0),
  n as (select *, list_transform(stages, lambda s: {_PROOF}) as sources from m)"""


def _mappings(spark, t):
    # Each row is made of itself alone; its words are taken once.
    docs = t("documents").select("doc_id", "lang", F.length(F.trim(F.coalesce("text", F.lit("")))).alias("size"), G.word_set(F.col("text")).alias("w"))
    has = lambda own: F.arrays_overlap("w", G.strings(own))
    periods = F.when(F.col("doc_id") % 7 == 0, G.strings(["2021", "2023"])).when(F.col("doc_id") % 11 == 0, G.strings([])).otherwise(F.array((F.lit(2020) + F.col("doc_id") % 4).cast("string")))
    flags = F.array_compact(F.array(F.when(has(PLAN) & ~has(RESULT), F.lit("plan_without_result")), F.when(F.col("size") < 20, F.lit("template_only"))))
    df = G.with_kinds(docs, "w", _terms(spark))
    df = df.select("doc_id", periods.alias("periods"), F.when(F.col("lang").isNull(), G.strings([])).otherwise(F.array("lang")).alias("organizations"), flags.alias("disqualifiers"), F.col("kinds").alias("stages"))
    return df.withColumn("sources", F.transform("stages", lambda s: F.coalesce(*[F.when(s == k, F.lit(v)) for k, v in G.PROOF.items()])))


YEAR = 2021


def _assessed():
    parts, before = [], {}
    for g in _GRADES:
        own = [
            f"list_transform({_except(G.REQUIRED[g], 'stages')}, lambda x: 'stage:' || x)",
            f"list_transform({_except([G.PROOF[s] for s in G.REQUIRED[g]], 'sources')}, lambda x: 'source_type:' || x)",
            f"case when not p_{G.BEFORE[g]} then ['prerequisite_grade:{G.BEFORE[g]}'] else [] end" if G.BEFORE[g] else "[]::varchar[]",
            "case when len(periods) <> 1 then ['period:required_single'] else [] end",
            "case when len(organizations) <> 1 then ['organization:required_single'] else [] end",
            f"case when len(periods) = 0 or list_min(list_transform(periods, lambda p: cast(p as int))) < {YEAR} then ['period:before_effective_date'] else [] end",
            "list_transform(list_sort(disqualifiers), lambda x: 'disqualifier:' || x)",
        ]
        before[g] = "list_concat(" * (len(own) - 1) + own[0] + "".join(f", {x})" for x in own[1:])
        parts.append(f"select doc_id, '{g}' as grade, m_{g} as missing, p_{g} as passed from a_{g}")
    steps, last = [], "n"
    for g in _GRADES:
        steps.append(f"b_{g} as (select *, {before[g]} as m_{g} from {last}), a_{g} as (select *, len(m_{g}) = 0 as p_{g} from b_{g})")
        last = f"a_{g}"
    return ", ".join(steps) + ", s as (" + " union all ".join(parts) + ")"


_ASSESSED = f"with {_MAPPINGS}, {_assessed()}"


@query(f"{_ASSESSED} select doc_id, grade, array_to_string(missing, ',') as missing, passed from s")
def grade_assessment(spark, t):
    return G.assess(_mappings(spark, t), "doc_id", G.fallback_rules(YEAR)).select("doc_id", "grade", F.array_join("missing", ",").alias("missing"), "passed")


@query(f"{_ASSESSED} select d.doc_id, arg_max(grade, instr('EDCBA', grade)) filter (where passed) as grade from documents d left join s on d.doc_id = s.doc_id group by d.doc_id")
def passed_grades(spark, t):
    return G.passed_grade(G.assess(_mappings(spark, t), "doc_id", G.fallback_rules(YEAR)), "doc_id")


_FLAGS = """f as (select n.doc_id, coalesce(l.quality = 1, false) as f1, n_chars >= 100 as f2, len(n.stages) > 0 as f3,
    coalesce(case when n.doc_id % 5 = 0 then null when n.doc_id % 5 = 1 then 'draft' else 'approved' end = 'approved', false) as ok, len(n.stages) - 1 as rank, case when n.doc_id % 3 = 0 then 1 else 4 end as ceiling, len(periods) = 1 as f5, len(organizations) = 1 as f6
  from n join documents d on n.doc_id = d.doc_id left join labels l on n.doc_id = l.doc_id),
  g as (select *, ok and rank >= 0 and rank <= ceiling as f4 from f)"""


@query(f"""with {_MAPPINGS}, {_FLAGS} select doc_id, array_to_string(list_filter([case when not f1 then 'mapping_status' end, case when not f2 then 'coverage' end, case when not f3 then 'sources' end,
  case when not f4 and rank > ceiling then 'grade_over_ceiling' when not f4 then 'grade_rule' end, case when not f5 then 'period' end, case when not f6 then 'organization' end], lambda x: x is not null), ',') as findings,
  f1 and f2 and f3 and f4 and f5 and f6 as verified from g""")
def six_flag_verification(spark, t):
    df = _mappings(spark, t).join(t("documents").select("doc_id", "n_chars"), "doc_id").join(t("labels"), "doc_id", "left")
    grades = lambda n: F.get(G.strings(_GRADES), n)
    k = F.col("doc_id")
    out = G.six_flags(
        df,
        F.when(F.col("quality") == 1, "candidate").otherwise("needs_review"),
        F.when(F.col("n_chars") >= 100, "complete").otherwise("partial"),
        F.size("stages") > 0,
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "draft").otherwise("approved"),
        grades(F.size("stages") - 1),
        grades(F.when(k % 3 == 0, 1).otherwise(4)),
        F.col("periods"),
        F.col("organizations"),
    )
    return out.select("doc_id", F.array_join("findings", ",").alias("findings"), "verified")


@query("""with c as (select o_custkey as k, o_orderkey as n, case when o_orderstatus = 'P' then 'needs_review' else 'candidate' end as status, case when o_orderpriority < '3' then 'plausible' else 'doubtful' end as verdict, o_totalprice from orders),
  s as (select k, n, case when status = 'candidate' and verdict = 'plausible' and o_totalprice < 200000 then 'candidate' else 'needs_review' end as status from c)
  select k, n, status, cast(row_number() over (partition by k order by case status when 'candidate' then 0 else 1 end, n) as int) as rank from s""")
def mapping_review(spark, t):
    orders = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("n"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    candidates = orders.select("k", "n", F.when(F.col("o_orderstatus") == "P", "needs_review").otherwise("candidate").alias("status"))
    verdicts = orders.where("o_totalprice < 200000").select("k", "n", F.when(F.col("o_orderpriority") < "3", "plausible").otherwise("doubtful").alias("verdict"))
    return G.demoted(candidates, verdicts, ["k", "n"], "n")


@query(f"""with {_MAPPINGS}, m2 as (select n.doc_id, d.source, coalesce(d.lang, 'unknown') as lang, unnest(case when len(stages) = 0 then ['none'] else stages end) as stage, periods, organizations from n join documents d on n.doc_id = d.doc_id
    left join labels l on d.doc_id = l.doc_id where coalesce(l.quality = 1 and l.toxic = 0, false)),
  g as (select source, lang, count(*) as n_members, count(distinct doc_id || ':' || stage) as n_facts, count(distinct doc_id) as n_runs, list_sort(list_distinct(list(stage) filter (where stage <> 'none'))) as s, bool_or(len(periods) > 1 or len(organizations) > 1) as contradictory from m2 group by source, lang)
  select source, lang, n_members, n_facts, n_runs, array_to_string(coalesce(s, []), ',') as stages, case {' '.join(f"when list_has_all(coalesce(s, []), {_list(G.REQUIRED[g])}) then '{g}'" for g in reversed(_GRADES))} end as safe_grade, contradictory from g""")
def evidence_synthesis(spark, t):
    m = _mappings(spark, t).join(t("documents").select("doc_id", "source", "lang"), "doc_id").join(t("labels"), "doc_id", "left")
    stage = F.explode(F.when(F.size("stages") == 0, G.strings(["none"])).otherwise(F.col("stages")))
    rows = m.select(F.col("doc_id").alias("run_id"), "source", F.coalesce("lang", F.lit("unknown")).alias("lang"), stage.alias("stage"), "periods", "organizations", "quality", "toxic")
    rows = rows.withColumn("fact_id", F.concat_ws(":", "run_id", "stage"))
    found = G.synthesis(rows, ["source", "lang"], (F.col("quality") == 1) & (F.col("toxic") == 0))
    return found.withColumn("stages", F.array_join("stages", ","))


def _bounded(x):
    return f"greatest(0, least(1, coalesce({x}, 0)))"


def _router(name, complexity, risk, needed, threshold, blocks, bypass="false"):
    """SQL of one router over the table x(doc_id, n_chars, lines, marks, digits, toxic, quality)."""
    score = lambda parts: "floor((" + " + ".join(f"{w} * {_bounded(c)}" for w, c in parts) + ") * 10000 + 0.500001) / 10000.0::double"
    free = " and ".join(f"not coalesce({c}, false)" for c in blocks.values())
    reasons = [f"case when not coalesce({needed}, false) then 'not_needed' end", f"case when coalesce({needed}, false) then 'needed' end", f"case when coalesce({needed}, false) and not (complexity >= {threshold} or {bypass}) then 'below_threshold' end", *[f"case when coalesce({c}, false) then '{n}' end" for n, c in blocks.items()]]
    return f"""select doc_id, '{name}' as phase, complexity, risk, coalesce({needed}, false) and (complexity >= {threshold} or {bypass}) and {free} as selected,
      array_to_string(list_sort(list_filter([{', '.join(reasons)}], lambda r: r is not null)), ',') as reasons from (select *, {score(complexity)} as complexity, {score(risk)} as risk from x) y"""


#: Weights and thresholds of the three routers; each part is a share from 0 to 1.
_FACT = ((0.25, "0.5"), (0.15, "lines / 40.0::double"), (0.2, "marks"), (0.25, "digits"), (0.1, "n_chars / 6000.0::double")), ((0.35, "1 - quality"), (0.25, "toxic"), (0.2, "marks"), (0.2, "digits"))
_MAP = ((0.4, "lines / 20.0::double"), (0.6, "marks")), ((0.5, "toxic"), (0.5, "1 - quality"))
_CHECK = ((0.7, "n_chars / 20000.0::double"), (0.3, "digits")), ((1.0, "toxic"),)


@query(f"""with x as (select d.doc_id, n_chars, cast(len(string_split(coalesce(text, ''), chr(10))) as double) as lines, len(regexp_extract_all(text, '[#*$%&|<>]')) / cast(greatest(n_chars, 1) as double) * 10 as marks,
    len(regexp_extract_all(text, '[0-9]')) / cast(greatest(n_chars, 1) as double) * 10 as digits, cast(toxic as double) as toxic, cast(quality as double) as quality from documents d left join labels l on d.doc_id = l.doc_id)
  {_router('fact', *_FACT, 'n_chars > 400', 0.3, {'coverage_failed': 'n_chars < 50', 'local_only': 'toxic = 1'}, 'coalesce(digits >= 0.25, false)')} union all
  {_router('mapping', *_MAP, 'quality is null', 0.2, {'local_only': 'toxic = 1'})} union all
  {_router('verification', *_CHECK, 'toxic = 1 or quality = 0', 0.25, {'budget_spent': 'n_chars > 15000'})}""")
def compute_routing(spark, t):
    c = F.col
    rate = lambda p: F.regexp_count("text", F.lit(p)) / F.greatest("n_chars", F.lit(1)).cast("double") * 10
    x = t("documents").join(t("labels"), "doc_id", "left").select(
        "doc_id", "n_chars", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("double").alias("lines"), rate("[#*$%&|<>]").alias("marks"), rate("[0-9]").alias("digits"), c("toxic").cast("double").alias("toxic"), c("quality").cast("double").alias("quality")
    )
    off = 1 - c("quality")
    parts = lambda *own: {str(i): p for i, p in enumerate(own)}
    # The weights and thresholds as above.
    fact = G.routed(
        x, parts((0.25, F.lit(0.5)), (0.15, c("lines") / 40), (0.2, c("marks")), (0.25, c("digits")), (0.1, c("n_chars") / 6000.0)), parts((0.35, off), (0.25, c("toxic")), (0.2, c("marks")), (0.2, c("digits"))),
        c("n_chars") > 400, 0.3, {"coverage_failed": c("n_chars") < 50, "local_only": c("toxic") == 1}, c("digits") >= 0.25,
    )
    mapping = G.routed(x, parts((0.4, c("lines") / 20), (0.6, c("marks"))), parts((0.5, c("toxic")), (0.5, off)), c("quality").isNull(), 0.2, {"local_only": c("toxic") == 1})
    check = G.routed(x, parts((0.7, c("n_chars") / 20000.0), (0.3, c("digits"))), parts((1.0, c("toxic"))), (c("toxic") == 1) | (c("quality") == 0), 0.25, {"budget_spent": c("n_chars") > 15000})
    out = None
    for phase, df in (("fact", fact), ("mapping", mapping), ("verification", check)):
        own = df.select("doc_id", F.lit(phase).alias("phase"), "complexity", "risk", "selected", F.array_join("reasons", ",").alias("reasons"))
        out = own if out is None else out.union(own)
    return out


_KINDS = [*G.STAGES, "general", "general", "general"]


@query(None)
def stage_diverse_facts(spark, t):
    """The 12 best orders of a group of customers with every stage present; the test compares it with a plain loop."""
    kinds = F.element_at(G.strings(_KINDS), (F.col("o_orderkey") % 8 + 1).cast("int"))
    facts = t("orders").select(
        (F.col("o_custkey") % 50).alias("k"), F.col("o_orderkey").alias("fact_id"), kinds.alias("fact_type"),
        F.when(F.col("o_orderstatus") == "P", "contradictory").otherwise("primary").alias("role"), (F.col("o_totalprice") / 500_000).alias("score"),
    )
    return G.stage_diverse(facts, "k")


def facts_of(orders):
    """The same facts as plain tuples, for the test."""
    return [(r.o_custkey % 50, r.o_orderkey, _KINDS[r.o_orderkey % 8], "contradictory" if r.o_orderstatus == "P" else "primary", r.o_totalprice / 500_000) for r in orders]
