"""Queries over what explains a mapping: outcomes of the rule table, turns of the conversation of the same number as facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import explain as X
from folioflow.operators import rulebook as B
from folioflow.plans import grading as P
from folioflow.plans import rulebook as Q
from folioflow.plans.registry import query

_MARKERS = ("src3", "src7")


@query(f"""with f as (select conv_id as doc_id, case role when 'user' then 'policy' else 'implementation' end as kind, case length(coalesce(text, '')) % 4 when 0 then 'primary' when 1 then 'supporting' when 2 then 'context' else 'contradictory' end as role from conversations),
  g as (select doc_id, bool_or(role = 'primary' and kind = 'implementation') as p, bool_or(kind = 'policy' or role = 'supporting') as s from f group by doc_id),
  l as (select d.doc_id, case when p then 'primary' when lower(coalesce(source, '')) in ('src3', 'src7') or s then 'supporting' when p is not null then 'context' else 'not_evidence' end as local, case d.doc_id % 5 when 0 then 'primary' when 1 then 'context' when 2 then 'not_evidence' when 3 then 'supporting' else 'unsure' end as model from documents d left join g using (doc_id)),
  o as (select *, list_position({list(X.ROLES)}, local) as a, list_position({list(X.ROLES)}, model) as b from l)
  select doc_id, local, {list(X.ROLES)}[least(a, case when b > 0 then b else a end)] as role from o""")
def conservative_roles(spark, t):
    n = F.length(F.coalesce("text", F.lit(""))) % 4
    facts = t("conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.when(F.col("role") == "user", "policy").otherwise("implementation").alias("fact_type"),
        F.when(n == 0, "primary").when(n == 1, "supporting").when(n == 2, "context").otherwise("contradictory").alias("role"),
    )
    markers = spark.createDataFrame([(m,) for m in _MARKERS], "term string")
    found = X.inferred_roles(t("documents"), facts, markers, "doc_id", "source").withColumnRenamed("role", "local")
    k = F.col("doc_id") % 5
    model = F.when(k == 0, "primary").when(k == 1, "context").when(k == 2, "not_evidence").when(k == 3, "supporting").otherwise("unsure")
    return found.select("doc_id", "local", X.conservative(F.col("local"), model).alias("role"))


@query(f"""with {P._MAPPINGS}, {Q._sql(False)},
  c0 as (select conv_id as doc_id, turn, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn desc) as k from conversations where turn <= 14),
  c as (select doc_id, count(*) as n_citations, string_agg(turn || '=' || array_to_string(string_split(text, ' ')[:5], ' '), '|' order by turn desc) as citations from c0 where k <= 12 group by doc_id),
  v as (select doc_id, unnest(list_filter([case when doc_id % 2 = 0 then 0 end, case when doc_id % 3 = 0 then 1 end], lambda x: x is not null)) as ordinal, length(coalesce(text, '')) as n, lang from documents),
  w as (select doc_id, bool_and((n + ordinal) % 3 <> 0) as verified, string_agg('f' || ordinal || coalesce(',' || lang, ''), ',' order by ordinal) as warnings from v group by doc_id)
  select d.doc_id, o.grade, case when fine then 'approved' else 'draft' end as approval_status, array_to_string(next_missing, ',') as missing, case when verified then 'verified' else 'needs_human_review' end as verification_status,
    coalesce(warnings, '') as warnings, coalesce(n_citations, 0) as n_citations, coalesce(citations, '') as citations from documents d join o using (doc_id) join p using (item_id) left join w on w.doc_id = d.doc_id left join c on c.doc_id = d.doc_id""")
def explainability(spark, t):
    (mappings, evidence), rules = Q._facts(spark, t), Q._rules(spark, t)
    outcomes = B.outcomes(B.assessed(mappings, evidence, rules, "doc_id", "item_id"), rules, "doc_id", "item_id").drop("item_id")
    key = lambda conv, turn: F.concat_ws(":", conv, turn)
    turns = t("conversations").select(key("conv_id", "turn").alias("fact_id"), F.col("turn").cast("string").alias("claim"), F.coalesce("text", F.lit("")).alias("text"))
    sources = turns.select("fact_id", F.posexplode(F.split("text", " ")).alias("ordinal", "quote"))
    own = mappings.select("doc_id", F.transform(F.sequence(F.lit(14), F.lit(0)), lambda i: key(F.col("doc_id").cast("string"), i.cast("string"))).alias("supporting"))
    checks = t("documents").select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, 0), F.when(F.col("doc_id") % 3 == 0, 1)))).alias("ordinal"), F.length(F.coalesce("text", F.lit(""))).alias("n"), "lang")
    checks = checks.select("doc_id", "ordinal", F.when((F.col("n") + F.col("ordinal")) % 3 != 0, "verified").otherwise("open").alias("status"), F.array_compact(F.array(F.concat(F.lit("f"), F.col("ordinal").cast("string")), F.col("lang"))).alias("findings"))
    found = X.explained(own, outcomes, checks, turns.select("fact_id", "claim"), sources, "doc_id")
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws("=", c["claim"], F.array_join(c["quotes"], " "))), "|")
    return found.select("doc_id", "grade", "approval_status", F.array_join("next_missing", ",").alias("missing"), "verification_status", F.array_join("warnings", ",").alias("warnings"), F.size("citations").cast("long").alias("n_citations"), cited.alias("citations"))
