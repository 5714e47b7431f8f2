"""Queries over evidence: merges, packages, scores, roles, verdicts, leases and checks, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import documents as D
from folioflow.operators import evaluation as E
from folioflow.operators import relational as R
from folioflow.operators import retrieval as V
from folioflow.operators import rules as U
from folioflow.plans.registry import query
from folioflow.session import written

#: Keywords of the corpus's languages, in place of a domain's lexicon.
STAGES = {"policy": "the", "shared": "and", "done": "tion", "evaluated": "ing", "improved": "able"}
CLASSES = {"english": ("the", "and", "ing"), "french": ("les", "eaux", "que"), "german": ("der", "sch", "und")}
TOPICS = {"motion": ("tion", "on"), "making": ("ment", "in"), "naming": ("heit", "de")}
SOURCES = {"letter": ("dear", "the"), "report": ("tion", "result"), "minutes": ("ment", "of")}
SYNONYMS = (("est", "best", "rest"), ("on", "upon"))


def _stages():
    return {k: F.instr(F.lower("text"), w) > 0 for k, w in STAGES.items()}


_STAGE_SQL = ", ".join(f"coalesce(instr(lower(text), '{w}') > 0, false) as {k}" for k, w in STAGES.items())
_SAFE_SQL = "case when policy and done and evaluated and improved then 'A' when policy and done and evaluated then 'B' when policy and done then 'C' when policy and shared then 'D' when policy then 'E' end"
_STATUS_SQL = "case when score > 80 then 'primary' when score >= 65 then 'supporting' when score >= 55 then 'review' else 'rejected' end"


def _any(words):
    return " or ".join(f"instr(lower(text), '{w}') > 0" for w in words)


@query("""with r as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events where event_type in ('view', 'purchase')),
  u as (select *, row_number() over (partition by user_id order by ts desc, case event_type when 'purchase' then 0 else 1 end) as k from r where n = 1) select user_id, event_id, event_type from u where k = 1""")
def upsert_merge(spark, t):
    last = lambda kind: R.latest(t("events").where(F.col("event_type") == kind), ["user_id"], F.desc("ts"), F.desc("event_id"))
    return R.upsert(last("view"), last("purchase"), ["user_id"], "ts").select("user_id", "event_id", "event_type")


@query("""with o as (select c_custkey as k, case when c_mktsegment = 'BUILDING' then ' ' else c_mktsegment end as a from customer), n as (select o_custkey as k, max(o_orderpriority) as b from orders group by o_custkey)
  select coalesce(o.k, n.k) as c_custkey, case when trim(coalesce(a, '')) <> '' then a else b end as label from o full join n on o.k = n.k""")
def conditional_upsert(spark, t):
    old = t("customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_mktsegment")).alias("label"))
    return R.keep_label(old, t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("label")), "c_custkey", "label")


_KEYS = {"nation": "n_nationkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "documents": "doc_id"}


@query(" union all ".join(f"select '{n}' as table_name, count(*) as n_rows, coalesce(sum({k}), 0)::bigint as key_sum from {n}" for n, k in _KEYS.items()))
def table_manifest(spark, t):
    return R.manifest({n: (t(n), k) for n, k in _KEYS.items()})


@query("""select r_name, '{"region":"' || r_name || '","nations":["' || string_agg(n_name, '","' order by n_name) || '"]}' as snapshot from nation join region on n_regionkey = r_regionkey group by r_name""")
def static_snapshot(spark, t):
    df = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("nations"))
    return df.select("r_name", F.to_json(F.struct(F.col("r_name").alias("region"), "nations")).alias("snapshot"))


@query("""with q as (select doc_id, case when lang = 'en' then upper(substr(text, 3, 25)) else substr(text, 3, 25) end as quote from documents)
  select q.doc_id, coalesce(trim(quote) <> '' and instr(text, quote) > 0, false) as verified from q join documents d on q.doc_id = d.doc_id""")
def quote_provenance(spark, t):
    part = F.substring("text", 3, 25)
    quotes = t("documents").select("doc_id", F.when(F.col("lang") == "en", F.upper(part)).otherwise(part).alias("quote"))
    return D.verified_quotes(quotes, t("documents")).select("doc_id", "verified")


@query("""with l as (select l_orderkey as k, count(*) as n from lineitem group by 1) select c_custkey, count(o_orderkey) as n_orders, coalesce(sum(l.n), 0)::bigint as n_lines
  from customer left join orders on c_custkey = o_custkey left join l on l.k = o_orderkey group by c_custkey""")
def status_chain(spark, t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("__n"))
    orders = t("orders").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("__o"), F.sum("__n").alias("__l"))
    return t("customer").join(orders, "c_custkey", "left").select("c_custkey", F.coalesce("__o", F.lit(0)).alias("n_orders"), F.coalesce("__l", F.lit(0)).alias("n_lines"))


@query("""with d as (select doc_id, sha256(text) as h from documents), g as (select h, min(doc_id) as first_id, count(*) as n from d group by h having count(*) > 1) select doc_id, first_id, n - 1 as n_others from d join g on d.h = g.h""")
def copy_members(spark, t):
    return R.copies(t("documents"), F.sha2("text", 256), "doc_id")


_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(rf"""with p as (select page_id, {_PATH} as path from pages), f as (select distinct regexp_extract(path, '^[^/]+/[^/]+') as prefix from p)
  select page_id, prefix from p join f on path = prefix or starts_with(path, prefix || '/') where prefix <> ''""")
def prefix_members(spark, t):
    pages = t("pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    prefixes = pages.select(F.regexp_extract("path", "^[^/]+/[^/]+", 0).alias("prefix")).where("prefix <> ''").distinct()
    return R.prefix_join(pages, "path", prefixes, "prefix").select("page_id", "prefix")


@query("select o_orderstatus as status, o_orderpriority as priority, count(*) as n, grouping(o_orderpriority)::bigint as is_total from orders group by rollup (o_orderstatus, o_orderpriority)")
def status_totals(spark, t):
    df = t("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).rollup("status", "priority")
    return df.agg(F.count("*").alias("n"), F.grouping("priority").cast("long").alias("is_total"))


@query(r"""select doc_id, left(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: length(x) > 0)[1], 180) as heading from documents""")
def document_headings(spark, t):
    return t("documents").select("doc_id", T.heading(F.col("text")).alias("heading"))


@query("""select 'documents' as metric, count(*)::bigint as value from documents union all select 'characters', sum(n_chars)::bigint from documents union all select 'texts', count(distinct sha256(text)) from documents
  union all select 'languages', count(distinct lang) from documents union all select 'blank', count(*) filter (where trim(coalesce(text, '')) = '') from documents""")
def corpus_summary(spark, t):
    one = t("documents").agg(
        F.count("*").alias("documents"),
        F.sum("n_chars").alias("characters"),
        F.countDistinct(F.sha2("text", 256)).alias("texts"),
        F.countDistinct("lang").alias("languages"),
        F.count(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", 1)).alias("blank"),
    )
    return one.unpivot([], one.columns, "metric", "value")


@query(f"""with s as (select source, n_chars, {_STAGE_SQL} from documents),
  g as (select source, round(avg(least(100.0::double, n_chars / 50.0::double)), 1) as average, bool_or(policy) as policy, bool_or(shared) as shared, bool_or(done) as done, bool_or(evaluated) as evaluated, bool_or(improved) as improved from s group by source),
  c as (select *, round((policy::int + shared::int + done::int + evaluated::int + improved::int) / 5.0::double * 100, 1) as chain_score from g), x as (select *, round(round(average * 0.65::double + chain_score * 0.35::double, 6), 1) as score from c)
  select source, average, chain_score, score, {_SAFE_SQL} as safe_grade, {_STATUS_SQL} as status from x""")
def package_scores(spark, t):
    score = F.least(F.lit(100.0), F.col("n_chars") / 50.0)
    return U.package_score(t("documents"), ["source"], _stages(), score).select("source", "average", "chain_score", "score", "safe_grade", "status")


@query("""with g as (select o_custkey, count(*) as total, count(*) filter (where o_orderstatus = 'F') as completed, count(*) filter (where o_orderstatus = 'P') as failed from orders group by o_custkey)
  select *, completed + failed as terminal, round(100.0::double * (completed + failed) / total, 1) as percentage, case when completed + failed < total then case when completed + failed > 0 then 'running' else 'queued' end
    when failed = total then 'failed' when failed > 0 then 'partial' else 'completed' end as status from g""")
def batch_progress(spark, t):
    return U.progress(t("orders"), "o_custkey", "o_orderstatus", "F", "P")


@query("""select key, json_extract_string(props, '$.' || key) as value, count(*) as n from (select props, unnest(json_keys(props)) as key from events) group by 1, 2""")
def reason_histogram(spark, t):
    return t("events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))


@query("""with d as (select o_custkey, o_orderkey, cast(substr(o_orderpriority, 1, 1) as int) as declared, row_number() over (partition by o_custkey, substr(o_orderpriority, 1, 1) order by o_orderkey) as n from orders)
  select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by declared) as int) as rank from d where n = 1""")
def renumbered_ranks(spark, t):
    df = t("orders").withColumn("declared", F.substring("o_orderpriority", 1, 1).cast("int"))
    return R.renumber(df, "o_custkey", "declared", "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("""select o_orderkey, o_orderpriority, o_orderdate from orders where o_orderstatus = 'O' order by case when o_orderpriority = '1-URGENT' then 0 else 1 end, o_orderdate, o_orderkey limit 25""")
def queue_head(spark, t):
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
    return t("orders").where("o_orderstatus = 'O'").orderBy(urgent, "o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("""with h as (select user_id, list(distinct event_type) as have from events group by user_id)
  select user_id, array_to_string(list_filter(['view', 'click', 'purchase'], lambda x: not list_contains(have, x)), ',') as missing, list_has_all(have, ['view', 'click', 'purchase']) as complete from h""")
def requirement_subset(spark, t):
    lacks = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("have")).select("user_id", U.missing(F.col("have"), ("view", "click", "purchase")).alias("m"))
    return lacks.select("user_id", F.array_join("m", ",").alias("missing"), (F.size("m") == 0).alias("complete"))


@query("""with f as (select user_id, event_type, min(event_id) as first_at from events group by all), r as (select *, row_number() over (partition by user_id order by first_at, event_type) as n from f)
  select user_id, string_agg(event_type, ',' order by n) as kinds from r where n <= 3 group by user_id""")
def ordered_union(spark, t):
    return R.first_seen(t("events"), "user_id", "event_type", "event_id", 3).select("user_id", F.array_join("values", ",").alias("kinds"))


_TOKEN_SQL = "list_filter(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'), lambda x: length(x) >= 2 and not list_contains([" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "], x))"
_LEX_SQL = ", ".join(f"('{a}', '{b}')" for g in SYNONYMS for a in g for b in g if a != b)
_POST_SQL = f"""dp as (select distinct doc_id, unnest({_TOKEN_SQL.format("text")}) as token from documents), cp as (select distinct item_id, unnest({_TOKEN_SQL.format("text")}) as token from benchmark),
  ov as (select doc_id, item_id, count(*) as n_common from dp join cp using (token) group by all), ds as (select doc_id, count(*) as a from dp group by doc_id), cs as (select item_id, count(*) as b from cp group by item_id)"""


@query(f"""with tk as (select distinct item_id as id, unnest({_TOKEN_SQL.format("text")}) as token from benchmark), x as (select * from (values {_LEX_SQL}) v(token, other))
  select id, token from tk union select id, other from tk join x using (token)""")
def synonym_terms(spark, t):
    return V.semantic_vectors(t("benchmark"), "item_id", "text", SYNONYMS).where("w = 1.0").select("id", "token")


def _overlap(t):
    return V.overlap(t("documents"), "doc_id", "text", V.postings(t("benchmark"), "item_id", "text"))


@query(f"""with {_POST_SQL} select doc_id, item_id, n_common, round(n_common / cast(least(a, b) as double), 6) as share, round(least(0.18::double, n_common * 0.035::double), 6) as bonus
  from ov join ds using (doc_id) join cs using (item_id) where round(n_common / cast(least(a, b) as double), 6) >= 0.5""")
def fact_mapping(spark, t):
    return _overlap(t).where("share >= 0.5").withColumn("bonus", V.bonus(F.col("n_common"), 0.035, 0.18))


@query(f"""with {_POST_SQL}, o as (select doc_id, item_id from ov join ds using (doc_id) join cs using (item_id) where round(n_common / cast(least(a, b) as double), 6) >= 0.8)
  select o.doc_id, o.item_id, case when length(trim(b.text)) >= 12 and instr(lower(coalesce(d.text, '')), lower(trim(b.text))) > 0 then 0.25::double else 0.0::double end as points
  from o join documents d on d.doc_id = o.doc_id join benchmark b on b.item_id = o.item_id""")
def phrase_points(spark, t):
    near = _overlap(t).where("share >= 0.8").select("doc_id", "item_id")
    items = t("benchmark").select("item_id", F.col("text").alias("phrase"))
    return near.join(items, "item_id").join(t("documents").select("doc_id", "text"), "doc_id").select("doc_id", "item_id", V.phrase_bonus(F.col("text"), F.col("phrase")).alias("points"))


@query(f"""with k as (select distinct d.doc_id, token, quality from (select doc_id, unnest({_TOKEN_SQL.format("text")}) as token from documents) d join labels l on d.doc_id = l.doc_id),
  s as (select token, round(count(*) filter (where quality = 0) / cast(count(*) as double), 6) as p from k group by token having count(*) filter (where quality = 0) >= 2), g as (select token, p from s where p >= 0.8)
  select doc_id, round(least(0.18::double, sum(0.08::double + p * 0.06::double)), 6) as bonus from (select distinct doc_id, unnest({_TOKEN_SQL.format("text")}) as token from documents) join g using (token) group by doc_id""")
def feedback_points(spark, t):
    terms = V.dealt(t("documents"), "doc_id", "text").select("doc_id", V.token_set(F.col("runs")).alias("t"))
    seen = terms.join(V.measured(t("labels").select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.explode("t").alias("token"))
    learned = E.feedback_terms(seen, t("labels").where("quality = 0")).select(F.sha2("token", 256).alias("term_hash"), "precision")
    return V.feedback_bonus(terms.select("doc_id", F.explode("t").alias("token")), written(learned, "learned"))


def _hits_sql(words, text="text"):
    return " + ".join(f"(instr(lower(coalesce({text}, '')), '{w}') > 0)::int" for w in words)


@query("with h as (" + " union all ".join(f"select doc_id, '{k}' as context, {_hits_sql(w)} as n from documents" for k, w in CLASSES.items()) + """), b as (select *, max(n) over (partition by doc_id) as best from h)
  select doc_id, context, round(least(0.35::double, n / cast(best as double) * 0.35::double), 4) as score from b where n > 0""")
def context_scores(spark, t):
    return V.context_scores(t("documents"), "doc_id", F.col("text"), CLASSES)


def _topic_sql(words):
    one = lambda w: f"regexp_matches(lower(coalesce(text, '')), '(^|[^a-z0-9]){w}([^a-z0-9]|$)')" if len(w) <= 4 else f"instr(lower(coalesce(text, '')), '{w}') > 0"
    return " + ".join(f"({one(w)})::int" for w in words)


@query(f"""with h as (select doc_id, {", ".join(f"{_topic_sql(w)} as {k}" for k, w in TOPICS.items())} from documents), b as (select *, greatest({", ".join(TOPICS)}) as best from h)
  select doc_id, case when best = 0 then null {" ".join(f"when {k} = best then '{k}'" for k in TOPICS)} end as topic from b""")
def document_topics(spark, t):
    return t("documents").select("doc_id", V.topic(F.col("text"), TOPICS).alias("topic"))


@query(f"""select item_id, array_to_string(list_sort(list_filter([{", ".join(f"case when {_any(w)} then '{k}' end" for k, w in SOURCES.items())}], lambda x: x is not null)), ',') as types,
  array_to_string(list_filter([case when instr(lower(text), 'plan') > 0 or instr(lower(text), 'on') > 0 then case when not ({_any(("tion", "ment"))}) then 'plan_without_result' end end], lambda x: x is not null), ',') as blocked from benchmark""")
def source_signals(spark, t):
    text = F.col("text")
    return t("benchmark").select("item_id", F.array_join(D.source_types(text, SOURCES), ",").alias("types"), F.array_join(D.disqualifiers(text, F.lit(False), ("plan", "on"), ("tion", "ment")), ",").alias("blocked"))


@query("""with c as (select doc_id, case when instr(lower(text), 'tion') > 0 then 'done' when instr(lower(text), 'the') > 0 then 'rule' else 'other' end as kind, text from (select d.doc_id, d.text from documents d join labels l on d.doc_id = l.doc_id)),
  r as (select doc_id, case when instr(lower(text), 'const') > 0 then 'contradictory' when kind = 'done' then 'primary' when kind = 'rule' then 'supporting' else 'context' end as role from c),
  g as (select doc_id, count(*) as n_facts, case when bool_or(role = 'primary') then 'primary' when bool_or(role = 'supporting') then 'supporting' else 'context' end as role from r group by doc_id)
  select d.doc_id, coalesce(n_facts, 0) as n_facts, coalesce(role, 'not_evidence') as role from documents d left join g on d.doc_id = g.doc_id""")
def document_roles(spark, t):
    low = F.lower("text")
    kind = F.when(F.instr(low, "tion") > 0, "done").when(F.instr(low, "the") > 0, "rule").otherwise("other")
    facts = t("documents").join(t("labels").select("doc_id"), "doc_id").select("doc_id", D.evidence_role(F.col("text"), kind, ("done",), ("rule",), ("const",)).alias("role"))
    return D.document_roles(t("documents"), facts)


@query(f"""with s as (select doc_id, n_chars, case lang when 'en' then 5 when 'fr' then 3 when 'de' then 2 else 0 end as target, {_STAGE_SQL} from documents), g as (select *, {_SAFE_SQL} as safe from s),
  l as (select *, case safe when 'A' then 5 when 'B' then 4 when 'C' then 3 when 'D' then 2 when 'E' then 1 else 0 end as level from g),
  m as (select *, case when target <= 0 then 0.45 when level <= 0 then 0.4 when target = level then 1.0 when target < level then greatest(0.72, 1.0 - (level - target) * 0.07) when target = level + 1 then 0.45 else 0.18 end::double as fit from l),
  x as (select doc_id, target, level, round(round(0.95::double * 30 + least(1.0::double, n_chars / 1000.0::double) * 25 + fit * 25 + 0.35::double * 15 + 0.45::double * 5, 6), 1) as raw from m),
  y as (select doc_id, case when target > 0 and target > level then least(raw, 64.0::double) else raw end as score from x) select doc_id, score, {_STATUS_SQL} as status from y""")
def reasoning_scores(spark, t):
    safe = U.safe_grade(*_stages().values())
    level = F.coalesce(*[F.when(safe == g, i + 1) for i, g in enumerate(U.GRADES)], F.lit(0))
    target = F.when(F.col("lang") == "en", 5).when(F.col("lang") == "fr", 3).when(F.col("lang") == "de", 2).otherwise(0)
    df = t("documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 1000.0).alias("match"), target.alias("target"), level.alias("level"))
    score = U.reasoning_score(F.lit(0.95), F.col("match"), F.col("target"), F.col("level"), F.lit(0.35), F.lit(0.45))
    return df.select("doc_id", score.alias("score")).withColumn("status", U.candidate_status(F.col("score")))


@query(rf"""with p as (select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as folder, lower(regexp_extract({_PATH}, '([^/]*)/?$', 1)) as name from pages),
  b as (select folder, regexp_matches(regexp_replace(name, '\.[^.]*$', ''), '^[0-9]+$') or length(regexp_replace(name, '\.[^.]*$', '')) <= 3 or instr(name, 'copy') > 0 as bad from p)
  select folder, count(*) as n_files, sum(bad::int)::bigint as n_vague, case when sum(bad::int) > 0 then 'curate' when count(*) < 4 then 'partial' else 'filled' end as status from b group by folder""")
def folder_status(spark, t):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    files = t("pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("folder"), F.regexp_extract(path, "([^/]*)/?$", 1).alias("name"))
    return D.folder_status(files, "folder", F.col("name"), ("copy",))


@query("""with y as (select doc_id, source, list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda x: regexp_matches(x, '^(19|20)[0-9]{2}$'))[-1] as year from documents),
  c as (select source, year, count(*) as n, sum(count(*)) over (partition by source) as total from y where year is not null group by source, year),
  d as (select source, year from (select *, row_number() over (partition by source order by n desc, year) as k from c) where k = 1 and n >= 2 and n >= 0.05 * total)
  select doc_id, y.year as own_year, coalesce(y.year, d.year) as resolved, coalesce(cast(coalesce(y.year, d.year) as int) >= 2010, false) as allowed from y left join d on y.source is not distinct from d.source""")
def resolved_periods(spark, t):
    years = t("documents").select("doc_id", "source", T.last_year(F.col("text")).alias("own_year"))
    periods = F.array_compact(F.array("resolved"))
    return R.resolve(years, "source", "own_year", 0.05).select("doc_id", "own_year", "resolved", U.period_allowed(F.lit(2010), periods).alias("allowed"))


@query("""select d.doc_id, coalesce(n_chars >= 200 and toxic = 0, false) as verified from documents d left join labels l on d.doc_id = l.doc_id""")
def second_pass(spark, t):
    first = t("documents").select("doc_id", (F.col("n_chars") >= 200).alias("verified"))
    return U.veto(first, t("labels").select("doc_id", (F.col("toxic") == 0).alias("agrees")), "doc_id")


@query("""with d as (select o_custkey as c_custkey, o_orderstatus as decision, o_orderpriority as p, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders)
  select c.c_custkey, case when p is null then 'none' when (p = '1-URGENT') = (c_mktsegment = 'BUILDING') then 'applied' else 'stale' end as overlay, case when p is not null and (p = '1-URGENT') = (c_mktsegment = 'BUILDING') then decision end as decision
  from customer c left join d on d.c_custkey = c.c_custkey and n = 1""")
def checksum_overlay(spark, t):
    units = t("customer").select("c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("checksum"))
    last = R.latest(t("orders"), ["o_custkey"], F.desc("o_orderkey"))
    decisions = last.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderpriority") == "1-URGENT").alias("checksum"), F.col("o_orderstatus").alias("decision"))
    return U.overlay(units, decisions, "c_custkey").select("c_custkey", "overlay", "decision")


@query("""with m as (select max(l_shipdate) - interval 365 day as as_of from lineitem), j as (select l_orderkey, l_linenumber, case l_returnflag when 'R' then 'running' when 'A' then 'cancel_requested' else 'queued' end as status, l_shipdate from lineitem)
  select l_orderkey, l_linenumber, case when l_shipdate < as_of and status = 'running' then 'queued' when l_shipdate < as_of and status = 'cancel_requested' then 'cancelled' else status end as effective from j, m""")
def lease_recovery(spark, t):
    lines = t("lineitem")
    as_of = lines.agg((F.max("l_shipdate") - F.expr("interval 365 day")).alias("as_of"))  # one row
    jobs = lines.withColumn("status", F.when(F.col("l_returnflag") == "R", "running").when(F.col("l_returnflag") == "A", "cancel_requested").otherwise("queued"))
    return U.leases(jobs.join(F.broadcast(as_of)), "status", "l_shipdate", F.col("as_of")).select("l_orderkey", "l_linenumber", "effective")


@query(r"""with h as (select page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) as host from pages)
  select page_id, starts_with(lower(url), 'https://') and (host in ('example.com', 'example.org') or ends_with(host, '.example.com') or ends_with(host, '.example.org')) as safe from h""")
def url_safety(spark, t):
    return t("pages").select("page_id", T.host_allowed(F.col("url"), ("example.com", "example.org")).alias("safe"))


@query("""select user_id, round(greatest(0, epoch(max(ts)) - epoch(min(ts))), 3) as seconds, count(*) as n from events group by user_id""")
def active_seconds(spark, t):
    span = F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))
    return t("events").groupBy("user_id").agg(F.round(F.greatest(F.lit(0), span) / 1e6, 3).alias("seconds"), F.count("*").alias("n"))


@query(r"""select conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '[0-9]{8,}', '[number]', 'g') as text from conversations""")
def redacted_turns(spark, t):
    return t("conversations").select("conv_id", "turn", T.redacted(F.col("text")).alias("text"))


@query("""select p_partkey, nullif(array_to_string(list_transform(regexp_extract_all(lower(coalesce(p_type, '')), '[a-z0-9]+'), lambda w: upper(w[1]) || w[2:]), ' '), '') as name from part""")
def canonical_names(spark, t):
    return t("part").select("p_partkey", T.title_case(F.col("p_type")).alias("name"))
