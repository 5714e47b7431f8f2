"""Queries over ledgers, selections, joins and evaluation, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import ledgers as L
from folioflow.operators import relational as R
from folioflow.plans.registry import query

AS_OF = "2024-01-03 00:00:00"


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 7")
def point_lookup(spark, t):
    return L.matching(t("orders"), {"o_orderkey": 7}).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("select o_orderkey from orders where o_orderstatus = 'F'")
def optional_filter(spark, t):
    return L.matching(t("orders"), {"o_orderstatus": "F", "o_orderpriority": None}).select("o_orderkey")


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P') and o_orderpriority = '1-URGENT' order by o_orderkey desc limit 1")
def dynamic_conjunction(spark, t):
    found = L.matching(t("orders"), {"o_orderstatus": ["F", "P"], "o_orderpriority": "1-URGENT", "o_custkey": None})
    return found.orderBy(F.desc("o_orderkey")).limit(1).select("o_orderkey", "o_orderstatus")


@query(r"""with f as (select page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) as host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/?', '') as name from pages)
  select page_id, host, name, strpos(name, '.') = 0 as is_folder, cast(row_number() over (partition by host order by case when strpos(name, '.') = 0 then 0 else 1 end, name, page_id) as int) as place from f""")
def file_listing(spark, t):
    from pyspark.sql import Window

    name = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/?", "")
    f = t("pages").select("page_id", T.url_host(F.col("url")).alias("host"), name.alias("name")).withColumn("is_folder", F.instr("name", ".") == 0)
    return f.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy((~F.col("is_folder")).cast("int"), "name", "page_id")))


@query("""select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus not in ('F', 'P') union all select o_orderkey, o_orderstatus, 0.0::double from orders where o_orderstatus in ('F', 'P') and o_orderkey % 2 = 0""")
def replace_partition(spark, t):
    old = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderstatus in ('F', 'P') and o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(0.0))
    return L.replaced(old, new, ["o_orderstatus"])


@query("""with r as (select *, count(*) over (partition by user_id, event_type) as n, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) select user_id, event_type, event_id, n as n_requests from r where k = 1""")
def idempotent_reservation(spark, t):
    return L.first_by_key(t("events"), ["user_id", "event_type"], F.asc("ts"), F.asc("event_id")).select("user_id", "event_type", "event_id", "n_requests")


@query("""with l as (select user_id, max(event_id) as last, bool_or(event_type = 'purchase' and value > 40) as final from events group by user_id),
  q as (select c_custkey as user_id, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then (select max(event_id) from events e where e.user_id = c_custkey) else -1 end as expected from customer where c_custkey <= 150)
  select q.user_id, case when coalesce(final, false) then 'final' when q.expected is not distinct from last then 'accepted' else 'conflict' end as verdict from q left join l on q.user_id = l.user_id""")
def optimistic_append(spark, t):
    events = t("events")
    last = events.groupBy("user_id").agg(F.max("event_id").alias("last"))
    k = F.col("user_id") % 3
    requests = t("customer").where("c_custkey <= 150").select(F.col("c_custkey").alias("user_id")).join(last, "user_id", "left")
    requests = requests.select("user_id", F.when(k == 0, F.lit(None).cast("long")).when(k == 1, F.col("last")).otherwise(F.lit(-1)).alias("expected"))
    return L.optimistic(events, requests, "user_id", "event_id", (F.col("event_type") == "purchase") & (F.col("value") > 40)).select("user_id", "verdict")


@query("""select event_id, user_id, event_type, event_id = max(event_id) over (partition by user_id, event_type) and value >= 5 as is_active from events""")
def active_scope(spark, t):
    return L.active_scope(t("events"), ["user_id", "event_type"], "event_id", F.col("value") >= 5).select("event_id", "user_id", "event_type", "is_active")


@query("""with s as (select doc_id, md5(lang) as dataset, md5(source) as catalog from documents where doc_id % 2 = 0),
  c as (select doc_id, md5(case when doc_id % 4 = 0 then lang else 'xx' end) as dataset, md5(case when doc_id % 6 = 0 then 'yy' else source end) as catalog from documents where doc_id % 10 <> 0)
  select s.doc_id, case when c.doc_id is null then 'missing' else array_to_string(list_filter([case when s.dataset is distinct from c.dataset then 'dataset' end, case when s.catalog is distinct from c.catalog then 'catalog' end], lambda x: x is not null), ',') end as stale,
    c.doc_id is not null and s.dataset is not distinct from c.dataset and s.catalog is not distinct from c.catalog as is_fresh from s left join c on s.doc_id = c.doc_id""")
def snapshot_freshness(spark, t):
    d, k = t("documents"), F.col("doc_id")
    s = d.where(k % 2 == 0).select("doc_id", F.md5("lang").alias("dataset"), F.md5("source").alias("catalog"))
    c = d.where(k % 10 != 0).select("doc_id", F.md5(F.when(k % 4 == 0, F.col("lang")).otherwise("xx")).alias("dataset"), F.md5(F.when(k % 6 == 0, F.lit("yy")).otherwise(F.col("source"))).alias("catalog"))
    return L.freshness(s, c, "doc_id", ["dataset", "catalog"]).select("doc_id", F.array_join("stale", ",").alias("stale"), "is_fresh")


@query("""select conv_id, turn, turn % 3 <> 1 as reused from conversations""")
def checkpoint_resume(spark, t):
    units = t("conversations").select("conv_id", F.col("turn").alias("unit"), F.sha2("text", 256).alias("checksum"))
    held = units.withColumn("checksum", F.when(F.col("unit") % 3 == 1, "moved on").otherwise(F.col("checksum")))
    return L.resumable(units, held, "conv_id").select("conv_id", F.col("unit").alias("turn"), "reused")


@query("""with a as (select distinct conv_id, turn from conversations), b as (select distinct conv_id, turn from conversations where conv_id % 3 <> 0 or turn <> 1)
  select coalesce(a.conv_id, b.conv_id) as conv_id, count(a.turn) as n_left, count(b.turn) as n_right, count(a.turn) = count(*) and count(b.turn) = count(*) as equal from a full join b on a.conv_id = b.conv_id and a.turn = b.turn group by 1""")
def resume_facts(spark, t):
    c = t("conversations").select("conv_id", "turn")
    return L.same_keys(c, c.where("conv_id % 3 <> 0 or turn <> 1"), "conv_id", "turn")


@query("select doc_id, sha256(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || cast(n_chars as varchar)) as dedupe_key from documents")
def batch_dedupe_key(spark, t):
    return t("documents").select("doc_id", L.dedupe_key(F.col("source"), F.col("lang"), F.col("n_chars")).alias("dedupe_key"))


@query("""with k as (select *, sha256(coalesce(source, '') || '|' || coalesce(lang, '')) as key from documents) select key, min(doc_id) as doc_id, count(*) as n from k group by key""")
def active_job_dedupe(spark, t):
    keyed = t("documents").withColumn("key", L.dedupe_key(F.col("source"), F.col("lang")))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(f"""with j as (select event_id, case event_type when 'view' then 'queued' when 'click' then 'running' else 'done' end as status, ts + interval 30 minute as until, cast(floor(value) as int) % 4 as attempts from events),
  a as (select *, case when (status = 'queued' or (status = 'running' and until <= timestamp '{AS_OF}')) and attempts < 3 then 'claim' when status = 'running' and until <= timestamp '{AS_OF}' then 'fail' when status = 'running' then 'renew' else 'none' end as action from j)
  select event_id, action, case when action in ('claim', 'renew') then timestamp '{AS_OF}' + interval 10 minute else until end as lease_until from a""")
def lease_claims(spark, t):
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").otherwise("done")
    jobs = t("events").select("event_id", status.alias("status"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("until"), (F.floor("value").cast("int") % 4).alias("attempts"))
    as_of = F.lit(AS_OF).cast(dict(jobs.dtypes)["until"])
    return L.claims(jobs, "status", "until", as_of, 10, 3).select("event_id", "action", "lease_until")


@query("""with d as (select doc_id, lang, n_chars, sha256(text) as digest, coalesce(l.quality, 2) as q, coalesce(l.toxic, 0) as x from documents left join labels l using (doc_id)),
  o as (select *, row_number() over (partition by lang, digest order by q, x desc, n_chars desc, doc_id) as k from d), u as (select * from o where k = 1),
  e as (select *, row_number() over (order by q, x desc, n_chars desc, doc_id) as r from u where lang = 'en'), te as (select * from e where r <= 20),
  f as (select *, row_number() over (order by q, x desc, n_chars desc, doc_id) as r from u where lang = 'fr' and digest not in (select digest from te)), tf as (select * from f where r <= 18),
  g as (select *, row_number() over (order by q, x desc, n_chars desc, doc_id) as r from u where lang = 'de' and digest not in (select digest from te union all select digest from tf)), tg as (select * from g where r <= 6),
  h as (select *, row_number() over (order by q, x desc, n_chars desc, doc_id) as r from u where lang = 'es' and digest not in (select digest from te union all select digest from tf union all select digest from tg)), th as (select * from h where r <= 6),
  t as (select *, 0 as s from te union all select *, 1 from tf union all select *, 2 from tg union all select *, 3 from th),
  b as (select *, row_number() over (partition by digest order by q, x desc, n_chars desc, doc_id) as kk from u where digest not in (select digest from t)),
  w as (select doc_id, lang, q, x, n_chars, false as backfill, s from t union all select doc_id, lang, q, x, n_chars, true, 0 from b where kk = 1),
  p as (select *, row_number() over (order by backfill, s, q, x desc, n_chars desc, doc_id) as place from w)
  select doc_id, lang, backfill, cast(place as int) as place from p where place <= 60""")
def priority_queue(spark, t):
    d = t("documents").join(t("labels"), "doc_id", "left").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("digest"), F.coalesce("quality", F.lit(2)).alias("q"), F.coalesce("toxic", F.lit(0)).alias("x"))
    found = L.quota_order(d, "lang", {"en": 20, "fr": 18, "de": 6, "es": 6}, 60, "digest", F.asc("q"), F.desc("x"), F.desc("n_chars"), F.asc("doc_id"))
    return found.select("doc_id", "lang", "backfill", "place")


_SHARES = R.largest_remainder({"en": 40, "fr": 36, "de": 12, "es": 12}, 77)


@query(f"""with r as (select doc_id, lang, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id) as n from documents),
  q as (select *, n > case lang {' '.join(f"when '{k}' then {v}" for k, v in _SHARES.items())} else 0 end as backfill from r)
  select doc_id, lang, n_chars, backfill from q order by backfill, n_chars desc, doc_id limit 77""")
def remainder_sample(spark, t):
    return R.quotas(t("documents").select("doc_id", "lang", "n_chars"), "lang", _SHARES, 77, F.desc("n_chars"), F.asc("doc_id"))


@query("""with r as (select *, row_number() over (partition by lang order by n_chars desc, doc_id) as k from documents where lang is not null) select lang, doc_id, n_chars from r where k = 1""")
def acceptance_sample(spark, t):
    return R.latest(t("documents").where("lang is not null"), ["lang"], F.desc("n_chars"), F.asc("doc_id")).select("lang", "doc_id", "n_chars")


@query("""select doc_id, array_to_string(list_sort(list_filter([case when not coalesce(length(trim(text)) > 0, false) then 'text' end, case when not coalesce(lang in ('en', 'fr', 'de', 'es'), false) then 'lang' end,
    case when not coalesce(n_chars between 40 and 100000, false) then 'size' end, case when count(*) over (partition by sha256(text)) > 1 then 'duplicate:digest' end], lambda x: x is not null)), ',') as violations from documents
  qualify violations <> ''""")
def manifest_validation(spark, t):
    d = t("documents").withColumn("digest", F.sha2("text", 256))
    checks = {"text": F.length(F.trim("text")) > 0, "lang": F.col("lang").isin("en", "fr", "de", "es"), "size": F.col("n_chars").between(40, 100_000)}
    return L.violations(d, "doc_id", checks, ["digest"]).withColumn("violations", F.array_join("violations", ","))


@query("""select doc_id, array_to_string(list_sort(list_filter([case when not coalesce(quality in (0, 1), false) then 'quality' end, case when toxic = 1 and quality = 1 then 'conflict' end, case when count(*) over (partition by doc_id) > 1 then 'duplicate:doc_id' end], lambda x: x is not null)), ',') as violations
  from labels qualify violations <> ''""")
def gold_validation(spark, t):
    checks = {"quality": F.col("quality").isin(0, 1), "conflict": ~((F.col("toxic") == 1) & (F.col("quality") == 1))}
    return L.violations(t("labels"), "doc_id", checks, ["doc_id"]).withColumn("violations", F.array_join("violations", ","))


_RATIO = "case when {b} = 0 then 0 else round({a} / cast({b} as double), 6) end"
_RATIOS = {
    "recall_at_5": ("hits", "positives"), "source_accuracy": ("matched_sources", "expected_sources"), "grade_label_coverage": ("graded", "positives"), "grade_assessment_coverage": ("assessed", "graded"),
    "false_positive_rate": ("false_positives", "negatives"), "precision_at_5": ("relevant", "shown"), "role_accuracy": ("matched_roles", "roles"), "role_coverage": ("roles", "cases"),
    "abstention_accuracy": ("(negatives - false_positives)", "negatives"), "latency_coverage": ("timed", "cases"), "cost_coverage": ("priced", "cases"), "template_accuracy": ("matched_templates", "templates"),
    "template_recall": ("matched_template_only", "template_only"), "template_coverage": ("templates", "cases"),
}
_CASES = """c as (select o_orderkey % 4 as n_expected, o_orderkey % 6 as n_shown, least(o_orderkey % 4, o_orderkey % 6) as n_relevant, o_orderkey % 3 as n_sources, case when o_orderkey % 2 = 0 then o_orderkey % 3 else 0 end as n_found,
    case when o_orderkey % 5 > 0 then o_orderkey % 5 end as eg, case when o_orderkey % 7 > 1 then o_custkey % 5 end as pg, case when o_orderkey % 3 > 0 then 'primary' end as er, case when o_custkey % 2 = 0 then 'primary' else 'context' end as pr,
    case o_orderkey % 4 when 0 then 'template_only' when 1 then 'substantive' end as et, case when o_custkey % 3 = 0 then 'template_only' else 'substantive' end as pt, case when o_orderkey % 9 > 0 then o_totalprice / 1000 - 1 end as latency, case when o_orderkey % 10 > 2 then o_totalprice / 100000 end as cost from orders),
  a as (select count(*) as cases, sum((n_expected > 0)::int)::bigint as positives, sum((n_expected = 0)::int)::bigint as negatives, sum((n_expected > 0 and n_relevant > 0)::int)::bigint as hits, sum(n_sources)::bigint as expected_sources, sum(n_found)::bigint as matched_sources,
    sum((n_expected > 0 and eg is not null)::int)::bigint as graded, sum((n_expected > 0 and eg is not null and pg is not null)::int)::bigint as assessed, sum(coalesce(n_expected > 0 and eg is not null and pg > eg, false)::int)::bigint as overgraded,
    sum((n_expected = 0 and n_shown > 0)::int)::bigint as false_positives, sum(n_shown)::bigint as shown, sum(n_relevant)::bigint as relevant, count(er) as roles, sum(coalesce(er = pr, false)::int)::bigint as matched_roles, count(et) as templates, sum(coalesce(et = pt, false)::int)::bigint as matched_templates,
    sum(coalesce(et = 'template_only', false)::int)::bigint as template_only, sum(coalesce(et = 'template_only' and pt = et, false)::int)::bigint as matched_template_only, count(latency) as timed, count(cost) as priced,
    round(avg(greatest(latency, 0)), 4) as average_latency, round(avg(greatest(cost, 0)), 4) as average_cost from c)"""


def _report(t):
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    cases = t("orders").select(
        (k % 4).alias("n_expected"), (k % 6).alias("n_shown"), F.least(k % 4, k % 6).alias("n_relevant"), (k % 3).alias("n_sources"), F.when(k % 2 == 0, k % 3).otherwise(0).alias("n_found_sources"),
        F.when(k % 5 > 0, k % 5).alias("expected_grade"), F.when(k % 7 > 1, u % 5).alias("predicted_grade"), F.when(k % 3 > 0, "primary").alias("expected_role"), F.when(u % 2 == 0, "primary").otherwise("context").alias("predicted_role"),
        F.when(k % 4 == 0, "template_only").when(k % 4 == 1, "substantive").alias("expected_template"), F.when(u % 3 == 0, "template_only").otherwise("substantive").alias("predicted_template"),
        F.when(k % 9 > 0, F.col("o_totalprice") / 1000 - 1).alias("latency"), F.when(k % 10 > 2, F.col("o_totalprice") / 100_000).alias("cost"),
    )
    return L.gold_report(cases)


@query(f"with {_CASES} select *, case when assessed = 0 then 1 else round(overgraded / cast(assessed as double), 6) end as overgrade_rate, " + ", ".join(f"{_RATIO.format(a=a, b=b)} as {k}" for k, (a, b) in _RATIOS.items()) + " from a")
def gold_report(spark, t):
    return _report(t).withColumns({c: F.round(c, 4) for c in ("average_latency", "average_cost")})


@query(f"""with {_CASES}, m as (select *, {_RATIO.format(a='hits', b='positives')} as recall, {_RATIO.format(a='matched_sources', b='expected_sources')} as accuracy, round(overgraded / cast(assessed as double), 6) as over from a)
  select array_to_string(list_filter([case when recall < 0.95 then 'recall_at_5<0.95' end, case when accuracy < 0.95 then 'source_accuracy<0.95' end, case when cases < 50 then 'cases<50' end, case when over > 0.02 then 'overgrade_rate>0.02' end], lambda x: x is not null), ',') as blockers,
    recall >= 0.95 and accuracy >= 0.95 and cases >= 50 and over <= 0.02 as ready from m""")
def promotion_gates(spark, t):
    found = L.readiness(_report(t), {"recall_at_5": 0.95, "source_accuracy": 0.95, "cases": 50}, {"overgrade_rate": 0.02})
    return found.select(F.array_join("blockers", ",").alias("blockers"), "ready")


@query("""select e.event_id, c.c_custkey, c.c_mktsegment from events e join customer c on e.user_id = c.c_custkey and e.event_type = case c.c_nationkey % 2 when 0 then 'click' else 'view' end""")
def two_key_join(spark, t):
    c = t("customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_nationkey") % 2 == 0, "click").otherwise("view").alias("kind"))
    return t("events").join(c, (F.col("user_id") == F.col("c_custkey")) & (F.col("event_type") == F.col("kind"))).select("event_id", "c_custkey", "c_mktsegment")


@query("""select l.l_orderkey, l.l_linenumber, o.o_custkey, l.l_partkey from lineitem l join orders o on l.l_orderkey = o.o_orderkey where o.o_orderstatus = 'P' and l.l_returnflag = 'R'""")
def event_action_join(spark, t):
    o = t("orders").where("o_orderstatus = 'P'")
    return t("lineitem").where("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "l_partkey")


_NAME = r"trim(regexp_replace(regexp_replace(lower({}), '\.[a-z0-9]{{1,5}}$', ''), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""with p as (select p_partkey, {_NAME.format('p_name')} as n from part), q as (select n, count(*) as c, min(p_partkey) as first_id from p group by n having count(*) > 1)
  select p_partkey, first_id, c - 1 as n_others from p join q on p.n = q.n where p.n <> ''""")
def live_duplicates(spark, t):
    named = t("part").withColumn("n", T.normal_name(F.col("p_name"))).where("n <> ''")
    return R.copies(named, F.col("n"), "p_partkey")


@query("""select distinct r_name, n_name, c_mktsegment from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' and c_acctbal > 0""")
def catalog_cascade(spark, t):
    nations = L.matching(t("region"), {"r_name": "ASIA"}).join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return t("customer").where("c_acctbal > 0").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "c_mktsegment").distinct()


@query("""with g as (select unnest(['A', 'B', 'C', 'D', 'E']) as grade), s as (select n_nationkey, n_regionkey from nation)
  select n_nationkey, grade, count(c_custkey) as slots from s cross join g left join customer on c_nationkey = n_nationkey and substr('ABCDE', cast(c_custkey % 5 + 1 as int), 1) = grade group by n_nationkey, grade""")
def seed_slots(spark, t):
    """Nations by the five grades with their filled slots: a nation explodes into five rows, which meet customers on both keys."""
    from folioflow.operators.grading import strings

    seeds = t("nation").select("n_nationkey", F.explode(strings(list("ABCDE"))).alias("grade"))
    filled = t("customer").groupBy(F.col("c_nationkey").cast("long").alias("n_nationkey"), F.substring(F.lit("ABCDE"), (F.col("c_custkey") % 5 + 1).cast("int"), F.lit(1)).alias("grade")).agg(F.count("*").alias("slots"))
    return seeds.join(filled, ["n_nationkey", "grade"], "left").select("n_nationkey", "grade", F.coalesce("slots", F.lit(0)).alias("slots"))


@query("select backend, n, bytes from (select l_linestatus as backend, count(*) as n, sum(l_quantity)::bigint as bytes from lineitem group by l_linestatus)")
def backend_bytes(spark, t):
    return t("lineitem").groupBy(F.col("l_linestatus").alias("backend")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("bytes"))


@query("""with j as (select user_id, count(*) as attempts, count(distinct event_type) as kinds from events group by user_id)
  select sum((attempts > 1)::int)::bigint as retried, sum(attempts - 1)::bigint as extra_attempts, sum((kinds > 1)::int)::bigint as lineage, sum((attempts >= 3 and kinds < 5)::int)::bigint as loops from j""")
def recovery_counters(spark, t):
    j = t("events").groupBy("user_id").agg(F.count("*").alias("attempts"), F.countDistinct("event_type").alias("kinds"))
    n = lambda c: F.sum(c.cast("long"))
    return j.agg(n(F.col("attempts") > 1).alias("retried"), F.sum(F.col("attempts") - 1).alias("extra_attempts"), n(F.col("kinds") > 1).alias("lineage"), n((F.col("attempts") >= 3) & (F.col("kinds") < 5)).alias("loops"))


@query("""with p as (select event_type, try_cast(json_extract_string(props, '$.k') as int) as k, value from events)
  select event_type as phase, count(*) as total, sum((k >= 50)::int)::bigint as selected, round(avg(k / 100.0::double), 6) as complexity, round(avg(value), 4) as risk, max(k) as most from p group by event_type""")
def phase_metrics(spark, t):
    p = t("events").select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"), "value")
    return p.groupBy(F.col("event_type").alias("phase")).agg(
        F.count("*").alias("total"), F.sum((F.col("k") >= 50).cast("long")).alias("selected"), F.round(F.avg(F.col("k") / 100.0), 6).alias("complexity"), F.round(F.avg("value"), 4).alias("risk"), F.max("k").alias("most")
    )


@query("""select user_id, sum(greatest(value - 10, 0)) filter (where event_type = 'purchase') is not null as priced, round(coalesce(sum(greatest(value - 10, 0)) filter (where event_type = 'purchase'), 0), 4) as cost, sum(greatest(cast(json_extract_string(props, '$.k') as int), 0))::bigint as tokens from events group by user_id""")
def run_costs(spark, t):
    cost = F.sum(F.when(F.col("event_type") == "purchase", F.greatest(F.col("value") - 10, F.lit(0.0))))
    tokens = F.sum(F.greatest(F.get_json_object("props", "$.k").cast("long"), F.lit(0)))
    return t("events").groupBy("user_id").agg(cost.isNotNull().alias("priced"), F.round(F.coalesce(cost, F.lit(0.0)), 4).alias("cost"), tokens.alias("tokens"))


@query("""with r as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey desc) as k from orders where o_orderstatus <> 'P')
  select c_custkey, case when o_orderstatus = 'F' then 'template_only' when o_orderstatus = 'O' then 'substantive' else 'not_assessed' end as template_status from customer left join r on c_custkey = o_custkey and k = 1""")
def template_status(spark, t):
    last = R.latest(t("orders").where("o_orderstatus <> 'P'"), ["o_custkey"], F.desc("o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "template_only").when(F.col("o_orderstatus") == "O", "substantive").otherwise("not_assessed")
    return t("customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", status.alias("template_status"))


@query("""with a as (select user_id, list_sort(list_distinct(list(event_type))) as legacy from events where event_id % 2 = 0 group by user_id), b as (select user_id, list_sort(list_distinct(list(event_type))) as fresh from events where event_id % 3 = 0 group by user_id)
  select coalesce(a.user_id, b.user_id) as user_id, case when legacy is null or fresh is null then 'tracking' when legacy = fresh then 'agreed' else 'diverged' end as state,
    len(list_intersect(coalesce(legacy, []), coalesce(fresh, []))) as n_both from a full join b on a.user_id = b.user_id""")
def shadow_lifecycle(spark, t):
    side = lambda m, name: t("events").where(F.col("event_id") % m == 0).groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias(name))
    both = side(2, "legacy").join(side(3, "fresh"), "user_id", "full")
    state = F.when(F.col("legacy").isNull() | F.col("fresh").isNull(), "tracking").when(F.col("legacy") == F.col("fresh"), "agreed").otherwise("diverged")
    none = F.array().cast("array<string>")
    return both.select("user_id", state.alias("state"), F.size(F.array_intersect(F.coalesce("legacy", none), F.coalesce("fresh", none))).cast("long").alias("n_both"))


@query("""with c as (select o_custkey % 20 as cycle, o_orderkey as id, o_orderstatus as status, md5(cast(o_orderkey as varchar)) as stored, md5(cast(case when o_orderkey % 9 = 0 then -1 else o_orderkey end as varchar)) as recomputed from orders),
  l as (select *, row_number() over (partition by cycle order by id desc) as k from c) select cycle, id, status = 'F' and stored = recomputed as stable from l where k = 1""")
def release_evidence(spark, t):
    k = F.col("o_orderkey")
    sums = t("orders").select((F.col("o_custkey") % 20).alias("cycle"), k.alias("id"), F.col("o_orderstatus").alias("status"), F.md5(k.cast("string")).alias("stored"), F.md5(F.when(k % 9 == 0, F.lit(-1)).otherwise(k).cast("string")).alias("recomputed"))
    return R.latest(sums, ["cycle"], F.desc("id")).select("cycle", "id", ((F.col("status") == "F") & (F.col("stored") == F.col("recomputed"))).alias("stable"))


@query(f"""with d as (select event_type as scope, bool_or(value > 2 and ts > timestamp '{AS_OF}') as allowed from events where user_id % 2 = 0 group by event_type), p as (select event_type as scope, bool_and(value >= 0) and count(*) >= 3 as passed from events where user_id % 2 = 1 group by event_type)
  select coalesce(d.scope, p.scope) as scope, coalesce(allowed, false) and coalesce(passed, false) as enabled from d full join p on d.scope = p.scope""")
def vision_governance(spark, t):
    e = t("events")
    live = (F.col("value") > 2) & (F.col("ts") > F.lit(AS_OF).cast(dict(e.dtypes)["ts"]))
    d = e.where("user_id % 2 = 0").groupBy(F.col("event_type").alias("scope")).agg(F.bool_or(live).alias("allowed"))
    p = e.where("user_id % 2 = 1").groupBy(F.col("event_type").alias("scope")).agg((F.bool_and(F.col("value") >= 0) & (F.count("*") >= 3)).alias("passed"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return d.join(p, "scope", "full").select("scope", (yes("allowed") & yes("passed")).alias("enabled"))


@query("""with r as (select lower(case when event_id % 2 = 0 then upper('U' || user_id) else 'u' || user_id end) as reviewer, event_type, ts, event_id, user_id % 40 as item from events where event_type in ('view', 'click', 'error')),
  l as (select *, row_number() over (partition by item, reviewer order by ts desc, event_id desc) as k from r),
  c as (select item, count(*) as reviewers, sum((event_type = 'view')::int)::bigint as yes, sum((event_type = 'click')::int)::bigint as no from l where k = 1 group by item)
  select item, reviewers, yes, no, case when yes > 0 and no > 0 then 'conflict' when greatest(yes, no) >= 2 then 'resolved' else 'pending' end as verdict from c""")
def consensus_verdict(spark, t):
    name = F.concat(F.lit("U"), F.col("user_id"))
    r = t("events").where("event_type in ('view', 'click', 'error')").select(F.lower(F.when(F.col("event_id") % 2 == 0, name).otherwise(F.lower(name))).alias("reviewer"), "event_type", "ts", "event_id", (F.col("user_id") % 40).alias("item"))
    n = lambda kind: F.sum((F.col("event_type") == kind).cast("long"))
    c = R.latest(r, ["item", "reviewer"], F.desc("ts"), F.desc("event_id")).groupBy("item").agg(F.count("*").alias("reviewers"), n("view").alias("yes"), n("click").alias("no"))
    verdict = F.when((F.col("yes") > 0) & (F.col("no") > 0), "conflict").when(F.greatest("yes", "no") >= 2, "resolved").otherwise("pending")
    return c.withColumn("verdict", verdict)


@query("""with v as (select user_id, event_type, event_id, value, lag(event_id) over (partition by user_id, event_type order by event_id) as previous from events), c as (select user_id, event_type, max(event_id) as current_id, count(*) as n_events, sum((previous is null)::int)::bigint as firsts from v group by user_id, event_type)
  select * from c""")
def approval_ledger(spark, t):
    linked = R.versions(t("events"), ["user_id", "event_type"], "event_id")
    return linked.groupBy("user_id", "event_type").agg(F.max("event_id").alias("current_id"), F.count("*").alias("n_events"), F.sum(F.col("supersedes").isNull().cast("long")).alias("firsts"))
