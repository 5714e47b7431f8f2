"""Queries of joins, keys, orders, verdicts and classifications, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import documents as D
from folioflow.operators import grading as G
from folioflow.operators import relational as R
from folioflow.operators import rules as U
from folioflow.plans.registry import query
from folioflow.sources import catalogs


@query("""with r as (select conv_id, turn, case when turn % 3 = 1 then null else turn % 4 end as rag_rank, length(text) as score from conversations)
  select conv_id, turn, cast(row_number() over (partition by conv_id order by rag_rank nulls last, score desc, turn) as int) as place from r""")
def nulls_last_order(spark, t):
    r = t("conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 1, F.col("turn") % 4).alias("rag_rank"), F.length("text").alias("score"))
    return r.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("rag_rank"), F.desc("score"), "turn")).alias("place"))


@query("""select e.event_id, e.user_id, c.c_mktsegment from events e join customer c on e.user_id = c.c_custkey
  where c.c_acctbal > 0 and md5(e.event_type) = md5(case c.c_nationkey % 3 when 0 then 'view' when 1 then 'click' else 'stale' end)""")
def snapshot_join(spark, t):
    """Terms (events) with the active snapshot (customer) whose catalog checksum is theirs."""
    active = t("customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment", F.md5(F.when(F.col("c_nationkey") % 3 == 0, "view").when(F.col("c_nationkey") % 3 == 1, "click").otherwise("stale")).alias("checksum"))
    terms = t("events").select("event_id", "user_id", F.md5("event_type").alias("checksum"))
    return terms.join(active, (F.col("user_id") == F.col("c_custkey")) & (terms["checksum"] == active["checksum"])).select("event_id", "user_id", "c_mktsegment")


@query("""select o.o_custkey % 25 as package, o.o_orderkey, c.c_name, o.o_orderstatus from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey where n.n_regionkey < 3""")
def package_members(spark, t):
    members = t("orders").select((F.col("o_custkey") % 25).alias("package"), "o_orderkey", "o_custkey", "o_orderstatus")
    near = t("nation").where("n_regionkey < 3").select("n_nationkey")
    runs = t("customer").join(near, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return members.join(runs, F.col("o_custkey") == F.col("c_custkey")).select("package", "o_orderkey", "c_name", "o_orderstatus")


@query("""with v as (select event_type, cast(json_extract_string(props, '$.k') as int) as k, value from events)
  select event_type, cast(k // 20 as int) as reason, count(*) as n, round(sum(value), 2) as seconds from v group by 1, 2""")
def resource_rollup(spark, t):
    """Sums and a histogram over the values of a map column."""
    v = t("events").select("event_type", "value", F.explode(F.map_values(F.from_json("props", "map<string,int>"))).alias("k"))
    return v.groupBy("event_type", F.floor(F.col("k") / 20).cast("int").alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("seconds"))


@query("""with q as (select doc_id, case when doc_id % 3 = 0 then lower(substr(text, 5, 30)) when doc_id % 3 = 1 then substr(text, 5, 30) else 'nowhere to be found' end as quote from documents)
  select q.doc_id, md5(quote) as quote from q join documents d on q.doc_id = d.doc_id where trim(quote) <> '' and instr(lower(d.text), lower(quote)) > 0""")
def accepted_facts(spark, t):
    """A model's facts stay only if their quote, case aside, is in the document."""
    k, part = F.col("doc_id") % 3, F.substring("text", 5, 30)
    facts = t("documents").select("doc_id", F.when(k == 0, F.lower(part)).when(k == 1, part).otherwise("nowhere to be found").alias("quote"))
    return D.accepted(facts, t("documents")).select("doc_id", F.md5("quote").alias("quote"))


@query("select l_orderkey, l_linenumber, l_orderkey || ':' || l_partkey || ':' || l_suppkey as mapping_key, l_orderkey || ':' || l_partkey as short_key from lineitem")
def composed_keys(spark, t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey").alias("mapping_key"), F.concat_ws(":", "l_orderkey", "l_partkey").alias("short_key"))


@query("""select doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) > 2 and x not in ('with', 'from', 'this', 'that', 'les', 'des', 'ein', 'eine'))) as n from documents""")
def earlier_tokens(spark, t):
    words = T.tokens(F.col("text"), 3, ("with", "from", "this", "that", "les", "des", "ein", "eine"))
    return t("documents").select("doc_id", F.size(words).cast("long").alias("n"))


@query("""select p_partkey, md5(concat_ws(' ', p_name, p_brand, p_type, cast(p_size as varchar), case when p_partkey % 4 <> 0 then p_brand end)) as corpus from part""")
def assembled_corpus(spark, t):
    fields = [F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand"))]
    return t("part").select("p_partkey", F.md5(T.assembled(*fields)).alias("corpus"))


@query("""with d as (select doc_id, sha256(text) as digest, left(text, 40) as name, n_chars from documents)
  select doc_id, case when count(*) over (partition by digest) > 1 then 'exact' when count(*) over (partition by name, n_chars) > 1 then 'high' when count(*) over (partition by name) > 1 then 'possible' else 'clear' end as verdict from d""")
def duplicate_verdicts(spark, t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.substring("text", 1, 40).alias("name"), "n_chars")
    return R.duplicate_verdicts(d, "doc_id", "digest", "name", "n_chars")


@query("""with u as (select page_id, case page_id % 6 when 0 then '10.1.2.' || page_id % 250 when 1 then '192.168.0.9' when 2 then '8.8.4.' || page_id % 250 when 3 then 'localhost' when 4 then '172.20.1.1' else lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) end as host from pages)
  select page_id, page_id % 6 in (2, 5) and host <> '' as is_public from u""")
def public_hosts(spark, t):
    k = F.col("page_id") % 6
    tail = (F.col("page_id") % 250).cast("string")
    host = F.when(k == 0, F.concat(F.lit("10.1.2."), tail)).when(k == 1, "192.168.0.9").when(k == 2, F.concat(F.lit("8.8.4."), tail)).when(k == 3, "localhost").when(k == 4, "172.20.1.1").otherwise(T.url_host(F.col("url")))
    return t("pages").select("page_id", T.public_host(host).alias("is_public"))


_CONTEXTS = {"english": ("that", "with", "from"), "french": ("dans", "avec", "pour"), "german": ("nicht", "von", "auf")}


def _hits(words):
    return "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda x: list_contains(w, x)))"


@query(f"""with d as (select doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents),
  h as (select doc_id, {', '.join(f'{_hits(w)} as {k}' for k, w in _CONTEXTS.items())}, regexp_matches(text, '[A-Z][a-z]+ [0-9]+|[0-9]{{3,}}') as formal, list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: regexp_matches(x, '^(19|20)[0-9]{{2}}$'))[-1] as period, w from d),
  g as (select *, greatest(english, french, german) as best from h)
  select doc_id, case when best = 0 then null when english = best then 'english' when french = best then 'french' else 'german' end as context, best as hits, list_has_any(w, ['this', 'avec', 'von', 'con', 'pour']) as shared, coalesce(formal, false) as formal, period from g""")
def context_classification(spark, t):
    """The best context by whole words (the first named in a tie), its hits, a stage, formality and period of each document."""
    words = G.word_set(F.col("text"))
    formal = F.coalesce(F.col("text").rlike("[A-Z][a-z]+ [0-9]+|[0-9]{3,}"), F.lit(False))
    df = t("documents").select("doc_id", words.alias("w"), formal.alias("formal"), T.last_year(F.col("text")).alias("period"))
    hits = lambda own: F.size(F.array_intersect("w", G.strings(own))).cast("long")
    best = F.array_max(F.array(*[F.struct(hits(own).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, own) in enumerate(_CONTEXTS.items())]))
    shared = F.arrays_overlap("w", G.strings(("this", "avec", "von", "con", "pour")))
    return df.withColumn("b", best).select("doc_id", F.when(F.col("b.n") > 0, F.col("b.name")).alias("context"), F.col("b.n").alias("hits"), shared.alias("shared"), "formal", "period")


@query("""with s as (select o_custkey as k, o_orderkey as n, case when o_totalprice > 300000 then 'primary' when o_totalprice > 200000 then 'supporting' else 'review' end as status, o_orderstatus = 'P' as blocked from orders)
  select k, n, case when status = 'primary' and bool_or(blocked) over (partition by k) then 'review' when status = 'supporting' and bool_or(blocked) over (partition by k) then 'review' else status end as status from s""")
def evidence_gate(spark, t):
    price = F.col("o_totalprice")
    s = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("n"), F.when(price > 300_000, "primary").when(price > 200_000, "supporting").otherwise("review").alias("status"), (F.col("o_orderstatus") == "P").alias("blocked"))
    return U.gated(s, "k", F.col("blocked")).select("k", "n", "status")


@query("""select r_name as kk, n_name as parameter, unnest(['A', 'B', 'C']) as grade from nation join region on n_regionkey = r_regionkey""")
def nested_catalog(spark, t):
    """Regions as nested JSON, exploded twice into catalog rows."""
    one = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    grades = F.from_json(F.lit('["A","B","C"]'), "array<string>")
    nested = one.groupBy(F.col("r_name").alias("kk")).agg(F.collect_list(F.struct(F.col("n_name").alias("name"), grades.alias("grades"))).alias("parameters"))
    text = nested.select(F.to_json(F.struct("kk", "parameters")).alias("value"))
    return catalogs.exploded(catalogs.parsed(text, "value"))


@query("""with n as (select n_name as parameter from nation where n_nationkey % 4 <> 0) select r_name as kk, n_name as parameter from nation join region on n_regionkey = r_regionkey where n_name not in (select parameter from n)""")
def removed_parameters(spark, t):
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("kk"), F.col("n_name").alias("parameter"))
    kept = rows.join(t("nation").where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("parameter")), "parameter", "left_semi")
    return R.removed(rows, kept, ["kk", "parameter"])
