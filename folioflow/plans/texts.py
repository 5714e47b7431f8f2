"""Queries over texts, units, layouts and exports, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import layout as Y
from folioflow.functions import nested as N
from folioflow.functions import text as T
from folioflow.operators import documents as D
from folioflow.operators import grading as G
from folioflow.operators import relational as R
from folioflow.operators import rules as U
from folioflow.plans.registry import query
from folioflow.streaming import events as S


@query(r"select p_partkey, 'https://x.example/files/' || array_to_string(list_transform(string_split(p_name || '/' || p_type, '/'), lambda s: url_encode(s)), '/') as link from part")
def public_links(spark, t):
    return t("part").select("p_partkey", T.public_link("https://x.example/files", F.concat_ws("/", "p_name", "p_type")).alias("link"))


@query("select o_orderkey, case when o_orderkey % 5 <> 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') end as iso from orders")
def http_dates(spark, t):
    sent = F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return t("orders").select("o_orderkey", T.http_date(F.when(F.col("o_orderkey") % 5 == 0, F.lit("yesterday")).otherwise(sent)).alias("iso"))


@query(r"select doc_id, length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) as n, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) as digest from documents")
def collapsed_texts(spark, t):
    c = T.collapse(F.col("text"))
    return t("documents").select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c).alias("digest"))


@query(r"""with c as (select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as c from documents) select doc_id, case when length(c) <= 200 then c when regexp_extract(left(c, 200), '^(.*[.!?])(\s|$)', 1) <> '' then regexp_extract(left(c, 200), '^(.*[.!?])(\s|$)', 1) else rtrim(left(c, 200)) end as preview from c""")
def previews(spark, t):
    return t("documents").select("doc_id", T.whole_sentences(F.col("text"), 200).alias("preview"))


@query(r"select doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), lambda x: length(x) >= 2)) as n from documents")
def unicode_words(spark, t):
    return t("documents").select("doc_id", F.size(T.unicode_tokens(F.col("text"))).cast("long").alias("n"))


@query(r"select event_id, lower(event_type) like 'p_r%' as hit from events")
def like_prefix(spark, t):
    return t("events").select("event_id", T.like_prefix(F.col("event_type"), "P_R").alias("hit"))


@query(r"""select page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(url, '^[a-z]+:/', ''), '/'), lambda p: left(trim(regexp_replace(regexp_replace(p, '[\\:*?"<>|\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g')), 118)), lambda p: p not in ('', '.', '..')), '/') as path from pages""")
def safe_paths(spark, t):
    return t("pages").select("page_id", T.safe_path(F.regexp_replace("url", "^[a-z]+:/", "")).alias("path"))


@query(r"""select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as body from conversations""")
def narratives(spark, t):
    """Turns dressed as markup and undressed again."""
    dressed = F.concat(F.lit("## "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n- ")), F.lit(" ```"))
    return t("conversations").select("conv_id", "turn", T.narrative(dressed).alias("body"))


@query("""select event_id, sha256('{"a":[1,{"b":null,"k":' || json_extract_string(props, '$.k') || '}],"z":"' || event_type || '"}') as digest from events""")
def canonical_hashes(spark, t):
    text = F.concat(F.lit('{"z": "'), "event_type", F.lit('", "a": [1, {"k": '), F.get_json_object("props", "$.k"), F.lit(', "b": null}]}'))
    return t("events").select("event_id", N.canonical_hash(text).alias("digest"))


@query("""select event_id, case when event_id % 4 = 0 then 'no json' else '{"files":["/new/' || event_type || '","x/old/y"],"n":1}' end as value from events""")
def json_rewrites(spark, t):
    text = F.concat(F.lit('{"files": ["/old/'), "event_type", F.lit('", "x/old/y"], "n": 1}'))
    return t("events").select("event_id", N.rewritten(F.when(F.col("event_id") % 4 == 0, F.lit("no json")).otherwise(text), "/old/", "/new/").alias("value"))


@query("""select event_id, case when event_id % 3 = 0 then -1 else cast(json_extract_string(props, '$.k') as bigint) end as k from events""")
def json_defaults(spark, t):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{broken"), "props")).otherwise(F.col("props"))
    return t("events").select("event_id", N.decoded(text, "$.k", "long", -1).alias("k"))


@query("""select p_partkey, case when p_size * 100 * p_size * 60 <= 1000000 then 1 else greatest(1, ceil(p_size * 100 / 1000.0::double)) end::int as columns, case when p_size * 100 * p_size * 60 <= 1000000 then 1 else greatest(1, ceil(p_size * 60 / 1000.0::double)) end::int as rows from part""")
def tile_grids(spark, t):
    return t("part").select("p_partkey", Y.tile_grid(F.col("p_size") * 100, F.col("p_size") * 60, 1_000_000).alias("g")).select("p_partkey", "g.columns", "g.rows")


@query("""with b as (select p_partkey, p_size as s, (p_partkey % 10) / 20.0::double as x, (p_partkey % 7) / 14.0::double as y from part)
  select p_partkey, round((s * 10 + x * greatest(1, s * 3)) / 1000.0::double, 6) as x, round((s * 5 + y * greatest(1, s * 2)) / 800.0::double, 6) as y, round(0.5::double * greatest(1, s * 3) / 1000.0::double, 6) as width, round(0.25::double * greatest(1, s * 2) / 800.0::double, 6) as height from b""")
def page_boxes(spark, t):
    s, k = F.col("p_size"), F.col("p_partkey")
    box = F.struct(((k % 10) / 20.0).alias("x"), ((k % 7) / 14.0).alias("y"), F.lit(0.5).alias("width"), F.lit(0.25).alias("height"))
    tile = F.struct((s * 10).alias("left"), (s * 5).alias("top"), (s * 13).alias("right"), (s * 7).alias("bottom"))
    return t("part").select("p_partkey", Y.on_page(box, tile, F.lit(1000.0), F.lit(800.0)).alias("b")).select("p_partkey", "b.*")


@query("""with w as (select o_custkey as page, o_orderkey as ordinal, o_orderpriority as text, case when o_orderstatus = 'P' then -1 else 40 + o_orderkey % 60 end as confidence, o_orderkey % 500 as x, o_orderkey % 90 as y, length(o_orderpriority) * 8 as wd from orders)
  select page, string_agg(text, ' ' order by ordinal) as text, floor(sum(confidence * length(text)) / cast(sum(length(text)) as double) * 100 + 0.500001) / 10000.0::double as confidence, min(x) as "left", min(y) as top, max(x + wd) as "right", max(y + 12) as bottom from w where confidence >= 0 group by page""")
def line_boxes(spark, t):
    k = F.col("o_orderkey")
    words = t("orders").select(
        F.col("o_custkey").alias("page"), k.alias("ordinal"), F.col("o_orderpriority").alias("text"), F.when(F.col("o_orderstatus") == "P", -1).otherwise(40 + k % 60).alias("confidence"),
        (k % 500).alias("left"), (k % 90).alias("top"), (F.length("o_orderpriority") * 8).alias("width"), F.lit(12).alias("height"),
    )
    return Y.lines(words, "page")


@query("""with r as (select n_nationkey as k, n_nationkey % 5 + 1 as c1, n_nationkey % 7 + 25 as c2, n_nationkey % 4 + 1 as r1, n_nationkey % 4 + 3 as r2 from nation),
  c as (select k, unnest(range(c1, c2 + 1)) as c, r1, r2 from r), d as (select k, c, unnest(range(r1, r2 + 1)) as r from c)
  select k, case when c <= 26 then chr(cast(64 + c as int)) else chr(cast(64 + (c - 1) // 26 as int)) || chr(cast(65 + (c - 1) % 26 as int)) end || r as cell from d""")
def range_cells(spark, t):
    k = F.col("n_nationkey")
    letters = F.when(k % 7 + 25 <= 26, F.char(64 + k % 7 + 25)).otherwise(F.concat(F.lit("A"), F.char(64 + k % 7 - 1)))
    ref = F.concat(F.char(65 + k % 5), (k % 4 + 1).cast("string"), F.lit(":"), letters, (k % 4 + 3).cast("string"))
    return t("nation").select(k.alias("k"), F.explode(Y.cells(ref)).alias("cell"))


@query("""with b as (select p_partkey, p_size * 3 as n from part), s as (select p_partkey, n, list_sort(list_distinct(list_concat(list_concat(range(0, least(3, n)), range(greatest(0, n - 3), n)), range(greatest(0, n // 2 - 2), least(n, n // 2 + 2))))) as base from b),
  r as (select *, greatest(0, 20 - len(base)) as room from s), q as (select *, greatest(1, n // greatest(1, room + 1)) as step from r),
  m as (select p_partkey, n, base, list_filter(range(step, n, step), lambda x: not list_contains(base, x))[1:room] as more from q)
  select p_partkey, array_to_string(case when n <= 20 then range(0, n) else list_sort(list_concat(base, more))[1:20] end, ',') as pages from m""")
def page_samples(spark, t):
    return t("part").select("p_partkey", F.array_join(Y.sampled_pages(F.col("p_size") * 3, 20), ",").alias("pages"))




@query(f"""with f as (select page_id, page_id % 5 as k, octet_length(encode(html)) as n from pages where page_id % 11 <> 0 union all select page_id, page_id % 5, 0 from pages where page_id % 11 = 0),
  e as (select page_id, unnest(list_filter([case when n = 0 then 'empty' end, case when n + case k when 0 then 5 when 2 then 4 else 0 end > 3000 and n > 0 then 'too_large' end, case when k = 3 then 'signature_mismatch' end, case when k = 0 and n = 0 then 'signature_mismatch' end,
    case when (n = 0 and k <> 1) or (n > 0 and k in (3, 4)) then 'unknown_kind' end], lambda x: x is not null)) as finding from f),
  g as (select page_id, count(*) as findings, bool_or(finding <> 'unknown_kind') as blocked from e group by page_id)
  select p.page_id, coalesce(findings, 0) as findings, case when coalesce(blocked, false) then 'blocked' when findings > 0 then 'review' else 'accepted' end as route from pages p left join g on p.page_id = g.page_id""")
def intake_routes(spark, t):
    k = F.col("page_id") % 5
    suffix = F.coalesce(*[F.when(k == i, F.lit(s)) for i, s in enumerate((".pdf", ".txt", ".docx", ".png"))], F.lit(".xyz"))
    head = F.when(k == 0, F.lit("%PDF-")).when(k == 2, F.lit("PK\x03\x04")).otherwise(F.lit(""))
    content = F.when(F.col("page_id") % 11 == 0, F.lit("")).otherwise(F.concat(head, F.col("html"))).cast("binary")
    files = t("pages").select("page_id", F.concat(F.col("page_id").cast("string"), suffix).alias("name"), content.alias("content"))
    return D.intake(files, "page_id", 3_000)


@query("""select doc_id, sha256(coalesce(text, '')) as digest, case doc_id % 3 when 0 then 'utf-16' when 1 then 'utf-8' else 'utf-8-sig' end as encoding, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(65533), '')) as n_replaced from documents""")
def decoded_files(spark, t):
    from folioflow.sources.files import decoded_texts

    text = F.coalesce("text", F.lit(""))
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.encode(text, "UTF-16")).when(k == 1, F.encode(text, "UTF-8")).otherwise(F.encode(F.concat(F.lit("﻿"), text), "UTF-8"))
    return decoded_texts(t("documents").select("doc_id", raw.alias("content")), "doc_id").select("doc_id", F.sha2("text", 256).alias("digest"), "encoding", F.col("n_replaced").cast("long").alias("n_replaced"))




@query(r"""with u as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
  s as (select doc_id, i, x, case when trim(x) = '' then 'empty' when i % 17 = 0 then 'ocr_required' when i % 5 = 0 then 'partial' else 'processed' end as status, case when i % 13 = 0 then 'pending_review_or_vision' end as visual, len(regexp_extract_all(x, '[#*$%&|<>]')) >= 4 as template from u)
  select doc_id, count(*) as n_units, sum((status in ('processed', 'partial') and length(x) > 0 and visual is null and not template)::int)::bigint as eligible, sum((status in ('processed', 'partial'))::int)::bigint as checked, sum((status in ('processed', 'partial') and template)::int)::bigint as template_units,
    sum((visual is not null)::int)::bigint as visual_semantics, sum((status = 'ocr_required' and visual is null)::int)::bigint as ocr_rescue,
    coalesce(array_to_string(list_sort(list_distinct(list(case when status = 'ocr_required' then 'ocr_required' when visual is not null then 'visual_pending' end) filter (where status = 'ocr_required' or visual is not null))), ','), '') as block_reasons from s group by doc_id""")
def unit_ledger(spark, t):
    """Lines as units: which may give facts, which are templates, what a person has to look at, and why coverage is blocked."""
    u = t("documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "text")).withColumn("i", F.col("i") + 1)
    i = F.col("i")
    status = F.when(F.length(F.trim("text")) == 0, "empty").when(i % 17 == 0, "ocr_required").when(i % 5 == 0, "partial").otherwise("processed")
    u = u.withColumns({"status": status, "visual": F.when(i % 13 == 0, "pending_review_or_vision"), "template": F.regexp_count("text", F.lit("[#*$%&|<>]")) >= 4})
    return D.unit_ledger(u).withColumn("block_reasons", F.array_join("block_reasons", ","))


@query("""with x as (select doc_id, lower(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as x from documents),
  h as (select doc_id, (contains(x, 'that'))::int + (contains(x, 'dans'))::int + (contains(x, 'nicht'))::int as terms, (regexp_matches(x, '[#*$%]{3,}'))::int + (regexp_matches(x, '_{2,}|\\.{3,}'))::int as marks, contains(x, 'with') or contains(x, 'avec') as activity, regexp_matches(x, '[0-9]{4}') as dated, contains(x, 'click here') as instruct from x)
  select doc_id, terms + marks as score, activity and dated as dated_activity, not (activity and dated) and (terms + marks >= 2 or instruct) as template_only from h""")
def template_detection(spark, t):
    found = D.templates(t("documents"), ("that", "dans", "nicht"), ("[#*$%]{3,}", r"_{2,}|\.{3,}"), ("with", "avec"), ("click here",), "[0-9]{4}")
    return found.select("doc_id", "score", "dated_activity", "template_only")


_FACT_TYPES = {"policy": ("that", "dans", "nicht"), "result": ("was", "sur", "auf"), "review": ("with", "avec", "von")}


@query(r"""with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_replace(x, '^[ \t\r\n•-]+|[ \t\r\n•-]+$', '', 'g')), lambda x: length(x) >= 20) as c from documents),
  b as (select doc_id, list_transform(c, lambda x: case when length(x) <= 700 then x when length(regexp_extract(left(x, 700), '(?s)^(.*)[ \t\r\n]', 1)) >= 20 then regexp_replace(regexp_extract(left(x, 700), '(?s)^(.*)[ \t\r\n]', 1), '[ \t\r\n]+$', '') else left(x, 700) end) as c from s),
  e as (select doc_id, unnest(c) as claim, generate_subscripts(c, 1) as i from b), f as (select *, row_number() over (partition by doc_id, lower(regexp_replace(claim, '[ \t\r\n]+', ' ', 'g')) order by i) as n from e),
  k as (select doc_id, claim from (select *, row_number() over (partition by doc_id order by i) as place from f where n = 1) where place <= 2000),
  w as (select doc_id, regexp_extract_all(lower(claim), '[a-z0-9]+') as w, claim from k),
  h as (select doc_id, list_has_any(w, ['that', 'dans', 'nicht'])::int as p, list_has_any(w, ['was', 'sur', 'auf'])::int as r, list_has_any(w, ['with', 'avec', 'von'])::int as v, list_has_any(w, ['the', 'les', 'der', 'los']) as sub, len(list_distinct(list_filter(w, lambda x: x in ('that', 'dans', 'nicht')))) as np,
    len(list_distinct(list_filter(w, lambda x: x in ('was', 'sur', 'auf')))) as nr, len(list_distinct(list_filter(w, lambda x: x in ('with', 'avec', 'von')))) as nv, list_has_any(w, ['not', 'pas', 'kein']) as against from w),
  g as (select doc_id, case when greatest(np, nr, nv) = 0 then 'unknown' when nv = greatest(np, nr, nv) then 'review' when nr = greatest(np, nr, nv) then 'result' else 'policy' end as t, sub, against from h),
  a as (select doc_id, t as fact_type, case when against then 'contradictory' when t = 'result' then 'primary' when t = 'policy' then 'supporting' else 'context' end as role from g where t <> 'unknown' or sub)
  select fact_type, role, count(*) as n, count(distinct doc_id) as documents from a group by 1, 2""")
def fact_histogram(spark, t):
    """Facts of all documents through eligibility, typing by whole words, the substantive filter and roles."""
    found = D.typed(D.claims(t("documents")), _FACT_TYPES, ("the", "les", "der", "los"))
    role = F.when(F.arrays_overlap("words", G.strings(("not", "pas", "kein"))), "contradictory").when(F.col("fact_type") == "result", "primary").when(F.col("fact_type") == "policy", "supporting").otherwise("context")
    return found.withColumn("role", role).groupBy("fact_type", "role").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query(r"""with c as (select item_id, regexp_extract_all(text, '[A-Z][a-zé]+(?: [a-zé]+)? (?:of|in|on) [a-zé]+') as o from benchmark) select item_id, case when len(o) > 0 then array_to_string(list_transform(regexp_extract_all(lower(o[1]), '[a-z0-9]+'), lambda w: upper(w[1]) || substr(w, 2)), ' ') end as organization from c""")
def organizations(spark, t):
    return t("benchmark").select("item_id", D.organization(F.col("text"), "[A-Z][a-zé]+(?: [a-zé]+)? (?:of|in|on) [a-zé]+").alias("organization"))


@query("""with r as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from conversations), q as (select conv_id, list_distinct(regexp_extract_all(lower(left(text, 80)), '[a-z0-9]+')) as w from conversations where turn = 0),
  m as (select q.conv_id, r.turn, len(list_intersect(q.w, r.w)) as n from q join r on q.conv_id = r.conv_id), k as (select *, row_number() over (partition by conv_id order by n desc, turn) as place from m where n > 0) select conv_id, turn, n as n_common, cast(place as int) as place from k where place <= 20""")
def quote_regions(spark, t):
    """Regions (turns) that share words with a quote (the first turn's start), the nearest 20 of a unit."""
    words = lambda c: G.word_set(c)
    regions = t("conversations").select("conv_id", F.col("turn").alias("region"), words(F.col("text")).alias("words"))
    quotes = t("conversations").where("turn = 0").select("conv_id", words(F.substring("text", 1, 80)).alias("quote"))
    return D.matched_regions(quotes, regions, "conv_id", 20).withColumnRenamed("region", "turn")


_KINDS = ("click", "view", "purchase", "signup", "error")


@query("select " + ", ".join(["count(*) as events", "count(distinct user_id) as users", "round(sum(value), 2) as total", "round(max(value), 2) as most", "min(event_id) as first_id", "max(event_id) as last_id"] + [f"sum((event_type = '{k}')::int)::bigint as n_{k}, count(distinct case when event_type = '{k}' then user_id end) as users_{k}, round(coalesce(sum(case when event_type = '{k}' then value end), 0), 2) as sum_{k}" for k in _KINDS]) + " from events")
def corpus_totals(spark, t):
    """One pass over the table for all totals, 21 of them."""
    of = lambda k: F.col("event_type") == k
    per = [x for k in _KINDS for x in (F.sum(of(k).cast("long")).alias(f"n_{k}"), F.countDistinct(F.when(of(k), F.col("user_id"))).alias(f"users_{k}"), F.round(F.coalesce(F.sum(F.when(of(k), F.col("value"))), F.lit(0.0)), 2).alias(f"sum_{k}"))]
    base = [F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"), F.round(F.max("value"), 2).alias("most"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")]
    return t("events").agg(*base, *per)


@query("""select n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' as line from nation""")
def jsonl_export(spark, t):
    return t("nation").select("n_nationkey", F.to_json(F.struct("n_name", "n_nationkey", "n_regionkey")).alias("line"))


@query("""select n_nationkey, '| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' | ' || n_regionkey || ' |' as line from nation""")
def markdown_rows(spark, t):
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return t("nation").select("n_nationkey", F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in ("n_nationkey", "n_name", "n_regionkey")]), F.lit(" |")).alias("line"))


@query("""select 'orders{status="' || o_orderstatus || '",priority="' || o_orderpriority || '"} ' || count(*)::varchar || '.0' as line from orders group by o_orderstatus, o_orderpriority""")
def prometheus_labels(spark, t):
    df = R.rollup(t("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")), "status", "priority")
    return U.exposition_lines(df, "orders", ["status", "priority"], "n")


@query("""with e as (select *, coalesce(max((event_type = 'purchase')::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as ended from events) select user_id, event_id, event_type from e where ended = 0""")
def tail_until_final(spark, t):
    return S.until_final(t("events"), "user_id", ["event_id"], F.col("event_type") == "purchase").select("user_id", "event_id", "event_type")


@query("""with a as (select 'orders' as k, count(*) as n, sum(o_orderkey)::bigint as s from orders union all select 'part', count(*), sum(p_partkey)::bigint from part union all select 'nation', count(*), sum(n_nationkey)::bigint from nation),
  b as (select 'orders' as k, count(*) as n, sum(o_orderkey)::bigint as s from orders where o_orderkey % 100 <> 0 union all select 'part', count(*), sum(p_partkey)::bigint from part union all select 'region', count(*), sum(r_regionkey)::bigint from region)
  select coalesce(a.k, b.k) as table_name, case when a.k is null then 'extra' when b.k is null then 'missing' when a.n = b.n and a.s = b.s then 'same' else 'changed' end as state from a full join b on a.k = b.k""")
def backup_check(spark, t):
    a = R.manifest({"orders": (t("orders"), "o_orderkey"), "part": (t("part"), "p_partkey"), "nation": (t("nation"), "n_nationkey")})
    b = R.manifest({"orders": (t("orders").where("o_orderkey % 100 <> 0"), "o_orderkey"), "part": (t("part"), "p_partkey"), "region": (t("region"), "r_regionkey")})
    return R.manifest_diff(a, b)


@query("""with l as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, lower(regexp_replace(html, '<[^>]+>', ' ', 'g')) as x from pages),
  h as (select host, bool_or(contains(x, ' that ')) as a, bool_or(contains(x, ' dans ')) as b, bool_or(contains(x, ' nicht ')) as c, count(*) as n from l group by host)
  select host, n, array_to_string(list_filter([case when a then 'policy' end, case when b then 'result' end, case when c then 'review' end], lambda s: s is not null), ',') as stages from h""")
def link_stages(spark, t):
    text = F.lower(F.regexp_replace("html", "<[^>]+>", " "))
    hits = {"policy": " that ", "result": " dans ", "review": " nicht "}
    df = t("pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), *[text.contains(w).alias(k) for k, w in hits.items()])
    df = df.groupBy("host").agg(F.count("*").alias("n"), *[F.bool_or(k).alias(k) for k in hits])
    return df.select("host", "n", F.array_join(F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in hits])), ",").alias("stages"))
