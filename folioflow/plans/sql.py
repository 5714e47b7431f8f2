"""SQL of the lexical scores, shared by oracles."""

from __future__ import annotations

from folioflow.functions import text as T

STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) >= 2 and not list_contains({STOP}, x))"
POSTINGS = f"""dp as (select id, token, count(*) as tf from (select doc_id as id, unnest({TOKENS}) as token from documents) group by id, token),
  cp as (select id, token, count(*) as tf from (select item_id as id, unnest({TOKENS}) as token from benchmark) group by id, token),
  tot as (select count(distinct id) as n, sum(tf) / cast(count(distinct id) as double) as avgdl from cp),
  st as (select token, count(*) as df, any_value(n) as n, any_value(avgdl) as avgdl from cp, tot group by token)"""
COSINE = """w as (select token, power(ln((n + 1) / cast(df + 1 as double)) + 1, 2) as w from st),
  dn as (select id, sqrt(sum(w)) as dn from dp join w using (token) group by id), cn as (select id, sqrt(sum(w)) as cn from cp join w using (token) group by id),
  dot as (select dp.id as doc_id, cp.id as item_id, sum(w) as dot from dp join cp on dp.token = cp.token join w on w.token = dp.token group by 1, 2),
  cosine as (select doc_id, item_id, round(dot / (dn * cn), 6) as cosine from dot join dn on dn.id = doc_id join cn on cn.id = item_id)"""
BM25 = """dl as (select id, sum(tf) as dl from cp group by id),
  cw as (select cp.id, cp.token, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) as w from cp join st on st.token = cp.token join dl on dl.id = cp.id),
  bm as (select dp.id as doc_id, cw.id as item_id, round(1 - exp(-sum(w * least(tf, 2)) / 8.0), 6) as bm25 from dp join cw on dp.token = cw.token group by 1, 2)"""
HYBRID = """hy as (select coalesce(cosine.doc_id, bm.doc_id) as doc_id, coalesce(cosine.item_id, bm.item_id) as item_id, floor((45 * cast(round(coalesce(cosine, 0) * 1e6) as bigint) + 55 * cast(round(coalesce(bm25, 0) * 1e6) as bigint)) / 10000.0::double) / 10000.0::double as score
    from cosine full join bm on cosine.doc_id = bm.doc_id and cosine.item_id = bm.item_id),
  top as (select *, row_number() over (partition by doc_id order by score desc, item_id) as rank from hy where score >= 0.12)"""
