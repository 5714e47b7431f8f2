"""Queries over the structure of documents: turns of a conversation are units, some of them headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import structure as S
from folioflow.plans.registry import query

# Levels come of the texts' lengths; 0 is no heading. A stack of 'level:title' is folded for every turn.
_STACKS = """u as (select conv_id, turn, role, length(coalesce(text, '')) % 5 as level, left(coalesce(text, ''), 20) as title from conversations),
  h as (select conv_id, turn, level || ':' || title as x from u where level > 0),
  f as (select u.conv_id, u.turn, u.role, list([h.x] order by h.turn) filter (where h.x is not null) as hs from u left join h on h.conv_id = u.conv_id and h.turn <= u.turn group by u.conv_id, u.turn, u.role),
  p as (select conv_id, turn, role, case when hs is null then []::varchar[] else list_transform(list_reduce(hs, lambda s, x: list_append(s[:cast(x[1][1:1] as int) - 1], x[1])), lambda y: y[3:]) end as path from f)"""


def _placed(t):
    level, title = F.length(F.coalesce("text", F.lit(""))) % 5, F.substring(F.coalesce("text", F.lit("")), 1, 20)
    return S.heading_paths(t("conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn", F.when(level > 0, level), title)


@query(f"with {_STACKS} select conv_id, turn, array_to_string(path, ' / ') as path from p")
def heading_paths(spark, t):
    return _placed(t).select("conv_id", "turn", F.array_join("path", " / ").alias("path"))


@query(f"""with {_STACKS}, g as (select conv_id, path, min(turn) as first from p where len(path) > 0 group by 1, 2), r as (select *, row_number() over (partition by conv_id order by first) as place from g)
  select conv_id, cast(place as int) as place, array_to_string(path, ' / ') as path, first from r where place <= 500""")
def distinct_headings(spark, t):
    return S.distinct_paths(_placed(t), "conv_id", "turn").withColumn("path", F.array_join("path", " / "))


@query(f"""with {_STACKS}, k as (select conv_id, role, count(*) as n from p group by 1, 2), w as (select conv_id, cast(sum(n) as bigint) as n_units, string_agg(role || '=' || n, ',' order by role) as kinds from k group by 1),
  d as (select conv_id, least(count(distinct path), 500) as n_paths from p where len(path) > 0 group by 1), s as (select conv_id, least(sum(length(coalesce(text, '')) % 3), 5000)::bigint as n_regions from conversations group by 1)
  select w.conv_id, n_units, kinds, coalesce(n_paths, 0) as n_paths, n_regions from w left join d using (conv_id) join s using (conv_id)""")
def document_maps(spark, t):
    found = S.document_map(_placed(t), "conv_id", "turn", "role", F.length(F.coalesce("text", F.lit(""))) % 3)
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.withColumn("kinds", kinds)
