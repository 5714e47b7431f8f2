"""Queries over streams with state of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioflow.plans.registry import query
from folioflow.streaming import events as S
from folioflow.streaming import leases as L

MINUTES, ATTEMPTS = 720, 3
_EVENTS = {"signup": "submit", "view": "claim", "click": "renew", "error": "cancel", "purchase": "complete"}
_MS = MINUTES * 60_000


# All events of a job are replayed one by one; what still runs at the watermark, an hour before the newest event, ends if its lease did.
@query(f"""with recursive e as (select user_id, epoch_ms(ts) as ms, case event_type {' '.join(f"when '{k}' then '{v}'" for k, v in _EVENTS.items())} end as event, case when event_id % 3 = 0 then cast(event_id % 4 as int) end as attempt,
    row_number() over (partition by user_id order by epoch_ms(ts), event_id) as k from events),
  run as (select distinct user_id, 0::bigint as k, 'none' as status, 0 as attempts, null::bigint as until, 0::bigint as yes, 0::bigint as no, 0::bigint as ended from events
    union all select user_id, k,
      case when not ok then st when event = 'submit' then 'queued' when event = 'claim' then 'running' when event = 'renew' then st when event = 'cancel' then case st when 'running' then 'cancel_requested' else 'cancelled' end when st = 'cancel_requested' then 'cancelled' else 'completed' end,
      case when ok and event = 'submit' then 0 when ok and event = 'claim' then attempts + 1 else attempts end,
      case when ok and event in ('claim', 'renew') then ms + {_MS} when ok and event in ('submit', 'complete') then null else un end,
      yes + ok::int, no + (not ok)::int, ended + ex::int
    from (select *, case event when 'submit' then st in ('none', 'completed', 'cancelled', 'failed') when 'claim' then st = 'queued' when 'cancel' then st in ('queued', 'running') when 'complete' then st in ('running', 'cancel_requested')
        else st in ('running', 'cancel_requested') and (attempt is null or attempt = attempts) end as ok
      from (select run.user_id, e.k, e.ms, e.event, e.attempt, attempts, yes, no, ended, coalesce(until < ms, false) as ex, case when until < ms then case when status = 'cancel_requested' then 'cancelled' when attempts >= {ATTEMPTS} then 'failed' else 'queued' end else status end as st, case when until < ms then null else until end as un
        from run join e on e.user_id = run.user_id and e.k = run.k + 1))),
  fin as (select *, coalesce(until < (select max(ms) - 3600000 from e), false) as ex from run qualify row_number() over (partition by user_id order by k desc) = 1)
  select user_id as job, case when ex then case when status = 'cancel_requested' then 'cancelled' when attempts >= {ATTEMPTS} then 'failed' else 'queued' end else status end as status, attempts, yes as n_accepted, no as n_refused, ended + ex::int as n_expired from fin""")
def lease_stream(spark, t):
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _EVENTS.items()])
    attempt = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 4).cast("int"))
    stream = S.tail(spark, t.path("events"), t("events").schema).select(F.col("user_id").alias("job"), F.col("ts").alias("at"), "event_id", kind.alias("event"), attempt.alias("attempt"))
    return L.summary(L.drained(L.transitions(stream, MINUTES, ATTEMPTS), uuid.uuid4().hex))


@query("select user_id, event_type, sha256(user_id || '|' || event_type) as dedupe_key from (select distinct user_id, event_type from events)")
def stream_reservations(spark, t):
    """All requests come in one batch, so each key is reserved once."""
    stream = S.tail(spark, t.path("events"), t("events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    kept = S.reserved(stream.withColumn("dedupe_key", F.sha2(F.concat_ws("|", "user_id", "event_type"), 256)), ["dedupe_key"], "ts", "60 days")
    return S.logged(kept.select("user_id", "event_type", "dedupe_key"), uuid.uuid4().hex)
