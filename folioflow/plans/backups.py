"""A copy of a table with planted damage, found and mended through the tree of digests; audits of files that reuse results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioflow.operators import audit as A
from folioflow.operators import backup as B
from folioflow.plans.registry import query
from folioflow.session import scratch, written
from folioflow.sources import files, units


@query("""select state, count(*) as n, cast(sum(o_orderkey) as bigint) as keys, round(sum(o_totalprice), 2) as total from (
    select 'missing' as state, o_orderkey, o_totalprice from orders where o_orderkey % 1000 = 7 union all select 'changed', o_orderkey, o_totalprice from orders where o_orderkey % 1000 = 8
    union all select 'extra', -o_orderkey, o_totalprice from orders where o_orderkey % 1000 = 9 union all select 'restored', o_orderkey, o_totalprice from orders) group by state""")
def backup_restore(spark, t):
    """Lost, changed and added orders are told from the damaged leaves alone; after the restore the whole table is the backup's."""
    base = f"{scratch(spark)}/folioflow-{spark.sparkContext.applicationId}/backup-{uuid.uuid4().hex}"
    orders = t("orders")
    levels, k = B.levels_for(orders.count()), F.col("o_orderkey")
    live = orders.where(k % 1000 != 7).withColumn("o_totalprice", F.when(k % 1000 == 8, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    live = live.union(orders.where(k % 1000 == 9).withColumn("o_orderkey", -k))
    B.write(orders, f"{base}/backup", ["o_orderkey"], levels)
    B.write(live, f"{base}/live", ["o_orderkey"], levels)
    leaves = written(B.damaged(spark.read.parquet(f"{base}/live/tree"), spark.read.parquet(f"{base}/backup/tree"), levels), "leaves")
    both = [B.read(spark, f"{base}/{x}") for x in ("live", "backup")]
    found = written(B.differences(*both, leaves, ["o_orderkey"]), "differences")
    prices = both[0].union(both[1].join(found.where("state = 'missing'"), "o_orderkey", "left_semi").select(*both[0].columns))
    told = found.join(prices, "o_orderkey").select("state", "o_orderkey", F.when(F.col("state") == "changed", F.col("o_totalprice") - 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    told = written(told, "told")
    B.restore(spark, f"{base}/live", f"{base}/backup", [r.node for r in leaves.collect()])
    whole = B.read(spark, f"{base}/live").select(F.lit("restored").alias("state"), "o_orderkey", "o_totalprice")
    return told.union(whole).groupBy("state").agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("long").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"))


#: Files that a folder of the audited ones holds, on average.
SHARE = 1_000


def _judged(rows):
    """Lines and characters of each content, through the readers of units."""
    found = files.file_units(rows.withColumnRenamed("sha256", "path"))
    return found.groupBy(F.col("path").alias("sha256")).agg(F.count("*").alias("units"), F.sum(F.length("text")).cast("long").alias("characters"))


@query("""with p as (select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host from pages)
  select 1 as run, count(*) as opened, count(*) as files, count(distinct host) as contents, cast(sum(length(host)) as bigint) as characters from p
  union all select 2, (select count(*) from p where page_id % 10 = 3), count(*), (select count(distinct h) from (select host as h from p union all select upper(host) from p where page_id % 10 = 3)), cast(sum(length(host)) as bigint) from p""")
def corpus_audit(spark, t):
    """A file for each page; the second run opens the tenth of them that was written again, and judges new contents only."""
    folder = f"{scratch(spark)}/folioflow-{spark.sparkContext.applicationId}/audit-{uuid.uuid4().hex}"
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    pages = t("pages")
    below = F.pmod(F.xxhash64("page_id"), F.lit(-(-pages.count() // SHARE) or 1)).cast("string")
    named = pages.select("page_id", F.concat(below, F.lit("/"), F.col("page_id").cast("string"), F.lit(".txt")).alias("name"), host.cast("binary").alias("content"), F.upper(host).cast("binary").alias("changed"))
    manifest, results = spark.createDataFrame([], A.MANIFEST), spark.createDataFrame([], "sha256 string, version string, units long, characters long")
    out = None
    for run, rows in ((1, named.select("name", "content")), (2, named.where("page_id % 10 = 3").select("name", F.col("changed").alias("content")))):
        units.saved(rows, folder)
        manifest, results, seen = A.audited(A.listing(spark, folder), manifest, results, "v1", _judged)
        whole = A.corpus(manifest, results, "v1").agg(F.count("*").alias("files"), F.coalesce(F.sum("characters"), F.lit(0)).alias("characters"))
        row = whole.join(results.agg(F.count("*").alias("contents"))).select(F.lit(run).alias("run"), F.lit(seen.get["opened"]).alias("opened"), "files", "contents", "characters")  # one row each
        out = row if out is None else out.union(row)
    return out
