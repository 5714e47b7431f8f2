"""Files written from a table and read back through the source of units."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.plans.registry import query
from folioflow.session import scratch
from folioflow.sources import archives, units

#: Pages that one archive lists.
SHARE = 100


def _archives(rows: pd.DataFrame) -> pd.DataFrame:
    """One file of each format for a share of pages."""
    rows, name = rows.sort_values("page_id"), f"{rows['share'].iloc[0]}/pages"
    ids, urls, digests = (rows[c].astype(object).where(rows[c].notna(), None).tolist() for c in ("page_id", "url", "digest"))
    shown = [u or "" for u in urls]
    return pd.DataFrame(
        [
            (f"{name}.docx", archives.docx(f"Pages {name}", shown)),
            (f"{name}.xlsx", archives.xlsx([("index", [[str(i), None, u] for i, u in zip(ids, urls, strict=True)]), ("digests", [[None, d] for d in digests])])),
            (f"{name}.pptx", archives.pptx([(u, d if i % 3 == 0 else "") for i, u, d in zip(ids, shown, digests, strict=True)])),
            (f"{name}.pdf", archives.pdf([[u, d] for u, d in zip(shown, digests, strict=True)])),
            (f"{name}.txt", "\n".join(shown).encode()),
        ],
        columns=["name", "content"],
    )


def _written(spark, t) -> DataFrame:
    """Units of files that list the table's pages, five files for each share of them."""
    pages = t("pages").select("page_id", "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.floor(F.col("page_id") / SHARE).alias("share"))
    folder = f"{scratch(spark)}/folioflow-{spark.sparkContext.applicationId}/archives-{uuid.uuid4().hex}"
    units.register(spark)
    units.saved(pages.groupBy("share").applyInPandas(_archives, "name string, content binary"), folder)
    return spark.read.format("folioflow_units").load(folder)


@query("""with p as (select page_id, page_id // 100 as s, coalesce(url, '') as u, url, sha256(coalesce(html, '')) as d, row_number() over (partition by page_id // 100 order by page_id) as n, count(*) over (partition by page_id // 100) as total from pages),
  r as (select s, 'docx' as f, 'heading' as unit_type, 0 as ordinal, 'Pages ' || s || '/pages' as text, ['Pages ' || s || '/pages'] as heading from p where n = 1
    union all select s, 'docx', 'block', n, u, ['Pages ' || s || '/pages'] from p
    union all select s, 'txt', 'line', n - 1, u, []::varchar[] from p
    union all select s, 'pdf', 'page', n - 1, trim(u || chr(10) || d), [case when u = '' then d else u[:180] end] from p
    union all select s, 'xlsx', 'row', n - 1, 'index' || chr(9) || page_id || coalesce(chr(9) || chr(9) || url, ''), ['index'] from p
    union all select s, 'xlsx', 'row', total + n - 1, 'digests' || chr(9) || chr(9) || d, ['digests'] from p
    union all select s, 'pptx', 'slide', n - 1 + count(*) filter (where page_id % 3 = 0) over (partition by s order by n rows between unbounded preceding and 1 preceding), u, []::varchar[] from p
    union all select s, 'pptx', 'notes', n + count(*) filter (where page_id % 3 = 0) over (partition by s order by n rows between unbounded preceding and 1 preceding), d, []::varchar[] from p where page_id % 3 = 0)
  select s || '/pages.' || f as name, unit_type, cast(ordinal as int) as ordinal, text, case when trim(text) = '' then 'empty' else 'processed' end as status, array_to_string(heading, ' / ') as headings from r""")
def archive_units(spark, t):
    found = _written(spark, t)
    name = F.regexp_extract("path", r"[^/]+/[^/]+$", 0)
    return found.select(name.alias("name"), "unit_type", "ordinal", "text", "status", F.array_join("heading", " / ").alias("headings"))


@query("""select page_id // 100 as share, count(*) as n_pages, cast(sum(length(coalesce(url, '')) + 65 - case when url is null then 1 else 0 end) as bigint) as characters from pages group by 1""")
def archive_pdf_pages(spark, t):
    """Filters on the kind reach the source, which opens the heads of other files only."""
    found = _written(spark, t).where("kind = 'pdf'")
    share = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).cast("long").alias("share")
    return found.groupBy(share).agg(F.count("*").alias("n_pages"), F.sum(F.col("metadata")["characters"].cast("long")).alias("characters"))
