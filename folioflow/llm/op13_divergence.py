"""Source divergence audit: how far the sources of a language use its terms differently.

Every kept term is one wide row: an array with its count in each source of its language, in the order of
the sources' names. JVM higher-order functions turn the row into relative frequencies and then into one
contribution for each pair of sources, which partial aggregation adds up before anything is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.llm.common import few, stored, table

#: Fixed values of the contract: what parts terms, documents a kept term has, the scale of p and its smoothing, and the ranks of terms.
BREAK = bytes(b for b in range(0x80) if not chr(b).isalpha())
LEAST_DOCS, SCALE, SMOOTH, TOP_TERMS = 10, 1_000_000_000, 2, 10
_WHOLE = "decimal(28,0)"
#: Groups' terms that a task holds before it hands them on.
HELD_TERMS = 300_000
_TERMS = bytes(32 if b in BREAK else b + 32 if 65 <= b <= 90 else b for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term in each group, and the rows of docs that hold it.

    Null texts, langs and sources are empty strings. A task adds up what it has read in tables of bounded size
    before anything is shuffled; UTF-8 keeps the bytes that part terms apart from those of other characters.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, rows) in held.items():
                many = len(n)
                term = pa.array(list(n), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * many, pa.string()), pa.array([source] * many, pa.string()), term, pa.array(list(n.values()), pa.int64()), pa.array(list(rows.values()), pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = Counter(text.as_py().encode("utf-8").translate(_TERMS).split())
                n, rows = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(own)
                rows.update(own.keys())
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from flushed()
                    size = 0
        yield from flushed()

    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(own("lang"), own("source"), own("text")).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), in whole numbers at any count."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    return 1 + F.call_function("div", above.cast("decimal(38,0)"), (total + SMOOTH * kept).cast(_WHOLE))


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares stay below 2^30, so this fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _dense(size: Column) -> Column:
    """The counts of a term by the place of its source, zeros between the entries that it has; linear in the result."""
    entries = F.col("entries")
    before = lambda i: F.when(i > 0, F.get(entries, i - 1)["at"]).otherwise(F.lit(-1))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n.cast("int"))
    parts = F.transform(entries, lambda e, i: F.concat(zeros(e["at"] - before(i) - 1), F.array(e["n"])))
    return F.concat(F.flatten(parts), zeros(size - 1 - F.element_at(entries, -1)["at"]))


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of docs.

    Part 'pair' ranks the other sources of the language by the distance of their term shares, part 'term' the
    ten terms that the source uses more than its language, by theirs; ties by item in UTF-8 order. A document is a row of
    docs: repeated rows count each, doc_id and other columns aren't read. Null texts have no terms, null langs
    and sources count as ''. A language without kept terms has pairs of value 0; an empty table gives no rows.
    All that is gathered grows with the number of sources of one language, whose square the result holds anyway.
    """
    counts = stored(term_counts(docs), "divergence-counts")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = stored(few(groups.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)), "divergence-groups")

    # One row a kept term: its counts by place, sorted; a term has an entry for each source that uses it.
    entry = F.struct("at", "n")
    wide = counts.join(groups, ["lang", "source"]).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.sort_array(F.collect_list(entry)).alias("entries"))
    wide = stored(wide.where(F.col("docs") >= LEAST_DOCS).drop("docs"), "divergence-wide")

    # One row a language: its sources' names and totals by place, its kept terms and its own total.
    sums = wide.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.at").alias("at")).agg(F.sum("e.n").alias("total"))
    placed = groups.join(sums, ["lang", "at"], "left").select("lang", "at", "source", F.coalesce("total", F.lit(0)).alias("total"))
    by_place = F.sort_array(F.collect_list(F.struct("at", "source", "total")))
    langs = placed.groupBy("lang").agg(by_place.alias("s")).select("lang", F.col("s.source").alias("sources"), F.col("s.total").alias("totals"))
    kept = wide.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("all"))
    langs = stored(few(langs.join(kept, "lang", "left").select("lang", "sources", "totals", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("all", F.lit(0)).alias("all"))), "divergence-langs")

    shares = F.transform(_dense(F.size("totals")), lambda c, i: _share(c, F.get("totals", i), F.col("kept")))
    vectors = wide.join(langs.drop("sources"), "lang").where(F.size("totals") > 1).select("lang", shares.alias("p"))
    later = lambda p, i: F.transform(F.slice(F.col("p"), i + 2, F.size("p")), lambda q: _gap(p, q))
    rows = F.transform("p", lambda p, i: F.struct(i.alias("low"), later(p, i).alias("gaps")))
    fans = vectors.select("lang", F.inline(rows)).select("lang", "low", F.posexplode("gaps").alias("k", "gap"))
    gaps = fans.groupBy("lang", "low", (F.col("low") + F.col("k") + 1).alias("high")).agg(F.sum("gap").alias("gap"))
    mirrored = F.explode(F.array(F.struct(F.col("low").alias("at"), F.col("high").alias("other")), F.struct(F.col("high").alias("at"), F.col("low").alias("other"))))
    gaps = gaps.select("lang", mirrored.alias("x"), "gap").select("lang", "x.at", "x.other", "gap")
    # Each group names all others of its language, also where no term was kept.
    others = groups.join(langs.select("lang", "sources"), "lang").select("lang", "source", "at", F.posexplode("sources").alias("other", "item")).where("at <> other")
    pairs = others.join(gaps, ["lang", "at", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("gap", F.lit(0)).cast("long").alias("value"))

    own = wide.join(langs, "lang").select("lang", F.col("term").alias("item"), "n", "totals", "sources", "kept", "all", F.explode("entries").alias("e"))
    p, q = _share(F.col("e.n"), F.get("totals", F.col("e.at")), F.col("kept")), _share(F.col("n"), F.col("all"), F.col("kept"))
    more = own.select("lang", F.get("sources", F.col("e.at")).alias("source"), "item", p.alias("p"), q.alias("q")).where("p > q")
    terms = more.select("lang", "source", F.lit("term").alias("part"), "item", _gap(F.col("p"), F.col("q")).alias("value"))

    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    # Spark keeps the first ten of each group on the map side of this window.
    return ranked(pairs).union(ranked(terms).where(F.col("rank") <= TOP_TERMS))


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from t group by lang, term having count(distinct id) >= 10),
v as (select lang, count(*) as v from k group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as c from t semi join k using (lang, term) group by all),
full_ as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select lang, source, term, c, cast(1 + (1000000000 * cast(c + 2 as hugeint)) // (sum(c) over (partition by lang, source) + 2 * v) as bigint) as p from full_ join v using (lang)),
l as (select lang, term, cast(1 + (1000000000 * cast(sum(c) + 2 as hugeint)) // (sum(sum(c)) over (partition by lang) + 2 * any_value(v)) as bigint) as q from full_ join v using (lang) group by lang, term),
pv as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (select g.lang, g.source, 'pair' as part, h.source as item, cast(coalesce(value, 0) as bigint) as value
    from g join g h on g.lang = h.lang and g.source <> h.source left join pv on pv.lang = g.lang and pv.source = g.source and pv.item = h.source
  union all select p.lang, p.source, 'term', p.term, cast(((p - q) * (p - q)) // (p + q) as bigint) from p join l on l.lang = p.lang and l.term = p.term where c > 0 and p > q)
select * from (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from parts) where part = 'pair' or rank <= 10
"""
