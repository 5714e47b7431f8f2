"""Documents to units and facts: text units, coverage, structure, sensitive signals, templates, claims."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import bounded, keyword_hits, sentences, title_case

SEGMENT = 20_000
#: Patterns of sensitive signals.
SIGNALS = {"emails": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phones": r"\+\d{8,14}", "long_ids": r"(?<!\d)\d{16}(?!\d)"}


def units(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One unit for each line, cut to segments of `segment` characters: doc_id, line, part, text, status (empty or processed)."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / segment).cast("int") - 1, F.lit(0))), lambda i: F.substring(F.col("text"), i * segment + 1, F.lit(segment)))
    parts = lines.select("doc_id", "line", F.posexplode(cuts).alias("part", "text"))
    return parts.withColumn("status", F.when(F.length(F.trim("text")) == 0, "empty").otherwise("processed"))


def coverage(unit: DataFrame) -> DataFrame:
    """doc_id, n_units, n_processed, percentage and coverage_status: complete, partial or blocked."""
    done = F.sum((F.col("status") == "processed").cast("long"))
    df = unit.groupBy("doc_id").agg(F.count("*").alias("n_units"), done.alias("n_processed"))
    share = F.round(100.0 * F.col("n_processed") / F.col("n_units"), 2)
    status = F.when(F.col("n_processed") == F.col("n_units"), "complete").when(F.col("n_processed") > 0, "partial").otherwise("blocked")
    return df.withColumns({"percentage": share, "coverage_status": status})


def sensitive(docs: DataFrame, signals: Mapping[str, str] = SIGNALS) -> DataFrame:
    """doc_id and the number of matches of each signal, for documents that have any."""
    counts = {name: F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p)).cast("long") for name, p in signals.items()}
    df = docs.select("doc_id", *[c.alias(n) for n, c in counts.items()])
    return df.where(sum(F.col(n) for n in counts) > 0)


def claims(docs: DataFrame, least: int = 20, most: int = 700, limit: int = 2000) -> DataFrame:
    """doc_id, place, claim: a document's sentences of `least` characters or more, without dashes and bullets around them, bounded.

    Of claims that agree but for case and white space the first stays; at most `limit` a document,
    which is the feature. Equal claims meet by key, so a long document costs no more than its length.
    """
    edges = r"^[ \t\r\n•-]+|[ \t\r\n•-]+$"
    own = F.filter(F.transform(sentences(F.col("text")), lambda s: F.regexp_replace(s, edges, "")), lambda s: F.length(s) >= least)
    rows = docs.select("doc_id", F.posexplode(own).alias("place", "raw")).select("doc_id", "place", bounded(F.col("raw"), most, least).alias("claim"))
    same = F.lower(F.regexp_replace("claim", r"[ \t\r\n]+", " "))
    # Dealt by doc_id once: the grouping and the numbering both keep to it.
    once = rows.repartition("doc_id").groupBy("doc_id", same.alias("same")).agg(F.min(F.struct("place", "claim")).alias("x"))
    numbered = once.select("doc_id", "x.place", "x.claim").withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")))
    return numbered.where(F.col("__n") <= limit).drop("__n")


def fact_type(claim: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """The type with most keyword hits; the largest name wins a tie, `general` without hits."""
    scored = F.array_max(F.array(*[F.struct(F.size(keyword_hits(claim, words)).alias("n"), F.lit(name).alias("name")) for name, words in lexicon.items()]))
    return F.when(scored["n"] > 0, scored["name"]).otherwise("general")


def verified_quotes(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """quotes (doc_id, quote) with verified: the quote isn't blank and stands in its document."""
    texts = docs.select("doc_id", "text")
    return quotes.join(texts, "doc_id", "left").withColumn("verified", F.coalesce((F.length(F.trim("quote")) > 0) & (F.instr("text", F.col("quote")) > 0), F.lit(False))).drop("text")


def accepted(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """facts (doc_id, quote) whose quote isn't blank and stands, case aside, in its document."""
    texts = docs.select("doc_id", "text")
    return facts.join(texts, "doc_id").where((F.length(F.trim("quote")) > 0) & (F.instr(F.lower("text"), F.lower("quote")) > 0)).drop("text")


def template_flags(docs: DataFrame, terms: Sequence[str], placeholder: str = r"[_]{3,}|[.]{4,}|\[[^\]]*\]") -> DataFrame:
    """doc_id, term_hits, placeholders, is_template: two hits or more of terms and placeholders together."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", F.size(keyword_hits(text, terms)).cast("long").alias("term_hits"), F.regexp_count(text, F.lit(placeholder)).cast("long").alias("placeholders"))
    return df.withColumn("is_template", F.col("term_hits") + F.col("placeholders") >= 2)


def file_kind(content: Column, name: Column) -> Column:
    """Kind by leading bytes, then by extension."""
    head = F.hex(F.substring(content, 1, 8))
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    office = F.when(kind.isin("docx", "xlsx", "pptx"), kind).otherwise("zip")
    by_head = F.when(head.startswith("25504446"), "pdf").when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("504B0304"), office)
    return F.coalesce(by_head, F.when(kind.isin("txt", "csv", "md", "html", "json"), kind), F.lit("unknown"))


def upload_findings(files: DataFrame, most_bytes: int, key: str = "name") -> DataFrame:
    """key, finding, blocking for each file (name, content and the key): empty, too large, NUL bytes in text, extension that the bytes contradict."""
    kind = file_kind(F.col("content"), F.col("name"))
    extension = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    size = F.octet_length("content")
    found = F.array_compact(
        F.array(
            F.when(size == 0, F.struct(F.lit("empty").alias("finding"), F.lit(True).alias("blocking"))),
            F.when(size > most_bytes, F.struct(F.lit("too_large").alias("finding"), F.lit(True).alias("blocking"))),
            F.when(kind.isin("txt", "csv", "md") & F.hex("content").rlike("^(..)*?00"), F.struct(F.lit("nul_bytes").alias("finding"), F.lit(True).alias("blocking"))),
            F.when(extension.isin("pdf", "png") & (kind != extension), F.struct(F.lit("signature_mismatch").alias("finding"), F.lit(True).alias("blocking"))),
            F.when(kind == "unknown", F.struct(F.lit("unknown_kind").alias("finding"), F.lit(False).alias("blocking"))),
        )
    )
    return files.select(key, F.inline(found))


def evidence_role(claim: Column, kind: Column, primary: Sequence[str], supporting: Sequence[str], against: Sequence[str]) -> Column:
    """contradictory where the claim holds a word against it, else primary or supporting by its type, else context."""
    return F.when(F.size(keyword_hits(claim, against)) > 0, "contradictory").when(kind.isin(*primary), "primary").when(kind.isin(*supporting), "supporting").otherwise("context")


def document_roles(docs: DataFrame, facts_: DataFrame) -> DataFrame:
    """doc_id, n_facts, role of every document by its facts (doc_id, role): primary, supporting, context, not_evidence without facts."""
    has = lambda r: F.bool_or(F.col("role") == r)
    per = facts_.groupBy("doc_id").agg(F.count("*").alias("n_facts"), F.when(has("primary"), "primary").when(has("supporting"), "supporting").otherwise("context").alias("role"))
    return docs.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("role", F.lit("not_evidence")).alias("role"))


def source_types(text: Column, terms: Mapping[str, Sequence[str]]) -> Column:
    """The source types whose terms a text holds, sorted."""
    return F.sort_array(F.array_compact(F.array(*[F.when(F.size(keyword_hits(text, words)) > 0, F.lit(name)) for name, words in terms.items()])))


def disqualifiers(text: Column, template: Column, plan: Sequence[str], result: Sequence[str]) -> Column:
    """template_only, and plan_without_result for a text with a plan's words and none of a result's."""
    planned = (F.size(keyword_hits(text, plan)) > 0) & (F.size(keyword_hits(text, result)) == 0)
    return F.array_compact(F.array(F.when(template, F.lit("template_only")), F.when(planned, F.lit("plan_without_result"))))


def folder_status(files: DataFrame, folder: str, name: str, vague: Sequence[str], least: int = 4) -> DataFrame:
    """folder, n_files, n_vague, status: curate where a name says nothing, partial below `least` files, else filled."""
    low = F.lower(F.coalesce(name, F.lit("")))
    stem = F.regexp_replace(low, r"\.[^.]*$", "")
    bad = stem.rlike("^[0-9]+$") | (F.length(stem) <= 3) | (F.size(keyword_hits(low, vague)) > 0)
    df = files.groupBy(folder).agg(F.count("*").alias("n_files"), F.sum(bad.cast("long")).alias("n_vague"))
    return df.withColumn("status", F.when(F.col("n_vague") > 0, "curate").when(F.col("n_files") < least, "partial").otherwise("filled"))


def intake(files: DataFrame, id_: str, most_bytes: int) -> DataFrame:
    """id, findings, route of every file (id, name, content): blocked by a blocking finding, review with others, accepted without."""
    found = upload_findings(files, most_bytes, id_)  # several files may have one name
    per = found.groupBy(id_).agg(F.count("*").alias("findings"), F.bool_or("blocking").alias("blocked"))
    df = files.select(id_).join(per, id_, "left")
    route = F.when(F.coalesce("blocked", F.lit(False)), "blocked").when(F.col("findings") > 0, "review").otherwise("accepted")
    return df.select(id_, F.coalesce("findings", F.lit(0)).alias("findings"), route.alias("route"))


#: Fixed value: mark of a unit whose picture nobody has looked at.
PENDING = "pending_review_or_vision"


def eligible(status: Column, text: Column, visual: Column, template: Column) -> Column:
    """Whether a unit may give facts: it was read, has text, its picture isn't pending, and it is no template."""
    return status.isin("processed", "partial") & (F.length(F.coalesce(text, F.lit(""))) > 0) & ~F.coalesce(visual == PENDING, F.lit(False)) & ~F.coalesce(template, F.lit(False))


def review_kind(status: Column, visual: Column) -> Column:
    """What a person has to look at: visual_semantics, ocr_rescue or null."""
    return F.when(visual == PENDING, "visual_semantics").when(status == "ocr_required", "ocr_rescue")


def unit_ledger(units_: DataFrame) -> DataFrame:
    """Per doc_id of units (doc_id, text, status, visual, template): n_units, eligible, checked, template_units, reviews by kind, block_reasons (sorted)."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    c = F.col
    read = c("status").isin("processed", "partial")
    kind = review_kind(c("status"), c("visual"))
    reason = F.when(c("status") == "ocr_required", "ocr_required").when(c("visual") == PENDING, "visual_pending")
    return units_.groupBy("doc_id").agg(
        F.count("*").alias("n_units"),
        n(eligible(c("status"), c("text"), c("visual"), c("template"))).alias("eligible"),
        n(read).alias("checked"),
        n(read & c("template")).alias("template_units"),
        n(kind == "visual_semantics").alias("visual_semantics"),
        n(kind == "ocr_rescue").alias("ocr_rescue"),
        F.sort_array(F.collect_set(reason)).alias("block_reasons"),
    )


def templates(docs: DataFrame, terms: Sequence[str], marks: Sequence[str], activity: Sequence[str], instructions: Sequence[str], date: str) -> DataFrame:
    """doc_id, score, dated_activity, template_only: hits of terms and of mark patterns reach 2, or an instruction is there, and no dated activity stands against it."""
    text = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    df = docs.select("doc_id", text.alias("x"))
    count = lambda cs: sum((c.cast("int") for c in cs), F.lit(0))
    has = lambda w: F.col("x").contains(w)
    score = count([has(w) for w in terms] + [F.col("x").rlike(p) for p in marks])
    dated = (count([has(w) for w in activity]) > 0) & F.col("x").rlike(date)
    only = ~dated & ((score >= 2) | (count([has(w) for w in instructions]) > 0))
    return df.select("doc_id", score.alias("score"), dated.alias("dated_activity"), only.alias("template_only"))


def typed(claims_: DataFrame, lexicon: Mapping[str, Sequence[str]], substantive: Sequence[str]) -> DataFrame:
    """claims with words, fact_type: the type with most whole words, the largest name in a tie; `unknown` without any, and such claims stay only with a substantive word."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("claim"), F.lit("[a-z0-9]+"), F.lit(0)))
    df = claims_.withColumn("words", words)
    hits = lambda own: F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in own])))
    best = F.array_max(F.array(*[F.struct(hits(own).alias("n"), F.lit(name).alias("name")) for name, own in lexicon.items()]))
    df = df.withColumn("fact_type", F.when(best["n"] > 0, best["name"]).otherwise("unknown"))
    return df.where((F.col("fact_type") != "unknown") | (hits(substantive) > 0))


def organization(text: Column, pattern: str, aliases: Mapping[str, str] | None = None) -> Column:
    """The first match of a pattern in title case, or the name that an alias (lower case) stands for; null without a match."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    named = title_case(F.get(found, F.lit(0)))
    known = [F.when(F.lower(named) == k, F.lit(v)) for k, v in (aliases or {}).items()]
    return F.coalesce(*known, named) if known else named


def matched_regions(quotes: DataFrame, regions: DataFrame, key: str, most: int) -> DataFrame:
    """key, region, n_common, place: a unit's regions (key, region, words) that share words with its quote (key, quote), the nearest `most`."""
    both = quotes.join(regions, key).withColumn("n_common", F.size(F.array_intersect("quote", "words"))).where("n_common > 0")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n_common"), "region"))
    return both.select(key, "region", F.col("n_common").cast("long").alias("n_common"), place.alias("place")).where(F.col("place") <= most)
