"""What stands behind each mapping, rolled up to one row, and the conservative role of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Facts cited, sources of a fact and warnings that one row shows at most.
MOST_CITED, MOST_SOURCES, MOST_WARNINGS = 12, 5, 20
#: Roles of a document from the weakest on, and types of facts that make a primary or a supporting one.
ROLES = ("not_evidence", "context", "supporting", "primary")
PRIMARY_TYPES, SUPPORTING_TYPES = ("implementation", "evaluation", "improvement"), ("policy", "socialization")


def inferred_roles(docs: DataFrame, facts: DataFrame, markers: DataFrame, id_: str, name: str) -> DataFrame:
    """id, role of every document: primary by a primary fact of an action's type, supporting by a marker (term) among its name's
    words or by its facts' types and roles, context with any other fact, else not_evidence. facts has id, fact_type, role."""
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    kind, role = F.coalesce("fact_type", F.lit("unknown")), F.coalesce("role", F.lit("context"))
    shown = facts.groupBy(id_).agg(has((role == "primary") & kind.isin(*PRIMARY_TYPES)).alias("__primary"), has(kind.isin(*SUPPORTING_TYPES) | (role == "supporting")).alias("__supporting"))
    words = docs.select(id_, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))).alias("term"))
    named = words.join(markers.select("term"), "term", "left_semi").select(id_).distinct().withColumn("__named", F.lit(True))
    df = docs.select(id_).join(shown, id_, "left").join(named, id_, "left")
    found = F.when(F.col("__primary"), "primary").when(F.col("__named"), "supporting").when(F.col("__supporting"), "supporting").when(F.col("__primary").isNotNull(), "context")
    return df.select(id_, F.coalesce(found, F.lit("not_evidence")).alias("role"))


def conservative(local: Column, model: Column) -> Column:
    """The weaker of two roles; a model can't promote, and one that names no role says nothing."""
    place = lambda c: F.coalesce(*[F.when(c == r, F.lit(i)) for i, r in enumerate(ROLES)])
    weaker = F.least(place(local), F.coalesce(place(model), place(local)))
    return F.coalesce(*[F.when(weaker == i, F.lit(r)) for i, r in enumerate(ROLES)])


def citations(mappings: DataFrame, facts: DataFrame, sources: DataFrame, id_: str) -> DataFrame:
    """id, citations: the first facts of a mapping's list `supporting` that exist, in its order, each with its first sources.

    facts has fact_id, claim; sources fact_id, ordinal, quote. Lists are cut before they are gathered, so a row holds
    MOST_CITED x MOST_SOURCES quotes at most.
    """
    # Lists are small as a file and many rows when exploded, so the planner's size of them says nothing: no side is broadcast.
    asked = mappings.select(id_, F.posexplode("supporting").alias("pos", "fact_id")).hint("merge").join(facts.select("fact_id", "claim"), "fact_id")
    cited = asked.withColumn("__n", F.row_number().over(Window.partitionBy(id_).orderBy("pos"))).where(F.col("__n") <= MOST_CITED)
    first = sources.withColumn("__n", F.row_number().over(Window.partitionBy("fact_id").orderBy("ordinal"))).where(F.col("__n") <= MOST_SOURCES)
    quotes = first.groupBy("fact_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "quote"))), lambda x: x["quote"]).alias("quotes"))
    each = F.struct("pos", "fact_id", "claim", F.coalesce("quotes", F.array().cast("array<string>")).alias("quotes"))
    rows = cited.join(quotes, "fact_id", "left").groupBy(id_).agg(F.sort_array(F.collect_list(each)).alias("c"))
    return rows.select(id_, F.transform("c", lambda x: F.struct(x["fact_id"].alias("fact_id"), x["claim"].alias("claim"), x["quotes"].alias("quotes"))).alias("citations"))


def checked(verifications: DataFrame, id_: str) -> DataFrame:
    """id, verified, warnings of verifications (id, ordinal, status, findings): verified if all checks are, findings in the checks' order."""
    each = verifications.select(id_, "status", "ordinal", F.posexplode_outer("findings").alias("pos", "finding"))
    ranked = each.withColumn("__n", F.count("finding").over(Window.partitionBy(id_).orderBy("ordinal", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kept = F.collect_list(F.when(F.col("finding").isNotNull() & (F.col("__n") <= MOST_WARNINGS), F.struct("ordinal", "pos", "finding")))
    rows = ranked.groupBy(id_).agg(F.bool_and(F.coalesce(F.col("status") == "verified", F.lit(False))).alias("verified"), F.sort_array(kept).alias("w"))
    return rows.select(id_, "verified", F.transform("w", lambda x: x["finding"]).alias("warnings"))


def explained(mappings: DataFrame, outcomes: DataFrame, verifications: DataFrame, facts: DataFrame, sources: DataFrame, id_: str) -> DataFrame:
    """One row for each mapping (id, supporting): outcome, verification_status, citations and warnings. It explains what was decided and decides nothing; without checks a person has to look."""
    df = mappings.select(id_).join(outcomes, id_, "left").join(checked(verifications, id_), id_, "left").join(citations(mappings, facts, sources, id_), id_, "left")
    status = F.when(F.col("verified"), "verified").otherwise("needs_human_review")
    none = F.array().cast("array<string>")
    return df.withColumns({"verification_status": status, "warnings": F.coalesce("warnings", none), "citations": F.coalesce("citations", F.array().cast("array<struct<fact_id:string,claim:string,quotes:array<string>>>"))}).drop("verified")
