"""From raw documents to token ids in five stages; each is written as Parquet and read by the next.

quality rules -> near-duplicates -> repeated passages -> mix of sources -> token ids
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import scratch_root, stored, table
from folioflow.llm.op01_bpe import decode, encode
from folioflow.llm.op03_rules import quality_rules
from folioflow.llm.op05_mix import mix
from folioflow.llm.op08_substring import remove_repeats
from folioflow.llm.op09_simhash import near_duplicates
from folioflow.session import ship

#: Copies of a row that one step makes.
COPIES = 1_000


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the quality rules keep, unchanged; null and empty texts go with the short ones, repeated rows stay or go together."""
    ship(spark)
    judged = quality_rules(docs, carry=tuple(docs.columns)).where("kept")
    return judged.select(*[F.col(f"__c_{c}").alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of smallest doc_id, a null one last, then of smallest text.

    Rows are judged, not ids: different texts under one doc_id, or none, all have their chance; rows that
    agree in both count as one. Null and empty texts form one group.
    """
    ship(spark)
    # The row travels as one column, so no name of it can clash; doc_id and digest tell rows apart.
    keyed = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.unhex(F.md5("row.text")), F.unhex(F.lit(""))).alias("digest"))
    found = near_duplicates(keyed.select("doc_id", F.col("row.text").alias("text"), "digest"), carry=("digest",))
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n"))
    first = stored(first, "pipeline-first")
    low = first.groupBy("root").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    # Texts are only read again where one doc_id, or none, has several.
    tied = first.join(low.where("low <> high").select("root"), "root").select("root", "doc_id", "digest")
    same = lambda x: keyed["doc_id"].eqNullSafe(x["doc_id"]) & (keyed["digest"] == x["digest"])
    texts = keyed.join(tied, same(tied)).groupBy(tied["root"]).agg(F.min(F.struct(keyed["row.text"], keyed["digest"])).alias("x")).select("root", F.col("x.digest").alias("digest"))
    sole = low.where("low = high").select("root", F.col("low").alias("digest"))
    stay = stored(first.join(sole.union(texts), ["root", "digest"]).select("doc_id", "digest", "n"), "pipeline-stay")
    # Only rows that occur several times are dealt to find one of each; the others pass where they stand.
    lone, several = stay.where("n = 1"), stay.where("n > 1")
    once = keyed.join(several, same(several), "left_semi").dropDuplicates(["doc_id", "digest"])
    return keyed.join(lone, same(lone), "left_semi").union(once).select("row.*")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that a document of smaller doc_id has; an untouched text stays as it was.

    A null text stays null, a null doc_id counts as the largest, repeated rows stay and keep each other's words.
    """
    ship(spark)
    others = tuple(c for c in docs.columns if c != "doc_id")
    found = remove_repeats(docs, carry=others)
    changed = F.col("n_removed") > 0
    own = {c: F.col("doc_id" if c == "doc_id" else f"__c_{c}") for c in docs.columns}
    own["text"] = F.when(changed, F.col("kept")).otherwise(own["text"])
    if "n_chars" in others:
        own["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(own["n_chars"].cast("long"))
    return found.select(*[own[c].alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null sources are a source, null texts have no words.

    Rows that agree in doc_id, source and text are documents of their own to the mix; what it takes of them in all is
    dealt out over them evenly, so repeats neither gain nor lose.
    """
    ship(spark)
    # Nulls are skipped by the hash, so what is null is hashed beside the values.
    parts = [x for c in ("doc_id", "source", "text") for x in (F.col(c), F.col(c).isNull())]
    keyed = docs.select(F.xxhash64(*parts).alias("key"), "source", "text", F.struct("*").alias("row"))
    taken = mix(keyed.select(F.col("key").alias("doc_id"), "source", "text"))
    taken = taken.groupBy(F.col("doc_id").alias("key")).agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    taken = stored(taken, "pipeline-taken")
    # Only rows that occur several times are summed up, equal ones to one row with its count.
    lone = keyed.join(taken.where("n = 1"), "key").select("row", F.col("copies").cast("long").alias("copies"))
    several = keyed.join(taken.where("n > 1"), "key").groupBy("key", "row", "copies", "n").agg(F.count("*").alias("own"))
    order = Window.partitionBy("key").orderBy(F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    several = several.withColumn("upto", F.sum("own").over(order))
    share = lambda upto: F.floor(F.col("copies").cast("decimal(20,0)") * upto / F.col("n"))
    several = several.select("row", (share(F.col("upto")) - share(F.col("upto") - F.col("own"))).cast("long").alias("copies")).where("copies > 0")
    # Many copies are made in two steps, so no array is long.
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES)))
    rows = lone.union(several).select("row", "copies", blocks.alias("block"))
    each = F.explode(F.array_repeat(F.lit(0), F.least(F.lit(COPIES), F.col("copies") - F.col("block") * COPIES).cast("int")))
    return rows.select("row", each).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of the bytes that they decode to, for each row; a null text is empty."""
    import public_tokenizers

    ship(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # Reused workers still hold what the stages before remembered, so this one remembers less than by default.
    coded = decode(encode(docs, path, public_tokenizers.PATTERN, remembered=120_000), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("quality rules", rules), ("near copies", near_copies), ("repeated passages", passages), ("mixture", mixture), ("token ids", tokens)]

#: The covariance estimates, the sampled mix and the token ids have no statement in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; the stages' tables stay in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch_root(spark)}/folioflow-{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
