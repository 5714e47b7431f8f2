"""Catalogs from nested JSON and from sheets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "kk string, parameters array<struct<name: string, grades: array<string>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Groups of a multi-line JSON file, an array or one object, in the schema of a catalog."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def parsed(texts: DataFrame, column: str) -> DataFrame:
    """Groups of JSON texts; what isn't JSON gives none."""
    return texts.select(F.from_json(column, SCHEMA).alias("x")).select("x.*").where("kk is not null")


def exploded(groups: DataFrame) -> DataFrame:
    """kk, parameter, grade of a catalog's groups; parameters without grades are left out."""
    return groups.select("kk", F.explode("parameters").alias("p")).select("kk", F.col("p.name").alias("parameter"), F.explode("p.grades").alias("grade"))


def sheet_cells(units: DataFrame) -> DataFrame:
    """path, sheet, ordinal, column, value of the rows of sheets (units of `file_units`): a row's first part names its sheet."""
    rows = units.where("unit_type = 'row'").select("path", "ordinal", F.split("text", "\t").alias("parts"))
    cells = rows.select("path", F.get("parts", F.lit(0)).alias("sheet"), "ordinal", F.posexplode(F.slice("parts", 2, F.size("parts"))).alias("column", "value"))
    return cells.where(F.length(F.trim("value")) > 0)


def sheet_table(units: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """path, sheet, ordinal and a column for each of names (heading to column name, case aside): the rows below a sheet's heading row, its first row."""
    cells = sheet_cells(units)
    first = cells.groupBy("path", "sheet").agg(F.min("ordinal").alias("first"))
    placed = cells.join(first, ["path", "sheet"])
    known = F.coalesce(*[F.when(F.lower(F.trim("value")) == k.lower(), F.lit(v)) for k, v in names.items()])
    heads = placed.where("ordinal = first").select("path", "sheet", "column", known.alias("name")).where("name is not null")
    below = placed.where("ordinal > first").join(heads, ["path", "sheet", "column"])
    return below.groupBy("path", "sheet", "ordinal").pivot("name", list(dict.fromkeys(names.values()))).agg(F.first("value"))


def sheet_evidence(units: DataFrame, stages: Mapping[str, Sequence[str]]) -> DataFrame:
    """path, sheet, ordinal, text, links, stages of the rows of sheets: their cells joined, distinct links, and the stages whose words they hold."""
    rows = units.where("unit_type = 'row'").select("path", "ordinal", F.split("text", "\t").alias("parts"))
    text = F.array_join(F.filter(F.slice("parts", 2, F.size("parts")), lambda x: F.length(F.trim(x)) > 0), " | ")
    df = rows.select("path", F.get("parts", F.lit(0)).alias("sheet"), "ordinal", text.alias("text"))
    links = F.array_distinct(F.regexp_extract_all("text", F.lit(r"https?://[^\s|]+"), F.lit(0)))
    hits = [F.when(F.lower("text").rlike("(^|[^a-z0-9])(" + "|".join(words) + ")([^a-z0-9]|$)"), F.lit(name)) for name, words in stages.items()]
    return df.withColumns({"links": links, "stages": F.array_compact(F.array(*hits))})
