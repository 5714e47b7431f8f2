"""Geometry and ranges as Column expressions: tiles, boxes, cell ranges, pages of a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a range that are named at most, and pages at a document's ends and around its middle.
MOST_CELLS, ENDS, MIDDLE = 500, 3, 2


def tile_grid(width: Column, height: Column, most_pixels: int) -> Column:
    """Struct (columns, rows): one tile if it fits, else tiles with sides of at most the root of most_pixels, so each fits."""
    side = F.lit(max(1, int(most_pixels**0.5)))
    fits = width.cast("long") * height.cast("long") <= most_pixels
    count = lambda n: F.when(fits, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(n / side))).cast("int")
    return F.struct(count(width).alias("columns"), count(height).alias("rows"))


def on_page(box: Column, tile: Column, width: Column, height: Column) -> Column:
    """A box (x, y, width, height in shares of its tile) in shares of the page; tile has left, top, right, bottom in pixels."""
    w, h = F.greatest(F.lit(1), tile["right"] - tile["left"]), F.greatest(F.lit(1), tile["bottom"] - tile["top"])
    share = lambda v: F.round(v, 6)
    return F.struct(
        share((tile["left"] + box["x"] * w) / width).alias("x"),
        share((tile["top"] + box["y"] * h) / height).alias("y"),
        share(box["width"] * w / width).alias("width"),
        share(box["height"] * h / height).alias("height"),
    )


def lines(words: DataFrame, *keys: str) -> DataFrame:
    """keys, text, confidence, left, top, right, bottom of each line of words (keys, ordinal, text, confidence 0..100, left, top, width, height).

    Words without text or with a negative confidence don't count; confidence is the mean by length, 0..1. Words
    of a line, few, are joined in their order.
    """
    weight = F.greatest(F.lit(1), F.length("text"))
    own = words.where((F.length(F.trim("text")) > 0) & (F.col("confidence") >= 0))
    df = own.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), " ").alias("text"),
        (F.sum(F.col("confidence") * weight) / F.sum(weight) / 100).alias("confidence"),
        F.min("left").alias("left"),
        F.min("top").alias("top"),
        F.max(F.col("left") + F.col("width")).alias("right"),
        F.max(F.col("top") + F.col("height")).alias("bottom"),
    )
    return df.withColumn("confidence", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))) * 10_000 + 0.500001) / 10_000.0)


def _index(letters: Column) -> Column:
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))


def _name(i: Column) -> Column:
    """The letters of a column's number, up to three of them."""
    one = lambda k: F.char(65 + k)
    z = i - 1
    two = F.concat(one(F.floor(z / 26) - 1), one(z % 26))
    y = z - 702
    three = F.concat(one(F.floor(y / 676)), one(F.floor(y / 26) % 26), one(y % 26))
    return F.when(i <= 26, one(z)).when(i <= 702, two).otherwise(three)


def cells(reference: Column, most: int = MOST_CELLS) -> Column:
    """The cells of a range such as `A1:C3`, row by row, `most` at most; what isn't a range stands for itself."""
    part = lambda k: F.upper(F.regexp_extract(reference, r"^\$?([A-Za-z]{1,3})\$?([0-9]+):\$?([A-Za-z]{1,3})\$?([0-9]+)$", k))
    a, b, r1, r2 = _index(part(1)), _index(part(3)), part(2).try_cast("int"), part(4).try_cast("int")
    low, wide = F.least(a, b), F.greatest(a, b) - F.least(a, b) + 1
    count = F.least(F.lit(most), wide * (F.greatest(r1, r2) - F.least(r1, r2) + 1))
    named = F.transform(F.sequence(F.lit(0), count - 1), lambda n: F.concat(_name(low + n % wide), (F.least(r1, r2) + F.floor(n / wide)).cast("string")))
    return F.when(r1.isNotNull() & r2.isNotNull(), named).otherwise(F.array(reference))


def sampled_pages(total: Column, limit: int) -> Column:
    """Pages (from 0) of a preview: all if they fit, else the first and last three, four in the middle, then evenly spaced ones until there are `limit`."""
    span = lambda a, b: F.when(b > a, F.sequence(a.cast("int"), (b - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0)
    middle = F.floor(total / 2)
    base = F.array_distinct(F.concat(span(zero, F.least(F.lit(ENDS), total)), span(F.greatest(zero, total - ENDS), total), span(F.greatest(zero, middle - MIDDLE), F.least(total, middle + MIDDLE))))
    room = F.greatest(zero, F.lit(limit) - F.size(base))
    step = F.greatest(F.lit(1), F.floor(total / F.greatest(F.lit(1), room + 1))).cast("int")
    spaced = F.when(step < total, F.sequence(step, (total - 1).cast("int"), step)).otherwise(F.array().cast("array<int>"))
    more = F.slice(F.array_except(spaced, base), F.lit(1), F.when(room > 0, room).otherwise(zero).cast("int"))
    whole = span(zero, F.least(total, F.lit(limit)))
    return F.when(total <= 0, F.array().cast("array<int>")).when(total <= limit, whole).otherwise(F.slice(F.sort_array(F.concat(base, more)), 1, limit))
