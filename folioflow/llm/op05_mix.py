"""Mixing sources to target weights by cube-method balanced sampling.

A source's documents start at equal inclusion probabilities. In the flight phase three documents of
fractional probability at a time move along the null vector of their source's constraints (number of
documents, number of words) until one is decided; blocks of bounded size fly apart, what each block
leaves (two documents at most) flies again with that of other blocks, until one block per source is
left, whose last two documents are the landing problem.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import stored, table

#: Fixed values of the mixing contract.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK = 512
_EDGE = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target for the table (source, source_size) of one row a source.

    Sources in the order of code points, null last, weigh `weights`, repeating. They share
    `share` times all sizes by weight; what lies above `most` times a source's size is reshared by
    weight among the others. That is one water level: a source gets min(cap, level * weight), with
    the level read off the sources ordered by cap / weight. Only sources are gathered, one row each.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("__full", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("__w", w).withColumn("__cap", most * F.col("source_size")).withColumn("__full", F.col("__cap") / F.col("__w"))
    df = df.withColumns(
        {
            "__total": share * F.sum("source_size").over(every),
            "__before": F.coalesce(F.sum("__cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "__left": F.sum("__w").over(full.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    df = df.withColumn("__level", (F.col("__total") - F.col("__before")) / F.col("__left"))
    # The first source that is not filled sets the level.
    df = df.withColumn("__level", F.min(F.when(F.col("__level") < F.col("__full"), F.struct("__full", "__level"))).over(every)["__level"])
    target = F.coalesce(F.least(F.col("__cap"), F.col("__level") * F.col("__w")), F.col("__cap")).cast("double")
    return df.select("source", "source_size", target.alias("target"))


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities until two fractional ones at most are left; their sum and their sum of sizes stay."""
    p = p.copy()
    open_ = [i for i in range(len(p)) if _EDGE < p[i] < 1 - _EDGE]
    held: list[int] = []
    scale = max(float(size.max(initial=0)), 1.0)
    while open_ or len(held) > 2:
        while len(held) < 3 and open_:
            held.append(open_.pop())
        if len(held) < 3:
            break
        a, b, c = (size[i] / scale for i in held)
        u = np.array([b - c, c - a, a - b])
        if not np.abs(u).max() > 1e-12:
            u = np.array([1.0, -1.0, 0.0])
        q = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
        q = q + (up if rng.random() * (up + down) < down else -down) * u
        q = np.where(q < _EDGE, 0.0, np.where(q > 1 - _EDGE, 1.0, q))
        p[held] = q
        held = [i for i in held if 0 < p[i] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last two: the choice whose sizes come nearest to what the probabilities promise."""
    at = np.flatnonzero((p > 0) & (p < 1))
    want = float((p[at] * size[at]).sum())
    choices = [[k >> i & 1 for i in range(len(at))] for k in range(1 << len(at))]
    p = p.copy()
    p[at] = min(choices, key=lambda x: (abs(float((np.array(x) * size[at]).sum()) - want), x)) if len(at) else 0
    return p


def _flight(last: bool) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        # Large documents fly first, so what is left to land is small.
        rows = rows.sort_by([("size", "ascending"), ("id", "ascending"), ("nth", "ascending")])
        p, size = rows.column("p").to_numpy(), rows.column("size").to_numpy().astype(np.float64)
        seed = [len(p), int(size.sum()) & 0x7FFFFFFF, int(rows.column("block")[0].as_py())]
        p = fly(p, size, np.random.default_rng(seed))
        if last:
            p = land(p, size)
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p))

    return run


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies long, taken long for each row of docs.

    The size of a null text is 0; such rows and empty texts take part in the count of documents. A
    null source is a source of its own, a null doc_id is allowed, repeated rows are documents of
    their own. Copies are 0, 1 or 2. Nothing depends on the order of rows, so reruns agree.
    An empty table gives an empty one.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long").alias("size"),
    )
    # Rows that agree get numbers, so that they spread over blocks like any others; they are summed up before they meet.
    same = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    rows = stored(same.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n"), "mix-sizes")
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__n"))
    goal = stored(targets(per.select("source", "source_size")).join(per.select(F.col("source").alias("__s"), "__n"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s"), "mix-targets")
    goal = goal.withColumnRenamed("source", "__source")
    joined = rows.join(goal, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + _EDGE)
    spread = lambda level: F.xxhash64("id", "size", "nth", F.lit(level))
    open_ = joined.select(
        F.col("doc_id").alias("id"),
        "nth",
        "source",
        "size",
        "source_size",
        "target",
        whole.cast("long").alias("whole"),
        F.greatest(ratio - whole, F.lit(0.0)).alias("p"),
        F.ceil(F.col("__n") / BLOCK).cast("long").alias("blocks"),
        F.lit(0).cast("long").alias("block"),
    )
    schema = open_.schema
    done = None
    level = 0
    while True:
        level += 1
        most = open_.agg(F.max("blocks")).first()[0] or 1
        last = most <= 1
        blocked = open_.withColumn("block", F.pmod(spread(level), F.greatest("blocks", F.lit(1))))
        flown = stored(blocked.groupBy("source", "block").applyInArrow(_flight(last), schema), f"mix-flight{level}")
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        decided = flown.where(~fractional)
        done = decided if done is None else done.union(decided)
        if last:
            break
        # Two rows at most are left of each block, so a level is a few hundred times smaller than the one before.
        open_ = flown.where(fractional).withColumn("blocks", F.when(F.col("blocks") <= 1, 1).otherwise(F.ceil(F.col("blocks") * 2 / BLOCK)).cast("long"))
    copies = F.col("whole") + F.col("p").cast("long")
    return done.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op5_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
