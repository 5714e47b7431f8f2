"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so a floor on the cosine is a radius. Vectors of one label are
sorted by their grid cells, as wide as the radius, on the leading principal dimensions, and cut into blocks;
FAN blocks that follow one another make an interval, FAN intervals the next larger one. Spark joins the
sequence with itself from the largest intervals down: pairs whose boxes lie further apart than the radius go,
the others are replaced by the pairs of their parts. The pairs of smallest intervals that remain are joined
in tasks, where blocks are skipped by their boxes, rows by a bound from principal dimensions and the length of the
rest, and what is left is decided by the cosine itself. A task reports degrees and components, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.llm.common import few, partitions, smallest_hashes, stored, table
from folioflow.llm.op09_simhash import connected

#: Fixed value of the contract.
LEAST_COSINE = 0.93
#: Rows that the principal dimensions are fitted on, at most; they only steer the order and the bounds, not the result.
SAMPLE = 8_192
#: Dimensions that order cells, that boxes have, and that the bound of two rows uses.
CELLS, BOX, BOUND = 4, 16, 24
#: Bytes of vectors in a block, most rows of one, and blocks of an interval as well as intervals of the next.
BLOCK_BYTES, BLOCK_ROWS, FAN = 256 << 10, 512, 16
#: Bounds give way by this much, so rounding never skips a pair.
SLACK = 1e-7
_PREPARED = "vec_id long, label {label}, dim int, digest binary, unit binary"


def _vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, places and matrix of the usable vectors of each length: no nulls, all finite, not zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    flat = column.flatten().cast(pa.float64())
    flat = np.asarray(flat.fill_null(np.nan)) if flat.null_count else np.asarray(flat)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        own = flat[begin[at][:, None] + np.arange(dim)]
        good = np.isfinite(own).all(1) & (own != 0).any(1)
        if good.any():
            yield dim, at[good], own[good]


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so nothing overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def prepared(rows: DataFrame) -> DataFrame:
    """vec_id, label, and for rows that can link dim, digest and unit (float64 bytes); equal vectors have equal digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            dims, digests, raws = np.zeros(n, object), [None] * n, [None] * n
            dims[:] = None
            labelled = np.asarray(batch.column(2).is_valid())
            for dim, at, x in _vectors(batch.column(1)):
                for i, own, unit in zip(at.tolist(), x + 0.0, units(x), strict=True):
                    if labelled[i]:
                        dims[i], digests[i], raws[i] = dim, hashlib.blake2b(own.tobytes(), digest_size=16).digest(), unit.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(dims.tolist(), pa.int32()), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "label", "dim", "digest", "unit"])

    kind = rows.schema["label"].dataType.simpleString()
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    return own.mapInArrow(run, _PREPARED.format(label=kind))


def principal(sample: pa.Table) -> dict[int, np.ndarray]:
    """For each length of the sample an orthonormal basis, principal dimensions first."""
    bases, raws = {}, sample.column("unit").to_pylist()
    dims = sample.column("dim").to_numpy() if len(sample) else np.zeros(0, int)
    for dim in np.unique(dims).tolist():
        x = np.stack([np.frombuffer(raws[i], np.float64) for i in np.flatnonzero(dims == dim)])
        x = x - x.mean(0)
        bases[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return bases


def projected(unit: np.ndarray, bases: dict[int, np.ndarray], first: int) -> np.ndarray:
    """The first principal coordinates, zeros where the vectors have fewer; a length that has no basis keeps its own axes."""
    basis = bases.get(unit.shape[1])
    y = unit[:, :first] if basis is None else unit @ basis[:, :first]
    return np.pad(y, ((0, 0), (0, first - y.shape[1])))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    dims, raws = np.asarray(batch.column("dim")), batch.column("unit").to_pylist()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield at, np.frombuffer(b"".join(raws[i] for i in at), np.float64).reshape(len(at), dim)


def _blocks(classes: DataFrame, shared, width: float) -> DataFrame:
    """The grid order, cut: one row a block with its part and place, its rows packed, and the box of its projections."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, CELLS), np.int32)
            for at, unit in _by_dim(batch):
                found[at] = np.floor(projected(unit, shared.value, CELLS) / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(found[:, k]) for k in range(CELLS)]], [*batch.schema.names, *[f"c{k}" for k in range(CELLS)]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    order = ["label", "dim", *[f"c{k}" for k in range(CELLS)], "node"]
    placed = classes.mapInArrow(cells, f"{schema}, " + ", ".join(f"c{k} int" for k in range(CELLS)))
    # The node breaks all ties, so a crowded cell is spread over parts like any other rows.
    placed = placed.repartitionByRange(partitions(classes.sparkSession), *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, place = [], None, 0

        def block() -> pa.RecordBatch:
            unit = np.frombuffer(b"".join(r["unit"] for r in held), np.float64).reshape(len(held), -1)
            y = projected(unit, shared.value, BOX)
            row = {"label": key[0], "dim": key[1], "part": held[0]["part"], "place": place, "rows": len(held)}
            row |= {"nodes": np.array([r["node"] for r in held], np.int64).tobytes(), "copies": np.array([r["n"] for r in held], np.int64).tobytes(), "units": unit.tobytes()}
            row |= {"low": y.min(0).tolist(), "high": y.max(0).tolist()}
            return pa.RecordBatch.from_pylist([row], schema=target)

        for batch in batches:
            for r in batch.to_pylist():
                if held and ((r["label"], r["dim"]) != key or len(held) >= max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * r["dim"])))):
                    yield block()
                    held, place = [], place + 1
                key = (r["label"], r["dim"])
                held.append(r)
        if held:
            yield block()

    label = classes.schema["label"].dataType
    out = f"label {label.simpleString()}, dim int, part int, place long, rows int, nodes binary, copies binary, units binary, low array<double>, high array<double>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(out))
    return placed.select("label", "dim", "node", "n", "unit", F.spark_partition_id().alias("part")).mapInArrow(cut, out)


def _box(df: DataFrame, *keys: str) -> DataFrame:
    sides = [f(F.col(side)[k]).alias(f"{side}{k}") for side, f in (("low", F.min), ("high", F.max)) for k in range(BOX)]
    made = df.groupBy(*keys).agg(*sides)
    return made.select(*keys, *[F.array(*[f"{side}{k}" for k in range(BOX)]).alias(side) for side in ("low", "high")])


def _near(radius: float):
    """Whether the boxes of x and y come within the radius of each other."""
    gap = lambda k: F.greatest(F.col("x.low")[k] - F.col("y.high")[k], F.col("y.low")[k] - F.col("x.high")[k], F.lit(0.0))
    return sum((gap(k) ** 2 for k in range(BOX)), F.lit(0.0)) <= radius**2 + SLACK


def interval_pairs(blocks: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """The blocks with the smallest interval of each, and the pairs (a <= b) of smallest intervals that may hold links.

    Blocks are numbered within a label and length by sums over the parts of the order. Levels are as many as
    FAN needs to reach one interval a label. A level's pairs come of the pairs of the level above.
    """
    keys = ["label", "dim"]
    parts = blocks.groupBy(*keys, "part").agg(F.count("*").alias("count"), F.min("place").alias("from"))
    before = F.sum("count").over(W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = few(parts.withColumn("offset", F.coalesce(before, F.lit(0)) - F.col("from")).select(*keys, "part", "offset"))
    numbered = blocks.join(offsets, [*keys, "part"]).withColumn("i0", F.floor((F.col("offset") + F.col("place")) / FAN).cast("long"))
    level = stored(few(_box(numbered, *keys, "i0").withColumnRenamed("i0", "i")), "ego-level")
    levels = [level]
    while (levels[-1].agg(F.max("i")).first()[0] or 0) > 0:
        up = levels[-1].withColumn("up", F.floor(F.col("i") / FAN).cast("long"))
        levels.append(stored(few(_box(up, *keys, "up").withColumnRenamed("up", "i")), "ego-level"))
    pairs = levels.pop().select(*keys, F.col("i").alias("a"), F.col("i").alias("b"))
    for level in reversed(levels):
        below = level.select(*keys, F.floor(F.col("i") / FAN).cast("long").alias("up"), F.struct("i", "low", "high").alias("own"))
        left = below.select(*keys, F.col("up").alias("a"), F.col("own").alias("x"))
        right = below.select(*keys, F.col("up").alias("b"), F.col("own").alias("y"))
        found = pairs.join(left, [*keys, "a"]).join(right, [*keys, "b"]).where((F.col("x.i") <= F.col("y.i")) & _near(radius))
        pairs = stored(found.select(*keys, F.col("x.i").alias("a"), F.col("y.i").alias("b")), "ego-pairs")
    return numbered, pairs


class _Side:
    """The blocks of one interval: their rows one after another, what bounds them, and boxes over runs of blocks."""

    def __init__(self, rows: list[dict], bases: dict[int, np.ndarray]):
        self.unit = np.concatenate([np.frombuffer(r["units"], np.float64).reshape(r["rows"], r["dim"]) for r in rows])
        self.nodes = np.concatenate([np.frombuffer(r["nodes"], np.int64) for r in rows])
        self.copies = np.concatenate([np.frombuffer(r["copies"], np.int64) for r in rows])
        self.ends = np.cumsum([0, *(r["rows"] for r in rows)])
        self.low, self.high = (np.array([r[c] for r in rows]) for c in ("low", "high"))
        y = projected(self.unit, bases, min(BOUND, self.unit.shape[1]))
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", y, y)))
        self.bound = np.column_stack([y, rest])


def _distant(a: _Side, x: tuple[int, int], b: _Side, y: tuple[int, int], radius: float) -> bool:
    low = np.maximum(a.low[x[0] : x[1]].min(0), b.low[y[0] : y[1]].min(0))
    high = np.minimum(a.high[x[0] : x[1]].max(0), b.high[y[0] : y[1]].max(0))
    return float((np.maximum(0.0, low - high) ** 2).sum()) > radius**2 + SLACK


def sequence_join(a: _Side, b: _Side, same: bool, least: float, emit) -> None:
    """emit(rows of a, rows of b) for all links of two intervals, or of one with itself, by halving both sequences."""
    radius = float(np.sqrt(2 - 2 * least))
    stack = [((0, len(a.low)), (0, len(b.low)))]
    while stack:
        x, y = stack.pop()
        if (same and x[0] >= y[1]) or _distant(a, x, b, y, radius):
            continue
        if x[1] - x[0] > 1 or y[1] - y[0] > 1:
            halves = lambda s: [s] if s[1] - s[0] == 1 else [(s[0], sum(s) // 2), (sum(s) // 2, s[1])]
            stack += [(p, q) for p in halves(x) for q in halves(y)]
            continue
        at, bt = int(a.ends[x[0]]), int(b.ends[y[0]])
        # No cosine exceeds the product over the leading dimensions plus that of what the rest can give at most.
        i, j = np.nonzero(a.bound[at : a.ends[x[1]]] @ b.bound[bt : b.ends[y[1]]].T >= least - SLACK)
        i, j = i + at, j + bt
        if same:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            hit = np.einsum("ij,ij->i", a.unit[p], b.unit[q]) >= least
            if hit.any():
                emit(p[hit], q[hit])


class _Links:
    """Degrees and components over the rows of a task's two intervals, from links as they come."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray):
        self.copies, self.degree, self.label = copies, np.zeros(len(nodes), np.int64), np.arange(len(nodes))

    def __call__(self, p: np.ndarray, q: np.ndarray) -> None:
        self.degree += np.bincount(p, self.copies[q], len(self.degree)).astype(np.int64) + np.bincount(q, self.copies[p], len(self.degree)).astype(np.int64)
        while True:
            x, y = self.label[p], self.label[q]
            apart = x != y
            if not apart.any():
                return
            np.minimum.at(self.label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(self.label, jumped := self.label[self.label]):
                self.label = jumped


def near_vectors(rows: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id for each row of rows (vec_id, embedding, label).

    Rows are compared where labels are equal and not null, by the cosine in double precision; a vector that is null,
    empty, zero or holds a null or non-finite component links with nothing, nor do vectors of different lengths.
    Equal vectors are one class with a count, and repeated rows link with one another. A row without vec_id takes part,
    and is never the smallest unless its component has no other. Other columns are ignored, an empty table gives an empty one.
    """
    spark, radius = rows.sparkSession, float(np.sqrt(2 - 2 * least))
    each = stored(prepared(rows), "ego-rows")
    keys = ["label", "dim", "digest"]
    usable = each.where("digest is not null")
    classes = usable.groupBy(*keys).agg(F.count("*").alias("n"), F.min("vec_id").alias("lowest"), F.first("unit").alias("unit"))
    # Numbers of the classes hold once they are written.
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "ego-classes")
    sample = smallest_hashes(classes.select("digest", "dim", "unit"), classes.count(), SAMPLE, "digest").toArrow()
    shared = spark.sparkContext.broadcast(principal(sample))
    blocks = stored(_blocks(classes, shared, radius), "ego-blocks")
    numbered, pairs = interval_pairs(blocks, radius)
    sent = ["rows", "nodes", "copies", "units", "low", "high"]
    sides = [numbered.select("label", "dim", F.col("i0").alias(c), F.lit(c).alias("side"), "part", "place", *sent) for c in "ab"]
    routed = [pairs.join(s, ["label", "dim", s.columns[2]]).select("label", "dim", "a", "b", "side", "part", "place", *sent) for s in (sides[0], sides[1].where("true"))]
    routed[1] = routed[1].where("a <> b")

    def search(group: pa.Table) -> pa.Table:
        listed = group.sort_by([("side", "ascending"), ("part", "ascending"), ("place", "ascending")]).to_pylist()
        own = [[r for r in listed if r["side"] == s] for s in "ab"]
        a = _Side(own[0], shared.value)
        b = _Side(own[1], shared.value) if own[1] else a
        split = len(a.nodes) if own[1] else 0
        nodes = np.concatenate([a.nodes, b.nodes]) if own[1] else a.nodes
        links = _Links(nodes, np.concatenate([a.copies, b.copies]) if own[1] else a.copies)
        sequence_join(a, b, not own[1], least, lambda p, q: links(p, q + split))
        hit = np.flatnonzero(links.degree)
        return pa.table([pa.array(nodes[hit]), pa.array(links.degree[hit]), pa.array(nodes[links.label[hit]])], names=["node", "links", "root"])

    found = stored(routed[0].union(routed[1]).groupBy("label", "dim", "a", "b").applyInArrow(search, "node long, links long, root long"), "ego-links")
    components = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select(*keys, "n", "lowest", "node").join(degrees, "node", "left").join(components, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named, "ego-named")
    lowest = named.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = named.join(lowest, "root").select(*keys, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = usable.select("vec_id", *keys).join(named, keys).select("vec_id", "n_links", "component_id")
    lone = each.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(lone)


def op12_egojoin(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE = """
with recursive e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
g as (select vec_id, label, v, sqrt(list_inner_product(v, v)) as norm from e where label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach as (select vec_id as a, vec_id as b from e union select reach.a, p.b from reach join p on p.a = reach.b),
c as (select a, min(b) as c from reach group by a), n as (select a, count(*) as n from p group by a)
select vec_id, coalesce(n, 0) as n_links, c as component_id, vec_id = c as kept from e left join n on n.a = vec_id join c on c.a = vec_id
"""
