"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is built from a bounded sample; every vector is put into one leaf. A query walks the tree
with a priority queue, by the inner product with a node's centre plus a part of its radius, and visits
as many leaves as a calibration against brute force over the sample asked for. Leaves are packed into
shards of bounded size. A leaf that is larger is dealt into parts, each of which has a tree of its own
over all its rows, so leaves multiply with the table. A shard skips leaves whose bound (centre's
product plus radius) lies below what a query has found there, and gives the best of the rest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import blocks, partitions, smallest_hashes, stored, table

NEAREST = 20
#: Bounds of the sample that the tree is built from.
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 8_000_000
BRANCHES, LEAF = 24, 80
#: Recall that the widening of visits is calibrated to, on CALIBRATED queries, and within the tree of a large leaf's part.
RECALL, CALIBRATED, PART_RECALL = 0.95, 200, 0.98
#: Shares of a node's radius that may count in the order of visits; calibration takes the cheapest.
REACHES = (0.0, 0.5, 1.0)
#: Rows of a shard, queries of a group that meets it, and queries that one task routes.
SHARD, GROUP, ROUTED = 4_096, 2_048, 1_024


class Tree:
    """Hierarchical k-means: inner nodes are numbered from 0, leaf i is the number -1 - i; each but the root has a centre and a radius."""

    def __init__(self, vectors: np.ndarray, seed: int = 5):
        self.children: list[list[int]] = []
        self.spans: list[tuple[int, int]] = []  # rows of `centres` that belong to an inner node's children
        self.leaves = 0
        self._centres: list[np.ndarray] = []
        self._radii: list[float] = []
        self._rng = np.random.default_rng(seed)
        self._build(vectors)
        self.centres = np.array(self._centres) if self._centres else np.zeros((0, vectors.shape[1]))
        self.radii = np.array(self._radii)
        del self._centres, self._radii, self._rng

    def _build(self, x: np.ndarray) -> int:
        label = self._split(x, min(BRANCHES, len(x) // 2)) if len(x) > LEAF else None
        if label is None or label.max() == 0:
            self.leaves += 1
            return -self.leaves
        here = len(self.children)
        self.children.append([])
        groups = [x[label == i] for i in range(label.max() + 1)]
        self.spans.append((len(self._centres), len(self._centres) + len(groups)))
        for g in groups:
            self._centres.append(g.mean(0))
            self._radii.append(float(np.linalg.norm(g - g.mean(0), axis=1).max()))
        self.children[here] = [self._build(g) for g in groups]
        return here

    def _split(self, x: np.ndarray, k: int) -> np.ndarray:
        centres = x[self._rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            label = (x @ centres.T * -2 + (centres**2).sum(1)).argmin(1)
            centres = np.array([x[label == i].mean(0) if (label == i).any() else centres[i] for i in range(k)])
        label = (x @ centres.T * -2 + (centres**2).sum(1)).argmin(1)
        return np.unique(label, return_inverse=True)[1]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.children and len(x) else []
        while todo:
            node, at = todo.pop()
            centres = self.centres[slice(*self.spans[node])]
            best = (x[at] @ centres.T * -2 + (centres**2).sum(1)).argmin(1)
            for i, child in enumerate(self.children[node]):
                own = at[best == i]
                if child < 0:
                    out[own] = -1 - child
                elif len(own):
                    todo.append((child, own))
        return out

    def best_first(self, q: np.ndarray, reach: float) -> Iterator[int]:
        """Leaves as a priority queue opens them: by the centres' inner product with q plus `reach` times what a radius can add."""
        if not self.children:
            yield 0
            return
        value = (-(self.centres @ q) - reach * float(np.linalg.norm(q)) * self.radii).tolist()
        queue: list[tuple[float, int]] = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            for at, child in enumerate(self.children[node], self.spans[node][0]):
                heapq.heappush(queue, (value[at], child))


def valid(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def calibrate(tree: Tree, sample: np.ndarray, nearest: int, recall: float = RECALL, most: int = CALIBRATED) -> tuple[int, float]:
    """The number of leaves to visit, widened until the recall over the sample is reached, and the share of radii that needs the fewest rows for it."""
    leaf, queries = tree.leaf_of(sample), np.arange(0, len(sample), max(1, len(sample) // most))
    k = min(nearest, len(sample) - 1)
    if k < 1:
        return 1, 0.0
    size = np.bincount(leaf, minlength=tree.leaves)
    true = []
    for i in queries:
        scores = sample @ sample[i]
        scores[i] = -np.inf
        true.append(leaf[np.argpartition(-scores, k - 1)[:k]])
    found = []
    for reach in REACHES:
        need, rows = [], []
        for i, wanted in zip(queries, true, strict=True):
            order = np.fromiter(tree.best_first(sample[i], reach), np.int64, tree.leaves)
            rank = np.empty(tree.leaves, np.int64)
            rank[order] = np.arange(1, tree.leaves + 1)
            need.append(rank[wanted])
            rows.append(np.cumsum(size[order]))
        need, rows, visits = np.array(need), np.array(rows), 1
        while (need <= visits).mean() < recall and visits < tree.leaves:
            visits = min(tree.leaves, max(visits + 1, visits * 9 // 8))
        found.append((float(rows[:, visits - 1].mean()), visits, reach))
    _, visits, reach = min(found)
    return visits, reach


def share_scored(tree: Tree, visits: int, reach: float, vectors: np.ndarray, queries: np.ndarray) -> float:
    """The share of vectors that lie in the leaves which a query visits, on average."""
    size = np.bincount(tree.leaf_of(vectors), minlength=tree.leaves)
    return float(np.mean([sum(size[x] for x in _first(tree.best_first(q, reach), visits)) for q in queries])) / max(len(vectors), 1)


def nearest_in(x: np.ndarray, ids: np.ndarray, leaf: np.ndarray, wanted: list[list[int]], q: np.ndarray, own: np.ndarray, nearest: int, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and products of each query's `nearest` best among the rows of its wanted leaves, ties to smaller ids.

    Queries of one best leaf go together. What they find there bounds them from below, and leaves whose
    centre's product plus radius is less are skipped.
    """
    order = np.argsort(leaf, kind="stable")
    names, first, size = np.unique(leaf[order], return_index=True, return_counts=True)
    x, ids = x[order], ids[order]
    at = np.repeat(np.arange(len(names)), size)
    centre = np.add.reduceat(x, first, axis=0) / size[:, None]
    radius = np.maximum.reduceat(np.linalg.norm(x - centre[at], axis=1), first)
    bound = q @ centre.T + np.linalg.norm(q, axis=1)[:, None] * radius
    bound += 1e-9 * (1 + np.abs(bound))  # rounding may put a product a little above its bound
    rows = np.repeat(np.arange(len(q)), [len(w) for w in wanted])
    leaves = np.array([n for w in wanted for n in w], np.int64)
    place = np.minimum(np.searchsorted(names, leaves), len(names) - 1)
    here = names[place] == leaves
    want = np.zeros(bound.shape, bool)
    want[rows[here], place[here]] = True
    bound[~want] = -np.inf
    best = bound.argmax(1)
    found = []
    by_leaf = np.argsort(best, kind="stable")
    for start in range(0, len(q), block):
        some = by_leaf[start : start + block]
        least = np.full(len(some), -np.inf)
        for n in np.unique(best[some]).tolist():
            mine = np.flatnonzero(best[some] == n)
            span = slice(first[n], first[n] + size[n])
            if size[n] > nearest:
                value = q[some[mine]] @ x[span].T
                value[ids[span][None, :] == own[some[mine]][:, None]] = -np.inf
                least[mine] = np.partition(value, size[n] - nearest, axis=1)[:, size[n] - nearest]
        open_ = want[some] & (bound[some] >= least[:, None])
        used = np.flatnonzero(open_.any(0)[at])
        if not len(used):
            continue
        value = q[some] @ x[used].T
        value[~open_[:, at[used]] | (ids[used][None, :] == own[some][:, None])] = -np.inf
        if len(used) > nearest:
            edge = np.partition(value, len(used) - nearest, axis=1)[:, len(used) - nearest]
        else:
            edge = np.full(len(some), -np.inf)
        row, column = np.nonzero((value >= edge[:, None]) & (value > -np.inf))
        value, id_ = value[row, column], ids[used][column]
        sort = np.lexsort((id_, -value, row))
        row, value, id_ = row[sort], value[sort], id_[sort]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < nearest
        found.append((own[some][row[keep]], id_[keep], value[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def search(vectors: DataFrame, id_: str, vector: str, is_query: Column, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the `nearest` best rows found for each query, its own id left out.

    is_query is over the column `id`. Null ids and vectors that are not `valid` take no part. Each length of
    vectors has a tree of its own and is searched apart. A query id that occurs several times is answered
    once, for the smallest of its vectors; repeated candidates count as often as they occur. Ties go
    to the smaller id. Without queries or candidates the result is empty.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & valid(F.col(vector)))
    base = stored(base.withColumn("n", F.size("v")), "ann-valid")
    schema = "query_id long, rank int, vec_id long, score double"
    queries = base.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    lengths = base.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").collect()
    found = [_search(base.where(F.col("n") == r["n"]).drop("n"), queries.where(F.size("v") == r["n"]), r["n"], r["c"], nearest) for r in lengths]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def _search(base: DataFrame, queries: DataFrame, length: int, count: int, nearest: int) -> DataFrame:
    """The answers of queries (id, v) from base (id, v), `count` rows of vectors of one length."""
    spark = base.sparkSession
    rows = min(SAMPLE_ROWS, SAMPLE_VALUES // length + 1)
    sample = _matrix(smallest_hashes(base, count, rows, "id", "v").select("v").toArrow().column(0))
    tree = Tree(sample)
    visits, reach = calibrate(tree, sample, nearest)
    known = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = known.value.leaf_of(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], ["id", "v", "leaf"])

    kind = base.schema["v"].dataType.simpleString()
    placed = stored(base.mapInArrow(assign, f"id long, v {kind}, leaf long"), "ann-placed")

    # One count a leaf comes to the driver; the tree's size, and so theirs, is bounded by the sample's.
    counts = dict.fromkeys(range(tree.leaves), 0) | {r[0]: r[1] for r in placed.groupBy("leaf").count().collect()}
    first, parts, shard, filled = {}, {}, 0, 0
    for leaf in range(tree.leaves):
        if filled and filled + counts[leaf] > SHARD:
            shard, filled = shard + 1, 0
        first[leaf], parts[leaf] = shard, blocks(counts[leaf], SHARD)
        filled += counts[leaf]
        if parts[leaf] > 1:
            shard, filled = shard + parts[leaf], 0
    plan = spark.sparkContext.broadcast((counts, first, parts))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, parts = plan.value
        for batch in batches:
            leaf = batch.column(2).to_pylist()
            own = [first[x] + (i * 2654435761 + r * 40503 >> 7) % parts[x] for r, (x, i) in enumerate(zip(leaf, batch.column(0).to_pylist(), strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *batch.columns], ["shard", "id", "v", "leaf"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, first, parts = plan.value
        for batch in batches:
            q = _matrix(batch.column(1))
            shards, ids, at, leaves = [], [], [], []
            for row in range(len(q)):
                wanted: dict[int, list[int]] = {}
                held = 0
                for n, leaf in enumerate(known.value.best_first(q[row], reach), 1):
                    for part in range(parts[leaf]):
                        wanted.setdefault(first[leaf] + part, []).append(leaf)
                    held += counts[leaf]
                    if n >= visits and held > nearest:
                        break
                for s, own in wanted.items():
                    shards.append(s)
                    ids.append(batch.column(0)[row].as_py())
                    at.append(row)
                    leaves.append(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), pa.array(ids, pa.int64()), batch.column(1).take(pa.array(at, pa.int64())), pa.array(leaves, pa.list_(pa.int64()))],
                ["shard", "id", "v", "leaves"],
            )

    def best(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if own.num_rows and asked.num_rows:
            ids, x, leaf = own.column("id").to_numpy(), _matrix(own.column("v")), own.column("leaf").to_numpy()
            q, wanted = _matrix(asked.column("v")), asked.column("leaves").to_pylist()
            if plan.value[2][int(leaf[0])] > 1:
                # A part of a large leaf: the leaves of its own tree take the leaf's place.
                inner = Tree(x)
                widened, inner_reach = calibrate(inner, x, nearest, PART_RECALL, 100)
                leaf, wanted = inner.leaf_of(x), [_first(inner.best_first(v, inner_reach), widened) for v in q]
            found = nearest_in(x, ids, leaf, wanted, q, asked.column("id").to_numpy(), nearest)
        return pa.table([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    # An explicit number of tasks: routing is the dear part of a small table.
    dealt = queries.repartition(max(partitions(spark), blocks(queries.count(), ROUTED)), "id")
    asked = stored(dealt.mapInArrow(ask, f"shard long, id long, v {kind}, leaves array<long>"), "ann-asked")
    # The queries of a shard meet it in groups of bounded size, each with the shard's rows.
    groups = stored(asked.groupBy("shard").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")), "ann-groups")
    group = F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")
    asked = asked.join(groups, "shard").select("shard", group.alias("group"), "id", "v", "leaves")
    sharded = placed.mapInArrow(members, f"shard long, id long, v {kind}, leaf long").join(groups.withColumnRenamed("groups", "n"), "shard")
    sharded = sharded.select("shard", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("group"), "id", "v", "leaf")
    found = sharded.groupBy("shard", "group").cogroup(asked.groupBy("shard", "group")).applyInArrow(best, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def _first(leaves: Iterator[int], n: int) -> list[int]:
    return [x for x, _ in zip(leaves, range(n), strict=False)]


def op7_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)
