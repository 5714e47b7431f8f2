"""SimHash near-dedup by vantage-point trees over Hamming distance.

Of two fingerprints within RADIUS bits, one quarter of 16 bits differs in RADIUS // 4 bits at most, so
for RADIUS 3 in none. For each quarter a vantage-point tree, built over exact counts of the quarter's
values (65,536 at most), partitions all distinct fingerprints into shards; a fingerprint lives in one
shard of each and also queries each shard that its ball of radius RADIUS // 4 overlaps, by the triangle
inequality. A shard that is too large, since many fingerprints share a quarter, is split by the trees of
the other three quarters, of which one differs in RADIUS // 3 bits at most, again with queries to all
shards that the ball overlaps. Within a shard trees answer the queries exactly. A shard reports the
links' components, not the pairs; these are then connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import partitions, stored, table

RADIUS = 3
SHINGLE = 3
SEED = 42
QUARTERS, WIDTH = 4, 16
#: Fingerprints a shard is meant to hold, and how many times as many make it split further.
SHARD, OVERSIZE = 8_192, 16
#: Points of a leaf within a shard; points of one quarter's value that a tree of its own orders.
LEAF, CROWD = 64, 2_048
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's lower-cased 3-word shingles, repeats included; zero for none. Ties give 0 bits."""
    import xxhash

    words = (text or "").encode("utf-8").translate(_LOWER).split()  # at the six ASCII spaces
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    hash_ = xxhash.xxh64_intdigest
    total, count = np.zeros(64, np.int64), 0
    part: list[int] = []
    for shingle in shingles:
        part.append(hash_(shingle, SEED))
        if len(part) == 65_536:
            total, count, part = total + _ones(part), count + len(part), []
    if part:
        total, count = total + _ones(part), count + len(part)
    bits = np.packbits(total * 2 > count)
    return int.from_bytes(bits.tobytes(), "big")


def _ones(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp long (the fingerprint's bits as a signed number) and the columns of carry for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *carry])

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).mapInArrow(run, "doc_id long, fp long" + kinds)


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def quarter(fp: np.ndarray, which: int) -> np.ndarray:
    return (fp >> np.uint64(WIDTH * which)) & np.uint64((1 << WIDTH) - 1)


class VantageTree:
    """A vantage-point tree over unsigned integers: left of a node is what lies within its radius of its vantage point.

    A node of more than `leaf` weight splits, unless its points are equal.
    """

    def __init__(self, points: np.ndarray, leaf: int, rng: np.random.Generator, weights: np.ndarray | None = None):
        self.nodes: list[tuple] = []  # (vantage, radius, left, right) or (None, places, number of the leaf)
        self.leaves = 0
        self.weights = np.ones(len(points)) if weights is None else weights.astype(np.float64)
        self._build(points, np.arange(len(points)), leaf, rng)
        del self.weights

    def _build(self, points: np.ndarray, at: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        here = len(self.nodes)
        self.nodes.append(())
        weight = self.weights[at]
        total = weight.sum()
        if total > leaf and len(at) > 1:
            # The most even split whose boundary few points are near; the heaviest point is a candidate, so a hot one can be split off.
            best = None
            for vantage in points[at[np.append(rng.integers(0, len(at), 7), weight.argmax())]]:
                d = distance(points[at], vantage).astype(np.int64)
                counts = np.bincount(d, weight, minlength=66)
                upto = np.cumsum(counts)
                near = counts + np.append(counts[1:], 0)
                for radius in np.flatnonzero((upto > 0) & (upto < total) & (counts > 0)):
                    uneven = abs(upto[radius] * 2 - total)
                    key = (uneven > 0.4 * total, near[radius] if uneven <= 0.4 * total else uneven, uneven)
                    if best is None or key < best[0]:
                        best = (key, vantage, int(radius), d)
            if best:
                _, vantage, radius, d = best
                left = self._build(points, at[d <= radius], leaf, rng)
                right = self._build(points, at[d > radius], leaf, rng)
                self.nodes[here] = (vantage, radius, left, right)
                return here
        self.nodes[here] = (None, at, self.leaves)
        self.leaves += 1
        return here

    def bare(self) -> VantageTree:
        """Without the places in the leaves, to send it to others."""
        self.nodes = [(None, None, n[2]) if n[0] is None else n for n in self.nodes]
        return self

    def homes(self, queries: np.ndarray) -> np.ndarray:
        """The leaf that each query lies in."""
        out = np.zeros(len(queries), np.int64)
        for (_, _, leaf), at in self.visit(queries, 0):
            out[at] = leaf
        return out

    def visit(self, queries: np.ndarray, reach: int) -> Iterator[tuple[tuple, np.ndarray]]:
        """Each leaf with the places of the queries whose ball of that reach may overlap it."""
        todo = [(0, np.arange(len(queries)))] if len(queries) else []
        while todo:
            node, at = todo.pop()
            own = self.nodes[node]
            if own[0] is None:
                yield own, at
                continue
            d = distance(queries[at], own[0]).astype(np.int64)
            for child, mask in ((own[2], d - reach <= own[1]), (own[3], d + reach > own[1])):
                if mask.any():
                    todo.append((child, at[mask]))


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Connect the places a[i] and b[i]: a label is the smallest place that is reached so far."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            return label


def shard_components(members: np.ndarray, visitors: np.ndarray, which: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that have a link in this shard, and for each the smallest of its component here.

    A link has one end among the members, and differs in reach // QUARTERS bits of the quarter `which` at most.
    """
    points = np.concatenate([members, visitors])
    state = {"label": np.arange(len(points)), "held": 0}
    held_a, held_b = [], []

    def link() -> None:
        if held_a:
            state["label"] = join_labels(state["label"], np.concatenate(held_a), np.concatenate(held_b))
            held_a.clear(), held_b.clear()
            state["held"] = 0

    def compare(places: np.ndarray, at: np.ndarray) -> None:
        step = max(1, (1 << 22) // max(len(places), 1))
        for start in range(0, len(at), step):
            part = at[start : start + step]
            x, y = np.nonzero(distance(points[part][:, None], members[places][None, :]) <= reach)
            a, b = part[x], places[y]
            some = a != b
            held_a.append(a[some])
            held_b.append(b[some])
            state["held"] += int(some.sum())
            if state["held"] > 500_000:
                link()

    own = quarter(members, which)
    values, at, counts = np.unique(own, return_inverse=True, return_counts=True)
    tree = VantageTree(values, LEAF, np.random.default_rng(1), counts)
    order = np.argsort(at, kind="stable")
    ends = np.concatenate([[0], np.cumsum(counts)])
    for (_, kinds, _), asking in tree.visit(quarter(points, which), reach // QUARTERS):
        places = np.concatenate([order[ends[k] : ends[k + 1]] for k in kinds])
        if len(places) <= CROWD:
            compare(places, asking)
            continue
        # Many fingerprints share the quarter: a tree over all bits.
        crowd = VantageTree(members[places], LEAF, np.random.default_rng(2))
        for (_, inner, _), near in crowd.visit(points[asking], reach):
            compare(places[inner], asking[near])
    link()
    root = state["label"]
    linked = np.flatnonzero(root != np.arange(len(points)))
    return points[linked], points[root[linked]]


def links(distinct: DataFrame, reach: int = RADIUS) -> DataFrame:
    """a, b: edges among the distinct fingerprints `fp` whose components are those of all pairs within reach.

    The driver sees one count for each value of each quarter, 4 * 65,536 at most, and one for each of the
    trees' leaves, which are fewer. A fingerprint is sent once for each quarter, and more often where
    its ball overlaps shards only if its shard is oversize or reach is above 3.
    """
    spark = distinct.sparkSession
    fp = F.col("fp")
    part = lambda k: F.shiftrightunsigned(fp, WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1))
    values = distinct.select(F.posexplode(F.array(*[part(k) for k in range(QUARTERS)])).alias("k", "v")).groupBy("k", "v").count().toArrow().sort_by([("k", "ascending"), ("v", "ascending")])
    kind, value, times = (values.column(c).to_numpy() for c in ("k", "v", "count"))
    count = int(times[kind == 0].sum())
    shards = max(count // SHARD + 1, min(partitions(spark), count // 512 + 1))
    trees, large = [], []
    for k in range(QUARTERS):
        own, weight = value[kind == k].astype(np.uint64), times[kind == k]
        tree = VantageTree(own, max(2, count // shards), np.random.default_rng(k), weight)
        held = np.bincount(tree.homes(own), weight, tree.leaves)
        trees.append(tree.bare())
        large.append(held > OVERSIZE * SHARD)
    shared = spark.sparkContext.broadcast((trees, large))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, large = shared.value
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            homes = [tree.homes(quarter(fp, k)) for k, tree in enumerate(trees)]
            for k in range(QUARTERS):
                for (_, _, leaf), at in trees[k].visit(quarter(fp, k), reach // QUARTERS):
                    if not large[k][leaf]:
                        yield _sent((k, leaf, k, 0), fp[at], homes[k][at] == leaf)
                        continue
                    for other in set(range(QUARTERS)) - {k}:
                        for (_, _, inner), near in trees[other].visit(quarter(fp[at], other), reach // (QUARTERS - 1)):
                            yield _sent((k, leaf, other, inner + 1), fp[at][near], (homes[k][at][near] == leaf) & (homes[other][at][near] == inner))

    def search(rows: pa.Table) -> pa.Table:
        # Repeats come of a retried batch only; one is enough.
        own = np.unique(rows.filter(rows.column("member")).column("fp").to_numpy().view(np.uint64))
        others = np.unique(rows.filter(pc.invert(rows.column("member"))).column("fp").to_numpy().view(np.uint64))
        a, b = shard_components(own, others, rows.column("k")[0].as_py(), reach)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    routed = distinct.select("fp").mapInArrow(route, "k int, leaf int, other int, inner int, fp long, member boolean")
    return routed.groupBy("k", "leaf", "other", "inner").applyInArrow(search, "a long, b long")


def _sent(shard: tuple[int, int, int, int], fp: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
    keys = [pa.array(np.full(len(fp), x, np.int32)) for x in shard]
    return pa.RecordBatch.from_arrays([*keys, pa.array(fp.view(np.int64)), pa.array(member)], ["k", "leaf", "other", "inner", "fp", "member"])


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component of each node that has an edge, by alternating large and small stars.

    Each round is written to the shared folder; a round is two aggregations and joins, no list of
    neighbours is ever gathered. Rounds grow with the logarithm of a component's size.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.select("u", F.col("m").alias("v")).union(near.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, reach: int = RADIUS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, component_id for each row of docs: the smallest doc_id reachable over links of `reach` bits or fewer.

    Null and empty texts have fingerprint zero. A null doc_id takes part and is never the smallest
    unless a component has no other. Repeated rows stay repeated, other columns are ignored, an
    empty table gives an empty one. With carry its columns come along, and root, the component's own key.
    """
    prints = stored(fingerprints(docs, carry), "simhash")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = connected(links(distinct, reach))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(named.join(lowest, "root").select("fp", "component_id", "root"), "simhash-components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", *carry, *(["root"] if carry else []))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
