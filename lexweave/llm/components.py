"""Connected components by alternating large and small stars, as joins and aggregates, after local contraction."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored


class Groups:
    """Union by least member over positions."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            if not apart.any():
                return
            low, high = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(self.root, high, low)
            a, b = a[apart], b[apart]

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.root
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        self.root = root
        return root[x]


#: Edges that a task contracts at a time.
HELD_EDGES = 500_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components: each task turns the edges it holds into stars about their least nodes."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([b.column(c).to_numpy() for c in ("a", "b") for b in held]), return_inverse=True)
        groups = Groups(len(nodes))
        groups.join(*np.split(at, 2))
        root = groups.find(np.arange(len(nodes)))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])

    def local(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD_EDGES:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return edges.mapInArrow(local, "a bigint, b bigint")


def _at_once(edges: DataFrame) -> DataFrame:
    """Node and component of at most HELD_EDGES edges, all held by one task."""

    def named(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            nodes, at = np.unique(np.concatenate([b.column(c).to_numpy() for c in ("a", "b") for b in held]), return_inverse=True)
            groups = Groups(len(nodes))
            groups.join(*np.split(at, 2))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[groups.find(np.arange(len(nodes)))])], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(named, "node bigint, component bigint")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, salts: int) -> DataFrame:
    """Edges (a, b) with m, the least b of their a.

    An edge goes by (a, salt of b): a hub's edges are dealt over the salts, its least neighbour is found first in
    each salt and then over the salts that it has, and comes back to each (a, salt). With about sqrt(edges) salts
    neither step puts more than about the square root of the edges behind one key.
    """
    salted = edges.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(salts)).alias("s"))
    runs = salted.groupBy("a", "s").agg(F.min("b").alias("m"))
    least = runs.select("a", "s", F.min("m").over(Window.partitionBy("a")).alias("m"))
    return salted.join(least, ["a", "s"]).select("a", "b", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = 60, held: int = HELD_EDGES) -> DataFrame:
    """Node and component (the component's least node) for every node of an edge list.

    Edges are contracted where they stand before the first round. Every round's edges are stored, so a lost executor repeats one round at most; the round before is deleted. A
    round keeps the components and ends when the edges are stars about their least nodes; rounds grow with the
    logarithm of the nodes. A hub of any degree is dealt over many keys. Where no more than held edges (HELD_EDGES at
    most) are left by the first contraction, one task does the rest with the same result: a round is some ten
    exchanges, and for each of them the driver keeps a thread and its memory for a minute. Null nodes and loops are dropped; an
    empty edge list has no nodes.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
    now = stored(contracted(pairs).distinct(), "edges")
    before = _state(now)
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if before[0] <= min(held, HELD_EDGES):
        found = stored(_at_once(now), "components")
        discard(now)
        return found
    salts = math.isqrt(before[0]) + 1
    for _ in range(limit):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, salts).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = stored(large, "edges")
        small = _with_least(large, salts)
        # Neighbours that are not the least move under it; the node itself stays under it.
        moved = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after_edges = stored(moved.distinct(), "edges")
        discard(now)
        discard(large)
        now = after_edges
        after = _state(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {limit} rounds")
