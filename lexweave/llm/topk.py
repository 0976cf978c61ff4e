"""Exact top-k inner-product search: a ball tree for each shard, branch and bound with a shared kth score.

Vectors become integers floor(1024 * x), so that scores are exact. Candidates are dealt into shards of bounded
size; a task reads a shard's rows, builds its ball tree once, and then reads the queries, block by block. A node
with centre c and radius r cannot hold a score above q.c + |q| r; a query walks down to a leaf by the child with the
higher bound first, and then through the tree, skipping nodes whose bound is below the kth score that it holds. Shards are searched in rounds, the
first alone and each later round GROWTH times as many as there were before it; the kth scores found so far start
the search of the next round.

Queries against candidates is a stated query set against all rows, in blocks: work grows with their product, less
what the bounds skip. Vectors in clusters let most nodes be skipped. Vectors that point evenly in all directions
of a high dimension let none: a ball round any few of them reaches as far as the kth score, and the search is a
blocked product with all rows.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do vectors of
different lengths against each other; ties go to the smaller id; a query never returns its own id; the rows
of a repeated id are candidates each, and as a query the id counts once, with its least vector; fewer than k
candidates give fewer rows; rows without an id take no part; an empty table gives no row. Scores are exact up to the range of a long; a vector
with a component beyond 2**25 / 1024 is compared in Python integers and its scores are clipped to that range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
LEAF_ROWS = 48
SHARD_ROWS = 16384
BLOCK_ROWS = 1024
#: Tasks of a round, at most.
MOST_TASKS = 32768
#: Shards of a round for each shard searched before it.
GROWTH = 3
LEAST = np.iinfo(np.int64).min


def finite(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


class BallTree:
    """Nodes over the rows of a matrix; each has a centre, a radius, a row range and maybe two children."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(vectors))
        self.vectors = vectors
        self.centres, self.radii, self.ranges, self.children = [], [], [], []
        self._build(0, len(vectors), leaf)
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)
        self.left, self.right = np.array([c or (-1, -1) for c in self.children], np.int64).reshape(-1, 2).T

    def _build(self, begin: int, end: int, leaf: int) -> int:
        node = len(self.centres)
        own = self.vectors[self.order[begin:end]]
        centre = own.mean(0)
        away = np.sqrt(((own - centre) ** 2).sum(1))
        self.centres.append(centre)
        self.radii.append(away.max())
        self.ranges.append((begin, end))
        self.children.append(None)
        if end - begin > leaf and away.max() > 0:
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(1).argmax()]
            along = own @ (other - one)
            middle = (end - begin) // 2
            self.order[begin:end] = self.order[begin:end][np.argpartition(along, middle, kind="introselect")]
            self.children[node] = (self._build(begin, begin + middle, leaf), self._build(begin + middle, end, leaf))
        return node


class Search:
    """The k best rows of a tree for a block of queries."""

    def __init__(self, tree: BallTree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray):
        self.tree, self.ids, self.queries, self.own, self.k = tree, ids, queries, own, k
        self.scores = np.full((len(queries), k), LEAST, np.int64)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
        self.least, self.floor = floor, floor.astype(np.float64)
        norms = np.sqrt((queries**2).sum(1))
        self.bounds = queries @ tree.centres.T + norms[:, None] * tree.radii[None, :]
        self.bounds += 1e-9 * np.abs(self.bounds) + 1e-9 * norms[:, None] * (np.sqrt((tree.centres**2).sum(1)) + tree.radii)[None, :] + 1e-6
        self.visited = 0
        self.first = np.zeros(len(queries), np.int64)
        if len(ids):
            self._descend()
            self._visit(0, np.arange(len(queries)))

    def _kth(self, active: np.ndarray) -> np.ndarray:
        return np.maximum(self.floor[active], self.scores[active, -1].astype(np.float64))

    def _descend(self) -> None:
        """Every query looks into the leaf that it reaches by the child with the higher bound, so that it holds k scores early."""
        every = np.arange(len(self.queries))
        while True:
            inner = self.tree.left[self.first] >= 0
            if not inner.any():
                break
            at, q = self.first[inner], every[inner]
            left, right = self.tree.left[at], self.tree.right[at]
            self.first[inner] = np.where(self.bounds[q, left] >= self.bounds[q, right], left, right)
        for leaf in np.unique(self.first):
            self._leaf(leaf, every[self.first == leaf])

    def _visit(self, node: int, active: np.ndarray) -> None:
        """The rest of the tree, all queries of a block that a node cannot be skipped for at a time."""
        active = active[self.bounds[active, node] >= self._kth(active)]
        if not len(active):
            return
        left, right = self.tree.left[node], self.tree.right[node]
        if left < 0:
            self._leaf(node, active[self.first[active] != node])
            return
        near = self.bounds[active, left].sum() >= self.bounds[active, right].sum()
        for child in (left, right) if near else (right, left):
            self._visit(child, active)

    def _leaf(self, node: int, active: np.ndarray) -> None:
        if not len(active):
            return
        begin, end = self.tree.ranges[node]
        rows = self.tree.order[begin:end]
        self.visited += len(rows) * len(active)
        new = exact_products(self.queries[active], self.tree.vectors[rows])
        ids = np.broadcast_to(self.ids[rows], new.shape)
        new = np.where(ids == self.own[active][:, None], LEAST, new)
        # Most leaves have nothing for most queries once these hold k rows.
        hit = (new >= np.maximum(self.least[active], self.scores[active, -1])[:, None]).any(1)
        active, new, ids = active[hit], new[hit], ids[hit]
        scores = np.concatenate([self.scores[active], new], axis=1)
        ids = np.concatenate([self.found[active], np.where(new == LEAST, np.iinfo(np.int64).max, ids)], axis=1)
        best = np.lexsort((ids, ~scores), axis=1)[:, : self.k]  # ~ turns the order round without overflow
        self.scores[active] = np.take_along_axis(scores, best, 1)
        self.found[active] = np.take_along_axis(ids, best, 1)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows as longs."""
    top = max(1.0, float(np.abs(a).max(initial=0))) * max(1.0, float(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if top < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    limit = np.iinfo(np.int64)
    return np.array([[min(limit.max, max(limit.min + 1, sum(x * y for x, y in zip(p, q)))) for q in whole[1]] for p in whole[0]], np.int64).reshape(len(a), len(b))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _searched(shards: DataFrame, queries: DataFrame, k: int, block_rows: int, tasks: int) -> DataFrame:
    """The k best of each (query, shard), from at or above the query's floor.

    A task's rows come in order of shard, candidates before queries: candidates are held until the first query of
    their shard, queries pass by in blocks.
    """
    columns = ["dims", "shard", "asks", "vec_id", "vector", "floor"]
    rows = shards.select("dims", "shard", F.lit(False).alias("asks"), "vec_id", "vector", F.lit(0).cast("bigint").alias("floor")).unionByName(
        queries.select("dims", "shard", F.lit(True).alias("asks"), F.col("query_id").alias("vec_id"), "vector", "floor")
    )

    def search(batches):
        key, held, tree, ids = None, [], None, None
        for batch in batches:
            dims, shard, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dims", "shard", "asks"))
            cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if key != (dims[begin], shard[begin]):
                    key, held, tree = (dims[begin], shard[begin]), [], None
                if not asks[begin]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if tree is None:
                    whole = pa.Table.from_batches(held)
                    tree, ids = BallTree(_matrix(whole.column("vector"))), whole.column("vec_id").to_numpy()
                for at in range(0, part.num_rows, block_rows):
                    block = part.slice(at, block_rows)
                    own, floor = block.column("vec_id").to_numpy(), block.column("floor").to_numpy()
                    found = Search(tree, ids, _matrix(block.column("vector")), own, k, floor)
                    hits = np.nonzero((found.scores > LEAST) & (found.scores >= floor[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(own[hits[0]]), pa.array(found.found[hits]), pa.array(found.scores[hits])], names=["query_id", "vec_id", "score"])

    dealt = rows.select(*columns).repartition(tasks, "dims", "shard").sortWithinPartitions("dims", "shard", "asks")
    return dealt.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")


def top_inner_products(df: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each query's k highest scores among all rows but its own: query_id, rank (from 1), vec_id, score."""
    spark = df.sparkSession
    whole = df.where(finite(F.col(vector)) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("bigint").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.size(vector).alias("dims"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Rows go to shards by their number, whatever their id: a repeated id is dealt over all of them.
    whole = stored(whole, "candidates")
    shards = max(16, math.ceil(whole.count() / shard_rows))
    candidates = whole.select("vec_id", "vector", "dims", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"))
    queries = stored(whole.where("asks").groupBy("vec_id").agg(F.min(F.struct("dims", "vector")).alias("v")).select(F.col("vec_id").alias("query_id"), "v.vector", "v.dims"), "queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best, searched = None, 0
    while searched < shards:
        upto = min(shards, max(1, (GROWTH + 1) * searched))
        asked = queries.select("*", F.lit(int(LEAST)).alias("floor"))
        if best is not None:
            kth = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query_id", "least")
            asked = queries.join(kth, "query_id", "left").select("query_id", "vector", "dims", F.coalesce("least", F.lit(int(LEAST))).alias("floor"))
        asked = asked.select("*", F.explode(F.sequence(F.lit(searched), F.lit(upto - 1))).alias("shard"))
        found = _searched(candidates.where((F.col("shard") >= searched) & (F.col("shard") < upto)), asked, k, block_rows, min(max(spread, upto - searched), MOST_TASKS))
        merged = found if best is None else best.select("query_id", "vec_id", "score").unionByName(found)
        best = merged.select("query_id", F.row_number().over(order).cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
        searched = upto
        if searched < shards:
            best = stored(best, "best")
    return best
