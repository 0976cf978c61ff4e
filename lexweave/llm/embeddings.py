"""Near duplicates among embeddings: spherical k-means cells, blocked cosine products, one vector kept of a group.

Vectors are assigned to the nearest of k centres, fitted on a bounded sample. Two vectors at the angle theta
or less can stand in cells i and j only if each is within reach of the other cell: (m_i - m_j).x is at most
sin(theta) |m_i - m_j| for x of cell i, and the angle of x to m_j is at most the cell's radius plus theta. So
a vector is compared inside its cell and with those other cells only that it can reach: no link is lost, and
clusters that are tight prune most cells. Cells that point the same way share a block, large cells are cut into
several; a vector goes once to each block that holds a cell it can reach. A task compares two blocks, counts the
links of each vector and gives the least member of each local group, not the pairs. Equal vectors are compared
once and counted as often as they occur.

Vectors without structure in high dimensions are within reach of most cells; then the work is that of all
pairs of blocks, and each vector is sent to every block. That is the price of losing no link.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing and are
kept; vectors of different lengths never link; a repeated id is one vector, the least of its rows; a null id
is kept and links with nothing; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .components import Groups, connected_components
from .topk import finite

#: Rows and components that the centres are fitted on, at most.
SAMPLE_ROWS, SAMPLE_COMPONENTS = 20_000, 4_000_000
#: Cells at most, and rows of a cell at least on average.
MAX_CELLS, CELL_ROWS = 1024, 128
#: Rows and components of a block at most.
BLOCK_ROWS, BLOCK_COMPONENTS = 32_768, 2_000_000
#: Vectors that are held against all centres at a time.
HELD_ROWS = 1000
#: Keys that the rows of one vector are dealt over.
SALTS = 1009


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k unit centres of unit vectors."""
    if not len(vectors):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    k = min(k, len(vectors))
    centres = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(rounds):
        cell = (vectors @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow for large or small components."""
    top = np.abs(vectors).max(1, keepdims=True, initial=0)
    scaled = vectors / np.where(top > 0, top, 1)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _vectors(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def block_links(left: np.ndarray, right: np.ndarray, same: bool, threshold: float):
    """Row and column numbers of the pairs of unit vectors with a cosine of at least the threshold, by strips."""
    single = right.astype(np.float32)
    for begin in range(0, len(left), 1024):
        strip = left[begin : begin + 1024]
        rows, columns = np.nonzero(strip.astype(np.float32) @ single.T >= np.float32(threshold - 1e-4))
        if same:
            keep = columns > rows + begin
            rows, columns = rows[keep], columns[keep]
        for at in range(0, len(rows), 200_000):
            r, c = rows[at : at + 200_000], columns[at : at + 200_000]
            true = np.einsum("ij,ij->i", strip[r], right[c]) >= threshold
            yield r[true] + begin, c[true]


def blocks_of(sizes: dict[int, int], centres: np.ndarray, rows: int) -> tuple[dict[int, int], dict[int, int], int]:
    """The first block and the number of blocks of each cell, and the number of all blocks.

    A cell of more than so many rows has blocks of its own. Smaller ones share blocks, in an order that keeps
    centres near each other together. Cells below 0 (of other dimensions) share none.
    """
    coarse = spherical_kmeans(centres, max(1, math.isqrt(len(centres)))) if len(centres) else centres
    group = (centres @ coarse.T).argmax(1) if len(centres) else np.zeros(0, np.int64)
    first, parts, total, room = {}, {}, 0, 0
    for c in sorted(sizes, key=lambda c: (c < 0, int(group[c]) if c >= 0 else 0, c)):
        if c < 0 or sizes[c] > rows:
            first[c], parts[c], room = total, max(1, math.ceil(sizes[c] / rows)), 0
            total += parts[c]
            continue
        if room < sizes[c]:
            total, room = total + 1, rows
        first[c], parts[c], room = total - 1, 1, room - sizes[c]
    return first, parts, total


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each vector: id, n_links, component_id, kept."""
    spark = df.sparkSession
    source = df.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    single = source.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    usable = finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    single = stored(single.select("vec_id", F.when(usable, F.col("v")).alias("v")), "vectors")
    # Equal vectors have equal hashes; the least id of each stands for all.
    keyed = single.where("v is not null").select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("s"))
    copies = stored(keyed.groupBy("h", "g").agg(F.min(F.struct("vec_id", "v")).alias("least"), F.count("*").alias("w")).select("h", "g", F.col("least.vec_id").alias("rep"), "w", F.col("least.v").alias("v")), "copies")
    rows = copies.count()
    # A bounded sample, of the dimension that most vectors have; the others form cells of their own.
    dims = [r[0] for r in copies.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()]
    wide = max(1, dims[0] if dims else 1)
    # Enough blocks that their pairs keep all cores busy.
    sides = math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))
    block = max(1, min(block_rows, BLOCK_COMPONENTS // wide, max(256, math.ceil(rows / sides))))
    k = max(1, min(MAX_CELLS, rows // CELL_ROWS))
    sample_rows = min(sample_rows, max(k, SAMPLE_COMPONENTS // wide))
    sample = copies.where(F.size("v") == (dims[0] if dims else 0)).orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("v").toArrow()
    centres = spherical_kmeans(unit(_vectors(sample.column("v"))), k) if dims else np.zeros((0, 0))

    def assign(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("v").value_lengths())
            cell, angle = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            main = np.flatnonzero(sizes == centres.shape[1]) if len(centres) else np.zeros(0, np.int64)
            cell[:] = -sizes  # other dimensions
            if len(main):
                near = unit(_vectors(batch.column("v").take(pa.array(main)))) @ centres.T
                cell[main] = near.argmax(1)
                angle[main] = np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("w"), batch.column("v"), pa.array(cell, pa.int64()), pa.array(angle)], names=["rep", "w", "v", "cell", "angle"])

    placed = stored(copies.select("rep", "w", "v").mapInArrow(assign, "rep bigint, w bigint, v array<double>, cell bigint, angle double"), "cells")
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).orderBy("cell").collect()  # a row for each of at most MAX_CELLS cells and for each other dimension
    theta = math.acos(threshold)
    gaps = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T))) if len(centres) else np.zeros((0, 0))
    # The least cosine to a centre that reaches its cell.
    least = np.full(len(centres), np.inf)
    for s in stats:
        if s.cell >= 0:
            least[s.cell] = math.cos(min(math.pi, s.r + theta)) - 1e-9
    first, parts, total = blocks_of({s.cell: s.n for s in stats}, centres, block)
    member = np.zeros((len(centres), total), np.float32)
    for c in parts:
        if c >= 0:
            member[c, first[c] : first[c] + parts[c]] = 1

    def deal(batches):
        """A vector goes to the pairs of its own block with the blocks of the cells in reach."""
        for whole in batches:
            for begin in range(0, whole.num_rows, HELD_ROWS):
                batch = whole.slice(begin, HELD_ROWS)
                v, cells, reps = batch.column("v"), batch.column("cell").to_numpy(), batch.column("rep").to_numpy()
                start, n = (np.array([d[c] for c in cells.tolist()], np.int64) for d in (first, parts))
                own = start + (reps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                reached = np.zeros((batch.num_rows, total), bool)
                main = np.flatnonzero(cells >= 0)
                if len(main):
                    near, at = unit(_vectors(v.take(pa.array(main)))) @ centres.T, cells[main]
                    margin = near[np.arange(len(main)), at][:, None] - near
                    inside = (margin <= math.sin(theta) * gaps[at] + 1e-9) & (near >= least[None, :])
                    inside[np.arange(len(main)), at] = True
                    reached[main] = inside.astype(np.float32) @ member > 0
                for row in np.flatnonzero(cells < 0):
                    reached[row, start[row] : start[row] + n[row]] = True
                at, other = np.nonzero(reached)
                mine = own[at]
                low, high = np.minimum(mine, other), np.maximum(mine, other)
                for cut in range(0, len(at), 4096):
                    t = pa.array(at[cut : cut + 4096])
                    side = ((mine == high) & (low != high))[cut : cut + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array((low * total + high)[cut : cut + 4096]), pa.array(side), batch.column("rep").take(t), batch.column("w").take(t), v.take(t)], names=["pair", "side", "rep", "w", "v"])

    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(part: pa.Table) -> pa.Table:
        side, rep, w = part.column("side").to_numpy(), part.column("rep").to_numpy(), part.column("w").to_numpy()
        order = np.argsort(rep, kind="stable")
        vectors = unit(_vectors(part.column("v")))
        pair = part.column("pair")[0].as_py()
        same = pair // total == pair % total
        left = order if same else order[~side[order]]
        right = order if same else order[side[order]]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        links = np.zeros(len(order), np.int64)
        groups = Groups(len(order))
        for r, c in block_links(vectors[left], vectors[right], same, threshold):
            a, b = left[r], right[c]
            np.add.at(links, a, w[b])
            np.add.at(links, b, w[a])
            groups.join(place[a], place[b])
        root = groups.find(np.arange(len(order)))
        linked = np.flatnonzero(links > 0)
        return pa.table([rep[linked], links[linked], rep[order[root[place[linked]]]]], schema=schema)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, total * (total + 1) // 2))
    dealt = placed.mapInArrow(deal, "pair bigint, side boolean, rep bigint, w bigint, v array<double>").repartition(tasks, "pair")
    found = stored(dealt.groupBy("pair").applyInArrow(compare, "rep bigint, links bigint, root bigint"), "links")
    discard(placed)
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    merged = copies.select("h", "g", "rep", "w").join(counted, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left").select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # What is found of a vector comes to each (vector, salt), so that a vector of very many rows is not one key.
    narrow = keyed.select("vec_id", "h", "g", "s")
    of_run = narrow.select("h", "g", "s").distinct().join(merged, ["h", "g"])
    result = narrow.join(of_run, ["h", "g", "s"]).select("vec_id", "n_links", "component_id")
    alone = single.where("v is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    nameless = source.where("vec_id is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("component_id"))
    every = result.unionByName(alone).unionByName(nameless)
    return every.select(F.col("vec_id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
