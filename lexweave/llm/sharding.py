"""Hilbert-curve sharding: rows are ordered along a curve through several quantised dimensions and cut into runs.

Every dimension is quantised to a few bits, the curve index is computed from the bins, rows are put in order
of (curve index, salt, id), and the order is cut into shards of near equal bytes. Rows near each other on the
curve are near each other in every dimension, so that a file's value ranges rule out most files for a filter
on any of them.

The order is found without a global sort: rows before a row = rows in earlier curve cells (a prefix over the
cells, of which there are at most 2**(bits * dimensions)) + rows in earlier salts of its cell + rows before it
in its (cell, salt). The salt is a hash of the id over about sqrt(rows) values, so that neither a cell nor
a salt holds more than about the square root of a hot cell's rows, however many rows are copies.

Defined results: a null text has no bytes and the crc of the empty text; a null dimension has a bin of its
own hash; ties and repeated rows get different slots; fewer rows than shards leave shards empty; an empty
table gives no row; columns of the input that are not asked for are not read, so names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes that a row costs beside its text.
ROW_BYTES = 8


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of an (n, dimensions) array of bins, by Skilling's transpose form."""
    x = [np.array(c, dtype=np.int64) for c in coordinates.T]
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x = [v ^ turn for v in x]
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | (v >> b & 1)
    return index


def category_bin(value: Column, bits: int) -> Column:
    """A category's bin: a hash, so that no list of the values is needed."""
    return F.pmod(F.xxhash64(value), F.lit(1 << bits)).cast("int")


def size_bin(value: Column, bits: int) -> Column:
    """A positive number's bin on a logarithmic scale up to 2**32."""
    top = (1 << bits) - 1
    return F.least(F.lit(top), F.floor(F.log2(F.greatest(value, F.lit(1))) * F.lit((top + 1) / 32.0))).cast("int")


def with_curve(df: DataFrame, bins: list[str], bits: int, name: str = "curve") -> DataFrame:
    """Adds the curve index of the bins."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{name}` bigint"

    def rows(batches):
        for batch in batches:
            cells = np.stack([batch.column(b).to_numpy(zero_copy_only=False) for b in bins], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_index(cells, bits), pa.int64())], names=[*batch.schema.names, name])

    return df.mapInArrow(rows, schema)


def hilbert_shards(df: DataFrame, shards: int = 24, id_column: str = "doc_id", text: str = "text", categories: tuple[str, ...] = ("lang", "source"), bits: int = 6) -> DataFrame:
    """Shard and slot of every row: id, size, text_crc32, curve, shard, slot (from 0 within its shard)."""
    text_or_empty = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(text_or_empty).cast("bigint") + F.lit(ROW_BYTES)
    bins = [f"bin{i}" for i in range(len(categories) + 1)]
    narrow = df.select(
        F.col(id_column).alias("id"),
        size.alias("size"),
        F.crc32(text_or_empty.cast("binary")).alias("text_crc32"),
        *(category_bin(F.col(c), bits).alias(b) for c, b in zip(categories, bins)),
        size_bin(size, bits).alias(bins[-1]),
    )
    narrow = stored(with_curve(narrow, bins, bits).drop(*bins), "curve")
    salts = math.isqrt(narrow.count()) + 1
    rows = narrow.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    runs = rows.groupBy("curve", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    cells = runs.groupBy("curve").agg(F.sum("n").alias("cell_n"), F.sum("b").alias("cell_b"))
    along = Window.orderBy("curve")
    cells = cells.select(
        "curve",
        F.coalesce(F.sum("cell_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cell_rank"),
        F.coalesce(F.sum("cell_b").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cell_before"),
        F.sum("cell_b").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    inside = Window.partitionBy("curve").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.join(cells, "curve").select(
        "curve",
        "salt",
        "total",
        (F.col("cell_rank") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("run_rank"),
        (F.col("cell_before") + F.coalesce(F.sum("b").over(inside), F.lit(0))).alias("run_before"),
    )
    own = Window.partitionBy("curve", "salt").orderBy("id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["curve", "salt"]).select(
        "id",
        "size",
        "text_crc32",
        "curve",
        "total",
        (F.col("run_rank") + F.coalesce(F.count("*").over(own), F.lit(0))).alias("rank"),
        (F.col("run_before") + F.coalesce(F.sum("size").over(own), F.lit(0))).alias("before"),
    )
    placed = stored(placed.select("id", "size", "text_crc32", "curve", "rank", F.expr(f"int(least({shards - 1}, ((before * 2 + size) * {shards}) div (total * 2)))").alias("shard")), "placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(F.col("id").alias(id_column), "size", "text_crc32", "curve", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def manifest(sharded: DataFrame, dimensions: list[str]) -> DataFrame:
    """A row for each shard with the least and the greatest value of each dimension, for pruning."""
    return sharded.groupBy("shard").agg(
        F.count("*").alias("rows"),
        *(f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))),
    )


def prune(shards: DataFrame, **ranges: tuple) -> DataFrame:
    """The shards of a manifest that can hold rows inside all the given (low, high) ranges."""
    for d, (low, high) in ranges.items():
        shards = shards.where((F.col(f"max_{d}") >= F.lit(low)) & (F.col(f"min_{d}") <= F.lit(high)))
    return shards


def write_shards(df: DataFrame, sharded: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Writes the documents as one folder for each shard, in slot order within each file."""
    placed = df.join(sharded.select(id_column, "shard", "slot", F.col("slot").alias("_slot")), id_column)
    placed.repartition("shard", F.floor(F.col("_slot") / F.lit(1_000_000))).sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(path)
