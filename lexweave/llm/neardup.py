"""Near-duplicate documents: BagMinHash signatures, bands, and exact verification of multiset overlap.

Two texts are linked if the weighted Jaccard similarity of their bags of five-word shingles is at least the
threshold and some band of their signatures agrees (at 0.8 all 32 bands of 5 slots disagree in 3 of a million
pairs), or if they are equal. Classes are the connected components of the links.

1. Signatures are made where the documents are read; only ids, a digest of the text and band keys go on.
   Equal texts are one from here on.
2. Every band bucket has its least member as leader; members are verified against their leaders, a leader's
   members in blocks that read its text once. That alone joins groups of close copies, in time linear in their
   size.
3. Buckets whose members are still in different components are compared in full. The buckets of one leader are
   one group, so that a text that shares several buckets with it is there once; groups are not joined to larger
   ones, however their members overlap. A group is cut into blocks, large components into blocks of their own;
   all pairs of blocks but those inside one component are compared exactly, by products of shingle incidence
   matrices. A task holds two blocks and gives the least member of each local group, never the pairs. So no
   candidate of any bucket is left out, however large the bucket.

Defined results: null texts and texts without words are in classes of their own, even when they are equal; a
text of fewer than five words has one shingle of all its words; texts of any length are read whole; rows of a
repeated id give a row each, with the class of their own text; a null id has a null class and is kept; an empty table gives
no row; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bagminhash import band_keys, overlap, shingle_bags, signatures
from .common import discard, mix, slices, stored, text_buffers
from .components import Groups, connected_components

BANDS = 32
BAND_ROWS = 5
#: Texts and bytes of text in a block, about.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
COLUMNS = 8192
#: Keys that the documents of one text are dealt over.
SALTS = 1009


def sign(df: DataFrame, id_column: str, text: str, bands: int, rows: int) -> DataFrame:
    """doc_id, a digest of the text and the band keys (none for a text without words)."""

    def made(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = text_buffers(part.column("text"))
                n = part.num_rows
                owner, shingles, counts = shingle_bags(raw, at)
                keys = band_keys(signatures(owner, shingles, counts, n, bands * rows), bands, rows)
                some = np.bincount(owner, minlength=n) > 0
                whole = raw.tobytes()
                digests = [hashlib.md5(whole[at[k] : at[k + 1]]).digest() for k in range(n)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digests, pa.binary()), lists], names=["doc_id", "digest", "bands"])

    named = df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")
    return named.mapInArrow(made, "doc_id bigint, digest binary, bands array<bigint>")


def _bags(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The shingle bag of each text."""
    out = []
    for part in slices(pa.RecordBatch.from_arrays([column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column], names=["text"]), "text"):
        owner, shingles, counts = shingle_bags(*text_buffers(part.column("text")))
        cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
        out += [(shingles[a:b], counts[a:b]) for a, b in zip(cut, cut[1:])]
    return out


def verify(pairs: DataFrame, texts: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The pairs (a, b) whose texts' bags overlap enough.

    The members a of a leader b are dealt over blocks. A task reads the leader's text once for each block and then
    the members pass by in slices of bounded size.
    """
    spread = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = math.isqrt(pairs.count()) + 1
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(salts)).alias("s"))
    upto = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    cut = salted.groupBy("b", "s").agg(F.count("*").alias("n")).select("b", "s", F.floor((F.sum("n").over(upto) - 1) / block_rows).alias("block"))
    members = salted.join(cut, ["b", "s"]).select("b", "block", F.lit(1).alias("side"), F.col("a").alias("node"))
    sides = members.unionByName(members.select("b", "block", F.lit(0).alias("side"), F.col("b").alias("node")).distinct())
    dealt = sides.join(texts.select("node", "text"), "node").repartition(spread, "b", "block").sortWithinPartitions("b", "block", "side")

    def check(batches):
        bag = None
        for batch in batches:
            for part in slices(batch, "text"):
                bags, sides, leaders = _bags(part.column("text")), part.column("side").to_pylist(), part.column("b")
                keep = np.zeros(part.num_rows, bool)
                for k, side in enumerate(sides):
                    if side == 0:
                        bag = bags[k]
                    else:
                        least, most = overlap(bags[k], bag)
                        keep[k] = most > 0 and least >= threshold * most - 1e-9
                yield pa.RecordBatch.from_arrays([part.column("node"), leaders], names=["a", "b"]).filter(pa.array(keep))

    return dealt.mapInArrow(check, "a bigint, b bigint")


def block_overlaps(bags: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of lesser counts of every left with every right bag, by incidence products over shared shingles."""
    rows, keys = [], []
    for k in np.unique(np.concatenate([left, right])):
        shingles, counts = bags[k]
        with np.errstate(over="ignore"):
            level = np.arange(int(counts.sum()), dtype=np.uint64) - np.repeat(np.cumsum(counts) - counts, counts).astype(np.uint64)
            keys.append(mix(np.repeat(shingles, counts) + level * np.uint64(0xD1B54A32D192ED03)))
        rows.append(np.full(len(level), k))
    keys, rows = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(column) else np.zeros(0, bool)
    rows, column = rows[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    place = [np.full(len(bags), -1), np.full(len(bags), -1)]
    place[0][left], place[1][right] = np.arange(len(left)), np.arange(len(right))
    total = np.zeros((len(left), len(right)))
    last = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, last, COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + COLUMNS])
        sides = []
        for where, size in zip(place, total.shape):
            at = where[rows[a:b]]
            matrix = np.zeros((size, min(COLUMNS, last - begin)), np.float32)
            matrix[at[at >= 0], column[a:b][at >= 0] - begin] = 1
            sides.append(matrix)
        total += sides[0] @ sides[1].T
    return total


def group_links(crowded: DataFrame, joined: DataFrame, texts: DataFrame, threshold: float, block_rows: int, scratch: list[DataFrame], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links between members of different components that share a leader's buckets: (a, b), a star for each local group.

    scratch takes what is stored on the way.
    """
    spark = crowded.sparkSession
    placed = stored(crowded.join(joined, crowded.rep == joined.node, "left").select("bucket", "rep", "leader", F.coalesce("component", "rep").alias("component")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    rows = placed.join(mixed, "bucket").select(F.col("leader").alias("family"), "rep", "component").distinct()
    members = stored(rows.join(texts.select(F.col("node").alias("rep"), "bytes"), "rep").withColumn("s", F.pmod(F.xxhash64("rep"), F.lit(SALTS))), "members")
    runs = members.groupBy("family", "component", "s").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    parts = lambda n, size: F.greatest(F.ceil(n / block_rows), F.ceil(size / block_bytes))
    sizes = runs.groupBy("family", "component").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).withColumn("large", parts(F.col("n"), F.col("bytes")) > 1)
    # Blocks: a large component's own, or those that a group's small components share.
    own = sizes.where("large").select("family", "component", F.col("component").alias("own"), parts(F.col("n"), F.col("bytes")).alias("parts"))
    # The sums of a group's small components come to each (group, salt), so that a group of very many is not one key.
    little = sizes.where("not large").withColumn("c", F.pmod(F.xxhash64("component"), F.lit(SALTS)))
    whole = Window.partitionBy("family")
    small = little.groupBy("family", "c").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select("family", "c", parts(F.sum("n").over(whole), F.sum("bytes").over(whole)).alias("parts"))
    shared = little.select("family", "component", "c").join(small, ["family", "c"]).select("family", "component", F.lit(None).cast("bigint").alias("own"), "parts")
    kinds = own.unionByName(shared)
    of_run = runs.select("family", "component", "s").join(kinds, ["family", "component"])
    cut = members.join(of_run, ["family", "component", "s"]).select("rep", "family", "own", F.xxhash64("family", F.coalesce("own", F.lit(-1)), F.pmod(F.xxhash64("rep", F.lit(1)), "parts")).alias("block"))
    cut = stored(cut, "cut")
    scratch += [placed, members, cut]
    blocks = cut.select("family", "own", "block").distinct()
    other = blocks.select(F.col("family"), F.col("own").alias("own2"), F.col("block").alias("block2"))
    tasks = blocks.join(other, "family").where("block <= block2 and not (own is not null and own2 is not null and own = own2)").select("block", "block2", F.xxhash64("block", "block2").alias("task"))
    sides = tasks.select("block", "task", F.lit(0).alias("side")).unionByName(tasks.where("block != block2").select(F.col("block2").alias("block"), "task", F.lit(1).alias("side")))
    dealt = cut.select("rep", "block").join(sides, "block").join(texts, F.col("rep") == F.col("node")).select("task", "side", "rep", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(part: pa.Table) -> pa.Table:
        rep, side = part.column("rep").to_numpy(), part.column("side").to_numpy()
        bags = _bags(part.column("text"))
        weight = np.array([b[1].sum() for b in bags], np.float64)
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        left, right = order[side[order] == 0], order[side[order] == 1]
        if not len(right):
            right = left
        common = block_overlaps(bags, left, right)
        r, c = np.nonzero(common >= threshold * (weight[left][:, None] + weight[right][None, :] - common) - 1e-9)
        apart = left[r] != right[c]
        groups = Groups(len(order))
        groups.join(place[left[r[apart]]], place[right[c[apart]]])
        root = groups.find(np.arange(len(order)))
        moved = np.flatnonzero(root != np.arange(len(order)))
        return pa.table([rep[order[moved]], rep[order[root[moved]]]], schema=schema)

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(spread, "task").groupBy("task").applyInArrow(compare, "a bigint, b bigint")


def near_duplicate_classes(df: DataFrame, threshold: float = 0.8, id_column: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = BAND_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each document: id, class_id (the least id of its class), kept (it is that id)."""
    signed = stored(sign(df, id_column, text, bands, rows), "signed")
    unique = stored(signed.where(F.size("bands") > 0).groupBy("digest").agg(F.min(F.struct("doc_id", "bands")).alias("least")).select("digest", F.col("least.doc_id").alias("rep"), "least.bands"), "unique")
    bucketed = unique.select("rep", F.explode("bands").alias("bucket"))
    leaders = bucketed.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("other")).where("leader != other").select("bucket", "leader")
    crowded = stored(bucketed.join(leaders, "bucket").select("bucket", "rep", "leader"), "crowded")
    pairs = stored(crowded.where("rep != leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    source = df.select(F.col(id_column).cast("bigint").alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The same plan at every size: what the broadcast of a short list saves would be gone where the list is long.
    texts = stored(source.join(nodes.hint("merge"), "node").withColumn("bytes", F.octet_length("text")), "texts")
    joined = stored(connected_components(verify(pairs, texts, threshold, block_rows)), "joined")
    scratch = [crowded, pairs, texts, joined]
    more = group_links(crowded, joined, texts, threshold, block_rows, scratch)
    classes = connected_components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    for step in scratch:  # the classes are stored now and read none of it
        discard(step)
    # A text's class comes to each (digest, salt) of its documents, so that a text of very many is not one key.
    salted = signed.select("doc_id", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("s"))
    of_digest = unique.select("digest", "rep").join(classes, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("class_id"))
    of_run = salted.select("digest", "s").distinct().join(of_digest, "digest")
    named = salted.join(of_run, ["digest", "s"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    nameless = df.where(F.col(id_column).isNull()).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("class_id"))
    every = named.unionByName(nameless)
    return every.select(F.col("doc_id").alias(id_column), "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, threshold: float = 0.8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their near duplicates: of each class the one with the least id, once.

    An id with different texts is a document for each text here: rows are known by a 64-bit hash of id and text.
    """
    key = F.xxhash64(F.col(id_column).cast("bigint"), F.coalesce(F.col(text), F.lit("")))
    packed = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), key.alias("key"), F.struct("*").alias("row"))
    classes = stored(near_duplicate_classes(packed.select("key", F.col(f"row.{text}").alias("text")), threshold, "key", "text").select("key", "class_id").distinct(), "classes")
    counted = packed.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("times")).join(classes, "key")
    least = counted.groupBy("class_id").agg(F.min(F.struct("id", "key", "times")).alias("least")).select("least.key", "least.times")
    kept = packed.select("key", "row").join(least, "key")
    once = kept.where("times = 1").unionByName(kept.where("times > 1").dropDuplicates(["key"]))
    return once.select("row.*").unionByName(df.where(F.col(id_column).isNull()))
