import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import sharding
from lexweave.llm.queries import op1_hilbert_shards


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_and_moves_one_step_at_a_time(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    walk = cells[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def check(rows, docs, shards):
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in docs)
    bytes_of = [0] * shards
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
        bytes_of[s] = sum(r.size for r in rows if r.shard == s)
    largest = max((r.size for r in rows), default=0)
    assert max(bytes_of) - min(bytes_of) <= 2 * largest


def test_nulls_ties_copies_and_clashing_names(spark):
    docs = [(i, None if i % 7 == 0 else "same text" if i % 3 else "é" * i, None if i % 5 == 0 else "en", "s", 1.0, 2) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, size double, curve int")
    rows = sharding.hilbert_shards(df, shards=5).collect()
    check(rows, docs, 5)
    for r in rows:
        text = (docs[r.doc_id][1] or "").encode()
        assert r.size == len(text) + 8 and r.text_crc32 == zlib.crc32(text)


def test_repeated_rows_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "a", "en", "s")] * 50, "doc_id long, text string, lang string, source string")
    check(sharding.hilbert_shards(df, shards=3).collect(), [(1,)] * 50, 3)
    assert sharding.hilbert_shards(df.limit(0), shards=3).count() == 0


def test_query_covers_all_documents_and_prunes(spark):
    rows = op1_hilbert_shards(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(rows.collect(), [(r.doc_id,) for r in docs.collect()], 24)
    joined = rows.join(docs.drop("size"), "doc_id")
    pruned = sharding.prune(sharding.manifest(joined, ["n_chars"]), n_chars=(0, 200))
    kept = {r.shard for r in pruned.collect()}
    assert {r.shard for r in joined.where(F.col("n_chars") <= 200).select("shard").distinct().collect()} <= kept
    assert len(kept) < 24


def test_written_shards_hold_every_row_once(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sharding.write_shards(docs, sharding.hilbert_shards(docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_shards_and_slots_are_those_of_one_global_sort(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in op1_hilbert_shards(spark, "/root/testdata/sf0.001").collect()}
    bins = docs.select("doc_id", "text", *(sharding.category_bin(F.col(c), 6).alias(c) for c in ("lang", "source")))
    size = F.octet_length(F.coalesce("text", F.lit(""))) + sharding.ROW_BYTES
    rows = bins.select("doc_id", size.alias("size"), "lang", "source", sharding.size_bin(size, 6).alias("third"), F.pmod(F.xxhash64("doc_id"), F.lit(int(docs.count() ** 0.5) + 1)).alias("salt")).collect()
    curve = sharding.hilbert_index(np.array([(r.lang, r.source, r.third) for r in rows]), 6)
    order = sorted(range(len(rows)), key=lambda k: (curve[k], rows[k].salt, rows[k].doc_id))
    total, before, slots = sum(r.size for r in rows), 0, [0] * 24
    for k in order:
        r = rows[k]
        shard = min(23, (2 * before + r.size) * 24 // (2 * total))
        assert (got[r.doc_id].curve, got[r.doc_id].shard, got[r.doc_id].slot) == (curve[k], shard, slots[shard])
        slots[shard] += 1
        before += r.size


def test_null_ids_have_slots_of_their_own(spark):
    df = spark.createDataFrame([(None, "a", "en", "s"), (None, "a", "en", "s"), (None, None, None, None), (1, "b", "en", "s")], "doc_id long, text string, lang string, source string")
    rows = sharding.hilbert_shards(df, shards=2).collect()
    assert len(rows) == 4 and len({(r.shard, r.slot) for r in rows}) == 4
