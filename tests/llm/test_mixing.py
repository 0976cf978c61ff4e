import collections

import pytest
from pyspark.sql import functions as F

from lexweave.llm import mixing


def fill(sizes, weights, cap=3):
    """Targets by sharing the excess again and again."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if level * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, name int")


def test_targets_and_takes(spark):
    rows = []
    for i in range(2000):
        source = [None, "a", "b", "c", "d", "e"][min(5, i % 17 % 7)]
        if i % 3 == 0:
            source = "hot"
        rows.append((i, None if i % 50 == 0 else "w " * (i % 40) + "\tx\x0bz", source, "clash", 1))
    out = mixing.systematic_mix(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = collections.defaultdict(int)
    taken = collections.defaultdict(int)
    target = {}
    for r in out:
        text, source = rows[r.doc_id][1], rows[r.doc_id][2]
        assert r.size == len((text or "").split())
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        sizes[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = fill([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])
    assert [target[s] for s in order] == pytest.approx(expected)
    for s in order:
        assert abs(taken[s] - target[s]) <= 3 * 42


def test_reruns_agree_and_odd_tables(spark):
    rows = [(1, "a b", "s", "x", 1)] * 30 + [(None, "", "t", "x", 1), (2, None, None, "x", 1)]
    df = documents(spark, rows)
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    first = sorted(map(key, mixing.systematic_mix(df).collect()))
    assert first == sorted(map(key, mixing.systematic_mix(df.repartition(5)).collect()))
    assert mixing.systematic_mix(df.limit(0)).count() == 0


def test_rows_of_a_hot_id_come_out_as_often_as_they_are_taken(spark):
    hot = spark.range(20_000).selectExpr("cast(null as bigint) doc_id", "concat('w w ', id % 7) text", "'s' source", "'x' size", "cast(id % 3 as int) name")
    df = hot.unionByName(spark.range(500).selectExpr("id doc_id", "'a b c d' text", "if(id % 2 = 0, 't', null) source", "'x' size", "1 name"))
    took = mixing.systematic_mix(df).groupBy(F.col("doc_id").isNull()).agg(F.sum("taken")).collect()
    rows = mixing.mixed_rows(df)
    assert rows.columns == df.columns
    words = rows.groupBy(F.col("doc_id").isNull()).agg(F.sum(F.size(F.split("text", " ")))).collect()
    assert sorted(map(tuple, took)) == sorted(map(tuple, words))
    most = rows.groupBy("text", "source", "name").count().join(df.groupBy("text", "source", "name").agg(F.count("*").alias("n")), ["text", "name"]).where(F.col("count") > 3 * F.col("n")).count()
    assert most == 0


def test_a_very_long_text_counts_all_its_words(spark):
    df = documents(spark, [(1, "w " * 2_000_000, "s", "x", 1), (2, "a b", "t", "x", 1)])
    got = {r.doc_id: (r.size, r.taken) for r in mixing.systematic_mix(df).collect()}
    assert got[1][0] == 2_000_000 and got[2][0] == 2


def test_the_main_path_runs_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mixing.mixed_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in rows for word in ("Python", "Pandas", "Arrow"))
    plan = mixing.systematic_mix(df).groupBy().agg(F.sum("taken"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
