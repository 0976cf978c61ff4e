import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import embeddings, topk
from lexweave.llm.components import connected_components


def vectors(seed=1, n=900, d=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    for i in range(0, n, 3):  # near copies, some in chains
        base[i] = base[i // 9] + rng.normal(scale=0.12, size=d)
    base[5:25] = base[4]
    rows = [(int(i), [float(x) for x in v.astype(np.float32)], "clash") for i, v in enumerate(base)]
    rows += [(n, None, "x"), (n + 1, [0.0] * d, "x"), (n + 2, [float("nan")] * d, "x"), (n + 3, [None] + [1.0] * (d - 1), "x"), (n + 4, [1.0, 2.0], "x"), (n + 5, [2.0, 4.0], "x")]
    return rows


SCHEMA = "vec_id long, embedding array<float>, rank string"


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_links_and_components_equal_brute_force(spark):
    rows = vectors()
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), block_rows=128).collect()}
    assert sorted(got) == [r[0] for r in rows]
    valid = [(i, np.array(v, float)) for i, v, _ in rows if good(v) and any(v)]
    links = {r[0]: set() for r in rows}
    for i, a in valid:
        for j, b in valid:
            if i != j and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.9:
                links[i].add(j)
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(seen), i == min(seen))


def test_a_null_id_and_an_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], ""), (1, [1.0, 0.0], ""), (1, [1.0, 0.0], "")], SCHEMA)
    rows = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert rows == {None: (0, None, True), 1: (0, 1, True)}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows", [20, 100_000])
def test_top_k_equals_brute_force_with_ties(spark, shard_rows):
    rows = vectors(seed=2, n=700)
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_inner_products(df, F.col("vec_id") % 100 == 0, k=10, shard_rows=shard_rows, block_rows=3).collect()
    whole = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows if good(v)}
    expected = []
    for q in whole:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:10])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(expected)


def test_the_tree_skips_most_of_clustered_rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 1000
    points = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 8)))
    tree = topk.BallTree(points)
    search = topk.Search(tree, np.arange(4000), points[::100], np.arange(0, 4000, 100), 10, np.full(40, topk.LEAST))
    assert search.visited < 0.5 * 40 * 4000


def test_large_components_are_exact_and_an_empty_table_has_no_rows(spark):
    df = spark.createDataFrame([(0, [1e6, 3.0], ""), (1, [1e9, 1.0], ""), (2, [-1e6, 2.0], "")], SCHEMA)
    got = [(r.vec_id, r.score) for r in topk.top_inner_products(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 1024 * 10**6 * 1024 * 10**9 + 3072 * 1024 if 1024 * 10**6 * 1024 * 10**9 + 3072 * 1024 < 2**63 else 2**63 - 1), (2, -(1024 * 10**6) ** 2 + 3072 * 2048)]
    assert topk.top_inner_products(df.limit(0), F.lit(True)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(0, [1.0, 0.0], ""), (0, [2.0, 0.0], ""), (5, [3.0, 0.0], ""), (5, [3.0, 0.0], ""), (None, [9.0, 9.0], ""), (7, [0.5, 0.0], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.query_id, r.vec_id, r.score) for r in topk.top_inner_products(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    assert got == [(0, 5, 1024 * 3072), (0, 5, 1024 * 3072), (0, 7, 1024 * 512)]  # the id asks once, with its least vector
    many = spark.range(3000).selectExpr("9 as vec_id", "array(float(1), float(id % 5)) as embedding", "'' as rank").unionByName(df)
    found = topk.top_inner_products(many, F.col("vec_id") == 0, k=10, shard_rows=100).collect()
    assert [r.score for r in sorted(found, key=lambda r: r["rank"])] == [3072 * 1024] * 2 + [1024 * 1024] * 8
    linked = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert linked == {0: (2, 0), 5: (2, 0), 7: (2, 0), None: (0, None)}


def test_cells_of_tight_clusters_are_sent_to_few_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    points = np.repeat(centres, 50, axis=0) + rng.normal(scale=0.02, size=(3000, 32))
    df = spark.createDataFrame([(int(i), [float(x) for x in v], "") for i, v in enumerate(points)], "vec_id long, embedding array<double>, rank string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, block_rows=300).collect()}
    u = embeddings.unit(points)
    near = u @ u.T >= 0.9
    assert {i: n for i, (n, _) in got.items()} == {i: int(near[i].sum()) - 1 for i in range(3000)}
    first, parts, total = embeddings.blocks_of({c: 50 for c in range(60)}, embeddings.unit(centres), 300)
    assert total == 10 and set(parts.values()) == {1} and sorted(np.bincount(list(first.values()))) == [6] * 10


def test_a_hub_and_long_chains_settle(spark):
    hub = spark.range(1, 5001).selectExpr("id as a", "0L as b")
    chain = spark.range(10_000, 12_000).selectExpr("id as a", "id + 1 as b").repartition(7)
    got = connected_components(hub.unionByName(chain)).groupBy("component").count().collect()
    assert sorted((r.component, r["count"]) for r in got) == [(0, 5001), (10_000, 2001)]


def test_few_edges_take_few_jobs_and_rounds_agree(spark):
    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 900, (600, 2))], "a long, b long").repartition(7)
    context = spark.sparkContext
    context.setJobGroup("few edges", "")
    at_once = {r.node: r.component for r in connected_components(edges).collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("few edges"))
    context.setJobGroup("rounds", "")
    assert at_once == {r.node: r.component for r in connected_components(edges, held=0).collect()}
    assert 0 < jobs <= 10 < len(context.statusTracker().getJobIdsForGroup("rounds"))
    context.setLocalProperty("spark.jobGroup.id", None)


def test_rounds_settle_a_hub_and_a_chain(spark):
    hub = spark.range(1, 2001).selectExpr("id as a", "0L as b")
    chain = spark.range(10_000, 10_500).selectExpr("id as a", "id + 1 as b").repartition(7)
    got = connected_components(hub.unionByName(chain), held=0).groupBy("component").count().collect()
    assert sorted((r.component, r["count"]) for r in got) == [(0, 2001), (10_000, 501)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, j) for j in range(2, 40)] + [(7, 7), (None, 3), (500, 400)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 40)}, 400: 400, 500: 400}
