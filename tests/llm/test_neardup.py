import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexweave.llm import bagminhash, neardup
from lexweave.llm.common import text_buffers


def bag(text):
    words = (text or "").split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similarity(a, b):
    least = sum((a & b).values())
    most = sum((a | b).values())
    return least / most if most else 0.0


def test_bags_and_overlaps_equal_the_definition():
    texts = ["", None, "one two", "a b c d e f g a b c d e f g", "a b c d e f g a b c d e f g h", "x " * 40, "é\tß \n z y w"]
    owner, shingles, counts = bagminhash.shingle_bags(*text_buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert sorted(counts[owner == i]) == sorted(bag(t).values())
    bags = neardup._bags(pa.array(texts, pa.string()).fill_null(""))
    every = np.arange(len(texts))
    common = neardup.block_overlaps(bags, every, every)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            least = sum((bag(a) & bag(b)).values())
            assert i == j or common[i, j] == least
            if bag(a) and bag(b):
                assert bagminhash.overlap(bags[i], bags[j]) == (least, sum((bag(a) | bag(b)).values()))


@pytest.mark.parametrize("seed", [1, 2])
def test_signatures_estimate_weighted_jaccard(seed):
    rng = np.random.default_rng(seed)
    elements = rng.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64)
    elements.sort()
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    owner = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    made = bagminhash.signatures(owner, np.concatenate([elements[a > 0], elements[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4000)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (made[0] == made[1]).mean() == pytest.approx(true, abs=4 * (true * (1 - true) / 4000) ** 0.5)


def planted(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for g in range(40):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 1, 2, 4, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    shared = " ".join(word() for _ in range(60))
    texts += [shared + " " + " ".join(word() for _ in range(25)) for _ in range(60)]
    texts += [None, "", "", "one two", "one two", "z " * 500, "z " * 510, "z " * 900]
    return texts


def brute(texts, threshold=0.8):
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block_rows", [8, 512])
def test_classes_equal_brute_force(spark, block_rows):
    texts = planted()
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], "doc_id long, text string, bands string, class_id int")
    got = {r.doc_id: (r.class_id, r.kept) for r in neardup.near_duplicate_classes(df, block_rows=block_rows).collect()}
    expected = brute(texts)
    assert got == {i: (c, c == i) for i, c in enumerate(expected)}


def test_very_long_texts_and_a_text_of_a_third_of_all_rows(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    long = [word() for _ in range(300_000)]
    near = list(long)
    near[1000] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:200_000]))] + [(10 + k, "the same words in many rows here") for k in range(400)] + [(1000 + k, " ".join(word() for _ in range(9))) for k in range(800)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=16).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3
    assert {got[10 + k] for k in range(400)} == {10} and all(got[1000 + k] == 1000 + k for k in range(800))


def test_no_stored_step_is_left_behind_but_what_the_result_reads(spark, tmp_path, monkeypatch):
    from lexweave import storage

    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(planted())], "doc_id long, text string")
    out = neardup.near_duplicate_classes(df)
    left = sorted({p.name.split("-")[1] for p in tmp_path.iterdir()})
    assert left == ["edges", "signed", "unique"]
    assert out.count() == df.count()


def test_keeping_one_of_each_class_with_repeats_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "other words here"), (None, "a b c d e f"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in neardup.keep_one(df).collect()) == ["1", "3", "4", "None"]
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_an_id_with_different_texts_costs_no_class_its_member(spark):
    a, b, c = "a b c d e f", "g h i j k l", "m n o p q r"
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (6, b), (7, c), (7, c)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in neardup.keep_one(df).collect()) == [(1, a), (5, b), (7, c)]
