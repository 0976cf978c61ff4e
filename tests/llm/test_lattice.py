import math
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lexweave.llm import lattice
from lexweave.llm.pieces import piece_model
from lexweave.llm.queries import op3_subword_lattice


@pytest.fixture(scope="module")
def model():
    return piece_model()


def every_segmentation(vocabulary, text):
    """Probability of a marked word by enumeration from the left."""
    pieces = dict(zip(vocabulary.pieces, vocabulary.weights))

    def total(at):
        if at == len(text):
            return 1.0
        out = math.exp(vocabulary.single[text[at]]) * total(at + 1)
        for n in range(1, len(text) - at + 1):
            if text[at : at + n] in pieces:
                out += math.exp(pieces[text[at : at + n]]) * total(at + n)
        return out

    return total(0)


WORDS = [b"a", b"then", b"xyz1", "é".encode(), "日".encode(), b"tion", b""]


@pytest.mark.parametrize("few", [0, 100])
def test_the_forward_recursion_sums_all_segmentations(model, few, monkeypatch):
    monkeypatch.setattr(lattice, "FEW_WORDS", few)
    rng = np.random.default_rng(1)
    vocabulary = lattice.Vocabulary(model, rng.integers(0, 50, 32000).astype(float))
    for word, got in zip(WORDS, vocabulary.marginals(WORDS)):
        assert got == pytest.approx(math.log(every_segmentation(vocabulary, lattice.SPACE_PIECE + word)))


def test_both_ways_through_long_words_agree(model, monkeypatch):
    rng = np.random.default_rng(2)
    vocabulary = lattice.Vocabulary(model, rng.integers(0, 50, 32000).astype(float))
    words = [bytes(rng.integers(97, 123, 500).astype(np.uint8)) for _ in range(3)] + [b"ab" * 2000]
    alone = vocabulary.marginals(words)
    monkeypatch.setattr(lattice, "FEW_WORDS", 0)
    monkeypatch.setattr(lattice, "HELD_POSITIONS", 1000)
    assert vocabulary.marginals(words) == pytest.approx(alone)


def test_a_documents_score_is_the_sum_over_all_its_segmentations(spark, model):
    texts = ["The cat sat", "the the", "", None, "é 日 zq"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lattice.score(df, F.lit(True), model).collect()}
    # The same piece probabilities by plain counting.
    tool = sentencepiece.SentencePieceProcessor(model_proto=model)
    counts = Counter(w for t in texts for w in lattice.words_of((t or "").encode()))
    found = np.zeros(tool.get_piece_size())
    for k in range(lattice.ROUNDS + 1):
        if k:
            tool = sentencepiece.SentencePieceProcessor(model_proto=lattice.rescored(model, np.log((found + lattice.PIECE_SMOOTHING) / (found.sum() + lattice.PIECE_SMOOTHING * len(found)))))
        found = np.zeros(tool.get_piece_size())
        for w, n in counts.items():
            for i in tool.encode(w.decode()):
                found[i] += n
    vocabulary = lattice.Vocabulary(model, found, len(texts))
    for i, t in enumerate(texts):
        words = lattice.words_of((t or "").encode())
        assert got[i] == pytest.approx((sum(math.log(every_segmentation(vocabulary, lattice.SPACE_PIECE + w)) for w in words) + vocabulary.end) / math.log(10))


def test_blocks_do_not_depend_on_how_files_are_split(spark, model, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learns = F.col("doc_id") % 3 != 0
    expected = {r.doc_id: r.score for r in lattice.score(df, learns, model).collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    blocks = [Counter(r[0] for r in df.select(lattice._blocks(df, 50, 4)).collect())]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        blocks.append(Counter(r[0] for r in df.select(lattice._blocks(df, 50, 4)).collect()))
        again = {r.doc_id: r.score for r in lattice.score(df, learns, model).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert blocks[0] == blocks[1] and len(blocks[0]) > 1
    assert again == pytest.approx(expected)


def test_base_scores_counts_and_odd_texts(spark, model):
    texts = ["The cat sat", "the dog\tsat\x0bdown", None, "", "É é straße", "zzzz unseen", "the the the", "x" * 20_000, "the the the"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    learns = ~F.col("doc_id").isin(5, 6)
    got = {r.doc_id: r for r in lattice.score(df, learns, model).collect()}
    train = [t or "" for i, t in enumerate(texts) if i not in (5, 6)]
    counts = Counter(w for t in train for w in lattice.words_of(t.encode()))
    n, kinds = sum(counts.values()) + len(train), len(counts) + 1
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (kinds + 1)))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = lattice.words_of((t or "").encode())
        assert got[i].n_tokens == len(words) + 1 and got[i].train_tokens == n
        assert got[i].n_known == sum(counts[w] > 0 for w in words) + 1
        assert got[i].base_score == pytest.approx(sum(log(counts[w]) for w in words) + log(len(train)))
        assert got[i].mixed_score <= got[i].closed_score < 0 and got[i].score < 0
    assert got[6].score == got[8].score and got[2].score == got[3].score


def test_no_training_rows_and_an_empty_table(spark, model):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = lattice.score(df, F.lit(False), model).collect()
    assert len(rows) == 2 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)
    assert lattice.score(df.limit(0), F.lit(True), model).count() == 0


def test_query_follows_the_contract(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op3_subword_lattice(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 10 == 0 for d in docs}
    counts = Counter(w for d in docs if not held[d.doc_id] for w in lattice.words_of((d.text or "").encode()))
    ends = sum(not h for h in held.values())
    n = sum(counts.values()) + ends
    total = [0.0, 0.0]
    for d in docs:
        r = rows[d.doc_id]
        words = lattice.words_of((d.text or "").encode())
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (len(counts) + 2))) for w in words) + math.log10((ends + 0.1) / (n + 0.1 * (len(counts) + 2)))
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[d.doc_id], len(words) + 1, n) and r.base_score == pytest.approx(base)
        if r.held_out:
            total[0] += r.base_score
            total[1] += r.closed_score
    assert total[1] > total[0]  # in the base's event space the model predicts held-out texts better
