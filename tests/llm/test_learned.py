import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexweave.llm import langid, quality
from lexweave.llm.common import text_buffers
from lexweave.llm.queries import op2_hyperdimensional_langid, op9_line_crf_quality

SF = "/root/testdata/sf0.1"


def naive_bundle(text, dimensions):
    letters = [c if c.isalpha() else " " for c in f" {text.lower()} "]
    kept = [c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " "]
    total = np.zeros(dimensions)
    for i in range(len(kept) - 2):
        if kept[i + 1] != " ":
            parts = [np.roll(langid.letter_vector(ord(c), dimensions).astype(int), 2 - k) for k, c in enumerate(kept[i : i + 3])]
            total += parts[0] * parts[1] * parts[2]
    return total


def test_bundles_equal_the_definition():
    texts = ["Hello, World", "", "ß İstanbul 東京タワー", "a", "1234", "ab cd  ef\ngh " * 30]
    for text, row in zip(texts, langid.bundles(texts, 64)):
        assert np.allclose(row, naive_bundle(text, 64))
    sums = langid.bundles(texts, 64, np.array([0, 1, 0, 1, 0, 1]), 2)
    assert np.allclose(sums[0], sum(naive_bundle(t, 64) for t in texts[::2]))


def test_a_large_alphabet_gives_the_same():
    text = "".join(chr(0x4E00 + 7 * i % 3000) for i in range(4000))
    assert np.allclose(langid.bundles([text], 32)[0], naive_bundle(text, 32))


def test_held_out_accuracy_of_languages(spark):
    rows = op2_hyperdimensional_langid(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "lang")
    out = rows.join(docs, "doc_id").where("held_out")
    assert rows.count() == docs.count()
    assert out.where("lang = lang_pred").count() > 0.97 * out.count()
    assert rows.where("score < 0 or score > 1").count() == 0


def test_odd_texts_have_no_language(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !?", "en"), (4, "the thing", None), (5, "ça été", "fr"), (5, "ça été", "fr")], "doc_id long, text string, lang string")
    languages, profile = langid.prototypes(df)
    assert languages == ["en", "fr"]
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(df, languages, profile).orderBy("doc_id").collect()]
    assert [x for x in got if x[0] < 4] == [(1, "und"), (2, "und"), (3, "und")] and got[4:] == [(5, "fr"), (5, "fr")]
    languages, profile = langid.prototypes(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, languages, profile).collect()} == {"und"}


def brute_marginals(chain, score):
    """Marginals of good over all labelings of one chain."""
    n = len(score)
    weights = {}
    for code in range(2**n):
        y = [code >> t & 1 for t in range(n)]
        weights[code] = np.exp(chain.start[y[0]] + sum(score[t] * y[t] for t in range(n)) + sum(chain.transition[a, b] for a, b in zip(y, y[1:])))
    total = sum(weights.values())
    return [sum(w for code, w in weights.items() if code >> t & 1) / total for t in range(n)]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    chain = quality.Chain(rng.normal(size=46), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(15), np.ones(15))
    text = np.repeat([0, 1, 2, 3], [5, 1, 8, 3])
    own = rng.normal(size=(17, 15))
    got, score = chain.marginals(text, own), chain.emissions(text, own)
    for d in range(4):
        assert got[text == d] == pytest.approx(brute_marginals(chain, score[text == d]))


def test_features_and_odd_texts():
    texts = ["", "  \n\t\n", None, "one line", "A!! B!!\nA!! B!!\n\nx x x x", "é" * 300_000, "w\n" * 20_000]
    text, size, own = quality.line_features(*text_buffers(pa.array(texts)))
    assert np.bincount(text, minlength=7).tolist() == [0, 0, 0, 1, 3, 1, 20_000]
    assert np.isfinite(own).all() and size.sum() == 8 + 8 + 8 + 7 + 600_000 + 40_000
    assert own[3, quality.FEATURES.index("word_repeats")] == 0.75 and own[2, -1] == 1
    chain = quality.train([t or "" for t in texts] + ["$$$ ***"], [1, 0, 1, 1, 0, 1, 1, 0], rounds=5)
    scores = chain.scores(*text_buffers(pa.array(texts)))
    assert (scores[:3] == 0).all() and ((scores >= 0) & (scores <= 1)).all()


def test_the_slope_of_the_likelihood_and_its_maximum():
    rng = np.random.default_rng(5)
    texts = ["\n".join("word " * rng.integers(1, 5) + "$" * rng.integers(0, 4) * (k % 2) for _ in range(rng.integers(1, 6))) for k in range(40)]
    labels = [1 - k % 2 for k in range(40)]
    seen = []
    real = quality.climb

    def spy(slope_of, at, rounds):
        best = real(slope_of, at, rounds)
        seen.append((slope_of, best))
        return best

    quality.climb, kept = spy, quality.climb
    try:
        quality.train(texts, labels)
    finally:
        quality.climb = kept
    slope_of, best = seen[0]
    at = rng.normal(size=len(best)) / 10
    value, slope = slope_of(at)
    for k in range(0, len(at), 3):
        step = np.zeros(len(at))
        step[k] = 1e-5
        assert slope[k] == pytest.approx((slope_of(at + step)[0] - slope_of(at - step)[0]) / 2e-5, abs=1e-5)
    assert slope_of(best)[0] > value and np.abs(slope_of(best)[1]).max() < 1e-3


def test_texts_without_lines_score_what_their_labels_say(spark):
    docs = spark.createDataFrame([(k, ["good words here", "$$ %% !!", " \n", None][k % 4]) for k in range(80)], "doc_id long, text string")
    good = spark.createDataFrame([(k, [1, 0, 1, 1][k % 4]) for k in range(80)] + [(500, 1), (3, None)], "doc_id long, quality int")
    scored = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, good)).collect()}
    assert scored[2] == scored[3] == pytest.approx(40 / 41) and scored[0] > 0.7 > scored[1]
    bad = good.withColumn("quality", good.quality * (good.doc_id % 4 < 2).cast("int"))
    assert quality.fit(docs, bad).blank == 0.0
    assert quality.fit(docs.limit(0), good).blank == 0.0 and quality.score(docs.limit(0), quality.fit(docs.limit(0), good)).count() == 0


def test_the_training_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, "x " * 50) for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    sizes = []
    kept = quality.train
    quality.train = lambda texts, found: sizes.append(len(texts)) or kept(texts, found)
    try:
        quality.fit(docs, labels, sample_bytes=450)
    finally:
        quality.train = kept
    assert sizes == [4]


def test_many_short_texts_take_little_memory():
    batch = pa.RecordBatch.from_pydict({"text": pa.array([f"short text {k} of {k * 7919 % 997} words {k * 31 % 677}" for k in range(10_000)])})
    made = list(langid.parts(batch, "text"))
    assert max(p.num_rows for p in made) <= langid.ROWS and sum(p.num_rows for p in made) == 10_000
    tracemalloc.start()
    for part in made[:2]:
        langid.bundles(part.column("text").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_training_without_both_labels():
    assert quality.train(["a b"], [1], rounds=2).scores(*text_buffers(pa.array(["x y", ""]))).tolist() == [1.0, 0.0]
    assert quality.train([], []).scores(*text_buffers(pa.array(["x y"]))).tolist() == [0.5]


def test_held_out_accuracy_of_quality(spark):
    rows = op9_line_crf_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    out = rows.join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 500
    assert sum(r.predicted == r.quality for r in out) > 0.97 * len(out)


def test_predictions_equal_those_of_plain_vectors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r.doc_id: r for r in op2_hyperdimensional_langid(spark, "/root/testdata/sf0.001").collect()}
    grams = {}

    def bundle(text):
        letters = [c if c.isalpha() else " " for c in f" {(text or '').lower()} "]
        kept = [c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " "]
        total = np.zeros(langid.DIMENSIONS)
        for gram in zip(kept, kept[1:], kept[2:]):
            if gram[1] != " ":
                if gram not in grams:
                    grams[gram] = np.prod([np.roll(langid.letter_vector(ord(c), langid.DIMENSIONS).astype(int), 2 - k) for k, c in enumerate(gram)], axis=0)
                total += grams[gram]
        return total

    vectors = {d.doc_id: bundle(d.text) for d in docs}
    sums = {}
    for d in docs:
        if d.lang is not None and d.text is not None and zlib.crc32(str(d.doc_id).encode()) % 5:
            sums[d.lang] = sums.get(d.lang, 0) + vectors[d.doc_id]
    languages = sorted(sums)
    for d in docs:
        v = vectors[d.doc_id]
        if not any(c.isalpha() for c in d.text or ""):
            assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == ("und", 0.0)
            continue
        near = [v @ sums[x] / np.linalg.norm(v) / np.linalg.norm(sums[x]) for x in languages]
        assert got[d.doc_id].score == pytest.approx(max(0, max(near)), abs=1e-5)
        assert near[languages.index(got[d.doc_id].lang_pred)] == pytest.approx(max(near), abs=1e-5)


def test_languages_of_empty_tables_repeated_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "the thing and the other", "en", "x", 2), (None, None, None, "x", 2), (None, None, None, "x", 2), (1, "le la les des", "fr", "x", 2)], "doc_id long, text string, lang string, lang_pred string, score int")
    languages, profile = langid.prototypes(df)
    rows = langid.predict(df, languages, profile).collect()
    assert sorted((r.lang_pred, r.doc_id is None) for r in rows) == [("en", True), ("fr", False), ("und", True), ("und", True)]
    assert langid.predict(df.limit(0), languages, profile).count() == 0


def test_document_scores_are_length_weighted_marginals():
    rng = np.random.default_rng(8)
    words = ["plain", "Words", "$$$", "12", "end.", "x"]
    texts = ["\n".join(" ".join(rng.choice(words, rng.integers(0, 5))) for _ in range(rng.integers(1, 8))) for _ in range(60)]
    chain = quality.train(texts, [k % 2 for k in range(60)], rounds=15)
    scores = chain.scores(*text_buffers(pa.array(texts)))
    for t, score in zip(texts, scores):
        text, size, own = quality.line_features(*text_buffers(pa.array([t])))
        if not len(text):
            assert score == chain.blank
            continue
        wide = (own - chain.mean) / chain.scale
        rows = [np.concatenate([wide[k], wide[k - 1] if k else 0 * wide[k], wide[k + 1] if k + 1 < len(wide) else 0 * wide[k], [1]]) for k in range(len(wide))]
        good = brute_marginals(chain, [r @ chain.weights for r in rows])
        assert score == pytest.approx(float(np.dot(good, size) / size.sum()))
