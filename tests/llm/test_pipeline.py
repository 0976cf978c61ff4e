import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece

import corpus_pipeline
from lexweave.llm import langid, mixing, neardup, quality
from lexweave.llm.common import text_buffers
from lexweave.llm.pieces import piece_model

SF = "/root/testdata/sf0.01"


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert seen[-1].columns == columns
    raw, good, known, unique, mix, coded = [x.collect() for x in seen]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert all(r in raw for r in good[:20])
    right = [(r.doc_id in kept) == bool(labels[r.doc_id]) for r in raw if r.doc_id in labels]
    assert sum(right) > 0.97 * len(right)
    assert len(known) > 0.99 * len(good) and {r.doc_id for r in known} <= kept
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(seen[2]).collect()}
    assert sorted(r.doc_id for r in unique) == sorted(set(classes.values()))
    taken = {r.doc_id: r.copies for r in mixing.systematic_mix(seen[3]).collect()}
    assert Counter(r.doc_id for r in mix) == Counter({d: n for d, n in taken.items() if n})
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    texts = {r.doc_id: r.text for r in mix}
    assert len(coded) == len(mix)
    for r in coded[:100]:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows_pass_through_every_stage(spark):
    sf_docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "the and of to the and of to.", "en", "a", 3), (9_000_001, None, None, None, None), (9_000_002, "", "en", "a", 0), (9_000_003, "12 34", "en", "a", 5), (9_000_004, "The one and the other of the two is in the end.", "en", None, 1), (9_000_004, "The one and the other of the two is in the end.", "en", None, 1)], sf_docs.schema)
    docs = sf_docs.limit(300).unionByName(odd).withColumn("score", sf_docs.doc_id).withColumn("row", sf_docs.doc_id)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
    left = Counter(r.doc_id for r in docs.collect())
    assert not {9_000_001, 9_000_002, 9_000_003} & set(left)
    empty = corpus_pipeline.STAGES[4][1](spark, docs.limit(0), SF)
    assert empty.count() == 0


def test_a_language_that_is_none_is_rejected():
    vectors = langid.bundles(["the and of " * 50, "qxzvjkw " * 3])
    assert vectors.shape[0] == 2
    chain = quality.train(["A plain line of words.", "$$$ ### %%%"] * 20, [1, 0] * 20, rounds=60)
    good, bad = chain.scores(*text_buffers(pa.array(["Other plain words here.", "### $$$ ***"])))
    assert good > 0.7 > bad and np.isfinite(good)


FOREIGN = [
    "Дом",
    "Человек, его права и свободы являются высшей ценностью.",
    "中华人民共和国的一切权力属于人民。",
    "Rzeczpospolita Polska jest dobrem wspólnym wszystkich obywateli i urzeczywistnia zasady sprawiedliwości społecznej.",
    "La Repubblica riconosce e garantisce i diritti inviolabili dell'uomo, sia come singolo sia nelle formazioni sociali ove si svolge la sua personalità, e richiede l'adempimento dei doveri inderogabili di solidarietà politica, economica e sociale. È compito della Repubblica rimuovere gli ostacoli di ordine economico e sociale.",
    "Allen die zich in Nederland bevinden, worden in gelijke gevallen gelijk behandeld. Discriminatie wegens godsdienst, levensovertuiging, politieke gezindheid, ras, geslacht of op welke grond dan ook, is niet toegestaan. De trein kwam gisteren niet op tijd aan en de mensen stonden te wachten op het perron.",
    "Человек, его права и свободы являются высшей ценностью. " * 20,
]


def test_the_language_stage_rejects_foreign_texts_short_and_long(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    good = docs.join(labels, "doc_id", "left_semi").select(docs.columns)
    foreign = spark.createDataFrame([(9_100_000 + k, t, None, "a", len(t)) for k, t in enumerate(FOREIGN)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, good.unionByName(foreign), SF).collect()}
    assert [k for k, _ in enumerate(FOREIGN) if 9_100_000 + k in kept] == []
    assert len(kept) >= 0.985 * good.count()
