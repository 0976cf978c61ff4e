"""From raw documents to token ids: quality, language, near duplicates, source mix, encoding.

Each stage takes (spark, docs, sf_dir) and reads all that its predecessor kept. All but the last return the
columns of the documents table, and further columns that docs has, whatever their names.

Defined results: a null text, an empty one and one of white space alone are of low quality unless most labelled
texts like it are good; a text without letters is in no language; so neither comes to the later stages, which
still take them: nulls are near duplicates of nothing, have no words to mix and encode as the end id alone. Rows
with a null id stay, as no id tells them apart; rows that repeat an id and a text become one in the near-duplicate
stage; of a class of near duplicates the least id stays. An empty table stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import langid, mixing, neardup, pieces, quality
from lexweave.llm.common import id_fold, stored, table
from lexweave.shipping import ship

#: Of the language vectors: the noise of a cosine is about one by the root of this.
LANGUAGE_DIMENSIONS = 1024


#: Rows of an Arrow batch. Rows hold whole documents, so that the default of 10 000 would take long buffers in the
#: JVM and in Python for each core.
BATCH_ROWS = 2000


def _prepare(spark: SparkSession) -> None:
    """Sends the package to the executors and keeps Arrow batches short in this session."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _packed(docs: DataFrame) -> DataFrame:
    """The whole row as one column, so that no column name can clash with a stage's own."""
    return docs.select(F.struct("*").alias("row"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores at least 0.7 stay."""
    _prepare(spark)
    labels = table(spark, sf_dir, "labels").where(id_fold("doc_id", 4) != 2)
    chain = quality.fit(docs, labels)
    return quality.score(_packed(docs), chain, text="row.text", keep=("row",)).where(F.col("score") >= quality.THRESHOLD).select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay."""
    _prepare(spark)
    training = docs.where(F.coalesce(id_fold("doc_id", 5) != 0, F.lit(True)))
    languages, profile = langid.prototypes(training, dimensions=LANGUAGE_DIMENSIONS)
    bound = langid.bounds(training, languages, profile)
    told = langid.predict(_packed(docs), languages, profile, text="row.text", keep=("row",), bound=bound)
    return told.where(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    _prepare(spark)
    return neardup.keep_one(docs, threshold=0.8)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    _prepare(spark)
    return mixing.mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row with digests of the ids and of the decoded text."""
    _prepare(spark)
    return pieces.encode(docs, pieces.piece_model(), outputs=("ids", "n_tokens", "n_source_bytes", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", encoding),
]

#: Learned models and signatures are not SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
