"""Streams of documents: every micro-batch goes through the batch operators; a document is whole inside a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexweave.operators import lines, statute


def text_stream(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    """Documents as they arrive as JSON lines in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).json(path)


def parse_stream(docs: DataFrame, sink: str, checkpoint: str, available_now: bool = True, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Parses arriving documents and appends provisions and citations under the sink, by batch so that a retry replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = statute.parse(lines.text_lines(batch), cite=True).persist()
        statute.provisions(parsed).write.mode("overwrite").parquet(f"{sink}/provisions/batch={batch_id}")
        statute.citations(parsed).write.mode("overwrite").parquet(f"{sink}/citations/batch={batch_id}")
        parsed.unpersist()
        if each:
            each(batch, batch_id)

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
