"""Documents as a stream: new files are cleaned and chunked once, however often the job restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import clean
from ..operators.chunking import chunk_id, chunked


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string, source string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest(docs: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    rows = chunked(docs.select("doc_id", "source", clean(F.col("text")).alias("text")))
    rows = rows.withColumn("chunk_id", chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index")))
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window of event time; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), key).count()
