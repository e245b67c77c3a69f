"""Written intermediates, and tables of chunks, vectors and questions as files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none: a temporary one in local mode, else an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, survives lost executors, computes df once.

    The tables of an application lie in one folder, which its driver deletes as it ends.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the bytes of a text column stay within limit, or the slice has one row."""
    import pyarrow.compute  # noqa: F401

    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
    start = 0
    while start < batch.num_rows:
        end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def read_questions(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """n and the fields of the questions of a JSON set (an object with the list questions, or the list itself), the first ones only if most is given."""
    rows = spark.read.option("multiLine", "true").json(path)
    if "questions" in rows.columns:
        rows = rows.select(F.posexplode("questions").alias("n", "q")).select("n", "q.*")
    else:
        rows = rows.withColumn("n", F.monotonically_increasing_id())
    rows = rows.orderBy("n")
    return rows if most is None else rows.limit(most)


def collection(table: DataFrame, ids: DataFrame | None = None, id: str = "id") -> DataFrame:
    """All rows of a collection, whatever their number, or those with the ids."""
    return table if ids is None else table.join(ids.select(id).distinct(), id, "left_semi")


def collection_stats(table: DataFrame, metadata: str = "metadata", document: str = "document", sample: int = 100, id: str = "id") -> DataFrame:
    """count, sample_size, sorted keys of the metadata and mean length of the documents of a sample: the rows of the smallest ids."""
    some = table.orderBy(id).limit(sample)
    keys = some.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_keys(metadata))))).alias("metadata_keys"), F.avg(F.length(document)).alias("avg_doc_length"), F.count(F.lit(1)).alias("sample_size"))
    n = table.agg(F.count(F.lit(1)).alias("count"))
    return n.join(F.broadcast(keys), how="cross").select("count", "sample_size", "metadata_keys", F.coalesce("avg_doc_length", F.lit(0.0)).alias("avg_doc_length"))


def write_chunks(chunks: DataFrame, path: str, by: str = "document") -> DataFrame:
    """Chunks as JSON, a line for each document with the list of its chunks; returns by, chunks, chars for the statistics file beside it."""
    fields = [c for c in chunks.columns if c != by]
    rows = chunks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("chunks"))
    rows.write.mode("overwrite").json(f"{path}/chunks")
    text = "content" if "content" in fields else fields[-1]
    stats = chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length(text)).alias("chars"))
    stats.write.mode("overwrite").json(f"{path}/stats")
    return stats


def save_vectors(chunks: DataFrame, vectors: DataFrame, path: str, id: str = "id") -> None:
    """Chunks with their vectors as Parquet; raises ValueError where a chunk has none or several."""
    both = saved(chunks.join(vectors, id, "left"))
    if both.count() != chunks.count() or not both.where("vector is null").isEmpty():
        raise ValueError("each chunk needs one vector")
    both.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A table of save_vectors, or JSON lines with the same fields."""
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)
