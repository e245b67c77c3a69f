"""documents -> quality classifier -> line dedup -> near-duplicate join -> source mix -> packed sequences.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents, extra ones too, whatever their names. Rows of one text and doc_id that repeat
stay repeated. Of a group of near-duplicates the document with the smallest doc_id stays, all rows of it; documents without
doc_id stay. Of lines that tie the one in the smallest doc_id stays. A document that the mix takes several times becomes
as many rows; rows alike share what it takes of them. Null texts are empty. Empty tables go through with empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import jaccard, lines, mixing, packing, perplexity
from quillspark.llm.common import documents, free_names, saved, small


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return perplexity.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one holds; n_chars follows the text."""
    out = lines.without_lines(docs, lines.line_bitmaps(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of texts with similar sets of five-word shingles."""
    (doc,) = free_names(docs, "_id")
    first = jaccard.near_duplicates(docs, 5, "0.8").where("doc_id = component_id").select(F.col("doc_id").alias(doc)).distinct()
    return docs.where("doc_id is null").unionByName(docs.join(small(saved(first)), F.col("doc_id").cast("long") == F.col(doc), "left_semi"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    doc, row, source, times, copies, copy, one = free_names(docs, "_id", "_row", "_source", "_times", "_copies", "_copy", "_one")
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row), F.col("source").alias(source))
    taken = saved(taken.agg(F.sum("times").alias(times), F.count(F.lit(1)).alias(copies)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(row)) & F.col("source").cast("string").eqNullSafe(F.col(source))
    out, often = docs.join(small(taken), same), F.col(times)
    if not taken.where(F.col(copies) > 1).isEmpty():  # repeated rows share what the mix takes of them
        out = out.withColumn(copy, F.row_number().over(Window.partitionBy(doc, row, source).orderBy(row)))
        often = F.floor((F.col(times) + F.col(copies) - F.col(copy)) / F.col(copies))
    return out.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), often.cast("int"))).alias(one)).drop(one)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 2048 tokens."""
    out = packing.pack(saved(packing.pieces(docs)))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
