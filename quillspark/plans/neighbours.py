"""Nearest neighbours by inverted lists, against the exact ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ann, retrieval
from .registry import SQL, _t, query


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(SQL["h6_dense_top_k"])
def p_cells_exact(spark, sf):
    """The exact mode: cells are left out by their bounds, the rows are those of a full search."""
    vectors, asked = _sides(spark, sf)
    return ann.CellIndex.build(vectors).exact(asked).withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS questions, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0")
def p_cells_recall(spark, sf):
    """Mean recall at 10 against brute force, 0.9 at least: as many cells are probed as other vectors needed for 0.95."""
    vectors, asked = _sides(spark, sf)
    index = ann.CellIndex.build(vectors)
    found = index.search(asked, 10, index.calibrated(10, 0.95))
    shares = ann.recall(found, retrieval.dense_top(vectors, asked, 10))
    return shares.agg(F.count(F.lit(1)).alias("questions"), (F.avg("recall") >= 0.9).alias("recall_reached"))
