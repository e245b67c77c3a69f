"""Experiments as one table of (configuration, question) and scores that need vectors or verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METHODS = (("dense", None), ("bm25", None), ("hybrid", 0.7), ("hybrid", 0.5))


def grid(spark: SparkSession, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """config, method, alpha, k: every method with every k, and a baseline without retrieval."""
    rows = [(f"{m}{'' if a is None else f'_{a}'}_k{k}", m, a, k) for m, a in METHODS for k in ks]
    return spark.createDataFrame([*rows, ("baseline", None, None, 0)], "config string, method string, alpha double, k int")


def planned(configs: DataFrame, questions: DataFrame) -> DataFrame:
    """Every question under every configuration; the grid is a small table by its making, so it is broadcast."""
    return questions.join(F.broadcast(configs), how="cross")


def run(configs: DataFrame, questions: DataFrame, rankings: DataFrame, query: str = "query_id") -> DataFrame:
    """config, query, ids (by rank), n_chunks: each question under each configuration.

    rankings (method, alpha, query, id, rank) are computed once, down to the largest k. The grid is a small table by
    its making, so it is broadcast. A question without results, or a baseline, keeps a row with no ids.
    """
    small = F.broadcast(configs)
    same = (F.col("g.method") == F.col("r.method")) & F.col("g.alpha").eqNullSafe(F.col("r.alpha")) & (F.col("r.rank") <= F.col("g.k"))
    found = rankings.alias("r").join(small.alias("g"), same).groupBy("g.config", f"r.{query}").agg(F.array_sort(F.collect_list(F.struct("r.rank", "r.id"))).alias("x"))
    ids = found.select("config", query, F.transform("x", lambda v: v["id"]).alias("ids"))
    every = questions.select(query).join(F.broadcast(configs.select("config")), how="cross")
    return every.join(ids, ["config", query], "left").withColumn("n_chunks", F.coalesce(F.size("ids"), F.lit(0)))


def greedy_match(candidate: Column, reference: Column) -> dict[str, Column]:
    """precision, recall, f1 of two arrays of token vectors: each token with the most similar one of the other side."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    unit = lambda v: F.transform(v, lambda x: x / F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)))
    a, b = F.transform(candidate, unit), F.transform(reference, unit)
    best = lambda xs, ys: F.try_divide(F.aggregate(F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: dot(x, y)))), F.lit(0.0), lambda s, v: s + v), F.size(xs))
    p, r = F.coalesce(best(a, b), F.lit(0.0)), F.coalesce(best(b, a), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def context_precision(verdicts: Column) -> Column:
    """Mean of the precision at each useful rank; verdicts are 0 or 1 by rank, 0 without any useful one."""
    total = F.aggregate(verdicts, F.lit(0), lambda s, v: s + v)
    at = F.transform(verdicts, lambda v, i: v * F.aggregate(F.slice(verdicts, F.lit(1), i + 1), F.lit(0), lambda s, w: s + w) / (i + 1))
    return F.coalesce(F.try_divide(F.aggregate(at, F.lit(0.0), lambda s, v: s + v), total), F.lit(0.0))


def judged_metrics(has_truth: bool) -> tuple[str, ...]:
    """Scores that a judge gives; those against a true answer only where there is one."""
    free = ("faithfulness", "answer_relevancy")
    return (*free, "context_precision", "context_recall", "context_entity_recall", "answer_similarity", "answer_correctness") if has_truth else free


def few_shot_example(questions: DataFrame, order: str, nth: int = 30) -> tuple[DataFrame, DataFrame]:
    """(the nth question as an example, those before it to be answered); no example if there are fewer."""
    first = questions.orderBy(order).limit(nth).withColumn("_n", F.row_number().over(Window.orderBy(order)))
    return first.where(F.col("_n") == nth).drop("_n"), first.where(F.col("_n") < nth).drop("_n")


def preview(text: Column, n: int) -> Column:
    return F.concat(F.substring(text, 1, n), F.lit("..."))
