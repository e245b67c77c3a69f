"""Question and answer pairs from numbered texts, and tables that reports show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .structure import lines

#: Lines that belong to no question: page numbers and addresses of page footers.
NOISE = (r"^\d+$", r"(?i)www\.gov\.br/receitafederal")
START = r"^\d+\.\s+(.+)$"


def question_pairs(docs: DataFrame, id: str = "doc_id", text: str = "text", noise: tuple[str, ...] = NOISE) -> DataFrame:
    """id, n, question, answer. A numbered line starts a question, which ends with the first line that ends in a question mark;
    the lines behind it, of more than three characters, are the answer. Pairs without question mark or answer are left out."""
    rows = lines(docs, id, text).withColumn("line", strip(F.col("line"))).where("line <> ''")
    for p in noise:
        rows = rows.where(~F.col("line").rlike(p))
    order = Window.partitionBy(id).orderBy("pos")
    rows = rows.withColumn("begins", F.col("line").rlike(START)).withColumn("n", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("n > 0")
    within = Window.partitionBy(id, "n").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("asked", F.coalesce(F.max(F.endswith(F.col("line"), F.lit("?"))).over(within), F.lit(False)))
    said = F.when(F.col("begins"), F.regexp_extract("line", START, 1)).otherwise(F.col("line"))
    part = lambda on: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("pos", said.alias("said"))))), lambda x: x["said"]), " ")
    out = rows.groupBy(id, "n").agg(part(~F.col("asked")).alias("question"), part(F.col("asked") & (F.length("line") > 3)).alias("answer"))
    return out.where("question like '%?' and answer <> ''").select(id, F.row_number().over(Window.partitionBy(id).orderBy("n")).alias("n"), "question", "answer")


def config_label(use_retrieval: Column, method: Column, k: Column, alpha: Column) -> Column:
    parts = F.concat_ws(", ", method, F.concat(F.lit("k="), k.cast("string")), F.concat(F.lit("α="), alpha.cast("string")))
    return F.when(~use_retrieval, "No RAG").when(parts == "", "RAG").otherwise(parts)


def ab_test(runs: DataFrame, a: str, b: str, metrics: list[str], key: str = "config", wins: tuple[str, str] = ("faithfulness", "relevance")) -> DataFrame:
    """One row: the means of a and b, b's difference in percent (null over 0), the winner by half and half of two metrics (equal: b)."""
    mean = lambda c, k: F.avg(F.when(F.col(key) == k, F.col(c)))
    out = runs.where(F.col(key).isin(a, b)).agg(*(mean(c, k).alias(f"{c}_{n}") for c in metrics for n, k in (("a", a), ("b", b))))
    diff = {f"{c}_diff": F.try_divide(F.col(f"{c}_b") - F.col(f"{c}_a"), F.col(f"{c}_a")) * 100 for c in metrics}
    score = lambda n: 0.5 * F.col(f"{wins[0]}_{n}") + 0.5 * F.col(f"{wins[1]}_{n}")
    return out.withColumns(diff).withColumn("winner", F.when(score("a") > score("b"), F.lit(a)).otherwise(F.lit(b)))


def metric_table(metrics: DataFrame, metric: str, key: str = "config", values: str = "metrics") -> DataFrame:
    """key and the metric of a map column, best first; rows without it are left out."""
    return metrics.select(key, F.col(values)[metric].alias("value")).where("value is not null").orderBy(F.desc("value"), key)


def overall_score(f1: Column, faithfulness: Column, relevancy: Column, precision: Column, latency_ms: Column, tokens: Column) -> Column:
    """Mean of those that are there, with 1000 / latency and 2000 / tokens; null without any."""
    found = F.array_compact(F.array(f1, faithfulness, relevancy, precision, F.try_divide(F.lit(1000.0), latency_ms), F.try_divide(F.lit(2000.0), tokens)))
    return F.try_divide(F.aggregate(found, F.lit(0.0), lambda s, v: s + v), F.size(found))


def success(runs: DataFrame, error: str = "error") -> DataFrame:
    n, good = F.count(F.lit(1)), F.count_if(F.col(error).isNull())
    return runs.agg(n.alias("total"), good.alias("successful"), (n - good).alias("failed"), F.coalesce(F.try_divide(100.0 * good, n), F.lit(0.0)).alias("rate"))


def reference_counts(ranking: DataFrame, source: str = "source", query: str = "query_id") -> DataFrame:
    """How many questions cite each source, once each."""
    return ranking.groupBy(source).agg(F.count_distinct(query).alias("n_questions"))


def coverage(files: DataFrame, words: str = "words", indexed: str = "indexed") -> DataFrame:
    """Files, words, and the share of words that is indexed."""
    of = F.coalesce(F.sum(F.when(F.col(indexed), F.col(words))), F.lit(0))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum(words).alias("words"), of.alias("indexed_words"), (F.try_divide(of, F.sum(words)) * 100).alias("percent"))


def without_errors(runs: DataFrame, error: str = "error") -> DataFrame:
    return runs.where(F.col(error).isNull())


def insights(runs: DataFrame, order: str, id: str = "id", score: str = "overall", hallucination: str = "hallucination", cited: str = "has_citations", first: int = 5) -> DataFrame:
    """One row: runs below 0.5 with the ids of the first of them in order, runs with hallucination above 0.3, share of runs with citations."""
    low = F.col(score) < 0.5
    firsts = runs.where(low).orderBy(order).limit(first).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(id).alias("_id")))), lambda x: x["_id"]).alias("low_quality_ids"))
    out = runs.agg(F.count_if(low).alias("low_quality"), F.count_if(F.col(hallucination) > 0.3).alias("high_hallucination"), F.coalesce(F.avg(F.col(cited).cast("double")), F.lit(0.0)).alias("citation_rate"))
    return out.join(F.broadcast(firsts), how="cross")


def without_empty(values: Column) -> Column:
    """A map without keys whose value is null or empty."""
    return F.map_filter(values, lambda k, v: v.isNotNull() & (v != ""))


def law_name(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def hierarchy(*levels: Column) -> Column:
    """Levels that are there, from the highest down."""
    return F.concat_ws(" > ", *levels)


def analysis(spark_rows: DataFrame, title: str = "Análise") -> str:
    """A Markdown table of a small result, as reports show it: at most a row for each configuration."""
    rows, names = spark_rows.collect(), spark_rows.columns
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows)]) + "\n"
