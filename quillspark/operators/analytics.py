"""Statistics of experiments. runs: config, metrics by column or in long form (config, metric, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(runs: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """count, mean, population deviation, min, max, median; rows without a value don't count."""
    v = F.col(value)
    return runs.where(v.isNotNull()).groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"))


def config_score(f: Column, r: Column, h: Column, c: Column, latency_ms: Column) -> Column:
    return 0.25 * f + 0.25 * r + 0.20 * (1 - h) + 0.15 * c + 0.15 * (1 - F.least(F.lit(1.0), latency_ms / 5000))


def compare(runs: DataFrame) -> DataFrame:
    """config, means of faithfulness, relevance, hallucination, latency_ms, citation rate, score, rank."""
    m = runs.groupBy("config").agg(*(F.avg(c).alias(c) for c in ("faithfulness", "relevance", "hallucination", "latency_ms")), F.avg(F.col("has_citations").cast("double")).alias("citation_rate"))
    m = m.withColumn("score", config_score(F.col("faithfulness"), F.col("relevance"), F.col("hallucination"), F.col("citation_rate"), F.col("latency_ms")))
    return m.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "config")))


def trade_offs(compared: DataFrame) -> DataFrame:
    return compared.agg(F.min_by("config", "latency_ms").alias("fastest"), F.max_by("config", "faithfulness").alias("most_faithful"), F.max_by("config", "citation_rate").alias("most_citations"), F.min_by("config", "hallucination").alias("safest"))


def improvement(means: DataFrame, baseline: str, key: str = "config", value: str = "mean") -> DataFrame:
    """Percent above the baseline's value; null where that is 0 or absent."""
    base = means.where(F.col(key) == baseline).select(F.col(value).alias("_base"))
    return means.join(F.broadcast(base), how="cross").select(key, value, (F.try_divide(F.col(value) - F.col("_base"), F.col("_base")) * 100).alias("improvement"))


def cohens_d(runs: DataFrame, a: str, b: str, key: str = "config", value: str = "value") -> DataFrame:
    """n, means, Cohen's d with the sample deviation, t of equal variances, label of the effect."""
    on = lambda k: F.when(F.col(key) == k, F.col(value))
    s = runs.agg(*(f(on(k)).alias(f"{n}_{i}") for i, k in (("a", a), ("b", b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    d = F.try_divide(F.col("mean_a") - F.col("mean_b"), pooled)
    s = s.withColumn("d", d).withColumn("t", d / F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b")))
    size = F.abs("d")
    return s.withColumn("effect", F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large"))


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t by the regularised incomplete beta function (continued fraction)."""
    x, a, b = df / (df + t * t), df / 2, 0.5

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + n * d), 1 + n / c
                h *= d * c
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    return min(1.0, front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b)


def embedding_stats(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """n, dim, mean, std (population), low and high of all numbers, mean norm of the vectors; sums of each vector first, so a pass and no rows of numbers."""
    e = vectors.select(F.col(vector).cast("array<double>").alias("e"))
    total = lambda f: F.aggregate("e", F.lit(0.0), lambda s, v: s + f(v))
    each = e.select(F.size("e").alias("dim"), total(lambda v: v).alias("s"), total(lambda v: v * v).alias("q"), F.array_min("e").alias("low"), F.array_max("e").alias("high"))
    n = F.sum("dim")
    out = each.agg(F.count(F.lit(1)).alias("n"), F.max("dim").cast("long").alias("dim"), (F.sum("s") / n).alias("mean"), (F.sum("q") / n).alias("square"), F.min("low").alias("low"), F.max("high").alias("high"), F.avg(F.sqrt("q")).alias("mean_norm"))
    return out.select("n", "dim", "mean", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"), "low", "high", "mean_norm")


def dataset_stats(pairs: DataFrame, by: list[str], question: str = "question", answer: str = "ground_truth") -> DataFrame:
    """kind, value, n, percent of all rows for each column of by, and the mean numbers of words as rows of the kind words."""
    words = lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    total = pairs.agg(F.count(F.lit(1)).alias("_all"), F.avg(words(question)).alias("_q"), F.avg(words(answer)).alias("_a"))
    out = None
    for c in by:
        part = pairs.groupBy(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    rows = out.join(F.broadcast(total), how="cross").select("kind", "value", F.col("n").cast("double").alias("n"), (100 * F.col("n") / F.col("_all")).alias("percent"))
    means = total.select(F.explode(F.array(F.struct(F.lit("question").alias("value"), F.col("_q").alias("n")), F.struct(F.lit("answer").alias("value"), F.col("_a").alias("n")))).alias("m"))
    return rows.unionByName(means.select(F.lit("words").alias("kind"), "m.value", "m.n", F.lit(None).cast("double").alias("percent")))


def group_stats(runs: DataFrame, by: str, value: str = "value") -> DataFrame:
    """by, count, mean, sample deviation, least and greatest, most frequent first."""
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")).orderBy(F.desc("count"), by)


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """(W, p) of Shapiro and Wilk's test of normality by Royston's approximation, for 3 to 5000 values; nan below or without spread."""
    from statistics import NormalDist

    x, n = sorted(values), len(values)
    if n < 3 or x[0] == x[-1]:
        return math.nan, math.nan
    if n > 5000:
        raise ValueError("at most 5000 values; give a sample")
    normal = NormalDist()
    m = [normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    square, u = sum(v * v for v in m), 1 / math.sqrt(n)
    poly = lambda c, t: sum(a * t**i for i, a in enumerate(c))
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        top = poly((m[-1] / math.sqrt(square), 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), u)
        if n > 5:
            second = poly((m[-2] / math.sqrt(square), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u)
            phi = (square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * top**2 - 2 * second**2)
            a = [-top, -second, *(v / math.sqrt(phi) for v in m[2:-2]), second, top]
        else:
            phi = (square - 2 * m[-1] ** 2) / (1 - 2 * top**2)
            a = [-top, *(v / math.sqrt(phi) for v in m[1:-1]), top]
    mean = sum(x) / n
    w = sum(p * q for p, q in zip(a, x, strict=True)) ** 2 / sum((v - mean) ** 2 for v in x)
    w = min(w, 1.0)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1.0:
        return w, 1.0
    if n <= 11:
        y = -math.log(poly((-2.273, 0.459), n) - math.log(1 - w))
        mu, sigma = poly((0.5440, -0.39978, 0.025054, -0.0006714), n), math.exp(poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        t = math.log(n)
        y = math.log(1 - w)
        mu, sigma = poly((-1.5861, -0.31082, -0.083751, 0.0038915), t), math.exp(poly((-0.4803, -0.082676, 0.0030302), t))
    return w, 1 - normal.cdf((y - mu) / sigma)


def best_and_worst(runs: DataFrame, value: str, id: str, n: int = 5) -> DataFrame:
    best = runs.orderBy(F.desc(value), id).limit(n).withColumn("which", F.lit("best"))
    return best.unionByName(runs.orderBy(value, id).limit(n).withColumn("which", F.lit("worst")))


def distribution(rows: DataFrame, by: str) -> DataFrame:
    """Count and share of all rows."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("_all"))), how="cross").select(by, "n", (100 * F.col("n") / F.col("_all")).alias("percent"))


def size_bucket(length: Column) -> Column:
    return F.when(length < 200, "0-200").when(length < 500, "200-500").when(length < 800, "500-800").when(length < 1000, "800-1000").otherwise("1000+")
