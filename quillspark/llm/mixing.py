"""Mixing sources to target weights: subset-sum budget fitting over counts of documents by exact length.

Method. Sizes are words. Targets share the sum of all sizes by weight; none exceeds `most` times its source, what is
above goes to the others by weight. A source repeats each document floor(target / size of the source) times and fills
the rest from a histogram of its documents' sizes: a proportional share of each size first, then a bounded-knapsack
dynamic programme over what is left of the budget. Which documents of a size are taken follows a seeded hash; ranks
come from counts of hash parts, so that no source or size gathers in one task.

Defined cases: a null text has size 0. A null source is a source, last in order. Sources of size 0 take nothing. Equal
rows get ranks in any order, with the same sum. A source's totals are gathered on the driver: one row for each source.
Sizes of very long texts count whole; a size above WINDOW is taken by the proportional share and the greedy step, or by
the programme where the rest of the budget holds it. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, documents, looked_up, ranked, saved

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 20240229
#: The largest budget that the dynamic programme fills, in words.
WINDOW = 1 << 17


def targets(totals: dict[str | None, int], weights=WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Sources that reach their limit are those of the greatest weight for their size: they are taken off in that order."""
    names = sorted((k for k in totals if k is not None)) + [None] * (None in totals)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    left, total = sum(totals.values()), sum(weight.values())
    out: dict[str | None, float] = {}
    for k in sorted(names, key=lambda k: most * totals[k] / weight[k]):
        if left * weight[k] <= most * totals[k] * total:
            break
        out[k] = float(most * totals[k])
        left, total = left - most * totals[k], total - weight[k]
    return {k: out[k] if k in out else left * weight[k] / total for k in names}


def fill(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that the sum comes as near to budget, from below, as the programme finds."""
    take = np.zeros(len(sizes), np.int64)
    whole = int((sizes * counts).sum())
    if budget <= 0 or whole <= 0:
        return take
    if budget >= whole:
        return counts.copy()
    take = np.array([int(c) * budget // whole for c in counts], np.int64)
    left = budget - int((take * sizes).sum())
    order = np.argsort(-sizes, kind="stable")
    for i in order:
        if left <= WINDOW:
            break
        if sizes[i] > 0:
            n = min(int(counts[i] - take[i]), (left - WINDOW // 2) // int(sizes[i]))
            take[i] += n
            left -= n * int(sizes[i])
    left = int(left)
    reach = np.zeros(left + 1, bool)
    reach[0] = True
    by = np.full(left + 1, -1, np.int64)  # the item that first reached a sum; what it came from was reached before it
    items: list[tuple[int, int, int]] = []
    for i in order:
        size, n, k = int(sizes[i]), int(counts[i] - take[i]), 1
        n = min(n, left // size) if size > 0 else 0
        while n > 0 and not reach[left]:
            k = min(k, n)
            w = k * size
            new = reach[: left + 1 - w] & ~reach[w:]
            by[w:][new] = len(items)
            reach[w:] |= new
            items.append((int(i), k, w))
            n, k = n - k, 2 * k
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, k, w = items[by[at]]
        take[i] += k
        at -= w
    return take


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, row (hash of the text), source, size, source_size, target, times (how often the document is taken), taken."""
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col("source").cast("string").alias("source"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")))
    totals = {(None if r.key == "-" else r.key[1:]): int(r.total) for r in rows.groupBy("key").agg(F.sum("size").alias("total")).toLocalIterator()}
    goal = targets(totals, weights, most)
    plan = []
    for name, total in totals.items():
        base = min(most, int(goal[name] // total)) if total else 0
        plan.append(("-" if name is None else "=" + name, total, float(goal[name]), base, round(goal[name] - base * total) if total and base < most else 0))
    plan_df = spark.createDataFrame(plan, "key string, source_size long, target double, base long, budget long")
    hist = rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")).join(plan_df, "key")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "n": pdf["n"], "more": fill(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["budget"].iloc[0])), "source_size": pdf["source_size"], "target": pdf["target"], "base": pdf["base"]})

    chosen = saved(hist.groupBy("key").applyInPandas(choose, "key string, size long, n long, more long, source_size long, target double, base long"))
    rows = ranked(rows, ["key", "size"], [F.col("doc_id"), F.col("row")], "rank", F.xxhash64(F.lit(seed), "doc_id", "row"))
    out = looked_up(rows, chosen, ["key", "size"], "n", F.xxhash64("doc_id", "row")).withColumn("times", F.col("base") + (F.col("rank") < F.col("more")).cast("long"))
    return out.select("doc_id", "row", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
