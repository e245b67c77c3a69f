"""Totals on several levels at once, and summaries that can be kept and merged.

totals: sums, counts and distinct counts over every prefix (rollup) or every subset (cube) of the keys, with the level that
a row belongs to, in one pass over the rows.

Sketches: HyperLogLog for distinct counts and KLL for quantiles as binary columns, one row for each group. They are kept as
a table and merged for any set of groups later, without the rows. KLL ranks are within about 1.7 percent of the rows at k of 200;
distinct counts within about 1.6 percent at 12 bits (one standard error); both are exact for few values.

Defined cases: null keys are a group of their own, told from a total by the level. Null values count in n alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HLL_BITS, KLL_K = 12, 200


def totals(rows: DataFrame, keys: list[str], sums: list[str], distinct: list[str] = (), every: bool = False) -> DataFrame:
    """keys, level, n, sum_<c>, distinct_<c>: level has a bit for each key that the row sums over, the first key's highest."""
    grouped = rows.cube(*keys) if every else rows.rollup(*keys)
    columns = [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in sums), *(F.countDistinct(c).alias(f"distinct_{c}") for c in distinct)]
    return grouped.agg(F.grouping_id().alias("level"), *columns)


def sketched(rows: DataFrame, keys: list[str], distinct: dict[str, Column] | None = None, quantiles: dict[str, Column] | None = None) -> DataFrame:
    """keys, n and a sketch under each name. quantiles' columns are whole numbers."""
    out = [F.count(F.lit(1)).alias("n")]
    out += [F.hll_sketch_agg(c, HLL_BITS).alias(k) for k, c in (distinct or {}).items()]
    out += [F.kll_sketch_agg_bigint(c.cast("long"), KLL_K).alias(k) for k, c in (quantiles or {}).items()]
    return rows.groupBy(*keys).agg(*out)


def merged(sketches: DataFrame, keys: list[str], distinct: list[str] = (), quantiles: list[str] = ()) -> DataFrame:
    """Sketches of several rows as one for each of keys (none: one row)."""
    out = [F.sum("n").alias("n"), *(F.hll_union_agg(k).alias(k) for k in distinct)]
    return sketches.groupBy(*keys).agg(*out, *(F.kll_merge_agg_bigint(k).alias(k) for k in quantiles))


def distinct_of(sketch: str) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile_of(sketch: str, share: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(F.col(sketch), F.lit(share))
