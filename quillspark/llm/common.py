"""What several operators share: written intermediates, byte-bounded Arrow batches, joins and ranks without hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import saved, shared_dir, slices  # noqa: F401

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

#: Rows and bytes that a lookup table may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20
#: A key is hot from so many rows on, or from this share of all rows: at most 1 / HOT_SHARE keys are.
HOT_ROWS, HOT_SHARE = 4096, 1 / 10_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Are the rows and the bytes of a saved df within the bounds?"""
    each = F.lit(16)
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            each = each + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) + 8
        elif kind.startswith(("array", "map", "struct")):
            each = each + F.coalesce(F.octet_length(F.to_json(F.struct(f"`{f.name}`"))), F.lit(0))
        else:
            each = each + 8
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(each), F.lit(0))).first()
    return n <= rows and total <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df (a saved one: it is counted) with a broadcast hint if its rows and bytes are within the bounds, else as it is."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores in front as make it differ from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def looked_up(df: DataFrame, table: DataFrame, keys: list[str], weight: str, spread: Column, bounds: tuple[int, int] = (BROADCAST_ROWS, BROADCAST_BYTES)) -> DataFrame:
    """df with the columns that a saved table has beside keys (unique there) and weight; rows without a match are dropped.

    weight: in how many rows of df, or at least how many, the key stands. Tables within the bounds
    (rows, bytes) are broadcast. Otherwise the hot
    keys, at most 1 / HOT_SHARE, are; the rows of the other keys meet the table by a shuffle, in which rows of hot keys
    are spread by a long that tells rows apart. keys and spread must not be null.
    """
    values = [c for c in table.columns if c not in (*keys, weight)]
    if is_small(table, *bounds):
        return df.join(F.broadcast(table.drop(weight)), keys)
    total = table.agg(F.sum(weight)).first()[0]
    hot = saved(table.where(F.col(weight) > max(HOT_ROWS, total * HOT_SHARE)))
    rest = table.drop(weight).withColumn("_salt", F.lit(0).cast("long"))
    if hot.isEmpty():
        return df.join(rest.drop("_salt"), keys)
    known = hot.select(*keys, F.struct(*values).alias("_hot"))
    df = df.join(F.broadcast(known), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(spread, F.lit(1 << 20))))
    out = df.join(rest.select(*keys, "_salt", F.struct(*values).alias("_cold")), [*keys, "_salt"], "left")
    out = out.withColumn("_found", F.coalesce("_hot", "_cold")).where("_found is not null")
    return out.select("*", "_found.*").drop("_hot", "_cold", "_found", "_salt")


def map_text(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = 4 << 20, column: str = "text") -> DataFrame:
    """mapInArrow over batches of at most limit bytes of text each."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in slices(batch, column, limit):
                out = f(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str, bucket: Column, per_task: int = 4096) -> DataFrame:
    """Adds a rank from 0 within keys (not null) to a saved table, without gathering a key in one task.

    Rows of a key are dealt by their hash (bucket, a long) into ceil(count / per_task) parts; the rank
    follows the parts and then order. A window sees one part only, and parts' offsets are sums over counts.
    """
    columns = df.columns
    df = df.withColumn("_h", F.pmod(bucket, F.lit(1 << 30)))
    total = saved(df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per_task).cast("long").alias("_parts"), F.count(F.lit(1)).alias("_rows")))
    df = looked_up(df, total, keys, "_rows", F.col("_h"))
    df = df.withColumn("_part", F.floor(F.col("_h") * F.col("_parts") / (1 << 30)))
    count = df.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    count = count.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    df = df.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_h", *order)) - 1)
    df = df.join(count, [*keys, "_part"])
    return df.select(*columns, (F.col("_in") + F.col("_before")).cast("long").alias(name))
