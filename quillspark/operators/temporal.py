"""Joins by time: the last row before a time (as-of), and rows whose interval holds a time.

as_of merges both sides in one shuffle: rows are dealt by ranges of key and time, so that a key with many rows lies in
several ranges, and stream through each range in order with the last right row in hand. What a range's first key has
seen before comes from the ranges before it: each range leaves its last right row, one row a range, and rows that found
none in their own range take it from there. No key is gathered, nothing but one row for each range is broadcast.

within deals both sides by key and stretch of time; an interval stands once in each stretch that it meets.

Defined cases: rows with a null key or time find nothing. With strict, a right row of the same time doesn't count. Of right
rows with one key and time the last by `ties` counts. Right columns come behind the left ones; names must differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved


def _merged(keys: list[str], left: list[str], right: list[str]):
    """Of a sorted range of both sides: left rows with the last right row of their key (kind 0), then the range's first (1) and last key (2), the latter with its last right row."""
    out = ["_kind", "_part", "_open", "_has", *keys, *left, *right]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        carry: pa.RecordBatch | None = None  # the row before: its key and the last right row of that key, _has tells whether there is one
        first: pa.RecordBatch | None = None
        same = True  # are all rows so far of the range's first key
        for batch in batches:
            if not batch.num_rows:
                continue
            head = carry if carry is not None else batch.slice(0, 1)
            table = pa.Table.from_batches([head, batch.select(head.schema.names) if carry is not None else batch]).combine_chunks()
            # Row 0 of table is what came before; without such, the first row stands there once more.
            n = table.num_rows
            new = np.zeros(n, bool)
            for k in keys:
                c = table.column(k)
                new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, n - 1)))
            own = np.asarray(table.column("_side")) == 0
            own[0] = carry is not None and bool(carry.column("_has")[0].as_py())
            at = np.arange(n)
            last = np.maximum.accumulate(np.where(own, at, -1))
            begin = np.maximum.accumulate(np.where(new, at, 0))
            found = last >= begin
            if first is None:
                first = batch.slice(0, 1)
            of_first = same & (begin == 0)
            rows = np.flatnonzero(np.asarray(table.column("_side")) == 1)
            rows = rows[rows > 0]
            take = pa.array(np.where(found, last, 0), mask=~found)
            values = {c: table.column(c).take(take) for c in right}
            if len(rows):
                pick = pa.array(rows)
                columns = {"_kind": pa.array(np.zeros(len(rows), np.int32)), "_part": table.column("_part").take(pick), "_open": pa.array((of_first & ~found)[rows]), "_has": pa.array(found[rows])}
                columns |= {c: table.column(c).take(pick) for c in (*keys, *left)} | {c: values[c].take(pick) for c in right}
                yield from pa.table(columns).select(out).combine_chunks().to_batches()
            same = same and begin[-1] == 0
            end = {c: table.column(c).slice(n - 1, 1) for c in table.column_names} | {c: values[c].slice(n - 1, 1) for c in right}
            end |= {"_has": pa.array([bool(found[-1])]), "_side": pa.array([2], table.schema.field("_side").type)}
            carry = pa.table(end).select(table.column_names).cast(table.schema).combine_chunks().to_batches()[0]
        if carry is not None:
            for kind, row in ((1, first), (2, carry)):
                table = pa.Table.from_batches([row])
                none = {c: pa.nulls(1, table.schema.field(c).type) for c in (*left, *(right if kind == 1 else ()))}
                columns = {c: table.column(c) for c in (*keys, "_part", *left, *right)} | none
                columns |= {"_kind": pa.array([kind], pa.int32()), "_open": pa.array([False]), "_has": pa.array([kind == 2 and bool(row.column("_has")[0].as_py())])}
                yield from pa.table(columns).select(out).combine_chunks().to_batches()

    return run


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, strict: bool = False, ties: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """left with the columns of the last row of right that has the same keys and a time up to left's (before it with strict), nulls where there is none."""
    spark = left.sparkSession
    values = [c for c in right.columns if c not in keys]
    if clash := {c.lower() for c in left.columns} & {c.lower() for c in values}:
        raise ValueError(f"both sides have {sorted(clash)}")
    others = [c for c in left.columns if c not in keys]
    kinds = dict(left.dtypes) | {c: t for c, t in right.dtypes if c not in keys}
    none = lambda names: [F.lit(None).cast(kinds[c]).alias(c) for c in names]
    known = lambda df, time: df.where(" and ".join(f"`{c}` is not null" for c in [*keys, time]))
    tie = F.struct(*ties) if ties else F.struct(F.lit(0))
    a = known(left, left_time).select(*keys, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(_kind_of(right, ties)).alias("_tie"), *others, *none(values))
    b = known(right, right_time).select(*(F.col(k).cast(kinds[k]).alias(k) for k in keys), F.col(right_time).alias("_time"), F.lit(0).alias("_side"), tie.alias("_tie"), *none(others), *values)
    order = [*keys, "_time", F.when(F.col("_side") == 1, 0 if strict else 2).otherwise(1), "_tie"]
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = a.unionByName(b).repartitionByRange(parts, *keys, "_time").sortWithinPartitions(*order)
    rows = rows.select(F.spark_partition_id().alias("_part"), "_side", F.lit(False).alias("_has"), *keys, *others, *values)
    schema = ", ".join(["_kind int, _part int, _open boolean, _has boolean", *(f"`{c}` {kinds[c]}" for c in (*keys, *others, *values))])
    merged = saved(rows.mapInArrow(_merged(keys, others, values), schema))
    before = Window.partitionBy(*keys).orderBy("_part", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("_has"), F.struct(*values)), ignorenulls=True).over(before)
    heads = merged.where("_kind > 0").withColumn("_carried", carried).where("_kind = 1").select(F.col("_part").alias("_of"), "_carried")
    out = merged.where("_kind = 0").join(F.broadcast(heads), F.col("_open") & (F.col("_part") == F.col("_of")), "left")  # a row for each range
    picked = [F.when(F.col("_open"), F.col("_carried")[c]).otherwise(F.col(c)).alias(c) for c in values]
    out = out.select(*left.columns, *picked)
    rest = left.where(" or ".join(f"`{c}` is null" for c in [*keys, left_time]))
    return out.unionByName(rest.select("*", *none(values)))


def _kind_of(right: DataFrame, ties: list[str] | None) -> str:
    return right.select(F.struct(*ties) if ties else F.struct(F.lit(0))).dtypes[0][1]


def within(left: DataFrame, right: DataFrame, keys: list[str], time: str, start: str, end: str, seconds: int) -> DataFrame:
    """Rows of left and right with equal keys where right's start <= left's time < right's end. seconds: length of the stretches that rows are dealt by."""

    def stretch(df: DataFrame, c: str, less: int = 0) -> Column:
        kind = dict(df.select(c).dtypes)[c]
        micros = F.unix_micros(F.col(c)) if kind == "timestamp" else F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{c}`)")
        return F.floor((micros - less) / (seconds * 1_000_000))

    a = left.withColumn("_stretch", stretch(left, time))
    b = right.where(F.col(start) < F.col(end)).withColumn("_stretch", F.explode(F.sequence(stretch(right, start), stretch(right, end, 1))))
    pairs = a.join(b, [*keys, "_stretch"]).where((F.col(start) <= F.col(time)) & (F.col(time) < F.col(end)))
    return pairs.drop("_stretch")
