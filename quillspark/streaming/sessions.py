"""Sessions of events: runs of a key's events with no gap longer than a limit, in batch and as a stream that keeps its late rows.

A batch is Spark's own session window, merged within tasks before the shuffle. A stream goes batch by batch: rows
older than the watermark, the greatest time of all batches before less a delay, are late; they are written apart, not lost.
The others join the open sessions of their keys; sessions that the new watermark has left behind are closed and written.
Open sessions and the watermark are kept under the number of the batch, and what a batch writes lies in a folder of its
number, so that a batch that runs again after a failure replaces its own rows. The state grows with the open sessions.

Defined cases: rows with a null key or time are late from the start. Null values count as rows, not in the sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, gap: str, key: str = "user_id", time: str = "ts", value: str = "value") -> DataFrame:
    """key, first, last, n, total of each session; gap as an interval, "30 minutes"."""
    events.sparkSession.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    rows = events.where(f"`{key}` is not null").groupBy(key, F.session_window(time, gap).alias("w"))
    return rows.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).drop("w")


def joined(parts: DataFrame, gap: int, key: str) -> DataFrame:
    """Pieces of sessions (key, first, last, n, total), those of a key not more than gap seconds apart made one."""
    order = Window.partitionBy(key).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = parts.withColumn("_new", (F.col("first") > reach + F.make_dt_interval(secs=F.lit(gap))).cast("int"))
    rows = rows.withColumn("_session", F.sum(F.coalesce("_new", F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_session").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("total").alias("total")).drop("_session")


class SessionSink:
    """Writes closed sessions to out/closed and late rows to out/late, by batch; the state is in out/open and out/mark."""

    def __init__(self, out: str, gap: int, delay: int, key: str = "user_id", time: str = "ts", value: str = "value"):
        self.out, self.gap, self.delay, self.key, self.time, self.value = out, gap, delay, key, time, value

    def _state(self, spark: SparkSession, name: str, batch: int, schema: str) -> DataFrame:
        if batch < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.out}/{name}/batch={batch}")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark, key, time = rows.sparkSession, self.key, self.time
        kind, when = dict(rows.dtypes)[key], dict(rows.dtypes)[time]
        mark = self._state(spark, "mark", batch - 1, f"mark {when}").first()
        mark = mark.mark if mark else None
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{self.out}/{name}/batch={batch}")
        known = F.col(key).isNotNull() & F.col(time).isNotNull()
        on_time = known & (F.lit(True) if mark is None else F.col(time) >= F.lit(mark))
        put(rows.where(~on_time), "late")
        fresh = rows.where(on_time)
        most = fresh.agg(F.max(time)).first()[0]
        pieces = fresh.select(key, F.col(time).alias("first"), F.col(time).alias("last"), F.lit(1).cast("long").alias("n"), F.col(self.value).cast("double").alias("total"))
        held = self._state(spark, "open", batch - 1, f"`{key}` {kind}, first {when}, last {when}, n long, total double")
        now = spark.range(1).select(F.greatest(F.lit(mark).cast(when), F.lit(most).cast(when) - F.make_dt_interval(secs=F.lit(self.delay))).alias("mark"))
        put(now, "mark")
        after = self._state(spark, "mark", batch, f"mark {when}").first().mark
        done = F.col("last") + F.make_dt_interval(secs=F.lit(self.gap)) < F.lit(after).cast(when)
        whole = joined(pieces.unionByName(held), self.gap, key).withColumn("_done", F.coalesce(done, F.lit(False)))
        whole.withColumn("_where", F.when(F.col("_done"), "closed").otherwise("open")).drop("_done").write.mode("overwrite").partitionBy("_where").parquet(f"{self.out}/all/batch={batch}")
        both = spark.read.schema(f"`{key}` {kind}, first {when}, last {when}, n long, total double, _where string").parquet(f"{self.out}/all/batch={batch}")
        for name in ("closed", "open"):
            put(both.where(F.col("_where") == name).drop("_where"), name)


def stream(events: DataFrame, out: str, checkpoint: str, gap: int, delay: int, key: str = "user_id", time: str = "ts", value: str = "value") -> StreamingQuery:
    """Sessions of a stream of events until what is there now has gone through; gap and delay in seconds."""
    sink = SessionSink(out, gap, delay, key, time, value)
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, out: str, name: str, schema: str) -> DataFrame:
    """closed sessions or late rows of all batches; with name open, the sessions that are still open."""
    if name != "open":
        return spark.read.schema(schema).parquet(f"{out}/{name}").drop("batch")
    last = spark.read.schema("batch int").parquet(f"{out}/mark").agg(F.max("batch")).first()[0]
    return spark.read.schema(schema).parquet(f"{out}/open/batch={last}")
