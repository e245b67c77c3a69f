"""The answer cache as keyed state (M1): which questions are in a first-in-first-out cache of limited size and age as they are asked.

Questions are dealt over shards by a digest; a shard is a cache of its own that holds size / shards different questions
(rounded up), so that shards run side by side; one shard is one cache. A question that is not in is put in as it is asked; the
oldest one leaves when a shard is full, and any leaves when it has been in for ttl seconds. Since all live equally long,
what is too old is always at the old end.

Batches (slots) go through a table function that Spark gives a shard's questions in order: a worker holds a shard's
questions, not the batch. Streams (stream_slots) keep the shard in state that survives restarts: a map from place to
question, a map from question to place, and both ends; with ttl, a timer frees what is too old though nobody asks.

Defined cases: a null question is an empty one. A size of 0 holds nothing. Questions of one time go by their order number.
Times in a stream follow the watermark: what comes later than that is left out by the stream, as by any of its operators.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shard_of(question: Column, shards: int) -> Column:
    """From 0: 28 bits of the question's MD5."""
    return (F.conv(F.substring(F.md5(question.cast("binary")), 1, 7), 16, 10).cast("long") % shards).cast("int")


def _each(size: int, shards: int) -> int:
    return -(-size // shards)


class Slots:
    """A shard's questions and the times they were put in, oldest first."""

    def __init__(self, size: int, ttl: int | None):
        self.size, self.ttl = size, ttl
        self.held: OrderedDict[str, int] = OrderedDict()

    def ask(self, question: str, at: int) -> bool:
        held = self.held
        while self.ttl is not None and held and next(iter(held.values())) + self.ttl <= at:
            held.popitem(last=False)
        if question in held:
            return True
        if self.size > 0:
            if len(held) >= self.size:
                held.popitem(last=False)
            held[question] = at
        return False


class CacheSlots:
    """cache_slots(TABLE(rows), size => n, ttl => seconds or null): rows with _shard, _order, _query and _at (long seconds); all columns but these, and hit."""

    def __init__(self):
        self.slots: Slots | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, ttl: AnalyzeArgument) -> AnalyzeResult:
        own = [f for f in rows.dataType.fields if f.name not in ("_shard", "_order", "_query", "_at")]
        return AnalyzeResult(schema=T.StructType([*own, T.StructField("hit", T.BooleanType())]), partitionBy=[PartitioningColumn("_shard")], orderBy=[OrderingColumn("_order")])

    def eval(self, rows, size, ttl):
        self.slots = self.slots or Slots(size, ttl)
        d = rows.asDict()
        question, at = d.pop("_query"), d.pop("_at")
        del d["_shard"], d["_order"]
        yield *d.values(), self.slots.ask(question, at)


def _prepared(asked: DataFrame, shards: int, query: str, order: str, at: str | None) -> DataFrame:
    question = F.coalesce(F.col(query), F.lit(""))
    time = F.unix_seconds(F.col(at)) if at and dict(asked.dtypes)[at].startswith("timestamp") else F.col(at).cast("long") if at else F.lit(0).cast("long")
    return asked.select("*", shard_of(question, shards).alias("_shard"), F.struct(F.coalesce(time, F.lit(0).cast("long")), F.col(order)).alias("_order"), question.alias("_query"), F.coalesce(time, F.lit(0).cast("long")).alias("_at"))


def slots(asked: DataFrame, size: int, ttl: int | None = None, shards: int = 1, query: str = "query", order: str = "n", at: str | None = None) -> DataFrame:
    """asked with hit. at: a time or a number of seconds; without it nothing grows old."""
    spark = asked.sparkSession
    spark.udtf.register("cache_slots", udtf(CacheSlots))
    rows = _prepared(asked, shards, query, order, at)
    return spark.sql(f"SELECT * FROM cache_slots(TABLE({{rows}}), size => {_each(size, shards)}, ttl => {'CAST(NULL AS INT)' if ttl is None else int(ttl)})", rows=rows)


class SlotState(StatefulProcessor):
    """A shard of the cache in the state of a stream."""

    def __init__(self, size: int, ttl: int | None):
        self.size, self.ttl = size, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at_place = handle.getMapState("at_place", "place long", "question string, at long")
        self.place_of = handle.getMapState("place_of", "question string", "place long")
        self.ends = handle.getValueState("ends", "first long, after long")

    def _drop(self, first: int) -> int:
        question, _ = self.at_place.getValue((first,))
        self.at_place.removeKey((first,))
        self.place_of.removeKey((question,))
        return first + 1

    def _old(self, first: int, after: int, now: int) -> int:
        while self.ttl is not None and first < after and self.at_place.getValue((first,))[1] + self.ttl <= now:
            first = self._drop(first)
        return first

    def _remind(self, first: int, after: int) -> None:
        """One timer, for the oldest question."""
        if self.ttl is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if first < after:
            self.handle.registerTimer((self.at_place.getValue((first,))[1] + self.ttl) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, after = self.ends.get() if self.ends.exists() else (0, 0)
        for r in sorted(rows, key=lambda r: tuple(r["_order"])):
            question, at = r["_query"], r["_at"]
            first = self._old(first, after, at)
            hit = self.place_of.containsKey((question,))
            if not hit and self.size > 0:
                if after - first >= self.size:
                    first = self._drop(first)
                self.at_place.updateValue((after,), (question, at))
                self.place_of.updateValue((question,), (after,))
                after += 1
            d = {k: v for k, v in r.asDict().items() if not k.startswith("_")}
            yield Row(**d, hit=hit)
        self.ends.update((first, after))
        self._remind(first, after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.ends.exists():
            first, after = self.ends.get()
            first = self._old(first, after, expiredTimerInfo.getExpiryTimeInMs() // 1000)
            self.ends.update((first, after))
            if first < after:
                self.handle.registerTimer((self.at_place.getValue((first,))[1] + self.ttl) * 1000)
        yield from ()

    def close(self) -> None:
        pass


def stream_slots(asked: DataFrame, size: int, ttl: int | None = None, shards: int = 1, query: str = "query", order: str = "n", at: str = "at", late: str = "0 seconds") -> DataFrame:
    """A stream of asked (at: a timestamp) with hit, for output mode update. Within a micro-batch questions go in order of time and number."""
    spark = asked.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = _prepared(asked.withWatermark(at, late) if ttl is not None else asked, shards, query, order, at)
    out = T.StructType([*(f for f in asked.schema.fields), T.StructField("hit", T.BooleanType())])
    return rows.groupBy("_shard").transformWithState(SlotState(_each(size, shards), ttl), out, "update", "none" if ttl is None else "eventTime")
