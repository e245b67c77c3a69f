"""The answer cache, as a table function and as state of a stream, against a plain ordered dictionary for each shard."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import cache


def plain(asked, size, ttl, shards):
    """Hits by order number of (n, query, at)."""
    each, held, out = -(-size // shards), [{} for _ in range(shards)], {}
    for n, q, at in sorted(asked, key=lambda r: (r[2], r[0])):
        slot = held[int(hashlib.md5((q or "").encode()).hexdigest()[:7], 16) % shards]
        for old in [k for k, t in slot.items() if ttl is not None and t + ttl <= at]:
            del slot[old]
        out[n] = (q or "") in slot
        if not out[n] and each:
            if len(slot) >= each:
                del slot[next(iter(slot))]
            slot[q or ""] = at
    return out


def questions(seed, n=400, kinds=40):
    rng = random.Random(seed)
    return [(i, rng.choice([None, "", *(f"pergunta {rng.randrange(kinds)}" for _ in range(8))]), i * 3 // 2) for i in range(n)]


@pytest.mark.parametrize(("size", "ttl", "shards"), [(10, None, 1), (10, 30, 1), (16, 50, 4), (5, 7, 4), (0, 10, 2), (1000, None, 7)])
def test_batches(spark, size, ttl, shards):
    asked = questions(size + shards)
    rows = spark.createDataFrame(random.Random(1).sample(asked, len(asked)), "n long, query string, at long").repartition(5)
    got = cache.slots(rows, size, ttl, shards, at="at")
    assert got.columns == ["n", "query", "at", "hit"]
    found = {r.n: r.hit for r in got.collect()}
    assert found == plain(asked, size, ttl, shards) and (size == 0 or any(found.values()))


def test_shards_run_side_by_side(spark):
    rows = spark.createDataFrame(questions(0), "n long, query string, at long")
    plan = cache.slots(rows, 16, None, 8, at="at")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(partition_by" in plan and "SinglePartition" not in plan


def test_empty_batch(spark):
    assert cache.slots(spark.createDataFrame([], "n long, query string"), 5).count() == 0


@pytest.mark.parametrize("ttl", [None, 40])
def test_stream_with_restart(spark, tmp_path, ttl):
    """Three runs of one checkpoint over files that come in between: the state goes on, timers free what is too old."""
    asked = questions(9, 240, 15)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    base = int(start.timestamp())
    found = {}
    for part in range(3):
        some = [(n, q, start + datetime.timedelta(seconds=at)) for n, q, at in asked[part * 80 : part * 80 + 80]]
        spark.createDataFrame(some, "n long, query string, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("n long, query string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = cache.stream_slots(stream, 8, ttl, 4, late="10 seconds").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp")
        out.foreachBatch(lambda df, _: found.update({r.n: r.hit for r in df.collect()})).trigger(availableNow=True).start().awaitTermination()
    assert found == plain([(n, q, base + at) for n, q, at in asked], 8, ttl, 4) and any(found.values())


def test_shards_are_alike_everywhere(spark):
    got = spark.createDataFrame([("a",), ("é",)], "q string").select("q", cache.shard_of(F.col("q"), 13).alias("s")).collect()
    assert {r.q: r.s for r in got} == {q: int(hashlib.md5(q.encode()).hexdigest()[:7], 16) % 13 for q in ("a", "é")}
