"""Joins by time and sessions against plain Python; streams with late rows and restarts against one batch."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import temporal
from quillspark.streaming import sessions

T0 = datetime.datetime(2024, 3, 1, 12)


def at(seconds):
    return None if seconds is None else T0 + datetime.timedelta(seconds=seconds)


def sides(seed, n=500):
    """Left (id, k, j, t) and right (k, j, u, v, w): a key with most rows, keys of one side only, nulls, equal times."""
    rng = random.Random(seed)
    key = lambda: (rng.choice([1, 1, 1, 1, 2, 3, 50, None]), rng.choice(["a", "a", "a", "b"]))
    time = lambda: at(rng.choice([None, *range(0, 3000, 7)]))
    left = [(i, *key(), time()) for i in range(n)] + [(n, 77, "a", at(5))]
    right = [(*key(), time(), i, None if i % 9 == 0 else f"w{i}") for i in range(n)] + [(99, "a", at(1), n, "alone")]
    return left, right


LEFT, RIGHT = "id long, k long, j string, t timestamp_ntz", "k long, j string, u timestamp_ntz, v long, w string"


@pytest.mark.parametrize(("strict", "ranges"), [(False, 1), (True, 5), (False, 5), (False, 60)])
def test_as_of(spark, strict, ranges):
    left, right = sides(ranges)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = temporal.as_of(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k", "j"], "t", "u", strict, ["v"], ranges).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i, k, j, t in left:
        fits = [r for r in right if None not in (k, t, r[2]) and (r[0], r[1]) == (k, j) and (r[2] < t if strict else r[2] <= t)]
        want[i] = max(fits, key=lambda r: (r[2], r[3]))[2:] if fits else (None, None, None)
    assert got[0].__fields__ == ["id", "k", "j", "t", "u", "v", "w"]
    assert {r.id: (r.u, r.v, r.w) for r in got} == want and len(got) == len(left) and sum(v[1] is not None for v in want.values()) > 200


def test_as_of_of_empty_sides(spark):
    left, right = sides(0, 20)
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    assert temporal.as_of(a.limit(0), b, ["k", "j"], "t", "u").count() == 0
    assert temporal.as_of(a, b.limit(0), ["k", "j"], "t", "u").where("v is null").count() == len(left)
    with pytest.raises(ValueError):
        temporal.as_of(a, b.withColumnRenamed("w", "ID"), ["k", "j"], "t", "u")


def test_as_of_spreads_a_key(spark):
    left = spark.range(20_000).select(F.col("id"), F.lit(1).alias("k"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id") * 2)).cast("timestamp_ntz").alias("t"))
    right = spark.range(20_000).select(F.lit(1).alias("k"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id") * 2 - 1)).cast("timestamp_ntz").alias("u"), F.col("id").alias("v"))
    got = temporal.as_of(left, right, ["k"], "t", "u", ranges=8)
    assert got.where("v <> id or v is null").count() == 0 and got.count() == 20_000


def test_within(spark):
    rng = random.Random(3)
    left = [(i, rng.choice([1, 1, 2, None]), at(rng.randrange(5000))) for i in range(300)]
    right = [(rng.choice([1, 1, 2, None]), at(a), at(a + rng.choice([-5, 0, 1, 30, 2500])), i) for i, a in enumerate(rng.randrange(5000) for _ in range(300))]
    got = temporal.within(spark.createDataFrame(left, "id long, k long, t timestamp_ntz"), spark.createDataFrame(right, "k long, a timestamp_ntz, b timestamp_ntz, v long"), ["k"], "t", "a", "b", 100)
    want = sorted((i, v) for i, k, t in left for q, a, b, v in right if k is not None and k == q and a <= t < b)
    assert sorted((r.id, r.v) for r in got.collect()) == want and len(want) > 1000


def plain_sessions(rows, gap):
    out = []
    for u, t, v in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1])):
        if out and out[-1][0] == u and (t - out[-1][2]).total_seconds() <= gap:
            out[-1][2:] = [t, out[-1][3] + 1, out[-1][4] + (v or 0)]
        else:
            out.append([u, t, t, 1, v or 0])
    return sorted(map(tuple, out))


def rows_of(df):
    return sorted((r.user_id, r.first, r.last, r.n, r.total or 0) for r in df.collect())


EVENTS, SESSION = "user_id long, ts timestamp_ntz, value double", "user_id long, first timestamp_ntz, last timestamp_ntz, n long, total double"


def test_sessions(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 2, 3, None]), at(rng.randrange(0, 90_000) + 0.5), rng.choice([1.0, 2.5, None])) for _ in range(600)]
    assert rows_of(sessions.sessions(spark.createDataFrame(rows, EVENTS), "100 seconds")) == plain_sessions(rows, 100)
    whole = spark.createDataFrame(rows, EVENTS).where("user_id is not null").selectExpr("user_id", "ts as first", "ts as last", "1L as n", "value as total")
    assert rows_of(sessions.joined(whole, 100, "user_id")) == plain_sessions(rows, 100)


def test_stream_keeps_late_rows(spark, tmp_path):
    """Files come in three runs of one checkpoint; what is older than the watermark lies with the late rows, the rest gives the sessions of a batch."""
    rng = random.Random(8)
    rows = [(rng.choice([1, 2, 3]), i * 20 + rng.randrange(-200, 200), 1.0) for i in range(300)]
    late = [(1, 10, 5.0), (2, 900, 5.0), (None, 7, 5.0), (3, None, 5.0)]  # come last
    parts = [rows[:100], rows[100:200], rows[200:], late]
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    mark, on_time, lost = None, [], []
    for part in parts:
        some = [(u, at(t), v) for u, t, v in part]
        for u, t, v in some:
            (lost if u is None or t is None or (mark and t < mark) else on_time).append((u, t, v))
        new = max((t for u, t, v in some if u is not None and t is not None and not (mark and t < mark)), default=None)
        mark = max(x for x in (mark, new and new - datetime.timedelta(seconds=600)) if x)
        spark.createDataFrame(some, EVENTS).coalesce(1).write.mode("append").parquet(src)
        sessions.stream(spark.readStream.schema(EVENTS).parquet(src), out, f"{tmp_path}/cp", 120, 600).awaitTermination()
    got = sessions.read(spark, out, "closed", SESSION).unionByName(sessions.read(spark, out, "open", SESSION))
    assert rows_of(got) == plain_sessions(on_time, 120)
    kept = sessions.read(spark, out, "late", EVENTS)
    assert sorted(((r.user_id, r.ts, r.value) for r in kept.collect()), key=str) == sorted(lost, key=str) and len(lost) == 4
    assert sessions.read(spark, out, "closed", SESSION).count() > 10 and sessions.read(spark, out, "open", SESSION).count() < 10


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    sink = sessions.SessionSink(str(tmp_path), 60, 10)
    rows = spark.createDataFrame([(1, at(0), 1.0), (1, at(300), 1.0)], EVENTS)
    for _ in range(2):
        sink(rows, 0)
    assert sessions.read(spark, str(tmp_path), "closed", SESSION).count() == 1
    for _ in range(2):
        sink(spark.createDataFrame([(1, at(310), 1.0), (1, at(5), 1.0)], EVENTS), 1)
    assert [(r.n, r.total) for r in sessions.read(spark, str(tmp_path), "open", SESSION).collect()] == [(2, 2.0)]
    assert sessions.read(spark, str(tmp_path), "late", EVENTS).count() == 1
