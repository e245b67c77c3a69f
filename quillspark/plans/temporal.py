"""Queries by time: sessions, as-of and interval joins of events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal
from ..streaming import sessions
from .registry import _t, query

#: A key that holds a third of both sides; orders are moved into the events' month. Alike in both engines.
_EVENT_KEY = "CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id % 40 END"
_BEGIN = "timestamp_ntz'2024-01-01 00:00:00'"
_ORDER_KEY = "CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey % 40 END"


@query("""
WITH s AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, round(sum(value), 6) AS total FROM n GROUP BY user_id, session
""")
def p_sessions(spark, sf):
    """Sessions of each user's events, at most six hours between two."""
    return sessions.sessions(_t(spark, sf, "events"), "6 hours").withColumn("total", F.round("total", 6))


@query(f"""
WITH e AS (SELECT event_id, {_EVENT_KEY} AS k, ts FROM events),
o AS (SELECT {_ORDER_KEY} AS k, TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 7919 % 2592000) AS t, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
SELECT event_id, e.k, coalesce(o_orderkey, -1) AS o_orderkey, coalesce(t, TIMESTAMP '2024-01-01') AS ordered FROM e ASOF LEFT JOIN o ON e.k = o.k AND e.ts >= o.t
""")
def p_as_of_orders(spark, sf):
    """The last order before each event; one key holds a third of both tables."""
    events = _t(spark, sf, "events").select("event_id", F.expr(f"cast({_EVENT_KEY} as long)").alias("k"), "ts")
    moved = F.expr(f"{_BEGIN} + make_dt_interval(0, 0, 0, o_orderkey * 7919 % 2592000)")
    orders = _t(spark, sf, "orders").select(F.expr(f"cast({_ORDER_KEY} as long)").alias("k"), moved.alias("ordered"), "o_orderkey")
    out = temporal.as_of(events, orders, ["k"], "ts", "ordered", ties=["o_orderkey"])
    return out.select("event_id", "k", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"), F.coalesce("ordered", F.expr(_BEGIN)).alias("ordered"))


@query(f"""
WITH e AS (SELECT event_id, {_EVENT_KEY} AS k, ts FROM events),
o AS (SELECT o_orderkey, {_ORDER_KEY} AS k, TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 7919 % 2592000) AS a, 60 + o_orderkey % 1800 AS long FROM orders),
j AS (SELECT e.k, e.event_id, o.o_orderkey FROM e JOIN o ON e.k = o.k AND e.ts >= o.a AND e.ts < o.a + to_seconds(o.long))
SELECT k, count(*) AS pairs, count(DISTINCT event_id) AS events, CAST(sum(o_orderkey) AS BIGINT) AS orders FROM j GROUP BY k
""")
def p_order_intervals(spark, sf):
    """Events within a while after an order of their key."""
    events = _t(spark, sf, "events").select("event_id", F.expr(f"cast({_EVENT_KEY} as long)").alias("k"), "ts")
    begin = f"{_BEGIN} + make_dt_interval(0, 0, 0, o_orderkey * 7919 % 2592000"
    orders = _t(spark, sf, "orders").select("o_orderkey", F.expr(f"cast({_ORDER_KEY} as long)").alias("k"), F.expr(f"{begin})").alias("a"), F.expr(f"{begin} + 60 + o_orderkey % 1800)").alias("b"))
    pairs = temporal.within(events, orders, ["k"], "ts", "a", "b", 3600)
    return pairs.groupBy("k").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("event_id").alias("events"), F.sum("o_orderkey").alias("orders"))
