"""Streaming queries over the events and orders tables, drained once; their SQL is the batch twin up to the last watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrane import bindings as B
from terrane.plans import containment as P
from terrane.plans import rules
from terrane.session import shared_dir, stored
from terrane.streaming import jobs as J

STORE = ["c_custkey AS store_id", "c_mktsegment AS channel", "c_nationkey AS district", "c_mktsegment = 'FURNITURE' AS direct", f"{B.X0} + (c_custkey * 7919 * 31) % {B.SIDE} AS x", f"{B.Y0} + (c_custkey * 104729 * 17) % {B.SIDE} AS y"]

SCOPE, BAD = "user_id % 8", "CAST(event_type = 'error' AS BIGINT)"


#: Days from 1970 to the period 0 of the gaps.
DAY_ZERO = 19_723


def events(spark, d):
    return J.read_stream(spark, f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


def live(spark, d):
    """Arriving stores, classified by the fences that hold them; the count of stores per kind."""
    arriving = J.read_stream(spark, f"{d}/customer.parquet").selectExpr(*STORE)
    fences, suppliers = stored(B.fences(spark, d), "fences"), stored(B.main_suppliers(spark, d), "suppliers")
    return J.classified(arriving, fences, suppliers, "live").groupBy("kind").agg(F.count("*").alias("n"))


def decisions(spark, d):
    """The trigger state machine over gaps that arrive in four parts, in order of period; it is restarted for each."""
    g = stored(rules.triggers(spark, d).withColumn("at", F.timestamp_seconds((F.col("n") + DAY_ZERO) * 86_400)), "gaps")
    low, high = g.agg(F.min("n"), F.max("n")).first()
    path, base = (f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}" for name in ("gaps", "x3"))
    for k in range(4):
        g.where(F.expr(f"(n - {low}) * 4 div ({high} - {low} + 1) = {k}")).write.mode("append").parquet(path)
        out = J.drain(J.triggered(spark.readStream.schema(g.schema).parquet(path), rules.TRIGGER), "x3", rocks=True, base=base)
    return out


def owners(spark, d):
    log = J.read_stream(spark, f"{d}/orders.parquet").select(F.col("o_custkey").alias("unit_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 10).alias("owner"))
    return J.changelog(log, "owners")


QUERIES = {
    "x1_windowed_gaps": lambda s, d: J.drain(J.windowed(events(s, d), SCOPE, BAD, "1 hour", "1 day"), "x1"),
    "x2_sliding_gaps": lambda s, d: J.drain(J.windowed(events(s, d), SCOPE, BAD, "1 hour", "2 days", "1 day"), "x2"),
    "x3_trigger_states": decisions,
    "x4_ownership_changelog": owners,
    "x5_live_classification": live,
    "x6_instruction_once": lambda s, d: J.drain(J.once(events(s, d).withColumn("day", F.to_date("ts")), ["user_id", "event_type", "day"], "40 days"), "x6").groupBy("day").agg(F.count("*").alias("n")),
    "x7_sessions": lambda s, d: J.drain(J.sessions(events(s, d), SCOPE, "1 hour", "30 minutes"), "x7").groupBy("scope").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events")),
}
_MARK = "mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS m FROM events)"
SQL = {
    "x1_windowed_gaps": f"WITH {_MARK} SELECT user_id % 8 AS scope, date_trunc('day', ts) AS start, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS observed FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT m FROM mark)",
    "x2_sliding_gaps": f"WITH {_MARK} SELECT user_id % 8 AS scope, start, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS observed FROM (SELECT *, unnest([to_timestamp(floor(epoch(ts) / 86400) * 86400)::TIMESTAMP, to_timestamp(floor(epoch(ts) / 86400) * 86400 - 86400)::TIMESTAMP]) AS start FROM events) GROUP BY 1, 2 HAVING start + INTERVAL 2 DAY <= (SELECT m FROM mark)",
    "x4_ownership_changelog": "SELECT o_custkey AS unit_id, max(o_orderkey) % 10 AS owner, max(o_orderkey) AS seq FROM orders GROUP BY 1",
    "x6_instruction_once": "SELECT day, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events) GROUP BY 1",
    "x7_sessions": f"WITH {_MARK}, s AS (SELECT user_id % 8 AS scope, ts, sum(CAST(p IS NULL OR ts - p >= INTERVAL 30 MINUTE AS INTEGER)) OVER (PARTITION BY user_id % 8 ORDER BY ts) AS island FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id % 8 ORDER BY ts) AS p FROM events)), g AS (SELECT scope, island, count(*) AS n, max(ts) + INTERVAL 30 MINUTE AS e FROM s GROUP BY 1, 2 HAVING e <= (SELECT m FROM mark)) SELECT scope, count(*) AS sessions, max(n) AS longest, CAST(sum(n) AS BIGINT) AS events FROM g GROUP BY 1",
}
SQL["x3_trigger_states"] = rules.SQL["w8_cooldown"]
SQL["x5_live_classification"] = P.sql("SELECT kind, count(*) AS n FROM kinded GROUP BY 1")
