"""Streaming queries over the driver's events: history handed over to a live feed, and the sliding day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import saved, scratch, table
from skein.streaming import live as lv

_NODE = "get_json_object(props, '$.k')"


def _level():
    return F.expr("CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END")


def handed_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once: the first three fifths of the time as history, then a feed that begins at two fifths."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.coalesce(F.min(micros), F.lit(0)), F.coalesce(F.max(micros), F.lit(0))).first()
    span = last - first
    low, high = first + 2 * span // 5, first + 3 * span // 5
    history = saved(events.filter(micros <= high), "history")
    feed = events.filter(micros >= low).withColumn("ts", F.col("ts").cast("timestamp"))
    home = f"{scratch(spark)}/feed-{uuid.uuid4().hex}"
    feed.write.parquet(f"{home}/in")
    stream = spark.readStream.schema(feed.schema).parquet(f"{home}/in")
    known = history.withColumn("ts", F.col("ts").cast("timestamp"))
    out = lv.beyond(stream, known, "event_id", "ts", f"{span // 1_000_000 + 1} SECONDS")
    out.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/marks").trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema(out.schema).parquet(f"{home}/out")
    part = lambda df, name: df.select("event_id", "event_type", F.lit(name).alias("via"))
    return part(history, "history").unionByName(part(seen, "live"))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return lv.recent_summary(events, "event_id", "ts", _level(), F.col("user_id"), F.expr(f"CASE event_type WHEN 'click' THEN {_NODE} END"), F.expr(f"CASE WHEN event_type = 'view' AND CAST({_NODE} AS INT) > 50 THEN CAST({_NODE} AS INT) END"), hours=24 * 20)


def _day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sliding day from slices, without the estimated part."""
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    totals = lv.slice_totals(events, "ts", _level(), F.col("user_id"))
    return lv.day_summary(totals, lv.slice_keys(events, "ts", F.expr(_NODE)), now).filter("key <> 'sessions'")


QUERIES = {"r3_handed_over": handed_over, "r4_summary": _summary, "r4_day": _day}

_LEVEL_SQL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END"
_K = "json_extract_string(props, '$.k')"
ORACLES = {
    "r3_handed_over": """
WITH m AS (SELECT epoch_us(min(ts)) + 3 * (epoch_us(max(ts)) - epoch_us(min(ts))) // 5 AS high FROM events)
SELECT event_id, event_type, CASE WHEN epoch_us(ts) <= high THEN 'history' ELSE 'live' END AS via FROM events, m
""",
    "r4_summary": f"""
WITH h AS (SELECT *, ts >= (SELECT max(ts) FROM events) - INTERVAL 480 HOURS AS fresh FROM events ORDER BY event_id DESC LIMIT 5000),
w AS (SELECT *, {_LEVEL_SQL} AS level FROM h WHERE event_id >= (SELECT min(event_id) FROM h WHERE fresh))
SELECT 'total' AS section, level AS key, count(event_id)::BIGINT AS n FROM (VALUES ('info'), ('warn'), ('error')) l(level) LEFT JOIN w USING (level) GROUP BY level
UNION ALL SELECT 'total', 'events', count(*) FROM w
UNION ALL SELECT 'total', 'sessions', count(DISTINCT user_id) FROM w
UNION ALL (SELECT 'hot', {_K}, count(*) FROM w WHERE event_type = 'click' AND {_K} IS NOT NULL GROUP BY ALL ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL (SELECT 'slow', event_id::VARCHAR, {_K}::BIGINT FROM w WHERE event_type = 'view' AND {_K}::INT > 50 ORDER BY event_id DESC LIMIT 20)
""",
    "r4_day": f"""
WITH w AS (SELECT *, {_LEVEL_SQL} AS level FROM events WHERE date_trunc('hour', ts) > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS)
SELECT 'total' AS section, level AS key, count(event_id)::BIGINT AS n FROM (VALUES ('info'), ('warn'), ('error')) l(level) LEFT JOIN w USING (level) GROUP BY level
UNION ALL SELECT 'total', 'total', count(*) FROM w
UNION ALL (SELECT 'hot', {_K}, count(*) FROM w WHERE {_K} IS NOT NULL GROUP BY ALL ORDER BY 3 DESC, 2 LIMIT 10)
""",
}
