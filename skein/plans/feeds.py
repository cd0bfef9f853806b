"""Event feed, source and text queries bound to the driver's tables, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.plans.catalog import _E, _V, bound_edges, bound_vertices
from skein.session import table
from skein.sources import graph_store as gs
from skein.sources import scripts
from skein.streaming import feeds


def _events(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "events"))


_K = lambda: F.get_json_object("props", "$.k").cast("long")
RULES = [("chase", "bought"), ("c", "clicked"), ("v", "viewed")]


def _new_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    archived = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(F.sha2("text", 256).alias("sha256"))
    return scripts.new_sources(docs, archived, "doc_id")


def _to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    cache = docs.join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "path"), "path").withColumn("hash", F.when(F.col("toxic") == 1, "old").otherwise(F.col("hash")))
    return scripts.to_process(docs, cache, F.col("quality") == 1).select("path")


def _repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_regionkey").alias("scope"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") % 5).alias("scope"))
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_nationkey") % 5).alias("scope"))
    return gs.missing_containment(parts.unionByName(customers), scopes, bound_edges(spark, sf_dir), "CONTAINS_TABLE")


def _geoids(orders: DataFrame) -> DataFrame:
    geoid = F.concat_ws(":", F.lit("pkg"), F.lit("s"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey").cast("string"))
    return orders.select("o_orderkey", tx.package_of(geoid).alias("package"), tx.statement_type(geoid).alias("kind"), tx.statement_line(geoid).alias("line"), tx.short_name(geoid).alias("short"))


QUERIES = {
    "r2_ring": _events(lambda d: feeds.ring(d.select("event_id", "ts"), "event_id", F.col("ts") >= F.lit("2024-01-20").cast("timestamp"))),
    "r4_recent_window": _events(lambda d: feeds.recent_window(d.select("event_id", "ts"), "event_id", "ts")),
    "r4_hot_nodes": _events(lambda d: feeds.hot_keys(feeds.recent_window(d.select("event_id", "ts", "props"), "event_id", "ts"), _K())),
    "r6_tenant_counters": _events(lambda d: feeds.tenant_counters(d, F.when(F.col("user_id") % 7 > 0, F.col("user_id") % 7), F.col("event_type"), RULES)),
    "r7_fence_gate": _events(lambda d: feeds.fence_gate(d.select("event_id", "user_id", (_K() % 10).alias("token")), "user_id", "token", "event_id").select("event_id", "decision")),
    "r9_first_writes": _events(lambda d: feeds.first_writes(d, "user_id").select("user_id", "event_id", "event_type")),
    "r10_poll": _events(lambda d: feeds.poll(d.select("event_id", "ts"), "ts", "event_id", None)),
    "r13_visible": _events(lambda d: feeds.visible_to(d, F.when(F.col("user_id") % 7 > 0, F.col("user_id") % 7), 3).select("event_id")),
    "r15_purge": _events(lambda d: feeds.kept_after_purge(d, "ts", F.lit("2024-01-15").cast("timestamp")).select("event_id")),
    "a13_new_sources": _new_sources,
    "a15_dropped_edges": lambda spark, sf_dir: gs.dropped_edges(bound_vertices(spark, sf_dir).filter("vtype <> 'Routine'"), bound_edges(spark, sf_dir)),
    "a18_write_statistics": lambda spark, sf_dir: gs.write_statistics(bound_edges(spark, sf_dir).select(F.col("etype").alias("vtype"), F.col("dst").alias("id"))),
    "a21_repair": _repair,
    "a22_to_process": _to_process,
    "f7_geoid_parts": lambda spark, sf_dir: _geoids(table(spark, sf_dir, "orders")),
}

_G = f"WITH {_V}, {_E}, "
_WINDOW = "h AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 5000), w AS (SELECT * FROM h WHERE event_id >= (SELECT min(event_id) FROM h WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS))"

ORACLES = {
    "r2_ring": "SELECT * FROM (SELECT event_id, ts FROM events ORDER BY event_id DESC LIMIT 10000) WHERE ts >= TIMESTAMP '2024-01-20'",
    "r4_recent_window": f"WITH {_WINDOW} SELECT event_id, ts FROM w",
    "r4_hot_nodes": f"WITH {_WINDOW} SELECT (props ->> '$.k')::BIGINT AS key, count(*) AS n FROM w GROUP BY 1 HAVING key IS NOT NULL ORDER BY n DESC, key LIMIT 10",
    "r6_tenant_counters": "SELECT tenant, counter, count(*) AS n FROM (SELECT CASE WHEN user_id % 7 > 0 THEN (user_id % 7)::VARCHAR ELSE '_platform' END AS tenant, CASE WHEN event_type LIKE '%chase%' THEN 'bought' WHEN event_type LIKE '%c%' THEN 'clicked' WHEN event_type LIKE '%v%' THEN 'viewed' END AS counter FROM events) WHERE counter IS NOT NULL GROUP BY ALL",
    "r7_fence_gate": "SELECT event_id, CASE WHEN coalesce(k, 0) = 0 THEN 'LEGACY' WHEN k > m THEN 'APPLY' WHEN k = m THEN 'REPLAY' ELSE 'STALE' END AS decision FROM (SELECT event_id, k, coalesce(max(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM (SELECT event_id, user_id, (props ->> '$.k')::BIGINT % 10 AS k FROM events))",
    "r9_first_writes": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "r10_poll": "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 100",
    "r13_visible": "SELECT event_id FROM events WHERE user_id % 7 IN (0, 3)",
    "r15_purge": "SELECT event_id FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-15'",
    "a13_new_sources": r"SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, min(strlen(text)) AS n_bytes FROM documents WHERE regexp_matches(text, '\S') AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL) GROUP BY 1",
    "a15_dropped_edges": _G + "i AS (SELECT id FROM v WHERE vtype <> 'Routine') SELECT etype, count(*) FILTER (src IN (SELECT id FROM i) AND dst IN (SELECT id FROM i)) AS n_kept, count(*) FILTER (NOT (src IN (SELECT id FROM i) AND dst IN (SELECT id FROM i))) AS n_dropped FROM e GROUP BY etype",
    "a18_write_statistics": _G + "i AS (SELECT 1) SELECT etype AS vtype, count(DISTINCT dst) AS inserted, count(*) - count(DISTINCT dst) AS duplicates FROM e GROUP BY etype",
    "a21_repair": "SELECT 'region:' || p_size % 5 AS src, 'part:' || p_partkey AS dst, 'CONTAINS_TABLE' AS etype FROM part",
    "a22_to_process": "SELECT doc_id AS path FROM documents WHERE text IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic IS DISTINCT FROM 1)",
    "f7_geoid_parts": "SELECT o_orderkey, 'pkg' AS package, o_orderstatus AS kind, o_custkey::INT AS line, o_orderpriority || ':' || o_orderstatus || ':' || o_custkey AS short FROM orders",
}
