"""Usage, archive, catalog and store queries over the driver's tables, with their SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import usage as us
from skein.plans.catalog import ORACLES as GRAPH_SQL
from skein.plans.catalog import bound_graph
from skein.session import dropped, saved, scratch, table
from skein.sources import catalogs as ct
from skein.sources.archive import SourceArchive
from skein.sources.store import GraphStore, canonical

TENANTS = 7


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of events, the last with days that the others have, one written twice."""
    events = table(spark, sf_dir, "events")
    path = f"{scratch(spark)}/usage-{uuid.uuid4().hex}"
    tokens = F.get_json_object("props", "$.k").cast("long")
    for batch in (0, 1, 1, 2):
        part = events.filter(F.col("event_id") % 3 == batch)
        us.write_batch(us.batch_usage(part, F.when(F.col("user_id") % TENANTS > 0, F.col("user_id") % TENANTS), F.col("ts"), tokens, tokens * 3), path, str(batch))
    return us.rolled_up(spark.read.parquet(path))


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir).select("tenant", "period", F.col("start").cast("string").alias("start"), *us.AMOUNTS)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = _usage(spark, sf_dir)
    today = F.lit(table(spark, sf_dir, "events").agg(F.max("ts").cast("date")).first()[0])
    n = F.when(F.col("tenant") == "_platform", 0).otherwise(F.col("tenant").cast("int"))
    limits = usage.select("tenant").distinct().select("tenant", F.when(n < 3, 10).otherwise(0).alias("daily_tokens"), F.when(n < 5, 20).otherwise(0).alias("daily_cost"), F.lit(100).alias("monthly_tokens"), F.lit(1).alias("monthly_cost"))
    return us.quota_states(usage, limits, today).select("tenant", "breach", "used", "most", F.col("resets").cast("string").alias("resets"))


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents archived twice, as files of their sources' sessions."""
    docs = table(spark, sf_dir, "documents")
    archive = SourceArchive(spark, f"{scratch(spark)}/archive-{uuid.uuid4().hex}", buckets=4)
    session = F.coalesce("source", F.lit("none"))
    files = docs.select(session.alias("session"), F.col("doc_id").cast("string").alias("path"), "text")
    sessions = docs.select(session.alias("session"), F.lit("2024-05-01").cast("timestamp").alias("started")).distinct()
    errors = files.limit(0).select("session", "path", F.lit("").alias("stage"), F.lit("").alias("message"))
    archive.write(sessions, files, errors)
    archive.write(sessions, files, errors)
    texts = archive.texts().select(F.lit("text").alias("part"), F.col("sha256").alias("name"), "n_bytes")
    kept = archive.store.vertices("File", "Session")
    return texts.unionByName(kept.select(F.lower("vtype").alias("part"), "name", "n_bytes"))


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as source lines: a text an order."""
    lines = table(spark, sf_dir, "lineitem")
    made = lines.select(F.col("l_orderkey").alias("owner"), F.lit("x").alias("name"), F.lit("VIEW").alias("kind"), F.col("l_linenumber").alias("line"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("text"))
    return ct.assembled(made, chunk=3).select(F.col("owner").alias("l_orderkey"), "n_lines", "text")


def _two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph committed in two batches that overlap, then read back: counts by type."""
    graph = bound_graph(spark, sf_dir)
    store = GraphStore(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}", buckets=4)
    half = F.pmod(F.xxhash64("id"), F.lit(3))
    edges = saved(graph.edges, "edges")  # both batches have them all
    store.commit(graph.vertices.filter(half < 2), edges)
    store.commit(graph.vertices.filter(half > 0), edges)
    dropped(edges)
    count = F.count(F.lit(1)).alias("n")
    return store.vertices().groupBy(F.lit("vertex").alias("kind"), F.col("vtype").alias("name")).agg(count).unionByName(store.edges().groupBy(F.lit("edge").alias("kind"), F.col("etype").alias("name")).agg(count))


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations as sessions that each name the tables of their region: one id a table of a database."""
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    vertices = suppliers.select(F.concat_ws(":", F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("Table").alias("vtype"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("db"), F.concat(F.lit("Tab"), (F.col("s_suppkey") % 4).cast("string")).alias("name"))
    edges = suppliers.select(F.concat_ws(":", F.lit("q"), F.col("n_nationkey").cast("string")).alias("src"), F.concat_ws(":", F.lit("s"), F.col("s_suppkey").cast("string")).alias("dst"), F.lit("READS_FROM").alias("etype"))
    pooled, linked = canonical(vertices, edges, "db", "name")
    named = pooled.select("id", F.upper(F.concat_ws("|", "db", "name")).alias("table")).distinct()
    return linked.select("src", F.col("dst").alias("id")).distinct().join(named, "id").select("src", "table")


QUERIES = {"g23_rollup": _rollup, "g23_states": _states, "a14_archive": _archive, "a3_assembled": _assembled, "a16_two_writers": _two_writers, "a19_pooled": _pooled}

_TENANT = f"CASE WHEN user_id % {TENANTS} > 0 THEN (user_id % {TENANTS})::VARCHAR ELSE '_platform' END"
_T = "coalesce(sum(json_extract_string(props, '$.k')::BIGINT), 0)::BIGINT"
_PERIODS = " UNION ALL ".join(f"SELECT {_TENANT} AS tenant, '{p}' AS period, date_trunc('{p}', ts)::DATE::VARCHAR AS start, {_T} AS tokens, (3 * {_T})::BIGINT AS cost, count(*) AS requests FROM events GROUP BY ALL" for p in ("day", "month"))
ORACLES = {
    "g23_rollup": _PERIODS,
    "g23_states": f"""
WITH u AS ({_PERIODS}), d AS (SELECT max(ts)::DATE AS today FROM events),
s AS (SELECT tenant, coalesce(max(tokens) FILTER (period = 'day' AND start = today::VARCHAR), 0) AS dt, coalesce(max(cost) FILTER (period = 'day' AND start = today::VARCHAR), 0) AS dc,
  coalesce(max(tokens) FILTER (period = 'month' AND start = date_trunc('month', today)::DATE::VARCHAR), 0) AS mt, coalesce(max(cost) FILTER (period = 'month' AND start = date_trunc('month', today)::DATE::VARCHAR), 0) AS mc,
  any_value(today) AS today, CASE WHEN tenant = '_platform' THEN 0 ELSE tenant::INT END AS n FROM u, d GROUP BY tenant),
b AS (SELECT *, CASE WHEN n < 3 AND dt >= 10 THEN 'daily_tokens' WHEN n < 5 AND dc >= 20 THEN 'daily_cost' WHEN mt >= 100 THEN 'monthly_tokens' WHEN mc >= 1 THEN 'monthly_cost' END AS breach FROM s)
SELECT tenant, breach, CASE breach WHEN 'daily_tokens' THEN dt WHEN 'daily_cost' THEN dc WHEN 'monthly_tokens' THEN mt WHEN 'monthly_cost' THEN mc END::BIGINT AS used,
  CASE breach WHEN 'daily_tokens' THEN 10 WHEN 'daily_cost' THEN 20 WHEN 'monthly_tokens' THEN 100 WHEN 'monthly_cost' THEN 1 END::BIGINT AS most,
  CASE WHEN breach LIKE 'daily%' THEN (today + 1)::VARCHAR WHEN breach IS NOT NULL THEN (date_trunc('month', today) + INTERVAL 1 MONTH)::DATE::VARCHAR END AS resets FROM b""",
    "a14_archive": """
SELECT 'text' AS part, sha256(text) AS name, min(strlen(text))::BIGINT AS n_bytes FROM documents WHERE text IS NOT NULL GROUP BY ALL
UNION ALL SELECT DISTINCT 'file', doc_id::VARCHAR, strlen(text)::BIGINT FROM documents
UNION ALL SELECT DISTINCT 'session', 'rev-2024-05-01-' || left(coalesce(source, 'none'), 8), NULL::BIGINT FROM documents""",
    "a3_assembled": "SELECT l_orderkey, count(*) AS n_lines, string_agg(l_partkey || '-' || l_suppkey, chr(10) ORDER BY l_linenumber, l_partkey || '-' || l_suppkey || chr(10)) AS text FROM lineitem GROUP BY l_orderkey",
    "a16_two_writers": GRAPH_SQL["g16_type_totals"],
    "a19_pooled": "SELECT DISTINCT 'q:' || n_nationkey AS src, 'R' || n_regionkey || '|TAB' || (s_suppkey % 4) AS \"table\" FROM supplier JOIN nation ON s_nationkey = n_nationkey",
}
