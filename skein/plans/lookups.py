"""Lookup and rate queries over the driver's tables, with their SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import lookups as lk
from skein.plans.catalog import bound_graph
from skein.plans.model import WITH, bound
from skein.session import scratch, table
from skein.sources.store import GraphStore
from skein.streaming.platform import rate_gate


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("geoid"), F.col("p_type").alias("kind"), F.col("p_name").alias("label"), F.col("p_brand").alias("description"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: at most 3 in 12 hours and 5 in three days."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    hour = 3_600_000
    return rate_gate(events, "user_id", "at", "event_id", F.col("event_id") % 11 == 0, ((12 * hour, 3), (72 * hour, 5))).select("event_id", "allowed")


def _batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand parts by id, of which a tenth are unknown, against a store of tables and what holds them."""
    graph = bound_graph(spark, sf_dir)
    store = GraphStore(spark, f"{scratch(spark)}/tables-{uuid.uuid4().hex}", buckets=4)
    store.commit(graph.vertices.filter("vtype IN ('Table', 'Schema')"), graph.of("CONTAINS_TABLE"))
    return store.lookup([f"part:{i}" for i in range(-100, 900)], "Table").select("id", "label")


QUERIES = {
    "j8_batch_lookup": _batch_lookup,
    "p37_entry": lambda spark, sf_dir: lk.entry_of(_entries(spark, sf_dir), "part:7"),
    "p37_search": lambda spark, sf_dir: lk.search_entries(_entries(spark, sf_dir), "1", 60),
    "p38_schemas": lambda spark, sf_dir: lk.schema_names(bound(spark, sf_dir)),
    "p38_columns": lambda spark, sf_dir: lk.table_columns(bound(spark, sf_dir), "table:7"),
    "t9_newest": lambda spark, sf_dir: lk.newest(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", 50, "o_orderkey").select("o_orderkey"),
    "r14_rate_gate": _calls,
    "f15_escaped": lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.md5(lk.escaped(F.col("text"))).alias("md5")),
    "f17_versions": lambda spark, sf_dir: table(spark, sf_dir, "nation").select("n_nationkey", lk.version_state(F.col("n_regionkey"), (1, 2, 3), (1,)).alias("state")),
}

_GATE = "CASE WHEN {r} IS NULL OR o.ms > {r} THEN {a} ELSE {b} END"
_ON = lambda r, n, span: (_GATE.format(r=r, a="1", b=f"{n} + 1"), _GATE.format(r=r, a=f"o.ms + {span}", b=r))
(_S, _SR), (_M, _MR) = _ON("g.sr", "g.s", 43_200_000), _ON("g.mr", "g.m", 259_200_000)
ORACLES = {
    "j8_batch_lookup": "SELECT 'part:' || p_partkey AS id, p_name AS label FROM part WHERE p_partkey < 900",
    "p37_entry": "SELECT 'part:' || p_partkey AS geoid, coalesce(p_type, '') AS kind, coalesce(p_name, '') AS label, coalesce(p_brand, '') AS description FROM part WHERE p_partkey = 7",
    "p37_search": "SELECT 'part:' || p_partkey AS geoid, p_type AS kind, p_name AS label, p_brand AS description FROM part WHERE contains(p_name, '1') OR contains(p_brand, '1') ORDER BY 1 LIMIT 60",
    "p38_schemas": "SELECT DISTINCT n_name AS schema FROM nation WHERE n_name IS NOT NULL",
    "p38_columns": WITH + "x AS (SELECT 1) SELECT c.id, coalesce(c.label, '') AS \"column\" FROM e JOIN v c ON c.id = dst AND c.vtype = 'Column' WHERE etype = 'HAS_COLUMN' AND src = 'table:7'",
    "t9_newest": "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 50",
    "r14_rate_gate": f"""
WITH RECURSIVE c AS (SELECT event_id, coalesce(user_id::VARCHAR, 'default') AS who, epoch_ms(ts) AS ms FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY ms, event_id) AS n FROM c WHERE event_id % 11 <> 0),
g AS (SELECT event_id, who, n, 1 AS s, ms + 43200000 AS sr, 1 AS m, ms + 259200000 AS mr FROM o WHERE n = 1
  UNION ALL SELECT o.event_id, o.who, o.n, {_S}, {_SR}, {_M}, {_MR} FROM g JOIN o ON o.who = g.who AND o.n = g.n + 1)
SELECT event_id, s <= 3 AND m <= 5 AS allowed FROM g UNION ALL SELECT event_id, true FROM events WHERE event_id % 11 = 0""",
    "f15_escaped": "SELECT doc_id, md5(replace(coalesce(text, ''), '''', '''''')) AS md5 FROM documents",
    "f17_versions": "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'deprecated' WHEN n_regionkey IN (2, 3) THEN 'supported' ELSE 'unsupported' END AS state FROM nation",
}
