"""Registered queries of the library outside the llm subpackage, with their SQL oracles.

The driver's tables are bound to a metadata graph: regions are schemas, customers and parts are tables, orders are
statements and suppliers routines. Orders write to their customer and read the parts of their lines; parts flow to their
suppliers, and suppliers to the customers of the orders whose first line they supply.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import graph
from skein.operators.lineage import Graph
from skein.plans.derived import derived_graph
from skein.session import table
from skein.streaming import events as ev


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(name: str, key: str, label: str, vtype: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("id"), F.lit(vtype).alias("vtype"), F.col(label).cast("string").alias("label"))

    parts = (("region", "r_regionkey", "r_name", "Schema"), ("customer", "c_custkey", "c_name", "Table"), ("part", "p_partkey", "p_name", "Table"), ("supplier", "s_suppkey", "s_name", "Routine"), ("orders", "o_orderkey", "o_orderpriority", "Statement"))
    return reduce(DataFrame.unionByName, (one(*p) for p in parts))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    end = lambda name, key: F.concat(F.lit(f"{name}:"), F.col(key).cast("string"))
    edge = lambda df, src, dst, etype: df.select(end(*src).alias("src"), end(*dst).alias("dst"), F.lit(etype).alias("etype"))
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    customers = t("customer").select("c_custkey", "c_nationkey")
    return reduce(DataFrame.unionByName, (
        edge(customers.join(t("nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")), ("region", "n_regionkey"), ("customer", "c_custkey"), "CONTAINS_TABLE"),
        edge(t("orders").select("o_orderkey", "o_custkey"), ("orders", "o_orderkey"), ("customer", "o_custkey"), "WRITES_TO"),
        edge(lines.select("l_orderkey", "l_partkey").distinct(), ("orders", "l_orderkey"), ("part", "l_partkey"), "READS_FROM"),
        edge(lines.select("l_partkey", "l_suppkey").distinct(), ("part", "l_partkey"), ("supplier", "l_suppkey"), "DATA_FLOW"),
        edge(t("lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct(), ("supplier", "l_suppkey"), ("customer", "o_custkey"), "DATA_FLOW"),
    ))


def bound_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends (src, dst) of the graph's edges of all types, parallel ones repeated, for what asks only which nodes are linked.

    What a line links stays together, and no line is shuffled to tell it from others.
    """
    end = lambda name, key: F.concat(F.lit(f"{name}:"), F.col(key).cast("string"))
    link = lambda src, dst: F.struct(end(*src).alias("src"), end(*dst).alias("dst"))
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    part = ("part", "l_partkey")
    made = (
        table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(link(("region", "n_regionkey"), ("customer", "c_custkey")).alias("link")),
        orders.select(link(("orders", "o_orderkey"), ("customer", "o_custkey")).alias("link")),
        lines.select(F.explode(F.array(link(("orders", "l_orderkey"), part), link(part, ("supplier", "l_suppkey")))).alias("link")),
        lines.filter("l_linenumber = 1").select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(link(("supplier", "l_suppkey"), ("customer", "o_custkey")).alias("link")),
    )
    return reduce(DataFrame.unionByName, made).select("link.*")


def bound_graph(spark: SparkSession, sf_dir: str) -> Graph:
    tables = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    return derived_graph(spark, sf_dir, "links", tables, lambda: (_vertices(spark, sf_dir), _edges(spark, sf_dir)))


def bound_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound_graph(spark, sf_dir).vertices


def bound_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound_graph(spark, sf_dir).edges


def _graph(f):
    return lambda spark, sf_dir: f(bound_vertices(spark, sf_dir), bound_edges(spark, sf_dir))


def _events(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "events"))


QUERIES = {
    "p1_impact": _graph(lambda v, e: graph.impact(v, e, "part:1")),
    "p2_lineage": _graph(lambda v, e: graph.lineage(v, e, "supplier:1")),
    "j1_expand": _graph(lambda v, e: graph.expand(v, e, "customer:1")),
    "j6_orphan_tables": _graph(lambda v, e: graph.without_edge(v, e, "Table", "READS_FROM", "WRITES_TO")),
    "g1_schema_summary": _graph(lambda v, e: graph.members(v, e, "CONTAINS_TABLE")),
    "g12_dependency_counts": _graph(lambda v, e: graph.dependency_counts(e)),
    "g16_type_totals": _graph(graph.type_totals),
    "g37_table_degrees": _graph(lambda v, e: graph.table_degrees(e)),
    "g44_hotspots": _graph(lambda v, e: graph.hotspots(e)),
    "g47_crossroads": _graph(lambda v, e: graph.crossroads(e)),
    "b11_event_filter": _events(lambda d: ev.event_filter(d, event_type="purchase").select("event_id", "user_id", "value")),
    "w3_fence": _events(lambda d: ev.fence_decisions(d.withColumn("token", F.get_json_object("props", "$.k").cast("long")), "user_id", "token", "event_id").select("event_id", "accepted")),
    "w7_top_and_rest": _events(lambda d: ev.top_and_rest(d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id", "n", 20)),
    "t_sliding_counts": _events(lambda d: ev.sliding_counts(d, "event_type", "24 hours", "6 hours")),
}

_V = "v AS (SELECT 'region:' || r_regionkey AS id, 'Schema' AS vtype, r_name AS label FROM region UNION ALL SELECT 'customer:' || c_custkey, 'Table', c_name FROM customer UNION ALL SELECT 'part:' || p_partkey, 'Table', p_name FROM part UNION ALL SELECT 'supplier:' || s_suppkey, 'Routine', s_name FROM supplier UNION ALL SELECT 'orders:' || o_orderkey, 'Statement', o_orderpriority FROM orders)"
_E = "e AS (SELECT 'region:' || n_regionkey AS src, 'customer:' || c_custkey AS dst, 'CONTAINS_TABLE' AS etype FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'WRITES_TO' FROM orders UNION ALL SELECT DISTINCT 'orders:' || l_orderkey, 'part:' || l_partkey, 'READS_FROM' FROM lineitem UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'DATA_FLOW' FROM lineitem UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'customer:' || o_custkey, 'DATA_FLOW' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1)"
_W = f"WITH RECURSIVE {_V}, {_E}, "


def _walk(name: str, node: str, hops: int, near: str = "src", far: str = "dst") -> str:
    return f"{name} AS (SELECT '{node}' AS id, 0 AS depth UNION SELECT e.{far}, {name}.depth + 1 FROM {name} JOIN e ON e.{near} = {name}.id WHERE e.etype = 'DATA_FLOW' AND {name}.depth < {hops})"


_DEGREES = "g AS (SELECT dst AS id, count(*) FILTER (etype = 'READS_FROM') AS read_by, count(*) FILTER (etype = 'WRITES_TO') AS written_by FROM e WHERE etype IN ('READS_FROM', 'WRITES_TO') GROUP BY dst)"

ORACLES = {
    "p1_impact": _W + _walk("w", "part:1", 5) + " SELECT id, vtype, label, min(depth) AS depth, count(*) OVER () >= 500 AS has_more FROM w JOIN v USING (id) WHERE depth > 0 AND id <> 'part:1' AND vtype IN ('Column', 'Routine', 'Statement', 'Table') GROUP BY id, vtype, label ORDER BY depth, id LIMIT 500",
    "p2_lineage": _W + _walk("u", "supplier:1", 10, "dst", "src") + ", " + _walk("w", "supplier:1", 10) + " SELECT id, vtype, 'upstream' AS direction, min(depth) AS depth FROM u JOIN v USING (id) WHERE depth > 0 GROUP BY ALL UNION ALL SELECT id, vtype, 'downstream', min(depth) FROM w JOIN v USING (id) WHERE depth > 0 GROUP BY ALL",
    "j1_expand": _W + "o AS (SELECT src, dst, etype, vtype AS other_type FROM e JOIN v ON v.id = e.dst WHERE src = 'customer:1' ORDER BY 1, 2, 3 LIMIT 200), i AS (SELECT src, dst, etype, vtype AS other_type FROM e JOIN v ON v.id = e.src WHERE dst = 'customer:1' ORDER BY 1, 2, 3 LIMIT 200) SELECT * FROM o UNION ALL SELECT * FROM i",
    "j6_orphan_tables": _W + "x AS (SELECT dst FROM e WHERE etype IN ('READS_FROM', 'WRITES_TO')) SELECT id, label FROM v WHERE vtype = 'Table' AND id NOT IN (SELECT dst FROM x)",
    "g1_schema_summary": _W + "x AS (SELECT src, count(*) AS n FROM e WHERE etype = 'CONTAINS_TABLE' GROUP BY src) SELECT label, n FROM x JOIN v ON v.id = x.src ORDER BY n DESC, label LIMIT 50",
    "g12_dependency_counts": _W + "x AS (SELECT src AS id, dst AS o, 'out' AS s FROM e UNION SELECT dst, src, 'in' FROM e) SELECT id, count(*) FILTER (s = 'out') AS n_out, count(*) FILTER (s = 'in') AS n_in, count(*) AS n_both FROM x GROUP BY id",
    "g16_type_totals": _W + "x AS (SELECT 1) SELECT 'vertex' AS kind, vtype AS name, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 'edge', etype, count(*) FROM e GROUP BY ALL",
    "g37_table_degrees": _W + _DEGREES + " SELECT * FROM g",
    "g44_hotspots": _W + _DEGREES + " SELECT * FROM g ORDER BY read_by + written_by DESC, id LIMIT 15",
    "g47_crossroads": _W + _DEGREES + " SELECT * FROM g WHERE read_by > 0 AND written_by > 0",
    "b11_event_filter": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'",
    "w3_fence": "SELECT event_id, k >= coalesce(max(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), k) AS accepted FROM (SELECT event_id, user_id, (props ->> '$.k')::BIGINT AS k FROM events)",
    "w7_top_and_rest": "WITH c AS (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY user_id) SELECT CASE WHEN r <= 20 THEN user_id::VARCHAR ELSE 'rest' END AS user_id, sum(n)::BIGINT AS n FROM c GROUP BY 1",
    "t_sliding_counts": "SELECT w AS window_start, event_type, count(*) AS n, sum(value) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 6 HOURS, ts::TIMESTAMP, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS * k AS w FROM events, range(0, 4) r(k)) GROUP BY ALL",
}
