"""Diagnostic, explore and algorithm queries bound to the driver's tables, with their SQL oracles.

The containment hierarchy is region, nation, customer, order; statements nest in it. Chains of events stand in for graphs
whose components SQL can state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import algorithms, diagnostics as dg, explore as ex
from skein.plans.catalog import _E, _V, bound_edges, bound_links, bound_vertices
from skein.session import table


def _graph(f):
    return lambda spark, sf_dir: f(bound_vertices(spark, sf_dir), bound_edges(spark, sf_dir))


def _of(name: str, f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


def bound_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment as (child, parent): nation in region, customer in nation, order in customer."""
    end = lambda name, key: F.concat(F.lit(f"{name}:"), F.col(key).cast("string"))
    parts = (("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("orders", "o_orderkey", "customer", "o_custkey"))
    return reduce(DataFrame.unionByName, (table(spark, sf_dir, c).select(end(c, ck).alias("child"), end(p, pk).alias("parent")) for c, ck, p, pk in parts))


def _hoisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = bound_edges(spark, sf_dir).filter("etype = 'READS_FROM'")
    return ex.hoist(reads, bound_parents(spark, sf_dir), 5)


def _optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = bound_edges(spark, sf_dir)
    routines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("routine"))
    statements = table(spark, sf_dir, "orders").select(F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")).alias("stmt"), F.col("o_custkey").alias("routine"))
    return ex.optional_counts(routines, statements, edges)


def _diff(events: DataFrame) -> DataFrame:
    half = lambda test: events.filter(test).groupBy("user_id").agg(F.max(F.struct("event_id", "event_type"))["event_type"].alias("state"))
    return ex.snapshot_diff(half("event_id % 2 = 0"), half("event_id % 2 = 1"), "user_id", "state")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "nation").select(F.concat(F.lit("a."), F.lower("n_name")).alias("name"))
    right = table(spark, sf_dir, "nation").select(F.concat(F.lit("b.c."), F.upper("n_name")).alias("name"))
    return ex.name_match(left, right, "name")


def _preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    one = lambda kind: events.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return ex.prefer_first([one("purchase"), one("view"), one("click")], ["user_id"])


def _overridden(events: DataFrame) -> DataFrame:
    explicit = F.when(F.col("event_id") % 5 == 0, F.get_json_object("props", "$.k").cast("long") % 20)
    return ex.override_order(events.select("user_id", "event_id", explicit.alias("explicit")), ["user_id"], "event_id", "explicit").select("event_id", "position")


_CHAIN = lambda d: d.filter("event_id % 7 <> 0").select(F.col("event_id").alias("src"), (F.col("event_id") + 1).alias("dst"))
_RINGS = lambda d: _CHAIN(d).unionByName(d.filter("event_id % 14 = 0").select(F.col("event_id").alias("src"), (F.col("event_id") - 6).alias("dst")))
_LINKS = lambda d: d.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
_TYPES = ("click", "view", "purchase")

QUERIES = {
    "g27_most_read": _graph(lambda v, e: dg.degree_top(e, "READS_FROM")),
    "p24_degrees": _graph(dg.degrees),
    "g36_without_lineage": _graph(lambda v, e: dg.untouched(v, e, "Table", ("WRITES_TO", "CONTAINS_TABLE"))),
    "g38_idle_statements": _graph(lambda v, e: dg.untouched(v, e, "Statement", ("READS_FROM",))),
    "g21_usage_roles": _graph(lambda v, e: dg.usage_roles(e)),
    "g46_dead_tables": _graph(lambda v, e: dg.dead_tables(e)),
    "g48_root_routines": _graph(lambda v, e: dg.end_routines(v, e, "DATA_FLOW", "dst")),
    "g42_health": _graph(dg.health),
    "g9_type_histogram": _of("events", lambda d: dg.type_histogram(d, "user_id", F.concat_ws(":", F.lit("db"), F.lit("s"), F.col("user_id").cast("string"), F.upper("event_type")), _TYPES)),
    "g20_run_metrics": _of("events", lambda d: dg.run_metrics(d, "event_type", "value", F.col("value") < 10)),
    "g15_tenant_stats": _of("events", lambda d: dg.tenant_stats(d, F.col("user_id") % 7, "user_id", "event_type", "error")),
    "g41_like_ratio": _of("part", lambda d: dg.like_ratio(d, "p_name", one="%1%", nine="%9")),
    "g30_top_groups": _of("lineitem", lambda d: dg.top_groups(d.filter("l_returnflag = 'R'"), ["l_partkey", "l_linestatus"])),
    "j9_siblings": _graph(lambda v, e: ex.siblings(e, "customer:1", "CONTAINS_TABLE")),
    "j3_optional_counts": _optional,
    "j4_name_match": _matched,
    "j12_snapshot_diff": _of("events", _diff),
    "p3_expand_deep": _graph(lambda v, e: ex.expand_deep(v, e, "customer:1", 2)),
    "p4_hoist": _hoisted,
    "p5_descendants": lambda spark, sf_dir: ex.descendants(bound_parents(spark, sf_dir), "region:1"),
    "p16_result_edges": _graph(ex.result_edges),
    "p16_result": _graph(ex.result_view),
    "s4_prefer_first": _preferred,
    "t10_recent_per_tenant": _of("events", lambda d: ex.recent_per(d.withColumn("tenant", F.col("user_id") % 7), "tenant", "event_id", 5, "event_type")),
    "w1_override_order": _of("events", _overridden),
    "p18_hits": _of("lineitem", lambda d: algorithms.hits(_LINKS(d), 2).select("id", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))),
    "p19_weak_components": _of("events", lambda d: algorithms.weak_components(_CHAIN(d))),
    "p20_strong_components": _of("events", lambda d: algorithms.strong_components(_RINGS(d))),
    # over the whole graph, to convergence: tested by brute force
    "p18_hits_settled": _of("lineitem", lambda d: algorithms.hits(_LINKS(d))),
    "p19_graph_components": lambda spark, sf_dir: algorithms.weak_components(bound_links(spark, sf_dir)),
    "p20_graph_components": lambda spark, sf_dir: algorithms.strong_components(bound_edges(spark, sf_dir)),
}

_G = f"WITH {_V}, {_E}, "
_D = "g AS (SELECT dst AS id, count(*) FILTER (etype = 'READS_FROM') AS read_by, count(*) FILTER (etype = 'WRITES_TO') AS written_by FROM e WHERE etype IN ('READS_FROM', 'WRITES_TO') GROUP BY dst)"
_P = "p AS (SELECT 'nation:' || n_nationkey AS child, 'region:' || n_regionkey AS parent FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey FROM orders)"
_UNTOUCHED = "SELECT id, label FROM v WHERE vtype = '{}' AND id NOT IN (SELECT src FROM x) AND id NOT IN (SELECT dst FROM x)"
_NODES = "n AS (SELECT src AS id FROM k UNION SELECT dst FROM k)"
_CHAIN_SQL = "SELECT event_id AS src, event_id + 1 AS dst FROM events WHERE event_id % 7 <> 0"


def _hits_sql(rounds: int) -> str:
    sql = f"WITH k AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), {_NODES}, h0 AS (SELECT id, 1.0::DOUBLE AS score FROM n)"
    for i in range(rounds):
        for made, given, near, far in ((f"a{i + 1}", f"h{i}", "src", "dst"), (f"h{i + 1}", f"a{i + 1}", "dst", "src")):
            sql += f", {made}r AS (SELECT {far} AS id, sum(score) AS raw FROM k JOIN {given} ON id = {near} GROUP BY {far}), {made} AS (SELECT id, raw / sqrt((SELECT sum(raw * raw) FROM {made}r)) AS score FROM {made}r)"
    return f"{sql} SELECT n.id, round(coalesce(h.score, 0), 9) AS hub, round(coalesce(a.score, 0), 9) AS authority FROM n LEFT JOIN h{rounds} h USING (id) LEFT JOIN a{rounds} a USING (id)"


ORACLES = {
    "g27_most_read": _G + "x AS (SELECT dst AS id, count(*) AS n FROM e WHERE etype = 'READS_FROM' GROUP BY dst) SELECT * FROM x ORDER BY n DESC, id LIMIT 10",
    "p24_degrees": _G + "x AS (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT v.id, coalesce(sum(i), 0)::BIGINT AS n_in, coalesce(sum(o), 0)::BIGINT AS n_out FROM v LEFT JOIN x USING (id) GROUP BY v.id",
    "g36_without_lineage": _G + "x AS (SELECT src, dst FROM e WHERE etype IN ('CONTAINS_TABLE', 'WRITES_TO')) " + _UNTOUCHED.format("Table"),
    "g38_idle_statements": _G + "x AS (SELECT src, dst FROM e WHERE etype = 'READS_FROM') " + _UNTOUCHED.format("Statement"),
    "g21_usage_roles": _G + "x AS (SELECT 1) SELECT DISTINCT src AS stmt, dst AS \"table\", CASE etype WHEN 'READS_FROM' THEN 'SOURCE' ELSE 'TARGET' END AS role FROM e WHERE etype IN ('READS_FROM', 'WRITES_TO')",
    "g46_dead_tables": _G + _D + " SELECT id, written_by FROM g WHERE read_by = 0 AND written_by > 0",
    "g48_root_routines": _G + "x AS (SELECT dst FROM e WHERE etype = 'DATA_FLOW') SELECT id, label FROM v WHERE vtype = 'Routine' AND id NOT IN (SELECT dst FROM x)",
    "g42_health": _G + "a AS (SELECT count(*) FILTER (vtype = 'Schema') AS n_schema, count(*) FILTER (vtype = 'Table') AS n_table, count(*) FILTER (vtype = 'Routine') AS n_routine, count(*) FILTER (vtype = 'Statement') AS n_statement FROM v), b AS (SELECT count(*) AS n_edges, count(*) FILTER (etype = 'READS_FROM') AS n_reads, count(*) FILTER (etype = 'WRITES_TO') AS n_writes, count(*) FILTER (etype = 'DATA_FLOW') AS n_flow FROM e) SELECT a.*, b.*, n_flow * 100.0::DOUBLE / n_edges AS flow_pct FROM a, b",
    "g9_type_histogram": "SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type IS NULL OR event_type NOT IN ('click', 'view', 'purchase')) AS n_other FROM events GROUP BY user_id",
    "g20_run_metrics": "SELECT event_type, count(*) FILTER (value >= 10 OR value IS NULL) AS n_ok, count(*) FILTER (value < 10) AS n_failed, min(value) AS least, max(value) AS most, avg(value) AS mean FROM events GROUP BY event_type",
    "g15_tenant_stats": "SELECT user_id % 7 AS tenant, count(DISTINCT user_id) AS n_sessions, count(*) AS n_rows FROM events WHERE event_type IS DISTINCT FROM 'error' GROUP BY 1",
    "g41_like_ratio": "SELECT count(*) AS n, count(*) FILTER (p_name LIKE '%1%') AS n_one, count(*) FILTER (p_name LIKE '%9') AS n_nine, count(*) FILTER (p_name LIKE '%1%')::DOUBLE / count(*) AS one_ratio, count(*) FILTER (p_name LIKE '%9')::DOUBLE / count(*) AS nine_ratio FROM part",
    "g30_top_groups": "SELECT l_partkey, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL ORDER BY n DESC, l_partkey, l_linestatus LIMIT 20",
    "j9_siblings": _G + "x AS (SELECT src FROM e WHERE dst = 'customer:1' AND etype = 'CONTAINS_TABLE') SELECT DISTINCT src AS parent, dst AS id FROM e WHERE etype = 'CONTAINS_TABLE' AND src IN (SELECT src FROM x)",
    "j3_optional_counts": "SELECT c_custkey AS routine, count(DISTINCT l_partkey) AS n_reads, count(DISTINCT o_custkey) AS n_writes FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey",
    "j4_name_match": "SELECT DISTINCT 'a.' || lower(l.n_name) AS left_name, 'b.c.' || upper(r.n_name) AS right_name FROM nation l JOIN nation r ON upper(l.n_name) = upper(r.n_name)",
    "j12_snapshot_diff": "WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS s FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, event_id) AS s FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT user_id, a.s AS was, b.s AS now, CASE WHEN a.s IS NULL THEN 'new' WHEN b.s IS NULL THEN 'deleted' ELSE 'changed' END AS status FROM a FULL JOIN b USING (user_id) WHERE a.s IS DISTINCT FROM b.s",
    "p3_expand_deep": _G + "x AS (SELECT src, dst, etype FROM e WHERE etype IN ('READS_FROM', 'WRITES_TO')), y AS (SELECT 'customer:1' AS id UNION SELECT src FROM x WHERE dst = 'customer:1' UNION SELECT dst FROM x WHERE src = 'customer:1') SELECT DISTINCT src, dst, etype FROM x WHERE src IN (SELECT id FROM y) OR dst IN (SELECT id FROM y) ORDER BY src, dst, etype LIMIT 500",
    "p4_hoist": "SELECT DISTINCT 'region:' || n_regionkey AS src, 'part:' || l_partkey AS dst, 'READS_FROM' AS etype FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey",
    "p5_descendants": f"WITH RECURSIVE {_P}, w AS (SELECT child AS id, 1 AS depth FROM p WHERE parent = 'region:1' UNION ALL SELECT p.child, w.depth + 1 FROM w JOIN p ON p.parent = w.id) SELECT id, depth FROM w ORDER BY depth, id LIMIT 500",
    "p16_result_edges": _G + "x AS (SELECT DISTINCT src || '__' || etype || '__' || dst AS edge FROM e WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)) SELECT edge, (SELECT count(*) FROM x) >= 500 AS has_more FROM x",
    "s4_prefer_first": "SELECT user_id, branch, event_id FROM (SELECT user_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS branch, min(event_id) AS event_id FROM events WHERE event_type IN ('purchase', 'view', 'click') GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY branch) = 1",
    "t10_recent_per_tenant": "SELECT user_id % 7 AS tenant, event_id, event_type, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id DESC) AS rank FROM events QUALIFY rank <= 5",
    "p16_result": _G + """x AS (SELECT DISTINCT src || '__' || etype || '__' || dst AS edge FROM e WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)), m AS (SELECT (SELECT count(*) FROM x) >= 500 OR (SELECT count(DISTINCT id) FROM v) >= 500 AS has_more)
SELECT 'node' AS kind, id AS key, min(coalesce(label, '')) AS label, any_value(has_more) AS has_more FROM v, m GROUP BY id UNION ALL SELECT 'edge', edge, '', has_more FROM x, m""",
    "w1_override_order": "WITH x AS (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN (props ->> '$.k')::BIGINT % 20 END AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT event_id, n + coalesce(max(greatest(0, y - n)) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS position FROM x",
    "p18_hits": _hits_sql(2),
    "p19_weak_components": f"WITH k AS ({_CHAIN_SQL}), {_NODES} SELECT id, min(id) OVER (PARTITION BY (id - 1) // 7) AS component FROM n",
    "p20_strong_components": f"WITH k AS ({_CHAIN_SQL} UNION ALL SELECT event_id, event_id - 6 FROM events WHERE event_id % 14 = 0), {_NODES} SELECT id, CASE WHEN id > 0 AND (id - 1) // 7 % 2 = 1 AND ((id - 1) // 7 + 1) * 7 IN (SELECT event_id FROM events) THEN (id - 1) // 7 * 7 + 1 ELSE id END AS component FROM n",
}
