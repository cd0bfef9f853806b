"""Scope, display, overview and community queries bound to the metadata graph, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import community as cm
from skein.operators import display as dp
from skein.operators.lineage import Graph
from skein.plans.model import WITH, bound
from skein.session import table

HOLDS = ("CONTAINS_SCHEMA", "CONTAINS_TABLE", "CONTAINS_ROUTINE", "HAS_COLUMN")


def _graph(f):
    return lambda spark, sf_dir: f(bound(spark, sf_dir))


def _scopes(g: Graph) -> DataFrame:
    """What 30 schemas and databases and 34 customers' tables lie in and hold."""
    tables = [f"table:{i}" for i in range(1, 35)]
    sources = g.vertices.filter(F.col("vtype").isin("Schema", "Database") | F.col("id").isin(tables)).select("id")
    return dp.reach_many(g.of(*HOLDS), sources)


def _hoisted(g: Graph) -> DataFrame:
    nested, lifted = dp.hoisted_reads(g)
    return nested.select(F.lit("nested").alias("part"), F.col("id").alias("src"), F.lit("").alias("dst")).unionByName(lifted.select(F.lit("read").alias("part"), "src", "dst"))


def _flags(g: Graph) -> DataFrame:
    scope = dp.containment(g, g.vertices.filter("id = 'db:1'").select("id"), HOLDS).select("id")
    hidden = g.vertices.filter("vtype = 'Table' AND label LIKE '%7'").select("id")
    return dp.node_flags(g.vertices.filter("vtype <> 'OutputColumn'"), g.edges, ("Database", "Schema"), hidden, upstream=False, scope=scope)


def _contracted(g: Graph) -> DataFrame:
    """Routines and tables alone: statements and packages are bridged."""
    hidden = g.vertices.filter(F.col("vtype").isin("Statement", "Package")).select("id")
    return dp.contracted(g.of("CONTAINS_ROUTINE", "CONTAINS_STMT", "READS_FROM", "WRITES_TO"), hidden)


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = F.col("n_nationkey") % 4 > 0
    return dp.overview(nations.select(
        F.concat(F.lit("schema:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"),
        F.when(named, F.concat(F.lit("db:"), F.col("n_regionkey").cast("string"))).alias("db"), F.when(named, F.col("r_name")).alias("db_name"),
        F.when(F.col("n_regionkey") < 3, F.concat(F.lit("app:"), (F.col("n_regionkey") % 2).cast("string"))).alias("app"), F.lit(None).cast("string").alias("app_name"),
    ))


def _modularity(g: Graph) -> DataFrame:
    """Communities of the whole graph: every edge of every type counts."""
    return cm.by_modularity(g.edges)


QUERIES = {
    "p23_community": _graph(lambda g: cm.by_schema(g.vertices.filter("vtype = 'Table'"))),
    "p23_modularity": _graph(_modularity),
    "p25_scopes": _graph(_scopes),
    "p26_hoisted_reads": _graph(_hoisted),
    "p27_node_flags": _graph(_flags),
    "p27_contracted": _graph(_contracted),
    "p27_table_level": _graph(lambda g: dp.shown_edges(g.edges, table_level=True, downstream=False).select("src", "dst", "etype")),
    "p40_overview": _overview,
}

_HOLDS = str(HOLDS)
_UP, _DOWN = str(dp.UP), str(dp.DOWN)
ORACLES = {
    "p23_community": WITH + "x AS (SELECT 1) SELECT id, scope AS community FROM v WHERE vtype = 'Table' AND scope IS NOT NULL",
    "p25_scopes": WITH + f"""
n AS MATERIALIZED (SELECT src AS a, dst AS b FROM e WHERE etype IN {_HOLDS} UNION SELECT dst, src FROM e WHERE etype IN {_HOLDS}),
s AS (SELECT id FROM v WHERE vtype IN ('Schema', 'Database') OR id IN (SELECT 'table:' || i FROM range(1, 35) t(i))),
walk AS (SELECT id AS source, id FROM s UNION SELECT w.source, n.b FROM walk w JOIN n ON n.a = w.id)
SELECT source, id FROM walk""",
    "p26_hoisted_reads": WITH + """
reads AS (SELECT src, dst FROM e WHERE etype = 'READS_FROM')
SELECT 'nested' AS part, src, '' AS dst FROM e WHERE etype = 'CHILD_OF' GROUP BY src
UNION ALL SELECT 'read', root, dst FROM (SELECT DISTINCT root, dst FROM top JOIN reads ON src = sub) l WHERE (root, dst) NOT IN (SELECT (src, dst) FROM reads)""",
    "p27_node_flags": WITH + f"""
hold AS (SELECT dst AS id FROM e WHERE src = 'db:1' AND etype IN {_HOLDS} UNION SELECT e.dst FROM hold JOIN e ON e.src = hold.id AND etype IN {_HOLDS}),
had AS (SELECT src AS id FROM e WHERE etype IN {_UP} OR etype IN {_DOWN} UNION SELECT dst FROM e WHERE etype IN {_UP} OR etype IN {_DOWN}),
has AS (SELECT src AS id FROM e WHERE etype IN {_DOWN} UNION SELECT dst FROM e WHERE etype IN {_DOWN})
SELECT id, vtype, vtype IN ('Database', 'Schema') OR (vtype = 'Table' AND label LIKE '%7') AS hidden,
  (id IN (SELECT id FROM had) AND id NOT IN (SELECT id FROM has)) OR id NOT IN (SELECT id FROM hold) AS dimmed FROM v WHERE vtype <> 'OutputColumn'""",
    "p27_contracted": WITH + """
g AS MATERIALIZED (SELECT src, dst FROM e WHERE etype IN ('CONTAINS_ROUTINE', 'CONTAINS_STMT', 'READS_FROM', 'WRITES_TO')),
hid AS MATERIALIZED (SELECT id FROM v WHERE vtype IN ('Statement', 'Package')),
thru AS (SELECT src, dst AS mid FROM g WHERE dst IN (SELECT id FROM hid) AND src NOT IN (SELECT id FROM hid) UNION SELECT t.src, g.dst FROM thru t JOIN g ON g.src = t.mid WHERE g.dst IN (SELECT id FROM hid))
SELECT src, dst FROM g WHERE dst NOT IN (SELECT id FROM hid) AND src NOT IN (SELECT id FROM hid)
UNION SELECT t.src, g.dst FROM thru t JOIN g ON g.src = t.mid WHERE g.dst NOT IN (SELECT id FROM hid)""",
    "p27_table_level": WITH + f"x AS (SELECT 1) SELECT src, dst, etype FROM e WHERE etype NOT IN {dp.COLUMN_EDGES} AND etype NOT IN {_DOWN}",
    "p40_overview": """
WITH s AS (
  SELECT 'schema:' || n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 4 > 0 THEN 'db:' || n_regionkey END AS db, CASE WHEN n_nationkey % 4 > 0 THEN r_name END AS db_name,
    CASE WHEN n_regionkey < 3 THEN 'app:' || (n_regionkey % 2) END AS app FROM nation JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT *, coalesce(db, 'stub:' || app, 'stub') AS db_key, coalesce(db_name, 'unnamed') AS db_label FROM s),
d AS (SELECT app, db_key, min(db_label) AS db_label FROM k GROUP BY ALL),
a AS (SELECT app FROM d WHERE app IS NOT NULL GROUP BY app HAVING count(*) > 1)
SELECT 'application' AS kind, app AS id, NULL AS parent, app AS label FROM a
UNION ALL SELECT 'database', db_key, CASE WHEN app IN (SELECT app FROM a) THEN app END, db_label FROM d
UNION ALL SELECT 'schema', id, db_key, name FROM k""",
}
