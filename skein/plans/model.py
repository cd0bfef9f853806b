"""A metadata graph bound to the driver's tables, stated in SQL that Spark and DuckDB both read.

Regions are databases, nations schemas with a package each, customers tables, suppliers routines (even ones in packages),
orders statements in trees of up to three, parts columns, order lines output columns. Statements read the tables whose
columns their lines name and write the table of their customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.operators.lineage import Graph
from skein.plans.derived import derived_graph
from skein.session import table

TABLES = ("region", "nation", "customer", "supplier", "orders", "part", "lineitem")
VERTICES = """
SELECT 'db:' || r_regionkey AS id, 'Database' AS vtype, r_name AS label, CAST(NULL AS STRING) AS scope, CAST(NULL AS STRING) AS parent FROM {region}
UNION ALL SELECT 'schema:' || n_nationkey, 'Schema', n_name, 'db:' || n_regionkey, NULL FROM {nation}
UNION ALL SELECT 'pkg:' || n_nationkey, 'Package', lower(n_name), 'schema:' || n_nationkey, NULL FROM {nation}
UNION ALL SELECT 'table:' || c_custkey, 'Table', c_name, 'schema:' || c_nationkey, NULL FROM {customer}
UNION ALL SELECT 'routine:' || s_suppkey, 'Routine', s_name, 'schema:' || s_nationkey, NULL FROM {supplier}
UNION ALL SELECT 'stmt:' || o_orderkey, 'Statement', o_orderpriority, NULL, CASE WHEN o_orderkey % 3 <> 0 THEN 'stmt:' || (o_orderkey - 1) END FROM {orders}
UNION ALL SELECT 'col:' || p_partkey, 'Column', p_name, 'table:' || (p_partkey % 100), NULL FROM {part}
UNION ALL SELECT 'col:x' || c_custkey, 'Column', 'spare', 'table:' || c_custkey, NULL FROM {customer} WHERE c_custkey % 10 = 0
UNION ALL SELECT DISTINCT 'out:' || l_orderkey || '.' || l_linenumber, 'OutputColumn', 'x.C' || l_linenumber, NULL, NULL FROM {lineitem}
UNION ALL SELECT DISTINCT 'aff:' || l_orderkey || '.' || l_linenumber, 'AffectedColumn', 't.c' || l_linenumber, NULL, NULL FROM {lineitem} WHERE l_linenumber <= 2 AND l_orderkey % 3 = 0
"""
EDGES = """
SELECT 'db:' || n_regionkey AS src, 'schema:' || n_nationkey AS dst, 'CONTAINS_SCHEMA' AS etype FROM {nation}
UNION ALL SELECT 'schema:' || c_nationkey, 'table:' || c_custkey, 'CONTAINS_TABLE' FROM {customer}
UNION ALL SELECT 'schema:' || n_nationkey, 'pkg:' || n_nationkey, 'CONTAINS_ROUTINE' FROM {nation}
UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'pkg:' ELSE 'schema:' END || s_nationkey, 'routine:' || s_suppkey, 'CONTAINS_ROUTINE' FROM {supplier}
UNION ALL SELECT 'routine:' || (o_custkey % 10), 'stmt:' || o_orderkey, 'CONTAINS_STMT' FROM {orders}
UNION ALL SELECT DISTINCT 'stmt:' || l_orderkey, 'table:' || (l_partkey % 100), 'READS_FROM' FROM {lineitem}
UNION ALL SELECT 'stmt:' || o_orderkey, 'table:' || o_custkey, 'WRITES_TO' FROM {orders}
UNION ALL SELECT 'stmt:' || o_orderkey, 'stmt:' || (o_orderkey - 1), 'CHILD_OF' FROM {orders} WHERE o_orderkey % 3 <> 0
UNION ALL SELECT 'table:' || (p_partkey % 100), 'col:' || p_partkey, 'HAS_COLUMN' FROM {part}
UNION ALL SELECT 'table:' || c_custkey, 'col:x' || c_custkey, 'HAS_COLUMN' FROM {customer} WHERE c_custkey % 10 = 0
UNION ALL SELECT DISTINCT 'stmt:' || l_orderkey, 'out:' || l_orderkey || '.' || l_linenumber, 'HAS_OUTPUT_COL' FROM {lineitem}
UNION ALL SELECT DISTINCT 'stmt:' || l_orderkey, 'aff:' || l_orderkey || '.' || l_linenumber, 'HAS_AFFECTED_COL' FROM {lineitem} WHERE l_linenumber <= 2 AND l_orderkey % 3 = 0
UNION ALL SELECT DISTINCT 'col:' || l_partkey, 'out:' || l_orderkey || '.' || l_linenumber, 'DATA_FLOW' FROM {lineitem}
UNION ALL SELECT DISTINCT 'out:' || l_orderkey || '.' || l_linenumber, 'aff:' || l_orderkey || '.' || l_linenumber, 'DATA_FLOW' FROM {lineitem} WHERE l_linenumber <= 2 AND l_orderkey % 3 = 0
UNION ALL SELECT DISTINCT 'col:' || l_partkey, 'stmt:' || l_orderkey, 'FILTER_FLOW' FROM {lineitem} WHERE l_returnflag = 'R' AND l_tax < 0.05
UNION ALL SELECT 'routine:' || s_suppkey, 'routine:' || (s_suppkey % 7), 'CALLS' FROM {supplier}
"""
# Atoms: one per order line, with the statement it stands in and what it was resolved to.
ATOMS = """
SELECT 'stmt:' || l_orderkey AS stmt, 'table:' || (l_partkey % 100) AS tbl, 'col:' || l_partkey AS col, CASE WHEN l_tax > 0.06 THEN 'SOURCE.' WHEN l_tax < 0.01 THEN 'TARGET.' ELSE 't.' END || 'c' || l_linenumber AS text,
  CASE l_linestatus WHEN 'O' THEN 'SELECT' ELSE 'WHERE' END AS context, CASE l_returnflag WHEN 'R' THEN 'resolved' WHEN 'A' THEN 'constant' ELSE 'unresolved' END AS status,
  CASE WHEN l_quantity > 10 THEN l_linenumber END AS output_order FROM {lineitem}
"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def bound(spark: SparkSession, sf_dir: str) -> Graph:
    return derived_graph(spark, sf_dir, "metadata", TABLES, lambda: (frame(spark, sf_dir, VERTICES), frame(spark, sf_dir, EDGES)))


def in_sql(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


WITH = f"WITH RECURSIVE v AS MATERIALIZED ({in_sql(VERTICES)}), e AS MATERIALIZED ({in_sql(EDGES)}), atoms AS ({in_sql(ATOMS)}), "
WITH += "rt AS (SELECT id FROM v WHERE vtype = 'Statement' AND parent IS NULL), climb AS (SELECT src AS sub, dst AS root FROM e WHERE etype = 'CHILD_OF' UNION SELECT c.sub, x.dst FROM climb c JOIN e x ON x.src = c.root AND x.etype = 'CHILD_OF'), top AS MATERIALIZED (SELECT sub, root FROM climb WHERE root IN (SELECT id FROM rt)), whole AS (SELECT id AS sub, id AS root FROM rt UNION ALL SELECT sub, root FROM top), "
