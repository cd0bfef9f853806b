"""Session reports bound to the driver's tables: suppliers as routines, orders as statements, order lines as atoms.

Session k holds the suppliers whose key modulo 10 is k, the orders of the customers of that remainder, and what hangs on these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import session_report as sr
from skein.plans.model import frame, in_sql

_NONE = "CAST(NULL AS STRING)"
_LINES = "{lineitem} JOIN {orders} ON o_orderkey = l_orderkey"
RECORDS = f"""
SELECT DISTINCT 'sess:' || (s_suppkey % 10) AS session, 'session' AS kind, 'sess:' || (s_suppkey % 10) AS id, {_NONE} AS owner, 'file' || (s_suppkey % 10) || '.pck' AS name,
  'plsql' AS detail, {_NONE} AS status, CAST(NULL AS BIGINT) AS line, CAST(NULL AS BIGINT) AS pos FROM {{supplier}}
UNION ALL SELECT 'sess:' || (s_suppkey % 10), 'routine', 'routine:' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'pkg:' || s_nationkey END, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'FUNCTION' ELSE 'PROCEDURE' END, NULL, NULL, NULL FROM {{supplier}}
UNION ALL SELECT 'sess:' || (s_suppkey % 10), 'call', 'call:' || s_suppkey, s_name, 'routine:' || (s_suppkey % 7), NULL, NULL, s_suppkey % 100, NULL FROM {{supplier}}
UNION ALL SELECT 'sess:' || (s_suppkey % 10), 'parameter', 'param:' || s_suppkey, s_name, 'p_' || s_nationkey, 'NUMBER', CASE WHEN s_nationkey % 2 = 0 THEN 'IN' ELSE 'OUT' END, NULL, NULL FROM {{supplier}}
UNION ALL SELECT 'sess:' || (s_suppkey % 10), 'variable', 'var:' || s_suppkey, s_name, 'v_' || s_nationkey, 'VARCHAR2', NULL, NULL, NULL FROM {{supplier}}
UNION ALL SELECT 'sess:' || (o_custkey % 10), 'statement', 'stmt:' || o_orderkey, 'routine:' || (o_custkey % 10), NULL,
  CASE o_orderkey % 7 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'insert' WHEN 2 THEN 'UPDATE' WHEN 3 THEN 'FOR_CURSOR' WHEN 4 THEN 'MERGE' WHEN 5 THEN 'BLOCK' ELSE '' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'root' ELSE 'child' END, o_orderkey % 1000, NULL FROM {{orders}}
UNION ALL SELECT 'sess:' || (o_custkey % 10), 'child', 'stmt:' || o_orderkey, 'stmt:' || (o_orderkey - o_orderkey % 3), NULL, NULL, NULL, NULL, NULL FROM {{orders}} WHERE o_orderkey % 3 <> 0
UNION ALL SELECT 'sess:' || (o_custkey % 10), 'snippet', 'snip:' || o_orderkey, 'stmt:' || o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'text of ' || o_orderpriority END, NULL, NULL, NULL, NULL FROM {{orders}}
UNION ALL SELECT 'sess:' || (o_custkey % 10), 'write', 'w:' || o_orderkey, 'stmt:' || o_orderkey, 'table:' || o_custkey, NULL, NULL, NULL, NULL FROM {{orders}}
UNION ALL SELECT DISTINCT 'sess:' || (o_custkey % 10), 'read', 'r:' || l_orderkey || '.' || (l_partkey % 100), 'stmt:' || l_orderkey, 'table:' || (l_partkey % 100), NULL, NULL, NULL, NULL FROM {_LINES}
UNION ALL SELECT 'sess:' || (o_custkey % 10), 'atom', 'atom:' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey, 'stmt:' || l_orderkey, 'c' || l_linenumber || '~' || (l_partkey % 90) || ':' || l_linenumber,
  CASE l_linestatus WHEN 'O' THEN 'SELECT' ELSE 'WHERE' END, CASE l_returnflag WHEN 'R' THEN 'resolved' WHEN 'A' THEN 'constant' ELSE 'UNRESOLVED' END, l_partkey % 90, l_linenumber FROM {_LINES}
UNION ALL SELECT DISTINCT 'sess:' || (o_custkey % 10), 'output', 'out:' || l_orderkey || '.' || l_linenumber, 'stmt:' || l_orderkey, 'x.C' || l_linenumber, NULL, NULL, NULL, l_linenumber FROM {_LINES}
UNION ALL SELECT DISTINCT 'sess:' || (o_custkey % 10), 'affected', 'aff:' || l_orderkey || '.' || l_linenumber, 'stmt:' || l_orderkey, 't.c' || l_linenumber, NULL, NULL, NULL, l_linenumber FROM {_LINES} WHERE l_linenumber <= 2
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged records; a registered query writes those of its sessions once and feeds all loaders from them."""
    return frame(spark, sf_dir, RECORDS)


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    scripts = rows.filter("kind = 'routine'").select(F.col("id").alias("file"), F.concat_ws("\n", F.concat(F.lit("create "), "detail"), "name", F.lit("begin"), F.lit("end;")).alias("script"))
    spans = rows.filter("kind = 'routine'").select(F.col("id").alias("id"), F.col("id").alias("file"), F.lit(2).alias("first"), F.when(F.col("detail") == "FUNCTION", 9).otherwise(3).alias("last"))
    return sr.source_of(sr.lines_of(scripts), spans)


ASKED = ["sess:1", "sess:4"]
QUERIES = {
    "p31_session_report": lambda spark, sf_dir: sr.session_report(records(spark, sf_dir), ASKED),
    "p33_snippets": lambda spark, sf_dir: sr.snippets_of(records(spark, sf_dir), [f"stmt:{i}" for i in range(0, 2000, 2)]),
    "p38_routine_source": _source,
}

_TEXT = "concat_ws('|', coalesce(owner, ''), coalesce(name, ''), coalesce(detail, ''), coalesce(status, ''), coalesce(line::VARCHAR, ''), coalesce(pos::VARCHAR, ''))"
_BY = {"statement": "owner, id", "atom": "owner, line, pos, name, id", "output": "owner, pos, name", "affected": "owner, pos, name", "call": "owner, line, name", "snippet": "owner, name"}
_RANKS = " UNION ALL ".join(
    f"SELECT *, row_number() OVER (PARTITION BY session ORDER BY {', '.join(c.strip() + ' NULLS FIRST' for c in _BY.get(k, 'owner, name, id').split(','))}) AS rank FROM r WHERE kind = '{k}'{' AND trim(coalesce(name, chr(32))) <> chr(0) AND length(trim(coalesce(name, chr(32)))) > 0' if k == 'snippet' else ''} QUALIFY rank <= {n}"
    for k, n in sr.LIMITS.items()
)
_OF = "count(*) FILTER (kind = 'atom' AND lower(status) = '{}')"
_ROOTS = "count(*) FILTER (kind = 'statement' AND status = 'root' AND {})"
_SUMMARY = ", ".join([
    "count(*) FILTER (kind = 'routine')", *(_ROOTS.format(f"upper(detail) = '{t}'") for t in sr.TYPES), _ROOTS.format(f"upper(detail) IN {sr.CURSORS}"),
    _ROOTS.format(f"upper(detail) NOT IN {sr.TYPES + sr.CURSORS} AND detail <> ''"), "count(*) FILTER (kind = 'atom')", *map(_OF.format, sr.STATUSES),
])
ORACLES = {
    "p31_session_report": f"""
WITH RECURSIVE r AS MATERIALIZED (SELECT * FROM ({in_sql(RECORDS)}) WHERE session IN ('sess:1', 'sess:4')),
k AS MATERIALIZED ({_RANKS}),
own AS (SELECT s.*, p.owner AS parent FROM k s LEFT JOIN (SELECT session, id, min(owner) AS owner FROM r WHERE kind = 'child' GROUP BY ALL) p ON p.session = s.session AND p.id = s.id WHERE s.kind = 'statement'),
near AS (SELECT o.*, q.id AS above FROM own o LEFT JOIN own q ON q.session = o.session AND q.id = o.parent),
tree AS (SELECT session, id, [rank] AS path FROM near WHERE above IS NULL UNION ALL SELECT n.session, n.id, list_append(t.path, n.rank) FROM tree t JOIN near n ON n.session = t.session AND n.above = t.id),
atoms AS (SELECT session, owner, concat_ws('/', count(*), {", ".join(map(_OF.format, sr.STATUSES))}) AS atoms FROM r WHERE kind = 'atom' GROUP BY ALL),
uses AS (SELECT session, owner, string_agg(DISTINCT name, ',' ORDER BY name) FILTER (kind = 'read') AS sources, string_agg(DISTINCT name, ',' ORDER BY name) FILTER (kind = 'write') AS targets FROM k WHERE kind IN ('read', 'write') GROUP BY ALL),
sub AS (SELECT session, above, count(*) AS n FROM near WHERE above IS NOT NULL GROUP BY ALL)
SELECT session, 'summary' AS section, 1::BIGINT AS at, concat_ws('|', max(name) FILTER (kind = 'session'), max(detail) FILTER (kind = 'session'), {_SUMMARY}) AS item FROM r GROUP BY session
UNION ALL SELECT session, 'table', row_number() OVER (PARTITION BY session ORDER BY item), item FROM (SELECT session, concat_ws('|', name, count(*) FILTER (kind = 'read'), count(*) FILTER (kind = 'write')) AS item FROM r WHERE kind IN ('read', 'write') GROUP BY session, name)
UNION ALL SELECT session, kind, rank, {_TEXT} FROM k WHERE kind NOT IN ('statement', 'read', 'write')
UNION ALL SELECT t.session, 'statement', row_number() OVER (PARTITION BY t.session ORDER BY path), concat_ws('|', len(path) - 1, t.id, detail, line, o.owner, coalesce(atoms, '0/0/0/0/0'), coalesce(sources, ''), coalesce(targets, ''), coalesce(sub.n, 0))
  FROM tree t JOIN own o ON o.session = t.session AND o.id = t.id LEFT JOIN atoms a ON a.session = t.session AND a.owner = t.id LEFT JOIN uses u ON u.session = t.session AND u.owner = t.id LEFT JOIN sub ON sub.session = t.session AND sub.above = t.id
""",
    "p33_snippets": f"SELECT owner AS id, name AS snippet FROM ({in_sql(RECORDS)}) WHERE kind = 'snippet' AND trim(name) <> '' AND split_part(owner, ':', 2)::BIGINT % 2 = 0 AND split_part(owner, ':', 2)::BIGINT < 2000",
    "p38_routine_source": "SELECT 'routine:' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 3 ELSE 2 END::BIGINT AS n_lines, s_name || chr(10) || 'begin' || CASE WHEN s_suppkey % 3 = 0 THEN chr(10) || 'end;' ELSE '' END AS source FROM supplier",
}
