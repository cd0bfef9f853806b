"""Resolution reports over the bound session records and graph, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import diagnostics as dg
from skein.operators import graph as gr
from skein.operators import inventory as inv
from skein.operators import reports as rp
from skein.operators import resolution as rs
from skein.operators.lineage import root_of
from skein.operators.session_report import CURSORS, STATUSES, TYPES
from skein.plans.model import ATOMS, WITH, bound, frame, in_sql
from skein.plans.sessions import RECORDS, records


def _records(f):
    return lambda spark, sf_dir: f(records(spark, sf_dir))


def _graph(f):
    return lambda spark, sf_dir: f(bound(spark, sf_dir))


def _ends(g):
    both = [dg.end_routines(g.vertices, g.edges, "CALLS", side).select(F.lit(name).alias("part"), "id", "label") for name, side in (("leaf", "src"), ("root", "dst"))]
    return both[0].unionByName(both[1])


def _lookups(spark, sf_dir):
    g, atoms = bound(spark, sf_dir), frame(spark, sf_dir, ATOMS)
    of = lambda *types: g.vertices.filter(F.col("vtype").isin(*types)).select("id", F.coalesce("label", F.lit("")).alias("label"))
    owner = g.link("CONTAINS_STMT", "label", "id")
    scopes = g.vertices.filter("vtype = 'Table'").select("id", F.col("scope").alias("label"))
    rows = atoms.select("stmt", "tbl", "col", "text", F.when(F.col("output_order").isNotNull(), F.concat(F.regexp_replace("stmt", "stmt", "out"), F.lit("."), F.col("output_order").cast("string"))).alias("out"))
    found = rs.with_lookups(rows, {"output_name": ("out", of("OutputColumn")), "column_name": ("col", of("Column")), "table_name": ("tbl", of("Table")), "statement_name": ("stmt", of("Statement")), "routine": ("stmt", owner), "schema": ("tbl", scopes), "top": ("stmt", root_of(g).select(F.col("sub").alias("id"), F.col("root").alias("label")))})
    return found.drop("out")


QUERIES = {
    "g6_statement_atoms": _records(rs.statement_atoms),
    "g7_atom_status": _records(lambda r: rp.value_counts(r.filter("kind = 'atom'"), "status")),
    "g8_atom_contexts": _records(lambda r: rp.value_counts(r.filter("kind = 'atom'"), "detail")),
    "g9_routine_types": _records(rs.routine_types),
    "g18_session_rates": _records(rs.session_rates),
    "g30_atom_groups": _records(rs.atom_groups),
    "g34_routine_kinds": _records(lambda r: rp.value_counts(r.filter("kind = 'routine'"), "detail")),
    "g38_statement_kinds": _records(rs.statement_kinds),
    "g40_flow_totals": _graph(lambda g: g.of("DATA_FLOW", "FILTER_FLOW", "JOIN_FLOW", "UNION_FLOW").groupBy("etype").agg(F.count(F.lit(1)).alias("n"))),
    "g42_store_health": _records(rs.health),
    "g43_flow_pairs": _graph(lambda g: inv.pairs(g, "DATA_FLOW")),
    "g47_shared_tables": _graph(lambda g: gr.crossroads(g.edges)),
    "g48_call_ends": _graph(_ends),
    "g49_result_kinds": _records(lambda r: r.filter("kind = 'atom'").groupBy(F.lower("status").alias("result_kind"), F.col("detail").alias("context")).agg(F.count(F.lit(1)).alias("n"))),
    "j6_unused_tables": _graph(lambda g: gr.without_edge(g.vertices, g.edges, "Table", "READS_FROM")),
    "j13_all_lookups": _lookups,
    "p32_statement_extras": lambda spark, sf_dir: rs.statement_extras(records(spark, sf_dir), root_of(bound(spark, sf_dir)), "stmt:3"),
}

_R = f"WITH r AS ({in_sql(RECORDS)}) "
_S = ", ".join(f"count(*) FILTER (lower(status) = '{s}') AS {s}" for s in STATUSES)
_VALUES = "SELECT CASE WHEN trim(coalesce({0}, '')) = '' THEN 'UNKNOWN' ELSE {0} END AS name, count(*) AS n FROM r WHERE kind = '{1}' GROUP BY 1"
_TYPES = ", ".join(f"count(*) FILTER (upper(detail) = '{t}') AS {t.lower()}" for t in TYPES)
_OK, _BAD = (f"count(*) FILTER (kind = 'atom' AND lower(status) = '{s}')" for s in ("resolved", "unresolved"))
_TXT = r"regexp_extract(coalesce(name, ''), '^(.*?)(~[0-9]+:[0-9]+)?$', 1)"
_PLAIN = [f"SELECT 'n_{k}' AS metric, count(*)::BIGINT AS n FROM r WHERE kind = '{k}'" for k in rs.HEALTH_KINDS] + [f"SELECT 'atoms_{s}', count(*) FROM r WHERE kind = 'atom' AND lower(status) = '{s}'" for s in STATUSES]
_PLAIN += ["SELECT 'n_root', count(*) FROM r WHERE kind = 'statement' AND status = 'root'", "SELECT 'blank_snippets', count(*) FROM r WHERE kind = 'snippet' AND trim(name) = ''", f"SELECT 'resolution_pct', ({_OK} * 100 // greatest({_OK} + {_BAD}, 1))::BIGINT FROM r"]
_PLAIN += ["SELECT 'used_tables', count(DISTINCT name) FROM r WHERE kind IN ('read', 'write')"]
_PLAIN += [f"SELECT '{n}', count(*) FROM p WHERE {w}" for n, w in (("idle_statements", "s > 0 AND rd + wr = 0"), ("without_atoms", "s > 0 AND a = 0"), ("without_output", "s > 0 AND o = 0"), ("orphan_uses", "s = 0 AND rd + wr > 0"))] + ["SELECT 'most_atoms', max(a) FROM p"]
ORACLES = {
    "g6_statement_atoms": _R + f"SELECT owner AS stmt, count(*) AS total, {_S} FROM r WHERE kind = 'atom' GROUP BY owner",
    "g7_atom_status": _R + _VALUES.format("status", "atom"),
    "g8_atom_contexts": _R + _VALUES.format("detail", "atom"),
    "g9_routine_types": _R + f"SELECT owner AS routine, {_TYPES}, count(*) FILTER (upper(detail) IN {CURSORS}) AS cursor, count(*) FILTER (upper(detail) NOT IN {(*TYPES, *CURSORS, '')}) AS other FROM r WHERE kind = 'statement' GROUP BY owner",
    "g18_session_rates": _R + f"SELECT session, count(*) FILTER (kind = 'statement') AS statements, count(*) FILTER (kind = 'atom') AS atoms, CASE WHEN {_OK} + {_BAD} = 0 THEN 1.0::DOUBLE ELSE {_OK}::DOUBLE / ({_OK} + {_BAD}) END AS rate FROM r GROUP BY session",
    "g30_atom_groups": _R + f""", a AS (SELECT lower(coalesce(status, 'unknown')) AS status, {_TXT} AS name, coalesce(detail, '') AS context FROM r WHERE kind = 'atom')
SELECT 'status' AS part, status AS name, NULL AS context, count(*)::BIGINT AS n FROM a GROUP BY status
UNION ALL SELECT 'context', NULL, context, count(*) FROM a WHERE status = 'unresolved' GROUP BY context
UNION ALL (SELECT 'text', name, context, count(*) FROM a WHERE status = 'unresolved' GROUP BY name, context ORDER BY 4 DESC, 2, 3 LIMIT 20)""",
    "g34_routine_kinds": _R + _VALUES.format("detail", "routine"),
    "g38_statement_kinds": _R + """, k AS (SELECT owner, count(*) AS kids FROM r WHERE kind = 'child' GROUP BY owner), u AS (SELECT DISTINCT owner FROM r WHERE kind IN ('read', 'write'))
SELECT upper(coalesce(detail, '')) AS type, status = 'root' AS is_root, count(*) AS n, sum(coalesce(kids, 0))::BIGINT AS children, count(*) FILTER (u.owner IS NULL) AS idle FROM r LEFT JOIN k ON k.owner = r.id LEFT JOIN u ON u.owner = r.id WHERE kind = 'statement' GROUP BY 1, 2""",
    "g40_flow_totals": WITH + "x AS (SELECT 1) SELECT etype, count(*) AS n FROM e WHERE etype IN ('DATA_FLOW', 'FILTER_FLOW') GROUP BY etype",
    "g42_store_health": _R + ", p AS (SELECT CASE kind WHEN 'statement' THEN id ELSE owner END AS stmt, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {n}" for k, n in (("statement", "s"), ("atom", "a"), ("read", "rd"), ("write", "wr"), ("output", "o"))) + " FROM r WHERE kind IN ('statement', 'atom', 'read', 'write', 'output') GROUP BY 1) " + " UNION ALL ".join(_PLAIN),
    "g43_flow_pairs": WITH + "x AS (SELECT 1) SELECT a.label AS src_label, b.label AS dst_label FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE etype = 'DATA_FLOW' ORDER BY 1, 2 LIMIT 30",
    "g47_shared_tables": WITH + "g AS (SELECT dst AS id, count(*) FILTER (etype = 'READS_FROM') AS read_by, count(*) FILTER (etype = 'WRITES_TO') AS written_by FROM e WHERE etype IN ('READS_FROM', 'WRITES_TO') GROUP BY dst) SELECT * FROM g WHERE read_by > 0 AND written_by > 0",
    "g48_call_ends": WITH + "c AS (SELECT src, dst FROM e WHERE etype = 'CALLS') SELECT 'leaf' AS part, id, label FROM v WHERE vtype = 'Routine' AND id NOT IN (SELECT src FROM c) UNION ALL SELECT 'root', id, label FROM v WHERE vtype = 'Routine' AND id NOT IN (SELECT dst FROM c)",
    "g49_result_kinds": _R + "SELECT lower(status) AS result_kind, detail AS context, count(*) AS n FROM r WHERE kind = 'atom' GROUP BY ALL",
    "j6_unused_tables": WITH + "x AS (SELECT 1) SELECT id, label FROM v WHERE vtype = 'Table' AND id NOT IN (SELECT dst FROM e WHERE etype = 'READS_FROM')",
    "j13_all_lookups": WITH + """x AS (SELECT *, CASE WHEN output_order IS NOT NULL THEN replace(stmt, 'stmt', 'out') || '.' || output_order END AS o FROM atoms)
SELECT x.stmt, tbl, col, text, coalesce(a.label, '') AS output_name, coalesce(b.label, '') AS column_name, coalesce(c.label, '') AS table_name, coalesce(d.label, '') AS statement_name, coalesce(r.src, '') AS routine, coalesce(c.scope, '') AS schema, coalesce(t.root, '') AS top
FROM x LEFT JOIN v a ON a.id = o LEFT JOIN v b ON b.id = col LEFT JOIN v c ON c.id = tbl LEFT JOIN v d ON d.id = x.stmt LEFT JOIN (SELECT src, dst FROM e WHERE etype = 'CONTAINS_STMT') r ON r.dst = x.stmt LEFT JOIN top t ON t.sub = x.stmt""",
    "p32_statement_extras": WITH + f"""r AS ({in_sql(RECORDS)}), u AS (SELECT sub FROM top WHERE root = 'stmt:3')
SELECT 'descendant' AS part, coalesce(detail, '') AS name, count(*) AS n FROM r WHERE kind = 'statement' AND id IN (SELECT sub FROM u) GROUP BY ALL
UNION ALL SELECT 'context', coalesce(detail, ''), count(*) FROM r WHERE kind = 'atom' AND (owner IN (SELECT sub FROM u) OR owner = 'stmt:3') GROUP BY ALL""",
}
