"""Explore, search and inventory queries bound to the metadata graph of ``model``, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import inventory as inv
from skein.operators import lineage as ln
from skein.operators import search as sc
from skein.plans.model import ATOMS, WITH, bound, frame
from skein.session import table


def _graph(f):
    return lambda spark, sf_dir: f(bound(spark, sf_dir))


def _atoms(f):
    return lambda spark, sf_dir: f(frame(spark, sf_dir, ATOMS))


def _both(f):
    return lambda spark, sf_dir: f(bound(spark, sf_dir), frame(spark, sf_dir, ATOMS))


def _tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as tenants, of which those of even regions are active."""
    nations = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("tenant"), F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    return sc.search_tenants(customers, nations.select(F.col("n_name").alias("tenant"), F.when(F.col("n_regionkey") % 2 == 0, "ACTIVE").otherwise("SUSPENDED").alias("status")), "1", 20)


def _enriched(g: ln.Graph) -> DataFrame:
    sources = g.vertices.filter("vtype = 'Table' or vtype = 'Schema'").select("id", F.when(F.col("id").endswith("3"), "ddl").when(F.col("id").endswith("4"), " ").alias("data_source"))
    return ln.enriched(g.vertices.filter("vtype in ('Table', 'Schema')").select("id", "vtype"), sources)


def _phantoms(g: ln.Graph) -> DataFrame:
    source = F.when(F.col("vtype") == "Table", F.when(F.col("id").endswith("3"), "ddl").otherwise("reconstructed")).otherwise("reconstructed")
    return ln.phantom_columns(g.vertices.filter("vtype in ('Table', 'Column')").select("id", source.alias("data_source")), g)


def _applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.concat(F.lit("db:"), F.col("r_regionkey").cast("string")).alias("database"), F.concat(F.lit("app"), (F.col("r_regionkey") % 2).cast("string")).alias("app"))
    return inv.hierarchy(bound(spark, sf_dir), apps)


def _joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return inv.join_report(lines.select(F.col("l_returnflag").alias("join_type"), F.when(F.col("l_quantity") > 5, F.col("l_partkey").cast("string")).alias("source"), F.when(F.col("l_tax") > 0.02, F.col("l_suppkey").cast("string")).otherwise(" ").alias("target")))


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return inv.sums_by(orders, "o_orderpriority", statements=F.lit(1), parse=F.col("o_custkey"), walk=F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))


QUERIES = {
    "p6_upstream": _graph(lambda g: ln.upstream(g, "stmt:0")),
    "p7_downstream": _graph(lambda g: ln.downstream(g, "stmt:0")),
    "p8_explore": _graph(lambda g: ln.explore(g, "pkg-pkg:2|db")),
    "p9_explore_schema": _graph(lambda g: ln.explore_schema(g, "schema:1", external=True)),
    "p10_explore_database": _graph(lambda g: ln.explore_database(g, "db:1")),
    "p11_explore_package": _graph(lambda g: ln.explore_package(g, "pkg:1")),
    "p12_explore_node": _graph(lambda g: ln.explore_node(g, "table:5")),
    "p13_routine_aggregate": _graph(lambda g: ln.routine_aggregate(g, "schema:3")),
    "p14_routine_scope": _graph(lambda g: ln.routine_scope(g, "routine:4")),
    "p15_statement_tree": _graph(lambda g: ln.statement_tree(g, "stmt:0")),
    "p41_flattened": _graph(lambda g: ln.flattened(g, "stmt:0")),
    "s5_described": _graph(lambda g: ln.described(g, ln.routine_scope(g, "routine:4"))),
    "p4_roots": _graph(ln.climbed),
    "p39_column_flow": _graph(lambda g: ln.column_flow(g, g.roots("root").select(F.col("root").alias("sub"), "root"))),
    "g5_routine_uses": _graph(lambda g: ln.routine_uses(g, g.typed("routine", "Routine"))),
    "b15_enriched": _graph(_enriched),
    "b17_phantom_columns": _graph(_phantoms),
    "p28_search": _graph(lambda g: sc.search(g.vertices, "1", 40)),
    "p29_search_tenants": _tenants,
    "p30_table_detail": _graph(lambda g: sc.table_detail(g, "table:7")),
    "p30_table_routines": _graph(lambda g: sc.table_routines(g, "table:7")),
    "p30_column_statements": _graph(lambda g: sc.column_statements(g, "col:7")),
    "p32_statement_sources": _graph(lambda g: sc.statement_sources(g, "stmt:0")),
    "p34_orphan_tables": _graph(lambda g: sc.template(g, "orphan_tables")),
    "p34_schema_summary": _graph(lambda g: sc.template(g, "schema_summary", database="db:1")),
    "p34_package_routines": _graph(lambda g: sc.template(g, "package_routines")),
    "p35_ad_hoc": lambda spark, sf_dir: sc.ad_hoc(spark, "SELECT n_name, n_regionkey FROM {n} WHERE n_regionkey = 1", n=table(spark, sf_dir, "nation")),
    "g3_overview": _graph(inv.overview),
    "g4_hierarchy": _applications,
    "g10_column_counts": _graph(inv.column_counts),
    "g11_output_atoms": _both(lambda g, a: inv.output_atoms(g, a, "stmt:5")),
    "g13_scope_sample": _graph(lambda g: inv.scope_sample(g, "schema:1")),
    "g14_statistics": _both(inv.statistics),
    "g26_per_database": _graph(inv.per_database),
    "g28_pipeline_sums": _sums,
    "g31_alias_leaks": _atoms(inv.alias_leaks),
    "g32_without_output": _atoms(inv.without_output),
    "g33_outputs_per_statement": _graph(inv.outputs_per_statement),
    "g34_nested_routines": _graph(inv.nested_routines),
    "g35_tables_without_columns": _graph(inv.tables_without_columns),
    "g35_widest_tables": _graph(inv.widest_tables),
    "g38_nesting": _graph(inv.nesting),
    "g39_joins": _joins,
    "g40_filter_candidates": _both(inv.filter_candidates),
    "g43_call_pairs": _graph(lambda g: inv.pairs(g, "CALLS")),
    "g45_complex_statements": _atoms(inv.most_complex),
    "g45_used_columns": _graph(inv.most_used_columns),
    "g46_empty_packages": _graph(inv.empty_packages),
    "g46_never_read_columns": _graph(inv.never_read_columns),
    "g49_unresolved": _atoms(inv.unresolved),
    "g17_statement_quality": _atoms(inv.statement_quality),
    "j13_atom_references": _both(inv.atom_references),
    "p40_buckets": lambda spark, sf_dir: inv.bucketed(table(spark, sf_dir, "nation"), "n_name", 4),
}

_STAR = "src, dst, etype"


def _branch(src: str, dst: str, etype: str, rest: str, limit: int | None = None) -> str:
    cut = f" ORDER BY 1, 2 LIMIT {limit}" if limit else ""
    return f"(SELECT DISTINCT {src} AS src, {dst} AS dst, '{etype}' AS etype FROM {rest}{cut})"


def _e(etype: str, name: str) -> str:
    return f"(SELECT src, dst FROM e WHERE etype = '{etype}') {name}"


def _all(*branches: str) -> str:
    return " UNION ALL ".join(branches)


def _schema_sql(schemas: str, limits: dict[str, int]) -> list[str]:
    tbl = f"{_e('CONTAINS_TABLE', 't')} JOIN {schemas} s ON t.src = s.id"
    held = f"{_e('CONTAINS_ROUTINE', 'h')} JOIN {schemas} s ON h.src = s.id"
    kind = lambda col, t: f"{col} IN (SELECT id FROM v WHERE vtype IN ({t}))"
    nested = f"{held} JOIN {_e('CONTAINS_ROUTINE', 'n')} ON n.src = h.dst"
    owned = lambda r: f"JOIN {_e('CONTAINS_STMT', 'o')} ON o.src = {r} AND o.dst IN (SELECT id FROM rt)"
    uses = lambda t: f"{tbl} JOIN {_e(t, 'u')} ON u.dst = t.dst"
    return [
        _branch("t.src", "t.dst", "CONTAINS_TABLE", tbl, limits["tables"]),
        _branch("h.src", "h.dst", "CONTAINS_ROUTINE", f"{held} WHERE {kind('h.dst', chr(39) + 'Package' + chr(39) + ', ' + chr(39) + 'Routine' + chr(39))}", limits["routines"]),
        _branch("h.dst", "o.dst", "CONTAINS_STMT", f"{held} {owned('h.dst')} WHERE {kind('h.dst', chr(39) + 'Routine' + chr(39))}", limits["statements"]),
        _branch("n.src", "n.dst", "CONTAINS_ROUTINE", nested, limits["routines"]),
        _branch("n.dst", "o.dst", "CONTAINS_STMT", f"{nested} {owned('n.dst')}", limits["statements"]),
        _branch("u.src", "u.dst", "WRITES_TO", f"{uses('WRITES_TO')} WHERE u.src IN (SELECT id FROM rt)", limits["uses"]),
        _branch("u.src", "u.dst", "READS_FROM", f"{uses('READS_FROM')} WHERE u.src IN (SELECT id FROM rt)", limits["uses"]),
        _branch("top.root", "u.dst", "READS_FROM", f"{uses('READS_FROM')} JOIN top ON top.sub = u.src", limits["hoisted"]),
        _branch("top.root", "u.dst", "WRITES_TO", f"{uses('WRITES_TO')} JOIN top ON top.sub = u.src", limits["hoisted"]),
        _branch("w.src", "w.dst", "WRITES_TO", f"{uses('READS_FROM')} JOIN {_e('WRITES_TO', 'w')} ON w.src = u.src WHERE u.src IN (SELECT id FROM rt)", limits["hoisted"]),
    ]


def _flow_sql(within: str) -> str:
    """Column flow into the roots of pairs (sub, root); labels meet by their upper-cased last segment."""
    seg = "upper(string_split(label, '.')[-1])"
    own = lambda t, n: f"(SELECT x.src AS root, x.dst AS id, {seg} AS seg FROM e x JOIN v ON v.id = x.dst WHERE etype = '{t}') {n}"
    return f"(SELECT DISTINCT h.src AS src, w.root AS dst, 'DATA_FLOW' AS etype, 'src-' || f.src AS source_handle, coalesce('tgt-' || coalesce(a.id, b.id), '') AS target_handle FROM {within} w JOIN {_e('HAS_OUTPUT_COL', 'o')} ON o.src = w.sub JOIN {_e('DATA_FLOW', 'f')} ON f.dst = o.dst JOIN {_e('HAS_COLUMN', 'h')} ON h.dst = f.src JOIN (SELECT id, {seg} AS seg FROM v) l ON l.id = o.dst LEFT JOIN {own('HAS_AFFECTED_COL', 'a')} ON a.root = w.root AND a.seg = l.seg LEFT JOIN {own('HAS_OUTPUT_COL', 'b')} ON b.root = w.root AND b.seg = l.seg)"


def _filter_sql(within: str) -> str:
    return f"(SELECT DISTINCT h.src AS src, w.root AS dst, 'FILTER_FLOW' AS etype, 'src-' || f.src AS source_handle, '' AS target_handle FROM {within} w JOIN {_e('FILTER_FLOW', 'f')} ON f.dst = w.sub JOIN {_e('HAS_COLUMN', 'h')} ON h.dst = f.src)"


_BARE = "SELECT *, '' AS source_handle, '' AS target_handle FROM"
_RW = "etype IN ('READS_FROM', 'WRITES_TO')"
_NODE = "(SELECT sub, root FROM whole WHERE root = 'stmt:0')"
_UNDER = "(SELECT sub, root FROM top WHERE root = 'stmt:0')"
_SHOWN = "(SELECT id FROM v WHERE vtype <> 'Statement' OR parent IS NULL)"
_S1 = "(SELECT 'schema:1' AS id)"
_EXT = f"(SELECT w.sub, w.root FROM whole w JOIN {_e('CONTAINS_STMT', 'o')} ON o.dst = w.root WHERE o.src IN (SELECT h.dst FROM {_e('CONTAINS_ROUTINE', 'h')} WHERE h.src = 'schema:1' UNION SELECT n.dst FROM {_e('CONTAINS_ROUTINE', 'h')} JOIN {_e('CONTAINS_ROUTINE', 'n')} ON n.src = h.dst WHERE h.src = 'schema:1'))"
_FAR = lambda t: f"{_EXT} w JOIN {_e(t, 'u')} ON u.src = w.sub JOIN v ON v.id = u.dst WHERE v.scope <> 'schema:1'"


def _package_sql(pkg: str) -> str:
    r = f"{_e('CONTAINS_ROUTINE', 'h')} JOIN {_e('CONTAINS_STMT', 'o')} ON o.src = h.dst AND o.dst IN (SELECT id FROM rt)"
    at = f"h.src = '{pkg}'"
    return _all(
        _branch("h.src", "h.dst", "CONTAINS_ROUTINE", f"{_e('CONTAINS_ROUTINE', 'h')} WHERE {at}", 200),
        _branch("o.src", "o.dst", "CONTAINS_STMT", f"{r} WHERE {at}", 300),
        _branch("u.src", "u.dst", "READS_FROM", f"{r} JOIN {_e('READS_FROM', 'u')} ON u.src = o.dst WHERE {at}", 200),
        _branch("o.dst", "u.dst", "READS_FROM", f"{r} JOIN top ON top.root = o.dst JOIN {_e('READS_FROM', 'u')} ON u.src = top.sub WHERE {at}", 200),
        _branch("u.src", "u.dst", "WRITES_TO", f"{r} JOIN {_e('WRITES_TO', 'u')} ON u.src = o.dst WHERE {at}", 200),
        _branch("u.src", "u.dst", "HAS_OUTPUT_COL", f"{r} JOIN {_e('HAS_OUTPUT_COL', 'u')} ON u.src = o.dst WHERE {at}", 500),
    )


_R4 = f"{_e('CONTAINS_STMT', 'o')}"
_ROUTINE = _all(
    _branch("o.src", "o.dst", "CONTAINS_STMT", f"{_R4} WHERE o.src = 'routine:4' AND o.dst IN (SELECT id FROM rt)", 300),
    _branch("u.src", "u.dst", "READS_FROM", f"{_R4} JOIN {_e('READS_FROM', 'u')} ON u.src = o.dst WHERE o.src = 'routine:4' AND o.dst IN (SELECT id FROM rt)", 500),
    _branch("u.src", "u.dst", "WRITES_TO", f"{_R4} JOIN {_e('WRITES_TO', 'u')} ON u.src = o.dst WHERE o.src = 'routine:4' AND o.dst IN (SELECT id FROM rt)", 500),
    _branch("o.dst", "u.dst", "READS_FROM", f"{_R4} JOIN top ON top.root = o.dst JOIN {_e('READS_FROM', 'u')} ON u.src = top.sub WHERE o.src = 'routine:4'", 1000),
    _branch("src", "dst", "CALLS", "e WHERE etype = 'CALLS' AND src = 'routine:4'", 50),
    _branch("src", "dst", "CALLS", "e WHERE etype = 'CALLS' AND dst = 'routine:4'", 50),
)
_OWN3 = f"(SELECT h.dst AS routine FROM {_e('CONTAINS_ROUTINE', 'h')} WHERE h.src = 'schema:3' AND h.dst IN (SELECT id FROM v WHERE vtype = 'Routine') UNION SELECT n.dst FROM {_e('CONTAINS_ROUTINE', 'h')} JOIN {_e('CONTAINS_ROUTINE', 'n')} ON n.src = h.dst WHERE h.src = 'schema:3')"
_USES = f"uses AS (SELECT DISTINCT o.src, u.dst, u.etype FROM {_e('CONTAINS_STMT', 'o')} JOIN e u ON u.src = o.dst AND u.{_RW})"
_FAR3 = "far AS (SELECT uses.* FROM uses JOIN v r ON r.id = uses.src JOIN v t ON t.id = uses.dst WHERE r.scope <> 'schema:3' AND r.vtype = 'Routine' AND t.scope = 'schema:3')"
_N5 = "'table:5'"

ORACLES = {
    "p6_upstream": WITH + f"x AS ({_BARE} (SELECT DISTINCT {_STAR} FROM e WHERE dst = 'stmt:0' AND src IN {_SHOWN}) UNION {_BARE} {_branch('u.dst', 'w.root', 'READS_FROM', _UNDER + ' w JOIN ' + _e('READS_FROM', 'u') + ' ON u.src = w.sub')} UNION SELECT * FROM {_flow_sql(_NODE)} UNION SELECT * FROM {_filter_sql(_NODE)}) SELECT * FROM x ORDER BY ALL LIMIT 2000",
    "p7_downstream": WITH + f"x AS (SELECT DISTINCT {_STAR} FROM e WHERE src = 'stmt:0' AND dst IN {_SHOWN} UNION SELECT * FROM {_branch('w.root', 'u.dst', 'WRITES_TO', _UNDER + ' w JOIN ' + _e('WRITES_TO', 'u') + ' ON u.src = w.sub')}) SELECT * FROM x ORDER BY ALL LIMIT 500",
    "p8_explore": WITH + f"x AS ({_package_sql('pkg:2')}) SELECT * FROM x",
    "p9_explore_schema": WITH + f"x AS ({_all(*_schema_sql(_S1, ln.SCHEMA_LIMITS), _branch('w.root', 'u.dst', 'READS_FROM', _FAR('READS_FROM'), 2000), _branch('w.root', 'u.dst', 'WRITES_TO', _FAR('WRITES_TO'), 1000))}), c AS (SELECT * FROM (SELECT * FROM {_flow_sql('whole')} UNION ALL SELECT * FROM {_filter_sql('(SELECT id AS sub, id AS root FROM rt)')}) WHERE src IN (SELECT dst FROM e WHERE etype = 'CONTAINS_TABLE' AND src = 'schema:1') ORDER BY src, dst, etype, source_handle, target_handle LIMIT 4000) {_BARE} x UNION ALL SELECT * FROM c",
    "p10_explore_database": WITH + f"d AS (SELECT id FROM v WHERE vtype = 'Schema' AND scope = 'db:1'), x AS ({_all(*_schema_sql('d', ln.DATABASE_LIMITS)[:-1])}) SELECT * FROM x",
    "p11_explore_package": WITH + f"x AS ({_package_sql('pkg:1')}) SELECT * FROM x",
    "p12_explore_node": WITH + "x AS (" + _all(
        f"(SELECT DISTINCT {_STAR} FROM e WHERE src = {_N5} ORDER BY ALL LIMIT 300)", f"(SELECT DISTINCT {_STAR} FROM e WHERE dst = {_N5} ORDER BY ALL LIMIT 300)",
        _branch("src", "dst", "HAS_OUTPUT_COL", f"e WHERE etype = 'HAS_OUTPUT_COL' AND (src = {_N5} OR src IN (SELECT dst FROM e WHERE etype = 'CONTAINS_STMT' AND src = {_N5}))", 200),
        *(_branch("top.root", "u.dst", t, f"{_e(t, 'u')} JOIN top ON top.sub = u.src WHERE u.dst = {_N5}", 200) for t in ("READS_FROM", "WRITES_TO"))) + ") SELECT * FROM x",
    "p13_routine_aggregate": WITH + f"{_USES}, {_FAR3}, x AS (SELECT * FROM uses WHERE src IN (SELECT routine FROM {_OWN3} ORDER BY 1 LIMIT 300) UNION ALL SELECT * FROM far WHERE src IN (SELECT DISTINCT src FROM far ORDER BY 1 LIMIT 100) UNION ALL {_branch('src', 'dst', 'CALLS', f'e WHERE {chr(101)}type = {chr(39)}CALLS{chr(39)} AND src IN {_OWN3}', 200)}) SELECT * FROM x",
    "p14_routine_scope": WITH + f"x AS ({_ROUTINE}) SELECT * FROM x",
    "p15_statement_tree": WITH + "x AS (" + _all(
        _branch("u.src", "u.dst", "CHILD_OF", f"{_UNDER} w JOIN {_e('CHILD_OF', 'u')} ON u.src = w.sub", 100), _branch("u.src", "u.dst", "READS_FROM", f"{_NODE} w JOIN {_e('READS_FROM', 'u')} ON u.src = w.sub", 200),
        _branch("u.src", "u.dst", "HAS_OUTPUT_COL", f"{_NODE} w JOIN {_e('HAS_OUTPUT_COL', 'u')} ON u.src = w.sub", 500), _branch("d.src", "d.dst", "DATA_FLOW", f"{_NODE} w JOIN {_e('HAS_OUTPUT_COL', 'u')} ON u.src = w.sub JOIN {_e('DATA_FLOW', 'd')} ON d.src = u.dst", 500)) + ") SELECT * FROM x",
    "p41_flattened": WITH + "x AS (SELECT 'stmt:0' AS id, 0 AS depth, ['stmt:0'] AS path UNION ALL SELECT e.src, x.depth + 1, list_append(x.path, e.src) FROM x JOIN e ON e.dst = x.id AND e.etype = 'CHILD_OF') SELECT id, depth, row_number() OVER (ORDER BY path) AS place FROM x",
    "s5_described": WITH + f"y AS ({_ROUTINE}), x AS (SELECT DISTINCT {_STAR} FROM y) SELECT x.src, x.dst, x.etype, coalesce(a.label, '') AS src_label, a.vtype AS src_type, coalesce(b.label, '') AS dst_label, b.vtype AS dst_type, coalesce(b.scope, '') AS dst_scope, (SELECT count(*) FROM y) >= 500 OR (SELECT count(*) FROM (SELECT src FROM x UNION SELECT dst FROM x)) >= 500 AS has_more FROM x JOIN v a ON a.id = x.src JOIN v b ON b.id = x.dst",
    "p4_roots": WITH + "x AS (SELECT 1) SELECT sub, root FROM top",
    "p39_column_flow": WITH + f"x AS (SELECT * FROM {_flow_sql('(SELECT id AS sub, id AS root FROM rt)')}) SELECT * FROM x",
    "g5_routine_uses": WITH + f"{_USES} SELECT * FROM uses WHERE src IN (SELECT id FROM v WHERE vtype = 'Routine')",
    "b15_enriched": WITH + "x AS (SELECT 1) SELECT id, vtype, CASE WHEN vtype = 'Table' AND id LIKE '%3' THEN 'ddl' END AS data_source FROM v WHERE vtype IN ('Table', 'Schema')",
    "b17_phantom_columns": WITH + "x AS (SELECT dst FROM e WHERE etype = 'HAS_COLUMN' AND src LIKE '%3') SELECT id FROM v WHERE (vtype = 'Column' AND id NOT IN (SELECT dst FROM x)) OR (vtype = 'Table' AND id NOT LIKE '%3')",
    "p28_search": WITH + "x AS (SELECT id, vtype, label, CASE vtype WHEN 'Table' THEN 1.0 WHEN 'Column' THEN 0.9 WHEN 'OutputColumn' THEN 0.9 WHEN 'Package' THEN 0.8 WHEN 'Routine' THEN 0.8 ELSE 0.7 END::DOUBLE AS score, row_number() OVER (PARTITION BY vtype ORDER BY label, id) AS n FROM v WHERE contains(label, '1') AND vtype <> 'AffectedColumn') SELECT id, vtype, label, score FROM x WHERE n <= 20 ORDER BY score DESC, vtype, label, id LIMIT 40",
    "p29_search_tenants": "SELECT n_name AS tenant, c_custkey AS id, c_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey % 2 = 0 AND contains(c_name, '1') QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY c_name, c_custkey) <= 20",
    "p30_table_detail": WITH + "x AS (SELECT dst AS id FROM e WHERE etype = 'HAS_COLUMN' AND src = 'table:7') SELECT x.id, v.label, (SELECT count(*) FROM e WHERE e.src = x.id AND etype = 'DATA_FLOW') AS n_flow, (SELECT count(*) FROM e WHERE e.src = x.id AND etype = 'FILTER_FLOW') AS n_filter FROM x JOIN v USING (id)",
    "p30_table_routines": WITH + f"x AS (SELECT coalesce(top.root, u.src) AS root, u.etype FROM e u LEFT JOIN top ON top.sub = u.src WHERE u.{_RW} AND u.dst = 'table:7') SELECT o.src AS routine, x.etype, count(*) AS n FROM x JOIN {_e('CONTAINS_STMT', 'o')} ON o.dst = x.root GROUP BY ALL ORDER BY n DESC, routine, etype LIMIT 200",
    "p30_column_statements": WITH + f"x AS (SELECT o.src AS stmt, 'output' AS how FROM {_e('DATA_FLOW', 'f')} JOIN {_e('HAS_OUTPUT_COL', 'o')} ON o.dst = f.dst WHERE f.src = 'col:7' UNION SELECT dst, 'filter' FROM e WHERE etype = 'FILTER_FLOW' AND src = 'col:7') SELECT * FROM x ORDER BY stmt, how LIMIT 200",
    "p32_statement_sources": WITH + f"x AS (SELECT dst AS tbl, 'DIRECT' AS how FROM e WHERE etype = 'READS_FROM' AND src = 'stmt:0' UNION ALL SELECT u.dst, 'SUBQUERY' FROM {_UNDER} w JOIN {_e('READS_FROM', 'u')} ON u.src = w.sub) SELECT tbl, min(how) AS how FROM x GROUP BY tbl",
    "p34_orphan_tables": WITH + "x AS (SELECT dst FROM e WHERE etype IN ('DATA_FLOW', 'READS_FROM')) SELECT id, label FROM v WHERE vtype = 'Table' AND id NOT IN (SELECT dst FROM x) ORDER BY label, id LIMIT 100",
    "p34_schema_summary": WITH + "x AS (SELECT id FROM v WHERE vtype = 'Schema' AND scope = 'db:1') SELECT scope AS schema, count(*) AS n FROM v WHERE vtype = 'Table' AND scope IN (SELECT id FROM x) GROUP BY scope ORDER BY n DESC, schema LIMIT 50",
    "p34_package_routines": WITH + f"x AS (SELECT p.label AS package, r.label, row_number() OVER (PARTITION BY p.label ORDER BY r.label) AS k FROM {_e('CONTAINS_ROUTINE', 'h')} JOIN v p ON p.id = h.src AND p.vtype = 'Package' JOIN v r ON r.id = h.dst) SELECT package, count(*) AS n, string_agg(label, ',' ORDER BY label) FILTER (k <= 5) AS names FROM x GROUP BY package ORDER BY n DESC, package LIMIT 100",
    "p35_ad_hoc": "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1",
    "g3_overview": WITH + "x AS (SELECT scope, count(*) FILTER (vtype = 'Table') AS t, count(*) FILTER (vtype = 'Routine') AS r, count(*) FILTER (vtype = 'Package') AS p FROM v GROUP BY scope) SELECT v.id AS schema, v.scope AS database, coalesce(t, 0) AS n_tables, coalesce(r, 0) AS n_routines, coalesce(p, 0) AS n_packages FROM v LEFT JOIN x ON x.scope = v.id WHERE vtype = 'Schema'",
    "g4_hierarchy": "SELECT CASE WHEN r_regionkey < 3 THEN 'app' || r_regionkey % 2 END AS app, 'db:' || r_regionkey AS database, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS schemas FROM region",
    "g10_column_counts": WITH + "x AS (SELECT id FROM v WHERE vtype = 'Table'), c AS (SELECT src AS id, count(DISTINCT dst) AS n FROM e WHERE etype = 'HAS_COLUMN' GROUP BY src), u AS (SELECT dst AS id, count(*) FILTER (etype = 'READS_FROM') AS r, count(*) FILTER (etype = 'WRITES_TO') AS w FROM e GROUP BY dst) SELECT x.id AS tbl, coalesce(n, 0) AS n_columns, coalesce(r, 0) AS n_read, coalesce(w, 0) AS n_written FROM x LEFT JOIN c USING (id) LEFT JOIN u USING (id)",
    "g11_output_atoms": WITH + "x AS (SELECT dst AS out, string_split(dst, '.')[-1]::INT AS k FROM e WHERE etype = 'HAS_OUTPUT_COL' AND src = 'stmt:5') SELECT out, coalesce((SELECT string_agg(text || ':' || status, ',' ORDER BY text || ':' || status) FROM atoms WHERE stmt = 'stmt:5' AND output_order = k), '') AS atoms FROM x",
    "g13_scope_sample": WITH + "x AS (SELECT label FROM v WHERE vtype = 'Table' AND scope = 'schema:1') SELECT label, (SELECT count(*) FROM x) AS n FROM x ORDER BY label LIMIT 10",
    "g14_statistics": WITH + "x AS (SELECT 1) SELECT vtype AS name, count(*) AS n FROM v GROUP BY vtype UNION ALL SELECT 'atoms:' || status, count(*) FROM atoms GROUP BY status",
    "g26_per_database": WITH + f"x AS (SELECT s.scope AS database, s.id AS schema, t.id AS tbl, (SELECT count(*) FROM e WHERE etype = 'HAS_COLUMN' AND src = t.id) AS c FROM v s LEFT JOIN v t ON t.scope = s.id AND t.vtype = 'Table' WHERE s.vtype = 'Schema') SELECT database, count(DISTINCT schema) AS n_schemas, count(tbl) AS n_tables, coalesce(sum(c), 0)::BIGINT AS n_columns FROM x GROUP BY database",
    "g28_pipeline_sums": "SELECT o_orderpriority, count(*) AS statements, sum(o_custkey)::BIGINT AS parse, sum(CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE 0 END)::BIGINT AS walk FROM orders GROUP BY 1",
    "g31_alias_leaks": WITH + "x AS (SELECT 1) SELECT status, count(*) FILTER (text LIKE 'SOURCE.%') AS n_source, count(*) FILTER (text LIKE 'TARGET.%') AS n_target FROM atoms GROUP BY status",
    "g32_without_output": WITH + "x AS (SELECT 1) SELECT stmt, count(*) AS n FROM atoms WHERE status = 'resolved' AND context = 'SELECT' AND output_order IS NULL GROUP BY stmt",
    "g33_outputs_per_statement": WITH + "x AS (SELECT src AS stmt, count(*) AS n FROM e WHERE etype = 'HAS_OUTPUT_COL' GROUP BY src) SELECT * FROM x ORDER BY n DESC, stmt LIMIT 20",
    "g34_nested_routines": WITH + "x AS (SELECT 1) SELECT src AS package, dst AS routine FROM e WHERE etype = 'CONTAINS_ROUTINE' AND src LIKE 'pkg:%' AND dst LIKE 'routine:%'",
    "g35_tables_without_columns": WITH + "x AS (SELECT src FROM e WHERE etype = 'HAS_COLUMN') SELECT id FROM v WHERE vtype = 'Table' AND id NOT IN (SELECT src FROM x)",
    "g35_widest_tables": WITH + "x AS (SELECT src AS tbl, count(DISTINCT dst) AS n_columns FROM e WHERE etype = 'HAS_COLUMN' GROUP BY src) SELECT * FROM x ORDER BY n_columns DESC, tbl LIMIT 10",
    "g38_nesting": WITH + "x AS (SELECT id, id NOT IN (SELECT sub FROM top) AS is_root, (SELECT count(*) FROM e WHERE etype = 'CHILD_OF' AND dst = v.id) AS k FROM v WHERE vtype = 'Statement') SELECT is_root, count(*) AS n, sum(k)::BIGINT AS n_children FROM x GROUP BY is_root",
    "g39_joins": "SELECT l_returnflag AS join_type, count(*) AS n, count(*) FILTER (l_quantity <= 5) AS no_source, count(*) FILTER (l_tax <= 0.02) AS no_target FROM lineitem GROUP BY 1",
    "g40_filter_candidates": WITH + "x AS (SELECT DISTINCT stmt, col FROM atoms WHERE status = 'resolved' AND context = 'WHERE') SELECT stmt, col FROM x WHERE NOT EXISTS (SELECT 1 FROM e WHERE etype = 'FILTER_FLOW' AND src = col AND dst = stmt)",
    "g43_call_pairs": WITH + "x AS (SELECT a.label AS src_label, b.label AS dst_label FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE etype = 'CALLS') SELECT * FROM x ORDER BY ALL LIMIT 30",
    "g45_complex_statements": WITH + "x AS (SELECT stmt, count(*) AS n, count(*) FILTER (status = 'resolved') AS n_resolved FROM atoms GROUP BY stmt) SELECT * FROM x ORDER BY n DESC, stmt LIMIT 15",
    "g45_used_columns": WITH + "x AS (SELECT src AS col, count(*) AS n FROM e WHERE etype IN ('DATA_FLOW', 'FILTER_FLOW') AND src LIKE 'col:%' GROUP BY src) SELECT * FROM x ORDER BY n DESC, col LIMIT 15",
    "g46_empty_packages": WITH + "x AS (SELECT src FROM e WHERE etype = 'CONTAINS_ROUTINE') SELECT id FROM v WHERE vtype = 'Package' AND id NOT IN (SELECT src FROM x)",
    "g46_never_read_columns": WITH + "x AS (SELECT src FROM e WHERE etype IN ('DATA_FLOW', 'FILTER_FLOW')) SELECT src AS tbl, count(*) AS n FROM e WHERE etype = 'HAS_COLUMN' AND dst NOT IN (SELECT src FROM x) GROUP BY src",
    "g49_unresolved": WITH + "x AS (SELECT text, context, count(*) AS n FROM atoms WHERE status = 'unresolved' GROUP BY ALL) SELECT * FROM x ORDER BY n DESC, text, context LIMIT 20",
    "g17_statement_quality": WITH + "x AS (SELECT stmt, count(*) AS total, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'constant') AS constant, count(*) FILTER (status = 'unresolved') AS unresolved FROM atoms GROUP BY stmt) SELECT *, (resolved + constant)::DOUBLE / total AS quality FROM x",
    "j13_atom_references": WITH + "x AS (SELECT dst, min(src) AS routine FROM e WHERE etype = 'CONTAINS_STMT' GROUP BY dst) SELECT stmt, text, coalesce(t.label, '') AS table_label, coalesce(c.label, '') AS column_label, coalesce(routine, '') AS routine FROM atoms LEFT JOIN v t ON t.id = tbl LEFT JOIN v c ON c.id = col LEFT JOIN x ON x.dst = stmt",
    "p40_buckets": "SELECT n_name, (row_number() OVER (ORDER BY n_name) - 1) // 4 AS bucket FROM nation",
}
