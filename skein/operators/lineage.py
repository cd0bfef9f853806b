"""Lineage neighbourhoods and explore views over a metadata graph.

vertices: id, vtype, label, scope (schema of tables and routines), parent (of statements). edges: src, dst, etype. Types are
Application, Database, Schema, Package, Routine, Table, Column, Statement, OutputColumn, AffectedColumn. Every view is a
union of branches, each a chain of joins that is ordered and limited by itself: src, dst, etype, and where columns are told,
source_handle and target_handle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.explore import last_segment
from skein.operators.graph import reach
from skein.session import saved

HIDDEN = ("Constraint", "PrimaryKey", "ForeignKey", "Atom")  # types that no view shows
USES = ("READS_FROM", "WRITES_TO")


@dataclass
class Graph:
    """A graph; ``tops`` are the roots (sub, root) of its nested statements once something asked for them."""

    vertices: DataFrame
    edges: DataFrame
    tops: DataFrame | None = None

    def of(self, *etypes: str) -> DataFrame:
        """Edges of types."""
        return self.edges.filter(F.col("etype").isin(*etypes))

    def link(self, etype: str, src: str, dst: str) -> DataFrame:
        """Edges of one type under names of the caller's."""
        return self.of(etype).select(F.col("src").alias(src), F.col("dst").alias(dst))

    def typed(self, name: str, *vtypes: str) -> DataFrame:
        return self.vertices.filter(F.col("vtype").isin(*vtypes)).select(F.col("id").alias(name))

    def roots(self, name: str) -> DataFrame:
        """Statements without a parent."""
        return self.vertices.filter((F.col("vtype") == "Statement") & (F.coalesce("parent", F.lit("")) == "")).select(F.col("id").alias(name))


def edges_of(df: DataFrame, src: str, dst: str, etype: str, limit: int | None = None) -> DataFrame:
    """A branch: distinct edges, the first ``limit`` of them."""
    out = df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(etype).alias("etype")).distinct()
    return out if limit is None else out.orderBy("src", "dst").limit(limit)


def union(branches: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, branches)


def root_of(graph: Graph) -> DataFrame:
    """The root above each statement that has one: sub, root. Written by the first who asks."""
    if graph.tops is None:
        graph.tops = saved(climbed(graph), "roots")
    return graph.tops


def climbed(graph: Graph, max_depth: int = 30) -> DataFrame:
    """The root above each statement that has one, by CHILD_OF: sub, root. A chain in a circle or longer than max_depth has none.

    Each round doubles what a statement has climbed, so chains of 30 take five.
    """
    up = saved(graph.link("CHILD_OF", "sub", "root").filter("sub is not null and root is not null").groupBy("sub").agg(F.min("root").alias("root")).withColumn("depth", F.lit(1)), "up")
    climbed = 1
    while climbed < max_depth:
        above = up.select(F.col("sub").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        met = up.join(above, "root", "left")
        fresh = saved(met.select("sub", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "up", instead_of=up)
        up, climbed = fresh, climbed * 2
        if fresh.filter("moved").isEmpty():
            break
    return up.filter(F.col("depth") <= max_depth).join(graph.roots("root"), "root", "left_semi").select("sub", "root")


def shown(graph: Graph, name: str) -> DataFrame:
    """Ids that views show: statements only as roots, no constraints, keys or atoms."""
    root = (F.col("vtype") != "Statement") | (F.coalesce("parent", F.lit("")) == "")
    return graph.vertices.filter(root & ~F.col("vtype").isin(*HIDDEN)).select(F.col("id").alias(name))


def column_paths(graph: Graph, within: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Columns that flow into output columns of statements, given to the roots of (sub, root) pairs ``within``: tbl, col, root, segment.

    ``columns`` (tbl, col) are those to begin with, else all. Where they are few and stored, other flow is left out as it is read.
    """
    held, flow = graph.link("HAS_COLUMN", "tbl", "col"), graph.link("DATA_FLOW", "col", "out")
    if columns is not None:
        held, flow = columns, flow.join(columns.select("col"), "col", "left_semi")
    met = flow.join(held, "col").join(graph.link("HAS_OUTPUT_COL", "sub", "out"), "out").join(within, "sub")
    return met.join(graph.vertices.select(F.col("id").alias("out"), last_segment(F.col("label")).alias("segment")), "out").select("tbl", "col", "root", "segment")


def root_columns(graph: Graph, roots: DataFrame, few: bool = False) -> DataFrame:
    """Affected and output columns of roots (root) with the last segments of their names: root, etype, own, segment.

    Those of a ``few`` roots are written, so that only their names are looked up.
    """
    ends = graph.of("HAS_AFFECTED_COL", "HAS_OUTPUT_COL").select(F.col("src").alias("root"), "etype", F.col("dst").alias("own")).join(roots, "root", "left_semi")
    named = graph.vertices
    if few:
        ends = saved(ends, "ends")
        named = named.join(ends.select(F.col("own").alias("id")), "id", "left_semi")
    return ends.join(named.select(F.col("id").alias("own"), last_segment(F.col("label")).alias("segment")), "own")


def into_columns(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """DATA_FLOW of column paths into their roots' columns (``root_columns``).

    The target handle is the root's affected column, else its output column, whose last name segment is that of the output
    column reached, without regard to case; empty where there is none.
    """
    at_root = lambda etype, name: ends.filter(F.col("etype") == etype).select("root", "segment", F.col("own").alias(name))
    met = paths.join(at_root("HAS_AFFECTED_COL", "aff"), ["root", "segment"], "left").join(at_root("HAS_OUTPUT_COL", "own"), ["root", "segment"], "left")
    target = F.coalesce(F.concat(F.lit("tgt-"), F.coalesce("aff", "own")), F.lit(""))
    return met.select(F.col("tbl").alias("src"), F.col("root").alias("dst"), F.lit("DATA_FLOW").alias("etype"), F.concat(F.lit("src-"), "col").alias("source_handle"), target.alias("target_handle")).distinct()


def column_flow(graph: Graph, within: DataFrame) -> DataFrame:
    """DATA_FLOW from tables to root statements by column, of (sub, root) pairs ``within``."""
    return into_columns(column_paths(graph, within), root_columns(graph, within.select("root").distinct()))


def filter_flow(graph: Graph, within: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """FILTER_FLOW from tables to root statements by column, of (sub, root) pairs ``within``; such edges land on the statement.

    ``columns`` (tbl, col) are those to begin with, else all.
    """
    held, flow = graph.link("HAS_COLUMN", "tbl", "col"), graph.link("FILTER_FLOW", "col", "sub")
    if columns is not None:
        held, flow = columns, flow.join(columns.select("col"), "col", "left_semi")
    met = within.join(flow, "sub").join(held, "col")
    return met.select(F.col("tbl").alias("src"), F.col("root").alias("dst"), F.lit("FILTER_FLOW").alias("etype"), F.concat(F.lit("src-"), "col").alias("source_handle"), F.lit("").alias("target_handle")).distinct()


def first_flow(graph: Graph, whole: DataFrame, roots: DataFrame, tables: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of column flow from tables (tbl) into roots of ``whole`` and filter flow into ``roots`` (sub, root).

    Each table, root and source handle has at least one row, so the first ``limit`` of these hold the first rows; target handles
    are looked up for them alone.
    """
    keys = ("src", "dst", "etype", "source_handle")
    columns = saved(graph.link("HAS_COLUMN", "tbl", "col").join(tables.select("tbl"), "tbl", "left_semi").distinct(), "columns")
    paths = saved(column_paths(graph, whole, columns).withColumn("source_handle", F.concat(F.lit("src-"), "col")), "paths")
    flow = paths.select(F.col("tbl").alias("src"), F.col("root").alias("dst"), F.lit("DATA_FLOW").alias("etype"), "source_handle")
    first = saved(flow.unionByName(filter_flow(graph, roots, columns).select(*keys)).distinct().orderBy(*keys).limit(limit), "first")
    wanted = first.filter("etype = 'DATA_FLOW'").select(F.col("src").alias("tbl"), F.col("dst").alias("root"), "source_handle")
    met = saved(paths.join(wanted, ["tbl", "root", "source_handle"], "left_semi").distinct(), "paths", instead_of=paths)
    flow = into_columns(met, root_columns(graph, met.select("root").distinct(), few=True))
    filtered = first.filter("etype = 'FILTER_FLOW'").withColumn("target_handle", F.lit(""))
    return flow.unionByName(filtered).orderBy(*keys, "target_handle").limit(limit)


def no_handles(df: DataFrame) -> DataFrame:
    return df.withColumns({"source_handle": F.lit(""), "target_handle": F.lit("")})


def below(graph: Graph, node: str) -> tuple[DataFrame, DataFrame]:
    """(sub, root) of the descendants of a root statement, without and with itself; none where the node is no root."""
    own = graph.roots("id").filter(F.col("id") == node)
    under = reach(graph.of("CHILD_OF"), own, 30, reverse=True).select(F.col("id").alias("sub"), F.lit(node).alias("root"))
    return under, under.unionByName(own.select(F.col("id").alias("sub"), F.col("id").alias("root")))


def upstream(graph: Graph, node: str, limit: int = 2000) -> DataFrame:
    """What flows into a node: its in-edges, tables read anywhere below it, and column and filter flow into it."""
    under, whole = below(graph, node)
    into = graph.edges.filter(F.col("dst") == node).join(shown(graph, "src"), "src", "left_semi").select("src", "dst", "etype").distinct()
    read = edges_of(under.join(graph.link("READS_FROM", "sub", "tbl"), "sub"), "tbl", "root", "READS_FROM")
    every = union([no_handles(into), no_handles(read), column_flow(graph, whole), filter_flow(graph, whole)]).distinct()
    return every.orderBy("src", "dst", "etype", "source_handle", "target_handle").limit(limit)


def downstream(graph: Graph, node: str, limit: int = 500) -> DataFrame:
    """What a node feeds: its out-edges, and tables written anywhere below it."""
    under, _ = below(graph, node)
    out = graph.edges.filter(F.col("src") == node).join(shown(graph, "dst"), "dst", "left_semi").select("src", "dst", "etype").distinct()
    written = edges_of(under.join(graph.link("WRITES_TO", "sub", "tbl"), "sub"), "root", "tbl", "WRITES_TO")
    return union([out, written]).distinct().orderBy("src", "dst", "etype").limit(limit)


def _schema_branches(graph: Graph, schemas: DataFrame, limits: dict[str, int]) -> list[DataFrame]:
    """The ten branches of a schema view; ``schemas`` has the column schema."""
    roots, top = graph.roots("stmt"), root_of(graph)
    tables = saved(schemas.join(graph.link("CONTAINS_TABLE", "schema", "tbl"), "schema"), "tables")
    held = schemas.join(graph.link("CONTAINS_ROUTINE", "schema", "child"), "schema")
    direct = held.join(graph.typed("child", "Routine"), "child", "left_semi").withColumnRenamed("child", "routine")
    nested = held.join(graph.typed("child", "Package"), "child", "left_semi").withColumnRenamed("child", "pkg").join(graph.link("CONTAINS_ROUTINE", "pkg", "routine"), "pkg")
    owns = graph.link("CONTAINS_STMT", "routine", "stmt").join(roots, "stmt", "left_semi")
    used = saved(graph.of(*USES).join(tables.select(F.col("tbl").alias("dst")), "dst", "left_semi").select("src", "dst", "etype"), "uses")
    uses = lambda etype, name: used.filter(F.col("etype") == etype).select(F.col("src").alias(name), F.col("dst").alias("tbl"))
    of_root = lambda etype: uses(etype, "stmt").join(roots, "stmt", "left_semi")
    hoisted = lambda etype: uses(etype, "sub").join(top, "sub")
    beyond = of_root("READS_FROM").select("stmt").distinct().join(graph.link("WRITES_TO", "stmt", "target"), "stmt")
    return [
        edges_of(tables, "schema", "tbl", "CONTAINS_TABLE", limits["tables"]),
        edges_of(held.join(graph.typed("child", "Package", "Routine"), "child", "left_semi"), "schema", "child", "CONTAINS_ROUTINE", limits["routines"]),
        edges_of(direct.join(owns, "routine"), "routine", "stmt", "CONTAINS_STMT", limits["statements"]),
        edges_of(nested, "pkg", "routine", "CONTAINS_ROUTINE", limits["routines"]),
        edges_of(nested.join(owns, "routine"), "routine", "stmt", "CONTAINS_STMT", limits["statements"]),
        edges_of(of_root("WRITES_TO"), "stmt", "tbl", "WRITES_TO", limits["uses"]),
        edges_of(of_root("READS_FROM"), "stmt", "tbl", "READS_FROM", limits["uses"]),
        edges_of(hoisted("READS_FROM"), "root", "tbl", "READS_FROM", limits["hoisted"]),
        edges_of(hoisted("WRITES_TO"), "root", "tbl", "WRITES_TO", limits["hoisted"]),
        edges_of(beyond, "stmt", "target", "WRITES_TO", limits["hoisted"]),
    ]


def _external_branches(graph: Graph, schemas: DataFrame) -> list[DataFrame]:
    """Tables of other schemas that root statements of the schema's routines, direct or in packages, read and write."""
    held = schemas.join(graph.link("CONTAINS_ROUTINE", "schema", "child"), "schema")
    routines = held.join(graph.typed("child", "Routine"), "child", "left_semi").select("schema", F.col("child").alias("routine"))
    nested = held.join(graph.link("CONTAINS_ROUTINE", "child", "routine"), "child").select("schema", "routine")
    stmts = routines.unionByName(nested).distinct().join(graph.link("CONTAINS_STMT", "routine", "root"), "routine").join(graph.roots("root"), "root", "left_semi")
    whole = stmts.select("schema", "root", F.col("root").alias("sub")).unionByName(stmts.join(root_of(graph), "root").select("schema", "root", "sub"))
    scoped = graph.vertices.filter(F.col("scope").isNotNull()).select(F.col("id").alias("tbl"), "scope")
    far = lambda etype: whole.join(graph.link(etype, "sub", "tbl"), "sub").join(scoped, "tbl").filter(F.col("scope") != F.col("schema"))
    return [edges_of(far("READS_FROM"), "root", "tbl", "READS_FROM", 2000), edges_of(far("WRITES_TO"), "root", "tbl", "WRITES_TO", 1000)]


SCHEMA_LIMITS = {"tables": 300, "routines": 200, "statements": 300, "uses": 3000, "hoisted": 200}
DATABASE_LIMITS = {"tables": 500, "routines": 300, "statements": 500, "uses": 3000, "hoisted": 500}


def explore_schema(graph: Graph, schema: str, external: bool = False, column_limit: int = 4000) -> DataFrame:
    """A schema's tables, routines and statements, what these use, and its columns' flow into root statements.

    Branches keep their rows apart, so an edge may come from several.
    """
    one = graph.vertices.filter((F.col("vtype") == "Schema") & (F.col("id") == schema)).select(F.col("id").alias("schema"))
    branches = _schema_branches(graph, one, SCHEMA_LIMITS) + (_external_branches(graph, one) if external else [])
    roots = graph.roots("root")
    whole = roots.select(F.col("root").alias("sub"), "root")
    tables = one.join(graph.link("CONTAINS_TABLE", "schema", "tbl"), "schema")
    flow = first_flow(graph, whole.unionByName(root_of(graph)), whole, tables, column_limit)
    return union([*map(no_handles, branches), flow.select("src", "dst", "etype", "source_handle", "target_handle")])


def explore_database(graph: Graph, database: str) -> DataFrame:
    """The same branches but the last over all schemas of a database, without column flow."""
    schemas = graph.vertices.filter((F.col("vtype") == "Schema") & (F.col("scope") == database)).select(F.col("id").alias("schema"))
    return union(_schema_branches(graph, schemas, DATABASE_LIMITS)[:-1])


def explore_package(graph: Graph, package: str) -> DataFrame:
    """A package's routines and root statements, what these write, read (also below them), and their output columns."""
    routines = graph.link("CONTAINS_ROUTINE", "pkg", "routine").filter(F.col("pkg") == package)
    stmts = saved(routines.join(graph.link("CONTAINS_STMT", "routine", "stmt"), "routine").join(graph.roots("stmt"), "stmt", "left_semi"), "statements")
    under = stmts.select("stmt").distinct().join(root_of(graph).withColumnRenamed("root", "stmt"), "stmt")
    return union([
        edges_of(routines, "pkg", "routine", "CONTAINS_ROUTINE", 200),
        edges_of(stmts, "routine", "stmt", "CONTAINS_STMT", 300),
        edges_of(stmts.join(graph.link("READS_FROM", "stmt", "tbl"), "stmt"), "stmt", "tbl", "READS_FROM", 200),
        edges_of(under.join(graph.link("READS_FROM", "sub", "tbl"), "sub"), "stmt", "tbl", "READS_FROM", 200),
        edges_of(stmts.join(graph.link("WRITES_TO", "stmt", "tbl"), "stmt"), "stmt", "tbl", "WRITES_TO", 200),
        edges_of(stmts.join(graph.link("HAS_OUTPUT_COL", "stmt", "out"), "stmt"), "stmt", "out", "HAS_OUTPUT_COL", 500),
    ])


def explore_node(graph: Graph, node: str) -> DataFrame:
    """Everything next to one node of any type, in eight branches: edges out and in, output columns of its statements and its
    own, its siblings as a column or output column, and roots of statements that read or write it."""
    near = lambda own, limit: graph.edges.filter(F.col(own) == node).select("src", "dst", "etype").distinct().orderBy("src", "dst", "etype").limit(limit)
    outputs, mine = graph.link("HAS_OUTPUT_COL", "stmt", "out"), F.lit(node)
    siblings = lambda etype: edges_of(graph.link(etype, "up", "down").join(graph.link(etype, "up", "own").filter(F.col("own") == node).select("up"), "up", "left_semi"), "up", "down", etype, 100)
    hoisted = lambda etype: edges_of(graph.link(etype, "sub", "tbl").filter(F.col("tbl") == mine).join(top, "sub"), "root", "tbl", etype, 200)
    top = root_of(graph)
    return union([
        near("src", 300), near("dst", 300),
        edges_of(graph.link("CONTAINS_STMT", "own", "stmt").filter(F.col("own") == node).join(outputs, "stmt"), "stmt", "out", "HAS_OUTPUT_COL", 200),
        edges_of(outputs.filter(F.col("stmt") == node), "stmt", "out", "HAS_OUTPUT_COL", 100),
        siblings("HAS_COLUMN"), siblings("HAS_OUTPUT_COL"), hoisted("READS_FROM"), hoisted("WRITES_TO"),
    ])


def parse_scope(scope: str) -> tuple[str, str, str]:
    """(kind, name, database) of ``kind-name|database``; a scope without a dash is the id of a node."""
    kind, dash, rest = scope.partition("-")
    if not dash:
        return "node", scope, ""
    name, _, database = rest.partition("|")
    return kind, name, database


def explore(graph: Graph, scope: str, external: bool = False) -> DataFrame:
    """The view of a scope: schema, pkg, db, routine, else of one node."""
    kind, name, _ = parse_scope(scope)
    views = {"schema": lambda: explore_schema(graph, name, external), "pkg": lambda: explore_package(graph, name), "db": lambda: explore_database(graph, name), "routine": lambda: routine_scope(graph, name)}
    return views.get(kind, lambda: explore_node(graph, name if kind == "node" else scope))()


def routine_uses(graph: Graph, routines: DataFrame) -> DataFrame:
    """Distinct tables that each routine's statements read and write, as edges of the routine: src, dst, etype."""
    met = routines.select("routine").distinct().join(graph.link("CONTAINS_STMT", "routine", "stmt"), "routine").join(graph.of(*USES).select(F.col("src").alias("stmt"), "dst", "etype"), "stmt")
    return met.select(F.col("routine").alias("src"), "dst", "etype").distinct()


def routines_in(graph: Graph, schema: str) -> DataFrame:
    """Routines a schema holds, direct or in packages: routine."""
    held = graph.link("CONTAINS_ROUTINE", "schema", "child").filter(F.col("schema") == schema).select("child")
    direct = held.join(graph.typed("child", "Routine"), "child", "left_semi").withColumnRenamed("child", "routine")
    return direct.unionByName(held.join(graph.link("CONTAINS_ROUTINE", "child", "routine"), "child").select("routine")).distinct()


def routine_aggregate(graph: Graph, schema: str, limit: int = 300, external_limit: int = 100, call_limit: int = 200) -> DataFrame:
    """Routine level of a schema: what its routines read, write and call, and routines of other schemas that use its tables."""
    own = saved(routines_in(graph, schema), "routines")
    uses = routine_uses(graph, own.orderBy("routine").limit(limit))
    scoped = graph.vertices.select("id", "scope")
    outside = scoped.filter(F.col("scope") != schema).join(graph.typed("id", "Routine"), "id", "left_semi").select(F.col("id").alias("routine"))
    inside = scoped.filter(F.col("scope") == schema).select(F.col("id").alias("dst"))
    far = saved(routine_uses(graph, outside).join(inside, "dst", "left_semi").select("src", "dst", "etype"), "external")
    first = far.select("src").distinct().orderBy("src").limit(external_limit)
    calls = edges_of(own.join(graph.link("CALLS", "routine", "called"), "routine"), "routine", "called", "CALLS", call_limit)
    return union([uses, far.join(first, "src", "left_semi").select("src", "dst", "etype"), calls])


def routine_scope(graph: Graph, routine: str) -> DataFrame:
    """A routine's root statements, tables they read and write, tables read below them, calls from it and to it."""
    stmts = saved(graph.link("CONTAINS_STMT", "routine", "stmt").filter(F.col("routine") == routine).join(graph.roots("stmt"), "stmt", "left_semi"), "statements")
    under = stmts.select("stmt").join(root_of(graph).withColumnRenamed("root", "stmt"), "stmt")
    use = lambda etype, limit: edges_of(stmts.join(graph.link(etype, "stmt", "tbl"), "stmt"), "stmt", "tbl", etype, limit)
    calls = graph.link("CALLS", "caller", "called")
    return union([
        edges_of(stmts, "routine", "stmt", "CONTAINS_STMT", 300), use("READS_FROM", 500), use("WRITES_TO", 500),
        edges_of(under.join(graph.link("READS_FROM", "sub", "tbl"), "sub"), "stmt", "tbl", "READS_FROM", 1000),
        edges_of(calls.filter(F.col("caller") == routine), "caller", "called", "CALLS", 50),
        edges_of(calls.filter(F.col("called") == routine), "caller", "called", "CALLS", 50),
    ])


def statement_tree(graph: Graph, node: str) -> DataFrame:
    """A root statement's descendants, tables read by the whole tree, its output columns, and where these flow."""
    under, whole = below(graph, node)
    outputs = whole.join(graph.link("HAS_OUTPUT_COL", "sub", "out"), "sub")
    return union([
        edges_of(under.join(graph.link("CHILD_OF", "sub", "up"), "sub"), "sub", "up", "CHILD_OF", 100),
        edges_of(whole.join(graph.link("READS_FROM", "sub", "tbl"), "sub"), "sub", "tbl", "READS_FROM", 200),
        edges_of(outputs, "sub", "out", "HAS_OUTPUT_COL", 500),
        edges_of(outputs.join(graph.link("DATA_FLOW", "out", "target"), "out"), "out", "target", "DATA_FLOW", 500),
    ])


def flattened(graph: Graph, node: str, max_depth: int = 30) -> DataFrame:
    """A statement tree depth first: id, depth, place (from 1). Children are ordered by id below their parent."""
    links = graph.link("CHILD_OF", "id", "parent")
    frontier = seen = graph.vertices.filter(F.col("id") == node).select("id", F.array("id").alias("path"))
    for _ in range(max_depth):
        down = links.join(frontier.select(F.col("id").alias("parent"), "path"), "parent").filter(~F.array_contains("path", F.col("id")))
        frontier = saved(down.select("id", F.concat("path", F.array("id")).alias("path")), "tree")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    place = F.row_number().over(Window.orderBy("path"))  # one tree of the view, not the graph
    return seen.select("id", (F.size("path") - 1).alias("depth"), place.alias("place"))


def described(graph: Graph, edges: DataFrame, limit: int = 500) -> DataFrame:
    """A merged result: distinct edges with labels, types and the target's scope, and whether nodes or rows reach ``limit``."""
    of = lambda name: graph.vertices.select(F.col("id").alias(name), F.coalesce("label", F.lit("")).alias(f"{name}_label"), F.col("vtype").alias(f"{name}_type"))
    scope = graph.vertices.select(F.col("id").alias("dst"), F.coalesce("scope", F.lit("")).alias("dst_scope"))
    one = saved(edges.select("src", "dst", "etype").distinct(), "edges")
    nodes = one.select("src").union(one.select("dst")).distinct().count()
    more = nodes >= limit or edges.count() >= limit
    return one.join(of("src"), "src").join(of("dst"), "dst").join(scope, "dst").withColumn("has_more", F.lit(more))


def enriched(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``data_source`` to table nodes (id, vtype) from sources (id, data_source); blanks are none."""
    known = sources.filter(F.trim(F.coalesce("data_source", F.lit(""))) != "").groupBy("id").agg(F.min("data_source").alias("data_source"))
    return nodes.join(known, "id", "left").withColumn("data_source", F.when(F.col("vtype") == "Table", F.col("data_source")))


def phantom_columns(columns: DataFrame, graph: Graph) -> DataFrame:
    """Columns (id, data_source) that were reconstructed and that no table of source ``ddl`` (vertices' label by ``columns``) holds."""
    ddl = columns.filter(F.col("data_source") == "ddl").select(F.col("id").alias("src"))
    held = graph.of("HAS_COLUMN").join(ddl, "src", "left_semi").select(F.col("dst").alias("id"))
    return columns.filter(F.col("data_source") == "reconstructed").join(held, "id", "left_anti").select("id")


def optional(column: Column, value: str | None) -> Column:
    """``column = value``, or anything where no value is given."""
    return F.lit(True) if not value else column == value
