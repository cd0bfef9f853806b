"""Inventories of a metadata graph: overviews, hierarchies, statistics and quality reports by type, scope and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.lineage import Graph, root_of
from skein.session import saved

_N = F.count


def _n(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def _of(test: Column, name: str) -> Column:
    return F.count(F.when(test, 1)).alias(name)


def overview(graph: Graph) -> DataFrame:
    """Tables, routines and packages of each schema and its database: schema, database, n_tables, n_routines, n_packages."""
    of = lambda t: F.col("vtype") == t
    counted = graph.vertices.filter(F.col("vtype").isin("Table", "Routine", "Package")).groupBy(F.col("scope").alias("schema")).agg(_of(of("Table"), "n_tables"), _of(of("Routine"), "n_routines"), _of(of("Package"), "n_packages"))
    schemas = graph.vertices.filter(of("Schema")).select(F.col("id").alias("schema"), F.col("scope").alias("database"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return schemas.join(counted, "schema", "left").select("schema", "database", *map(zero, ("n_tables", "n_routines", "n_packages")))


def hierarchy(graph: Graph, applications: DataFrame) -> DataFrame:
    """Applications (database, app) with their databases and the schemas of these; databases without one come under null.

    One row per database: app, database, schemas (names in order, comma-joined). Schemas without a database are left out.
    """
    databases = graph.vertices.filter(F.col("vtype") == "Database").select(F.col("id").alias("database"))
    schemas = graph.vertices.filter("vtype = 'Schema' and scope is not null").groupBy(F.col("scope").alias("database")).agg(F.concat_ws(",", F.sort_array(F.collect_set("label"))).alias("schemas"))
    return databases.join(applications, "database", "left").join(schemas, "database", "left").select("app", "database", "schemas")


def column_counts(graph: Graph) -> DataFrame:
    """Distinct columns of each table, and its edges in by use: tbl, n_columns, n_read, n_written."""
    held = graph.link("HAS_COLUMN", "tbl", "col").distinct().groupBy("tbl").agg(_n("n_columns"))
    used = graph.of("READS_FROM", "WRITES_TO").groupBy(F.col("dst").alias("tbl")).agg(_of(F.col("etype") == "READS_FROM", "n_read"), _of(F.col("etype") == "WRITES_TO", "n_written"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return graph.typed("tbl", "Table").join(held, "tbl", "left").join(used, "tbl", "left").select("tbl", *map(zero, ("n_columns", "n_read", "n_written")))


def widest_tables(graph: Graph, limit: int = 10) -> DataFrame:
    return column_counts(graph).select("tbl", "n_columns").orderBy(F.desc("n_columns"), "tbl").limit(limit)


def scope_sample(graph: Graph, schema: str, sample: int = 10) -> DataFrame:
    """First names of a schema's tables, with the count of all: label, n."""
    tables = graph.vertices.filter((F.col("vtype") == "Table") & (F.col("scope") == schema))
    total = tables.agg(_n())  # one row
    return tables.select("label").orderBy("label").limit(sample).join(F.broadcast(total))


def statistics(graph: Graph, atoms: DataFrame) -> DataFrame:
    """One row a name: vertices by type, and atoms by status: name, n."""
    return graph.vertices.groupBy(F.col("vtype").alias("name")).agg(_n()).unionByName(atoms.groupBy(F.concat(F.lit("atoms:"), "status").alias("name")).agg(_n()))


def per_database(graph: Graph) -> DataFrame:
    """Schemas, tables and columns of each database, by tables in descending order: database, n_schemas, n_tables, n_columns."""
    schemas = graph.vertices.filter("vtype = 'Schema'").select(F.col("scope").alias("database"), F.col("id").alias("schema"))
    tables = graph.vertices.filter("vtype = 'Table'").select(F.col("scope").alias("schema"), F.col("id").alias("tbl"))
    columns = graph.link("HAS_COLUMN", "tbl", "col").groupBy("tbl").agg(_n("c"))
    per = schemas.join(tables.join(columns, "tbl", "left").groupBy("schema").agg(_n("t"), F.sum(F.coalesce("c", F.lit(0))).alias("c")), "schema", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.groupBy("database").agg(_n("n_schemas"), zero("t").alias("n_tables"), zero("c").alias("n_columns")).orderBy(F.desc("n_tables"), "database")


def sums_by(df: DataFrame, key: str, **columns: Column) -> DataFrame:
    """Sums of several measures of each key, 0 for nulls."""
    return df.groupBy(key).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(name) for name, c in columns.items()))


def alias_leaks(atoms: DataFrame) -> DataFrame:
    """Atoms whose text starts with a merge alias instead of a table, by status: status, n_source, n_target."""
    text = F.upper("text")
    return atoms.groupBy("status").agg(_of(text.like("SOURCE.%"), "n_source"), _of(text.like("TARGET.%"), "n_target"))


def without_output(atoms: DataFrame) -> DataFrame:
    """Resolved atoms of select lists that name no output column, per statement: stmt, n."""
    lost = atoms.filter("status = 'resolved' and context = 'SELECT' and output_order is null")
    return lost.groupBy("stmt").agg(_n())


def outputs_per_statement(graph: Graph, limit: int = 20) -> DataFrame:
    return graph.of("HAS_OUTPUT_COL").groupBy(F.col("src").alias("stmt")).agg(_n()).orderBy(F.desc("n"), "stmt").limit(limit)


def nested_routines(graph: Graph) -> DataFrame:
    """Routines that packages hold: package, routine."""
    return graph.link("CONTAINS_ROUTINE", "package", "routine").join(graph.typed("package", "Package"), "package", "left_semi").join(graph.typed("routine", "Routine"), "routine", "left_semi").select("package", "routine")


def empty_packages(graph: Graph) -> DataFrame:
    return graph.typed("id", "Package").join(graph.link("CONTAINS_ROUTINE", "id", "routine"), "id", "left_anti")


def never_read_columns(graph: Graph) -> DataFrame:
    """Columns that flow nowhere, by their table: tbl, n."""
    used = graph.of("DATA_FLOW", "FILTER_FLOW").select(F.col("src").alias("col"))
    return graph.link("HAS_COLUMN", "tbl", "col").join(used, "col", "left_anti").groupBy("tbl").agg(_n())


def tables_without_columns(graph: Graph) -> DataFrame:
    return graph.typed("id", "Table").join(graph.link("HAS_COLUMN", "id", "col"), "id", "left_anti")


def join_report(joins: DataFrame) -> DataFrame:
    """Joins (join_type, source, target) by type: join_type, n, no_source, no_target."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return joins.groupBy("join_type").agg(_n(), _of(blank("source"), "no_source"), _of(blank("target"), "no_target"))


def filter_candidates(graph: Graph, atoms: DataFrame) -> DataFrame:
    """Resolved atoms of conditions whose column has no FILTER_FLOW into their statement: stmt, col."""
    there = graph.link("FILTER_FLOW", "col", "stmt")
    return atoms.filter("status = 'resolved' and context = 'WHERE'").select("stmt", "col").distinct().join(there, ["stmt", "col"], "left_anti")


def nesting(graph: Graph) -> DataFrame:
    """Root and nested statements and the statements right below them: is_root, n, n_children."""
    links = graph.link("CHILD_OF", "sub", "up")
    kids = links.groupBy(F.col("up").alias("stmt")).agg(_n("kids"))
    own = graph.typed("stmt", "Statement").join(kids, "stmt", "left").join(root_of(graph).withColumnRenamed("sub", "stmt"), "stmt", "left")
    return own.groupBy(F.col("root").isNull().alias("is_root")).agg(_n(), F.sum(F.coalesce("kids", F.lit(0))).alias("n_children"))


def pairs(graph: Graph, etype: str, limit: int = 30) -> DataFrame:
    """Edges of a type by label: src_label, dst_label."""
    name = lambda n: graph.vertices.select(F.col("id").alias(n), F.col("label").alias(f"{n}_label"))
    return graph.of(etype).join(name("src"), "src").join(name("dst"), "dst").select("src_label", "dst_label").orderBy("src_label", "dst_label").limit(limit)


def most_complex(atoms: DataFrame, limit: int = 15) -> DataFrame:
    """Statements with the most atoms, and how many of these are resolved: stmt, n, n_resolved."""
    return atoms.groupBy("stmt").agg(_n(), _of(F.col("status") == "resolved", "n_resolved")).orderBy(F.desc("n"), "stmt").limit(limit)


def most_used_columns(graph: Graph, limit: int = 15) -> DataFrame:
    return graph.of("DATA_FLOW", "FILTER_FLOW").join(graph.typed("src", "Column"), "src", "left_semi").groupBy(F.col("src").alias("col")).agg(_n()).orderBy(F.desc("n"), "col").limit(limit)


def unresolved(atoms: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent unresolved texts by context: text, context, n."""
    return atoms.filter("status = 'unresolved'").groupBy("text", "context").agg(_n()).orderBy(F.desc("n"), "text", "context").limit(limit)


def statement_quality(atoms: DataFrame) -> DataFrame:
    """Atoms of each statement by status, and the settled share: stmt, total, resolved, constant, unresolved, quality."""
    is_ = lambda s: F.col("status") == s
    counted = atoms.groupBy("stmt").agg(_n("total"), *(_of(is_(s), s) for s in ("resolved", "constant", "unresolved")))
    return counted.withColumn("quality", (F.col("resolved") + F.col("constant")) / F.col("total"))


def output_atoms(graph: Graph, atoms: DataFrame, statement: str) -> DataFrame:
    """Output columns of a statement with what they are made of: out, atoms (text:status in order, comma-joined). Atoms without text are left out."""
    outs = graph.link("HAS_OUTPUT_COL", "stmt", "out").filter(F.col("stmt") == statement).withColumn("output_order", F.substring_index("out", ".", -1).cast("int"))
    made = atoms.filter(F.col("text").isNotNull()).groupBy("stmt", "output_order").agg(F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws(":", "text", "status")))).alias("atoms"))
    return outs.join(made, ["stmt", "output_order"], "left").select("out", F.coalesce("atoms", F.lit("")).alias("atoms"))


def atom_references(graph: Graph, atoms: DataFrame) -> DataFrame:
    """Atoms with the labels of the tables and columns they refer to, empty where unknown: stmt, text, table_label, column_label, routine.

    Names of the tables that atoms refer to are written first; where these are few, atoms are not shuffled for them.
    """
    name = lambda vtype, key, to: graph.vertices.filter(F.col("vtype") == vtype).select(F.col("id").alias(key), F.col("label").alias(to))
    owner = graph.link("CONTAINS_STMT", "routine", "stmt").groupBy("stmt").agg(F.min("routine").alias("routine"))
    tables = saved(name("Table", "tbl", "table_label").join(atoms.select("tbl").distinct(), "tbl", "left_semi"), "tables")
    met = atoms.select("stmt", "text", "tbl", "col").join(tables, "tbl", "left").join(name("Column", "col", "column_label"), "col", "left").join(owner, "stmt", "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return met.select("stmt", "text", blank("table_label"), blank("column_label"), blank("routine"))


def bucketed(df: DataFrame, key: str, size: int) -> DataFrame:
    """Keys in fixed-size buckets by their position: key, bucket. For lists of a view, which one task orders."""
    place = F.row_number().over(Window.orderBy(key))
    return df.select(key, F.floor((place - 1) / size).alias("bucket"))
