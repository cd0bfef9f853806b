"""Search over typed names, within one tenant or across tenants, named query templates and guarded ad-hoc queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.guards import CYPHER_WRITES, SQL_WRITES
from skein.operators import graph as traversals
from skein.operators.lineage import Graph, below, root_of

# How much a match counts by the type of what it names.
SCORES = {"Table": 1.0, "Column": 0.9, "OutputColumn": 0.9, "Package": 0.8, "Routine": 0.8, "Parameter": 0.75, "Variable": 0.75, "Statement": 0.7, "Schema": 0.7, "Database": 0.7, "Application": 0.7, "Session": 0.5}
MOST_ROWS = 500


def search(vertices: DataFrame, text: str, limit: int = 20, scores: dict[str, float] = SCORES) -> DataFrame:
    """Vertices whose label holds a text as it is written: id, vtype, label, score.

    Each type keeps max(limit / 2, 10) rows by label and id, the whole the best ``limit`` by score. The rank is bounded, so
    Spark cuts it in each task before the shuffle.
    """
    score = F.create_map(*(F.lit(x) for pair in scores.items() for x in pair))
    found = vertices.filter(F.col("vtype").isin(*scores) & F.col("label").contains(text)).select("id", "vtype", "label", score[F.col("vtype")].alias("score"))
    nth = F.row_number().over(Window.partitionBy("vtype").orderBy("label", "id"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= max(limit // 2, 10)).drop("nth").orderBy(F.desc("score"), "vtype", "label", "id").limit(limit)


def search_tenants(vertices: DataFrame, tenants: DataFrame, text: str, each: int = 20) -> DataFrame:
    """The best ``each`` matches of every active tenant: tenant, id, label. vertices has tenant; tenants has tenant, status."""
    active = tenants.filter(F.col("status") == "ACTIVE").select("tenant").distinct()
    found = vertices.filter(F.col("label").contains(text)).join(active, "tenant", "left_semi")
    nth = F.row_number().over(Window.partitionBy("tenant").orderBy("label", "id"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= each).select("tenant", "id", "label")


def orphan_tables(graph: Graph, limit: int = 100) -> DataFrame:
    """Tables that nothing flows into and nothing reads, by label: id, label."""
    return traversals.without_edge(graph.vertices, graph.edges, "Table", "DATA_FLOW", "READS_FROM").orderBy("label", "id").limit(limit)


def schema_summary(graph: Graph, database: str | None = None, limit: int = 50) -> DataFrame:
    """Schemas with the most tables: schema, n."""
    tables = graph.vertices.filter(F.col("vtype") == "Table")
    if database:
        tables = tables.join(graph.vertices.filter((F.col("vtype") == "Schema") & (F.col("scope") == database)).select(F.col("id").alias("scope")), "scope", "left_semi")
    return tables.groupBy(F.col("scope").alias("schema")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "schema").limit(limit)


def package_routines(graph: Graph, limit: int = 100, sample: int = 5) -> DataFrame:
    """Packages with the most routines and the first names of these: package, n, names."""
    held = graph.link("CONTAINS_ROUTINE", "pkg", "routine").join(graph.vertices.filter(F.col("vtype") == "Package").select(F.col("id").alias("pkg"), F.col("label").alias("package")), "pkg")
    named = held.join(graph.vertices.select(F.col("id").alias("routine"), "label"), "routine")
    nth = F.row_number().over(Window.partitionBy("package").orderBy("label"))
    counted = named.groupBy("package").agg(F.count(F.lit(1)).alias("n"))
    first = named.withColumn("nth", nth).filter(F.col("nth") <= sample).groupBy("package").agg(F.concat_ws(",", F.sort_array(F.collect_list("label"))).alias("names"))
    return counted.join(first, "package").orderBy(F.desc("n"), "package").limit(limit)


TEMPLATES: dict[str, Callable] = {
    "downstream_impact": lambda g, node, **_: traversals.impact(g.vertices, g.edges, node, types=("Table", "Column", "Routine", "Statement", "OutputColumn", "AffectedColumn")),
    "upstream_lineage": lambda g, node, **_: traversals.lineage(g.vertices, g.edges, node, "upstream").orderBy("depth", "id").limit(MOST_ROWS),
    "schema_summary": lambda g, database=None, **_: schema_summary(g, database),
    "orphan_tables": lambda g, **_: orphan_tables(g),
    "package_routines": lambda g, **_: package_routines(g),
}


def template(graph: Graph, name: str, **parameters) -> DataFrame:
    """The named template on a graph; an unknown name is a ValueError."""
    if name not in TEMPLATES:
        raise ValueError(f"no template {name}; there are {', '.join(TEMPLATES)}")
    return TEMPLATES[name](graph, **parameters)


def ad_hoc(spark: SparkSession, query: str, language: str = "sql", limit: int = MOST_ROWS, **frames: DataFrame) -> DataFrame:
    """A read-only SQL query over frames it names in braces, trimmed to ``limit`` rows. Other languages are not carried out."""
    import re

    words = SQL_WRITES if language == "sql" else CYPHER_WRITES
    if re.search(r"(?i)(?<!\w)(?:" + "|".join(words) + r")(?!\w)", query):
        raise PermissionError("the query writes")
    if language != "sql":
        raise NotImplementedError(language)
    return spark.sql(query, **frames).limit(limit)


def table_detail(graph: Graph, table: str) -> DataFrame:
    """Columns of a table and how many statements use each by flow: id, label, n_flow, n_filter."""
    columns = graph.link("HAS_COLUMN", "tbl", "col").filter(F.col("tbl") == table).select("col")
    used = graph.of("DATA_FLOW", "FILTER_FLOW").withColumnRenamed("src", "col").join(columns, "col", "left_semi")
    of = lambda t, name: F.count(F.when(F.col("etype") == t, 1)).alias(name)
    counted = used.groupBy("col").agg(of("DATA_FLOW", "n_flow"), of("FILTER_FLOW", "n_filter"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return columns.join(graph.vertices.select(F.col("id").alias("col"), "label"), "col").join(counted, "col", "left").select(F.col("col").alias("id"), "label", zero("n_flow"), zero("n_filter"))


def table_routines(graph: Graph, table: str, limit: int = 200) -> DataFrame:
    """Routines whose statements, or the roots above these, use a table: routine, etype, n (statements)."""
    uses = graph.of("READS_FROM", "WRITES_TO").filter(F.col("dst") == table).select(F.col("src").alias("stmt"), "etype")
    up = uses.join(root_of(graph).withColumnRenamed("sub", "stmt"), "stmt", "left").select("stmt", F.coalesce("root", "stmt").alias("root"), "etype")
    met = up.join(graph.link("CONTAINS_STMT", "routine", "root"), "root")
    return met.groupBy("routine", "etype").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "routine", "etype").limit(limit)


def column_statements(graph: Graph, column: str, limit: int = 200) -> DataFrame:
    """Statements a column flows into, by its output columns or as a filter: stmt, how."""
    out = graph.link("DATA_FLOW", "col", "out").filter(F.col("col") == column).join(graph.link("HAS_OUTPUT_COL", "stmt", "out"), "out").select("stmt", F.lit("output").alias("how"))
    filtered = graph.link("FILTER_FLOW", "col", "stmt").filter(F.col("col") == column).select("stmt", F.lit("filter").alias("how"))
    return out.unionByName(filtered).distinct().orderBy("stmt", "how").limit(limit)


def statement_sources(graph: Graph, node: str) -> DataFrame:
    """Tables a root statement reads: DIRECT where it reads them itself, else SUBQUERY: tbl, how."""
    reads = graph.link("READS_FROM", "stmt", "tbl")
    direct = reads.filter(F.col("stmt") == node).select("tbl", F.lit(0).alias("rank"))
    under = below(graph, node)[0].select(F.col("sub").alias("stmt"))
    deep = reads.join(under, "stmt", "left_semi").select("tbl", F.lit(1).alias("rank"))
    first = direct.unionByName(deep).groupBy("tbl").agg(F.min("rank").alias("rank"))
    return first.select("tbl", F.when(F.col("rank") == 0, "DIRECT").otherwise("SUBQUERY").alias("how"))
