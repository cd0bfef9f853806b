"""Small lookups: glossary entries, schemas and columns, newest rows, escaped quotes and payload versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.lineage import Graph

MOST = 100


def entry_of(entries: DataFrame, geoid: str) -> DataFrame:
    """The entry (geoid, kind, label, description) of an object, blanks for what it lacks; of several the least by label."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return entries.filter(F.col("geoid") == geoid).orderBy("label").limit(1).select(*map(text, ("geoid", "kind", "label", "description")))


def search_entries(entries: DataFrame, query: str | None, limit: int = 20) -> DataFrame:
    """Entries whose label or description holds a text, with regard to case, at most 100; none for a blank text."""
    if query is None or not query.strip():
        return entries.limit(0).select("geoid", "kind", "label", "description")
    held = F.contains("label", F.lit(query)) | F.contains("description", F.lit(query))
    return entries.filter(F.coalesce(held, F.lit(False))).select("geoid", "kind", "label", "description").orderBy("geoid").limit(min(limit, MOST))


def schema_names(graph: Graph) -> DataFrame:
    """Names of the schemas there are, in order."""
    return graph.vertices.filter("vtype = 'Schema' AND label IS NOT NULL").select(F.col("label").alias("schema")).distinct().orderBy("schema")


def table_columns(graph: Graph, table: str) -> DataFrame:
    """column, at: a table's columns in order of their ids."""
    held = graph.link("HAS_COLUMN", "tbl", "id").filter(F.col("tbl") == table)
    named = graph.vertices.filter("vtype = 'Column'").select("id", F.coalesce("label", F.lit("")).alias("column"))
    return held.join(named, "id").select("id", "column").orderBy("id")


def newest(rows: DataFrame, at: str, limit: int, tie: str, own: Column | None = None) -> DataFrame:
    """The newest rows, of one owner where a test is given; later ties first. Spark keeps ``limit`` rows a task."""
    kept = rows if own is None else rows.filter(own)
    return kept.orderBy(F.desc_nulls_last(at), F.desc(tie)).limit(limit)


def escaped(text: Column) -> Column:
    """A text with its single quotes doubled, for a literal; null is empty. Bound parameters need none of this."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("'"), F.lit("''"))


def version_state(version: Column, supported: tuple[int, ...], deprecated: tuple[int, ...] = ()) -> Column:
    """``deprecated`` for versions that will go, ``supported`` for the others taken, else ``unsupported``."""
    return F.when(version.isin(*deprecated), "deprecated").when(version.isin(*supported), "supported").otherwise("unsupported") if deprecated else F.when(version.isin(*supported), "supported").otherwise("unsupported")
