"""Writing a graph: first-wins vertices, edges whose ends are known, write statistics, repaired containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are vertices."""
    ids = vertices.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def dropped_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each type that are written and that are dropped for an unknown end: etype, n_kept, n_dropped."""
    count = lambda df, name: df.groupBy("etype").agg(F.count(F.lit(1)).alias(name))
    every = count(edges, "n").join(count(known_edges(vertices, edges), "n_kept"), "etype", "left")
    kept = F.coalesce("n_kept", F.lit(0)).cast("long")
    return every.select("etype", kept.alias("n_kept"), (F.col("n") - kept).alias("n_dropped"))


def write_statistics(vertices: DataFrame) -> DataFrame:
    """Vertices of each type that are inserted and that repeat an id: vtype, inserted, duplicates."""
    per_id = vertices.groupBy("vtype", "id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.groupBy("vtype").agg(F.count(F.lit(1)).alias("inserted"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


def write_graph(vertices: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes vertices (one a id) and known edges as Parquet, by type, so that readers of one type scan only its files."""
    vertices.dropDuplicates(["id"]).write.mode(mode).partitionBy("vtype").parquet(f"{path}/vertices")
    known_edges(vertices, edges).write.mode(mode).partitionBy("etype").parquet(f"{path}/edges")


def missing_containment(members: DataFrame, scopes: DataFrame, edges: DataFrame, etype: str) -> DataFrame:
    """Edges (src, dst, etype) to add for members (id, scope) no edge of the type enters: to the least scope (id, scope) of that name."""
    first = scopes.groupBy("scope").agg(F.min("id").alias("src"))
    orphans = members.join(edges.filter(F.col("etype") == etype).select(F.col("dst").alias("id")), "id", "left_anti")
    return orphans.join(first, "scope").select("src", F.col("id").alias("dst"), F.lit(etype).alias("etype"))
