"""Traversals and degree reports over a property graph of vertices (id, vtype, label, scope) and edges (src, dst, etype)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import saved

FLOW = ("DATA_FLOW", "FILTER_FLOW", "JOIN_FLOW", "ATOM_REF_COLUMN")


def reach(edges: DataFrame, start: DataFrame, max_hops: int, reverse: bool = False, stored: bool = False) -> DataFrame:
    """Least depth (id, depth) of every node within 1..max_hops steps of the ids in ``start`` (id).

    Each hop meets its frontier with the edges, which are written once where they are not ``stored``, drops nodes seen before and
    is written. The start itself is never returned.
    """
    near, far = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(near).alias("near"), F.col(far).alias("far")).filter("near is not null and far is not null")
    if max_hops > 1 and not stored:
        steps = saved(steps, "steps")
    seen = start.select("id", F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, max_hops + 1):
        met = steps.join(frontier.select(F.col("id").alias("near")), "near", "left_semi").select(F.col("far").alias("id")).distinct()
        frontier = saved(met.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


IMPACT_TYPES = ("Column", "Routine", "Statement", "Table")


def impact(vertices: DataFrame, edges: DataFrame, node: str, downstream: bool = True, max_hops: int = 5, types: tuple[str, ...] = IMPACT_TYPES, limit: int = 500) -> DataFrame:
    """Nodes of the wanted types that flow edges reach from one node, nearest first: id, vtype, label, depth, has_more.

    ``has_more`` says that the result has ``limit`` rows, also where there are exactly so many.
    """
    start = vertices.filter(F.col("id") == node).select("id")
    found = reach(edges.filter(F.col("etype").isin(*FLOW)), start, max_hops, reverse=not downstream)
    first = saved(vertices.filter(F.col("vtype").isin(*types)).join(found, "id").select("id", "vtype", "label", "depth").orderBy("depth", "id").limit(limit), "impact")
    return first.withColumn("has_more", F.lit(first.count() >= limit))


def lineage(vertices: DataFrame, edges: DataFrame, node: str, direction: str = "both", max_hops: int = 10) -> DataFrame:
    """Nodes that DATA_FLOW edges reach; ``both`` puts the two directions after each other without merging them."""
    if direction not in ("upstream", "downstream", "both"):
        raise ValueError(f"unknown direction {direction}")
    start, flow = vertices.filter(F.col("id") == node).select("id"), saved(edges.filter(F.col("etype") == "DATA_FLOW").select("src", "dst"), "steps")
    parts = [reach(flow, start, max_hops, reverse=d == "upstream", stored=True).withColumn("direction", F.lit(d)) for d in ("upstream", "downstream") if direction in (d, "both")]
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return vertices.join(every, "id").select("id", "vtype", "direction", "depth")


def expand(vertices: DataFrame, edges: DataFrame, node: str, limit: int = 200) -> DataFrame:
    """Edges that leave and that enter a node, each side limited by itself: src, dst, etype, other_type."""
    def side(own: str, other: str) -> DataFrame:
        near = edges.filter(F.col(own) == node)
        typed = near.join(vertices.select(F.col("id").alias(other), F.col("vtype").alias("other_type")), other)
        return typed.select("src", "dst", "etype", "other_type").orderBy("src", "dst", "etype").limit(limit)

    return side("src", "dst").unionByName(side("dst", "src"))


def without_edge(vertices: DataFrame, edges: DataFrame, vtype: str, *etypes: str) -> DataFrame:
    """Vertices of a type that no edge of the named types enters: orphans and tables without lineage."""
    linked = edges.filter(F.col("etype").isin(*etypes)).select(F.col("dst").alias("id"))
    return vertices.filter(F.col("vtype") == vtype).join(linked, "id", "left_anti").select("id", "label")


def members(vertices: DataFrame, edges: DataFrame, etype: str, limit: int = 50) -> DataFrame:
    """Scopes with the most members: label, n."""
    counted = edges.filter(F.col("etype") == etype).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(vertices.select(F.col("id").alias("src"), "label"), "src").select("label", "n").orderBy(F.desc("n"), "label").limit(limit)


def type_totals(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Count of each vertex and edge type: kind, name, n."""
    count = F.count(F.lit(1)).alias("n")
    return vertices.groupBy(F.lit("vertex").alias("kind"), F.col("vtype").alias("name")).agg(count).unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("etype").alias("name")).agg(count))


def table_degrees(edges: DataFrame) -> DataFrame:
    """Readers and writers of each table: id, read_by, written_by, one shuffle."""
    of = lambda t: F.count(F.when(F.col("etype") == t, 1))
    return edges.filter(F.col("etype").isin("READS_FROM", "WRITES_TO")).groupBy(F.col("dst").alias("id")).agg(of("READS_FROM").alias("read_by"), of("WRITES_TO").alias("written_by"))


def hotspots(edges: DataFrame, limit: int = 15) -> DataFrame:
    """Tables with the most readers and writers."""
    return table_degrees(edges).orderBy(F.desc(F.col("read_by") + F.col("written_by")), "id").limit(limit)


def crossroads(edges: DataFrame) -> DataFrame:
    """Tables that are both read and written."""
    return table_degrees(edges).filter("read_by > 0 and written_by > 0")


def dependency_counts(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node: id, n_out, n_in, n_both."""
    one = lambda own, other, side: edges.select(F.col(own).alias("id"), F.col(other).alias("other"), F.lit(side).alias("side"))
    ends = one("src", "dst", "out").unionByName(one("dst", "src", "in")).distinct()
    of = lambda s: F.count(F.when(F.col("side") == s, 1))
    return ends.groupBy("id").agg(of("out").alias("n_out"), of("in").alias("n_in"), F.count(F.lit(1)).alias("n_both"))


def label_of(*names: str) -> Column:
    """First non-null name, else the empty text."""
    return F.coalesce(*map(F.col, names), F.lit(""))
