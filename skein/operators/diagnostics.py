"""Diagnostic reports over vertices (id, vtype, label) and edges (src, dst, etype), and over plain frames of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import table_degrees


def degree_top(edges: DataFrame, etype: str, end: str = "dst", limit: int = 10) -> DataFrame:
    """Nodes with the most edges of one type at the given end: id, n. The limit is the report's length."""
    return edges.filter(F.col("etype") == etype).groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(limit)


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """In and out degree of every vertex, 0 where it has no edge: id, n_in, n_out."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counted = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return vertices.select("id").join(counted, "id", "left").select("id", zero("n_in"), zero("n_out"))


def untouched(vertices: DataFrame, edges: DataFrame, vtype: str, etypes: tuple[str, ...]) -> DataFrame:
    """Vertices of a type that no edge of the types leaves or enters: id, label. One anti-join against both ends."""
    used = edges.filter(F.col("etype").isin(*etypes))
    ends = used.select(F.col("src").alias("id")).unionByName(used.select(F.col("dst").alias("id")))
    return vertices.filter(F.col("vtype") == vtype).join(ends, "id", "left_anti").select("id", "label")


def usage_roles(edges: DataFrame) -> DataFrame:
    """One row per statement, table and role (SOURCE for reads, TARGET for writes): stmt, table, role."""
    role = F.when(F.col("etype") == "READS_FROM", "SOURCE").otherwise("TARGET")
    return edges.filter(F.col("etype").isin("READS_FROM", "WRITES_TO")).select(F.col("src").alias("stmt"), F.col("dst").alias("table"), role.alias("role")).distinct()


def dead_tables(edges: DataFrame) -> DataFrame:
    """Tables that are written and never read: id, written_by."""
    return table_degrees(edges).filter("read_by = 0 and written_by > 0").select("id", "written_by")


def end_routines(vertices: DataFrame, edges: DataFrame, etype: str, side: str) -> DataFrame:
    """Routines no edge of the type leaves (side ``src``: leaves) or enters (side ``dst``: roots): id, label."""
    linked = edges.filter(F.col("etype") == etype).select(F.col(side).alias("id"))
    return vertices.filter(F.col("vtype") == "Routine").join(linked, "id", "left_anti").select("id", "label")


def health(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of the vertex kinds, of edges by role, and the share of edges that carry data flow (0 to 100)."""
    of = lambda c, v, name: F.count(F.when(F.col(c) == v, 1)).alias(name)
    v = vertices.agg(*(of("vtype", t, f"n_{t.lower()}") for t in ("Schema", "Table", "Routine", "Statement")))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"), of("etype", "READS_FROM", "n_reads"), of("etype", "WRITES_TO", "n_writes"), of("etype", "DATA_FLOW", "n_flow"))
    share = F.when(F.col("n_edges") == 0, F.lit(0.0)).otherwise(F.col("n_flow") * 100.0 / F.col("n_edges"))
    # both sides are global aggregates of one row
    return v.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k").drop("k").withColumn("flow_pct", share)


def type_histogram(df: DataFrame, key: str, geoid: Column, types: tuple[str, ...]) -> DataFrame:
    """Rows of each key by the type in segment 4 of a geoid, other types in ``n_other``: key, n_<type>..., n_other."""
    kind = F.lower(F.try_element_at(F.split(geoid, ":"), F.lit(4)))
    rows = df.select(key, kind.alias("kind"))
    return rows.groupBy(key).agg(*(F.count(F.when(F.col("kind") == t, 1)).alias(f"n_{t}") for t in types), F.count(F.when(~F.coalesce(F.col("kind").isin(*types), F.lit(False)), 1)).alias("n_other"))


def run_metrics(df: DataFrame, key: str, took: str, failed: Column) -> DataFrame:
    """Runs of each key: n_ok, n_failed, min, max and mean duration of all runs."""
    return df.groupBy(key).agg(F.count(F.when(failed, None).otherwise(1)).alias("n_ok"), F.count(F.when(failed, 1)).alias("n_failed"), F.min(took).alias("least"), F.max(took).alias("most"), F.avg(took).alias("mean"))


def tenant_stats(df: DataFrame, tenant: Column, session: str, kind: str, archived: str) -> DataFrame:
    """Sessions and rows of each tenant, without archived rows: tenant, n_sessions, n_rows."""
    kept = df.filter(~F.coalesce(F.col(kind) == archived, F.lit(False)))
    return kept.groupBy(tenant.alias("tenant"), session).agg(F.count(F.lit(1)).alias("n")).groupBy("tenant").agg(F.count(session).alias("n_sessions"), F.sum("n").alias("n_rows"))


def like_ratio(df: DataFrame, column: str, **patterns: str) -> DataFrame:
    """One row: how many values match each pattern, and their share: n, n_<name>, <name>_ratio."""
    n = F.count(F.lit(1))
    share = lambda p: F.when(n == 0, F.lit(0.0)).otherwise(F.count(F.when(F.col(column).like(p), 1)) / n)
    return df.agg(n.alias("n"), *(F.count(F.when(F.col(column).like(p), 1)).alias(f"n_{k}") for k, p in patterns.items()), *(share(p).alias(f"{k}_ratio") for k, p in patterns.items()))


def top_groups(df: DataFrame, keys: list[str], limit: int = 20) -> DataFrame:
    """The most frequent combinations of keys: keys, n."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys).limit(limit)
