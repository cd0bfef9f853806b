"""Explore operators: siblings, hoisting to roots, undirected expansion, name matches, snapshot diffs, merged results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.guards import is_root
from skein.operators.graph import reach
from skein.session import saved


def siblings(edges: DataFrame, node: str, etype: str) -> DataFrame:
    """What the parents of a node hold, itself included: parent, id."""
    held = edges.filter(F.col("etype") == etype).select(F.col("src").alias("parent"), F.col("dst").alias("id"))
    return held.join(held.filter(F.col("id") == node).select("parent").distinct(), "parent", "left_semi").distinct()


def closure(parents: DataFrame, max_depth: int = 30) -> DataFrame:
    """Every ancestor of every node of (child, parent) edges by least depth, itself at depth 0: id, ancestor, depth.

    Pairs seen before are dropped, so cycles end; each round joins only the pairs found last.
    """
    links = saved(parents.filter("child is not null and parent is not null").select("child", "parent").distinct(), "links")
    nodes = links.select(F.col("child").alias("id")).union(links.select(F.col("parent").alias("id"))).distinct()
    seen = frontier = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    for depth in range(1, max_depth + 1):
        up = frontier.join(links.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("id", F.col("parent").alias("ancestor")).distinct()
        frontier = saved(up.join(seen.select("id", "ancestor"), ["id", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def hoist(edges: DataFrame, parents: DataFrame, max_depth: int = 30) -> DataFrame:
    """Reads and writes of descendants given to their root, the ancestor without a parent: src, dst, etype, distinct."""
    up = closure(parents, max_depth)
    roots = up.join(parents.filter("parent is not null").select(F.col("child").alias("ancestor")), "ancestor", "left_anti").select(F.col("id").alias("src"), F.col("ancestor").alias("root"))
    return edges.join(roots, "src", "left").select(F.coalesce("root", "src").alias("src"), "dst", "etype").distinct()


def descendants(parents: DataFrame, root: str, max_depth: int = 30, limit: int = 500) -> DataFrame:
    """Descendants of a node without itself, nearest first: id, depth."""
    links = saved(parents.select(F.col("parent").alias("src"), F.col("child").alias("dst")), "links")
    start = links.filter(F.col("src") == root).select(F.col("src").alias("id")).distinct()
    return reach(links, start, max_depth).select("id", "depth").orderBy("depth", "id").limit(limit)


def expand_deep(vertices: DataFrame, edges: DataFrame, node: str, depth: int = 3, limit: int = 500) -> DataFrame:
    """Read and write edges met within 1 to 10 undirected steps of a node over tables and root statements: src, dst, etype.

    Where vertices have no column ``parent``, all statements are roots.
    """
    parent = F.col("parent") if "parent" in vertices.columns else F.lit(None)
    allowed = vertices.filter(F.col("vtype").isin("Table", "Statement") & is_root(F.col("vtype"), parent)).select("id")
    used = edges.filter(F.col("etype").isin("READS_FROM", "WRITES_TO"))
    used = used.join(allowed.withColumnRenamed("id", "src"), "src", "left_semi").join(allowed.withColumnRenamed("id", "dst"), "dst", "left_semi")
    used = saved(used, "used")
    both = used.select("src", "dst").unionByName(used.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    start = allowed.filter(F.col("id") == node)
    steps = min(max(depth, 1), 10)
    inner = start if steps == 1 else start.unionByName(reach(both, start, steps - 1).select("id"))
    # an edge is on a path of at most ``steps`` edges when one end lies within steps - 1
    out = used.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(used.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "etype"), allowMissingColumns=False)
    return out.select("src", "dst", "etype").distinct().orderBy("src", "dst", "etype").limit(limit)


def last_segment(name: Column) -> Column:
    """The upper-cased part after the last dot."""
    return F.upper(F.element_at(F.split(name, r"\."), -1))


def name_match(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Pairs of rows whose names agree in the last dotted segment without regard to case: left_name, right_name."""
    side = lambda df, to: df.select(F.col(name).alias(to), last_segment(F.col(name)).alias("segment")).distinct()
    return side(left, "left_name").join(side(right, "right_name"), "segment").select("left_name", "right_name")


def optional_counts(routines: DataFrame, statements: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct tables that each routine's statements read and write, 0 where none.

    routines (routine), statements (stmt, routine), edges (src, dst, etype): routine, n_reads, n_writes.
    """
    per = edges.filter(F.col("etype").isin("READS_FROM", "WRITES_TO")).select(F.col("src").alias("stmt"), "dst", "etype")
    touched = statements.join(per, "stmt").select("routine", "etype", "dst").distinct()
    counted = touched.groupBy("routine").agg(*(F.count(F.when(F.col("etype") == t, 1)).alias(n) for t, n in (("READS_FROM", "n_reads"), ("WRITES_TO", "n_writes"))))
    return routines.join(counted, "routine", "left").select("routine", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_reads", "n_writes")))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Transitions between two snapshots of unique keys: key, was, now, status (new, changed, deleted); equal rows are left out."""
    side = lambda df, name: df.filter(F.col(key).isNotNull()).select(key, F.col(value).alias(name), F.lit(1).alias(f"in_{name}"))
    both = side(before, "was").join(side(after, "now"), key, "full_outer")
    status = F.when(F.col("in_was").isNull(), "new").when(F.col("in_now").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select(key, "was", "now", status.alias("status")).filter("status is not null")


def prefer_first(branches: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of branches of one schema; of equal keys the row of the earliest branch stays, with its number in ``branch``."""
    every = reduce(DataFrame.unionByName, (df.withColumn("branch", F.lit(i)) for i, df in enumerate(branches)))
    rest = [c for c in every.columns if c not in (*keys, "branch")]
    return every.groupBy(*keys).agg(F.min(F.struct("branch", *rest)).alias("first")).select(*keys, "first.*")


def result_edges(vertices: DataFrame, edges: DataFrame, most: int = 500) -> DataFrame:
    """Distinct edges under their result key ``src__type__dst`` whose ends are both known: edge, has_more (``most`` rows or more)."""
    known = vertices.select("id").distinct()
    kept = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out = kept.select(F.concat_ws("__", "src", "etype", "dst").alias("edge")).distinct()
    total = out.agg(F.count(F.lit(1)).alias("n"))  # one row, safe to broadcast
    return out.join(F.broadcast(total)).select("edge", (F.col("n") >= most).alias("has_more"))


def recent_per(df: DataFrame, key: str, order: str, most: int, *columns: str) -> DataFrame:
    """The newest rows of each key. The rank is bounded, so Spark filters within tasks before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.select(key, order, *columns).withColumn("rank", rank).filter(F.col("rank") <= most)


def override_order(df: DataFrame, keys: list[str], order: str, explicit: str, cell: int = 100_000) -> DataFrame:
    """Adds ``position``: a counter per key; an explicit position lifts the counter to at least itself.

    The counter after row t is the greatest of t and, over explicit rows i up to t, explicit_i + (rows after i up to t). The order, a
    number, is cut into cells, so no task orders a whole key: a cell's count and its greatest lead, one row each, carry over.
    """
    rows = df.withColumn("_cell", F.floor(F.col(order) / cell))
    so_far = Window.partitionBy(*keys, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(so_far)).withColumn("_lead", F.col(explicit) - F.col("_n"))
    cells = rows.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_held"), F.max("_lead").alias("_most"))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_held").over(earlier), F.lit(0)))
    cells = cells.withColumn("_ahead", F.max(F.col("_most") - F.col("_before")).over(earlier))
    named = cells.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_cell").alias("_at"), "_before", "_ahead")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("_cell") == F.col("_at"))
    ahead = F.greatest(F.lit(0), F.col("_ahead"), F.max("_lead").over(so_far) - F.col("_before"))
    met = rows.join(named, same).withColumn("position", F.col("_before") + F.col("_n") + ahead)
    return met.select(*df.columns, "position")


def result_view(vertices: DataFrame, edges: DataFrame, most: int = 500) -> DataFrame:
    """kind, key, label, has_more of a merged result: nodes put once, and distinct edges both of whose ends are among them.

    ``has_more`` says that nodes or edges reach ``most``. Of rows of one node the least label stays.
    """
    nodes = saved(vertices.groupBy("id").agg(F.min(F.coalesce("label", F.lit(""))).alias("label")), "result-nodes")
    kept = saved(result_edges(nodes, edges, most).select("edge"), "result-edges")
    more = F.lit(nodes.count() >= most or kept.count() >= most)
    view = lambda df, kind, key, label: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), label.alias("label"), more.alias("has_more"))
    return view(nodes, "node", "id", F.col("label")).unionByName(view(kept, "edge", "edge", F.lit("")))
