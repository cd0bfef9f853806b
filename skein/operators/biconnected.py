"""Bridges and articulation points of undirected graphs, by breadth-first trees grown over all components at once.

Rounds go with the depth of the trees (the diameter), and each round is a join and an aggregate over narrow rows that are
written once; no component is gathered. Links that are in no tree are climbed from both ends to where they meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.algorithms import weak_components
from skein.session import saved


def _links(edges: DataFrame) -> DataFrame:
    """Distinct undirected links u < v, without loops and nulls."""
    kept = edges.filter("src is not null and dst is not null and src <> dst")
    return saved(kept.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), "links")


def _tree(links: DataFrame) -> tuple[DataFrame, int]:
    """Breadth-first trees from each component's least node: id, parent (null at roots), depth; and the greatest depth."""
    both = saved(links.select(F.col("u").alias("near"), F.col("v").alias("id")).unionByName(links.select(F.col("v").alias("near"), F.col("u").alias("id"))), "both")
    roots = weak_components(links.select(F.col("u").alias("src"), F.col("v").alias("dst"))).filter("id = component").select("id", F.lit(None).cast(links.schema["u"].dataType).alias("parent"), F.lit(0).alias("depth"))
    levels, depth = [saved(roots, "level")], 0
    while True:
        depth += 1
        met = both.join(levels[-1].select(F.col("id").alias("near")), "near").groupBy("id").agg(F.min("near").alias("parent"))
        # a neighbour of a level lies in it, in the one before or in the next
        for seen in levels[-2:]:
            met = met.join(seen.select("id"), "id", "left_anti")
        fresh = saved(met.withColumn("depth", F.lit(depth)), "level")
        if fresh.isEmpty():
            return saved(reduce(DataFrame.unionByName, levels), "tree"), depth - 1
        levels.append(fresh)


def _outside_tree(links: DataFrame, tree: DataFrame) -> DataFrame:
    """Links (u, v) that no tree has."""
    held = tree.filter("parent is not null").select(F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"))
    return links.join(held, ["u", "v"], "left_anti")


def bridges(edges: DataFrame) -> DataFrame:
    """Links whose loss parts their component: u, v (u < v).

    Each link outside the trees gets a random 64-bit mark at both ends. A tree link is a bridge if the marks below it cancel
    out under exclusive or, that is, if no other link leads out of what lies below it (but for a chance of 2 ** -64).
    """
    links = _links(edges)
    tree, deepest = _tree(links)
    outside = _outside_tree(links, tree).select("u", "v", F.xxhash64("u", "v").alias("mark"))
    own = outside.select(F.col("u").alias("id"), "mark").unionByName(outside.select(F.col("v").alias("id"), "mark")).groupBy("id").agg(F.bit_xor("mark").alias("mark"))
    marks = saved(tree.join(own, "id", "left").select("id", "parent", "depth", F.coalesce("mark", F.lit(0)).alias("mark")), "marks")
    done, up = [], None
    for depth in range(deepest, 0, -1):
        level = marks.filter(F.col("depth") == depth).select("id", "parent", "mark")
        if up is not None:
            level = level.join(up, "id", "left").select("id", "parent", F.col("mark").bitwiseXOR(F.coalesce("below", F.lit(0))).alias("mark"))
        level = saved(level, "below")
        up = level.groupBy(F.col("parent").alias("id")).agg(F.bit_xor("mark").alias("below"))
        done.append(level)
    if not done:
        return links.limit(0)
    return reduce(DataFrame.unionByName, done).filter("mark = 0").select(F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"))


def articulation_points(edges: DataFrame) -> DataFrame:
    """Nodes whose loss parts their component: id.

    A link outside the trees joins the two children, towards its ends, of the node where the ends meet, and joins every child
    on its way to what lies beyond the child's parent. A node parts its component if some child of it stays unjoined with the
    rest: for roots, with another child; for others, with what lies beyond the node.
    """
    links = _links(edges)
    tree, deepest = _tree(links)
    up = tree.select("id", "parent", "depth")
    of = lambda end: up.select(F.col("id").alias(end), F.col("parent").alias(f"{end}_parent"), F.col("depth").alias(f"{end}_depth"))
    pairs = saved(_outside_tree(links, tree).select(F.col("u").alias("x"), F.col("v").alias("y")), "climb")
    joined, beyond = [], []
    while not pairs.isEmpty():
        met = saved(pairs.join(of("x"), "x").join(of("y"), "y"), "climbed")
        siblings = F.col("x_parent") == F.col("y_parent")
        joined.append(met.filter(siblings).select("x", "y"))
        on = met.filter(~F.coalesce(siblings, F.lit(False)))
        # the deeper end climbs, both where they are level; it reaches beyond its parent unless the parent is the other end
        x_moves, y_moves = F.col("x_depth") >= F.col("y_depth"), F.col("y_depth") >= F.col("x_depth")
        beyond.append(on.filter(x_moves & ~F.col("x_parent").eqNullSafe(F.col("y"))).select(F.col("x").alias("child")).unionByName(on.filter(y_moves & ~F.col("y_parent").eqNullSafe(F.col("x"))).select(F.col("y").alias("child"))))
        moved = on.select(F.when(x_moves, F.col("x_parent")).otherwise(F.col("x")).alias("x"), F.when(y_moves, F.col("y_parent")).otherwise(F.col("y")).alias("y"))
        pairs = saved(moved.filter("x <> y").distinct(), "climb")
    children = tree.filter("parent is not null").select(F.col("id").alias("child"), "parent")
    roots = tree.filter("parent is null").select(F.col("id").alias("parent"), F.lit(True).alias("is_root"))
    text = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    same = [children.select(text("c", "child").alias("src"), text("c", "child").alias("dst"))]
    same += [j.select(text("c", "x").alias("src"), text("c", "y").alias("dst")) for j in joined]
    same += [b.join(children, "child").select(text("c", "child").alias("src"), text("o", "parent").alias("dst")) for b in beyond]
    group = weak_components(reduce(DataFrame.unionByName, same))
    placed = children.withColumn("id", text("c", "child")).join(group, "id").select("parent", "component")
    outer = tree.select(F.col("id").alias("parent")).withColumn("id", text("o", "parent")).join(group, "id").select("parent", "component", F.lit(True).alias("outer"))
    told = placed.join(outer, ["parent", "component"], "left").join(roots, "parent", "left")
    counted = told.groupBy("parent").agg(F.count_distinct("component").alias("groups"), F.bool_or(F.col("outer").isNull()).alias("lost"), F.bool_or(F.coalesce("is_root", F.lit(False))).alias("is_root"))
    return counted.filter("(is_root and groups > 1) or (not is_root and lost)").select(F.col("parent").alias("id"))
