"""Iterative graph algorithms over edges (src, dst): hubs and authorities, weak and strong components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import dropped, saved


def hits(edges: DataFrame, rounds: int | None = None, tolerance: float = 1e-8, most: int = 1000) -> DataFrame:
    """Hub and authority scores with L2 norm 1: id, hub, authority, 0.0 where none.

    Rounds go on until no score moves by ``tolerance`` or more, or for a given number. Where the two greatest singular values
    are equal scores may not settle; after ``most`` rounds that is an error.
    """
    links = saved(edges.select("src", "dst").distinct(), "links")
    nodes = saved(links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct(), "nodes")

    def step(scores: DataFrame, near: str, far: str, name: str, old: DataFrame) -> DataFrame:
        raw = saved(links.join(scores.select(F.col("id").alias(near), "score"), near).groupBy(F.col(far).alias("id")).agg(F.sum("score").alias("raw")), "raw")
        norm = raw.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw")))).first()[0] or 0.0
        was = old.select("id", F.col("score").alias("was"))
        scaled = raw.join(was, "id", "left").withColumn("score", F.col("raw") / F.lit(norm) if norm else F.lit(0.0))
        out = saved(scaled.select("id", "score", F.abs(F.col("score") - F.coalesce("was", F.lit(0.0))).alias("moved")), name, instead_of=old)
        dropped(raw)
        return out

    hub, authority, done = saved(nodes.withColumn("score", F.lit(1.0)), "hub"), saved(nodes.withColumn("score", F.lit(1.0)), "authority"), 0
    while rounds is None or done < rounds:
        authority = step(hub, "src", "dst", "authority", authority)
        hub = step(authority, "dst", "src", "hub", hub)
        done += 1
        if rounds is None and max(x.agg(F.max("moved")).first()[0] or 0.0 for x in (authority, hub)) < tolerance:
            break
        if rounds is None and done >= most:
            raise RuntimeError(f"scores still moved after {most} rounds")
    named = lambda df, name: df.select("id", F.col("score").alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return nodes.join(named(hub, "hub"), "id", "left").join(named(authority, "authority"), "id", "left").select("id", zero("hub"), zero("authority"))


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the least node of its component under links (a, b)."""
    label = np.arange(n)
    while len(a):
        at, to = label[a], label[b]
        low = np.minimum(at, to)
        np.minimum.at(label, at, low)
        np.minimum.at(label, to, low)
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _stars(batch: int):
    """Tells of every ``batch`` links of a partition their nodes (id), each with a number of its component there (hub) and whether it is its least node."""

    def star(rows: list[pa.RecordBatch], base: int) -> tuple[pa.RecordBatch, int]:
        table = pa.Table.from_batches(rows)
        ends = pa.chunked_array([*table["src"].chunks, *table["dst"].chunks]).combine_chunks().dictionary_encode()
        codes, names = ends.indices.to_numpy(zero_copy_only=False), ends.dictionary
        label = _joined(codes[: table.num_rows], codes[table.num_rows :], len(names))
        first = pa.table({"hub": label, "id": names}).group_by("hub").aggregate([("id", "min")])
        least = pc.equal(names, first["id_min"].combine_chunks().take(pc.index_in(pa.array(label), first["hub"].combine_chunks())))
        return pa.record_batch({"id": names, "hub": pa.array(label + base), "least": least}), base + len(names)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, base = [], 0, TaskContext.get().partitionId() << 40
        for rows in batches:
            held.append(rows)
            n += rows.num_rows
            if n >= batch:
                out, base = star(held, base)
                yield out
                held, n = [], 0
        if n:
            yield star(held, base)[0]

    return told


def weak_components(edges: DataFrame, batch: int = 4_000_000) -> DataFrame:
    """Least node of each weakly connected component: id, component.

    Links are read once: ``batch`` links of a partition at a time become the stars of their components, a row a node. A node that
    lies in several stars links their hubs, so what is left to join are numbers of hubs, few where links lie well or are many.
    """
    pairs = edges.filter("src is not null and dst is not null").select("src", "dst")
    kind = T.StructType([T.StructField("id", pairs.schema["src"].dataType), T.StructField("hub", T.LongType()), T.StructField("least", T.BooleanType())])
    # a node is once in a batch, so no node has many rows
    low = pairs.mapInArrow(_stars(batch), kind).withColumn("low", F.min("hub").over(Window.partitionBy("id")))
    kept = F.when((F.col("hub") == F.col("low")) | F.col("least"), F.col("id"))
    stars = saved(low.select(kept.alias("id"), "hub", "low", "least"), "stars")
    labels = _least_labels(stars.filter("hub <> low").select(F.col("hub").alias("src"), F.col("low").alias("dst")))
    of = lambda hub: labels.select(F.col("id").alias(hub), "label")
    named = stars.filter("least").join(of("hub"), "hub", "left").groupBy(F.coalesce("label", "hub").alias("label")).agg(F.min("id").alias("component"))
    return stars.filter("hub = low").join(of("low"), "low", "left").select("id", F.coalesce("label", "low").alias("label")).join(named, "label").select("id", "component")


def _least_labels(pairs: DataFrame) -> DataFrame:
    """Least node of each component of links (src, dst): id, label. Labels also jump to the label of their label each round.

    Jumping makes the rounds grow with the logarithm of the longest chain rather than with the chain.
    """
    both = saved(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    labels = start = saved(both.groupBy(F.col("src").alias("id")).agg(F.min(F.least("src", "dst")).alias("label")), "labels")
    while True:
        met = both.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("met"))
        # a label's own label is no worse, and the node it named takes the least that its members met
        low = saved(labels.join(met, "id").select("id", "label", F.least("label", "met").alias("low")), "low")
        lifted = low.groupBy(F.col("label").alias("id")).agg(F.min("low").alias("lifted"))
        hooked = saved(low.join(lifted, "id", "left").select("id", F.col("label").alias("was"), F.least("low", "lifted").alias("label")), "hooked")
        up = hooked.select(F.col("id").alias("label"), F.col("label").alias("up"))
        fresh = saved(hooked.join(up, "label").select("id", F.col("up").alias("label"), (F.col("up") < F.col("was")).alias("moved")), "jumped")
        labels = fresh.select("id", "label")
        for old in (low, hooked, start):
            dropped(old)
        start = fresh
        if fresh.filter("moved").isEmpty():
            dropped(both)
            return labels


def _least_both_ways(links: DataFrame, nodes: DataFrame, salt: int) -> DataFrame:
    """For each node the pivots of least rank that reach it and that it reaches: id, above, below.

    Ranks are hashes. Labels (way, id, rank, pivot) only fall. Besides a neighbour's label a node takes the label of its own
    pivot, as what reaches its pivot reaches it; so labels jump along chains and rounds grow with the logarithm of their length.
    """
    steps = saved(links.select(F.lit(0).alias("way"), "src", "dst").unionByName(links.select(F.lit(1).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"))), "steps")
    label = F.struct(F.xxhash64("id", F.lit(salt)).alias("rank"), F.col("id").alias("pivot"))
    labels = saved(nodes.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), "id", label.alias("label")), "labels")
    while True:
        met = steps.join(labels.select("way", F.col("id").alias("src"), "label"), ["way", "src"]).groupBy("way", F.col("dst").alias("id")).agg(F.min("label").alias("met"))
        near = labels.join(met, ["way", "id"], "left").select("way", "id", "label", F.least("label", "met").alias("low"))
        up = labels.select("way", F.col("id").alias("pivot"), F.col("label").alias("up"))
        jumped = near.withColumn("pivot", F.col("low.pivot")).join(up, ["way", "pivot"]).select("way", "id", F.least("low", "up").alias("fresh"), "label")
        fresh = saved(jumped.select("way", "id", F.col("fresh").alias("label"), (F.col("fresh") < F.col("label")).alias("moved")), "labels", instead_of=labels)
        labels = fresh
        if fresh.filter("moved").isEmpty():
            break
    dropped(steps)
    of = lambda way: F.max(F.when(F.col("way") == way, F.col("label.pivot")))
    out = saved(labels.groupBy("id").agg(of(0).alias("above"), of(1).alias("below")), "pivots")
    dropped(labels)
    return out


def strong_components(edges: DataFrame) -> DataFrame:
    """Least node of each strongly connected component: id, component, by random pivots forward and backward.

    Nodes that no link enters or leaves are components of their own and leave first. Of the rest each finds the pivot of least
    random rank that reaches it, and that it reaches: where these are the same, it is in the pivot's component. Nodes of one
    component agree in both pivots, so links between nodes that differ in one go, and what is left falls apart like a random
    search tree: rounds grow with the logarithm of the longest path.
    """
    links = saved(edges.filter("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), "links")
    nodes = saved(edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).filter("id is not null").distinct(), "nodes")
    found, left, number = [], nodes, 0
    while not links.isEmpty():
        number += 1
        ends = links.select(F.col("src").alias("id")).distinct().join(links.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        inner = saved(ends, "inner")
        trimmed = saved(links.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi"), "links", instead_of=links)
        pivots = _least_both_ways(trimmed, inner, number)
        found.append(saved(pivots.filter("above = below").select("id", F.col("above").alias("pivot")), "found"))
        of = lambda end: pivots.filter("above <> below").select(F.col("id").alias(end), F.struct("above", "below").alias(f"{end}_pivots"))  # noqa: B023, E731
        links = saved(trimmed.join(of("src"), "src").join(of("dst"), "dst").filter("src_pivots = dst_pivots").select("src", "dst"), "links", instead_of=trimmed)
        dropped(inner)
        dropped(pivots)
    done = reduce(DataFrame.unionByName, found, left.limit(0).select("id", F.col("id").alias("pivot")))
    least = done.groupBy("pivot").agg(F.min("id").alias("component"))
    named = done.join(least, "pivot").select("id", "component")
    return left.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
