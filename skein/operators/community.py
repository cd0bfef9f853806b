"""Communities: by schema, and by modularity with local moving over contracted graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skein.session import dropped, saved


def by_schema(tables: DataFrame) -> DataFrame:
    """id, community of tables (id, scope): the schema that holds them, where one does."""
    return tables.filter("scope IS NOT NULL").select("id", F.col("scope").alias("community"))


def _both_ways(edges: DataFrame, weight: str | None) -> DataFrame:
    """Undirected weights (src, dst, w) in both directions; parallel edges add up and loops are left out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    kept = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst", w.alias("w"))
    return kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def modularity(links: DataFrame, of: DataFrame) -> float:
    """Modularity of communities (id, community) over weights in both directions (src, dst, w), loops counted once a direction."""
    total = links.agg(F.sum("w")).first()[0]
    if not total:
        return 0.0
    met = links.join(of.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    part = met.groupBy("a").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"))
    return part.agg(F.sum(F.col("inside") / total - F.pow(F.col("all") / total, F.lit(2)))).first()[0]


def _local_moving(links: DataFrame, rounds: int) -> tuple[DataFrame, float]:
    """Communities (id, community) that no single move betters much, and their modularity.

    In a round the nodes of one half, dealt anew by hash, each go to the neighbouring community of greatest gain; as not all
    move at once, neighbours do not trade places for ever. The best state is kept. Nodes carry their community's size, so a round
    joins the links once; the modularity of a state is observed by the round that begins with it.
    """
    total = links.agg(F.sum("w")).first()[0]
    degree = links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("loop"))
    state = saved(degree.select("id", F.col("id").alias("community"), "k", "loop", F.col("k").alias("size")), "communities")
    best, least, still = state, float("-inf"), 0
    outward = links.filter("src <> dst")
    other = F.col("community") != F.col("own")
    gain = F.col("near") - F.col("k") * F.col("size") / total
    for number in range(rounds + 1):
        to = outward.join(state.select(F.col("id").alias("dst"), "community", "size"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("near"), F.first("size").alias("size"))
        own = state.select("id", F.col("community").alias("own"), "k", "loop", F.col("size").alias("own_size"))
        weighed = own.join(to, "id", "left").groupBy("id").agg(
            F.max(F.when(other, F.struct(gain.alias("gain"), "community"))).alias("most"), F.coalesce(F.max(F.when(~other, F.col("near"))), F.lit(0.0)).alias("near"),
            *(F.first(c).alias(c) for c in ("own", "k", "loop", "own_size")),
        )
        # every node is weighed against its own community as well, which it may have no link to
        wants = F.coalesce(F.col("most.gain") > F.col("near") - F.col("k") * (F.col("own_size") - F.col("k")) / total, F.lit(False))
        may = F.pmod(F.xxhash64("id", F.lit(number)), F.lit(2)) == 0
        told = Observation()
        # a node's share of the squares of sizes is its degree times its community's size
        seen = weighed.withColumn("wants", wants).observe(told, F.sum(F.col("near") + F.col("loop")).alias("inside"), F.sum(F.col("k") * F.col("own_size")).alias("squares"), F.count(F.when(F.col("wants"), 1)).alias("moved"))
        moved = saved(seen.select("id", F.when(F.col("wants") & may, F.col("most.community")).otherwise(F.col("own")).alias("community"), "k", "loop"), "moved")
        found = told.get["inside"] / total - told.get["squares"] / total / total
        if found > least + 1e-9:
            if best is not state:
                dropped(best)
            best, least, still = state, found, 0
        else:
            still += 1
        if not told.get["moved"] or still >= 4 or number == rounds:
            dropped(moved)
            break
        size = moved.groupBy("community").agg(F.sum("k").alias("size"))
        fresh = saved(moved.join(size, "community").select("id", "community", "k", "loop", "size"), "communities", instead_of=moved)
        if state is not best:
            dropped(state)
        state = fresh
    return best.select("id", "community"), least


def _contracted(links: DataFrame, of: DataFrame) -> DataFrame:
    """Weights between communities (id, community), loops among them."""
    a, b = of.select(F.col("id").alias("src"), F.col("community").alias("a")), of.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    return links.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))


def _hung(links: DataFrame) -> DataFrame:
    """id, community of the nodes of weights in both directions: the neighbour of a node with a single one, else itself.

    Of two nodes that have but each other the lesser is the community.
    """
    near = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("head"))
    pendant = near.filter("n = 1").select(F.col("id").alias("head"), F.col("head").alias("back"))
    # pairs of pendants name each other; all other heads have more neighbours
    pairs = pendant.select(F.col("back").alias("id"), F.col("head").alias("other"))
    met = near.join(pairs, (near["n"] == 1) & (near["id"] == pairs["id"]) & (near["head"] == pairs["other"]), "left").select(near["id"], "n", "head", F.col("other").isNotNull().alias("paired"))
    return met.select("id", F.when((F.col("n") > 1) | (F.col("paired") & (F.col("id") < F.col("head"))), F.col("id")).otherwise(F.col("head")).alias("community"))


def by_modularity(edges: DataFrame, weight: str | None = None, rounds: int = 20, levels: int = 10, tolerance: float = 1e-6) -> DataFrame:
    """id, community of the nodes of undirected edges: communities are moved, contracted to nodes and moved again while modularity grows.

    A community is named by its least node. Loops do not count, parallel edges add up. Nodes with one neighbour only are contracted
    into it before the first level: no partition of greatest modularity has them apart, and rounds cost what is left. Rounds go over
    numbers of nodes.
    """
    base = saved(_both_ways(edges, weight), "weights")
    nodes = saved(base.select(F.col("src").alias("name")).distinct().withColumn("id", F.monotonically_increasing_id()), "nodes")
    of = lambda end: nodes.select(F.col("name").alias(end), F.col("id").alias(f"{end}_id"))
    base = saved(base.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "w"), "weights", instead_of=base)
    names = saved(_hung(base), "names")
    links = saved(_contracted(base, names), "contracted", instead_of=base)
    reached = modularity(links, names.select(F.col("community").alias("id"), "community").distinct())
    for _ in range(levels):
        if links.filter("src <> dst").isEmpty():
            break
        of, found = _local_moving(links, rounds)
        if found < reached + tolerance:
            break
        reached = found
        names = saved(names.join(of.select(F.col("id").alias("community"), F.col("community").alias("next")), "community").select("id", F.col("next").alias("community")), "names", instead_of=names)
        links = saved(_contracted(links, of), "contracted", instead_of=links)
    named = names.join(nodes, "id")
    least = named.groupBy("community").agg(F.min("name").alias("least"))
    return named.join(least, "community").select(F.col("name").alias("id"), F.col("least").alias("community"))
