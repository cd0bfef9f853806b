"""Reports over plain frames: counts, qualities, usage and quotas, reconciliation, scored search and ordered windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from skein.session import dropped, saved


def value_counts(df: DataFrame, column: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Rows of each value; null and blank values count as ``unknown``: name, n."""
    name = F.when(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == "", F.lit(unknown)).otherwise(F.col(column).cast("string"))
    return df.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


def conditional_counts(df: DataFrame, key: str, **tests: Column) -> DataFrame:
    """Rows of each key, and how many of them pass each test: key, total, one column a test."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *(F.count(F.when(test, 1)).alias(name) for name, test in tests.items()))


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """part / whole as a double; ``empty`` where the whole is 0."""
    return F.when(whole == 0, F.lit(empty)).otherwise(part.cast("double") / whole)


def weighted_merge(df: DataFrame, key: str, rate: str, weight: str) -> DataFrame:
    """Rows, total weight and weighted mean of a rate (0.0 without weight) of each key: key, n, weight, rate."""
    total = F.sum(weight)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), total.alias("weight"), F.when(total == 0, F.lit(0.0)).otherwise(F.sum(F.col(rate) * F.col(weight)) / total).alias("rate"))


def members_sampled(df: DataFrame, key: str, name: str, sample: int = 5, limit: int = 50) -> DataFrame:
    """Keys with the most distinct names, and their least names: key, n, sample. No key's names are gathered whole."""
    names = df.select(key, name).distinct()
    counted = names.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(limit)
    ranked = names.join(F.broadcast(counted.select(key)), key, "left_semi").withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(name))).filter(F.col("r") <= sample)
    listed = ranked.groupBy(key).agg(F.concat_ws(",", F.sort_array(F.collect_list(name))).alias("sample"))
    return counted.join(listed, key).select(key, "n", "sample")


def token_estimate(text: Column) -> Column:
    """A quarter of the length, at least 1; 0 for an empty or null text."""
    length = F.coalesce(F.length(text), F.lit(0))
    return F.when(length == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(length / 4))).cast("long")


def cost_estimate(tokens_in: Column, tokens_out: Column, prompt: float, completion: float) -> Column:
    """Price of tokens at rates a thousand."""
    return tokens_in * prompt / 1000 + tokens_out * completion / 1000


def first_breach(*limits: tuple[str, Column, float]) -> Column:
    """Name of the first limit that a value reaches, in the given order; a limit of 0 is none."""
    met = [F.when(value >= most, F.lit(name)) for name, value, most in limits if most > 0]
    return F.coalesce(*met, F.lit(None).cast("string"))


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """What differs between two frames of unique keys: key, status (left_only, right_only, mismatch). Null keys are skipped."""
    side = lambda df, name: df.filter(F.col(key).isNotNull()).select(key, F.col(value).alias(name), F.lit(1).alias(f"in_{name}"))
    both = side(left, "l").join(side(right, "r"), key, "full_outer")
    status = F.when(F.col("in_r").isNull(), "left_only").when(F.col("in_l").isNull(), "right_only").when(~F.col("l").eqNullSafe(F.col("r")), "mismatch")
    return both.select(key, status.alias("status")).filter("status is not null")


def scored_search(branches: list[tuple[DataFrame, str, float]], pattern: str, limit: int) -> DataFrame:
    """Names of several frames (id, name) that hold a pattern: kind, id, name, score.

    Case is ignored and ``*`` stands for anything. Each branch keeps max(limit / 2, 10) rows, the whole the best ``limit``
    by score, then kind and name.
    """
    like = "%" + pattern.upper().replace("*", "%") + "%"
    each = max(limit // 2, 10)
    found = [df.filter(F.upper("name").like(like)).orderBy("name", "id").limit(each).select(F.lit(kind).alias("kind"), "id", "name", F.lit(score).alias("score")) for df, kind, score in branches]
    return reduce(DataFrame.unionByName, found).orderBy(F.desc("score"), "kind", "name", "id").limit(limit)


def file_name(schema: Column, name: Column, kind: Column) -> Column:
    """``schema__name.kind.sql`` in lower case, other characters as ``_``; a null schema is ``default``."""
    safe = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_")
    return F.concat(safe(F.coalesce(schema, F.lit("default"))), F.lit("__"), safe(name), F.lit("."), safe(kind), F.lit(".sql"))


def earliest(df: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """The row of each key that comes first, by a partial aggregate instead of a window."""
    return df.groupBy(*keys).agg(F.min(F.struct(order, *columns)).alias("first")).select(*keys, "first.*")


def latest(df: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """The row of each key that comes last."""
    return df.groupBy(*keys).agg(F.max(F.struct(order, *columns)).alias("last")).select(*keys, "last.*")


def ordinals(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Position of each name of a key by first appearance, from 1: key, name, ordinal."""
    seen = df.groupBy(key, name).agg(F.min(order).alias("at"))
    return seen.select(key, name, F.row_number().over(Window.partitionBy(key).orderBy("at", name)).alias("ordinal"))


def clipped_depth(df: DataFrame, key: str, order: str, step: Column, cell: int = 100_000) -> DataFrame:
    """Adds ``depth``: the running sum of steps that never falls below zero, by a numeric order.

    The order is cut into cells, so no task orders a whole key: sums and least sums of a key's earlier cells, one row each,
    carry over to the rows of a cell.
    """
    rows = df.withColumn("_step", step).withColumn("_cell", F.floor(F.col(order) / cell))
    so_far = Window.partitionBy(key, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_sum", F.sum("_step").over(so_far))
    cells = summed.groupBy(key, "_cell").agg(F.sum("_step").alias("_total"), F.min("_sum").alias("_low"))
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    cells = cells.withColumn("_least", F.min(F.col("_before") + F.col("_low")).over(earlier))
    met = summed.join(cells.select(F.col(key).alias("_key"), F.col("_cell").alias("_at"), "_before", "_least"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cell") == F.col("_at")))
    total = F.col("_before") + F.col("_sum")
    least = F.least(F.lit(0), F.col("_least"), F.min(total).over(so_far))
    return met.withColumn("depth", total - least).drop("_step", "_cell", "_sum", "_key", "_at", "_before", "_least")


def rate_limited(df: DataFrame, key: str, order: str, at: str, unit: str, most: int) -> DataFrame:
    """Adds ``allowed``: whether a call is among the first ``most`` of its key's fixed window; rejected calls count too."""
    frame = Window.partitionBy(key, F.date_trunc(unit, at)).orderBy(order)
    return df.withColumn("allowed", F.row_number().over(frame) <= most)


def chain_breaks(df: DataFrame, key: str, order: str, payload: Column, previous: str, stored: str, cell: int = 100_000) -> DataFrame:
    """Links of a hash chain that do not hold: the stored hash is not that of previous and payload, or previous is not the hash before.

    The order, a number, is cut into cells; the first link of a cell is held against the last one of the key's cell before.
    """
    rows = df.withColumn("_cell", F.floor(F.col(order) / cell))
    last = rows.groupBy(F.col(key).alias("_key"), F.col("_cell").alias("_at")).agg(F.max_by(stored, order).alias("_last"))
    last = last.select("_key", "_at", F.lag("_last", 1, "").over(Window.partitionBy("_key").orderBy("_at")).alias("_carried"))
    met = rows.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cell") == F.col("_at")))
    own = Window.partitionBy(key, "_cell").orderBy(order)
    before = F.when(F.row_number().over(own) == 1, F.col("_carried")).otherwise(F.lag(stored).over(own))
    fresh = F.sha2(F.concat(F.col(previous), F.lit("|"), payload), 256)
    return met.withColumn("_broken", (fresh != F.col(stored)) | (F.col(previous) != before)).filter("_broken").select(*df.columns)


def _packed(n: int, most: int = 4_000_000):
    """Links between numbered nodes (src_block, src_at, dst_block, dst_at) as arrays of positions in bytes, by pairs of ``n`` blocks: cell, src, dst."""

    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        of = {name: rows[name].to_numpy() for name in rows.column_names}
        cell = of["dst_block"] * n + of["src_block"]
        order = np.argsort(cell, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            yield pa.record_batch({"cell": [int(cell[part[0]])], "src": [of["src_at"][part].tobytes()], "dst": [of["dst_at"][part].tobytes()]}, _CELLS)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield from pack(held)
                held, rows = [], 0
        if rows:
            yield from pack(held)

    return packed


_CELLS = pa.schema([("cell", pa.int32()), ("src", pa.binary()), ("dst", pa.binary())])
_GIVEN = pa.schema([("block", pa.int32()), ("given", pa.binary())])
_SCORES = pa.schema([("block", pa.int32()), ("score", pa.binary()), ("share", pa.binary()), ("n_out", pa.binary()), ("held", pa.float64()), ("moved", pa.float64())])
_DDL = {"cells": "cell int, src binary, dst binary", "given": "block int, given binary", "scores": "block int, score binary, share binary, n_out binary, held double, moved double"}


def _scored(block: int, score: np.ndarray, n_out: np.ndarray, moved: float) -> pa.Table:
    """A block's scores, what each node gives over a link, what dangling nodes hold and how far scores moved."""
    share = np.divide(score, n_out, out=np.zeros(len(score)), where=n_out > 0)
    return pa.table([[block], [score.tobytes()], [share.tobytes()], [n_out.tobytes()], [float(score[n_out == 0].sum())], [moved]], schema=_SCORES)


def _given(n: int, sizes: dict[int, int]):
    """What the nodes of one block give to those of another: block, given."""

    def give(links: pa.Table, sent: pa.Table) -> pa.Table:
        if not links.num_rows:
            return _GIVEN.empty_table()
        block, share = links["cell"][0].as_py() // n, np.frombuffer(sent["share"][0].as_buffer())
        given = np.zeros(sizes[block])
        for src, dst in zip(links["src"], links["dst"], strict=True):
            given += np.bincount(np.frombuffer(dst.as_buffer(), np.int32), share[np.frombuffer(src.as_buffer(), np.int32)], len(given))
        return pa.table([[block], [given.tobytes()]], schema=_GIVEN)

    return give


def _rescored(damping: float, dealt: float):
    """A block's next scores from what is given to it."""

    def score(old: pa.Table, given: pa.Table) -> pa.Table:
        was, n_out = np.frombuffer(old["score"][0].as_buffer()), np.frombuffer(old["n_out"][0].as_buffer(), np.int64)
        fresh = (1 - damping) + damping * (sum((np.frombuffer(g.as_buffer()) for g in given["given"]), np.zeros(len(was))) + dealt)
        return _scored(old["block"][0].as_py(), fresh, n_out, float(np.abs(fresh - was).sum()))

    return score


def _first_scores(nodes: pa.Table) -> pa.Table:
    n_out = np.zeros(nodes.num_rows, np.int64)
    n_out[nodes["at"].to_numpy()] = nodes["n_out"].to_numpy()
    return _scored(nodes["block"][0].as_py(), np.ones(len(n_out)), n_out, 0.0)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, score in zip(batch["block"], batch["score"], strict=True):
            scores = np.frombuffer(score.as_buffer())
            for at in range(0, len(scores), 100_000):
                some = scores[at : at + 100_000]
                yield pa.record_batch({"block": np.full(len(some), block.as_py(), np.int32), "at": np.arange(at, at + len(some), dtype=np.int32), "score": some})


def page_rank(edges: DataFrame, rounds: int | None = None, damping: float = 0.85, tolerance: float = 1e-6, block: int = 2_000_000) -> DataFrame:
    """Scores (id, score) over distinct edges (src, dst), at a mean of 1: what dangling nodes hold is dealt out evenly.

    Rounds go on until scores move by less than ``tolerance`` on the mean, or for a given number. A round multiplies a matrix in
    blocks with a vector: nodes are numbered in at least four blocks of about ``block``, links lie by pairs of blocks and stay where
    they are, and what is shuffled are blocks' scores, once a pair of blocks, and what the pairs sum up to.
    """
    links = saved(edges.filter("src IS NOT NULL").select("src", "dst").distinct(), "links")
    out = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    nodes = saved(links.select(F.col("dst").alias("id")).distinct().join(out, "id", "full_outer").select("id", F.coalesce("n_out", F.lit(0)).alias("n_out")), "nodes")
    count, k = nodes.count(), 0
    n = max(4, -(-count // block))
    number = F.monotonically_increasing_id()
    placed = nodes.repartition(n, "id").select("id", "n_out", F.shiftright(number, 33).cast("int").alias("block"), number.bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("at"))
    nodes = saved(placed, "numbered", instead_of=nodes)
    sizes = {b: size for b, size in nodes.groupBy("block").count().collect()}  # one row a block
    of = lambda end: nodes.select(F.col("id").alias(f"{end}_id"), F.col("block").alias(f"{end}_block"), F.col("at").alias(f"{end}_at"))
    met = links.join(of("src"), F.col("src") == F.col("src_id")).join(of("dst"), F.col("dst").eqNullSafe(F.col("dst_id"))).select("src_block", "src_at", "dst_block", "dst_at")
    cells = met.mapInArrow(_packed(n), _DDL["cells"]).repartition(8 * n * n, "cell").persist(StorageLevel.DISK_ONLY)

    def written(frame: DataFrame, instead_of: DataFrame | None = None) -> tuple[DataFrame, float, float]:
        """The scores of a round, what dangling nodes hold and how far scores moved; both are observed by the write."""
        told = Observation()
        out = saved(frame.observe(told, F.sum("held").alias("held"), F.sum("moved").alias("moved")), "scores", instead_of=instead_of)
        return out, told.get["held"] or 0.0, told.get["moved"] or 0.0

    scores, lost, _ = written(nodes.groupBy("block").applyInArrow(_first_scores, _DDL["scores"]))
    while count and (rounds is None or k < rounds):
        k += 1
        sent = scores.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: b * n + F.col("block"))).alias("cell"), "share")
        given = cells.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(_given(n, sizes), _DDL["given"])
        fresh = scores.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_rescored(damping, lost / count), _DDL["scores"])
        scores, lost, change = written(fresh, scores)
        if rounds is None and change < tolerance * count:
            break
    cells.unpersist()
    dropped(links)
    return nodes.join(scores.mapInArrow(_unpacked, "block int, at int, score double"), ["block", "at"]).select("id", "score")
