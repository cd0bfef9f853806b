"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest capacity are cut into pieces of that capacity and a rest; other documents stay whole.
Pieces are dealt into shards of a bounded number of pieces by hash, and each shard is packed by itself, so packing is one
shuffle of narrow rows and no task holds more than its shard. Within a shard the pieces are placed in descending size:

* into the open bin with the least remaining room that still holds the piece (best fit);
* else a new bin is opened at the capacity of least cost per expected token: cost(c) = c + quadratic * c * c / largest,
  over the room that bins of that capacity have come to fill so far, at least the piece itself;
* at last every bin is downsized to the least permitted capacity that holds its contents.

Two plans are made for each shard, one opening by that rule and one always opening the largest capacity, and the one with
the lower total cost is taken: the capacities are optimised jointly and never come out worse than packing for one.

Defined cases: documents without words (null or empty text) make no piece; repeated rows are separate items; a null
doc_id is packed like any other; an empty table gives an empty result; other columns are ignored. Equal pieces are
interchangeable, and placement is a function of sizes and ids alone, so reruns agree.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.mixing import n_words
from skein.session import saved

CAPACITIES = (256, 512, 1024, 2048, 4096)
SHARD_PIECES = 16384


def cost(capacity: int, largest: int, quadratic: float) -> float:
    """Compute of one sequence: linear layers and attention."""
    return capacity + quadratic * capacity * capacity / largest


def best_fit(sizes: list[int], capacities: tuple[int, ...], quadratic: float, joint: bool) -> tuple[list[int], list[int]]:
    """Bin number of each size (given in descending order) and the contents of each bin."""
    largest = capacities[-1]
    prices = [cost(c, largest, quadratic) for c in capacities]
    filled, opened = [0.0] * len(capacities), [0] * len(capacities)
    room: list[tuple[int, int]] = []  # (room, bin), ascending
    at, used, of = [], [], []
    for size in sizes:
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, number = room.pop(k)
            filled[of[number]] += size
        else:
            fits = bisect_left(capacities, size)
            if joint:
                # expected contents: the mean fill of this capacity so far, or the whole of it before it is known
                expect = lambda c: max(size, filled[c] / opened[c] if opened[c] >= 8 else capacities[c])  # noqa: B023, E731
                kind = min(range(fits, len(capacities)), key=lambda c: (prices[c] / expect(c), c))
            else:
                kind = len(capacities) - 1
            left, number = capacities[kind], len(used)
            used.append(0)
            of.append(kind)
            opened[kind] += 1
            filled[kind] += size
        at.append(number)
        used[number] += size
        if left > size:
            insort(room, (left - size, number))
    return at, used


def pack_sizes(sizes: np.ndarray, capacities: tuple[int, ...], quadratic: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sizes in descending order: bin of each, its offset there, and the capacity of each bin."""
    plans = []
    for joint in (True, False):
        at, used = best_fit(sizes.tolist(), capacities, quadratic, joint)
        final = [capacities[bisect_left(capacities, u)] for u in used]
        plans.append((sum(cost(c, capacities[-1], quadratic) for c in final), at, final))
    _, at, final = min(plans, key=lambda p: p[0])
    at = np.asarray(at, dtype=np.int64)
    order = np.argsort(at, kind="stable")
    run = np.cumsum(sizes[order]) - sizes[order]
    first = np.r_[True, at[order][1:] != at[order][:-1]]
    offset = np.empty(len(at), dtype=np.int64)
    offset[order] = run - np.repeat(run[first], np.diff(np.r_[np.flatnonzero(first), len(at)]))
    return at, offset, np.asarray(final, dtype=np.int64)


def _pack_shard(capacities: tuple[int, ...], quadratic: float):
    def run(shard: pa.Table) -> pa.Table:
        # Arrow keeps ids next to nulls as they are; nulls come first among equal sizes
        shard = shard.take(pc.sort_indices(shard, [("length", "descending"), ("doc_id", "ascending"), ("copy", "ascending"), ("piece", "ascending")], null_placement="at_start"))
        length = shard["length"].to_numpy()
        at, offset, final = pack_sizes(length, capacities, quadratic)
        used = np.bincount(at, weights=length, minlength=len(final)).astype(np.int64)
        for name, values in (("bin", at), ("at", offset), ("capacity", final[at]), ("in_bin", used[at])):
            shard = shard.append_column(name, pa.array(values, pa.int64()))
        return shard

    return run


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, quadratic: float = 0.25, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, copy, piece, start, length, shard, bin, at, capacity, in_bin.

    ``start`` and ``length`` are words of the document, ``at`` is the offset in the bin, which is named by (shard, bin);
    ``copy`` tells repeated rows of one doc_id and size apart.
    """
    capacities = tuple(sorted(set(capacities)))
    if not capacities or capacities[0] < 1:
        raise ValueError("capacities must be positive")
    largest = capacities[-1]
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col("text").cast("string")).alias("size")).filter("size > 0")
    # repeated rows are counted before they are dealt out, so one doc_id on many rows is spread as well
    counted = saved(sized.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    pieces = F.ceil(F.col("size") / largest)
    total = counted.agg(F.sum(F.col("copies") * pieces)).first()[0] or 0
    shards = -(-total // shard_pieces) or 1
    copies = counted.select("doc_id", "size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    cut = copies.select("doc_id", "size", "copy", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("long"))).alias("piece"))
    start = F.col("piece") * largest
    dealt = cut.select("doc_id", "copy", "piece", start.alias("start"), F.least(F.lit(largest), F.col("size") - start).alias("length"), F.pmod(F.xxhash64("doc_id", "size", "copy", "piece"), F.lit(shards)).alias("shard"))
    out = "doc_id long, copy long, piece long, start long, length long, shard long, bin long, at long, capacity long, in_bin long"
    return dealt.groupBy("shard").applyInArrow(_pack_shard(capacities, quadratic), out)
