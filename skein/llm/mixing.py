"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each source gets a target number of words; its documents share one expected number of copies, target / size of the
source. Copies are prefix-summed within the source, one random offset is added, and a document is emitted once for each
integer boundary its share of the sum crosses. Documents are laid out by size class, so the words taken come close to the
target: neighbours on the line are of like size.

The prefix sum is distributed. A document's place is the number of documents in earlier cells of its source plus its rank
in its own cell (source, size class, hash bucket); cells are counted first, so one source holding a third of all rows is
spread over many tasks, and only its bounded list of cells is ordered as a whole.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source of size 0 has target
0; repeated rows are separate documents; rows with equal size and doc_id are interchangeable; an empty table gives an
empty result; other columns pass through untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.textkernels import WORD
from skein.session import saved

WEIGHTS = (5, 2, 1)
BUCKETS = 256


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Eighths of an octave as sortable text: number of binary digits, then the three digits after the first."""
    digits = F.bin(size)
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.rpad(F.substring(digits, 2, 3), 3, "0"))


def hash_unit(text: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) for a string."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets for (source, source_size): ``share`` of all words by weight, none above ``cap`` times its source.

    Resharing the excess by weight until none is above ends where every target is min(cap * size, level * weight) for one
    level. In order of cap * size / weight the full sources come first, so the level is found where a source's own ratio
    reaches the level that is left for it and the rest.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = reduce(lambda rest, iw: F.when(F.col("turn") % len(weights) == iw[0], F.lit(float(iw[1]))).otherwise(rest), enumerate(weights), F.lit(None).cast("double"))
    sources = sources.withColumn("turn", turn).withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("full") / F.col("weight"), "turn")
    before, onward, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    sources = sources.withColumn("level", left / F.sum("weight").over(onward))
    sources = sources.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct(F.col("full") / F.col("weight"), "turn", "level"))).over(whole)["level"])
    return sources.select("source", "source_size", F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full"))).alias("target"))


def systematic_copies(sized: DataFrame, targets: DataFrame, seed: str = "mix-1") -> DataFrame:
    """Add source_size, target, copies and taken to rows (source, size, tie, ...)."""
    cells = ["source_key", "cls", "bucket"]
    rows = sized.withColumns({
        "source_key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
        "cls": size_class(F.col("size")),
        "bucket": F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("tie").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)),
    })
    line = Window.partitionBy("source_key").orderBy("cls", "bucket")
    starts = rows.groupBy(*cells).agg(F.count(F.lit(1)).alias("in_cell")).withColumn("start", F.sum("in_cell").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_cell"))
    per_source = targets.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("expected"),
        hash_unit(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))).alias("offset"),
    )
    place = F.col("start") + F.row_number().over(Window.partitionBy(*cells).orderBy("size", "tie"))
    upto = lambda k: F.floor(k * F.col("expected") + F.col("offset"))
    rows = rows.join(starts.join(per_source, "source_key").drop("in_cell"), cells).withColumn("place", place)
    rows = rows.withColumn("copies", upto(F.col("place")) - upto(F.col("place") - 1)).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.drop("cls", "bucket", "source_key", "start", "place", "expected", "offset")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``cap`` may be at most 2 for the promise that no document is taken more than twice.
    """
    sized = saved(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.col("doc_id").alias("tie")), "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    return systematic_copies(sized, targets).drop("tie")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with the columns of ``docs``.

    Copies are decided on narrow rows and joined back by (doc_id, text and source hash); rows that agree in these are
    interchangeable and share their copies evenly.
    """
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("at")
    key = F.xxhash64("text", "source", F.col("doc_id").isNull()).alias("key")
    sized = saved(docs.select(F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), at, key).withColumn("tie", F.concat_ws(":", "at", "key")), "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    copies = systematic_copies(sized, targets).groupBy("at", "key").agg(F.sum("copies").alias("all_copies"), F.count(F.lit(1)).alias("rows")).filter("all_copies > 0")
    upto = lambda k: F.floor(k * F.col("all_copies") / F.col("rows"))
    nth = F.row_number().over(Window.partitionBy("at", "key").orderBy("at"))
    # the row is nested, so that no column of it can clash
    joined = docs.select(F.struct(*docs.columns).alias("row"), at, key).join(copies, ["at", "key"]).withColumn("nth", nth)
    own = joined.withColumn("own", (upto(F.col("nth")) - upto(F.col("nth") - 1)).cast("int")).filter("own > 0")
    return own.select("row", F.explode(F.sequence(F.lit(1), F.col("own")))).select(*(F.col("row")[c].alias(c) for c in docs.columns))
