"""Event-stream operators that hold for batch and streaming frames of (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("INFO", "WARN", "ERROR")


def level_at_least(level: Column, least: str) -> Column:
    """Whether a level reaches another; unknown levels count as INFO."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.upper(level))
    return F.greatest(F.coalesce(rank, F.lit(0)), F.lit(1)) >= LEVELS.index(least) + 1


def event_filter(events: DataFrame, least_level: str | None = None, **equal) -> DataFrame:
    """Events that satisfy all given keys; a key that is None is not asked for."""
    tests = [F.col(k) == v for k, v in equal.items() if v is not None]
    if least_level is not None:
        tests.append(level_at_least(F.col("level"), least_level))
    return events.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


CELL = 100_000  # of the order, so that no task orders a whole key


def prior_max(df: DataFrame, key: str, value: str, order: str, cell: int = CELL) -> DataFrame:
    """Adds ``_prior``: the largest value of the key before a row, null where there is none.

    The order (a number) is cut into cells: the rows of one key and cell are ordered, and what came before is the maximum of
    the key's earlier cells, of which there is one row each. A key with a third of all rows is spread over its cells.
    """
    rows = df.withColumn("_cell", F.floor(F.col(order) / cell))
    cells = rows.groupBy(key, "_cell").agg(F.max(value).alias("_most"))
    earlier = F.max("_most").over(Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    met = rows.join(cells.select(F.col(key).alias("_key"), F.col("_cell").alias("_at"), earlier.alias("_earlier")), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cell") == F.col("_at")))
    own = F.max(value).over(Window.partitionBy(key, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return met.withColumn("_prior", F.greatest("_earlier", own)).drop("_cell", "_key", "_at", "_earlier")


def fence_decisions(events: DataFrame, key: str, token: str, order: str, cell: int = CELL) -> DataFrame:
    """Adds ``accepted``: whether a token is at least the largest one of its key so far."""
    return prior_max(events, key, token, order, cell).withColumn("accepted", F.col(token) >= F.coalesce("_prior", F.col(token))).drop("_prior")


def top_and_rest(counts: DataFrame, key: str, value: str, top: int) -> DataFrame:
    """The largest keys, and the others summed in one row named ``rest``: key, value.

    The top is found without ordering all keys in one task; the rest is one more aggregate.
    """
    best = counts.orderBy(F.desc(value), key).limit(top).select(F.col(key).cast("string").alias(key), value)
    rest = counts.join(best.select(F.col(key).alias("top_key")), F.col(key).cast("string") == F.col("top_key"), "left_anti")
    return best.unionByName(rest.agg(F.sum(value).alias(value)).select(F.lit("rest").alias(key), value).filter(F.col(value).isNotNull()))


def sliding_counts(events: DataFrame, key: str, length: str, slide: str, late: str | None = None) -> DataFrame:
    """Events for each key and sliding window: window_start, key, n, total. ``late`` sets a watermark for streams."""
    timed = events.withWatermark("ts", late) if late else events
    return timed.groupBy(F.window("ts", length, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")
