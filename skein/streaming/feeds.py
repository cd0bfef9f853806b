"""Bounded buffers, fences, polls and tenant counters of event feeds; arrival order is an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.streaming.events import CELL, prior_max

RING = 10_000
WINDOW_EVENTS = 5_000


def ring(events: DataFrame, order: str, since: Column | None = None, most: int = RING) -> DataFrame:
    """The newest ``most`` events, oldest evicted; of these the ones for which ``since`` holds."""
    held = events.orderBy(F.desc(order)).limit(most)
    return held if since is None else held.filter(since)


def recent_window(events: DataFrame, order: str, at: str, hours: int = 24, most: int = WINDOW_EVENTS) -> DataFrame:
    """The newest ``most`` events without the stale ones that arrived before the first fresh one.

    Fresh is less than ``hours`` before the latest time of all events. A stale event behind a fresh one stays.
    """
    held = events.orderBy(F.desc(order)).limit(most)
    now = events.agg(F.max(at).alias("_now"))  # one row
    fresh = held.join(F.broadcast(now)).withColumn("_fresh", F.col(at) >= F.col("_now") - F.expr(f"INTERVAL {hours} HOURS"))
    first = fresh.filter("_fresh").agg(F.min(order).alias("_first"))
    return fresh.join(F.broadcast(first)).filter(F.col(order) >= F.col("_first")).drop("_now", "_fresh", "_first")


def hot_keys(events: DataFrame, key: Column, most: int = 10) -> DataFrame:
    """The most frequent non-null keys: key, n."""
    return events.filter(key.isNotNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(most)


def fence_gate(events: DataFrame, key: str, token: str, order: str, cell: int = CELL) -> DataFrame:
    """Adds ``decision``: LEGACY (no token or 0), APPLY (above all seen), REPLAY (equal to the last one) or STALE (below)."""
    seen = F.coalesce("_prior", F.lit(0))
    decision = F.when(F.coalesce(F.col(token), F.lit(0)) == 0, "LEGACY").when(F.col(token) > seen, "APPLY").when(F.col(token) == seen, "REPLAY").otherwise("STALE")
    return prior_max(events, key, token, order, cell).withColumn("decision", decision).drop("_prior")


def first_writes(events: DataFrame, key: str, order: str = "event_id", late: str | None = None, at: str = "ts") -> DataFrame:
    """The row of each key that was written first, by ``order``. On streams, where arrival is the order, ``late`` bounds the state by event time."""
    if late:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    rest = [c for c in events.columns if c not in (key, order)]
    first = events.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_first"))
    return first.select(key, "_first.*").select(*events.columns)


def poll(events: DataFrame, at: str, order: str, since: tuple | None, page: int = 100) -> DataFrame:
    """The next page after the place (time, order) of the last row, oldest first; rows of one time are never skipped."""
    if since is not None:
        events = events.filter((F.col(at) > F.lit(since[0])) | ((F.col(at) == F.lit(since[0])) & (F.col(order) > F.lit(since[1]))))
    return events.orderBy(at, order).limit(page)


def visible_to(events: DataFrame, tenant: Column, name) -> DataFrame:
    """Events of a tenant and those of none."""
    return events.filter(tenant.isNull() | (tenant == F.lit(name)))


def tenant_counters(events: DataFrame, alias: Column, event_type: Column, rules: list[tuple[str, str]]) -> DataFrame:
    """Events of each tenant by counter: tenant, counter, n. The first rule (part of the type, counter) that fits counts.

    A null alias is ``_platform``; types no rule fits are not counted.
    """
    counter = F.coalesce(*(F.when(event_type.contains(part), F.lit(name)) for part, name in rules), F.lit(None).cast("string"))
    named = events.select(F.coalesce(alias.cast("string"), F.lit("_platform")).alias("tenant"), counter.alias("counter"))
    return named.filter("counter is not null").groupBy("tenant", "counter").agg(F.count(F.lit(1)).alias("n"))


def kept_after_purge(events: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """Events not older than the cutoff; those without a time stay."""
    return events.filter(F.col(at).isNull() | (F.col(at) >= cutoff))
