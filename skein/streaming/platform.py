"""Ingest, replay, counters and control of event feeds, for batch and streaming frames."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from skein.operators.explore import snapshot_diff

MOST_BATCH = 100
EXEMPT = ("platform.%", "audit.%")  # patterns of event types that need no tenant


def stamped(events: DataFrame, at: str, now: Column) -> DataFrame:
    """Events whose time is 0, negative or null take ``now``."""
    return events.withColumn(at, F.when(F.col(at) > 0, F.col(at)).otherwise(now))


def tagged(event_type: Column, component: Column, tenant: Column, internal: tuple[str, ...] = (), exempt_types: tuple[str, ...] = EXEMPT) -> Column:
    """Whether an event names its tenant, or is of a type (by LIKE patterns) or an internal component that need not."""
    exempt = F.coalesce(component.isin(*internal), F.lit(False)) if internal else F.lit(False)
    for pattern in exempt_types:
        exempt = exempt | F.coalesce(event_type.like(pattern), F.lit(False))
    return exempt | (F.trim(F.coalesce(tenant, F.lit(""))) != "")


def valid_batches(events: DataFrame, batch: str, well_formed: Column, has_tag: Column, most: int = MOST_BATCH) -> DataFrame:
    """Rows of the batches that may come in: none of a batch above ``most`` rows or with a malformed row; untagged rows are left out.

    Batches are counted first, so no batch is gathered; what joins them back is one row a batch.
    """
    judged = events.withColumn("_well", F.coalesce(well_formed, F.lit(False))).withColumn("_tag", F.coalesce(has_tag, F.lit(False)))
    good = judged.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"), F.bool_and("_well").alias("_all")).filter((F.col("_n") <= most) & F.col("_all")).select(batch)
    return judged.filter("_tag").join(good, batch, "left_semi").drop("_well", "_tag")


def replayed(history: DataFrame, live: DataFrame, test: Column) -> DataFrame:
    """What a new listener sees: the held events that fit, then the live ones. Both are batch frames, or both streams."""
    return history.filter(test).unionByName(live.filter(test))


def counters(events: DataFrame, amounts: dict[str, Column]) -> DataFrame:
    """One row of running totals, none below 0, and ``rate``: resolutions per hundred files, NaN without files."""
    summed = events.agg(*(F.greatest(F.lit(0).cast("long"), F.coalesce(F.sum(c), F.lit(0)).cast("long")).alias(n) for n, c in amounts.items()))
    if not {"resolutions", "files"} <= amounts.keys():
        return summed
    return summed.withColumn("rate", F.when(F.col("files") == 0, F.lit(float("nan"))).otherwise(F.col("resolutions") * 100.0 / F.col("files")))


def next_tokens(issued: DataFrame, token: str, wall_clock: int, n: int, gap: int = 1000) -> list[int]:
    """The next ``n`` tokens: above every issued one by ``gap``, and from the wall clock (ms) where none was issued."""
    top = issued.agg(F.max(token)).first()[0]
    first = wall_clock if top is None else top + gap
    return list(range(first, first + n))


def status_changes(before: DataFrame | None, now: DataFrame, key: str, value: str) -> DataFrame:
    """What changed since the last snapshot; the first one is only a baseline: key, was, now, status."""
    return snapshot_diff(now if before is None else before, now, key, value)


def level_counts(events: DataFrame, level: Column) -> DataFrame:
    """Events by level, unknown ones as INFO: level, n."""
    known = F.when(F.upper(level).isin("WARN", "ERROR"), F.upper(level)).otherwise("INFO")
    return events.groupBy(known.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def slow_renders(events: DataFrame, order: str, took: Column, least: float, most: int = 20) -> DataFrame:
    """The most recent renders that took at least ``least``, newest first."""
    return events.filter(took >= least).orderBy(F.desc(order)).limit(most)


def fenced(payload: Column, token: Column) -> Column:
    """A payload map with a fence token, replacing any it had."""
    return F.map_concat(F.map_filter(payload, lambda k, _: k != "_fenceToken"), F.create_map(F.lit("_fenceToken"), token.cast("string")))


def fence_of(payload: Column) -> Column:
    """The fence token of a payload map as a long, null where it has none or no number."""
    return F.element_at(payload, "_fenceToken").try_cast("long")


def unfenced(payload: Column) -> Column:
    return F.map_filter(payload, lambda k, _: k != "_fenceToken")


def schema_version(payload: Column, default: int = 1) -> Column:
    """Version a payload map names, ``default`` where it names none or no number."""
    return F.coalesce(F.element_at(payload, "_schemaVersion").try_cast("int"), F.lit(default))


def hash_chain(events: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """Adds ``prev`` and ``hash`` to the rows of each chain (key) in order: hash = sha256(prev | payload), prev of the first is ''.

    A hash needs the one before it, so a chain is one task's: its rows are sorted, spilling where they must, and streamed once,
    with one hash held between batches. A null payload has no hash, nor has what follows it.
    """
    sorted_ = events.withColumn("_payload", payload.cast("string")).repartition(key).sortWithinPartitions(key, order)
    schema = StructType([*events.schema, StructField("prev", StringType()), StructField("hash", StringType())])
    at = events.columns.index(key)

    def run(batches):
        chain, last = None, ""
        for batch in batches:
            before, hashes = [], []
            for own, text in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if chain is None or own != chain[0]:
                    chain, last = (own,), ""
                before.append(last)
                last = None if text is None or last is None else hashlib.sha256(f"{last}|{text}".encode()).hexdigest()
                hashes.append(last)
            names = [*batch.schema.names[:-1], "prev", "hash"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(before, pa.string()), pa.array(hashes, pa.string())], names)

    return sorted_.mapInArrow(run, schema)


def rate_gate(calls: DataFrame, key: str, at: str, order: str, exempt: Column, limits: tuple[tuple[int, int], ...] = ((1_000, 100), (60_000, 1_000))) -> DataFrame:
    """Adds ``allowed``: whether a call stays within all limits (window in ms, most) of its key.

    A window starts with the first call after the one before has run out; rejected calls count, exempt ones are allowed and do
    not. Null keys share ``default``. Calls (``at`` in ms) of a key are sorted, spilling where they must, and streamed once with a
    count and an end for each limit.
    """
    own = F.coalesce(F.col(key).cast("string"), F.lit("default"))
    sorted_ = calls.withColumns({"_own": own, "_exempt": F.coalesce(exempt, F.lit(False))}).repartition("_own").sortWithinPartitions("_own", at, order)
    when = calls.columns.index(at)

    def run(batches):
        tenant, state = None, []
        for batch in batches:
            allowed = []
            for who, now, free in zip(*(batch.column(i).to_pylist() for i in (batch.num_columns - 2, when, batch.num_columns - 1)), strict=True):
                if who != tenant:
                    tenant, state = who, [(0, None) for _ in limits]
                if free:
                    allowed.append(True)
                    continue
                state = [(1, now + span) if end is None or now > end else (n + 1, end) for (n, end), (span, _) in zip(state, limits, strict=True)]
                allowed.append(all(n <= most for (n, _), (_, most) in zip(state, limits, strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(allowed, pa.bool_())], [*batch.schema.names[:-2], "allowed"])

    return sorted_.mapInArrow(run, StructType([*calls.schema, StructField("allowed", BooleanType())]))
