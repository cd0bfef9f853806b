"""Streams: hand-over without loss or repeats, fences with bounded state, and days that agree with batch."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from skein.streaming import feeds
from skein.streaming import live as lv

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, token long, level string"


def rows(ids, seed=1):
    rng = random.Random(seed)
    made = {i: (i, T0 + dt.timedelta(minutes=i), i % 7, rng.randint(0, 6), rng.choice(["INFO", "warn", "ERROR", None])) for i in range(2000)}
    return [made[i] for i in ids]


def feed(spark, batches):
    """A stream of one file a batch, in order."""
    path = tempfile.mkdtemp(prefix="spark-feed-")
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/{n:03d}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def run(spark, out, name, mode="append"):
    query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-marks-")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect(), query


def test_each_event_comes_once_from_history_or_stream(spark):
    history = spark.createDataFrame(rows(i for i in range(600) if i not in (550, 580)), EVENTS)  # two came too late for it
    live = feed(spark, [rows(range(a, a + 100)) + rows(range(a - 30, a)) for a in range(500, 1500, 100)])
    got, query = run(spark, lv.beyond(live, history, "event_id", "ts", "120 MINUTES").select("event_id"), "handed")
    ids = [r.event_id for r in got]
    assert sorted(ids) == [550, 580, *range(600, 1500)]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) < 500


def test_empty_history_lets_everything_through(spark):
    live = feed(spark, [rows(range(20)), rows(range(10, 30))])
    got, _ = run(spark, lv.beyond(live, spark.createDataFrame([], EVENTS), "event_id", "ts", "10 HOURS").select("event_id"), "fresh")
    assert sorted(r.event_id for r in got) == list(range(30))


def test_fences_agree_with_batch_and_state_expires(spark):
    batches = [rows(range(a, a + 50)) for a in range(0, 400, 50)]
    got, _ = run(spark, lv.fence_stream(feed(spark, batches), "user_id", "token", "event_id", "ts", "1 hour"), "fences")
    batch = feeds.fence_gate(spark.createDataFrame([r for b in batches for r in b], EVENTS), "user_id", "token", "event_id").collect()
    assert {(r.event, r.decision) for r in got} == {(r.event_id, r.decision) for r in batch} and len(got) == 400
    once = [[(i, T0 + dt.timedelta(hours=4 * i), i, 5, None)] for i in range(8)]  # each key once, far apart
    _, query = run(spark, lv.fence_stream(feed(spark, once), "user_id", "token", "event_id", "ts", "1 hour", keep="2 hours"), "expiring")
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_days_of_batch_and_stream_agree(spark):
    own = rows(range(1800))
    level, session, key = F.col("level"), F.col("user_id") * 1000 + F.col("event_id") % 300, F.col("token")
    events = spark.createDataFrame(own, EVENTS)
    batch = lv.slice_totals(events, "ts", level, session), lv.slice_keys(events, "ts", key)
    for n, make in enumerate((lambda d: lv.slice_totals(d, "ts", level, session, late="1 hour"), lambda d: lv.slice_keys(d, "ts", key, late="1 hour"))):
        run(spark, make(feed(spark, [own[a : a + 200] for a in range(0, 1800, 200)])), f"slices{n}", "complete")
    now = F.lit(own[-1][1])
    days = [{(r.section, r.key): r.n for r in lv.day_summary(*pair, now).collect()} for pair in (batch, (spark.table("slices0"), spark.table("slices1")))]
    assert days[0] == days[1]
    inside = [r for r in own if r[1].replace(minute=0) > own[-1][1] - dt.timedelta(hours=24)]
    exact = len({r[2] * 1000 + r[0] % 300 for r in inside})
    assert days[0]["total", "total"] == len(inside) and abs(days[0]["total", "sessions"] - exact) <= 0.025 * exact
    assert days[0]["total", "warn"] == sum(r[4] == "warn" for r in inside)
