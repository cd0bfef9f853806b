"""Feed control, counter and value-function queries bound to the driver's tables, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import values as vl
from skein.operators import biconnected
from skein.session import table
from skein.streaming import feeds
from skein.streaming import platform as pf


def _of(name: str, f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


_K = lambda: F.get_json_object("props", "$.k").cast("long")
_TAG = lambda: F.when(F.col("user_id") % 5 > 0, F.col("user_id").cast("string"))


def _batches(events: DataFrame) -> DataFrame:
    size = F.when(F.col("event_id") < 500, 120).otherwise(7)
    kind = F.when(F.col("event_type") == "click", F.lit("audit.click")).otherwise(F.col("event_type"))
    batched = events.withColumn("batch", F.concat_ws(":", size.cast("string"), F.floor(F.col("event_id") / size).cast("string")))
    return pf.valid_batches(batched, "batch", _K() != 13, pf.tagged(kind, F.lit("app"), _TAG())).select("event_id", "batch")


def _statuses(events: DataFrame) -> DataFrame:
    half = lambda keep: events.filter(keep).groupBy("user_id").agg(F.max(F.struct("event_id", "event_type"))["event_type"].alias("state"))
    return pf.status_changes(half("event_id % 3 <> 0"), half("event_id % 2 = 0"), "user_id", "state")


def _chain(events: DataFrame) -> DataFrame:
    return pf.hash_chain(events.select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type")).select("event_id", "prev", "hash")


def _dates(events: DataFrame) -> DataFrame:
    day = vl.today(F.col("ts"), "UTC")
    return events.select("event_id", day.alias("day"), vl.next_day(day).alias("next_day"), vl.next_month(day).alias("next_month"))


def _fences(events: DataFrame) -> DataFrame:
    payload = F.create_map(F.lit("k"), _K().cast("string"), F.lit("_schemaVersion"), F.when(_K() % 2 == 0, F.lit("2")).otherwise(F.lit("x")))
    made = pf.fenced(payload, F.col("event_id"))
    return events.select("event_id", pf.fence_of(made).alias("token"), pf.fence_of(payload).alias("none"), F.size(pf.unfenced(made)).cast("long").alias("n"), pf.schema_version(made).alias("version"))


_RINGS = lambda d: d.filter("event_id % 7 <> 0").select(F.col("event_id").alias("src"), (F.col("event_id") + 1).alias("dst")).unionByName(d.filter("event_id % 14 = 0 and event_id > 0").select(F.col("event_id").alias("src"), (F.col("event_id") - 6).alias("dst")))
_TIMES = lambda: F.when(F.col("event_id") % 4 > 0, F.unix_millis(F.col("ts").cast("timestamp"))).otherwise(F.lit(0))

QUERIES = {
    "b10_assistant_guard": _of("conversations", lambda d: d.select("conv_id", "turn", vl.assistant_query(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, F.lit(" limit 5")).otherwise(F.lit("")))).alias("ok"))),
    "b13_valid_batches": _of("events", _batches),
    "b14_stamped": _of("events", lambda d: pf.stamped(d.select("event_id", _TIMES().alias("at")), "at", F.lit(77).cast("long"))),
    "r3_replayed": _of("events", lambda d: pf.replayed(feeds.ring(d.filter("event_id < 900"), "event_id", most=100).select("event_id", "event_type"), d.filter("event_id >= 900").select("event_id", "event_type"), F.col("event_type") == "view")),
    "r5_counters": _of("events", lambda d: pf.counters(d, {"files": F.when(F.col("event_type") == "view", 1), "resolutions": F.when(F.col("event_type") == "click", 1), "queue": F.when(F.col("event_type") == "click", -5).otherwise(1)})),
    "r4_level_counts": _of("events", lambda d: pf.level_counts(d, F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.col("event_type")))),
    "t7_slow_renders": _of("events", lambda d: pf.slow_renders(d.select("event_id", "value"), "event_id", F.col("value"), 30.0)),
    "r11_hash_chain": _of("events", _chain),
    "r12_status_changes": _of("events", _statuses),
    "p21_bridges": _of("events", lambda d: biconnected.bridges(_RINGS(d))),
    "p22_articulation_points": _of("events", lambda d: biconnected.articulation_points(_RINGS(d))),
    "a7_adapters": _of("part", lambda d: d.select("p_partkey", vl.adapter(F.concat(F.when(F.col("p_size") % 3 == 0, F.lit("JDBC:Oracle:thin")).when(F.col("p_size") % 3 == 1, F.lit("jdbc:postgresql://")).otherwise(F.lit("http://x/")), F.when(F.col("p_size") % 5 == 0, F.lit("arcadedb")).otherwise(F.lit("")))).alias("adapter"))),
    "f11_hashes": _of("part", lambda d: d.select("p_partkey", vl.hashes(F.col("p_name")).alias("h")).select("p_partkey", "h.*")),
    "f12_payload": _of("events", lambda d: d.select("event_id", vl.payload_number(F.col("props"), "k").alias("k"), vl.payload_number(F.col("props"), "none", -1.0).alias("none"), vl.payload_text(F.col("props"), "k").alias("text"))),
    "f13_dates": _of("events", _dates),
    "f14_durations": _of("orders", lambda d: d.select("o_orderkey", vl.duration(F.col("o_orderkey") * 37).alias("took"))),
    "f16_error_classes": _of("part", lambda d: d.select("p_partkey", vl.error_class(F.lpad((F.col("p_size") * 17 % 100).cast("string"), 2, "0")).alias("what"))),
    "f18_fences": _of("events", _fences),
}

_KSQL = "(props ->> '$.k')::BIGINT"
_EDGES = "k AS (SELECT event_id AS a, event_id + 1 AS b FROM events WHERE event_id % 7 <> 0 UNION SELECT event_id - 6, event_id FROM events WHERE event_id % 14 = 0 AND event_id > 0), ring AS (SELECT event_id AS hi FROM events WHERE event_id % 14 = 0 AND event_id > 0), c AS (SELECT a, b FROM k WHERE b = a + 1 AND NOT EXISTS (SELECT 1 FROM ring WHERE a >= hi - 6 AND b <= hi))"
_BATCH = "CASE WHEN event_id < 500 THEN '120:' || event_id // 120 ELSE '7:' || event_id // 7 END"

ORACLES = {
    "b10_assistant_guard": "WITH t AS (SELECT conv_id, turn, lower(coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN ' limit 5' ELSE '' END) AS q FROM conversations) SELECT conv_id, turn, NOT regexp_matches(q, '(insert|update|delete|drop|create|truncate|alter|merge) ') AND contains(q, 'limit') AS ok FROM t",
    "b13_valid_batches": f"WITH t AS (SELECT event_id, event_type, user_id, {_BATCH} AS batch, coalesce({_KSQL} <> 13, false) AS well FROM events), g AS (SELECT batch FROM t GROUP BY batch HAVING count(*) <= 100 AND bool_and(well)) SELECT event_id, batch FROM t WHERE batch IN (SELECT batch FROM g) AND (event_type = 'click' OR user_id % 5 > 0)",
    "b14_stamped": "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN epoch_us(ts) // 1000 ELSE 77 END::BIGINT AS at FROM events",
    "r3_replayed": "SELECT event_id, event_type FROM events WHERE event_type = 'view' AND event_id >= 800",
    "r5_counters": "WITH t AS (SELECT count(*) FILTER (event_type = 'view') AS files, count(*) FILTER (event_type = 'click') AS resolutions, greatest(0, sum(CASE WHEN event_type = 'click' THEN -5 ELSE 1 END))::BIGINT AS queue FROM events) SELECT *, resolutions * 100.0::DOUBLE / files AS rate FROM t",
    "r4_level_counts": "SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, count(*) AS n FROM events GROUP BY 1",
    "t7_slow_renders": "SELECT event_id, value FROM events WHERE value >= 30 ORDER BY event_id DESC LIMIT 20",
    "r11_hash_chain": "WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), h AS (SELECT event_id, user_id, n, '' AS prev, sha256('|' || event_type) AS hash FROM o WHERE n = 1 UNION ALL SELECT o.event_id, o.user_id, o.n, h.hash, sha256(h.hash || '|' || o.event_type) FROM h JOIN o ON o.user_id = h.user_id AND o.n = h.n + 1) SELECT event_id, prev, hash FROM h",
    "r12_status_changes": "WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS s FROM events WHERE event_id % 3 <> 0 GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, event_id) AS s FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT user_id, a.s AS was, b.s AS now, CASE WHEN a.s IS NULL THEN 'new' WHEN b.s IS NULL THEN 'deleted' ELSE 'changed' END AS status FROM a FULL JOIN b USING (user_id) WHERE a.s IS DISTINCT FROM b.s",
    "p21_bridges": f"WITH {_EDGES} SELECT a AS u, b AS v FROM c",
    "p22_articulation_points": f"WITH {_EDGES} SELECT a AS id FROM c WHERE a IN (SELECT b FROM c)",
    "a7_adapters": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'oracle' WHEN 1 THEN 'postgresql' ELSE CASE WHEN p_size % 5 = 0 THEN 'arcadedb' END END AS adapter FROM part",
    "f11_hashes": "SELECT p_partkey, sha256(p_name) AS sha256, md5(p_name) AS md5, base64(p_name::BLOB) AS base64 FROM part",
    "f12_payload": f"SELECT event_id, {_KSQL}::DOUBLE AS k, -1.0::DOUBLE AS \"none\", props ->> '$.k' AS text FROM events",
    "f13_dates": "SELECT event_id, ts::DATE AS day, (ts::DATE + 1)::DATE AS next_day, (date_trunc('month', ts) + INTERVAL 1 MONTH)::DATE AS next_month FROM events",
    "f14_durations": "WITH t AS (SELECT o_orderkey, o_orderkey * 37 AS ms FROM orders) SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1f', round_even(ms / 1000, 1)) || 's' ELSE (ms // 60000) || 'm' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || 's' END AS took FROM t",
    "f16_error_classes": "SELECT p_partkey, CASE lpad((p_size * 17 % 100)::VARCHAR, 2, '0') WHEN '08' THEN 'CONNECTION' WHEN '28' THEN 'AUTHENTICATION' WHEN '42' THEN 'PERMISSION_OR_SYNTAX' WHEN '53' THEN 'RESOURCES' WHEN '57' THEN 'CANCELLED' ELSE 'OTHER' END AS what FROM part",
    "f18_fences": f"SELECT event_id, event_id AS token, NULL::BIGINT AS \"none\", 2::BIGINT AS n, CASE WHEN {_KSQL} % 2 = 0 THEN 2 ELSE 1 END::INT AS version FROM events",
}
