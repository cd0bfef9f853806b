"""Report queries bound to the driver's tables, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import reports as rp
from skein.session import table
from skein.streaming.platform import hash_chain


def _of(name: str, f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


def _usage(conversations: DataFrame) -> DataFrame:
    tokens = rp.token_estimate(F.col("text"))
    by = conversations.groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "user", tokens).otherwise(0)).alias("tokens_in"), F.sum(F.when(F.col("role") == "user", 0).otherwise(tokens)).alias("tokens_out"))
    return by.withColumn("cost", rp.cost_estimate(F.col("tokens_in"), F.col("tokens_out"), 3.0, 15.0))


def _quota(conversations: DataFrame) -> DataFrame:
    breach = rp.first_breach(("tokens", F.col("tokens_in") + F.col("tokens_out"), 400), ("cost", F.col("cost"), 2.0), ("calls", F.lit(1), 0))
    return _usage(conversations).select("conv_id", breach.alias("breach"))


def _reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 500).cast("int").alias("v"))
    return rp.reconcile(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("v")), "doc_id", "v")


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, key, label: table(spark, sf_dir, name).select(F.col(key).cast("string").alias("id"), F.col(label).alias("name"))
    return rp.scored_search([(one("customer", "c_custkey", "c_name"), "customer", 1.0), (one("supplier", "s_suppkey", "s_name"), "supplier", 0.9), (one("nation", "n_nationkey", "n_name"), "nation", 0.8)], "r*0", 40)


def _chain(events: DataFrame) -> DataFrame:
    """Users' chains, of which every tenth event and the stored hash of every fifteenth was altered afterwards."""
    payload = F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("event_type"))
    made = hash_chain(events.select("event_id", "user_id", "event_type"), "user_id", "event_id", payload)
    kind = F.when(F.col("event_id") % 10 == 0, F.lit("altered")).otherwise(F.col("event_type"))
    stored = F.when(F.col("event_id") % 15 == 7, F.lit("altered")).otherwise(F.col("hash"))
    return rp.chain_breaks(made.withColumns({"event_type": kind, "hash": stored}), "user_id", "event_id", payload, "prev", "hash").select("event_id")


def _status(df: DataFrame) -> DataFrame:
    return rp.conditional_counts(df, "l_suppkey", resolved=F.col("l_returnflag") == "R", constant=F.col("l_returnflag") == "A", failed=F.col("l_linestatus") == "O")


_LINKS = lambda df: df.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))

QUERIES = {
    "g8_counts_by_context": _of("events", lambda d: rp.value_counts(d, "event_type")),
    "g6_conditional_counts": _of("lineitem", _status),
    "g17_quality": _of("lineitem", lambda d: _status(d).select("l_suppkey", rp.ratio(F.col("resolved") + F.col("constant"), F.col("total"), 0.0).alias("quality"))),
    "g18_resolution_rate": _of("lineitem", lambda d: _status(d).select("l_suppkey", rp.ratio(F.col("resolved"), F.col("resolved") + F.col("failed"), 1.0).alias("rate"))),
    "g19_session_merge": _of("lineitem", lambda d: rp.weighted_merge(d.select("l_returnflag", F.col("l_discount").cast("double").alias("rate"), F.col("l_linenumber").cast("long").alias("atoms")), "l_returnflag", "rate", "atoms")),
    "g2_members_sampled": _of("part", lambda d: rp.members_sampled(d, "p_brand", "p_name")),
    "g22_usage": _of("conversations", _usage),
    "g23_quota": _of("conversations", _quota),
    "g25_token_estimate": _of("documents", lambda d: d.select("doc_id", rp.token_estimate(F.col("text")).alias("tokens"))),
    "j11_reconcile": _reconcile,
    "t4_scored_search": _search,
    "t8_latest": _of("events", lambda d: rp.latest(d, ["user_id"], "event_id", "event_type")),
    "w2_first_wins": _of("events", lambda d: rp.earliest(d, ["user_id", "event_type"], "event_id", "value")),
    "w4_chain_breaks": _of("events", _chain),
    "w5_clipped_depth": _of("events", lambda d: rp.clipped_depth(d, "user_id", "event_id", F.when(F.col("event_type") == "purchase", 1).otherwise(-1)).select("event_id", "depth")),
    "w6_ordinals": _of("events", lambda d: rp.ordinals(d, "user_id", "event_type", "event_id")),
    "r14_rate_limit": _of("events", lambda d: rp.rate_limited(d, "user_id", "event_id", "ts", "day", 2).select("event_id", "allowed")),
    "a8_file_name": _of("part", lambda d: d.select("p_partkey", rp.file_name(F.col("p_brand"), F.col("p_name"), F.lit("TABLE")).alias("file"))),
    "p17_page_rank": _of("lineitem", lambda d: rp.page_rank(_LINKS(d).union(_LINKS(d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))), 20)),
}

_STATUS = "s AS (SELECT l_suppkey, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS resolved, count(*) FILTER (l_returnflag = 'A') AS constant, count(*) FILTER (l_linestatus = 'O') AS failed FROM lineitem GROUP BY l_suppkey)"
_TOKENS = "CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END"
_USAGE = f"u AS (SELECT conv_id, sum(CASE WHEN role = 'user' THEN {_TOKENS} ELSE 0 END)::BIGINT AS tokens_in, sum(CASE WHEN role = 'user' THEN 0 ELSE {_TOKENS} END)::BIGINT AS tokens_out FROM conversations GROUP BY conv_id), c AS (SELECT *, tokens_in * 3.0::DOUBLE / 1000 + tokens_out * 15.0::DOUBLE / 1000 AS cost FROM u)"
_NAMED = " UNION ALL ".join(f"(SELECT '{kind}' AS kind, {key}::VARCHAR AS id, {name} AS name, {score}::DOUBLE AS score FROM {kind} WHERE upper({name}) LIKE '%R%0%' ORDER BY name, id LIMIT 20)" for kind, key, name, score in (("customer", "c_custkey", "c_name", 1.0), ("supplier", "s_suppkey", "s_name", 0.9), ("nation", "n_nationkey", "n_name", 0.8)))


def _rank_sql(rounds: int) -> str:
    """Every node has a link out, so nothing dangles."""
    sql = "WITH f AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), k AS (SELECT src, dst FROM f UNION SELECT dst, src FROM f), l AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM k), r0 AS MATERIALIZED (SELECT DISTINCT src AS id, 1.0::DOUBLE AS score FROM k)"
    for i in range(rounds):
        sql += f", r{i + 1} AS MATERIALIZED (SELECT dst AS id, 0.15::DOUBLE + 0.85::DOUBLE * sum(score / n) AS score FROM l JOIN r{i} ON id = src GROUP BY dst)"
    return f"{sql} SELECT id, score FROM r{rounds}"


ORACLES = {
    "g8_counts_by_context": "SELECT coalesce(nullif(trim(event_type), ''), 'UNKNOWN') AS name, count(*) AS n FROM events GROUP BY 1",
    "g6_conditional_counts": f"WITH {_STATUS} SELECT * FROM s",
    "g17_quality": f"WITH {_STATUS} SELECT l_suppkey, (resolved + constant)::DOUBLE / total AS quality FROM s",
    "g18_resolution_rate": f"WITH {_STATUS} SELECT l_suppkey, CASE WHEN resolved + failed = 0 THEN 1.0 ELSE resolved::DOUBLE / (resolved + failed) END AS rate FROM s",
    "g19_session_merge": "SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS weight, sum(l_discount::DOUBLE * l_linenumber) / sum(l_linenumber) AS rate FROM lineitem GROUP BY 1",
    "g2_members_sampled": "WITH d AS (SELECT DISTINCT p_brand, p_name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM d) SELECT p_brand, max(n) AS n, string_agg(p_name, ',' ORDER BY p_name) FILTER (r <= 5) AS sample FROM r GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 50",
    "g22_usage": f"WITH {_USAGE} SELECT * FROM c",
    "g23_quota": f"WITH {_USAGE} SELECT conv_id, CASE WHEN tokens_in + tokens_out >= 400 THEN 'tokens' WHEN cost >= 2.0 THEN 'cost' END AS breach FROM c",
    "g25_token_estimate": f"SELECT doc_id, ({_TOKENS})::BIGINT AS tokens FROM documents",
    "j11_reconcile": "SELECT doc_id, status FROM (SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' WHEN (length(text) > 500)::INT IS DISTINCT FROM quality THEN 'mismatch' END AS status FROM documents d FULL JOIN labels l USING (doc_id)) WHERE status IS NOT NULL",
    "t4_scored_search": f"SELECT * FROM ({_NAMED}) ORDER BY score DESC, kind, name, id LIMIT 40",
    "t8_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "w2_first_wins": "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL",
    "w4_chain_breaks": "SELECT event_id FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_id % 10 = 0 OR event_id % 15 = 7 OR before % 15 = 7",
    "w5_clipped_depth": "WITH s AS (SELECT event_id, user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events) SELECT event_id, (t - least(0, min(t) OVER (PARTITION BY user_id ORDER BY event_id)))::BIGINT AS depth FROM s",
    "w6_ordinals": "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id), event_type) AS ordinal FROM events GROUP BY user_id, event_type",
    "r14_rate_limit": "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id) <= 2 AS allowed FROM events",
    "a8_file_name": "SELECT p_partkey, regexp_replace(lower(coalesce(p_brand, 'default')), '[^a-z0-9_]', '_', 'g') || '__' || regexp_replace(lower(p_name), '[^a-z0-9_]', '_', 'g') || '.table.sql' AS file FROM part",
    "p17_page_rank": _rank_sql(20),
}
