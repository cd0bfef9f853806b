"""Guard and price queries bound to the driver's tables, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import guards as gd
from skein.operators import reports as rp
from skein.session import table

PRICES = [("user", 3.0), ("assistant", 15.0)]


def _of(name: str, f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each turn by its role's price; roles without a price cost 0."""
    prices = spark.createDataFrame(PRICES, "role string, price double")  # a fixed list of two rows
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", rp.token_estimate(F.col("text")).alias("tokens"))
    return turns.join(F.broadcast(prices), "role", "left").select("conv_id", "turn", F.coalesce(F.col("tokens") * F.col("price") / 1000, F.lit(0.0)).alias("cost"))


def _approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    tokens = rp.token_estimate(F.col("text"))
    return turns.select("conv_id", "turn", gd.approval(gd.has_word(F.col("text"), ("the",)), F.col("role") == "system", tokens * 15.0 / 1000).alias("decision"))


QUERIES = {
    "b7_wildcard": _of("part", lambda d: d.filter(gd.wildcard(F.col("p_name"), "a*e")).select("p_partkey", "p_name")),
    "b9_read_only": _of("documents", lambda d: d.select("doc_id", gd.read_only(F.col("text")).alias("sql_ok"), gd.read_only(F.col("text"), "cypher").alias("cypher_ok"))),
    "b18_keywords": _of("documents", lambda d: d.filter(gd.all_keywords(F.col("text"), F.array(F.lit("The"), F.lit(" "), F.lit("and")))).select("doc_id")),
    "b19_approval": _approved,
    "g24_cost": _priced,
    "g7_status_counts": _of("orders", lambda d: rp.value_counts(d.select(F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status")), "status", "pending")),
}

_TOKENS = "CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END"
# word boundaries spelled out as the guard has them, since the engines' own differ on letters beyond ASCII
_WORD = r"NOT coalesce(regexp_matches(text, '(?i)(^|[^\pL\pN_])({})($|[^\pL\pN_])'), false)"

ORACLES = {
    "b7_wildcard": "SELECT p_partkey, p_name FROM part WHERE upper(p_name) LIKE '%A%E%'",
    "b9_read_only": f"SELECT doc_id, {_WORD.format('INSERT|UPDATE|DELETE|DROP|CREATE|TRUNCATE|ALTER')} AS sql_ok, {_WORD.format('CREATE|DELETE|REMOVE|SET|MERGE|DROP')} AS cypher_ok FROM documents",
    "b18_keywords": "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')",
    "b19_approval": rf"SELECT conv_id, turn, CASE WHEN NOT {_WORD.format('the')} THEN 'destructive' WHEN role = 'system' THEN 'policy' WHEN ({_TOKENS}) * 15.0::DOUBLE / 1000 > 0.5 THEN 'cost' ELSE 'allow' END AS decision FROM conversations",
    "g24_cost": f"SELECT conv_id, turn, CASE role WHEN 'user' THEN ({_TOKENS}) * 3.0::DOUBLE / 1000 WHEN 'assistant' THEN ({_TOKENS}) * 15.0::DOUBLE / 1000 ELSE 0.0 END AS cost FROM conversations",
    "g7_status_counts": "SELECT CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus ELSE 'pending' END AS name, count(*) AS n FROM orders GROUP BY 1",
}
