from pyspark.sql import functions as F

from skein.functions import guards as gd


def test_guards_take_whole_words(spark):
    rows = spark.createDataFrame([("select updated_at from t",), ("Update t",), ("match (n) set n.x = 1",), ("xénon éset",), (None,)], "q string")
    assert [tuple(r) for r in rows.select(gd.read_only(F.col("q")), gd.read_only(F.col("q"), "cypher")).collect()] == [(True, True), (False, True), (True, False), (True, True), (True, True)]


def test_predicates(spark):
    row = spark.range(1).select(
        gd.wildcard(F.lit("abCd"), "B*d").alias("wild"), gd.literal_match(F.lit("a%b"), "%").alias("literal"),
        gd.all_keywords(F.lit("How Big"), F.array(F.lit("big"), F.lit(""))).alias("all"), gd.all_keywords(F.lit("x"), F.array(F.lit(" "))).alias("blank"),
        gd.is_root(F.lit("Statement"), F.lit(None).cast("string")).alias("root"), gd.is_root(F.lit("Statement"), F.lit("p")).alias("inner"),
        gd.approval(F.lit(None).cast("boolean"), F.lit(True), F.lit(9.0)).alias("policy"), gd.approval(F.lit(False), F.lit(False), F.lit(0.5)).alias("allow"),
    ).first()
    assert (row.wild, row.literal, row["all"], row.blank, row.root, row.inner, row.policy, row.allow) == (True, True, True, False, True, False, "policy", "allow")
