import random
from collections import Counter

from pyspark.sql import functions as F

from skein.operators import reports as rp


def test_blank_values_count_as_unknown(spark):
    rows = spark.createDataFrame([("a",), (" ",), (None,)], "v string")
    assert {tuple(r) for r in rp.value_counts(rows, "v").collect()} == {("a", 1), ("UNKNOWN", 2)}


def test_ratios_without_denominator(spark):
    row = spark.range(1).select(rp.ratio(F.lit(0), F.lit(0), 1.0).alias("a"), rp.ratio(F.lit(1), F.lit(4), 0.0).alias("b")).first()
    assert tuple(row) == (1.0, 0.25)
    merged = rp.weighted_merge(spark.createDataFrame([("x", 0.5, 0), ("y", 0.5, 1), ("y", 1.0, 3)], "k string, rate double, w long"), "k", "rate", "w")
    assert {r.k: r.rate for r in merged.collect()} == {"x": 0.0, "y": 0.875}


def test_token_estimate_and_breach_order(spark):
    rows = spark.createDataFrame([("",), (None,), ("abc",), ("a" * 9,)], "t string").select(rp.token_estimate(F.col("t")).alias("n"))
    assert [r.n for r in rows.collect()] == [0, 0, 1, 2]
    row = spark.range(1).select(rp.first_breach(("off", F.lit(9), 0), ("a", F.lit(1), 2), ("b", F.lit(5), 2), ("c", F.lit(5), 2)).alias("x"), rp.first_breach(("a", F.lit(1), 2)).alias("y")).first()
    assert tuple(row) == ("b", None)


def test_reconcile_skips_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "z")], "k int, v string")
    right = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    assert {tuple(r) for r in rp.reconcile(left, right, "k", "v").collect()} == {(1, "left_only"), (2, "mismatch"), (4, "right_only")}


def test_queue_depth_never_falls_below_zero(spark):
    rows = spark.createDataFrame([(i, "q", s) for i, s in enumerate([-1, 1, 1, -1, -1, -1, 1])], "n int, q string, s int")
    assert [r.depth for r in rp.clipped_depth(rows, "q", "n", F.col("s")).orderBy("n").collect()] == [0, 1, 2, 1, 0, 0, 1]


def test_chain_breaks_where_a_link_was_altered(spark):
    from hashlib import sha256

    rows, prev = [], ""
    for i in range(4):
        digest = sha256(f"{prev}|p{i}".encode()).hexdigest()
        rows.append((i, "c", f"p{i}" if i != 2 else "changed", prev, digest))
        prev = digest
    for cell in (1, 2, 100_000):
        broken = rp.chain_breaks(spark.createDataFrame(rows, "n int, c string, p string, prev string, hash string"), "c", "n", F.col("p"), "prev", "hash", cell)
        assert [r.n for r in broken.collect()] == [2]


def test_file_names(spark):
    row = spark.range(1).select(rp.file_name(F.lit(None).cast("string"), F.lit("A b-C"), F.lit("VIEW")).alias("f")).first()
    assert row.f == "default__a_b_c.view.sql"


def test_page_rank_over_many_blocks_and_links_that_stay(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(50)}") for _ in range(150)]
    nodes, links = sorted({n for p in pairs for n in p}), set(pairs)
    out, score = Counter(a for a, _ in links), dict.fromkeys(nodes, 1.0)
    for _ in range(6):
        lost = sum(score[n] for n in nodes if not out[n]) / len(nodes)
        score = {n: 0.15 + 0.85 * (lost + sum(score[a] / out[a] for a, b in links if b == n)) for n in nodes}
    for block in (9, 1000):
        got = {r.id: r.score for r in rp.page_rank(spark.createDataFrame(pairs, "src string, dst string"), 6, block=block).collect()}
        assert got.keys() == score.keys() and all(abs(got[n] - score[n]) < 1e-9 for n in nodes)


def test_page_rank_converges_and_deals_out_what_dangles(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("c", "e"), ("d", "c")]
    nodes, links = sorted({n for p in pairs for n in p}), set(pairs)
    score = dict.fromkeys(nodes, 1.0)
    for _ in range(300):
        lost = sum(score[n] for n in nodes if not any(a == n for a, _ in links)) / len(nodes)
        score = {n: 0.15 + 0.85 * (lost + sum(score[a] / sum(x == a for x, _ in links) for a, b in links if b == n)) for n in nodes}
    got = {r.id: r.score for r in rp.page_rank(spark.createDataFrame(pairs, "src string, dst string"), tolerance=1e-4).collect()}
    assert set(got) == set(nodes) and all(abs(got[n] - score[n]) < 1e-2 for n in nodes) and abs(sum(got.values()) - len(nodes)) < 1e-6
    assert rp.page_rank(spark.createDataFrame([], "src string, dst string")).count() == 0
