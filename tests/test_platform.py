import random

from pyspark.sql import functions as F

from skein.functions import values as vl
from skein.operators import biconnected
from skein.operators import lineage as ln
from skein.streaming import platform as pf


def parts(nodes, pairs):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[top(a)] = top(b)
    return len({top(n) for n in nodes})


def test_bridges_and_articulation_points_against_brute_force(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted((10 * k + rng.randrange(9), 10 * k + rng.randrange(9)))) for k in range(4) for _ in range(11)} | {(40, 41), (41, 42), (42, 40), (42, 43)}
    pairs = {p for p in pairs if p[0] != p[1]}
    nodes = {n for p in pairs for n in p}
    whole = parts(nodes, pairs)
    bridges = {p for p in pairs if parts(nodes, pairs - {p}) > whole}
    points = {n for n in nodes if parts(nodes - {n}, {p for p in pairs if n not in p}) > whole - (not any(n in p for p in pairs))}
    edges = spark.createDataFrame([*pairs, (7, 7), (None, 3), *((b, a) for a, b in list(pairs)[:5])], "src long, dst long")
    assert {tuple(r) for r in biconnected.bridges(edges).collect()} == bridges
    assert {r.id for r in biconnected.articulation_points(edges).collect()} == points
    assert bridges and points and biconnected.bridges(edges.limit(0)).count() == biconnected.articulation_points(edges.limit(0)).count() == 0


def test_batches_are_refused_whole_and_untagged_rows_alone(spark):
    rows = [(1, "a", "t"), (1, "b", None), (2, None, "t"), (2, "c", "t"), *((3, "d", "t") for _ in range(5)), (4, "audit.x", " ")]
    frame = spark.createDataFrame(rows, "batch int, kind string, tenant string")
    out = pf.valid_batches(frame, "batch", F.col("kind").isNotNull(), pf.tagged(F.col("kind"), F.lit("c"), F.col("tenant")), most=4)
    assert sorted((r.batch, r.kind) for r in out.collect()) == [(1, "a"), (4, "audit.x")]


def test_counters_tokens_and_baselines(spark):
    row = pf.counters(spark.createDataFrame([(-3,)], "x int"), {"files": F.lit(0), "resolutions": F.lit(2), "queue": F.col("x")}).first()
    assert row.queue == 0 and row.rate != row.rate
    empty = spark.createDataFrame([], "t long")
    assert pf.next_tokens(empty, "t", 50, 2) == [50, 51] and pf.next_tokens(spark.createDataFrame([(9,)], "t long"), "t", 50, 1) == [1009]
    now = spark.createDataFrame([(1, "a")], "k int, s string")
    assert pf.status_changes(None, now, "k", "s").count() == 0


def test_long_chains_hash_as_one(spark):
    from hashlib import sha256

    rows = [(k, i) for k in "ab" for i in range(150 if k == "a" else 3)]
    got = {(r.k, r.i): (r.prev, r.hash) for r in pf.hash_chain(spark.createDataFrame(rows, "k string, i int"), "k", "i", F.col("i").cast("string")).collect()}
    for k, n in (("a", 150), ("b", 3)):
        prev = ""
        for i in range(n):
            digest = sha256(f"{prev}|{i}".encode()).hexdigest()
            assert got[k, i] == (prev, digest)
            prev = digest


def test_values_and_urls(spark):
    row = spark.range(1).select(vl.duration(F.lit(999)).alias("a"), vl.duration(F.lit(1500)).alias("b"), vl.duration(F.lit(125_000)).alias("c"), vl.payload_number(F.lit('{"x": "nope"}'), "x", 3.0).alias("d"), vl.assistant_query(F.lit("select 1 LIMIT 3")).alias("e"), vl.assistant_query(F.lit("Drop table x limit 1")).alias("f")).first()
    assert tuple(row) == ("999ms", "1.5s", "2m05s", 3.0, True, False)
    assert vl.allowed_url("jdbc:postgresql://db.example.com:5432/x") and vl.allowed_url("jdbc:oracle:thin:@db.example.com:1521/x")
    assert not any(map(vl.allowed_url, ("jdbc:postgresql://127.0.0.1/x", "jdbc:postgresql://10.0.0.8:1/x", "jdbc:postgresql://localhost/x", "jdbc:mysql://db.example.com/x", "jdbc:clickhouse://169.254.169.254/x", "jdbc:postgresql://[::1]/x")))


def test_upstream_takes_handles_by_name_and_hides_what_no_view_shows(spark):
    v = [("r", "Statement", "r", None, None), ("s", "Statement", "s", None, "r"), ("t", "Table", "t", "x", None), ("c", "Column", "c", None, None), ("o", "OutputColumn", "q.Name", None, None), ("a", "AffectedColumn", "name", None, None), ("k", "Atom", "k", None, None), ("u", "Table", "u", "x", None)]
    e = [("s", "r", "CHILD_OF"), ("s", "t", "READS_FROM"), ("s", "o", "HAS_OUTPUT_COL"), ("c", "o", "DATA_FLOW"), ("t", "c", "HAS_COLUMN"), ("r", "a", "HAS_AFFECTED_COL"), ("c", "s", "FILTER_FLOW"), ("k", "r", "USES"), ("u", "r", "USES"), ("s", "u", "WRITES_TO"), ("r", "k", "USES")]
    g = ln.Graph(spark.createDataFrame(v, "id string, vtype string, label string, scope string, parent string"), spark.createDataFrame(e, "src string, dst string, etype string"))
    assert {tuple(x) for x in ln.upstream(g, "r").collect()} == {("u", "r", "USES", "", ""), ("t", "r", "READS_FROM", "", ""), ("t", "r", "DATA_FLOW", "src-c", "tgt-a"), ("t", "r", "FILTER_FLOW", "src-c", "")}
    assert {tuple(x) for x in ln.downstream(g, "r").collect()} == {("r", "a", "HAS_AFFECTED_COL"), ("r", "u", "WRITES_TO")}
    assert ln.upstream(g, "s").filter("etype = 'READS_FROM'").count() == 0
    assert [(x.sub, x.root) for x in ln.root_of(g).collect()] == [("s", "r")]
    assert ln.parse_scope("schema-a|b") == ("schema", "a", "b") and ln.parse_scope("#1:2") == ("node", "#1:2", "")
