import random

import pytest
from pyspark.sql import functions as F

from skein.operators import algorithms, diagnostics as dg, explore as ex
from skein.plans import catalog
from skein.session import saved

V, E = "id string, vtype string, label string", "src string, dst string, etype string"


def reachable(nodes, pairs):
    out = {n: {n} for n in nodes}
    while True:
        grown = {n: set().union(seen, *({b for a, b in pairs if a == m} for m in seen)) for n, seen in out.items()}
        if grown == out:
            return out
        out = grown


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(24), rng.randrange(24)) for _ in range(26)}) + [(40, 40), (60, 61), (61, 60)]
    edges = spark.createDataFrame(pairs + [pairs[0], (None, 1)], "src long, dst long")
    nodes = {n for p in pairs for n in p}
    whole = reachable(nodes, pairs + [(b, a) for a, b in pairs])
    assert {tuple(r) for r in algorithms.weak_components(edges).collect()} == {(n, min(whole[n])) for n in nodes}
    there = reachable(nodes, pairs)
    assert {tuple(r) for r in algorithms.strong_components(edges).collect()} == {(n, min(m for m in there[n] if n in there[m])) for n in nodes}


def test_weak_components_join_stars_of_batches(spark):
    rng = random.Random(5)
    pairs = sorted({(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)}) + [(f"p{i:02}", f"p{i + 1:02}") for i in range(30)] + [("z", "z"), ("é", "~")]
    whole = reachable({n for p in pairs for n in p}, pairs + [(b, a) for a, b in pairs])
    edges = spark.createDataFrame(pairs + pairs[:9] + [(None, "n1"), ("n1", None)], "src string, dst string").repartition(3)
    for batch in (2, 7, 1000):
        assert sorted(tuple(r) for r in algorithms.weak_components(edges, batch).collect()) == sorted((n, min(m)) for n, m in whole.items())


def test_links_read_once_leave_only_hubs_to_join(spark, monkeypatch):
    left, joined = [], algorithms._least_labels
    monkeypatch.setattr(algorithms, "_least_labels", lambda pairs: left.append(pairs.count()) or joined(pairs))
    edges = spark.range(1000).select(F.concat(F.lit("a"), (F.col("id") % 100).cast("string")).alias("src"), F.concat(F.lit("b"), (F.col("id") % 7).cast("string")).alias("dst"))
    assert {tuple(r) for r in algorithms.weak_components(edges.coalesce(1)).collect()} == {(f"a{i}", "a0") for i in range(100)} | {(f"b{i}", "a0") for i in range(7)}
    assert left == [0]


def test_repeated_links_have_the_components_of_the_edges(spark):
    sf = "/root/testdata/sf0.001"
    edges, links = catalog.bound_edges(spark, sf).select("src", "dst").distinct(), catalog.bound_links(spark, sf).distinct()
    assert edges.exceptAll(links).isEmpty() and links.exceptAll(edges).isEmpty()


def test_algorithms_on_an_empty_graph(spark):
    empty = spark.createDataFrame([], "src string, dst string")
    assert algorithms.weak_components(empty).count() == algorithms.strong_components(empty).count() == algorithms.hits(empty, 2).count() == 0


def test_hits_of_a_star(spark):
    got = {r.id: (round(r.hub, 6), round(r.authority, 6)) for r in algorithms.hits(spark.createDataFrame([("a", "x"), ("b", "x")], "src string, dst string"), 2).collect()}
    assert got == {"a": (0.707107, 0.0), "b": (0.707107, 0.0), "x": (0.0, 1.0)}


def test_hoisting_stops_in_cycles_and_keeps_roots(spark):
    parents = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "z"), ("z", "y")], "child string, parent string")
    edges = spark.createDataFrame([("c", "t", "READS_FROM"), ("a", "t", "READS_FROM"), ("o", "t", "READS_FROM"), ("y", "t", "READS_FROM")], E)
    assert {r.src for r in ex.hoist(edges, parents).collect()} == {"a", "o", "y"}
    assert [tuple(r) for r in ex.descendants(parents, "a").collect()] == [("b", 1), ("c", 2)]


def test_deep_expansion_passes_only_tables_and_statements(spark):
    v = spark.createDataFrame([("t", "Table", ""), ("s", "Statement", ""), ("u", "Table", ""), ("q", "Statement", ""), ("c", "Column", "")], V)
    e = spark.createDataFrame([("s", "t", "READS_FROM"), ("s", "u", "WRITES_TO"), ("q", "u", "READS_FROM"), ("c", "t", "READS_FROM"), ("s", "q", "CALLS")], E)
    assert {(r.src, r.dst) for r in ex.expand_deep(v, e, "t", 1).collect()} == {("s", "t")}
    assert {(r.src, r.dst) for r in ex.expand_deep(v, e, "t", 2).collect()} == {("s", "t"), ("s", "u")}
    assert ex.expand_deep(v, e, "t", 99).count() == 3
    assert ex.expand_deep(v, e, "missing").count() == 0


def test_snapshots_and_preferred_branches(spark):
    one = lambda rows: spark.createDataFrame(rows, "k int, s string")
    got = {tuple(r) for r in ex.snapshot_diff(one([(1, "a"), (2, "b"), (3, None), (None, "x")]), one([(2, "c"), (3, None), (4, "d")]), "k", "s").collect()}
    assert got == {(1, "a", None, "deleted"), (2, "b", "c", "changed"), (4, None, "d", "new")}
    assert {tuple(r) for r in ex.prefer_first([one([(1, "z")]), one([(1, "a"), (2, "b")])], ["k"]).collect()} == {(1, 0, "z"), (2, 1, "b")}


def test_explicit_positions_lift_the_counter(spark):
    explicit = [None, 5, None, 2, None, 6, 20, None]
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(explicit)], "k int, n int, x long")
    want, at = [], 0
    for x in explicit:
        at = max(at + 1, x or 0)
        want.append(at)
    for cell in (2, 100_000):
        assert [r.position for r in ex.override_order(rows, ["k"], "n", "x", cell).orderBy("n").collect()] == want
def test_diagnostics(spark):
    v = spark.createDataFrame([("t", "Table", "t"), ("u", "Table", "u"), ("r", "Routine", "r"), ("q", "Routine", "q")], V)
    e = spark.createDataFrame([("s", "t", "WRITES_TO"), ("r", "q", "CALLS")], E)
    assert [r.id for r in dg.untouched(v, e, "Table", ("WRITES_TO",)).collect()] == ["u"]
    assert [r.id for r in dg.end_routines(v, e, "CALLS", "src").collect()] == ["q"]
    assert [r.id for r in dg.end_routines(v, e, "CALLS", "dst").collect()] == ["r"]
    assert {(r.id, r.n_in, r.n_out) for r in dg.degrees(v, e).collect()} == {("t", 1, 0), ("u", 0, 0), ("r", 0, 1), ("q", 1, 0)}
    assert dg.health(v, e.filter("false")).first().flow_pct == pytest.approx(0.0)
    assert [r.id for r in dg.dead_tables(e).collect()] == ["t"]


def test_strong_components_of_paths_and_rings_take_few_rounds(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(algorithms, "saved", lambda df, name, **k: (labels.append(name), saved(df, name, **k))[1])
    path = [(i, i + 1) for i in range(1000)] + [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)] + [(999, 2000)]
    got = {r.id: r.component for r in algorithms.strong_components(spark.createDataFrame(path, "src long, dst long")).collect()}
    assert got == {**{i: i for i in range(1001)}, **{2000 + i: 2000 for i in range(30)}}
    assert labels.count("pivots") <= 25


def test_settled_hits_match_the_singular_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    links = sorted({(int(a), int(b) + 100) for a, b in rng.integers(0, 12, (60, 2))})
    matrix = np.zeros((12, 12))
    for a, b in links:
        matrix[a, b - 100] = 1
    u, _, v = np.linalg.svd(matrix)
    got = {r.id: (r.hub, r.authority) for r in algorithms.hits(spark.createDataFrame(links, "src long, dst long"), tolerance=1e-7).collect()}
    for i in range(12):
        assert abs(got.get(i, (0, 0))[0] - abs(u[i, 0])) < 1e-5 and abs(got.get(i + 100, (0, 0))[1] - abs(v[0, i])) < 1e-5
