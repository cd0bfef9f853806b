"""Scopes of many sources, contraction, flags, overviews and communities against brute force."""

import random
from itertools import product

import pytest

from skein.operators import community as cm
from skein.operators import display as dp
from skein.operators.lineage import Graph
from skein.plans import display as plans

EDGES = "src string, dst string, etype string"


def frame(spark, edges):
    return spark.createDataFrame([(*e, "X") if len(e) == 2 else e for e in edges], EDGES)


def reached(edges, start, undirected):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for a, b in edges:
            for near, far in ((a, b), (b, a)) if undirected else ((a, b),):
                if near == at and far not in seen:
                    seen.add(far)
                    todo.append(far)
    return seen


def test_many_sources_reach_as_one_by_one(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randint(0, 90)}", f"n{rng.randint(0, 90)}") for _ in range(80)] + [("n1", "n1"), ("p0", "p1")]
    sources = [f"n{i}" for i in range(70)] + ["lone"]
    for undirected in (True, False):
        got = dp.reach_many(frame(spark, edges), spark.createDataFrame([(s,) for s in [*sources, "n0", None]], "id string"), undirected).collect()
        assert len(got) == len(set(got))
        assert {tuple(r) for r in got} == {(s, i) for s in sources for i in reached(edges, s, undirected)}
    near = dp.reach_many(frame(spark, [("a", "b"), ("b", "c")]), spark.createDataFrame([("a",)], "id string"), False, max_hops=1)
    assert {r.id for r in near.collect()} == {"a", "b"}


def test_hidden_nodes_are_bridged(spark):
    edges = [("a", "h1"), ("h1", "h2"), ("h2", "b"), ("h2", "h1"), ("a", "b2"), ("h2", "c"), ("x", "h9")]
    hidden = spark.createDataFrame([("h1",), ("h2",), ("h9",)], "id string")
    assert {tuple(r) for r in dp.contracted(frame(spark, edges), hidden).collect()} == {("a", "b"), ("a", "c"), ("a", "b2")}


def test_flags_of_directions_depth_and_scope(spark):
    v = spark.createDataFrame([("s", "Statement"), ("t", "Table"), ("w", "Table"), ("z", "Schema")], "id string, vtype string")
    edges = frame(spark, [("s", "t", "READS_FROM"), ("s", "w", "WRITES_TO"), ("t", "c", "HAS_COLUMN")])
    flags = dp.node_flags(v, edges, ("Schema",), spark.createDataFrame([("w",)], "id string"), upstream=False, scope=spark.createDataFrame([("s",), ("w",)], "id string"))
    assert {r.id: (r.hidden, r.dimmed) for r in flags.collect()} == {"s": (False, False), "t": (False, True), "w": (True, False), "z": (True, True)}
    assert {r.etype for r in dp.shown_edges(edges, table_level=True, upstream=False).collect()} == {"WRITES_TO"}


def test_reads_below_a_root_are_lifted_once(spark):
    v = spark.createDataFrame([("r", "Statement", None), ("a", "Statement", "r"), ("b", "Statement", "a")], "id string, vtype string, parent string")
    g = Graph(v, frame(spark, [("a", "r", "CHILD_OF"), ("b", "a", "CHILD_OF"), ("r", "t1", "READS_FROM"), ("a", "t1", "READS_FROM"), ("b", "t2", "READS_FROM"), ("a", "t2", "READS_FROM")]))
    nested, lifted = dp.hoisted_reads(g)
    assert {r.id for r in nested.collect()} == {"a", "b"} and {tuple(r) for r in lifted.collect()} == {("r", "t2")}


def test_overviews_group_and_stub(spark):
    schema = "id string, name string, db string, db_name string, app string, app_name string"
    rows = [("s1", "one", "d1", "D1", "a", "A"), ("s2", "two", "d2", None, "a", "A"), ("s3", "three", None, None, "a", "A"), ("s4", "four", "d3", "D3", "b", None), ("s5", "five", None, None, None, None), ("s6", "six", "d4", "D4", None, None)]
    got = {(r.kind, r.id): (r.parent, r.label) for r in dp.overview(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("application", "a"): (None, "A"), ("database", "d1"): ("a", "D1"), ("database", "d2"): ("a", "unnamed"), ("database", "stub:a"): ("a", "unnamed"), ("database", "d3"): (None, "D3"), ("database", "stub"): (None, "unnamed"), ("database", "d4"): (None, "D4"), **{("schema", r[0]): (r[2] or ("stub:a" if r[4] else "stub"), r[1]) for r in rows}}
    flat = spark.createDataFrame([(f"s{i}", str(i), None, None, None, None) for i in range(11)], schema)
    dealt = dp.overview(flat, per_app=9, per_db=3, position=flat["name"].cast("long")).collect()
    assert {r.id for r in dealt if r.kind == "application"} == {"app-0"} and {r.id: r.parent for r in dealt if r.kind == "database"} == {"db-0-0": "app-0", "db-0-1": "app-0", "db-0-2": "app-0", "db-1-0": None}


def quality(edges, of):
    m2 = 2 * len(edges)
    inside = sum(2 for a, b in edges if of[a] == of[b])
    size = {}
    for a, b in edges:
        for n in (a, b):
            size[of[n]] = size.get(of[n], 0) + 1
    return inside / m2 - sum((s / m2) ** 2 for s in size.values())


def test_modularity_reaches_the_best_partition_of_small_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = sorted({tuple(sorted(rng.sample("abcdefg", 2))) for _ in range(9)} | {("a", "b"), ("b", "c")})
        nodes = sorted({n for e in edges for n in e})
        best = max(quality(edges, dict(zip(nodes, p, strict=True))) for p in product(range(3), repeat=len(nodes)))
        of = {r.id: r.community for r in cm.by_modularity(frame(spark, edges)).collect()}
        assert quality(edges, of) >= best - 0.03


def test_ring_of_cliques_is_cut_between_them(spark):
    edges = [(f"{c}{i}", f"{c}{j}") for c in "abcdef" for i in range(5) for j in range(i)] + [(f"{a}0", f"{b}1") for a, b in zip("abcdef", "bcdefa", strict=True)]
    of = {r.id: r.community for r in cm.by_modularity(frame(spark, edges)).collect()}
    assert all(of[f"{c}{i}"] == of[f"{c}0"] == f"{c}0" for c in "abcdef" for i in range(5)) and len(set(of.values())) == 6
    assert cm.by_modularity(frame(spark, [])).count() == 0


def test_nodes_of_one_neighbour_join_it_without_moving(spark, monkeypatch):
    monkeypatch.setattr(cm, "_local_moving", lambda *_: pytest.fail("stars need no moving"))
    edges = [(f"s{i:02}", f"t{i % 3}") for i in range(30)] + [("t0", "s00"), ("x", "y"), ("z", "z")]
    of = {r.id: r.community for r in cm.by_modularity(frame(spark, edges)).collect()}
    assert of == {f"s{i:02}": f"s0{i % 3}" for i in range(30)} | {f"t{k}": f"s0{k}" for k in range(3)} | {"x": "x", "y": "x"}


def test_communities_are_those_of_the_whole_graph(spark):
    edges = [("s1", "t1", "READS_FROM"), ("s1", "o1", "HAS_OUTPUT_COL"), ("c1", "o1", "DATA_FLOW"), ("s2", "t2", "WRITES_TO"), ("r1", "r2", "CALLS")]
    of = {r.id: r.community for r in plans._modularity(Graph(spark.range(0), frame(spark, edges))).collect()}
    assert set(of) == {n for a, b, _ in edges for n in (a, b)} and of["s1"] == of["t1"] and of["c1"] == of["o1"]
    assert of["s2"] == of["t2"] == "s2" and of["r1"] == of["r2"] == "r1"
