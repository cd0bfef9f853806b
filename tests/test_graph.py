import pytest

from skein.operators import graph
from skein.session import saved
from skein.streaming import events as ev

V, E = "id string, vtype string, label string", "src string, dst string, etype string"


@pytest.fixture
def small(spark):
    v = spark.createDataFrame([(i, "Table", i) for i in "abcd"] + [("s", "Statement", "s")], V)
    e = spark.createDataFrame([("a", "b", "DATA_FLOW"), ("b", "c", "DATA_FLOW"), ("c", "a", "DATA_FLOW"), ("s", "a", "READS_FROM"), ("s", "b", "WRITES_TO"), ("s", "a", "WRITES_TO")], E)
    return v, e


def test_impact_stops_in_cycles_and_at_the_hop_limit(small):
    v, e = small
    assert [(r.id, r.depth) for r in graph.impact(v, e, "a").collect()] == [("b", 1), ("c", 2)]
    assert [r.id for r in graph.impact(v, e, "a", max_hops=1).collect()] == ["b"]
    assert [r.id for r in graph.impact(v, e, "a", downstream=False, max_hops=1).collect()] == ["c"]
    assert graph.impact(v, e, "missing").count() == 0


def test_lineage_both_keeps_each_direction(small):
    v, e = small
    assert graph.lineage(v, e, "a").count() == 4
    with pytest.raises(ValueError):
        graph.lineage(v, e, "a", "sideways")


def test_lineage_writes_its_edges_once(small, monkeypatch):
    v, e = small
    names = []
    monkeypatch.setattr(graph, "saved", lambda df, name, **k: (names.append(name), saved(df, name, **k))[1])
    assert {(r.id, r.direction, r.depth) for r in graph.lineage(v, e, "a").collect()} == {("c", "upstream", 1), ("b", "upstream", 2), ("b", "downstream", 1), ("c", "downstream", 2)}
    assert names.count("steps") == 1


def test_degree_reports(small):
    v, e = small
    assert {(r.id, r.read_by, r.written_by) for r in graph.table_degrees(e).collect()} == {("a", 1, 1), ("b", 0, 1)}
    assert [r.id for r in graph.crossroads(e).collect()] == ["a"]
    assert {r.id for r in graph.without_edge(v, e, "Table", "READS_FROM", "WRITES_TO").collect()} == {"c", "d"}


def test_fence_takes_tokens_that_do_not_fall(spark):
    rows = spark.createDataFrame([(1, "t", 5), (2, "t", 4), (3, "t", 5), (4, "t", 7), (5, "u", 1)], "n int, key string, token int")
    assert [r.accepted for r in ev.fence_decisions(rows, "key", "token", "n").orderBy("n").collect()] == [True, False, True, True, True]


def test_levels_and_filters(spark):
    rows = spark.createDataFrame([(1, "INFO"), (2, "error"), (3, None)], "n int, level string")
    assert [r.n for r in ev.event_filter(rows, least_level="WARN").collect()] == [2]
    assert ev.event_filter(rows, n=None).count() == 3


def test_entry_works_without_the_llm_subpackage():
    import __spark_entry__ as entry

    assert {"p1_impact", "g12_dependency_counts"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
