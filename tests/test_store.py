"""The versioned graph store: keyed upserts, interleaved writers, canonical ids and pruned lookups."""

import tempfile

import pytest

from skein.operators.lineage import Graph, routine_scope
from skein.session import saved
from skein.sources import store as store_module
from skein.sources.store import GraphStore, canonical

V, E = "id string, vtype string, label string, n int", "src string, dst string, etype string"


def batch(spark, vertices, edges):
    return spark.createDataFrame(vertices, V), spark.createDataFrame(edges, E)


def ids(df):
    return sorted(tuple(r) for r in df.collect())


def test_first_write_wins_and_edges_need_both_ends(spark):
    store = GraphStore(spark, tempfile.mkdtemp(prefix="spark-store-"), buckets=3)
    assert store.vertices().count() == store.edges().count() == 0
    first = batch(spark, [("a", "Table", "late", 2), ("a", "Table", "early", 1), ("b", "Statement", "b", 1)], [("b", "a", "READS_FROM"), ("b", "a", "READS_FROM"), ("b", "zz", "READS_FROM"), (None, "a", "X")])
    assert store.commit(*first, order="n") == {"vertices": 2, "repeated_vertices": 1, "edges": 1, "repeated_edges": 1, "dropped_edges": 1}
    second = batch(spark, [("a", "Table", "again", 0), ("c", "Table", "c", 1)], [("b", "c", "WRITES_TO"), ("b", "a", "READS_FROM")])
    assert store.commit(*second) == {"vertices": 1, "repeated_vertices": 1, "edges": 1, "repeated_edges": 1, "dropped_edges": 0}
    assert ids(store.vertices().select("id", "label")) == [("a", "early"), ("b", "b"), ("c", "c")]
    assert ids(store.edges("WRITES_TO").select("src", "dst")) == [("b", "c")]
    assert store.commit(*batch(spark, [("d", "Table", "d", 1)], []), mode="DISABLED")["vertices"] == 0
    with pytest.raises(ValueError, match="mode"):
        store.commit(*first, mode="EMBEDDED")


def test_edges_without_any_known_end_are_counted(spark):
    store = GraphStore(spark, tempfile.mkdtemp(prefix="spark-store-"), buckets=2)
    counts = store.commit(*batch(spark, [], [("a", "b", "CALLS"), ("a", "b", "CALLS"), ("c", "b", "CALLS")]))
    assert counts == {"vertices": 0, "repeated_vertices": 0, "edges": 0, "repeated_edges": 1, "dropped_edges": 2}
    assert store.commit(*batch(spark, [("a", "Table", "a", 1)], [("a", "b", "CALLS")]))["dropped_edges"] == 1
    assert store.commit(*batch(spark, [("x", "Table", "x", 1)], [("q", "x", "CALLS")])) == {"vertices": 1, "repeated_vertices": 0, "edges": 0, "repeated_edges": 0, "dropped_edges": 1}
    assert store.commit(*batch(spark, [("b", "Table", "b", 1)], [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS")])) == {"vertices": 1, "repeated_vertices": 0, "edges": 1, "repeated_edges": 0, "dropped_edges": 2}


def test_a_commit_shuffles_its_edges_once_for_each_end(spark, monkeypatch):
    plans, plain = [], GraphStore._write
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(GraphStore, "_write", lambda self, rows, kind, version: plans.append((kind, rows._jdf.queryExecution().executedPlan().toString())) or plain(self, rows, kind, version))
    try:
        store = GraphStore(spark, tempfile.mkdtemp(prefix="spark-store-"), buckets=2)
        for label in ("a", "b"):
            store.commit(*batch(spark, [(f"{label}{i}", "Table", label, i) for i in range(9)], [(f"{label}{i}", f"{label}{i + 1}", "CALLS") for i in range(9)]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    # by source, with what is there, and by end, and the ids for both
    assert [plan.count("Exchange hashpartitioning") for kind, plan in plans if kind == "edges"] == [4, 4]


def test_a_saved_frame_is_not_written_again(spark, monkeypatch):
    vertices, edges = batch(spark, [("a", "Table", "a", 1)], [("a", "a", "CALLS"), (None, "a", "CALLS")])
    edges, made = saved(edges, "edges"), []
    monkeypatch.setattr(store_module, "saved", lambda df, name: made.append(name) or saved(df, name))
    store = GraphStore(spark, tempfile.mkdtemp(prefix="spark-store-"), buckets=2)
    assert store.commit(vertices, edges)["edges"] == 1 and store.commit(vertices, edges)["repeated_edges"] == 1
    assert made == ["batch-vertices"] * 2 and edges.count() == 2


def test_interleaved_writers_lose_nothing(spark):
    path = tempfile.mkdtemp(prefix="spark-store-")
    other = GraphStore(spark, path, buckets=2)

    class Slow(GraphStore):
        met = 0

        def _swap(self, manifest):
            if not self.met:  # another writer commits between this one's files and its manifest
                self.met += 1
                other.commit(*batch(spark, [("t", "Table", "theirs", 1), ("u", "Table", "u", 1)], [("u", "t", "CALLS")]))
            return super()._swap(manifest)

    slow = Slow(spark, path, buckets=2)
    counts = slow.commit(*batch(spark, [("t", "Table", "ours", 1), ("s", "Statement", "s", 1)], [("s", "t", "READS_FROM"), ("s", "u", "READS_FROM")]))
    assert counts == {"vertices": 1, "repeated_vertices": 1, "edges": 2, "repeated_edges": 0, "dropped_edges": 0}
    assert ids(slow.vertices().select("id", "label")) == [("s", "s"), ("t", "theirs"), ("u", "u")]
    assert ids(slow.edges()) == [("s", "t", "READS_FROM"), ("s", "u", "READS_FROM"), ("u", "t", "CALLS")]
    assert slow.manifest().number == 2
    held = {v for own in slow.manifest().parts.values() for versions in own.values() for v in versions}
    assert len(held) == 2


def test_lookup_reads_only_the_asked_buckets(spark):
    store = GraphStore(spark, tempfile.mkdtemp(prefix="spark-store-"), buckets=50)
    store.commit(*batch(spark, [(f"t{i}", "Table", "x", i) for i in range(400)], [(f"t{i}", f"t{i + 1}", "CALLS") for i in range(300)]))
    some = store.lookup(["t7", "t8", "none"])
    assert ids(some.select("id")) == [("t7",), ("t8",)] and len(some.inputFiles()) <= 3 < len(store.vertices().inputFiles())
    assert ids(store.lookup(["t7"], "CALLS", kind="edges").select("dst")) == [("t8",)]


def test_equal_objects_of_sessions_get_one_id(spark):
    rows = [("s1:t", "Table", "hr.emp", 1), ("s2:t", "Table", "HR.EMP", 2), ("s1:q", "Statement", "hr.emp", 1)]
    vertices, edges = canonical(*batch(spark, rows, [("s1:q", "s1:t", "READS_FROM"), ("s1:q", "s2:t", "READS_FROM")]), database="vtype", name="label")
    assert len({r.id for r in vertices.collect()}) == 2
    store = GraphStore(spark, tempfile.mkdtemp(prefix="spark-store-"))
    assert store.commit(vertices, edges)["edges"] == 1
    assert [r.label for r in store.vertices("Table").collect()] == ["HR.EMP"] or store.vertices("Table").count() == 1


def test_views_read_a_stored_graph(spark):
    store = GraphStore(spark, tempfile.mkdtemp(prefix="spark-store-"), buckets=2)
    v = spark.createDataFrame([("r", "Routine", "r", None, None), ("s", "Statement", "s", None, None), ("t", "Table", "t", "x", None)], "id string, vtype string, label string, scope string, parent string")
    store.commit(v, spark.createDataFrame([("r", "s", "CONTAINS_STMT"), ("s", "t", "READS_FROM")], E))
    found = routine_scope(Graph(store.vertices(), store.edges()), "r")
    assert ids(found) == [("r", "s", "CONTAINS_STMT"), ("s", "t", "READS_FROM")]
