"""Derived graphs: a type reads only the tables it comes from, and nothing is written before a query asks."""

from pathlib import Path

from pyspark.sql import functions as F

from skein.operators import inventory as inv
from skein.operators import lineage as ln
from skein.operators.lineage import root_of
from skein.plans.catalog import bound_graph
from skein.plans.model import bound
from skein.session import saved, scratch

SF = "/root/testdata/sf0.001"


def files(df):
    return {Path(f).name for f in df.inputFiles()}


def test_a_type_reads_only_its_tables(spark):
    graph = bound(spark, SF)
    assert files(graph.of("CALLS")) == {"supplier.parquet"}
    assert files(graph.typed("id", "Table", "Column")) == {"customer.parquet", "part.parquet"}
    assert files(bound_graph(spark, SF).of("WRITES_TO")) == {"orders.parquet"}


def test_counts_write_nothing(spark):
    made = lambda: set(Path(scratch(spark)).glob("*"))
    before = made()
    assert bound(spark, SF).of("HAS_COLUMN").count() > 0 and bound_graph(spark, SF).vertices.count() > 0
    assert made() == before


def test_roots_are_written_once_a_graph(spark):
    graph = bound(spark, SF)
    assert root_of(graph) is root_of(bound(spark, SF))
    assert root_of(graph).filter(F.col("sub") == "stmt:2").first().root == "stmt:0"


def test_a_schema_view_looks_only_at_its_own_uses_and_columns(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(ln, "saved", lambda df, name, **k: written.setdefault(name, saved(df, name, **k)) if name in ("uses", "columns") else saved(df, name, **k))
    graph = bound(spark, SF)
    held = {r.dst for r in graph.of("CONTAINS_TABLE").filter("src = 'schema:1'").collect()}
    whole = graph.roots("root").select(F.col("root").alias("sub"), "root")
    every = ln.column_flow(graph, whole.unionByName(root_of(graph))).unionByName(ln.filter_flow(graph, whole)).filter(F.col("src").isin(*held))
    want = [tuple(r) for r in every.orderBy("src", "dst", "etype", "source_handle", "target_handle").collect()]
    for limit in (7, len(want) + 1):
        view = ln.explore_schema(graph, "schema:1", column_limit=limit).filter("source_handle <> ''")
        assert sorted(tuple(r) for r in view.collect()) == want[:limit] and want
    assert {r.dst for r in written["uses"].collect()} <= held
    assert {r.tbl for r in written["columns"].collect()} <= held


def test_atoms_look_up_tables_and_columns_alone(spark):
    v = [("t", "Table", "T", None, None), ("t", "OutputColumn", "x", None, None), ("c", "Column", "C", None, None), ("c", "Statement", "y", None, None)]
    g = ln.Graph(spark.createDataFrame(v, "id string, vtype string, label string, scope string, parent string"), spark.createDataFrame([("r", "s", "CONTAINS_STMT"), ("q", "s", "CONTAINS_STMT")], "src string, dst string, etype string"))
    atoms = spark.createDataFrame([("s", "t.c", "t", "c"), ("z", "u", "u", None), (None, "n", None, "c")], "stmt string, text string, tbl string, col string")
    got = sorted(tuple(r) for r in inv.atom_references(g, atoms).select("text", "table_label", "column_label", "routine").collect())
    assert got == [("n", "", "C", ""), ("t.c", "T", "C", "q"), ("u", "", "", "")]
