import datetime as dt
import tempfile
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.sources import graph_store as gs
from skein.sources import scripts
from skein.streaming import events as ev
from skein.streaming import feeds


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def test_stale_events_behind_a_fresh_one_stay(spark):
    rows = spark.createDataFrame([(1, at(0)), (2, at(40)), (3, at(1)), (4, at(50))], "n int, ts timestamp")
    assert sorted(r.n for r in feeds.recent_window(rows, "n", "ts").collect()) == [2, 3, 4]
    assert [r.n for r in feeds.recent_window(rows, "n", "ts", most=1).collect()] == [4]
    assert feeds.recent_window(rows.filter("false"), "n", "ts").count() == 0


def test_fence_gate(spark):
    rows = spark.createDataFrame([(i, "k", t) for i, t in enumerate([3, 3, 2, 0, None, 5])], "n int, k string, token long")
    assert [r.decision for r in feeds.fence_gate(rows, "k", "token", "n").orderBy("n").collect()] == ["APPLY", "REPLAY", "STALE", "LEGACY", "LEGACY", "APPLY"]


def test_polls_never_skip_rows_of_one_time(spark):
    rows = spark.createDataFrame([(i, at(i // 4)) for i in range(10)], "n int, ts timestamp")
    place, seen = None, []
    while page := feeds.poll(rows, "ts", "n", place, 3).collect():
        seen += [r.n for r in page]
        place = (page[-1].ts, page[-1].n)
    assert seen == list(range(10))


def test_tenants(spark):
    rows = spark.createDataFrame([("a", "X_JOB"), (None, "JOB"), ("b", "none"), ("a", None)], "t string, e string")
    got = {tuple(r) for r in feeds.tenant_counters(rows, F.col("t"), F.col("e"), [("X_", "x"), ("JOB", "jobs")]).collect()}
    assert got == {("a", "x", 1), ("_platform", "jobs", 1)}
    assert feeds.visible_to(rows, F.col("t"), "b").count() == 2


def test_stream_and_batch_windows_agree(spark):
    folder = Path(tempfile.mkdtemp(prefix="spark-feed-"))
    rows = spark.createDataFrame([(i, at(i), "ab"[i % 2], float(i)) for i in range(30)], "event_id int, ts timestamp, event_type string, value double")
    rows.write.parquet(str(folder / "in"))
    stream = ev.sliding_counts(spark.readStream.schema(rows.schema).parquet(str(folder / "in")), "event_type", "8 hours", "4 hours", late="1 hour")
    run = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    assert {tuple(r) for r in spark.table("windows").collect()} == {tuple(r) for r in ev.sliding_counts(rows, "event_type", "8 hours", "4 hours").collect()}


@pytest.fixture
def folder():
    root = Path(tempfile.mkdtemp(prefix="spark-scripts-"))
    (root / "crm").mkdir()
    (root / "crm" / "a.sql").write_bytes(b"\xef\xbb\xbfselect 1")
    (root / "crm" / "b.pck").write_bytes("да".encode("cp1251"))
    (root / "crm" / "skip.txt").write_bytes(b"x")
    (root / "root.sql").write_bytes(b"\x98\xe9")
    return root


def test_scan_decodes_and_names_databases(spark, folder):
    found = scripts.scan(spark, str(folder))
    assert sorted(r.text for r in found.collect()) == sorted(["select 1", "да", "\x98\xe9"])
    assert [(r.db_name) for r in scripts.with_database(found, str(folder)).collect()] == ["crm", "crm"]
    alone = scripts.with_database(scripts.scan(spark, str(folder / "crm")), str(folder / "crm"))
    assert {r.db_name for r in alone.collect()} == {"default"}


def test_unzip_limits(spark, folder):
    with zipfile.ZipFile(folder / "x.zip", "w") as z:
        z.writestr("p/q.sql", "select 2")
        z.writestr("readme.md", "no")
    assert [(r.member, r.text) for r in scripts.unzip(spark, str(folder)).collect()] == [("p/q.sql", "select 2")]
    assert [(r.member, r.error) for r in scripts.unzip(spark, str(folder), most_bytes=3).collect()] == [(None, "exceeds 2000 files or 3 bytes")]
    (folder / "broken.zip").write_bytes(b"no archive")
    errors = {r.path.rsplit("/", 1)[-1]: r.error for r in scripts.unzip(spark, str(folder)).collect()}
    assert errors["x.zip"] is None and errors["broken.zip"].startswith("cannot be read")


def test_archive_drops_blank_and_known_texts(spark):
    rows = spark.createDataFrame([(1, "a"), (2, " \n"), (3, None), (4, "b"), (0, "b")], "k int, text string")
    known = spark.range(1).select(F.sha2(F.lit("a"), 256).alias("sha256"))
    assert [(r.k, r.n_bytes) for r in scripts.new_sources(rows, known, "k").collect()] == [(0, 1)]


def test_graph_store_keeps_known_ends(spark):
    v = spark.createDataFrame([("a", "T"), ("b", "T"), ("a", "T")], "id string, vtype string")
    e = spark.createDataFrame([("a", "b", "E"), ("a", "z", "E"), ("z", "b", "F")], "src string, dst string, etype string")
    assert {tuple(r) for r in gs.dropped_edges(v, e).collect()} == {("E", 1, 1), ("F", 0, 1)}
    assert [tuple(r) for r in gs.write_statistics(v).collect()] == [("T", 2, 1)]
    path = tempfile.mkdtemp(prefix="spark-graph-")
    gs.write_graph(v, e, path)
    assert spark.read.parquet(f"{path}/vertices").count() == 2 and spark.read.parquet(f"{path}/edges").count() == 1


def test_identifiers(spark):
    row = spark.range(1).select(tx.statement_line(F.lit("a:b:c:SELECT:x")).alias("bad"), tx.short_name(F.lit("a:b:c:d:5")).alias("short"), tx.atom_position(F.lit("x~3:9")).alias("at"), tx.atom_position(F.lit("x")).alias("none"), tx.text_list(F.lit('["a","b"]')).alias("list"), tx.text_list(F.lit("nonsense")).alias("empty"), tx.file_title(F.lit("c:\\d\\e.sql")).alias("title")).first()
    assert row.bad is None and row.short == "c:d:5" and tuple(row["at"]) == (3, 9) and tuple(row["none"]) == (None, None)
    assert row["list"] == ["a", "b"] and row["empty"] == [] and row.title == "e.sql"


def test_running_states_are_the_same_in_cells_as_in_one(spark):
    import random

    from skein.operators import reports as rp

    rng = random.Random(8)
    rows = spark.createDataFrame([(i, rng.choice("ab"), rng.choice([None, *range(12)]), rng.choice([-1, 1])) for i in range(300)], "n int, k string, t long, s int")
    of = lambda cell: [tuple(r) for r in rp.clipped_depth(feeds.fence_gate(ev.fence_decisions(rows, "k", "t", "n", cell), "k", "t", "n", cell), "k", "n", F.col("s"), cell).orderBy("n").collect()]
    assert of(7) == of(10**9)


def test_catalogs(spark):
    from skein.sources import catalogs as ct

    scripts_ = spark.createDataFrame([("hr", "p", "PACKAGE", at(1)), ("hr", "v", "VIEW", at(9)), ("fin", "f", "FUNCTION", at(9)), ("hr", "q", "package", None)], "owner string, name string, kind string, changed timestamp")
    pick = lambda **c: sorted(r.name for r in ct.selected(scripts_, ct.Harvest(**c)).collect())
    assert pick() == ["f", "p", "q", "v"] and pick(schema="HR", kinds=("package",)) == ["p", "q"] and pick(since=at(5)) == ["f", "q", "v"] and pick(limit=1) == ["f"]
    spaces = spark.createDataFrame([(1, "public"), (2, "pg_catalog")], "oid long, nspname string")
    procs = spark.createDataFrame([(10, "f", 1, "f", "body f"), (11, "p", 1, "p", "body p"), (12, "x", 2, "f", "no")], "oid long, proname string, pronamespace long, prokind string, src string")
    classes = spark.createDataFrame([(20, "v", 1, "v", "select 1"), (21, "t", 1, "r", None)], "oid long, relname string, relnamespace long, relkind string, src string")
    triggers = spark.createDataFrame([(21, "trg", "create trigger", False), (21, "inner", "no", True)], "tgrelid long, tgname string, src string, tgisinternal boolean")
    assert {(r.owner, r.name, r.kind) for r in ct.postgres_objects(spaces, procs, classes, triggers).collect()} == {("public", "f", "FUNCTION"), ("public", "p", "PROCEDURE"), ("public", "v", "VIEW"), ("public", "trg", "TRIGGER")}
    folder = tempfile.mkdtemp(prefix="spark-tsv-")
    Path(folder, "f.tsv").write_text("f1\tCREATE FUNCTION f1\\tAS x\nbad\n")
    assert sorted((r.name, r.text) for r in ct.tsv_functions(spark, folder).collect()) == [("bad", None), ("f1", "CREATE FUNCTION f1\tAS x")]
    assert ct.jdbc_options("jdbc:postgresql://db.example.com/x", "select 1", 500)["fetchsize"] == "500"
    with pytest.raises(ValueError):
        ct.jdbc_options("jdbc:postgresql://127.0.0.1/x", "select 1")
