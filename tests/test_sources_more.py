"""Late usage, quotas, archives of texts and catalogs of source lines."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from skein.operators import usage as us
from skein.sources import catalogs as ct
from skein.sources.archive import SourceArchive
from skein.sources.store import GraphStore


def test_late_and_repeated_batches_equal_a_full_run(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), dt.datetime(2024, rng.choice([1, 2]), rng.randint(1, 28)), rng.randint(0, 90), rng.randint(0, 9)) for _ in range(400)] + [("a", None, 5, 5)]
    frame = lambda some: spark.createDataFrame(some, "tenant string, at timestamp, t long, c long")
    made = lambda some: us.batch_usage(frame(some), F.col("tenant"), F.col("at"), F.col("t"), F.col("c"))
    path = tempfile.mkdtemp(prefix="spark-usage-")
    for name, some in (("1", rows[:150]), ("2", rows[150:300]), ("2", rows[150:300]), ("late", rows[300:])):
        us.write_batch(made(some), f"{path}/u", name)
    got = us.rolled_up(spark.read.parquet(f"{path}/u"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, made(rows).collect()))
    assert got.filter("period = 'month'").agg(F.sum("tokens")).first()[0] == sum(r[2] for r in rows[:-1])


def test_first_breach_in_order(spark):
    day, month = dt.date(2024, 2, 29), dt.date(2024, 2, 1)
    usage = spark.createDataFrame([("a", "day", day, 10, 1, 1), ("a", "month", month, 500, 70, 9), ("b", "day", day, 10, 5, 1), ("c", "month", dt.date(2024, 1, 1), 9999, 9, 1)], "tenant string, period string, start date, tokens long, cost long, requests long")
    limits = spark.createDataFrame([("a", 0, 2, 500, 1), ("b", 10, 1, 1, 1), ("c", 1, 1, 1, 1), ("d", None, None, None, None)], "tenant string, daily_tokens long, daily_cost long, monthly_tokens long, monthly_cost long")
    got = {r.tenant: tuple(r)[1:] for r in us.quota_states(usage, limits, F.lit(day)).collect()}
    assert got == {"a": ("monthly_tokens", 500, 500, dt.date(2024, 3, 1)), "b": ("daily_tokens", 10, 10, dt.date(2024, 3, 1)), "c": (None,) * 4, "d": (None,) * 4}


def test_archives_keep_one_copy_of_a_text(spark):
    path = tempfile.mkdtemp(prefix="spark-archive-")
    sessions = lambda s: spark.createDataFrame([(s, dt.datetime(2024, 5, 1))], "session string, started timestamp")
    files = lambda s, *texts: spark.createDataFrame([(s, f"f{i}.sql", t) for i, t in enumerate(texts)], "session string, path string, text string")
    errors = spark.createDataFrame([("s1234567890", "f0.sql", "parse", "bad"), ("s1234567890", None, "lost", None)], "session string, path string, stage string, message string")
    none = errors.limit(0)
    archive = SourceArchive(spark, path, buckets=4)
    assert archive.write(sessions("s1234567890"), files("s1234567890", "select é", "select é", None), errors)["vertices"] == 1 + 3 + 1 + 2
    assert archive.write(sessions("s1234567890"), files("s1234567890", "select é", "select é", None), errors)["vertices"] == 0
    other, seen = SourceArchive(spark, path, buckets=4), []

    class Slow(GraphStore):
        def _swap(self, manifest):
            if not seen:  # the same text is archived by another writer in between
                seen.append(other.write(sessions("x"), files("x", "shared"), none))
            return super()._swap(manifest)

    archive.store = Slow(spark, path, 4)
    archive.write(sessions("y"), files("y", "shared", "own"), none)
    texts = archive.texts().collect()
    assert sorted(r.text for r in texts) == ["own", "select é", "shared"] and {r.n_bytes for r in texts if "é" in r.text} == {9}
    assert archive.texts([texts[0].sha256]).count() == 1
    assert {r.name for r in archive.store.vertices("Error").collect()} == {"PARSE_ERROR", "SESSION_ERROR"}
    assert "rev-2024-05-01-s1234567" in {r.name for r in archive.store.vertices("Session").collect()}
    assert archive.store.edges("HAS_TEXT").count() == 2 + 1 + 2


def test_oracle_lines_become_texts_in_order(spark):
    rng = random.Random(3)
    lines = [("HR", "BIG", "PACKAGE BODY", i, f"line {i}" + ("\n" if i % 3 else "")) for i in range(1, 100_001)] + [("HR", "ONE", "function", 1, "return 1;")]
    rng.shuffle(lines)
    objects = spark.createDataFrame([("HR", "BIG", "PACKAGE BODY", dt.datetime(2024, 1, 2)), ("HR", "ONE", "FUNCTION", None), ("HR", "V", "VIEW", dt.datetime(2020, 1, 1)), ("HR", "GONE", "TRIGGER", None), ("HR", "T", "TABLE", None)], "owner string, object_name string, object_type string, last_ddl_time timestamp")
    catalog = {"objects": objects, "lines": spark.createDataFrame(lines, "owner string, name string, type string, line int, text string"), "views": spark.createDataFrame([("HR", "V", "select 1")], "owner string, view_name string, text string")}
    got = {r.name: r for r in ct.fetched("oracle", catalog, ct.Harvest(schema="hr", since=dt.datetime(2023, 1, 1))).collect()}
    assert set(got) == {"BIG", "ONE", "GONE"} and got["GONE"].error == "no text returned" and got["ONE"].text == "return 1;"
    assert got["BIG"].text == "\n".join(f"line {i}" for i in range(1, 100_001))
    functions = spark.createDataFrame([("f", "x -> x")], "name string, text string")
    assert ct.fetched("clickhouse", {"functions": functions}, ct.Harvest()).first().text == "x -> x"
    with pytest.raises(ValueError, match="adapter"):
        ct.fetched("other", {}, ct.Harvest())
    options = ct.split_options("jdbc:postgresql://db.example.com/x", "select 1 as k", "k", 0, 100, 8)
    assert options["dbtable"] == "(select 1 as k) q" and options["numPartitions"] == "8" and "query" not in options
