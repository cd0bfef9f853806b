"""Rate limits against a walk over the calls, glossary lookups, escapes and versions."""

import random

from pyspark.sql import functions as F

from skein.operators import lookups as lk
from skein.streaming.platform import rate_gate


def test_rate_limits_match_a_walk(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(0, 4000), rng.choice(["user", "super", None])) for i in range(600)]
    limits = ((100, 3), (900, 12))
    got = {r.i: r.allowed for r in rate_gate(spark.createDataFrame(rows, "i int, t string, at long, role string"), "t", "at", "i", F.col("role") == "super", limits).collect()}
    state, want = {}, {}
    for i, tenant, at, role in sorted(rows, key=lambda r: (r[2], r[0])):
        if role == "super":
            want[i] = True
            continue
        own = state.setdefault(tenant, [[0, None] for _ in limits])
        for slot, (span, _) in zip(own, limits, strict=True):
            if slot[1] is None or at > slot[1]:
                slot[:] = [0, at + span]
            slot[0] += 1
        want[i] = all(slot[0] <= most for slot, (_, most) in zip(own, limits, strict=True))
    assert got == want and len(set(want.values())) == 2
    assert rate_gate(spark.createDataFrame([], "i int, t string, at long"), "t", "at", "i", F.lit(False)).count() == 0


def test_entries_are_found_by_text_as_it_stands(spark):
    rows = spark.createDataFrame([("g1", "k", "100% sure", None), ("g2", None, None, "of 100%"), ("g3", "k", "1000", "x")], "geoid string, kind string, label string, description string")
    assert [r.geoid for r in lk.search_entries(rows, "100%").collect()] == ["g1", "g2"]
    assert lk.search_entries(rows, "  ").count() == 0 and lk.entry_of(rows, "none").count() == 0
    assert tuple(lk.entry_of(rows, "g2").first()) == ("g2", "", "", "of 100%")


def test_escapes_and_versions(spark):
    row = spark.range(1).select(lk.escaped(F.lit("a'b''")).alias("e"), lk.escaped(F.lit(None).cast("string")).alias("n"), lk.version_state(F.lit(2), (1, 2)).alias("s"), lk.version_state(F.lit(1), (1, 2), (1,)).alias("d"), lk.version_state(F.lit(9), (1,)).alias("u")).first()
    assert tuple(row) == ("a''b''''", "", "supported", "deprecated", "unsupported")
