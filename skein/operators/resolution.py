"""Reports on how far sessions' statements and atoms were resolved, over tagged session records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.session_report import CURSORS, STATUSES, TYPES
from skein.session import dropped, saved


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def statement_atoms(records: DataFrame) -> DataFrame:
    """stmt, total and atoms by status of each statement that has atoms."""
    own = records.filter("kind = 'atom'")
    return own.groupBy(F.col("owner").alias("stmt")).agg(F.count(F.lit(1)).alias("total"), *(_count(F.lower("status") == s).alias(s) for s in STATUSES))


def routine_types(records: DataFrame) -> DataFrame:
    """routine and its statements by type: one column a type, cursors together, the rest as other; blank types are not counted."""
    kind = F.upper(F.coalesce("detail", F.lit("")))
    own = records.filter("kind = 'statement'")
    named = [_count(kind == t).alias(t.lower()) for t in TYPES]
    return own.groupBy(F.col("owner").alias("routine")).agg(*named, _count(kind.isin(*CURSORS)).alias("cursor"), _count(~kind.isin(*TYPES, *CURSORS, "")).alias("other"))


def session_rates(records: DataFrame) -> DataFrame:
    """session, statements, atoms, rate: resolved among resolved and unresolved atoms, 1.0 where there are none of either."""
    status = F.lower("status")
    good, bad = (_count((F.col("kind") == "atom") & (status == s)) for s in ("resolved", "unresolved"))
    rate = F.when(good + bad == 0, F.lit(1.0)).otherwise(good / (good + bad))
    return records.groupBy("session").agg(_count(F.col("kind") == "statement").alias("statements"), _count(F.col("kind") == "atom").alias("atoms"), rate.alias("rate"))


def atom_groups(records: DataFrame, top: int = 20) -> DataFrame:
    """part, name, context, n: atoms by ``status``, unresolved ones by ``context``, and the ``top`` unresolved texts with their contexts.

    All three come from one aggregate by (status, text, context), which Spark combines before its shuffle.
    """
    told = F.lower(F.coalesce("status", F.lit("unknown")))
    text = F.regexp_extract(F.coalesce("name", F.lit("")), r"^(.*?)(~[0-9]+:[0-9]+)?$", 1)
    groups = saved(records.filter("kind = 'atom'").groupBy(told.alias("status"), text.alias("text"), F.coalesce("detail", F.lit("")).alias("context")).agg(F.count(F.lit(1)).alias("n")), "atom-groups")
    none, total = F.lit(None).cast("string"), F.sum("n").alias("n")
    status = groups.groupBy("status").agg(total).select(F.lit("status").alias("part"), F.col("status").alias("name"), none.alias("context"), "n")
    lost = groups.filter("status = 'unresolved'")
    contexts = lost.groupBy("context").agg(total).select(F.lit("context").alias("part"), none.alias("name"), "context", "n")
    texts = lost.orderBy(F.desc("n"), "text", "context").limit(top).select(F.lit("text").alias("part"), F.col("text").alias("name"), "context", "n")
    out = saved(status.unionByName(contexts).unionByName(texts), "atom-report")
    dropped(groups)
    return out


def statement_kinds(records: DataFrame) -> DataFrame:
    """type, is_root, n, children, idle: statements by type and place, those below them, and those that neither read nor write."""
    kids = records.filter("kind = 'child'").groupBy(F.col("owner").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    uses = records.filter("kind IN ('read', 'write')").select(F.col("owner").alias("id")).distinct().withColumn("uses", F.lit(True))
    own = records.filter("kind = 'statement'").select("id", F.upper(F.coalesce("detail", F.lit(""))).alias("type"), (F.col("status") == "root").alias("is_root"))
    met = own.join(kids, "id", "left").join(uses, "id", "left")
    return met.groupBy("type", "is_root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("kids", F.lit(0))).alias("children"), _count(F.col("uses").isNull()).alias("idle"))


HEALTH_KINDS = ("session", "routine", "statement", "child", "atom", "output", "affected", "snippet", "read", "write", "call", "parameter", "variable")


def health(records: DataFrame) -> DataFrame:
    """metric, n of the whole store: counts by kind, roots, atoms by status, blank snippets, used tables, idle statements, resolution.

    Two passes: one of plain counts, and one by statement for what is missing or greatest.
    """
    kind, status = F.col("kind"), F.lower("status")
    plain = {f"n_{k}": _count(kind == k) for k in HEALTH_KINDS} | {"n_root": _count((kind == "statement") & (F.col("status") == "root"))}
    plain |= {f"atoms_{s}": _count((kind == "atom") & (status == s)) for s in STATUSES}
    plain |= {"blank_snippets": _count((kind == "snippet") & (F.trim(F.coalesce("name", F.lit(""))) == ""))}
    resolved, lost = (_count((kind == "atom") & (status == s)) for s in ("resolved", "unresolved"))
    plain |= {"resolution_pct": F.when(resolved + lost == 0, F.lit(100)).otherwise(F.floor(resolved * 100 / (resolved + lost)))}
    owner = F.when(kind == "statement", F.col("id")).otherwise(F.col("owner"))
    per = records.filter(kind.isin("statement", "atom", "read", "write", "output")).groupBy(owner.alias("stmt")).agg(*(_count(kind == k).alias(k) for k in ("statement", "atom", "read", "write", "output")))
    known = F.col("statement") > 0
    by_stmt = {"idle_statements": _count(known & (F.col("read") + F.col("write") == 0)), "without_atoms": _count(known & (F.col("atom") == 0)), "without_output": _count(known & (F.col("output") == 0)), "most_atoms": F.max("atom"), "orphan_uses": _count(~known & (F.col("read") + F.col("write") > 0))}
    tables = records.filter("kind IN ('read', 'write')").select("name").distinct().agg(F.count(F.lit(1)).alias("used_tables"))

    def flat(row: DataFrame, names) -> DataFrame:
        return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.coalesce(n, F.lit(0)).cast("long").alias("n")) for n in names))).alias("m")).select("m.*")

    counts = records.agg(*(c.alias(n) for n, c in plain.items()))
    return flat(counts, plain).unionByName(flat(per.agg(*(c.alias(n) for n, c in by_stmt.items())), by_stmt)).unionByName(flat(tables, ["used_tables"]))


def with_lookups(rows: DataFrame, lookups: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Rows with a column for each lookup (name: key column, frame of id and label): the label of the key, empty where there is none.

    Each frame has one row an id; Spark picks each join's way by the frame's size.
    """
    for name, (key, frame) in lookups.items():
        known = frame.select(F.col("id").alias(f"_{name}"), F.col("label").alias(f"_{name}_label"))
        rows = rows.join(known, F.col(key) == F.col(f"_{name}"), "left").withColumn(name, F.coalesce(f"_{name}_label", F.lit(""))).drop(f"_{name}", f"_{name}_label")
    return rows


def statement_extras(records: DataFrame, tops: DataFrame, node: str) -> DataFrame:
    """part, name, n: a root statement's descendants by type, and its tree's atoms by context."""
    under = tops.filter(F.col("root") == node).select(F.col("sub").alias("id"))
    own = records.sparkSession.createDataFrame([(node,)], "id string")
    below = records.filter("kind = 'statement'").join(under, "id", "left_semi")
    types = below.groupBy(F.lit("descendant").alias("part"), F.coalesce("detail", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    atoms = records.filter("kind = 'atom'").join(under.unionByName(own).withColumnRenamed("id", "owner"), "owner", "left_semi")
    return types.unionByName(atoms.groupBy(F.lit("context").alias("part"), F.coalesce("detail", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n")))
