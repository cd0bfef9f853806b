"""The report of harvest sessions: all its loaders fed by one tagged scan, statements as nested trees.

Records are one table of tagged rows: session, kind, id, owner, name, detail, status, line, pos. ``owner`` is what a record hangs on:
the statement of an atom, output column, affected column, snippet, read or write, the parent of a child statement, the routine of a
statement, parameter, variable or call, the package of a routine. Store them partitioned by session, so that a report prunes to its
sessions.

Rows are ranked within (session, kind) by the loaders' orders and cut to the loaders' limits in one window, whose limit Spark
applies before its shuffle. Counts go over all rows, pre-aggregated. What is assembled for one session, the statement tree, is
bounded by the statements' limit. Sessions are reported in parallel, whatever their number.

Defined cases: null names and details are empty; a session without a ``session`` record has no summary; a child whose parent is cut
off by the limit is a root; statements in a circle are in no tree; blank snippets are left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import saved

# fixed values: rows of each loader, as its callers expect
LIMITS = {"statement": 1000, "read": 5000, "write": 5000, "routine": 5000, "parameter": 5000, "variable": 5000, "snippet": 50_000, "atom": 5000, "output": 5000, "affected": 5000, "call": 5000}
ORDERS = {"statement": ("owner", "id"), "atom": ("owner", "line", "pos", "name", "id"), "output": ("owner", "pos", "name"), "affected": ("owner", "pos", "name"), "call": ("owner", "line", "name"), "snippet": ("owner", "name")}
CURSORS = ("CURSOR", "DINAMIC_CURSOR", "DYNAMIC_CURSOR", "FOR_CURSOR")  # fixed values: statement types counted as cursors
TYPES = ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE")
STATUSES = ("resolved", "unresolved", "constant", "function_call")


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def summaries(records: DataFrame) -> DataFrame:
    """session, item: name, dialect, routines, root statements by type, atoms by status, in one pass without a shuffle of rows."""
    kind, status, type_ = F.col("kind"), F.lower("status"), F.upper("detail")
    root = (kind == "statement") & (F.col("status") == "root")
    types = [_count(root & (type_ == t)) for t in TYPES]
    counts = [_count(kind == "routine"), *types, _count(root & type_.isin(*CURSORS)), _count(root & ~type_.isin(*TYPES, *CURSORS) & (type_ != "")), _count(kind == "atom"), *(_count((kind == "atom") & (status == s)) for s in STATUSES)]
    named = F.max(F.when(kind == "session", F.struct(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("detail", F.lit("")).alias("detail"))))
    out = records.groupBy("session").agg(named.alias("own"), F.concat_ws("|", *(c.cast("string") for c in counts)).alias("counts")).filter("own IS NOT NULL")
    return out.select("session", F.concat_ws("|", "own.name", "own.detail", "counts").alias("item"))


def ranked(records: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Records of limited kinds with their ``rank`` within session and kind, each kind to its limit."""
    kind = F.col("kind")
    keys = []
    for place in range(max(map(len, ORDERS.values()))):
        text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
        for name in limits:
            order = ORDERS.get(name, ("owner", "name", "id"))
            if place < len(order):
                if order[place] in ("line", "pos"):
                    number = F.when(kind == name, F.col(order[place])).otherwise(number)
                else:
                    text = F.when(kind == name, F.col(order[place])).otherwise(text)
        keys += [number, text]
    rows = records.filter(kind.isin(*limits) & ((kind != "snippet") | (F.trim(F.coalesce("name", F.lit(""))) != "")))
    rank = F.row_number().over(Window.partitionBy("session", "kind").orderBy(*keys))
    limit = F.coalesce(*(F.when(kind == k, n) for k, n in limits.items()))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= max(limits.values())).filter(F.col("rank") <= limit)


def _tree(rows: pd.DataFrame) -> pd.DataFrame:
    """One session's statements depth first: parents before children, siblings by rank."""
    rows = rows.sort_values("rank")
    parent = dict(zip(rows["id"], rows["parent"], strict=True))
    below: dict[str | None, list[str]] = {}
    for own in rows["id"]:
        up = parent[own] if parent[own] in parent else None
        below.setdefault(up, []).append(own)
    place, stack = {}, [(own, 0) for own in reversed(below.get(None, []))]
    while stack:
        own, depth = stack.pop()
        place[own] = (len(place) + 1, depth, len(below.get(own, [])))
        stack += [(child, depth + 1) for child in reversed(below.get(own, []))]
    shown = rows[rows["id"].isin(place)]
    at, depth, children = zip(*(place[i] for i in shown["id"]), strict=True) if len(shown) else ((), (), ())
    return pd.DataFrame({"session": shown["session"], "id": shown["id"], "at": pd.Series(at, shown.index, "int64"), "depth": pd.Series(depth, shown.index, "int64"), "children": pd.Series(children, shown.index, "int64")})


def statement_trees(records: DataFrame, kept: DataFrame) -> DataFrame:
    """session, at, item of each session's statements, nested: atoms by status, sources and targets beside each."""
    own = kept.filter("kind = 'statement'").select("session", "id", F.col("owner").alias("routine"), "detail", "line", "rank")
    parents = records.filter("kind = 'child'").groupBy("session", "id").agg(F.min("owner").alias("parent"))
    trees = own.join(parents, ["session", "id"], "left").select("session", "id", "parent", "rank").groupBy("session").applyInPandas(_tree, "session string, id string, at long, depth long, children long")
    atoms = records.filter("kind = 'atom'").groupBy("session", F.col("owner").alias("id")).agg(F.concat_ws("/", F.count(F.lit(1)).cast("string"), *(_count(F.lower("status") == s).cast("string") for s in STATUSES)).alias("atoms"))
    listed = lambda k: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name")))), ",")
    uses = kept.filter("kind IN ('read', 'write')").groupBy("session", F.col("owner").alias("id")).agg(listed("read").alias("sources"), listed("write").alias("targets"))
    joined = trees.join(own, ["session", "id"]).join(atoms, ["session", "id"], "left").join(uses, ["session", "id"], "left")
    text = lambda c, none="": F.coalesce(F.col(c).cast("string"), F.lit(none))
    return joined.select("session", "at", F.concat_ws("|", text("depth"), text("id"), text("detail"), text("line"), text("routine"), text("atoms", "0/0/0/0/0"), text("sources"), text("targets"), text("children")).alias("item"))


def used_tables(records: DataFrame) -> DataFrame:
    """session, item: each table a session's statements read or write, with both counts."""
    uses = records.filter("kind IN ('read', 'write')").groupBy("session", "name").agg(*(_count(F.col("kind") == k).alias(k) for k in ("read", "write")))
    return uses.select("session", F.concat_ws("|", "name", F.col("read").cast("string"), F.col("write").cast("string")).alias("item"))


def session_report(records: DataFrame, sessions: list[str] | None = None, limits: dict[str, int] = LIMITS) -> DataFrame:
    """session, section, at, item: the report of the asked sessions, or of all."""
    rows = saved(records if sessions is None else records.filter(F.col("session").isin(*sessions)), "session-records")
    kept = saved(ranked(rows, limits), "session-kept")
    numbered = lambda df, section: df.withColumn("at", F.row_number().over(Window.partitionBy("session").orderBy("item"))).select("session", F.lit(section).alias("section"), F.col("at").cast("long").alias("at"), "item")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = kept.filter(~F.col("kind").isin("statement", "read", "write"))
    lists = plain.select("session", F.col("kind").alias("section"), F.col("rank").cast("long").alias("at"), F.concat_ws("|", *map(text, ("owner", "name", "detail", "status", "line", "pos"))).alias("item"))
    trees = statement_trees(rows, kept).select("session", F.lit("statement").alias("section"), "at", "item")
    return numbered(summaries(rows), "summary").unionByName(numbered(used_tables(rows), "table")).unionByName(trees).unionByName(lists)


def snippets_of(records: DataFrame, statements: list[str]) -> DataFrame:
    """Snippets of a list of statements that a caller holds: id, snippet; blanks are none."""
    asked = records.sparkSession.createDataFrame([(s,) for s in set(statements)], "owner string")
    found = records.filter((F.col("kind") == "snippet") & (F.trim(F.coalesce("name", F.lit(""))) != "")).join(asked, "owner", "left_semi")
    return found.select(F.col("owner").alias("id"), F.col("name").alias("snippet"))


def lines_of(scripts: DataFrame) -> DataFrame:
    """Scripts (file, script) cut into lines once: file, line (from 1), text. What a statement shows is then a range of lines."""
    return scripts.select("file", F.posexplode(F.split("script", "\r\n|\r|\n")).alias("at", "text")).select("file", (F.col("at") + 1).cast("long").alias("line"), "text")


def source_of(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Text of spans (id, file, first, last) from lines: id, n_lines, source. A span's lines are met by file and line, not by range."""
    wanted = spans.select("id", "file", F.explode(F.sequence(F.greatest("first", F.lit(1)).cast("long"), F.greatest("last", "first", F.lit(1)).cast("long"))).alias("line"))
    got = wanted.join(lines, ["file", "line"]).groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("rows"))
    return got.select("id", "n_lines", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("source"))
