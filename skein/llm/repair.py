"""Conversation structure repair: Dijkstra on the implicit lattice of (turn index, grammar state).

A conversation's rows, by turn, are repaired into roles whose initials read ``(s?(ua)+)?`` by edits: K keeps a row (0), R gives it
another role, user or assistant (3), D deletes it (4; blank rows and duplicates must go), I inserts an empty user or assistant row
anywhere (3). A truncated row that stays costs 3 more. A node is (rows consumed, state): 0 nothing yet, 1 after s, 2 after u, 3
after a. Nodes leave the queue by (cost, audit), the audit being the edits' initials, and the first accepting end node to leave it
ends the search. At one node no audit of a cost begins another of that cost (they would differ by insertions, which are not
free), so the order of audits holds when both go on.

Plan: rows are range-partitioned by (conversation, turn, role, start of the text) and sorted, and each partition is read once in
order. A conversation that lies wholly inside a partition and has at most ``block`` rows is solved there. All others (the first and
last of a partition, and longer ones, of which one may hold a third of all rows) go on as rows with their place:

1. Duplicates among them are found by the first place of each (conversation, role, text), pre-aggregated.
2. Each block of rows is solved from each state to each state, in parallel.
3. One row a block meets in the conversation's order and carries the best (cost, audit) of each state.
4. The states passed pick each block's edits; the blocks' repaired rows are streamed into the digest in order.

So no task holds more than a block's rows, and only audits, which are results, grow with a conversation.

Defined cases: null conv_id, turn, role and text read as one space where they are text; rows of null conv_id are one conversation;
null turns come first; rows of one turn are taken by role, then text; repeated rows are duplicates; a role's initial is its first
code point, and an empty role has none and is never kept; a conversation of which no row is left has zeros, an empty audit and the
digest of the empty string; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import saved

BLOCK = 512  # rows that one search spans
SPACE = "\x20\x09-\x0d"
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
PUT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
ACCEPTING = (0, 3)
LEGAL = ("su", "ua", "au")
BLANK, DUPLICATE, CUT = 1, 2, 3  # a row's first fault


class Row(NamedTuple):
    role: str
    text: str
    fault: int  # 0 if none


def search(rows: list[Row], start: int, ends: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) from ``start`` to each state of ``ends`` after all rows; all of them must be within reach.

    Without ``ends`` the first accepting state ends the search.
    """
    wanted, found, done = set(ends or ACCEPTING), {}, set()
    queue = [(0, "", 0, start)]
    while queue:
        cost, audit, at, state = heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in wanted:
            found[state] = (cost, audit)
            if not ends or len(found) == len(wanted):
                break
        after, _ = PUT[state]
        heappush(queue, (cost + INSERT, audit + "I", at, after))
        if at < len(rows):
            row = rows[at]
            heappush(queue, (cost + DELETE, audit + "D", at + 1, state))
            if row.fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if row.fault == CUT else 0
                heappush(queue, (cost + REROLE + more, audit + "R", at + 1, after))
                if kept := KEPT.get((state, row.role[:1])):
                    heappush(queue, (cost + more, audit + "K", at + 1, kept))
    return found


def repaired(rows: list[Row], audit: str, state: int) -> Iterator[str]:
    """``role:text`` of each row that the edits leave."""
    left = iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit == "D":
            continue
        after, role = PUT[state]
        if edit == "K":
            after, role = KEPT[state, row.role[:1]], row.role
        yield f"{role}:{row.text if row else ''}"
        state = after


def fault_of(text: str, seen: bool) -> int:
    bare = text.strip(" \t\n\x0b\x0c\r")
    return BLANK if not bare else DUPLICATE if seen else CUT if bare[-1] not in ".!?" else 0


def illegal_steps(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
OPEN = [("part", T.IntegerType()), ("place", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType())]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows that damage leaves, by crc32 of ``conv_id:turn`` modulo 20."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    hit = rows.select("conv_id", "turn", kind.alias("kind"), named("role").alias("role"), named("text").alias("text")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)))).alias("nth")
    return hit.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), times).drop("nth")


def _solve(turns: list[int | None], pairs: list[tuple[str, str]]) -> dict:
    """The result of one whole conversation, rows in order."""
    seen, rows = set(), []
    for role, text in pairs:
        rows.append(Row(role, text, fault_of(text, (role, text) in seen)))
        seen.add((role, text))
    cost, audit = min(search(rows, 0, ()).values())
    known = [t for t in turns if t is not None]
    faults = [r.fault for r in rows]
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
        "illegal": illegal_steps([r.role[:1] for r in rows]), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(repaired(rows, audit, 0)).encode()).hexdigest(),
    }


def _in_order(block: int, schema: T.StructType):
    """A pass over a sorted partition: a row with ``result`` for each conversation inside it, the rows of the others with their place."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def rows_of(batches):
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)

    def run(batches):
        out, place, first = [], 0, True

        def full():
            return sum(len(r["text"] or "") + 64 for r in out) > 4_000_000 or len(out) >= 4096

        def batch():
            made = pa.RecordBatch.from_pylist(out, arrow)
            out.clear()
            return made

        def opened(part, conv, some):
            nonlocal place
            for turn, role, text in some:
                out.append({"conv_id": conv, "part": part, "place": place, "turn": turn, "role": role, "text": text, "result": None})
                place += 1

        waiting = None  # the last conversation read, if it may be whole
        for (part, conv), rows in groupby(rows_of(batches), key=lambda r: (r[0], r[1])):
            if waiting:
                _, before, some = waiting
                out.append({"conv_id": before, "part": None, "place": None, "turn": None, "role": None, "text": None, "result": _solve([t for t, _, _ in some], [(r, x) for _, r, x in some])})
                waiting = None
            held, whole = [], not first
            first = False
            for row in rows:
                held.append(row[2:])
                if not whole or len(held) > block:
                    whole = False
                    opened(part, conv, held)
                    held = []
                    if full():
                        yield batch()
            if whole:
                waiting = part, conv, held
            if full():
                yield batch()
        if waiting:
            opened(*waiting)
        if out:
            yield batch()

    return run


def _block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One block of an open conversation: its counts, ends and best edits from each state to each state."""
    rows = rows.sort_values("place")
    own = [Row(r, t, fault_of(t, s)) for r, t, s in zip(rows["role"], rows["text"], rows["seen"], strict=True)]
    initials, faults = [r.role[:1] for r in own], [r.fault for r in own]
    # nothing leads back to states 0 and 1, and from 0 to 1 only a kept row
    system = any(r.role[:1] == "s" and r.fault not in (BLANK, DUPLICATE) for r in own)
    reach = {0: (0, 1, 2, 3) if system else (0, 2, 3), 1: (1, 2, 3), 2: (2, 3), 3: (2, 3)}
    best = [{"start": s, "state": e, "cost": c, "audit": a} for s, ends in reach.items() for e, (c, a) in search(own, s, ends).items()]
    return pd.DataFrame({
        "group": [key[0]], "part": [key[1]], "block": [key[2]], "blank": [faults.count(BLANK)], "duplicate": [faults.count(DUPLICATE)], "truncated": [faults.count(CUT)],
        "illegal": [illegal_steps(initials)], "first": [initials[0]], "last": [initials[-1]], "best": [best],
    })


BLOCKS = "group string, part int, block long, blank long, duplicate long, truncated long, illegal long, first string, last string, best array<struct<start:int,state:int,cost:long,audit:string>>"
CHOSEN = "group string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits array<struct<part:int,block:long,start:int,audit:string>>"


def _choose(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
    """The best way through the blocks of one conversation."""
    blocks = blocks.sort_values(["part", "block"])
    ways: dict[int, tuple[int, str, list]] = {0: (0, "", [])}
    for part, block, best in zip(blocks["part"], blocks["block"], blocks["best"], strict=True):
        on: dict[int, tuple[int, str, list]] = {}
        for b in best:
            if b["start"] in ways:
                cost, audit, path = ways[b["start"]]
                way = (cost + b["cost"], audit + b["audit"])
                if b["state"] not in on or way < on[b["state"]][:2]:
                    on[b["state"]] = (*way, (path, part, block, b["start"], b["audit"]))
        ways = on
    cost, audit, path = min((ways[s] for s in ACCEPTING if s in ways), key=lambda w: w[:2])
    edits = []
    while path:
        path, *step = path
        edits.append(dict(zip(("part", "block", "start", "audit"), step, strict=True)))
    steps = sum(a + b not in LEGAL for a, b in zip(blocks["last"][:-1], blocks["first"][1:], strict=True))
    return pd.DataFrame({"group": [key[0]], **{c: [int(blocks[c].sum())] for c in ("blank", "duplicate", "truncated")}, "illegal": [int(blocks["illegal"].sum()) + steps], "cost": [cost], "audit": [audit], "edits": [edits]})


def _digests(batches):
    """group and repaired_sha256 of rows (group, piece) in order; an empty piece is a block that leaves no row."""
    group, digest, begun = None, None, False
    for batch in batches:
        out = []
        for own, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != group:
                if digest:
                    out.append((group, digest.hexdigest()))
                group, digest, begun = own, hashlib.sha256(), False
            if piece:
                digest.update((("\n" if begun else "") + piece).encode())
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.string()), pa.array([d for _, d in out], pa.string())], ["group", "repaired_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([digest.hexdigest()])], ["group", "repaired_sha256"])


def _piece(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("place")
    own = [Row(r, t, 0) for r, t in zip(rows["role"], rows["text"], strict=True)]
    return pd.DataFrame({"group": [key[0]], "part": [key[1]], "block": [key[2]], "piece": ["\n".join(repaired(own, rows["audit"].iloc[0], int(rows["start"].iloc[0])))]})


def _open_results(rows: DataFrame, block: int) -> DataFrame:
    """group and result of the conversations whose rows were left open."""
    rows = rows.withColumn("key", F.sha2(F.concat(F.col("group"), F.lit("|"), F.length("role").cast("string"), F.lit("|"), "role", "text"), 256))
    at = F.struct("part", "place")
    firsts = rows.groupBy("key").agg(F.min(at).alias("earliest"))
    faulty = rows.join(firsts, "key").select("group", "part", F.floor(F.col("place") / block).alias("block"), "place", "role", "text", (at > F.col("earliest")).alias("seen"))
    placed = saved(faulty, "open-rows")
    cell = ["group", "part", "block"]
    blocks = placed.groupBy(*cell).applyInPandas(_block, BLOCKS)
    chosen = saved(blocks.groupBy("group").applyInPandas(_choose, CHOSEN), "chosen")
    edits = chosen.select("group", F.explode("edits").alias("edit")).select("group", "edit.*")
    pieces = placed.join(edits, cell).groupBy(*cell).applyInPandas(_piece, "group string, part int, block long, piece string")
    # a task reads one row a block
    digests = pieces.repartition("group").sortWithinPartitions(*cell).select("group", "piece").mapInArrow(_digests, "group string, repaired_sha256 string")
    # turns are counted once each before their conversation's are
    turns = rows.groupBy("group", "turn").count().groupBy("group").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    joined = chosen.drop("edits").join(turns, "group").join(digests, "group")
    return joined.select("group", F.struct(F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), *(f for f in RESULT.names[1:])).alias("result"))


def _group(conv_id: str | Column = "conv_id") -> Column:
    """A conversation's id as text that tells a null from a space."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def repair_rows(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """group and result for each conversation of rows (conv_id, turn, role, text), without nulls in role and text."""
    by = ["group", "turn", "role"]
    near = rows.select(_group().alias("group"), "turn", "role", "text").withColumn("head", F.substring("text", 1, 64))
    sorted_ = near.repartitionByRange(*by, "head").sortWithinPartitions(*by, "text").select(F.spark_partition_id().alias("part"), *by, "text")
    schema = T.StructType([T.StructField("conv_id", T.StringType()), *(T.StructField(n, t) for n, t in OPEN), T.StructField("result", RESULT)])
    passed = saved(sorted_.mapInArrow(_in_order(block, schema), schema).withColumnRenamed("conv_id", "group"), "conversations")
    inside = passed.filter("result IS NOT NULL").select("group", "result")
    return inside.unionByName(_open_results(passed.filter("result IS NULL").drop("result"), block))


def repair(conversations: DataFrame, block: int = BLOCK, damaged: bool = False) -> DataFrame:
    """conv_id and the contract's figures for every conversation of the table, after damage where ``damaged``."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    left = damage(rows) if damaged else rows.select("conv_id", F.col("turn").cast("long").alias("turn"), named("role"), named("text"))
    every = rows.select("conv_id", _group().alias("group")).distinct()
    none = {n: F.lit(hashlib.sha256(b"").hexdigest()) if n == "repaired_sha256" else F.lit("") if n == "audit" else F.lit(0).cast("long") for n in RESULT.names}
    found = every.join(repair_rows(left, block), "group", "left")
    return found.select("conv_id", *(F.coalesce(F.col("result")[n], none[n]).alias(n) for n in RESULT.names))
