"""Spans of regular expressions as column expressions: code-point positions without Python.

A span is struct<start, end, kind, value>; start counts code points from 0, end is exclusive. All work is linear in the
text and its matches (but for sorting): positions are prefix sums taken in blocks, and texts are cut and
rewritten in chunks, since taking a substring reads its string from the start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"
BLOCK = 256  # of prefix sums
CHUNK = 2048  # code points


def no_spans() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each member of an array of longs, the members before it joined by an associative function.

    What stands before a member is what stands before its block and what stands before it in its block.
    """
    whole = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), zero, join))
    before = lambda blocks: F.transform(blocks, lambda _, b: F.aggregate(F.slice(blocks, F.lit(1), b), zero, join))
    inner = lambda v, i: F.aggregate(F.slice(v, i - i % BLOCK + 1, i % BLOCK), zero, join)
    placed = lambda v, head: F.transform(v, lambda _, i: join(F.get(head, F.floor(i / BLOCK).cast("int")), inner(v, i)))
    return let(values, lambda v: let(let(whole(v), before), lambda head: placed(v, head)))


def find_spans(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches the empty string.

    The text is cut at its matches; lengths of gaps and matches add up to the positions.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    plus = lambda a, b: a + b

    def placed(m: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda g, v: F.struct(F.length(g).cast("long").alias("gap"), v.alias("value"), (F.length(g) + F.length(v)).cast("long").alias("both")))
        span = lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["both"]).alias("end"), F.lit(kind).alias("kind"), p["value"].alias("value"))
        return let(pairs, lambda ps: F.zip_with(ps, running(F.transform(ps, lambda p: p["both"]), F.lit(0).cast("long"), plus), span))

    return let(matches, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(no_spans()))


def in_order(spans: Column, kinds: tuple[str, ...]) -> Column:
    """Spans by start, then by the order of ``kinds``, then by end."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], rank(s), s["end"], s["kind"], s["value"])))
    return F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def between(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that is cut into ``chunks``."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    at = lambda n: F.coalesce(F.get(chunks, n), F.lit(""))
    inside = lambda p: (p % CHUNK).cast("int")
    one = F.substring(at(first), inside(start) + 1, (end - start).cast("int"))
    whole = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(first == last, one).otherwise(F.concat(F.substring(at(first), inside(start) + 1, F.lit(CHUNK)), whole, F.substring(at(last), F.lit(1), inside(end))))


def chunked(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _pieces(text: Column, spans: Column, piece: Callable[[Column, Column, Column], Column]) -> Column:
    """The text rebuilt from ``piece(chunks, span, end of what stands before)`` of each span (in order), and its rest."""
    ends = lambda ss: running(F.transform(ss, lambda s: s["end"]), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
    rest = lambda ss, cut: between(cut, F.array_max(F.transform(ss, lambda s: s["end"])), F.length(text).cast("long"))
    built = lambda ss, cut: F.concat(F.array_join(F.zip_with(ss, ends(ss), lambda s, upto: piece(cut, s, upto)), ""), rest(ss, cut))
    return F.when(F.size(spans) > 0, let(chunked(text), lambda cut: let(spans, lambda ss: built(ss, cut)))).otherwise(text)


def rewritten(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text with each span (in order) replaced by ``replacement(span)``; of overlapping spans the first names the replacement."""
    return _pieces(text, spans, lambda cut, s, upto: F.when(s["start"] >= upto, F.concat(between(cut, upto, s["start"]), replacement(s))).otherwise(F.lit("")))


def masked(text: Column, spans: Column) -> Column:
    """The text with each code point of the spans (in order) as 0; positions stay."""
    zeros = lambda a, b: F.repeat(F.lit("0"), F.greatest(b - a, F.lit(0)).cast("int"))
    return _pieces(text, spans, lambda cut, s, upto: F.when(s["start"] >= upto, F.concat(between(cut, upto, s["start"]), zeros(s["start"], s["end"]))).otherwise(zeros(upto, s["end"])))
