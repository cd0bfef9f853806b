"""Column functions over identifiers, paths, lists and durations; malformed input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment(geoid: Column, n: int) -> Column:
    """Segment ``n`` (from 1) of a colon-joined id, else null."""
    return F.try_element_at(F.split(geoid, ":"), F.lit(n))


def statement_type(geoid: Column) -> Column:
    """Type of a statement: segment 4."""
    return segment(geoid, 4)


def statement_line(geoid: Column) -> Column:
    """Line of a statement: segment 5 as int, null where it is no number."""
    return segment(geoid, 5).try_cast("int")


def short_name(geoid: Column) -> Column:
    """Segments 3 to 5, colon-joined; the whole id where it has fewer."""
    parts = F.split(geoid, ":")
    return F.when(F.size(parts) >= 5, F.array_join(F.slice(parts, 3, 3), ":")).otherwise(geoid)


def package_of(geoid: Column) -> Column:
    """What stands before the first colon."""
    return F.substring_index(geoid, ":", 1)


def atom_position(atom: Column) -> Column:
    """struct<line, pos> of ``text~line:pos``; null members where absent."""
    place = F.split(F.when(atom.contains("~"), F.substring_index(atom, "~", -1)), ":")
    at = lambda n: F.try_element_at(place, F.lit(n)).try_cast("int")
    return F.struct(at(1).alias("line"), at(2).alias("pos"))


def file_title(path: Column) -> Column:
    """Last part of a path with / or \\ between parts."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def text_list(text: Column) -> Column:
    """A JSON list of strings as an array; empty where it is none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def month_of(at: Column) -> Column:
    """Month prefix, as 2024-01."""
    return F.date_format(at, "yyyy-MM")
