"""Column functions for durations, dates, payloads, adapters and error classes; malformed input gives null or a default, never an error."""

from __future__ import annotations

import ipaddress
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of the sources that scripts are fetched from.
ADAPTERS = {"jdbc:oracle:": "oracle", "jdbc:postgresql:": "postgresql", "jdbc:clickhouse:": "clickhouse"}


def duration(ms: Column) -> Column:
    """Milliseconds as ``12ms``, ``3.4s`` or ``2m05s``."""
    seconds = F.floor(ms / 1000)
    return F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms"))).when(ms < 60_000, F.concat(F.format_string("%.1f", F.bround(ms / 1000, 1)), F.lit("s"))).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"), F.lpad((seconds % 60).cast("string"), 2, "0"), F.lit("s")))


def today(at: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def next_day(day: Column) -> Column:
    return F.date_add(day, 1)


def next_month(day: Column) -> Column:
    return F.add_months(F.trunc(day, "month"), 1)


def payload_number(payload: Column, key: str, default: float = 0.0) -> Column:
    """A number of a JSON payload; ``default`` where it is absent or none."""
    return F.coalesce(F.get_json_object(payload, f"$.{key}").try_cast("double"), F.lit(default))


def payload_text(payload: Column, key: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(payload, f"$.{key}"), F.lit(default))


def adapter(url: Column) -> Column:
    """Which source a url names: by its prefix, or arcadedb anywhere in it; else null."""
    low = F.lower(url)
    out = F.when(low.contains("arcadedb"), F.lit("arcadedb"))
    for prefix, name in reversed(ADAPTERS.items()):
        out = F.when(low.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def error_class(state: Column) -> Column:
    """What went wrong by the class of an SQLSTATE."""
    head = F.substring(state, 1, 2)
    return F.when(head == "08", "CONNECTION").when(head == "28", "AUTHENTICATION").when(head == "42", "PERMISSION_OR_SYNTAX").when(head == "53", "RESOURCES").when(head == "57", "CANCELLED").otherwise("OTHER")


def hashes(text: Column) -> Column:
    """struct<sha256, md5, base64> of a text."""
    return F.struct(F.sha2(text, 256).alias("sha256"), F.md5(text).alias("md5"), F.base64(text.cast("binary")).alias("base64"))


def allowed_url(url: str, schemes: tuple[str, ...] = tuple(ADAPTERS)) -> bool:
    """Whether a JDBC url may be connected to: of a known kind, and to no loopback, private, link-local or reserved address."""
    if not any(url.lower().startswith(s) for s in schemes):
        return False
    rest = url[url.index(":", 5) + 1 :]
    host = urlsplit(rest if rest.startswith("//") else "//" + rest.split("@")[-1].lstrip("/")).hostname
    if not host or host.lower() == "localhost" or host.lower().endswith((".localhost", ".internal", ".local")):
        return False
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return not host.replace(".", "").isdigit()
    return address.is_global


def assistant_query(query: Column, verbs: tuple[str, ...] = ("insert ", "update ", "delete ", "drop ", "create ", "truncate ", "alter ", "merge ")) -> Column:
    """Whether an assistant may run a query: it has no writing verb and says how many rows it wants."""
    low = F.lower(query)
    writes = F.lit(False)
    for verb in verbs:
        writes = writes | low.contains(verb)
    return F.coalesce(~writes & low.contains("limit"), F.lit(False))
