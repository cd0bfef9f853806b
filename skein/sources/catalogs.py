"""Scripts of databases: what to harvest, catalog inventories, and the options to read them over JDBC or from TSV."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.values import allowed_url

KINDS = ("FUNCTION", "PROCEDURE", "PACKAGE", "PACKAGE BODY", "TRIGGER", "VIEW")


@dataclass(frozen=True)
class Harvest:
    """What to fetch: a schema, object kinds, only what changed since a time (objects without a time always), at most so many."""

    schema: str | None = None
    kinds: tuple[str, ...] = KINDS
    since: dt.datetime | None = None
    limit: int | None = None


def selected(objects: DataFrame, harvest: Harvest) -> DataFrame:
    """The objects (owner, name, kind, changed, ...) of a harvest. Filters come first, so that a JDBC source carries them out."""
    out = objects.filter(F.upper("kind").isin(*(k.upper() for k in harvest.kinds)))
    if harvest.schema:
        out = out.filter(F.upper("owner") == harvest.schema.upper())
    if harvest.since is not None:
        out = out.filter(F.col("changed").isNull() | (F.col("changed") > F.lit(harvest.since)))
    return out if harvest.limit is None else out.orderBy("owner", "name", "kind").limit(harvest.limit)


def jdbc_options(url: str, query: str, fetch: int = 1000, **more: str) -> dict[str, str]:
    """Options of ``spark.read.format("jdbc")`` for a query; a url that may not be connected to is a ValueError."""
    if not allowed_url(url):
        raise ValueError(f"{url} may not be connected to")
    return {"url": url, "query": query, "fetchsize": str(fetch), **more}


def read_jdbc(spark: SparkSession, url: str, query: str, **more: str) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **more)).load()


def postgres_objects(namespaces: DataFrame, procs: DataFrame, classes: DataFrame, triggers: DataFrame) -> DataFrame:
    """Functions, procedures, views and triggers of a PostgreSQL catalog, without its own schemas: owner, name, kind, text.

    namespaces (oid, nspname), procs (proname, pronamespace, prokind, src), classes (oid, relname, relnamespace, relkind,
    src), triggers (tgrelid, tgname, src, tgisinternal); src holds the definition.
    """
    spaces = namespaces.filter(~F.col("nspname").isin("pg_catalog", "information_schema")).select(F.col("oid").alias("space"), F.col("nspname").alias("owner"))
    routines = procs.filter(F.col("prokind").isin("f", "p")).join(spaces, F.col("pronamespace") == F.col("space")).select("owner", F.col("proname").alias("name"), F.when(F.col("prokind") == "p", "PROCEDURE").otherwise("FUNCTION").alias("kind"), F.col("src").alias("text"))
    held = classes.join(spaces, F.col("relnamespace") == F.col("space"))
    views = held.filter(F.col("relkind").isin("v", "m")).select("owner", F.col("relname").alias("name"), F.lit("VIEW").alias("kind"), F.col("src").alias("text"))
    fired = triggers.filter(~F.col("tgisinternal")).select("tgrelid", "tgname", F.col("src").alias("text")).join(held.select("oid", "owner"), F.col("tgrelid") == F.col("oid")).select("owner", F.col("tgname").alias("name"), F.lit("TRIGGER").alias("kind"), "text")
    return routines.unionByName(views).unionByName(fired)


def tsv_functions(spark: SparkSession, path: str) -> DataFrame:
    """SQL-defined functions of TSV lines, cut at the first tab, with \\t and \\n in the text undone: name, text."""
    lines = spark.read.text(path)
    at = F.instr("value", "\t")
    text = F.when(at > 0, F.replace(F.replace(F.substring(F.col("value"), at + 1, F.length("value")), F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")))
    return lines.filter(F.col("value") != "").select(F.when(at > 0, F.substring(F.col("value"), F.lit(1), at - 1)).otherwise(F.col("value")).alias("name"), text.alias("text"))


CHUNK = 1000  # lines that are joined at once


def assembled(lines: DataFrame, keys: tuple[str, ...] = ("owner", "name", "kind"), chunk: int = CHUNK) -> DataFrame:
    """Source lines (keys, line, text) as one text an object: keys, n_lines, text.

    Lines are joined by chunks of their numbers and the chunks by object, so that no task gathers more than a chunk of rows and
    one row a chunk. Lines end as they are stored; a line that lacks its end is given one, but for the last.
    """
    ended = F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")))
    own = lines.select(*keys, "line", ended.alias("text"), F.floor(F.col("line") / chunk).alias("chunk"))
    joined = lambda df, by, at: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(at, "text"))).alias("rows"), F.sum("n").alias("n"))
    text = F.array_join(F.transform("rows", lambda r: r["text"]), "")
    chunks = joined(own.withColumn("n", F.lit(1).cast("long")), (*keys, "chunk"), "line").select(*keys, "chunk", text.alias("text"), "n")
    return joined(chunks, keys, "chunk").select(*keys, F.col("n").alias("n_lines"), F.regexp_replace(text, r"\n\z", "").alias("text"))


def oracle_objects(objects: DataFrame, lines: DataFrame, views: DataFrame) -> DataFrame:
    """Objects of an Oracle catalog with their texts: owner, name, kind, changed, text, error.

    objects (owner, object_name, object_type, last_ddl_time, status), lines (owner, name, type, line, text), views (owner,
    view_name, text). An object without a text has an error; invalid objects come as they are.
    """
    told = objects.select("owner", F.col("object_name").alias("name"), F.upper("object_type").alias("kind"), F.col("last_ddl_time").alias("changed")).filter(F.col("kind").isin(*KINDS))
    texts = assembled(lines.select("owner", "name", F.upper("type").alias("kind"), "line", "text")).select("owner", "name", "kind", "text")
    texts = texts.unionByName(views.select("owner", F.col("view_name").alias("name"), F.lit("VIEW").alias("kind"), "text"))
    return told.join(texts, ["owner", "name", "kind"], "left").withColumn("error", F.when(F.col("text").isNull(), F.lit("no text returned")))


def split_options(url: str, query: str, column: str, lower: int, upper: int, parts: int, **more: str) -> dict[str, str]:
    """Options of a JDBC read of a query in ``parts`` ranges of a numeric column, each a task's own connection."""
    if parts < 1 or upper < lower:
        raise ValueError("a read needs a range and at least one part")
    base = jdbc_options(url, query, **more)
    return {k: v for k, v in base.items() if k != "query"} | {"dbtable": f"({query}) q", "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(parts)}


def fetched(adapter: str, catalog: dict[str, DataFrame], harvest: Harvest) -> DataFrame:
    """Scripts of a database by its adapter (oracle, postgresql, clickhouse): owner, name, kind, text, error.

    ``catalog`` has the frames that the adapter's function takes, by name.
    """
    if adapter == "oracle":
        found = oracle_objects(**catalog)
    elif adapter == "postgresql":
        found = postgres_objects(**catalog).withColumns({"changed": F.lit(None).cast("timestamp"), "error": F.lit(None).cast("string")})
    elif adapter == "clickhouse":
        found = catalog["functions"].select(F.lit(harvest.schema).cast("string").alias("owner"), "name", F.lit("FUNCTION").alias("kind"), "text").withColumns({"changed": F.lit(None).cast("timestamp"), "error": F.lit(None).cast("string")})
    else:
        raise ValueError(f"no adapter {adapter}")
    return selected(found, harvest).select("owner", "name", "kind", "text", "error")
