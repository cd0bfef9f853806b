"""What a view shows: scopes of many sources at once, hoisted reads, display flags, contraction of hidden nodes, grouped overviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.lineage import Graph, root_of
from skein.session import dropped, saved

WORD = 64  # sources whose bits one number holds
COLUMN_EDGES = ("HAS_COLUMN", "HAS_OUTPUT_COL", "HAS_AFFECTED_COL", "DATA_FLOW", "FILTER_FLOW")
UP, DOWN = ("READS_FROM", "HAS_OUTPUT_COL"), ("WRITES_TO", "HAS_AFFECTED_COL")
NESTS = ("CHILD_OF", "NESTED_IN")  # from the nested statement; USES_SUBQUERY leads to it


def reach_many(edges: DataFrame, sources: DataFrame, undirected: bool = True, max_hops: int | None = None) -> DataFrame:
    """All (source, id) such that edges lead from a source to a node, itself included, for many sources in one pass.

    Sources (id) are numbered; 64 of them are the bits of one number that is carried along the edges, so a round costs one join
    whatever the number of sources in a word. A node goes on with the bits that are new to it. ``edges`` (src, dst) are read once
    a round and should be stored.
    """
    steps = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL")
    if undirected:
        steps = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    steps = saved(steps.distinct(), "steps")
    # numbered by hash order within buckets of one word: no window over all sources
    ids = sources.select("id").filter("id IS NOT NULL").distinct()
    numbered = saved(ids.withColumn("number", F.monotonically_increasing_id()), "sources")
    bit = F.expr(f"shiftleft(1L, CAST(number % {WORD} AS INT))")
    word = F.floor(F.col("number") / WORD).cast("long")
    seen = frontier = saved(numbered.groupBy("id", word.alias("word")).agg(F.bit_or(bit).alias("bits")), "bits")
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        met = steps.join(frontier.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "word").agg(F.bit_or("bits").alias("came"))
        both = seen.join(met, ["id", "word"], "full_outer")
        old, came = F.coalesce("bits", F.lit(0)), F.coalesce("came", F.lit(0))
        fresh = saved(both.select("id", "word", old.bitwiseOR(came).alias("bits"), came.bitwiseAND(F.bitwise_not(old)).alias("new")), "bits", instead_of=seen)
        frontier = fresh.filter("new <> 0").select("id", "word", F.col("new").alias("bits"))
        seen = fresh
        if frontier.isEmpty():
            break
    dropped(steps)
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    flat = seen.select("id", "word", F.explode(places).alias("place")).select("id", (F.col("word") * WORD + F.col("place")).alias("number"))
    return flat.join(numbered.withColumnRenamed("id", "source"), "number").select("source", "id")


def containment(graph: Graph, roots: DataFrame, etypes: tuple[str, ...]) -> DataFrame:
    """All (source, id) of roots (id) and what they hold by edges of the types, in any depth, without themselves."""
    return reach_many(graph.of(*etypes), roots, undirected=False).filter("source <> id")


def hoisted_reads(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Nested statements (id), and the READS_FROM edges (src, dst) that their roots get from them and do not have themselves.

    Nesting is CHILD_OF, NESTED_IN and USES_SUBQUERY between statements.
    """
    used = graph.link("USES_SUBQUERY", "dst", "src").select("src", "dst")
    statements = graph.typed("id", "Statement")
    inner = graph.of(*NESTS).select("src", "dst").unionByName(used)
    inner = inner.join(statements.withColumnRenamed("id", "src"), "src", "left_semi").join(statements.withColumnRenamed("id", "dst"), "dst", "left_semi")
    nested = inner.select(F.col("src").alias("id")).distinct()
    tops = root_of(graph)
    reads = graph.of("READS_FROM").select("src", "dst")
    lifted = reads.join(tops.select(F.col("sub").alias("src"), "root"), "src").select(F.col("root").alias("src"), "dst").distinct()
    return nested, lifted.join(reads, ["src", "dst"], "left_anti")


def shown_edges(edges: DataFrame, table_level: bool = False, upstream: bool = True, downstream: bool = True) -> DataFrame:
    """Edges of a view: none between columns at table level, none of a direction that is off."""
    off = (COLUMN_EDGES if table_level else ()) + (() if upstream else UP) + (() if downstream else DOWN)
    return edges.filter(~F.col("etype").isin(*off)) if off else edges


def node_flags(vertices: DataFrame, edges: DataFrame, hidden_types: tuple[str, ...] = (), hidden: DataFrame | None = None, upstream: bool = True, downstream: bool = True, scope: DataFrame | None = None) -> DataFrame:
    """id, vtype, hidden, dimmed of a view's nodes.

    Hidden are the types below the view's depth and the ids of ``hidden``. Dimmed are nodes that a direction switched off leaves
    without flow though they had some, and nodes outside ``scope`` (id).
    """
    flow = edges.filter(F.col("etype").isin(*UP, *DOWN))
    ends = lambda df: df.select(F.col("src").alias("id")).union(df.select(F.col("dst").alias("id"))).distinct()
    had, has = ends(flow).withColumn("had", F.lit(True)), ends(shown_edges(flow, False, upstream, downstream)).withColumn("has", F.lit(True))
    rows = vertices.select("id", "vtype").join(had, "id", "left").join(has, "id", "left")
    dim, hide = F.col("had").isNotNull() & F.col("has").isNull(), F.col("vtype").isin(*hidden_types) if hidden_types else F.lit(False)
    if scope is not None:
        rows = rows.join(scope.select("id").distinct().withColumn("inside", F.lit(True)), "id", "left")
        dim = dim | F.col("inside").isNull()
    if hidden is not None:
        rows = rows.join(hidden.select("id").distinct().withColumn("chosen", F.lit(True)), "id", "left")
        hide = hide | F.col("chosen").isNotNull()
    return rows.select("id", "vtype", hide.alias("hidden"), dim.alias("dimmed"))


def contracted(edges: DataFrame, hidden: DataFrame, max_depth: int = 30) -> DataFrame:
    """Edges (src, dst) between shown nodes: those there are, and one for each way that leads through hidden nodes (id) only."""
    gone = saved(hidden.select("id").distinct(), "hidden")
    marked = edges.select("src", "dst").distinct().join(gone.select(F.col("id").alias("dst"), F.lit(True).alias("into")), "dst", "left")
    marked = marked.join(gone.select(F.col("id").alias("src"), F.lit(True).alias("out_of")), "src", "left")
    links = saved(marked.select("src", "dst", F.col("into").isNotNull().alias("into"), F.col("out_of").isNotNull().alias("out_of")), "marked")
    parts = [links.filter("NOT into AND NOT out_of").select("src", "dst")]
    onward = links.filter("out_of").select(F.col("src").alias("mid"), F.col("dst").alias("far"), "into")
    seen = frontier = saved(links.filter("into AND NOT out_of").select("src", F.col("dst").alias("mid")), "through")
    for _ in range(max_depth):
        if frontier.isEmpty():
            break
        met = saved(frontier.join(onward, "mid").select("src", "far", "into").distinct(), "through")
        parts.append(met.filter("NOT into").select("src", F.col("far").alias("dst")))
        frontier = saved(met.filter("into").select("src", F.col("far").alias("mid")).join(seen, ["src", "mid"], "left_anti"), "through")
        seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, parts).distinct()


def overview(schemas: DataFrame, stub: str = "unnamed", per_app: int = 10, per_db: int = 5, position: Column | None = None) -> DataFrame:
    """kind, id, parent, label of an overview's applications, databases and schemas (id, name, db, db_name, app, app_name).

    Where any schema names its database, groups are real: databases below their application, or standing alone where it has
    but one or they have none; schemas without a database go to a stub, below their application if they name one. Otherwise
    schemas are dealt by ``position`` (from 0) to stubs of ``per_db``, and these to applications of ``per_app`` schemas.
    """
    null = F.lit(None).cast("string")
    if schemas.filter("db IS NOT NULL").isEmpty():
        if position is None:
            raise ValueError("schemas without databases are dealt by position")
        rows = schemas.withColumn("at", position)
        app, db = F.floor(F.col("at") / per_app).cast("long"), F.floor((F.col("at") % per_app) / per_db).cast("long")
        rows = rows.select("id", "name", F.concat(F.lit("app-"), app.cast("string")).alias("app_key"), F.concat_ws("-", F.lit("db"), app.cast("string"), db.cast("string")).alias("db_key"), F.lit(stub).alias("db_label"), F.concat(F.lit("System-"), (app + 1).cast("string")).alias("app_label"))
    else:
        db_key = F.coalesce("db", F.when(F.col("app").isNotNull(), F.concat(F.lit("stub:"), "app")).otherwise(F.lit("stub")))
        rows = schemas.select("id", "name", F.col("app").alias("app_key"), db_key.alias("db_key"), F.when(F.col("db").isNotNull(), F.coalesce("db_name", F.lit(stub))).otherwise(F.lit(stub)).alias("db_label"), F.coalesce("app_name", "app").alias("app_label"))
    dbs = saved(rows.groupBy("app_key", "db_key").agg(F.min("db_label").alias("db_label"), F.min("app_label").alias("app_label")), "databases")
    apps = dbs.filter("app_key IS NOT NULL").groupBy("app_key").agg(F.count(F.lit(1)).alias("n"), F.min("app_label").alias("label")).filter("n > 1")
    under = dbs.join(apps.select("app_key", F.col("app_key").alias("parent")), "app_key", "left")
    return (
        apps.select(F.lit("application").alias("kind"), F.col("app_key").alias("id"), null.alias("parent"), "label")
        .unionByName(under.select(F.lit("database").alias("kind"), F.col("db_key").alias("id"), "parent", F.col("db_label").alias("label")))
        .unionByName(rows.select(F.lit("schema").alias("kind"), "id", F.col("db_key").alias("parent"), F.col("name").alias("label")))
    )
