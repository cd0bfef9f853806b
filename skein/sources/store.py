"""A versioned graph store: keyed upserts of touched partitions, a manifest swapped last, one id for equal objects.

Layout below the store's path:

* ``vertices/version=V/vtype=T/bucket=B`` and ``edges/version=V/etype=T/bucket=B``: Parquet, bucketed by the hash of a vertex's id
  or an edge's source. A version's files never change.
* ``manifests/N.json``: for each partition (type and bucket) the versions it consists of. The latest manifest is the store.

A commit reads the partitions its rows touch, leaves out rows whose key is there (first write wins) and writes the rest as one new
version, then creates the next manifest by a rename that fails if another writer made it first. In that case its files are deleted
and the commit begins again on the other's manifest, so no write is lost and no key stands twice. Readers hold on to a manifest.
What comes to the driver are manifests, types and buckets, whose number does not depend on the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import dropped, is_saved, saved

MODES = ("DISABLED", "REMOTE", "REMOTE_BATCH")
KEYS = {"vertices": ("id",), "edges": ("src", "dst", "etype")}
TYPE = {"vertices": "vtype", "edges": "etype"}
OWNER = {"vertices": "id", "edges": "src"}


@dataclass
class Manifest:
    number: int = 0
    schemas: dict[str, str] = field(default_factory=dict)
    parts: dict[str, dict[str, list[str]]] = field(default_factory=lambda: {"vertices": {}, "edges": {}})

    def with_version(self, version: str, schemas: dict[str, str], touched: dict[str, list[str]]) -> Manifest:
        parts = {kind: {p: list(v) for p, v in own.items()} for kind, own in self.parts.items()}
        for kind, places in touched.items():
            for place in places:
                parts[kind].setdefault(place, []).append(version)
        return Manifest(self.number + 1, self.schemas | schemas, parts)


def _counted(rows: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """Rows, and their number once they were written: observed, or counted if an empty side of a join left them unread."""
    told = Observation()

    def count() -> int:
        try:
            return told.get["n"]
        except Py4JJavaError:  # nothing was observed
            return rows.count()

    return rows.observe(told, F.count(F.lit(1)).alias("n")), count


class GraphStore:
    """A property graph at ``path``; ``buckets`` holds for the store's life."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # files

    def _files(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def manifest(self) -> Manifest:
        """The latest manifest; an empty one for a new store."""
        files, folder = self._files(f"{self.path}/manifests")
        if not files.exists(folder):
            return Manifest()
        names = [s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().endswith(".json")]
        if not names:
            return Manifest()
        stream = files.open(self._files(f"{self.path}/manifests/{max(names)}")[1])
        try:
            return Manifest(**json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
        finally:
            stream.close()

    def _swap(self, manifest: Manifest) -> bool:
        """Creates a manifest; False if another writer created that number."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        files, draft = self._files(f"{self.path}/manifests/.draft-{uuid.uuid4().hex}")
        stream = files.create(draft)
        stream.write(bytearray(json.dumps(manifest.__dict__).encode()))
        stream.close()
        final = self._files(f"{self.path}/manifests/{manifest.number:010d}.json")[1]
        never = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, never)
        except Py4JJavaError as error:
            files.delete(draft, False)
            if "FileAlreadyExistsException" in error.java_exception.toString():
                return False
            raise
        return True

    # reading

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str, places: list[str], manifest: Manifest) -> DataFrame:
        own, least = manifest.parts[kind], T.StructType([T.StructField(c, T.StringType()) for c in dict.fromkeys((*KEYS[kind], TYPE[kind]))])
        schema = T.StructType.fromJson(json.loads(manifest.schemas[kind])) if kind in manifest.schemas else least
        paths = [f"{self.path}/{kind}/version={v}/{p}" for p in places for v in own.get(p, [])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        placed = T.StructType([*schema, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.StringType())])
        read = self.spark.read.schema(placed).option("basePath", f"{self.path}/{kind}").parquet(*paths)
        return read.drop("bucket", "version")

    def _places(self, kind: str, types: tuple[str, ...], buckets: set[int] | None, manifest: Manifest) -> list[str]:
        def fits(place: str) -> bool:
            type_, bucket = (p.split("=", 1)[1] for p in place.split("/"))
            return (not types or type_ in types) and (buckets is None or int(bucket) in buckets)

        return [p for p in manifest.parts[kind] if fits(p)]

    def vertices(self, *vtypes: str, manifest: Manifest | None = None) -> DataFrame:
        """Vertices of some types, or all; only these types' files are listed."""
        manifest = manifest or self.manifest()
        return self._read("vertices", self._places("vertices", vtypes, None, manifest), manifest)

    def edges(self, *etypes: str, manifest: Manifest | None = None) -> DataFrame:
        manifest = manifest or self.manifest()
        return self._read("edges", self._places("edges", etypes, None, manifest), manifest)

    def lookup(self, ids: list[str], *types: str, kind: str = "vertices") -> DataFrame:
        """Rows whose id (edges: source) is one of ``ids``, a list that a caller holds: only the files of their buckets are read."""
        manifest = self.manifest()
        asked = self.spark.createDataFrame([(i,) for i in set(ids)], "asked string")
        buckets = {r[0] for r in asked.select(self.bucket("asked")).distinct().collect()}  # at most as many as the store has
        rows = self._read(kind, self._places(kind, types, buckets, manifest), manifest)
        return rows.join(asked, F.col(OWNER[kind]) == F.col("asked"), "left_semi")

    # writing

    def _touched(self, rows: DataFrame, kind: str) -> list[str]:
        return [f"{TYPE[kind]}={t}/bucket={b}" for t, b in rows.select(TYPE[kind], self.bucket(OWNER[kind])).distinct().collect()]

    def _write(self, rows: DataFrame, kind: str, version: str) -> None:
        placed = rows.withColumns({"bucket": self.bucket(OWNER[kind]), "version": F.lit(version)})
        placed.hint("rebalance", TYPE[kind], "bucket").write.mode("append").partitionBy("version", TYPE[kind], "bucket").parquet(f"{self.path}/{kind}")

    def commit(self, vertices: DataFrame, edges: DataFrame, mode: str = "REMOTE_BATCH", order: str | None = None, tries: int = 20) -> dict[str, int]:
        """Upserts a batch: counts of vertices inserted and repeated, edges inserted, repeated and dropped for an unknown end.

        Of equal keys in a batch the row least in ``order`` stays. ``REMOTE`` and ``REMOTE_BATCH`` differ in how a caller cuts its
        batches, not in what is written; ``DISABLED`` writes and counts nothing. Frames that are saved are not written again.
        """
        if mode not in MODES:
            raise ValueError(f"unknown or unsupported mode {mode}")
        if mode == "DISABLED":
            return {"vertices": 0, "repeated_vertices": 0, "edges": 0, "repeated_edges": 0, "dropped_edges": 0}
        batch, asked, own = {}, {}, []
        for kind, rows in (("vertices", vertices), ("edges", edges)):
            keyed = lambda df: df.filter("src IS NOT NULL AND dst IS NOT NULL") if kind == "edges" else df  # noqa: B023, E731
            if is_saved(rows):
                batch[kind] = keyed(rows)
                asked[kind] = batch[kind].count()
            else:
                told, count = _counted(keyed(rows))
                batch[kind] = saved(told, f"batch-{kind}")
                asked[kind] = count()
                own.append(batch[kind])
        for _ in range(tries):
            if (counts := self._attempt(asked, batch, order)) is not None:
                for rows in own:
                    dropped(rows)
                return counts
        raise RuntimeError(f"{tries} other writers came first")

    def _attempt(self, asked: dict[str, int], batch: dict[str, DataFrame], order: str | None) -> dict[str, int] | None:
        base, version = self.manifest(), uuid.uuid4().hex
        fresh, counts, schemas = {}, {}, {}
        ids = batch["vertices"].select("id").union(self.vertices(manifest=base).select("id")) if base.number else batch["vertices"].select("id")
        for kind, rows in batch.items():
            rest = [c for c in rows.columns if c not in KEYS[kind] and c != order]
            least = F.min(F.when(~F.col("there"), F.struct(*([order] if order in rows.columns else []), *rest))) if rest else F.lit(None).cast("string")
            places = [p for p in self._touched(rows, kind) if p in base.parts[kind]] if base.number else []
            held = rows.withColumn("there", F.lit(False))
            if places:
                held = held.unionByName(self._read(kind, places, base).select(*KEYS[kind], F.lit(True).alias("there")), allowMissingColumns=True)
            # rows lie by their owner, with those that are there, so neither equal keys nor owners ask for another shuffle of them
            met = held.repartition(OWNER[kind]).groupBy(*KEYS[kind]).agg(least.alias("row"), F.bool_or("there").alias("there"), F.bool_and("there").alias("old"))
            kept = met.filter("NOT old").select(*KEYS[kind], *(F.col("row")[c].alias(c) for c in rest), "there")
            schemas[kind] = kept.drop("there").schema.json()
            new, n_kept = _counted(kept)
            if kind == "edges":
                new, n_owned = _counted(new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi"))
                new, n_left = _counted(new.filter("NOT there"))
                # what is there has both ends
                new = new.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
            else:
                new = new.filter("NOT there")
            self._write(new.select(*kept.drop("there").columns), kind, version)
            fresh[kind] = self._written(kind, version)
            counts[kind] = sum(fresh[kind].values())
        counts |= {"repeated_vertices": asked["vertices"] - counts["vertices"], "dropped_edges": n_kept() - n_owned() + n_left() - counts["edges"]}
        counts["repeated_edges"] = asked["edges"] - counts["dropped_edges"] - counts["edges"]
        if self._swap(base.with_version(version, schemas, {kind: list(own) for kind, own in fresh.items()})):
            return counts
        for kind in KEYS:
            files, folder = self._files(f"{self.path}/{kind}/version={version}")
            files.delete(folder, True)
        return None

    def _written(self, kind: str, version: str) -> dict[str, int]:
        """Rows of a version by partition."""
        files, folder = self._files(f"{self.path}/{kind}/version={version}")
        if not files.exists(folder):
            return {}
        read = self.spark.read.schema(f"{TYPE[kind]} string, bucket int").option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}/version={version}")
        counted = read.groupBy(TYPE[kind], "bucket").count().collect()
        return {f"{TYPE[kind]}={t}/bucket={b}": n for t, b, n in counted}


POOLED = ("Schema", "Table", "Column")


def canonical(vertices: DataFrame, edges: DataFrame, database: str, name: str, types: tuple[str, ...] = POOLED) -> tuple[DataFrame, DataFrame]:
    """Gives equal objects of different sessions one id: vertices and edges whose ids are those of the pool.

    Objects of the pooled types are equal if type, ``database`` and ``name`` (columns of vertices, upper-cased) are. Their id is a
    digest of these, so that concurrent sessions agree without asking one another.
    """
    pooled = F.col("vtype").isin(*types)
    key = F.concat_ws("|", F.upper(F.coalesce(database, F.lit(""))), F.upper(F.coalesce(name, F.lit(""))))
    named = F.when(pooled, F.concat(F.lower("vtype"), F.lit(":"), F.substring(F.sha2(key, 256), 1, 32))).otherwise(F.col("id"))
    mapped = vertices.withColumn("_id", named)
    ids = mapped.filter(pooled).select(F.col("id").alias("old"), F.col("_id").alias("new")).distinct()
    out = edges
    for end in ("src", "dst"):
        out = out.join(ids.withColumnRenamed("old", end), end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    return mapped.withColumn("id", F.col("_id")).drop("_id"), out.select(*edges.columns)
