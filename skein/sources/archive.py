"""A permanent archive of harvested texts: one copy of each text, with the sessions, files and errors that name it.

Texts are addressed by their SHA-256 and lie in hash buckets of a versioned store, so a text is written once, the first write wins
and writers do not wait for one another. Files hang on their session and on their text by edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import saved
from skein.sources.store import GraphStore

COLUMNS = "id string, vtype string, session string, name string, text string, sha256 string, n_bytes long, at timestamp"


def revision_of(session: Column, day: Column) -> Column:
    """``rev-<date>-<first eight of the session>``."""
    return F.concat(F.lit("rev-"), F.date_format(day, "yyyy-MM-dd"), F.lit("-"), F.substring(session, 1, 8))


def error_kind(stage: Column) -> Column:
    """Kind of an error by the stage it arose in: PARSE_ERROR, WRITE_ERROR, else SESSION_ERROR."""
    return F.when(F.upper(stage).isin("PARSE", "WRITE"), F.concat(F.upper(stage), F.lit("_ERROR"))).otherwise(F.lit("SESSION_ERROR"))


class SourceArchive:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.store = spark, GraphStore(spark, path, buckets)

    def _rows(self, df: DataFrame, vtype: str, **columns: Column) -> DataFrame:
        empty = {"session": "string", "name": "string", "text": "string", "sha256": "string", "n_bytes": "long", "at": "timestamp"}
        return df.select(columns["id"].alias("id"), F.lit(vtype).alias("vtype"), *(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in empty.items()))

    def write(self, sessions: DataFrame, files: DataFrame, errors: DataFrame) -> dict[str, int]:
        """Archives sessions (session, started), files (session, path, text) and errors (session, path, stage, message).

        A null text is a file without a text. Writing the same again changes nothing.
        """
        told = saved(files.withColumn("sha256", F.sha2("text", 256)).withColumn("n_bytes", F.octet_length("text").cast("long")), "archive-files")
        # the least session and path names the copy that stays; a text is carried once for each session's file
        texts = told.filter("text IS NOT NULL").groupBy("sha256").agg(F.min_by("text", F.struct("session", "path")).alias("text"), F.min("n_bytes").alias("n_bytes"))
        file_id = F.concat_ws(":", F.lit("file"), "session", "path")
        vertices = (
            self._rows(sessions, "Session", id=F.concat(F.lit("session:"), "session"), session=F.col("session"), name=revision_of(F.col("session"), F.col("started")), at=F.col("started"))
            .unionByName(self._rows(told, "File", id=file_id, session=F.col("session"), name=F.col("path"), sha256=F.col("sha256"), n_bytes=F.col("n_bytes")))
            .unionByName(self._rows(texts, "Text", id=F.concat(F.lit("text:"), "sha256"), text=F.col("text"), sha256=F.col("sha256"), n_bytes=F.col("n_bytes")))
            .unionByName(self._rows(errors, "Error", id=F.concat_ws(":", F.lit("error"), "session", F.coalesce("path", F.lit("")), error_kind(F.col("stage")), F.sha2(F.coalesce("message", F.lit("")), 256)), session=F.col("session"), name=error_kind(F.col("stage")), text=F.col("message")))
        )
        edge = lambda df, src, dst, etype: df.select(src.alias("src"), dst.alias("dst"), F.lit(etype).alias("etype"))
        edges = edge(told, F.concat(F.lit("session:"), "session"), file_id, "HAS_FILE").unionByName(edge(told.filter("sha256 IS NOT NULL"), file_id, F.concat(F.lit("text:"), "sha256"), "HAS_TEXT"))
        return self.store.commit(vertices, edges)

    def texts(self, hashes: list[str] | None = None) -> DataFrame:
        """sha256, text, n_bytes of all texts, or of a caller's list, of which only the buckets are read."""
        rows = self.store.vertices("Text") if hashes is None else self.store.lookup([f"text:{h}" for h in hashes], "Text")
        return rows.select("sha256", "text", "n_bytes")
