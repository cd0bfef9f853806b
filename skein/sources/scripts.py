"""Script files: directory scans, decoding with fallbacks, archives of sources by hash, change caches."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("sql", "pck", "pks", "pkb", "pls")
MOST_FILES, MOST_BYTES = 2_000, 500 * 1024 * 1024


def decoded(raw: bytes | None) -> str | None:
    """UTF-8, else Windows-1251, else ISO-8859-1, without a byte-order mark."""
    if raw is None:
        return None
    for encoding in ("utf-8-sig", "cp1251"):
        try:
            return bytes(raw).decode(encoding)
        except UnicodeDecodeError:
            continue
    return bytes(raw).decode("latin-1")


def _decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"path": f["path"], "text": f["content"].map(decoded)})


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Script files below a folder, read and decoded in tasks: path, text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    return files.select("path", "content").mapInPandas(_decode, "path string, text string")


def with_database(files: DataFrame, root: str, single: str = "default") -> DataFrame:
    """Adds ``db_name``, the folder below the root. If there are such folders, files of the root itself are left out; else all are of one database."""
    below = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    folder = F.when(below.contains("/"), F.substring_index(below, "/", 1))
    named = files.withColumn("_folder", folder)
    any_folder = named.agg(F.coalesce(F.bool_or(F.col("_folder").isNotNull()), F.lit(False)).alias("_any"))  # one row
    kept = named.join(F.broadcast(any_folder)).filter("not _any or _folder is not null")
    return kept.withColumn("db_name", F.coalesce("_folder", F.lit(single))).drop("_folder", "_any")


def _members(path: str, raw: bytes, extensions: tuple[str, ...], most_files: int, most_bytes: int) -> list[tuple]:
    """(path, member, text, error) of an archive's scripts, or one row that says what is wrong with it."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            members = [m for m in archive.infolist() if not m.is_dir() and m.filename.rsplit(".", 1)[-1].lower() in extensions]
            if not members:
                return [(path, None, None, "holds no script")]
            if len(members) > most_files or sum(m.file_size for m in members) > most_bytes:
                return [(path, None, None, f"exceeds {most_files} files or {most_bytes} bytes")]
            return [(path, m.filename, decoded(archive.read(m)), None) for m in members]
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError) as error:
        return [(path, None, None, f"cannot be read: {error}")]


def _unzip(extensions: tuple[str, ...], most_files: int, most_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, raw in zip(f["path"], f["content"]):
                yield pd.DataFrame(_members(path, raw, extensions, most_files, most_bytes), columns=["path", "member", "text", "error"], dtype=object)

    return run


def unzip(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Scripts of the zip files below a folder: path, member, text, error. An archive that is broken, without scripts or above the limits is one row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    return files.select("path", "content").mapInPandas(_unzip(extensions, most_files, most_bytes), "path string, member string, text string, error string")


def new_sources(incoming: DataFrame, archived: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Texts whose hash the archive (sha256) lacks, one row a hash under its least key: sha256, key, n_bytes. Blank texts are dropped."""
    told = incoming.filter(F.col(text).rlike(r"\S")).select(F.sha2(text, 256).alias("sha256"), key, F.octet_length(text).cast("long").alias("n_bytes"))
    return told.groupBy("sha256").agg(F.min(key).alias(key), F.min("n_bytes").alias("n_bytes")).join(archived.select("sha256"), "sha256", "left_anti")


def to_process(files: DataFrame, cache: DataFrame, fresh: Column) -> DataFrame:
    """Files (path, hash, ...) that no fresh cache row of the same path and hash covers."""
    return files.join(cache.filter(fresh).select("path", "hash"), ["path", "hash"], "left_anti")
