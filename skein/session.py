"""Session helpers shared by every query: reading tables, shared scratch space and written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; ``sf_dir`` may be any path or URI Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor and the driver share, taken from ``spark.checkpoint.dir``.

    Only a session on one machine (master ``local``) may leave the setting out; a temporary folder is made and set then.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path
    jvm_dir = sc._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="spark-skein-")
    sc.setCheckpointDir(path)
    return path


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def scratch(spark: SparkSession) -> str:
    """This session's folder in the shared one; it goes when the session ends."""
    home = f"{shared_dir(spark).rstrip('/')}/skein-{spark.sparkContext.applicationId}"
    files, root = _filesystem(spark, home)
    files.deleteOnExit(root)
    return home


def dropped(df: DataFrame) -> None:
    """Deletes the files of a saved frame that nothing needs any more."""
    if path := getattr(df, "_skein_path", None):
        files, old = _filesystem(df.sparkSession, path)
        files.delete(old, True)


def is_saved(df: DataFrame) -> bool:
    """Whether a frame is one that ``saved`` gave, which costs no more than reading it."""
    return getattr(df, "_skein_path", None) is not None


def saved(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage in a form that survives losing executors, and lets several later jobs read a result without
    computing it again. Each call writes a new folder. ``instead_of`` is an earlier saved frame that nothing needs once
    this one is written, such as the last round of a loop: its files are deleted. The rest goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    if instead_of is not None:
        dropped(instead_of)
    return out
