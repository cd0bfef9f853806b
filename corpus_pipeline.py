"""Corpus pipeline: toxicity, near-duplicates, personal data, source mix and packing, each stage on what the last one kept.

``STAGES`` are (name, function of spark, docs, sf_dir). Each result is written as Parquet and reread as the next stage's
documents; all but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.mixing import mixed_rows
from skein.llm.neardup import keep_one
from skein.llm.packing import pack_documents
from skein.llm.pii import sanitise
from skein.llm.toxicity import drop_toxic
from skein.session import saved, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic from labelled examples."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, similarity 0.8 or more on five-word shingles."""
    return keep_one(docs, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and disclosing terms removed or generalised."""
    return sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a packed sequence."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("minhash_near_dedup", near_duplicates), ("pii", personal_data), ("source_mix", mix), ("best_fit_packing", pack)]

# Nearest neighbours, MinHash banding and best-fit placement are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
