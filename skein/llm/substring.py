"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window is ``width`` consecutive words of one document. A word goes if it lies in a window whose word sequence also
starts in a document with a smaller doc_id; windows are judged on the input.

Plan
1. One pass hashes each document's windows. To keep the count small, every window also names its *anchor*, the least
   hash of the short word runs inside it: equal windows have equal anchors, so a window whose anchor occurs in one
   document only cannot repeat. Anchors are about a twentieth of the windows; they are pre-aggregated and counted.
2. Exact copies of an earlier document lose every word that a window covers, without hashing. Other documents meet their
   own repeated anchors; the windows holding one (the only ones that can repeat) are emitted with a
   96-bit Rabin-Karp hash and counted: least doc_id for each hash, pre-aggregated before the shuffle.
3. Windows whose hash has a smaller doc_id return to their document, where overlapping windows merge into maximal removal
   intervals.

Every step is keyed by a hash or by a document, so no group grows with the corpus but the rows of one window hash, which
are only ever aggregated or joined with a single row. First documents of windows that hold more than a 1,024th of all are
broadcast for that join (fewer than 1,024 rows), so a passage that very many documents share meets in no single task.

Defined cases: null or blank text has no words; a text shorter than the window keeps all; rows with a null doc_id rank
after all others and so never cause a removal, but lose what earlier documents hold; repeated rows (same doc_id) do not
remove one another; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.textkernels import BASE_A, BASE_B, Words, mix, rolling, sliding_min, slices
from skein.session import saved

LAST = 2**63 - 1  # stands for a null doc_id
HOT = 1024  # a window is hot if it is more than one of so many, so there are fewer than HOT hot windows


def _windows(words: Words, width: int, gram: int):
    """For each row with windows: its number, and the anchor of each of its windows."""
    grams = mix(rolling(words.ids, gram, BASE_A))
    lows = sliding_min(grams, width - gram + 1)
    for row in range(len(words)):
        a, b = words.first[row], words.first[row + 1]
        if b - a >= width:
            yield row, int(a), lows[a : b - width + 1]


def _anchors(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, key = batch.column("text"), batch.column("at").to_numpy(), batch.column("key").to_numpy()
            for lo, hi in slices(texts):
                rows, found, total = [], [], 0
                for row, _, lows in _windows(Words(texts.slice(lo, hi - lo)), width, gram):
                    total += len(lows)
                    found.append(np.unique(lows))
                    rows.append(np.full(len(found[-1]), lo + row))
                if found:
                    r = np.concatenate(rows)
                    # and one row with the number of windows
                    yield pa.RecordBatch.from_arrays([pa.array([*np.concatenate(found).view(np.int64).tolist(), None], pa.int64()), pa.array(np.r_[at[r], total]), pa.array(np.r_[key[r], 0])], ["anchor", "at", "key"])

    return run


def _candidates(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, key, wanted = batch.column("text"), batch.column("at").to_numpy(), batch.column("key").to_numpy(), batch.column("anchors")
            for lo, hi in slices(texts, 1 << 19):
                words = Words(texts.slice(lo, hi - lo))
                high, low = mix(rolling(words.ids, width, BASE_A)), mix(rolling(words.ids, width, BASE_B))
                out = []
                for row, first, lows in _windows(words, width, gram):
                    repeated = np.sort(np.asarray(wanted[lo + row].values, dtype=np.int64).view(np.uint64))
                    near = np.minimum(np.searchsorted(repeated, lows), len(repeated) - 1)
                    pos = np.flatnonzero(repeated[near] == lows)
                    out.append((high[first + pos], low[first + pos], np.full(len(pos), at[lo + row]), np.full(len(pos), key[lo + row]), pos.astype(np.int32)))
                if out:
                    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array((cols[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)), *map(pa.array, cols[2:])], ["h1", "h2", "at", "key", "pos"])

    return run


def intervals(positions: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Merge windows starting at ``positions`` into maximal word intervals, end exclusive."""
    p = np.unique(positions)
    if not len(p):
        return []
    cut = np.flatnonzero(np.diff(p) > width)
    first, last = np.r_[p[0], p[cut + 1]], np.r_[p[cut], p[-1]]
    return [(int(a), int(b) + width) for a, b in zip(first, last, strict=True)]


def _kept(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, copy = batch.column("text"), batch.column("positions"), batch.column("copy")
            for lo, hi in slices(texts):
                words = Words(texts.slice(lo, hi - lo), ids=False)
                body = words.bytes.tobytes()
                total, removed, cuts, kept = [], [], [], []
                for row in range(hi - lo):
                    a, b = int(words.first[row]), int(words.first[row + 1])
                    keep = np.ones(b - a, dtype=bool)
                    at = np.arange(max(b - a - width + 1, 0)) if copy[lo + row].is_valid else np.asarray(found[lo + row].values) if found[lo + row].is_valid else np.empty(0, np.int64)
                    gone = intervals(at, width)
                    for s, e in gone:
                        keep[s:e] = False
                    left = np.flatnonzero(keep) + a
                    kept.append(b" ".join(body[s:e] for s, e in zip(words.starts[left].tolist(), words.ends[left].tolist(), strict=True)).decode())
                    total.append(b - a)
                    removed.append(b - a - len(left))
                    cuts.append([{"start": s, "end": e} for s, e in gone])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                        pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string()),
                        pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"],
                )

    return run


def dedup_substrings(docs: DataFrame, width: int = 50, gram: int = 16) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, removed (word intervals), kept_text.

    ``gram`` is the length of the short runs that anchors are taken from; it changes the work, never the result.
    """
    doc_id = F.col("doc_id").cast("long")
    # every use below has these three columns, so the texts are shuffled once and that shuffle is reused
    keyed = docs.select(F.coalesce(doc_id, F.lit(LAST)).alias("at"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))

    hashed = saved(keyed.select("at", "key", "text").mapInArrow(_anchors(width, gram), "anchor long, at long, key long"), "anchors")
    anchors, total = hashed.filter("anchor is not null"), hashed.filter("anchor is null").agg(F.sum("at")).first()[0] or 0
    repeated = anchors.groupBy("anchor").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).filter("lo < hi").select("anchor")
    # exact copies of an earlier document need no windows: all of theirs start there
    texts = keyed.select("at", "key", F.hash("text").alias("key2"))
    earliest = texts.groupBy("key", "key2").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).filter("lo < hi").select("key", "key2", "lo")
    copies = texts.join(earliest, ["key", "key2"]).filter("at > lo").select("at", "key").distinct().withColumn("copy", F.lit(True))
    own = anchors.join(repeated, "anchor").groupBy("at", "key").agg(F.collect_set("anchor").alias("anchors")).join(copies, ["at", "key"], "left_anti")

    # not written: hashing again costs less than keeping every window twice
    windows = keyed.join(own, ["at", "key"]).mapInArrow(_candidates(width, gram), "h1 long, h2 int, at long, key long, pos int")
    first = windows.groupBy("h1", "h2").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # windows that hold more than a 1,024th of all: fewer than 1,024 rows. Theirs are settled where they are made, and go on
    # under keys that spread them, as the null in h2 lets them meet nothing
    hot = first.filter(F.col("n") * HOT > total).select("h1", "h2", F.col("lo").alias("hot_lo"))
    made = windows.join(F.broadcast(hot), ["h1", "h2"], "left").filter("hot_lo is null or at > hot_lo")
    met = made.select(F.when(F.col("hot_lo").isNull(), F.col("h1")).otherwise(F.xxhash64("at", "pos")).alias("h1"), F.when(F.col("hot_lo").isNull(), F.col("h2")).alias("h2"), "at", "key", "pos").join(first.drop("n"), ["h1", "h2"], "left")
    gone = met.filter("h2 is null or at > lo").groupBy("at", "key").agg(F.collect_set("pos").alias("positions"))  # once each, however many rows repeat

    kept = keyed.join(gone, ["at", "key"], "left").join(copies, ["at", "key"], "left").select(F.col("at").alias("doc_id"), "text", "positions", "copy").mapInArrow(_kept(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>, kept_text string")
    return kept.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))
