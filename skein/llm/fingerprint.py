"""Lempel-Ziv phrase fingerprints: documents that compress each other have like sets of phrases.

A text is parsed into phrases as LZ78 does: each phrase is the shortest run, from where the last one ended, that is not
yet in the dictionary (the last phrase of a text may be one that is). The set of phrases is hashed; one universal hash
deals it into ``BINS`` bins and keeps the least 40-bit value of each (one-permutation minimum hashing) as a floating number
of 12 bits: 5 for its leading zeros, 7 for the digits after the first one (Yu and Weber, 2017). So minima stay apart however
long a text is: unrelated bins agree about once in 300. Two fingerprints
are alike in the share of equal bins among the bins that either fills, an estimate of the Jaccard likeness of the phrase
sets. Equal texts have equal fingerprints; two texts without phrases are alike by 1, one such and another by 0.

``neighbour_likeness`` compares each document with the next one in ascending doc_id, and with itself after its end was
replaced by the start of the next. Rows are range-partitioned and sorted by doc_id (one shuffle of the texts) and streamed;
only the last document of each range waits for the first of the next one. The two parses of a document share their
common start.

Defined cases: null text is the empty text; null doc_ids come after all others; rows of equal doc_id are ordered by a hash
of their text; repeated rows (equal doc_id and text) are one document here and share its result; a single document is its
own next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.textkernels import mix, powers
from skein.session import saved

BINS = 128
BASE_CHAR = 0xC2B2AE3D27D4EB4F
NONE = 0xFFF  # marks an empty bin; values end below it
WIDTH, DIGITS = 40, 7  # bits of a hashed value, and of those kept after its first one


def phrase_ends(text: str, root: dict, added: list | None = None) -> list[int]:
    """Ends of the new phrases of ``text``, continuing with the dictionary ``root``, a trie that grows.

    What follows the last end is a phrase that the dictionary has. ``added`` collects (node, character) of new entries,
    so they can be taken back.
    """
    ends, node = [], root
    for at, c in enumerate(text, 1):
        follow = node.get(c)
        if follow is None:
            node[c] = {}
            if added is not None:
                added.append((node, c))
            ends.append(at)
            node = root
        else:
            node = follow
    return ends


def floating(values: np.ndarray) -> np.ndarray:
    """Leading zeros (31 at most) and the digits after the first one of values of ``WIDTH`` bits; an order-reversing code."""
    part, bits = np.frexp(values.astype(np.float64))
    zeros = np.minimum(WIDTH - bits, 31)
    digits = ((part * 2 - 1).clip(0) * (1 << DIGITS)).astype(np.int64)
    return np.minimum(zeros << DIGITS | digits, NONE - 1).astype(np.uint16)


def sketch(text: str, ends: list[int]) -> np.ndarray:
    """Bin minima of the phrases of a text, given the ends of the new ones."""
    bins = np.full(BINS, NONE, dtype=np.uint16)
    if text:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        up, down = powers(BASE_CHAR, len(codes) + 1)
        total = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
        to = np.asarray(ends if ends and ends[-1] == len(text) else [*ends, len(text)])
        start = np.r_[0, to[:-1]]
        hashes = mix((total[to] - total[start]) * down[start] + (to - start).astype(np.uint64))
        least = np.full(BINS, 1 << WIDTH, dtype=np.uint64)
        np.minimum.at(least, (hashes % np.uint64(BINS)).astype(np.int64), hashes >> np.uint64(64 - WIDTH))
        filled = least < 1 << WIDTH
        bins[filled] = floating(least[filled])
    return bins


def packed(bins: np.ndarray) -> bytes:
    """Twelve bits a bin."""
    a, b = bins[0::2], bins[1::2]
    return np.stack([a >> 4, (a & 15) << 4 | b >> 8, b & 255], axis=1).astype(np.uint8).tobytes()


def fingerprint(text: str) -> np.ndarray:
    return sketch(text, phrase_ends(text, {}))


def edited(text: str, following: str) -> str:
    """The last half of the code points of a text replaced by the first as many of another."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprint_pair(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of a text and of its edited text, and that text. The common start is parsed once."""
    root: dict = {}
    common = phrase_ends(text[: len(text) - len(text) // 2], root)
    back = common[-1] if common else 0  # the phrase that is open at the end of the start is parsed in both
    added: list = []
    rest = [back + e for e in phrase_ends(text[back:], root, added)]
    for node, c in reversed(added):
        del node[c]
    other = edited(text, following)
    rest_other = [back + e for e in phrase_ends(other[back:], root)]
    return sketch(text, common + rest), sketch(other, common + rest_other), other


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != NONE) | (b != NONE)
    n = int(filled.sum())
    return float((a == b)[filled].sum() / n) if n else 1.0


def as_text(column: str):
    """A packed fingerprint as text: three hexadecimal digits a bin, ``fff`` for an empty one."""
    return F.lower(F.hex(column))


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.binary()), ("edited_fp", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"
EDGE = "part int, edge string, edge_id long, copies long, body string"


def _rows_to_arrays(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(FIELDS)]


def _finish(doc_id, text: str, own: np.ndarray, other: np.ndarray, changed: str, next_fp: np.ndarray) -> tuple:
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), packed(own), packed(other), likeness(own, other), likeness(own, next_fp))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare neighbours of one sorted range; emit results, and the first and the last document as edges."""
    part = TaskContext.get().partitionId()
    waiting = None  # (doc_id, text, copies): the last document read
    held = None  # the one before it, compared with it but for its fingerprint: (doc_id, text, copies, own, other, changed)
    first = None

    def emit(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
        n, m = len(rows), len(edges)
        arrays = [pa.concat_arrays([a, pa.nulls(m, a.type)]) for a in _rows_to_arrays(rows)]
        for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())):
            arrays.append(pa.concat_arrays([pa.nulls(n, t), pa.array([e[i] for e in edges], t)]))
        return pa.RecordBatch.from_arrays(arrays, [n for n, _ in FIELDS] + [f.split()[0] for f in EDGE.split(", ")])

    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if waiting is not None and waiting[0] == doc_id and waiting[1] == text:
                waiting = (doc_id, text, waiting[2] + 1)
                continue
            if waiting is None:
                first = (doc_id, text)
            else:
                own, other, changed = fingerprint_pair(waiting[1], text)
                if held is not None:
                    rows += [_finish(held[0], held[1], *held[3:], own)] * held[2]
                held = (*waiting, own, other, changed)
            waiting = (doc_id, text, 1)
        if rows:
            yield emit(rows, [])
    if first is not None:
        rows = [_finish(held[0], held[1], *held[3:], fingerprint(waiting[1]))] * held[2] if held is not None else []
        yield emit(rows, [(part, "first", first[0], 1, first[1]), (part, "last", *waiting[:1], waiting[2], waiting[1])])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare documents (doc_id, copies, text) with their next one (following)."""
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, copies, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "copies", "text", "following")), strict=True):
            own, other, changed = fingerprint_pair(text, following)
            rows += [_finish(doc_id, text, own, other, changed, fingerprint(following))] * copies
        yield pa.RecordBatch.from_arrays(_rows_to_arrays(rows), [n for n, _ in FIELDS])


def neighbour_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    done = saved(texts.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(_ranges, f"{SCHEMA}, {EDGE}"), "ranges")
    # a row per range from here on: the last document of each waits for the first of the next range, the very last for the very first
    edges = done.filter("edge is not null").select(*[f.split()[0] for f in EDGE.split(", ")])
    parts = Window.orderBy("part")
    around = edges.filter("edge = 'first'").select("part", F.coalesce(F.lead("part").over(parts), F.min("part").over(parts)).alias("next_part"))
    starts = edges.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("body").alias("following"))
    lasts = edges.filter("edge = 'last'").join(around, "part").join(starts, "next_part").select(F.col("edge_id").alias("doc_id"), "copies", F.col("body").alias("text"), "following")
    names = [n for n, _ in FIELDS]
    every = done.filter("edge is null").select(*names).unionByName(lasts.mapInArrow(_pairs, SCHEMA))
    return every.select("doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row, for comparisons other than with the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [packed(fingerprint(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.binary())], ["doc_id", "fp"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, fp binary").select("doc_id", as_text("fp").alias("fingerprint"))
