"""Approximate nearest neighbours by randomly rotated one-bit codes (Gao and Long, 2024).

A unit vector o, padded with zeros to B dimensions, is rotated by a random orthogonal matrix and kept as the signs of its B
components, packed to B bits, with one correction scalar: dot(o, code), the inner product with its own code vector
(signs / sqrt(B)). For a rotated unit query q the cosine is estimated as dot(code, q) / dot(o, code), and the error is at
most, but for a chance that falls with the square of epsilon in the exponent,

    epsilon * sqrt((1 - dot(o, code)**2) / dot(o, code)**2 / (B - 1))

Plan
1. Equal vectors form a class, of which the k + 1 least ids are kept, so a vector that a third of all rows share costs one
   search. Classes are encoded once; bits and scalars are saved apart from the vectors.
2. Queries and codes are dealt into blocks of bounded size by hash; each pair of blocks is one bounded task that reads bits
   only (128 bytes a row at 1,024 bits) and returns each query's k + 1 largest lower bounds. The best over all blocks get exact
   cosines; the least of these is the query's bar: its k-th neighbour is no farther.
3. The bits are scanned again, now against the bars of all blocks together, and only rows whose upper bound reaches the bar
   return. Vectors are joined to these survivors alone, a number that does not grow with the blocks, and give exact cosines
   in double precision.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors are scaled by
their largest component before norms are taken, so neither tiny nor huge ones under- or overflow; cosines are taken between
vectors of equal length only; rows with a null id take no part; repeated ids count once per distinct vector; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.textkernels import slices_of
from skein.session import saved

BLOCK, QUERY_BLOCK, TILE = 8192, 16384, 256
BITS = 1024


@cache
def rotation(dim: int, bits: int, seed: int = 6) -> np.ndarray:
    """Columns of a random orthogonal matrix of ``bits`` rows, for vectors of ``dim`` components padded with zeros."""
    q, r = np.linalg.qr(np.random.default_rng([seed, bits]).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def encode(vectors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalars of rows."""
    turned = unit(vectors) @ rotation(vectors.shape[1], bits).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(bits)


def signs(codes: np.ndarray) -> np.ndarray:
    """Bits as columns of 0.0 and 1.0: bits x rows."""
    return np.unpackbits(codes, axis=1).astype(np.float32).T


def estimate(ones: np.ndarray, own: np.ndarray, queries: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries x rows) from bits and scalars, and the error bound of each row."""
    bits = len(ones)
    turned = (unit(queries) @ rotation(queries.shape[1], bits).T / np.sqrt(bits)).astype(np.float32)
    # dot(code, q) = 2 * (sum of q where the bit is set) - sum of q
    near = (2 * (turned @ ones) - turned.sum(axis=1, keepdims=True)) / own[None, :].astype(np.float32)
    error = epsilon * np.sqrt(np.maximum(1 - own**2, 0) / own**2 / max(bits - 1, 1))
    return near, (error + 1e-5).astype(np.float32)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _encoded(bits: int):
    """Codes of vectors of any lengths: (class_id, lone, dim, codes, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices_of(batch.column("dim").to_numpy(), 4096):
                part = batch.take(pa.array(rows))
                dim = part.column("dim")[0].as_py()
                codes, own = encode(_matrix(part.column("vector")), max(bits, -(-dim // 8) * 8))
                yield pa.RecordBatch.from_arrays([part.column("class_id"), part.column("lone"), part.column("dim"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(own)], ["class_id", "lone", "dim", "codes", "own"])

    return run


def _scan(k: int, epsilon: float, against_bar: bool):
    """For each query of one block among the codes of another: its k largest lower bounds, or all rows that may reach its bar."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {n: [np.empty(0, np.int64)] for n in ("query_id", "class_id")} | {"low": [np.empty(0)]}
        if left.num_rows and right.num_rows:
            queries, codes, own = _matrix(left["vector"]), np.frombuffer(b"".join(right["codes"].to_pylist()), dtype=np.uint8).reshape(right.num_rows, -1), right["own"].to_numpy()
            q_ids, q_class, r_class = (t[c].to_numpy() for t, c in ((left, "query_id"), (left, "class_id"), (right, "class_id")))
            ones = signs(codes)
            lone, bars = right["lone"].to_numpy(zero_copy_only=False), left["bar"].to_numpy()
            for at in range(0, len(q_ids), TILE):
                near, error = estimate(ones, own, queries[at : at + TILE], epsilon)
                near[lone[None, :] & (r_class[None, :] == q_class[at : at + TILE, None])] = -np.inf  # a query is no neighbour of itself
                for i in range(len(near)):
                    if against_bar:
                        pick = np.flatnonzero((near[i] + error >= bars[at + i]) & (near[i] > -np.inf))
                    else:
                        low = near[i] - error
                        pick = np.argpartition(-low, k - 1)[:k] if len(low) > k else np.arange(len(low))
                        pick = pick[near[i][pick] > -np.inf]
                    out["query_id"].append(np.full(len(pick), q_ids[at + i]))
                    out["class_id"].append(r_class[pick])
                    out["low"].append((near[i] - error)[pick].astype(np.float64))
        return pa.table({n: np.concatenate(v) for n, v in out.items()})

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact cosines of rows (query_id, class_id, q, v)."""
    for batch in batches:
        score = np.empty(len(batch))
        for rows in slices_of(batch.column("dim").to_numpy(), 8192):
            part = batch.take(pa.array(rows))
            score[rows] = (unit(_matrix(part.column("q"))) * unit(_matrix(part.column("v")))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("class_id"), pa.array(score)], ["query_id", "class_id", "score"])


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, epsilon: float = 3.0, bits: int = BITS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id is divisible by ``every``. ``bits`` is a multiple of 8."""
    rows = usable(vectors, id_column, vector_column)
    same = F.xxhash64("vector").alias("h1"), F.xxhash64(F.reverse("vector"), F.size("vector")).alias("h2")
    keyed = rows.select("vec_id", "vector", *same)
    ids = keyed.groupBy("h1", "h2", "vec_id").agg(F.first("vector").alias("vector"))
    least = Window.partitionBy("h1", "h2").orderBy("vec_id")
    members = saved(ids.withColumn("nth", F.row_number().over(least)).filter(F.col("nth") <= k + 1), "members")
    size = members.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("class_id"))
    classes = saved(members.filter("nth = 1").join(size, ["h1", "h2"]).select("h1", "h2", "class_id", "vector", F.size("vector").alias("dim"), (F.col("n") == 1).alias("lone")), "classes")
    queries = saved(keyed.filter(F.col("vec_id") % every == 0).groupBy("h1", "h2", "vec_id").agg(F.first("vector").alias("vector")).join(classes.select("h1", "h2", "class_id"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "class_id", "vector", F.size("vector").alias("dim")), "queries")
    codes = saved(classes.select("class_id", "lone", "dim", "vector").mapInArrow(_encoded(bits), "class_id long, lone boolean, dim int, codes binary, own double"), "codes")

    n_blocks, q_blocks = max(1, -(-codes.count() // BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    deal = lambda id_, n: F.pmod(F.xxhash64(F.lit(n), F.col(id_)), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = codes.withColumns({"rb": deal("class_id", n_blocks)}).withColumn("qb", every_of(q_blocks))
    keys = ["dim", "qb", "rb"]  # vectors of different length never meet

    def scan(barred: DataFrame, against_bar: bool) -> DataFrame:
        left = barred.withColumn("qb", deal("query_id", q_blocks)).withColumn("rb", every_of(n_blocks))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scan(k + 1, epsilon, against_bar), "query_id long, class_id long, low double")

    def reranked(found: DataFrame) -> DataFrame:
        met = found.select("query_id", "class_id").join(queries.select("query_id", "dim", F.col("vector").alias("q")), "query_id").join(classes.select("class_id", F.size("vector").alias("c_dim"), F.col("vector").alias("v")), "class_id")
        return met.filter("dim = c_dim").select("query_id", "class_id", "dim", "q", "v").mapInArrow(_cosines, "query_id long, class_id long, score double")

    first = Window.partitionBy("query_id").orderBy(F.desc("low"), "class_id")
    likely = scan(queries.withColumn("bar", F.lit(float("-inf"))), False).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    bar = reranked(likely).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    bars = queries.join(bar, "query_id", "left").withColumn("bar", F.when(F.col("n") > k, F.col("least")).otherwise(F.lit(float("-inf")))).drop("least", "n")
    survivors = saved(scan(saved(bars, "bars"), True), "survivors")
    # best classes of each query (one more than k: its own class may name the query itself), then the least ids of each
    by_class = Window.partitionBy("query_id").orderBy(F.desc("score"), "class_id")
    best = reranked(survivors).withColumn("place", F.row_number().over(by_class)).filter(F.col("place") <= k + 1)
    in_class = members.join(size.select("h1", "h2", "class_id"), ["h1", "h2"]).select("class_id", "vec_id")
    pairs = best.join(in_class, "class_id").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
