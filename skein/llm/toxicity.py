"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Words are runs of letters, lower-cased. A text's vector holds every word of the examples that it has, at weight

    (1 + log tf) * idf(w) * rf(w),    idf(w) = log(1 + N / df(w)),    rf(w) = log2(2 + toxic(w) / max(1, other(w)))

df counts all documents of the corpus; toxic and other count examples of either label that have the word (the relevance
frequency of Lan et al., 2009: a word that tells nothing keeps a factor near 1, none is left out). The norm takes in all of a
text's words; those no example has weigh as words of one document without relevance.

The index holds the examples' vectors, sorted by their strongest word and cut into blocks of ``BLOCK``. Words that many
examples have (``HEAD`` of them or more) are kept as columns with their largest weight in each block; all others as posting
lists. A search adds up the posting lists, bounds each example from above by the block maxima of the text's head words, and
adds the true head weights only for examples whose bound reaches the k-th best, so the k nearest are exact. They vote,
weighted by cosine; votes are smoothed towards the base share and calibrated by isotonic regression on an eighth of the
examples, which the index does not hold. Neighbours and cosines are the evidence. Texts without any word of the examples have
no evidence, and score the toxic share of calibration examples of that sort, shrunk to 0.

The sample (at most ``most_examples`` rows, by least hash of the text), its vocabulary and the index are of bounded size
whatever the corpus, save for the length of single texts. All else is one pass over the texts that counts the sample's words
(pre-aggregated to one row a word and task), and one that scores each text where it is read.

Defined cases: null and empty texts have no words; labels that are null or not 0 or 1 are ignored; several labels of
one text are averaged; rows with a null doc_id are scored and not held out; without any labelled example all scores are 0;
an empty table gives an empty result; other columns are ignored. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import saved

MOST_EXAMPLES = 3_400
BLOCK, HEAD = 64, 0.15  # examples of a block; share of the examples that makes a head word
LEAST_CALIBRATION = 50  # examples; with fewer, votes are taken as they are
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> Counter:
    return Counter(LETTERS.findall((text or "").lower()))


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples of each word by label: (word, toxic, other), of the examples in the index."""
    toxic, other = Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            (toxic if y >= 0.5 else other).update(words_of(text).keys())
    found = sorted(toxic.keys() | other.keys())
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic[w] for w in found], pa.int64()), pa.array([other[w] for w in found], pa.int64())], ["word", "toxic", "other"])


def _document_counts(numbers):
    """Documents of a task that hold each word of a broadcast vocabulary: (id, n), and their number under id -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        n, rows = np.zeros(len(known), dtype=np.int64), 0
        for batch in batches:
            rows += len(batch)
            for text in batch.column("text").to_pylist():
                n[[known[w] for w in set(LETTERS.findall(text.lower())) if w in known]] += 1
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, met].astype(np.int32)), pa.array(np.r_[rows, n[met]])], ["id", "n"])

    return run


@dataclass
class Vectoriser:
    """Weights of words: ``numbers`` names them, ``weights`` has idf * rf, ``unseen`` is the weight of all other words."""

    numbers: dict[str, int]
    weights: np.ndarray
    unseen: float

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and weights of a text, at norm 1 over all its words."""
        known = [(self.numbers[w], n) for w, n in counts.items() if w in self.numbers]
        if not known:
            return np.empty(0, np.int64), np.empty(0)
        ids, tf = np.array(known, dtype=np.int64).T
        w = (1 + np.log(tf)) * self.weights[ids]
        rest = sum((1 + math.log(n)) ** 2 if n > 1 else 1.0 for word, n in counts.items() if word not in self.numbers)
        return ids, w / math.sqrt((w * w).sum() + rest * self.unseen**2)


def _vectors(words):
    """Vectors of texts: the other columns, ids, weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [words.value.vector(words_of(text)) for text in batch.column("text").to_pylist()]
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float64()))], [*kept, "ids", "weights"])

    return run


@dataclass
class Index:
    """Block-max inverted index of labelled examples."""

    labels: np.ndarray
    names: np.ndarray
    base: float
    start: np.ndarray  # of each word's posting list
    rows: np.ndarray
    weights: np.ndarray
    head: np.ndarray  # column of each head word, -1 for others
    columns: np.ndarray  # examples x head words
    tops: np.ndarray  # head words x blocks
    blank: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def build(cls, vectors: pa.Table, n_words: int, head_share: float = HEAD) -> Index:
        """vectors: name, toxic, ids, weights (word numbers and weights of each example), in any order."""
        lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (vectors["ids"], vectors["weights"])]
        sizes = np.diff(lists[0].offsets.to_numpy())
        flat_ids, flat_weights = lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy()
        names, labels = vectors["name"].to_numpy(), vectors["toxic"].to_numpy()
        ends = np.cumsum(sizes)
        strongest = np.array([flat_ids[e - n + flat_weights[e - n : e].argmax()] if n else -1 for e, n in zip(ends, sizes, strict=True)], dtype=np.int64)
        order = np.lexsort((names, strongest))
        order = order[sizes[order] > 0]
        at = np.concatenate([np.empty(0, np.int64), *(np.arange(ends[e] - sizes[e], ends[e]) for e in order)])
        ids, weights, rows = flat_ids[at].astype(np.int64), flat_weights[at], np.repeat(np.arange(len(order)), sizes[order])
        examples, labels, names = order, labels[order].astype(np.float64), names[order].astype(np.int64)
        base = float(labels.mean()) if len(labels) else 0.0
        held = np.bincount(ids, minlength=n_words)
        heads = np.flatnonzero((held >= max(head_share * len(examples), 1)) & (held > BLOCK))
        head = np.full(n_words, -1, dtype=np.int32)
        head[heads] = np.arange(len(heads))
        n_blocks = -(-len(examples) // BLOCK)
        columns = np.zeros((n_blocks * BLOCK, len(heads)))
        at_head = head[ids] >= 0
        columns[rows[at_head], head[ids[at_head]]] = weights[at_head]
        tops = columns.reshape(n_blocks, BLOCK, len(heads)).max(axis=1).T if n_blocks else np.zeros((0, 0))
        by_word = np.argsort(ids[~at_head], kind="stable")
        start = np.searchsorted(ids[~at_head][by_word], np.arange(n_words + 1))
        return cls(labels, names, base, start, rows[~at_head][by_word].astype(np.int32), weights[~at_head][by_word], head, columns, np.ascontiguousarray(tops))

    def search(self, ids: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples, exactly; ties go to the lower row. Examples of cosine 0 are none."""
        n = len(self.labels)
        if not n or not len(ids):
            return np.empty(0, np.int64), np.empty(0)
        at = self.head[ids]
        tail, q = ids[at < 0], np.zeros(self.columns.shape[1])
        q[at[at >= 0]] = w[at >= 0]  # over all head words: whole rows of columns are read faster than parts of them
        lo, hi = self.start[tail], self.start[tail + 1]
        lists = [slice(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        rows = np.concatenate([np.empty(0, np.int64), *(self.rows[s] for s in lists)])
        part = np.bincount(rows, np.concatenate([np.empty(0), *(self.weights[s] for s in lists)]) * np.repeat(w[at < 0], hi - lo), minlength=n)
        bound = part + np.repeat(q @ self.tops, BLOCK)[:n]
        seed = np.argpartition(-bound, k - 1)[:k] if n > k else np.arange(n)
        least = (part[seed] + self.columns[seed] @ q).min() if n > k else 0.0
        pick = np.flatnonzero((bound >= least - 1e-12) & (bound > 0))
        cosines = part[pick] + self.columns[pick] @ q
        order = np.lexsort((pick, -np.round(cosines, 12)))[:k]
        order = order[cosines[order] > 0]
        return pick[order], cosines[order]

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic neighbours by cosine, with the base share as a neighbour of a tenth of the nearest one's weight."""
        if not len(rows):
            return self.base
        prior = cosines[0] / 10
        return float(((cosines * self.labels[rows]).sum() + prior * self.base) / (cosines.sum() + prior))

    def calibrate(self, votes: list[tuple[float, float, bool]]) -> None:
        """Isotonic steps from votes to labels, pooled to 5 examples at least, of (vote, label, whether there was evidence)."""
        blank = [y for _, y, told in votes if not told]
        self.blank = sum(blank) / (len(blank) + 1)
        pairs = sorted((v, y) for v, y, told in votes if told)
        toxic = sum(y for _, y in pairs)
        if len(pairs) < LEAST_CALIBRATION or min(toxic, len(pairs) - toxic) < 5:
            return
        parts = [pairs[at : at + 5] for at in range(0, len(pairs), 5)]
        pools: list[list[float]] = []
        for part in parts:
            pools.append([sum(v for v, _ in part) / len(part), sum(y for _, y in part), len(part)])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                v, y, n = pools.pop()
                v0, y0, n0 = pools[-1]
                pools[-1] = [(v0 * n0 + v * n) / (n0 + n), y0 + y, n0 + n]
        self.steps = np.array([p[0] for p in pools]), np.array([(y + self.base) / (n + 1) for _, y, n in pools])

    def score(self, ids: np.ndarray, w: np.ndarray, k: int) -> tuple[float, list[int], list[float]]:
        rows, cosines = self.search(ids, w, k)
        if not len(rows):
            return self.blank, [], []
        vote = self.vote(rows, cosines)
        # the vote breaks ties between texts of one calibrated level
        score = vote if self.steps is None else 0.99 * float(np.interp(vote, *self.steps)) + 0.01 * vote
        return min(1.0, score), self.names[rows].tolist(), cosines.tolist()


def _scored(model, k: int):
    """Scores of texts: the other columns, score, evidence, cosines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectoriser, index = model.value
        for batch in batches:
            out = [index.score(*vectoriser.vector(words_of(text)), k) for text in batch.column("text").to_pylist()]
            kept = [n for n in batch.schema.names if n != "text"]
            arrays = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *arrays], [*kept, "score", "evidence", "cosines"])

    return run


class ToxicityScorer:
    """Learns from labelled documents; ``score`` gives a row per document.

    k: neighbours that vote; most_examples: bound on the labelled texts, an eighth of which calibrates.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, k: int = 15, most_examples: int = MOST_EXAMPLES):
        self.k = k
        self.texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        marks = labels.filter("toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("label_id")).agg(F.avg(F.col("toxic").cast("double")).alias("toxic"))
        # The sample is chosen on hashes, so only its own texts move. Equal texts are one example with their mean label.
        name = F.xxhash64("text").alias("name")
        hashed = saved(self.texts.select("doc_id", name), "hashes")
        chosen = hashed.join(marks, F.col("doc_id") == F.col("label_id")).groupBy("name").agg(F.avg("toxic").alias("toxic"), F.min("doc_id").alias("example_id")).orderBy("name").limit(most_examples)
        chosen = saved(chosen.withColumnRenamed("name", "example"), "chosen")
        # most_examples rows of three numbers bound what is broadcast
        met = self.texts.select("doc_id", name, "text").join(F.broadcast(chosen), (F.col("name") == F.col("example")) & (F.col("doc_id") == F.col("example_id")))
        sample = met.dropDuplicates(["name"]).select("name", "toxic", "text", (F.pmod(F.xxhash64("name"), F.lit(8)) == 0).alias("calibrates"))
        self.sample = saved(sample, "examples")
        self.model = self._learn()

    def _learn(self):
        """Broadcast (vectoriser, index), or None without an example. What the driver takes is the sample's words and weights, as arrays."""
        sc, indexed = self.texts.sparkSession.sparkContext, self.sample.filter("not calibrates")
        counted = indexed.select("text", "toxic").mapInArrow(_example_words, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow()
        if not counted.num_rows:
            return None
        numbers = sc.broadcast({w: i for i, w in enumerate(counted.column("word").to_pylist())})
        held = self.texts.select("text").mapInArrow(_document_counts(numbers), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
        ids, n = held.column("id").to_numpy(), held.column("n").to_numpy()
        total, df = n[ids < 0].sum(), np.ones(counted.num_rows)
        df[ids[ids >= 0]] = n[ids >= 0]
        relevance = np.log2(2 + counted.column("toxic").to_numpy() / np.maximum(1, counted.column("other").to_numpy()))
        vectoriser = Vectoriser(numbers.value, np.log(1 + total / df) * relevance, float(np.log(1 + total)))
        words = sc.broadcast(vectoriser)
        vectors = indexed.select("name", "toxic", "text").mapInArrow(_vectors(words), "name long, toxic double, ids array<int>, weights array<double>").toArrow()  # most_examples rows
        index = Index.build(vectors, len(df))
        model = sc.broadcast((vectoriser, index))
        votes = self.sample.filter("calibrates").select("toxic", "text").mapInArrow(_scored(model, self.k), "toxic double, score double, evidence array<long>, cosines array<double>")
        index.calibrate([(r.score, r.toxic, r.told) for r in votes.select("score", "toxic", (F.size("evidence") > 0).alias("told")).collect()])
        for old in (numbers, words, model):
            old.destroy()
        return sc.broadcast((vectoriser, index))

    def release(self) -> None:
        """Frees the index on the driver and the executors; nothing can be scored after it."""
        if self.model is not None:
            self.model.destroy()
            self.model = None

    def score(self) -> DataFrame:
        """doc_id, row_key (a hash of doc_id and text), score, evidence (hashes of the nearest example texts), cosines."""
        keyed = self.texts.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.xxhash64("text").alias("text_key"), "text")
        schema = "score double, evidence array<long>, cosines array<double>"
        if self.model is None:
            return keyed.select("doc_id", "row_key", "text_key", F.lit(0.0).alias("score"), F.array().cast("array<long>").alias("evidence"), F.array().cast("array<double>").alias("cosines"))
        return keyed.mapInArrow(_scored(self.model, self.k), "doc_id long, row_key long, text_key long, " + schema)


def predicted(score: Column, threshold: float) -> Column:
    return (score >= threshold).cast("int")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, cosines, one row per document."""
    scored = ToxicityScorer(docs, labels, **options).score()
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted(F.col("score"), threshold).alias("predicted"), "evidence", "cosines")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, with their columns. A text without evidence is never dropped."""
    scorer = ToxicityScorer(docs, labels, **options)
    rejected = scorer.score().filter((predicted(F.col("score"), threshold) == 1) & (F.size("evidence") > 0)).select("row_key", "text_key").distinct()
    rejected = saved(rejected, "rejected")
    scorer.release()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the row is nested, so that no column of it can clash
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col("doc_id"), text).alias("row_key"), F.xxhash64(text).alias("text_key"))
    return keyed.join(rejected, ["row_key", "text_key"], "left_anti").select(*(F.col("row")[c].alias(c) for c in docs.columns))
