"""Byte-level BPE with given ranks: recursive DuckDB queries over each partition's distinct words, and ordered decoding.

A text is cut by the pattern; each match (a word) is a token of its own if the ranks hold it. All other words are rows (word,
position, token) of a recursive query: every step joins neighbours to the merge table, takes each word's leftmost pair of least
rank and contracts it, until no word has a pair left. Decoding joins token rows to the vocabulary and aggregates their bytes
by position.

A step keeps all rows of its unfinished words, so n bytes make up to n * n / 2 rows. Words longer than ``2 * SPAN`` bytes are
therefore cut into overlapping chunks, which are words of the same queries, and joined where both chunks have a token boundary
and the two tokens beside it, encoded together, stay these two: a sequence of tokens is the encoding of its bytes if and only if
every two neighbours are the encoding of theirs. Where chunks have no such place their span doubles.

Everything runs where the texts are read, without a shuffle. What is shipped is the rank file, whose size does not depend on the
documents; a worker holds that, ``REMEMBERED`` words at most, and the words of ``WORDS`` matches.

Defined cases: null text is the empty text and has no tokens; a null doc_id, repeated rows and an empty table are rows or no
rows like any other; other columns are ignored. Bytes that no rank holds raise an error, as do unknown ids in decoding.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice, pairwise

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPAN = 64  # bytes by which chunks of a long word advance; a chunk is twice as long
STATES = 3_000_000  # rows that one recursive query may make
WORDS = 300_000  # matches that are encoded together
REMEMBERED = 1_200_000  # words whose tokens a worker keeps

CONTRACT = """
WITH RECURSIVE step AS MATERIALIZED (
    SELECT word, pos, token, 0 AS round FROM start
  UNION ALL (
    WITH paired AS MATERIALIZED (
      SELECT word, pos, token, round, before, merged
      FROM (SELECT *, lead(token) OVER near AS following, lag(pos) OVER near AS before FROM step WINDOW near AS (PARTITION BY word ORDER BY pos))
      LEFT JOIN merges ON first = token AND second = following
    ), best AS (
      SELECT word, min((merged::BIGINT << 32) | pos) AS least FROM paired WHERE merged IS NOT NULL GROUP BY word
    )
    SELECT word, pos, CASE WHEN pos = least & 4294967295 THEN (least >> 32)::INTEGER ELSE token END, round + 1
    FROM paired JOIN best USING (word)
    WHERE before IS DISTINCT FROM least & 4294967295
  )
)
SELECT word, token FROM step JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round) ORDER BY word, pos
"""
DECODE = "SELECT doc, string_agg(piece, '' ORDER BY pos) AS bytes FROM ids JOIN vocabulary USING (token) GROUP BY doc"


def read_ranks(path: str) -> bytes:
    """A rank file's bytes, read on the driver: lines of a token in base 64 and its rank."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Coder:
    """Tokens of words, and bytes of tokens, for one rank file and pattern."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks, self.pattern = parse_ranks(data), regex.compile(pattern)
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.ids = np.array(sorted(self.token), np.int32)
        self.decimal = {rank: str(rank) for rank in self.token}
        self._forget()
        self.bytes = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.base = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        merges = [(self.ranks[t[:at]], self.ranks[t[at:]], rank) for t, rank in self.ranks.items() for at in range(1, len(t)) if t[:at] in self.ranks and t[at:] in self.ranks]
        self._fill("merges", np.array(merges, np.int32).reshape(-1, 3), ("first", "second", "merged"))
        # bytes as the characters of the same number
        pieces = pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "piece": [t.decode("latin-1") for t in self.ranks]})
        self.base.register("pieces", pieces)
        self.base.execute("CREATE TABLE vocabulary AS FROM pieces")

    def _fill(self, name: str, rows: np.ndarray, columns: tuple[str, ...]) -> None:
        self.base.register("rows_of", pa.table(dict(zip(columns, rows.T, strict=True))))
        self.base.execute(f"CREATE TABLE {name} AS FROM rows_of")
        self.base.unregister("rows_of")

    def contract(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of each word by recursive queries over (word, position, token)."""
        lengths = np.array([len(w) for w in words], np.int64)
        part = np.cumsum(lengths * (lengths + 1) // 2) // STATES
        out: list[list[int]] = []
        for rows in np.split(np.arange(len(words)), np.flatnonzero(np.diff(part)) + 1):
            if not len(rows):
                continue
            own = lengths[rows]
            tokens = self.bytes[np.frombuffer(b"".join(words[i] for i in rows), np.uint8)]
            if (tokens < 0).any():
                raise ValueError("a byte has no rank")
            ends = np.cumsum(own)
            start = pa.table({"word": np.repeat(np.arange(len(rows), dtype=np.int32), own), "pos": (np.arange(ends[-1]) - np.repeat(ends - own, own)).astype(np.int32), "token": tokens})
            self.base.register("start", start)
            found = self.base.sql(CONTRACT).fetchnumpy()
            cuts = np.searchsorted(found["word"], np.arange(len(rows) + 1)).tolist()
            ids = found["token"].tolist()
            out += [ids[a:b] for a, b in pairwise(cuts)]
        return out

    def encode_bytes(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Tokens of each distinct word: whole if ranked, contracted if short, in chunks if long."""
        words = set(words)
        out = {w: [self.ranks[w]] for w in words if w in self.ranks}
        short = [w for w in words if w not in out and len(w) <= 2 * SPAN]
        out |= zip(short, self.contract(short), strict=True)
        return out | {w: self._joined(w) for w in words if w not in out}

    def _joined(self, word: bytes) -> list[int]:
        """Tokens of a long word from overlapping chunks."""
        span = SPAN
        while 2 * span < len(word):
            starts = range(0, len(word) - span, span)
            chunks = [word[s : s + 2 * span] for s in starts]
            distinct = sorted(set(chunks))
            tokens = dict(zip(distinct, self.contract(distinct), strict=True))
            bounds = {c: np.cumsum([0, *(len(self.token[t]) for t in ids)]).tolist() for c, ids in tokens.items()}
            # places where a chunk and the next one both have a boundary with a token on either side
            met = [[(p, bounds[a].index(p + span)) for p in bounds[b][1:-1] if p + span in set(bounds[a][1:-1])] for a, b in pairwise(chunks)]
            beside = [[(tokens[a][k - 1], tokens[b][bounds[b].index(p)]) for p, k in places] for (a, b), places in zip(pairwise(chunks), met, strict=True)]
            stays = self._stay({pair for pairs in beside for pair in pairs})
            cut = [next((place for place, pair in zip(places, pairs, strict=True) if pair in stays), None) for places, pairs in zip(met, beside, strict=True)]
            if None not in cut:
                ids: list[int] = []
                for number, chunk in enumerate(chunks):
                    first = bounds[chunk].index(cut[number - 1][0]) if number else 0
                    last = cut[number][1] if number < len(cut) else None
                    ids += tokens[chunk][first:last]
                return ids
            span *= 2
        return self.contract([word])[0]

    def _stay(self, pairs: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """Pairs of tokens that are the encoding of their bytes."""
        both = {pair: self.token[pair[0]] + self.token[pair[1]] for pair in pairs}
        words = sorted(set(both.values()))
        found = dict(zip(words, self.contract(words), strict=True))
        return {pair for pair, word in both.items() if found[word] == list(pair)}

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # a word's number
        self.store, self.ends = array("i"), array("q", [0])  # tokens of all known words, and where each word's end

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words, one after the other, and how many each has."""
        new = set(words) - self.known.keys()
        if new and len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = set(words)
        if new:
            found = self.encode_bytes(w.encode() for w in new)
            for number, word in enumerate(new, len(self.known)):
                self.store.extend(found[word.encode()])
                self.ends.append(len(self.store))
                self.known[word] = number
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ends, store = np.array(self.ends), np.array(self.store)
        sizes = (ends[1:] - ends[:-1])[numbers]
        upto = np.cumsum(sizes)
        return store[np.arange(upto[-1] if len(upto) else 0) + np.repeat(ends[numbers] - (upto - sizes), sizes)], sizes

    def decode(self, documents: list[np.ndarray]) -> list[bytes]:
        """Bytes of each document's tokens, aggregated by position."""
        sizes = np.array([len(d) for d in documents], np.int64)
        if not sizes.sum():
            return [b""] * len(documents)
        tokens = np.concatenate(documents).astype(np.int32)
        if not np.isin(tokens, self.ids).all():
            raise ValueError("an id is not in the vocabulary")
        self.base.register("ids", pa.table({"doc": np.repeat(np.arange(len(documents), dtype=np.int32), sizes), "pos": np.arange(len(tokens), dtype=np.int64), "token": tokens}))
        out = [b""] * len(documents)
        for doc, piece in self.base.sql(DECODE).fetchall():
            out[doc] = piece.encode("latin-1")
        return out


@lru_cache(maxsize=2)
def coder(data: bytes, pattern: str) -> Coder:
    """One coder a worker."""
    return Coder(data, pattern)


def encoded(own: Coder, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Tokens of each text, in order; matches of several texts are encoded together, a long text's in parts."""
    words: list[str] = []
    ends: list[int] = []  # of the texts in words
    parts: list[np.ndarray] = []  # of a text that goes on

    def flush() -> Iterator[np.ndarray]:
        tokens, sizes = own.encode(words)
        upto = np.concatenate([[0], np.cumsum(sizes)])[[0, *ends, len(words)]]
        for a, b in pairwise(upto[:-1]):
            yield np.concatenate([*parts, tokens[a:b]])
            parts.clear()
        parts.append(tokens[upto[-2] :])
        words.clear()
        ends.clear()

    for text in texts:
        if text and len(text) > WORDS:
            matches = own.pattern.finditer(text)
            while some := [m[0] for m in islice(matches, WORDS)]:
                words += some
                if len(words) >= WORDS:
                    yield from flush()
        elif text:
            words += own.pattern.findall(text)
        ends.append(len(words))
        if len(words) >= WORDS:
            yield from flush()
    yield from flush()


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("doc_id", "cast(text as string) AS text")


def _doc_id(docs: DataFrame) -> T.StructField:
    return T.StructField("doc_id", docs.schema["doc_id"].dataType)


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and tokens (array of int) of every row of ``docs`` by the rank file ``ranks``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))  # one file, of a size that no table changes

    def run(batches):
        for batch in batches:
            lists = list(encoded(coder(shared.value, pattern), map(pa.StringScalar.as_py, _column(batch, "text"))))
            values = np.concatenate([np.array([], np.int32), *lists])
            tokens = pa.ListArray.from_arrays(np.cumsum([0, *map(len, lists)]).astype(np.int32), values)
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), tokens], ["doc_id", "tokens"])

    return _texts(docs).mapInArrow(run, T.StructType([_doc_id(docs), T.StructField("tokens", T.ArrayType(T.IntegerType()))]))


def decode_documents(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and decoded (binary) of every row of a table with doc_id and tokens; null tokens are none."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def run(batches):
        for batch in batches:
            lists = [np.array(ids.as_py() or [], np.int32) for ids in _column(batch, "tokens")]
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), pa.array(coder(shared.value, pattern).decode(lists), pa.binary())], ["doc_id", "decoded"])

    return tokens.select("doc_id", "tokens").mapInArrow(run, T.StructType([_doc_id(tokens), T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, and decoded from the tokens, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    names = ("n_tokens", "ids_sha256", "decoded_sha256")

    def digests(own: Coder, lists: list[np.ndarray]):
        for ids, raw in zip(lists, own.decode(lists), strict=True):
            yield len(ids), hashlib.sha256(" ".join(map(own.decimal.__getitem__, ids.tolist())).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()

    def run(batches):
        for batch in batches:
            own, rows, lists, held = coder(shared.value, pattern), [], [], 0
            for ids in encoded(own, map(pa.StringScalar.as_py, _column(batch, "text"))):
                lists.append(ids)
                held += len(ids)
                if held >= WORDS:
                    rows += digests(own, lists)
                    lists, held = [], 0
            rows += digests(own, lists)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), *columns], ["doc_id", *names])

    fields = [T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.StringType(), T.StringType()), strict=True)]
    return _texts(docs).mapInArrow(run, T.StructType([_doc_id(docs), *fields]))
