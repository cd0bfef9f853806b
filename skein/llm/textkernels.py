"""Vectorised word and window hashing over Arrow string columns, used inside Spark tasks.

Words are maximal runs of bytes outside the six ASCII blanks (space and 0x09-0x0D). As no blank byte occurs inside a
multi-byte UTF-8 sequence, cutting bytes cuts code points correctly. A null text counts as the empty text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_CODES = np.random.default_rng(20240501).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE_A, BASE_B, BASE_WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F
LONG = 256
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of an odd base modulo 2**64, and of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 1 << 22:  # a single huge text does not stay in memory
            _powers[base] = have
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of every run of ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(base, n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up, out=total[1:])
    return (total[width:] - total[:-width]) * down[: n - width + 1]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def slices(texts: pa.Array, most_bytes: int = 1 << 20):
    """Cut a string column into runs of rows of about ``most_bytes``; one longer text makes a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at, n = 0, len(texts)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield at, to
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column without nulls."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return body, off - off[0]


def slices_of(values: np.ndarray, most: int):
    """Row numbers of each run of at most ``most`` rows of one value."""
    order = np.argsort(values, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
        for at in range(0, len(group), most):
            yield group[at : at + most]


class Words:
    """Words of a run of rows: byte bounds, 64-bit ids, and the first word of each row.

    A word's id is a polynomial modulo 2**64 over random odd codes of its bytes. Such sums are weak for long words of few
    different bytes (a Thue-Morse word and its complement agree from 2,048 bytes on), so words longer than ``LONG`` bytes take
    their id from a cryptographic digest.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, ids: bool = True):
        body, off = raw(texts)
        n = len(body)
        if lower:
            body = _LOWER[body]
        self.bytes, self.offsets = body, off
        blank = _BLANK[body]
        before = np.ones(n, dtype=bool)
        before[1:] = blank[:-1]
        before[off[:-1][off[:-1] < n]] = True
        after = np.ones(n, dtype=bool)
        after[:-1] = blank[1:]
        after[off[1:][off[1:] > 0] - 1] = True
        self.starts = np.flatnonzero(~blank & before)
        self.ends = np.flatnonzero(~blank & after) + 1
        self.first = np.searchsorted(self.starts, off)  # rows + 1 entries
        if ids:
            self.ids = self._ids(body)

    def _ids(self, body: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.empty(0, dtype=np.uint64)
        lengths = self.ends - self.starts
        at = np.arange(len(body), dtype=np.int32 if len(body) < 2**31 else np.int64)
        at[self.starts[0] :] -= np.repeat(self.starts.astype(at.dtype), np.diff(np.r_[self.starts, len(body)]))
        np.minimum(at, LONG, out=at)
        values = _BYTE_CODES[body]
        values *= powers(BASE_WORD, LONG + 1)[0][at]
        values[_BLANK[body]] = 0
        ids = mix(np.add.reduceat(values, self.starts) + lengths.astype(np.uint64))
        for n in np.flatnonzero(lengths > LONG):
            ids[n] = int.from_bytes(hashlib.blake2b(body[self.starts[n] : self.ends[n]].tobytes(), digest_size=8).digest(), "little")
        return ids

    def __len__(self) -> int:
        return len(self.first) - 1
