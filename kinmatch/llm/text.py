"""Whole texts as flat numpy arrays: words, lines and n-grams without a Python loop per word.

Words are runs of characters other than space, tab, \\n, \\v, \\f and \\r. All of these are
ASCII, so UTF-8 bytes can be scanned without decoding. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text held as numpy arrays at a time (a single longer text is held alone).
CHUNK_BYTES = 1 << 20

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 8 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


_FOLD = _LOWER.copy()
_FOLD[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 0x20


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def folded(data: np.ndarray) -> np.ndarray:
    """ASCII punctuation as spaces, A-Z and the capitals of Latin-1 in lower case."""
    out = _FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def run_hash(words: np.ndarray) -> np.uint64:
    """The hash that grams() gives a run of these words."""
    return mix((words * _GRAM[: len(words)]).sum(keepdims=True))[0]


@dataclass
class Chunk:
    """Some whole texts: their bytes one after another, and where each begins and ends."""

    rows: slice
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @property
    def n(self) -> int:
        return len(self.begin)

    @cached_property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        inside = ~_SEP[self.data]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        before[self.begin[self.begin < len(inside)]] = False
        last = self.end[self.end > 0] - 1
        after[last] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    @property
    def starts(self) -> np.ndarray:
        return self._edges[0]

    @property
    def stops(self) -> np.ndarray:
        return self._edges[1]

    @cached_property
    def first(self) -> np.ndarray:
        """For each text, the number of words before it; one entry more at the end."""
        return np.append(np.searchsorted(self.starts, self.begin), len(self.starts))

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def doc(self) -> np.ndarray:
        """For each word, the text it is in."""
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def _sums(self) -> np.ndarray:
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _power(_BASE, len(self.data)), out=out[1:])
        return out

    def span_hash(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        h = (self._sums[stops] - self._sums[starts]) * _power(_BASE_INV, len(self.data) + 1)[starts]
        return mix(h + (stops - starts).astype(np.uint64))

    @cached_property
    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.stops)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, stop and text of every line; text between line feeds, empty ones too."""
        at = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.begin, at + 1])
        stops = np.concatenate([at, self.end])
        doc = np.concatenate([np.arange(self.n), np.searchsorted(self.end, at, side="right")])
        # Empty texts share their begin with the next one: ordering by text first keeps lines apart.
        a = np.lexsort((starts, doc))
        doc_of_stop = np.concatenate([np.searchsorted(self.end, at, side="right"), np.arange(self.n)])
        b = np.lexsort((stops, doc_of_stop))
        return starts[a], stops[b], doc[a]

    def gram_starts(self, k: int) -> np.ndarray:
        """The words at which a run of k words of one text begins."""
        n = len(self.doc)
        return np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :]) if n >= k else np.zeros(0, np.int64)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of every run of k words."""
        at, h = self.gram_starts(k), self.word_hash
        acc = np.zeros(len(at), np.uint64)
        for j in range(k):
            acc += h[at + j] * _GRAM[j]
        return mix(acc), self.doc[at]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As grams, but a text with fewer words is one run of all that it has."""
        out, doc = self.grams(k)
        short = np.flatnonzero((self.n_words > 0) & (self.n_words < k))
        if not len(short):
            return out, doc
        h, acc = self.word_hash, np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = self.n_words[short] > j
            acc[has] += h[self.first[short[has]] + j] * _GRAM[32 + j]
        return np.concatenate([out, mix(acc + np.uint64(1))]), np.concatenate([doc, short])


def chunks(texts: pa.Array, through: Callable[[np.ndarray], np.ndarray] | None = None, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow column in chunks of about `limit` bytes, each text whole; through changes bytes, not their number."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        upto = min(upto, len(texts))
        data = raw[offsets[at] : offsets[upto]]
        off = offsets[at : upto + 1] - offsets[at]
        yield Chunk(slice(at, upto), through(data) if through else data, off[:-1], off[1:])
        at = upto
