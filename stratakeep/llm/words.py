"""Vectorised words of Arrow text batches: byte tables mark words, prefix sums hash them.

Both word classes used here end at ASCII bytes only, so the UTF-8 bytes can be scanned as they
are: bytes of 128 and above always belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

CHUNK_BYTES = 1 << 19

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: [^\x20\x09-\x0D]+
PLAIN = np.ones(256, dtype=bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text in lower case; A-Z count as their lower case.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_U = np.uint64
_BASE, _SEED = 0x9E3779B97F4A7C15 | 1, 20240229


@lru_cache(2)
def _byte_codes(fold: bool) -> np.ndarray:
    """A random 64-bit code for each byte; with fold, the same for both cases of A-Z."""
    codes = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    return codes[_FOLD] if fold else codes


_powers: list[np.ndarray] = []


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.r_[_U(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Words:
    """Words of the rows of a text array. A null has none.

    data: all bytes; starts, ends: of each word in data; first: of each row, its first word's
    number, with the total at the end; row_at: of each row its first byte, with the total.
    """

    def __init__(self, texts: pa.Array, is_word: np.ndarray = PLAIN):
        self._kept = None
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        self.data = np.frombuffer(body, np.uint8)[low:high] if body is not None and high > low else np.zeros(0, np.uint8)
        self.row_at = (offsets - low) if len(offsets) else np.zeros(1, np.int64)
        inside = is_word[self.data]
        before = np.r_[False, inside[:-1]] if len(inside) else inside
        after = np.r_[inside[1:], False] if len(inside) else inside
        edges = self.row_at[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        before[edges] = False
        after[edges - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.row_at)

    def hashes(self, fold: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; with fold, the case of A-Z is ignored."""
        return self.spans(self.starts, self.ends, fold)

    def _sums(self, fold: bool) -> np.ndarray:
        """Prefix sums of the bytes' codes times powers of a base, modulo 2**64; made once."""
        if self._kept is None or self._kept[0] != fold:
            powers, _ = _base_powers(len(self.data))
            sums = np.zeros(len(self.data) + 1, np.uint64)
            codes = _byte_codes(fold)[self.data]
            codes *= powers[: len(self.data)]
            np.cumsum(codes, out=sums[1:])
            self._kept = fold, sums
        return self._kept[1]

    def spans(self, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
        """A 64-bit hash of each span of bytes."""
        sums, (_, inverses) = self._sums(fold), _base_powers(len(self.data))
        return mix((sums[ends] - sums[starts]) * inverses[starts])

    def windows(self, n: int, fold: bool = True) -> np.ndarray:
        """A 64-bit hash of the n bytes from each byte on (of fewer at the end of data)."""
        size, sums, (_, inverses) = len(self.data), self._sums(fold), _base_powers(len(self.data))
        whole = max(0, size - n + 1)
        out = np.empty(size, np.uint64)
        np.subtract(sums[n : n + whole], sums[:whole], out=out[:whole])
        np.subtract(sums[size], sums[whole:size], out=out[whole:])
        for k in range(0, size, 1 << 14):  # in the processor's cache
            out[k : k + (1 << 14)] = mix(out[k : k + (1 << 14)] * inverses[k : min(size, k + (1 << 14))])
        return out

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def per_row(self, marked: np.ndarray) -> np.ndarray:
        """How many of each row's bytes are marked."""
        sums = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=sums[1:])
        return sums[self.row_at[1:]] - sums[self.row_at[:-1]]

    def words_per_row(self, marked: np.ndarray) -> np.ndarray:
        """How many of each row's words are marked."""
        sums = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether these n are in one row."""
        total = len(hashes)
        last = np.repeat(self.first[1:], np.diff(self.first))
        whole = np.arange(total) + n <= last
        out = np.zeros(total, np.uint64)
        size = max(0, total - n + 1)
        for k in range(n):
            out[:size] = (out[:size] ^ hashes[k : k + size]) * _U(0xD6E8FEB86659FD93) + _U(n)
        return mix(out), whole


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each row; of fewer words the whole sequence is one."""
    words = Words(texts)
    hashes = words.hashes()
    grams, _ = words.grams(hashes, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            short = _U(b - a)
            for h in hashes[a:b]:
                short = mix((np.array([short]) ^ h) * _U(0xD6E8FEB86659FD93))[0]
            yield np.array([short], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, so that memory doesn't follow row width."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pa.compute.binary_length(sizes).fill_null(0), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(np.r_[0, np.cumsum(lengths)] // limit))
        edges = [0, *(c for c in cuts.tolist() if c), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)
