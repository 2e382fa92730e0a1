"""Words, shingles and MinHash values of many texts at once, on byte arrays.

Words are maximal runs of ASCII letters, digits, underscores and any other non-ASCII characters of the
lower-cased text, so neither case, punctuation nor white space tells two texts apart.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RADIX, -1, 1 << 64)
_MIX_1, _MIX_2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _WORD[_c] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all 64 bits."""
    h = (h ^ (h >> _U(30))) * _MIX_1
    h = (h ^ (h >> _U(27))) * _MIX_2
    return h ^ (h >> _U(31))


_TABLE: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse, at least so many. One table, as long as needed so far, is kept."""
    if not _TABLE or len(_TABLE[0]) < size:
        forth, back = np.full(size, _RADIX, _U), np.full(size, _INVERSE, _U)
        forth[0] = back[0] = 1
        _TABLE[:] = np.cumprod(forth, out=forth), np.cumprod(back, out=back)
    return _TABLE[0], _TABLE[1]


def sliced(incoming: Iterator[pa.RecordBatch], rows: int = 1024, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Record batches of a few rows each, and of about most bytes of texts, so that a worker holds few texts at a time as its own objects.

    A longer text makes a batch alone.
    """
    for batch in incoming:
        held = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                held += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(held), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


def batches(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most characters together; one longer text makes a range alone."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


class Words:
    """hashes: 64 bits for each word of the texts in a row; first: where each text's words begin, and the end;
    starts and ends: byte positions in the texts' lower-cased UTF-8, counted from each text's own start."""

    def __init__(self, texts: list[str]):
        data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter((len(d) + 1 for d in data), np.int64, len(data))
        at = np.zeros(len(data) + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        raw = np.frombuffer(b" ".join([*data, b""]), np.uint8)
        is_word = _WORD[raw]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        size = 1 << max(16, int(raw.size + 1).bit_length())
        forth, back = _powers(size)
        sums = np.zeros(raw.size + 1, _U)
        part = sums[1:]
        part[:] = raw
        part += _U(1)
        part *= forth[: raw.size]
        np.cumsum(part, out=part)
        self.hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(_U))
        self.first = np.searchsorted(starts, at)
        owner = np.repeat(np.arange(len(data)), np.diff(self.first))
        self.starts, self.ends = starts - at[owner], ends - at[owner]


@functools.cache
def _factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, np.uint64) * _U(2) + _U(1)


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words, text by text, and where each text's begin (and the end).

    A text of fewer words has one shingle of all of them; one without words has none.
    """
    h, first = words.hashes, words.first
    counts = np.diff(first)
    mine = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begins = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(mine, out=begins[1:])
    total = int(begins[-1])
    where = np.arange(total) - np.repeat(begins[:-1] - first[:-1], mine)  # the shingle's first word
    end = np.repeat(first[1:], mine)
    out = np.zeros(total, _U)
    padded = np.concatenate((h, np.zeros(n, _U)))
    for k, factor in enumerate(_factors(n, 5)):
        part = padded[where + k] * factor
        part[where + k >= end] = 0
        out += part
    return mix(out + _U(1)), begins


@functools.cache
def _hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 63, n, np.uint64) * _U(2) + _U(1), rng.integers(0, 1 << 63, n, np.uint64)


def minhashes(hashes: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values (32 bits) of each text; texts without shingles have the greatest value everywhere."""
    out = np.full((len(begins) - 1, n), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(begins))
    if not len(some):
        return out
    factors, terms = _hash_functions(n)
    # a few texts at a time, so that what each function makes stays in the cache
    bounds = np.searchsorted(begins[some], np.arange(0, int(begins[-1]) + 1, 1 << 15))
    edges = np.unique(np.concatenate((bounds, [0, len(some)])))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = some[low:high]
        offset, end = int(begins[part[0]]), int(begins[part[-1] + 1])
        own, cuts = hashes[offset:end], begins[part] - offset
        buffer = np.empty_like(own)
        for k in range(n):
            np.multiply(own, factors[k], out=buffer)
            np.add(buffer, terms[k], out=buffer)
            out[part, k] = np.minimum.reduceat(buffer, cuts) >> _U(32)
    return out
