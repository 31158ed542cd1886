"""Words of whole texts as NumPy arrays, for operators that run in Arrow batches.

An Arrow text column already is one byte buffer with offsets, so words, their hashes and hashes of
word windows come from a few array operations over many documents at once. Memory follows the
largest of one slice of a batch and one document; hashing itself works in short blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}

#: Bytes that separate words, x20 and x09 to x0D.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: All ASCII bytes but letters and digits separate normalised words.
MARKS = np.zeros(256, bool)
MARKS[:128] = [not chr(i).isalnum() for i in range(128)]


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others (in a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def strings(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> pa.Array:
    """One large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.utf8_lower(column) if lower else column


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0), of about ``limit`` bytes or one longer text."""
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the first word of each text (n + 1 numbers)."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(breaks[data], out=inside[1:-1])
    step = inside[1:] != inside[:-1]
    edges = np.flatnonzero(step)
    starts, ends = edges[::2], edges[1::2]
    # texts that touch without a blank between them
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut + 1]]
    if len(cut):
        starts = np.sort(np.concatenate([starts, cut]))
        ends = np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words, equal hashes, wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        lo = int(starts[i])
        part = data[lo:int(ends[j - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LETTERS[part] * powers(_BASE, len(part)), out=sums[1:])
        s = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[s]) * powers(_INVERSE, len(part))[s]
        i = j
    return mix(out)


def windows(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """A hash of every ``size`` consecutive values (the caller leaves out those over an edge)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)
    for k in range(size):
        out += words[k:k + n] * weights[k]
    return mix(out)


def prefix_sums(words: np.ndarray) -> np.ndarray:
    """For :func:`range_hashes`."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_BASE, len(words)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the words lo to hi of each pair."""
    return mix((sums[hi] - sums[lo]) * powers(_INVERSE, len(sums))[lo] + (hi - lo).astype(np.uint64))


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and the first shingle of each; a shorter text is one shingle.

    ``first``: first word of each text, n + 1 numbers. A text without words has none.
    """
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    at = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=at[1:])
    text = np.repeat(np.arange(len(made)), made)
    start = first[text] + (np.arange(at[-1]) - at[text])
    out = np.zeros(at[-1], np.uint64)
    full = counts[text] >= size
    every = windows(words, size)
    out[full] = every[start[full]]
    few = np.flatnonzero(~full)
    if len(few):
        sums = prefix_sums(words)
        out[few] = range_hashes(sums, first[text[few]], first[text[few] + 1])
    return out, at


def occurrences(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How many equal values come before, in the same text."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    key = mix(values + text.astype(np.uint64) * np.uint64(_BASE))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    out = np.empty(n, np.int64)
    out[order] = np.arange(n) - begin
    return out
