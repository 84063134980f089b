"""Word spans and hashes of Arrow string batches, in numpy.

All functions work on the UTF-8 bytes of a whole batch at once.  A hash is a
polynomial modulo 2**64 over bytes or words, finished by a mixing step; equal
inputs have equal hashes on any machine.  Such polynomials can't tell some long
strings of two letters apart, so words of more than LONG bytes are hashed by BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
LONG = 64
#: Bytes of words that are hashed at once.
_BLOCK = 1 << 20

#: Rows, and about as many bytes of text, that are worked on at once.
SHORT_ROWS, SHORT_BYTES = 512, 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def short(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows and few bytes in column ``text``; nothing is copied.

    Spark bounds the bytes of a batch; numbers per byte of text take several times as much.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        whole, i = np.concatenate([[0], np.cumsum(sizes)]), 0
        while i < batch.num_rows:
            j = min(i + SHORT_ROWS, max(i + 1, int(np.searchsorted(whole, whole[i] + SHORT_BYTES, side="right")) - 1))
            yield batch.slice(i, j - i)
            i = j


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BYTE_BASE, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the non-overlapping, ordered, non-empty byte spans."""
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    long = ends - starts > LONG
    if long.any():
        raw = [data[i:j].tobytes() for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        out[long] = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in raw]
        out[~long] = span_hashes(data, starts[~long], ends[~long])
        return out
    lengths = ends - starts
    power = _powers(int(lengths.max()))
    done = np.cumsum(lengths)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + _BLOCK, side="right")))
        n = lengths[i:j]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        at = inside + np.repeat(starts[i:j], n)
        terms = (data[at].astype(np.uint64) + np.uint64(1)) * power[inside]
        out[i:j] = np.add.reduceat(terms, first) + n.astype(np.uint64)
        i = j
    return mix(out)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space), and the row of each."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words, by doubling; also across rows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    block, width, got, have = words, 1, None, 0
    left, base = k, np.uint64(_WORD_BASE)
    power = {1: int(_WORD_BASE)}
    while left:
        if left & 1:
            if got is None:
                got, have = block, width
            else:  # the grams so far, then the next block
                scale = np.uint64(pow(int(base), width, 1 << 64))
                m = len(words) - (have + width) + 1
                got, have = got[:m] * scale + block[have : have + m], have + width
        left >>= 1
        if left:
            m = len(words) - 2 * width + 1
            block = block[:m] * np.uint64(pow(int(base), width, 1 << 64)) + block[width : width + m]
            width *= 2
    return mix(got)


def whole_grams(rows: np.ndarray, k: int) -> np.ndarray:
    """Which of the k-word grams lie in one row."""
    return rows[: len(rows) - k + 1] == rows[k - 1 :] if len(rows) >= k else np.zeros(0, bool)


def minimisers(words: np.ndarray, rows: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of ``window`` words in one row, its k-gram of the smallest hash.

    Returns the starts of the windows, the start of each one's gram (the leftmost of
    the smallest), and the hashes of all grams.  Equal windows choose at the same place.
    """
    n = len(words) - window + 1
    grams = gram_hashes(words, k)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    best, width, span = np.arange(len(grams)), 1, window - k + 1
    while width < span:
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(grams[a] <= grams[b], a, b)
        width += step
    starts = np.flatnonzero(whole_grams(rows, window))
    return starts, best[starts], grams
