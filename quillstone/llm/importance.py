"""Importance resampling towards a target distribution of hashed word n-grams.

A batch's texts are lower-cased, joined with sentinels between them, and cut into words
by one regex pass.  N-grams that would reach over a document's end are masked by the
documents' offsets; what is left is counted by bucket.  Rows are scored by how much
likelier their features are in the target than in the corpus, plus Gumbel noise fixed
by their ids; the highest scores are a draw without replacement.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.membership import PIECES, folded, pieces_of
from quillstone.llm.numbering import numbered
from quillstone.llm.staging import digest, stage
from quillstone.llm.words import short, utf8

BUCKETS = 10_000
#: Features are runs of 1 to ORDER words.
ORDER = 3
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Counters of the bucket table that one row carries on its way to the driver.
PIECE = 1_000
#: Bytes that the regex goes over at once; words never reach over such a cut.
SLAB = 8 << 20
#: Words of more bytes are hashed as a whole, not by the tables.
TABLED = 64

SENTINEL = b"\x00"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+|\x00")
#: A-Z in lower case; every byte that is in no word is a blank, so the sentinel stands for nothing else.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _advance(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-32 states after one more zero byte."""
    return (x >> np.uint32(8)) ^ table[x & np.uint32(255)]


def _shift_tables() -> np.ndarray:
    """For 0 to TABLED + 1 further bytes: what each value of each byte of a CRC-32 state becomes (lengths x 4 x 256)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    out = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)]
    for _ in range(TABLED + 1):
        out.append(_advance(out[-1], table))
    return np.stack(out)


def _shifted(crc: np.ndarray, n: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The states ``crc`` after ``n`` zero bytes each."""
    low = np.uint32(255)
    return tables[n, 0, crc & low] ^ tables[n, 1, crc >> np.uint32(8) & low] ^ tables[n, 2, crc >> np.uint32(16) & low] ^ tables[n, 3, crc >> np.uint32(24)]


class Features:
    """The hashed features of batches of texts."""

    def __init__(self) -> None:
        self.tables = _shift_tables()

    def words(self, column) -> tuple[np.ndarray, np.ndarray, dict[int, bytes], np.ndarray]:
        """CRC-32 and bytes of all words of the batch, the long words by their place, and how many words end with each document."""
        data, offsets = utf8(column)
        raw = data.tobytes()
        joined = SENTINEL.join(raw[i:j].translate(_PLAIN) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)) + SENTINEL
        crcs, sizes, ends, long, n, i = [], [], [], {}, 0, 0
        while i < len(joined):
            j = len(joined)
            if j - i > SLAB:  # up to a byte that is in no word
                cut = re.compile(rb"[\x20\x00]").search(joined, i + SLAB)
                j = cut.end() if cut else j
            found = _WORD.findall(joined, i, j)
            size = np.fromiter(map(len, found), np.int64, len(found))
            crc = np.fromiter(map(zlib.crc32, found), np.uint32, len(found))
            at = np.flatnonzero((size == 1) & (crc == np.uint32(zlib.crc32(SENTINEL))))
            keep = np.ones(len(found), bool)
            keep[at] = False
            ends.append(n + at - np.arange(len(at)))
            for k in np.flatnonzero(size > TABLED).tolist():
                long[n + k - int(np.searchsorted(at, k))] = found[k]
            crcs.append(crc[keep])
            sizes.append(size[keep])
            n += len(found) - len(at)
            i = j
        return np.concatenate(crcs), np.concatenate(sizes), long, np.concatenate(ends)

    def buckets(self, column, n_buckets: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Per order the bucket of each n-gram by its first word, which of them lie in one document, and the documents' ends in words."""
        crc, size, long, ends = self.words(column)
        rows = np.searchsorted(ends, np.arange(len(crc)), side="right")
        blank = np.uint32(zlib.crc32(b" "))
        short_ = np.minimum(size, TABLED)
        after = _shifted(np.full(len(crc), blank), short_, self.tables) ^ crc  # of a blank and the word
        for k, word in long.items():
            after[k] = zlib.crc32(b" " + word)
        grams, whole, state = [crc % np.uint32(n_buckets)], [np.ones(len(crc), bool)], crc
        for order in range(1, ORDER):
            m = max(len(crc) - order, 0)
            last = slice(order, order + m)
            longer = _shifted(state[:m], short_[last] + 1, self.tables) ^ after[last]
            for k, word in long.items():
                if 0 <= k - order < m:
                    longer[k - order] = zlib.crc32(b" " + word, int(state[k - order]))
            state = longer
            grams.append(longer % np.uint32(n_buckets))
            whole.append(rows[:m] == rows[last])
        return grams, whole, ends


def bucket_counts(docs: DataFrame, n_buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """How often the features of all texts fall into each bucket.

    Every task counts all its rows in a table of fixed size; the tables are added up
    piece by piece in tasks, so that the driver gets ``n_buckets`` numbers.
    """
    width = -(-n_buckets // PIECE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, seen = Features(), np.zeros(width * PIECE, np.int64)
        for batch in short(batches, 0):
            for grams, whole in zip(*features.buckets(batch.column(0), n_buckets)[:2], strict=True):
                seen += np.bincount(grams[whole], minlength=len(seen))
        yield pieces_of(seen.astype("<i8").reshape(-1, PIECE))

    out = np.zeros((width, PIECE), np.int64)
    for piece, counts in folded(docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, PIECES), "<i8", np.add).items():
        out[piece] = counts
    return out.ravel()[:n_buckets]


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 * ln of the ratio of its smoothed shares in target and corpus)."""
    n, s, t = float(len(corpus)), float(corpus.sum()), float(target.sum())
    ratio = [(float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged, per row: doc_id, digest, n_words, n_features, weight (the sum of its features' gains)."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, gain = Features(), held.value
        for batch in short(batches, 2):
            grams, whole, ends = features.buckets(batch.column(2), len(gain))
            starts = np.concatenate([[0], ends[:-1]])
            n, weight, count = ends - starts, np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
            for order, (of, inside) in enumerate(zip(grams, whole, strict=True)):
                upto = np.concatenate([[0], np.cumsum(np.where(inside, gain[of], 0))])
                weight += upto[np.minimum(ends, len(of))] - upto[np.minimum(starts, len(of))]
                count += np.maximum(n - order, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(count, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "digest", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), digest(text).alias("digest"), F.col(text).cast("string").alias("text"))
    return stage(rows.mapInArrow(weigh, "doc_id long, digest binary, n_words long, n_features long, weight long"), "weights")


def scored(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, n_buckets: int = BUCKETS, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, digest, n_words, n_features, weight, score, rank (null if it is not drawn).

    Of the N rows with ``least_words`` words or more, floor(percent * N / 100) are drawn,
    those of the highest scores, ties to the smaller doc_id.

    Defined cases: a null or empty text has no features, weight 0 and is never drawn
    (unless ``least_words`` is 0); a null doc_id counts as an empty one for the noise and
    comes after all others in ties; a very long text counts with all its features;
    repeated rows are scored alike and each counts, ranked in any order among
    themselves; without documents the result is empty, without target texts all
    features are as unlikely there; other columns are ignored.
    """
    rows = weighed(docs, gains(bucket_counts(docs, n_buckets, text), bucket_counts(target, n_buckets, target_text)), key, text)
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    may = F.col("n_words") >= least_words
    n_drawn = percent * rows.where(may).count() // 100
    rows = rows.withColumn("score", F.col("weight") + noise).withColumn("_may", may).withColumn("_place", F.monotonically_increasing_id())
    placed = numbered(rows, F.col("_may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_place"), label="scores")
    rank = F.when(F.col("_may") & (F.col("row_no") < n_drawn), F.col("row_no") + 1)
    return placed.withColumn("rank", rank).drop("_may", "_place", "row_no")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, n_buckets: int = BUCKETS, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """The drawn rows of ``docs``, with all their columns.

    Defined cases: as for ``scored``; repeated rows are drawn together if any of them is.
    """
    found = scored(docs, target, percent, least_words, seed, n_buckets, key, text, target_text)
    no_id, no_text = F.lit(-(1 << 63)), F.lit(b"")
    drawn = stage(found.where("rank IS NOT NULL").select(F.coalesce("doc_id", no_id).alias("id"), F.coalesce("digest", no_text).alias("name")).distinct(), "drawn")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("long"), no_id).alias("id"), F.coalesce(digest(text), no_text).alias("name"))
    return rows.join(drawn, ["id", "name"], "left_semi").select("row.*")
