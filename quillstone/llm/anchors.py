"""Content-selected anchors: which documents share passages, found without comparing them.

In each window of consecutive words the k-word gram of the smallest hash is its
anchor.  Equal windows choose the same anchor at the same place, so documents that
share a window share an anchor; only a few in a hundred positions are anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.membership import likely
from quillstone.llm.skew import joined_by_key
from quillstone.llm.staging import digest, stage
from quillstone.llm.words import minimisers, short, span_hashes, utf8, word_spans


def ragged(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list column: ``values`` whose ``rows`` ascend, dealt to n rows."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def anchored(docs: DataFrame, k: int, window: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged, per row: doc_id, digest, n_words, kept_sha256 (of all words, joined by one blank), anchors (distinct hashes)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 2):
            n = batch.num_rows
            data, offsets = utf8(batch.column(2))
            starts, ends, rows = word_spans(data, offsets)
            _, chosen, grams = minimisers(span_hashes(data, starts, ends), rows, k, window)
            at = np.unique(chosen)
            pairs = np.unique(np.stack([rows[at].astype(np.uint64), grams[at]]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
            raw = data.tobytes()
            sha = [hashlib.sha256(b" ".join(raw[i:j].translate(_BLANKS).split())).hexdigest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.bincount(rows, minlength=n), pa.int64()), pa.array(sha), ragged(pairs[1].view(np.int64), pairs[0].astype(np.int64), n, pa.int64())],
                names=["doc_id", "digest", "n_words", "kept_sha256", "anchors"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), digest(text).alias("digest"), F.col(text).alias("text"))
    return stage(rows.mapInArrow(scan, "doc_id long, digest binary, n_words long, kept_sha256 string, anchors array<long>"), "anchors")


#: ASCII white space as blanks; bytes.split() alone would know the same set, this states it.
_BLANKS = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))


def representatives(rows: DataFrame) -> DataFrame:
    """Staged, one row per distinct text with a doc_id: node (a number of the text), digest, first_id (its smallest doc_id), n_rows, n_words, anchors.

    A text that many rows hold is one row from here on.  Two texts under one doc_id
    are two nodes; doc_ids only decide which of two texts is the earlier one.
    """
    texts = (
        rows.where(F.col("doc_id").isNotNull() & (F.size("anchors") > 0))
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"), F.first("n_words").alias("n_words"), F.first("anchors").alias("anchors"))
    )
    return stage(texts.withColumn("node", F.monotonically_increasing_id()), "texts")  # the number that is written stays


def sharing(texts: DataFrame) -> DataFrame:
    """Staged, the texts that share an anchor with one of another doc_id: node, digest, first_id, shared (those anchors)."""
    each = texts.select("node", F.explode("anchors").alias("anchor"))
    common = texts.select("first_id", F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.min("first_id").alias("low"), F.max("first_id").alias("high"), F.count(F.lit(1)).alias("n"))
    common = stage(common.where("low < high").select("anchor", "n"), "common")
    lists = joined_by_key(each, common, "anchor", "n").groupBy("node").agg(F.collect_list("anchor").alias("shared"))
    return stage(texts.select("node", "digest", "first_id").join(lists, "node"), "sharing")


def with_texts(docs: DataFrame, wanted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``wanted`` (digest, first_id, more) with the texts themselves, one row for each row of its document.

    Documents that can't be wanted are left out before the shuffle.  The join is by text
    and document at once, so copies of one text do not meet; the wanted rows are the
    side held in memory, and the texts stream past.
    """
    found = docs.select(F.col(key).cast("long").alias("first_id"), digest(text).alias("digest"), F.col(text).alias("text"))
    names = [F.col("digest"), F.col("first_id")]
    return likely(found, names, wanted, names).join(wanted.hint("shuffle_hash"), ["digest", "first_id"])
