"""Passages: paragraphs, sentences, greedy packing with overlap.

Sentences end where Unicode's rules say so (``functions.sentence_breaks``), but not after
listed abbreviations.  A document stays in its row from text to passages, so nothing is
shuffled.  The packing carries state from unit
to unit, so it is a fold over arrays of lengths, in one function over Arrow batches;
texts stay with Spark and are joined after it, by position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.columns import ABBREVIATIONS, CHARS_PER_TOKEN, WS, collapsed, token_estimate
from quillstone.functions.sentence_breaks import SENTENCE_END

MARK = "\x1e"
MAX_CHUNKS = 1000


@dataclass(frozen=True)
class ChunkOptions:
    """Sizes in tokens of four characters."""

    target: int = 600
    max: int = 800
    overlap: int = 80
    min: int = 150

    def __post_init__(self):
        if not self.min <= self.target <= self.max or self.overlap >= self.target:
            raise ValueError("need min <= target <= max and overlap < target")

    def chars(self) -> tuple[int, int, int, int]:
        return self.target * CHARS_PER_TOKEN, self.max * CHARS_PER_TOKEN, self.overlap * CHARS_PER_TOKEN, self.min * CHARS_PER_TOKEN


def paragraphs(docs: DataFrame, document: str = "document_id", text: str = "text") -> DataFrame:
    """(document, paragraph_no, paragraph): split at blank lines; inner white space is one blank; empty ones go."""
    rows = docs.select(document, F.posexplode(F.split(F.col(text), rf"\n[{WS}]*\n")).alias("paragraph_no", "raw"))
    return rows.select(document, "paragraph_no", collapsed("raw").alias("paragraph")).where("paragraph <> ''")


def sentences(rows: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, paragraph_no, sentence_no, sentence).

    A sentence ends after a stop of any script, with its closing quotes or brackets and
    blanks.  A stop before another stop, a comma, a colon or a dash ends none, nor does a
    full stop inside a number or before a lower-case letter, with a letter on both
    sides, or after a listed abbreviation: what follows that is joined by a blank.
    """
    each = rows.select(document, "paragraph_no", F.posexplode(sentence_array(F.col("paragraph"))).alias("sentence_no", "sentence"))
    return each.withColumn("sentence_no", F.col("sentence_no").cast("long"))


def sentence_array(paragraph: Column) -> Column:
    """The sentences of a paragraph with collapsed white space: cut at marks that are put where sentences end."""
    marked = F.regexp_replace(paragraph, SENTENCE_END, f"$1$2$3{MARK}")
    # the mark comes first, so that what is before it is looked at there alone
    glued = F.regexp_replace(marked, rf"{MARK}(?<=\.{MARK})(?<=(?:^|[{WS}({MARK}])(?:{ABBREVIATIONS})\.{MARK})(?!\z)", " ")
    return F.filter(F.split(glued, MARK), lambda x: x != "")


def split_on_words(sentence: Column, size: int) -> Column:
    """An over-long sentence as pieces of at most ``size`` characters, cut between words.

    A word longer than a piece is cut by characters; ``continues`` marks pieces that
    start inside a word.
    """

    def cut(word: Column) -> Column:
        n = F.greatest(F.ceil(F.length(word) / size), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.substring(word, i * size + 1, F.lit(size)).alias("text"), (n > 1).alias("giant"), (i == 0).alias("first"), (i == n - 1).alias("last")))

    parts = F.flatten(F.transform(F.split(sentence, " "), cut))
    pieces = F.expr("cast(array() as array<struct<text: string, continues: boolean>>)")
    start = F.struct(pieces.alias("done"), F.lit("").alias("text"), F.lit(False).alias("continues"))

    def state(done: Column, text: Column, continues: Column) -> Column:
        return F.struct(done.alias("done"), text.alias("text"), continues.alias("continues"))

    def closed(at: Column) -> Column:
        return F.when(at["text"] == "", at["done"]).otherwise(F.concat(at["done"], F.array(F.struct(at["text"].alias("text"), at["continues"].alias("continues")))))

    def step(at: Column, p: Column) -> Column:
        so_far = F.when(p["first"], closed(at)).otherwise(at["done"])
        whole = state(F.concat(so_far, F.array(F.struct(p["text"].alias("text"), (~p["first"]).alias("continues")))), F.lit(""), F.lit(False))
        rest = state(so_far, p["text"], F.lit(True))
        full = (at["text"] != "") & (F.length(at["text"]) + 1 + F.length(p["text"]) > size)
        fresh = state(closed(at), p["text"], F.lit(False))
        longer = state(at["done"], F.when(at["text"] == "", p["text"]).otherwise(F.concat(at["text"], F.lit(" "), p["text"])), at["continues"])
        return F.when(p["giant"] & ~p["last"], whole).when(p["giant"], rest).when(full, fresh).otherwise(longer)

    return F.aggregate(parts, start, step, closed)


UNIT = "array<struct<text: string, gap: int>>"
#: Separators before a unit: inside a word, between sentences, between paragraphs.
INSIDE, SENTENCE, PARAGRAPH = 0, 1, 2


def unit_array(text: Column, options: ChunkOptions) -> Column:
    """The units of a text, sentences or pieces of over-long ones, with the gap before each; an empty array without text."""
    target, longest, _, _ = options.chars()
    parts = F.filter(F.transform(F.split(text, rf"\n[{WS}]*\n"), collapsed), lambda p: p != "")
    unit = lambda x, gap: F.struct(x.alias("text"), gap.cast("int").alias("gap"))

    def of_sentence(s: Column, i: Column) -> Column:
        first = F.when(i == 0, PARAGRAPH).otherwise(SENTENCE)
        pieces = F.transform(split_on_words(s, target), lambda p, j: unit(p["text"], F.when(j == 0, first).when(p["continues"], INSIDE).otherwise(SENTENCE)))
        return F.when(F.length(s) > longest, pieces).otherwise(F.array(unit(s, first)))

    units_ = F.transform(parts, lambda p: F.flatten(F.transform(sentence_array(p), of_sentence)))
    return F.coalesce(F.flatten(units_), F.array().cast(UNIT))


def units(docs: DataFrame, options: ChunkOptions = ChunkOptions(), document: str = "document_id", text: str = "text") -> DataFrame:
    """(document, unit_no, unit, starts_paragraph, continues_word): sentences, or pieces of over-long ones."""
    rows = docs.select(document, F.posexplode(unit_array(F.col(text), options)).alias("unit_no", "u"))
    return rows.select(document, F.col("unit_no").cast("long").alias("unit_no"), F.col("u.text").alias("unit"), (F.col("u.gap") == PARAGRAPH).alias("starts_paragraph"), (F.col("u.gap") == INSIDE).alias("continues_word"))


def packed(lengths: np.ndarray, gaps: np.ndarray, options: ChunkOptions) -> list[tuple[int, int, int]]:
    """The chunks of a document as (first unit, last unit, characters of overlap).

    A unit is added while the chunk stays within the target, or is too short and stays
    within the maximum.  The next chunk begins with whole trailing units as overlap,
    never with all of the chunk before; a short tail joins the last chunk if it fits.
    """
    target, longest, overlap, least = options.chars()
    if not len(lengths):
        return []
    n, ends, lengths = len(lengths), np.cumsum(lengths + gaps).tolist(), lengths.tolist()

    def size(s: int, e: int) -> int:
        """Characters of units s..e joined: the first one's separator does not count."""
        return ends[e] - ends[s] + lengths[s]

    def carried(s: int, k: int) -> int:
        """First unit of the overlap before unit k of a chunk that began at s; k if there is none."""
        first, i = k, k - 1
        while i >= s + 1 and i >= k - (overlap // 2 + 2) and (size(i, k - 1) <= overlap or (i == k - 1 and lengths[i] <= 2 * overlap)) and size(i, k) <= longest:
            first, i = i, i - 1
        return first

    out, s, new = [], 0, 0
    for k in range(1, n):
        then = size(s, k)
        if then > target and (then > longest or size(s, k - 1) >= least):
            out.append((s, k - 1, new))
            s, new = carried(s, k), k
    out.append((s, n - 1, new))
    if len(out) > 1 and size(new, n - 1) < least and size(out[-2][0], n - 1) <= longest:
        out[-2:] = [(out[-2][0], n - 1, out[-2][2])]
    return [(s, e, size(s, new - 1) if new > s else 0) for s, e, new in out]


def chunk_array(docs: DataFrame, options: ChunkOptions = ChunkOptions(), text: str = "text", out: str = "chunks") -> DataFrame:
    """``docs`` with the array ``out`` of each text's passages: content, overlap_chars."""

    @F.pandas_udf("array<struct<s: int, e: int, overlap: int>>")
    def pack(lengths: pd.Series, gaps: pd.Series) -> pd.Series:
        return pd.Series([[{"s": s, "e": e, "overlap": o} for s, e, o in packed(np.asarray(n, np.int64), np.asarray(g, np.int64), options)] for n, g in zip(lengths, gaps, strict=True)], dtype=object)

    rows = docs.withColumn("_u", unit_array(F.col(text), options))
    rows = rows.withColumn("_p", pack(F.transform("_u", lambda x: F.length(x["text"])), F.transform("_u", lambda x: x["gap"])))
    gap = lambda x, i: F.when((i == 0) | (x["gap"] == INSIDE), "").when(x["gap"] == PARAGRAPH, "\n\n").otherwise(" ")
    content = lambda c: F.array_join(F.transform(F.slice("_u", c["s"] + 1, c["e"] - c["s"] + 1), lambda x, i: F.concat(gap(x, i), x["text"])), "")
    return rows.withColumn(out, F.transform("_p", lambda c: F.struct(content(c).alias("content"), c["overlap"].alias("overlap_chars")))).drop("_u", "_p")


def chunks(docs: DataFrame, options: ChunkOptions = ChunkOptions(), document: str = "document_id", text: str = "text") -> DataFrame:
    """(document, chunk_index, content, token_estimate, overlap_chars) of each document's passages."""
    rows = chunk_array(docs.select(document, F.col(text).alias("_text")), options, "_text")
    # outer: a plain explode would be given a filter that makes the array once more
    rows = rows.select(document, F.posexplode_outer("chunks").alias("chunk_index", "c")).where("c IS NOT NULL")
    return rows.select(document, "chunk_index", "c.content", token_estimate("c.content").alias("token_estimate"), "c.overlap_chars")


def capped(chunks_: DataFrame, limit: int = MAX_CHUNKS, document: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(chunks of documents within the limit, failures): a document with more is too large as a whole."""
    counted = chunks_.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(document)))
    kept = counted.where(F.col("_n") <= limit).drop("_n")
    message = F.format_string(f"Document is too large to process: %d chunks (limit {limit})", "_n")
    return kept, counted.where(F.col("_n") > limit).select(document, message.alias("error_message")).distinct()
