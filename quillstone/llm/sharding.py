"""Reproducible shuffle into shards: a Feistel permutation over row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.numbering import numbered

ROUNDS = 4
#: Walks written out in the plan; rows still outside after them walk on in a fold.
OPEN_WALKS = 4
#: Each walk leaves a row outside with a chance below 1/2, so 200 never are used up.
FOLD_WALKS = 196
_LOW31 = (1 << 31) - 1


def _mixed(half: Column, key: int) -> Column:
    """A pseudo-random function of a half block of at most 31 bits: two multiply-and-shift steps in BIGINT.

    Each step names its argument once, which keeps the written-out plan short.
    """
    x = F.shiftright(half.bitwiseXOR(F.lit(key)) * F.lit(0x9E3779B1), 17).bitwiseAND(F.lit(_LOW31))
    return F.shiftright(x * F.lit(0xC2B2AE35), 21)


def round_keys(seed: int) -> list[int]:
    """31-bit keys of the rounds, from the seed by a linear congruence."""
    keys, state = [], seed & 0xFFFFFFFF
    for _ in range(ROUNDS):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        keys.append(state >> 1)
    return keys


def _encrypted(x: Column, bits: int, seed: int) -> Column:
    """One pass of the Feistel network, a permutation of 0 .. 2**bits - 1.

    The halves may differ by one bit; they change places in each round, and the
    even number of rounds brings the widths back.
    """
    wide, narrow = bits - bits // 2, bits // 2
    left, right, w_left, w_right = F.shiftright(x, wide), x.bitwiseAND(F.lit((1 << wide) - 1)), narrow, wide
    for key in round_keys(seed):
        left, right = right, left.bitwiseXOR(_mixed(right, key)).bitwiseAND(F.lit((1 << w_left) - 1))
        w_left, w_right = w_right, w_left
    return F.shiftleft(left, w_right) + right


def permuted(df: DataFrame, n: int, seed: int, row_no: str = "row_no", name: str = "position") -> DataFrame:
    """``df`` with ``name``, the place of ``row_no`` (0 .. n-1) in a permutation of 0 .. n-1.

    Cycle walking: a place at n or beyond is encrypted again until it is below n.
    The block has the fewest bits that hold n, so a walk ends with a chance of
    1/2 or more.
    """
    bits = max(2, (max(n, 1) - 1).bit_length())
    if bits > 62:
        raise ValueError("at most 2**62 rows")
    df = df.withColumn(name, _encrypted(F.col(row_no), bits, seed))
    for _ in range(OPEN_WALKS):
        df = df.withColumn(name, F.when(F.col(name) < n, F.col(name)).otherwise(_encrypted(F.col(name), bits, seed)))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(FOLD_WALKS)),
        F.col(name),
        lambda at, _: F.when(at < n, at).otherwise(_encrypted(at, bits, seed)),
    )
    df = df.withColumn(name, F.when(F.col(name) < n, F.col(name)).otherwise(walk))
    return df.withColumn(name, F.when(F.col(name) < n, F.col(name)).otherwise(F.raise_error(F.lit("cycle walk did not end"))))


def sharded(docs: DataFrame, shards: int = 8, seed: int = 20240229, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put all documents into ``shards`` shards whose row counts differ by one at most.

    Rows are numbered in the order of (key, crc32, size), the numbers are permuted,
    and shard and slot are the remainder and the quotient of the place by the
    number of shards: they can be computed for any row number without the data.

    Defined cases: a null text has size 1 and the crc32 of the empty text; null
    keys come first; repeated rows get neighbouring numbers and so separate places;
    an empty table gives an empty result; other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows = numbered(narrow, "doc_id", "text_crc32", "size", label="shard-rows")
    n = rows.count()
    at = permuted(rows, n, seed)
    return at.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("position") % shards).cast("int").alias("shard"),
        F.expr(f"position div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
        "position",
    )
