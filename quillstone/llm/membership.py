"""Tables of fixed size that all tasks fill and the driver adds up, and a bitmap among them that spares shuffles."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.numbering import partitions

#: Bits of the bitmap (4 MB) and of the piece of it that one row carries.
BITS, PIECE = 1 << 25, 1 << 19
PIECES = "piece long, data binary"


def pieces_of(table: np.ndarray, first: int = 0) -> pa.RecordBatch:
    """The rows of a table that are not all zero, packed, as (piece, data)."""
    live = np.flatnonzero(table.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(live + first, pa.int64()), pa.array([zlib.compress(table[i].tobytes(), 1) for i in live], pa.binary())], names=["piece", "data"])


def folded(rows: DataFrame, kind: str, both: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """The pieces that tasks sent, those of one number combined by ``both``, on the driver.

    ``rows``: piece, data.  There are as many numbers as the table has pieces, however
    many tasks there were; a number's pieces stream through one task, which holds two.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(zlib.decompress(data), kind)
                if piece == last:
                    total = both(total, found)
                    continue
                if last is not None:
                    yield pa.RecordBatch.from_pydict({"piece": [last], "data": [zlib.compress(total.tobytes(), 1)]})
                last, total = piece, found
        if last is not None:
            yield pa.RecordBatch.from_pydict({"piece": [last], "data": [zlib.compress(total.tobytes(), 1)]})

    dealt = rows.repartition(partitions(rows), "piece").sortWithinPartitions("piece")
    return {r.piece: np.frombuffer(zlib.decompress(bytes(r.data)), kind) for r in dealt.mapInArrow(fold, PIECES).collect()}


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The bits of all 64-bit hashes in the only column, packed."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[(batch.column(0).to_numpy().view(np.uint64) % np.uint64(BITS)).astype(np.int64)] = True
        yield pieces_of(np.packbits(bits).reshape(-1, PIECE // 8))

    out = np.zeros((BITS // PIECE, PIECE // 8), np.uint8)
    for piece, bits in folded(hashes.mapInArrow(mark, PIECES), "u1", np.bitwise_or).items():
        out[piece] = bits
    return out.ravel()


def likely(df: DataFrame, keys: list[Column], wanted: DataFrame, wanted_keys: list[Column]) -> DataFrame:
    """The rows of ``df`` whose keys may be among those of ``wanted``: all that are, and few others.

    Only the keys' hashes go to Python.  The bitmap's size does not grow with the
    data; where it fills up, more rows pass, and the join that follows decides.
    """
    held = df.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64(*wanted_keys).alias("h"))))

    @F.pandas_udf("boolean")
    def may_match(h: pd.Series) -> pd.Series:
        at = h.to_numpy().view(np.uint64) % np.uint64(BITS)
        byte, bit = (at >> np.uint64(3)).astype(np.int64), (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)
        return pd.Series((held.value[byte] >> bit & 1).astype(bool))

    return df.where(may_match(F.xxhash64(*keys)))
