"""A join whose hot keys are sent to all tasks, so that none of them is one task's work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if more than one in HOT of the rows hold it; there are fewer than HOT such keys, however many rows.
HOT = 1000
#: So few rows of a key are no task's burden: no key is hot that no more than these hold, and small joins need no broadcasts.
FEW = 256


def joined_by_key(rows: DataFrame, keyed: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (``how``: inner or left) to ``keyed``, which has each key once and, in ``n``, how many of the rows hold it.

    ``keyed`` should be a written table: it is read for the hot keys, of which there
    are fewer than HOT and which are broadcast, and for the others, which are shuffled.
    """
    told = keyed.agg(F.sum(n).alias("total"), F.min(n).alias("least"), F.max(n).alias("most")).first()
    if not told.total or told.most <= max(FEW, told.total / HOT):
        return rows.join(keyed.drop(n), key, how)
    if told.least * HOT > told.total:  # all keys are hot, and so there are fewer than HOT
        return rows.join(F.broadcast(keyed.drop(n)), key, how)
    is_hot = (F.col(n) * HOT > F.lit(told.total)) & (F.col(n) > FEW)
    hot, few = keyed.where(is_hot).select(key), keyed.where(is_hot).drop(n)
    others = rows.join(F.broadcast(hot), key, "left_anti").join(keyed.where(~is_hot).drop(n), key, how)
    return rows.join(F.broadcast(few), key).unionByName(others)
