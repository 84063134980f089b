"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many sources, the table of rates is sent to all tasks (under 10 MB); beyond, it is joined by key.
BROADCAST_SOURCES = 50_000
#: exp(-rate) must stay a normal number; a larger mean is the sum of independent parts.
PART_RATE = 500.0


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the seed and the parts."""
    told = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson(u: Column, rate: Column) -> Column:
    """The Poisson quantile: the smallest k whose distribution function exceeds ``u``.

    The fold adds up the probabilities; it has as many steps as a rate of that
    size can need for a ``u`` of 52 bits.
    """
    steps = F.sequence(F.lit(1), (rate + 12 * F.sqrt(rate) + 40).cast("int"))
    start = F.struct(u.alias("u"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(at: Column, k: Column) -> Column:
        p = at["p"] * rate / k
        further = at["u"] >= at["cdf"]
        return F.struct(at["u"].alias("u"), p.alias("p"), F.when(further, at["cdf"] + p).otherwise(at["cdf"]).alias("cdf"), F.when(further, k).otherwise(at["k"]).alias("k"))

    return F.aggregate(steps, start, step, lambda at: at["k"])


def poisson_sum(seed: int, rate: Column, *parts: Column) -> Column:
    """A Poisson count of any mean, as a sum of independent counts of means up to PART_RATE."""
    n = F.greatest(F.ceil(rate / PART_RATE), F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, j: total + poisson(uniform(seed, *parts, j), rate / n))


def source_rates(sources: DataFrame, weights: dict[str, float], default_weight: float, size: float) -> DataFrame:
    """One row per source: its documents, target share and mean repetition rate.

    ``sources`` has one column, ``source``.  Shares are the weights over their sum for
    the sources that the table has; the rate is share * (size * all documents) /
    documents of the source.
    """
    named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
    counts = sources.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    counts = counts.withColumn("weight", F.coalesce(named[F.coalesce("source", F.lit(""))], F.lit(float(default_weight))))
    totals = counts.agg(F.sum("weight").alias("all_weight"), F.sum("docs").alias("all_docs"))
    share = F.col("weight") / F.col("all_weight")
    return counts.crossJoin(F.broadcast(totals)).select(  # totals is one row
        "source", "docs", share.alias("share"), (share * F.col("all_docs") * size / F.col("docs")).alias("rate")
    )


def replicated(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = 1.0,
    size: float = 1.0,
    seed: int = 7,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``mixed`` with each input row in one column, ``row``, so that no names can clash: row, rate, n_copies, copy, shuffle_key."""
    rates = source_rates(docs.select(F.col(source).alias("source")), weights or {}, default_weight, size)
    rates = rates.select("rate", F.col("source").alias("of_source"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), F.col(key).alias("key"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_md5"))
    counted = rows.join(rates, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("n_copies", poisson_sum(seed, F.col("rate"), F.col("key"), F.col("text_md5"))).where("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    dealt = copies.select("row", "rate", "n_copies", "copy", uniform(seed + 1, F.col("key"), F.col("copy"), F.col("text_md5")).alias("shuffle_key"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, size: float = 1.0, seed: int = 7, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Replicate each document by a hash-seeded Poisson count and shuffle globally.

    The mean of the count is the target repetition rate of the document's source,
    so the expected shares of the sources are the target weights, and the expected
    size is ``size`` times the input.  The count is the Poisson quantile at a hash
    of seed, key and text: it does not depend on order, partitions or other rows
    of the source.  Copies are dealt by a hash of seed, key and copy number, and
    sorted by it within each partition.

    Adds ``rate``, ``n_copies``, ``copy`` (from 0) and ``shuffle_key``; columns of
    these names in the input are replaced, all others are kept as they are.  Defined
    cases: a null source is a source of its own with the default weight; null key or
    text counts as empty in the hash; a very long text is a row like any other, and is
    only hashed; repeated rows share their count; an empty table gives an empty result.
    """
    added = ["rate", "n_copies", "copy", "shuffle_key"]
    out = replicated(docs, weights, default_weight, size, seed, source, key, text)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added], *added)
