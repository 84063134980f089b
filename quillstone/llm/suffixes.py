"""Substring duplicates by a sparse suffix array over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.anchors import anchored, representatives, sharing, with_texts
from quillstone.llm.numbering import partitions
from quillstone.llm.skew import joined_by_key
from quillstone.llm.staging import discard, stage
from quillstone.llm.words import gram_hashes, minimisers, mix, short, span_hashes, utf8, word_spans

#: Shortest repeat, in words.
REPEAT = 50
#: Any SELECT consecutive words hold a retained suffix, which starts with a gram of ANCHOR words.
ANCHOR, SELECT = 10, 25
#: A repeat's first retained suffix starts within LEFT words of its start, so PREFIX words or more follow in it.
LEFT = SELECT - ANCHOR
PREFIX = REPEAT - LEFT


def suffix_rows(sharers: DataFrame) -> DataFrame:
    """The retained suffixes: doc_id, digest, at (their first word), right, back, windows.

    ``right`` is the suffix: its first REPEAT words, as 32-bit hashes, big-endian, so that
    byte order is suffix order.  ``back`` is how far the suffix can be extended to the
    left, LEFT words at most; ``windows`` are the 64-bit hashes, of full word hashes, of
    the REPEAT words that start so many words left of the suffix, then one less, and so
    on as far as the text reaches.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 2):
            data, offsets = utf8(batch.column(2))
            starts, ends, rows = word_spans(data, offsets)
            hashes = span_hashes(data, starts, ends)
            _, chosen, grams = minimisers(hashes, rows, ANCHOR, SELECT)
            at = np.unique(chosen)
            shared = batch.column(3)
            salt = np.uint64(0xA24BAED4963EE407)
            known = shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            known_rows = np.repeat(np.arange(len(shared)), np.diff(shared.offsets.to_numpy())).astype(np.uint64)
            at = at[np.isin(mix(grams[at] + rows[at].astype(np.uint64) * salt), mix(known + known_rows * salt))] if len(at) else at
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            low, high = bounds[rows[at]], bounds[rows[at] + 1]
            most, least = np.minimum(at - low, LEFT), np.maximum(REPEAT - (high - at), 0)
            keep = most >= least
            at, low, high, most, least = (x[keep] for x in (at, low, high, most, least))
            ahead = (hashes >> np.uint64(32)).astype(">u4").tobytes()
            spans = gram_hashes(hashes, REPEAT).tobytes()
            right = [ahead[4 * i : 4 * min(i + REPEAT, h)] for i, h in zip(at.tolist(), high.tolist(), strict=True)]
            windows = [spans[8 * i : 8 * j] for i, j in zip((at - most).tolist(), (at - least + 1).tolist(), strict=True)]
            of = pa.array(rows[at], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(at - low, pa.int64()), pa.array(right, pa.binary()), pa.array(most, pa.int32()), pa.array(windows, pa.binary())],
                names=["doc_id", "digest", "at", "right", "back", "windows"],
            )

    schema = "doc_id long, digest binary, at long, right binary, back int, windows binary"
    return sharers.select(F.col("first_id").alias("doc_id"), "digest", "text", "shared").mapInArrow(emit, schema)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes as rows of REPEAT numbers, and their lengths."""
    raw = column.to_pylist()
    lengths = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
    out = np.zeros((len(raw), REPEAT), np.uint32)
    out[np.arange(REPEAT) < lengths[:, None]] = np.frombuffer(b"".join(raw), ">u4")
    return out, lengths


def common_prefixes(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many first words each suffix has in common with the next one."""
    same = words[1:] == words[:-1]
    first = np.where(same.all(axis=1), REPEAT, same.argmin(axis=1))
    return np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))


def shared_windows(contexts: DataFrame) -> DataFrame:
    """(context, low, high, back, window): the extended windows of each suffix that may occur elsewhere.

    ``contexts``: context, right, back, windows, low, high (smallest and largest
    document).  The suffixes are sorted, and each is compared with its two neighbours:
    with no other suffix can it have more first words in common.  A window that starts
    ``back`` words left of a suffix can be held by others only if REPEAT - ``back`` words
    of the suffix are.  Suffixes at the edge of a partition have a neighbour that is not
    seen, so all their windows are kept.  Equal suffixes are dealt to partitions by what
    surrounds them, so a passage that very many documents hold is no single task's work.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept(rows: pa.RecordBatch, common: np.ndarray) -> pa.RecordBatch:
            context, low, high, back = (rows.column(i).to_numpy() for i in (0, 1, 2, 4))
            windows = rows.column(5).to_pylist()
            common = np.where(low < high, REPEAT, common)
            n = np.minimum(np.fromiter(map(len, windows), np.int64, len(windows)) // 8, np.maximum(back - (REPEAT - common) + 1, 0))
            of = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            found = np.frombuffer(b"".join(w[: 8 * k] for w, k in zip(windows, n.tolist(), strict=True)), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(context[of]), pa.array(low[of]), pa.array(high[of]), pa.array((back[of] - nth).astype(np.int32)), pa.array(found, pa.int64())], names=["context", "low", "high", "back", "window"])

        # the last row of a batch waits for its other neighbour
        waiting, before = None, REPEAT
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if waiting is None else [waiting, batch]).combine_chunks()
            rows = table.to_batches()[0]
            common = common_prefixes(*words_of(rows.column(3)))
            if len(common):
                yield kept(rows.slice(0, len(common)), np.maximum(common, np.concatenate([[before], common[:-1]])))
                before = int(common[-1])
            waiting = rows.slice(len(common))
        if waiting is not None:
            yield kept(waiting, np.array([REPEAT]))

    ordered = contexts.repartitionByRange(partitions(contexts), "right", "context").sortWithinPartitions("right", "context")
    return ordered.select("context", "low", "high", "right", "back", "windows").mapInArrow(compare, "context long, low long, high long, back int, window long")


def kept_by(windows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(context, n, kept), staged, ``kept`` a list of (keeper, back, ahead): all documents of the context after ``keeper`` repeat a passage of it.

    The passage is ``back`` words left and ``ahead`` words right of the suffix's start;
    each window of it is held by document ``keeper``, the smallest that has it.
    ``sizes``: context, n (how many suffixes have it).
    """
    keepers = windows.groupBy("window").agg(F.min("low").alias("keeper"), F.max("high").alias("last"), F.count(F.lit(1)).alias("n")).where("keeper < last")
    keepers = stage(keepers.select("window", "keeper", "n"), "keepers")
    held = joined_by_key(windows.select("context", "high", "back", "window"), keepers, "window", "n").where("high > keeper")
    # the windows of a context all hold the words from the suffix's start on, so they make one span
    found = held.groupBy("context", "keeper").agg(F.max("back").cast("long").alias("back"), (REPEAT - F.min("back")).cast("long").alias("ahead"))
    lists = found.groupBy("context").agg(F.collect_list(F.struct("keeper", "back", "ahead")).alias("kept"))  # no more than a context has windows
    return stage(sizes.join(lists, "context").select("context", "n", "kept"), "matches")


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans (doc_id, digest, start, stop, keeper) of a text as one, with the smallest keeper."""
    of_text = Window.partitionBy("doc_id", "digest").orderBy("start", "stop")
    fresh = F.coalesce(F.col("start") > F.max("stop").over(of_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    grouped = spans.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(of_text.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("doc_id", "digest", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("keeper").alias("keeper")).drop("span")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages of REPEAT words or more that a document shares with one of a smaller id.

    One row per passage: doc_id, start_word, end_word (exclusive), n_words,
    keeper_doc_id (the smallest document found to hold a part of it), text_md5 (which
    of the texts of the doc_id it is in, if there are several).  The keeper has no row
    for the passage, so removing all rows' words leaves one copy.

    Suffixes are retained at minimiser positions only, sorted, compared with their
    neighbours and extended to the left; of the equal windows of REPEAT words that this
    gives, each is kept by the smallest document that has it.  A copy of a whole text
    is one passage.  Windows are told apart by 64-bit hashes.

    Defined cases: a null text has no passages; a very long text is searched as a whole;
    a null doc_id is neither smaller nor larger than any; rows of one doc_id do not
    repeat each other, whatever their texts; repeated rows give one row per passage; an
    empty table gives an empty result; other columns are ignored.
    """
    rows = anchored(docs, ANCHOR, SELECT, key, text)
    texts = representatives(rows)
    sharers = stage(with_texts(docs, sharing(texts), key, text), "sharers")
    suffixes = stage(suffix_rows(sharers).withColumn("context", F.xxhash64("right", "back", "windows")), "suffixes")
    contexts = stage(suffixes.groupBy("context", "right", "back", "windows").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")), "contexts")
    windows = stage(shared_windows(contexts), "windows")
    matches = kept_by(windows, contexts.groupBy("context").agg(F.sum("n").alias("n")))
    # a passage that very many documents hold with equal surroundings is one context
    found = joined_by_key(suffixes.select("context", "doc_id", "digest", "at"), matches, "context", "n").select("doc_id", "digest", "at", F.inline("kept")).where("doc_id > keeper")
    inner = found.select("doc_id", "digest", (F.col("at") - F.col("back")).alias("start"), (F.col("at") + F.col("ahead")).alias("stop"), "keeper")
    pieces = stage(merged(inner), "pieces")
    firsts = stage(texts.where((F.col("n_words") >= REPEAT) & (F.col("n_rows") > 1)).select("digest", "first_id", "n_rows"), "firsts")
    whole = joined_by_key(rows.where(F.col("n_words") >= REPEAT), firsts, "digest", "n_rows").where("doc_id > first_id")
    copies = whole.select("doc_id", "digest", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop"), F.col("first_id").alias("keeper")).distinct()
    discard(sharers, suffixes, contexts, windows, matches)
    out = pieces.unionByName(copies)
    return out.select(
        "doc_id", F.col("start").alias("start_word"), F.col("stop").alias("end_word"), (F.col("stop") - F.col("start")).alias("n_words"), F.col("keeper").alias("keeper_doc_id"), F.lower(F.hex("digest")).alias("text_md5")
    )
