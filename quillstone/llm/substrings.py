"""Substring dedup by automata of recurring passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.anchors import anchored, representatives, sharing, with_texts
from quillstone.llm.numbering import partitions
from quillstone.llm.skew import joined_by_key
from quillstone.llm.staging import discard, stage
from quillstone.llm.words import gram_hashes, minimisers, mix, short, span_hashes, utf8, word_spans

WINDOW = 50
ANCHOR = 10
#: Words of an automaton's pattern: any WINDOW consecutive words hold a whole aligned block of so many.
BLOCK = WINDOW // 2
#: Owners (documents whose passages are looked for) of one automaton, and documents that one task streams through it.
SHARD_OWNERS, SHARD_DOCS = 16, 500
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _shared_windows(data: np.ndarray, offsets: np.ndarray, shared: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Starts and rows of the windows whose anchor is in the row's ``shared`` list; hashes of all words; word spans."""
    starts, ends, rows = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    first, chosen, grams = minimisers(hashes, rows, ANCHOR, WINDOW)
    of = rows[first]
    known = shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    known_rows = np.repeat(np.arange(len(shared)), np.diff(shared.offsets.to_numpy()))
    row_salt = np.uint64(0xA24BAED4963EE407)  # (row, anchor) as one number; a clash would only add a window to be judged
    live = np.isin(mix(grams[chosen] + of.astype(np.uint64) * row_salt), mix(known + known_rows.astype(np.uint64) * row_salt))
    return first[live], of[live], hashes, (starts, ends, rows)


def window_rows(sharers: DataFrame) -> DataFrame:
    """(window, node, doc_id) for each window of the sharing texts around a shared anchor."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 2):
            data, offsets = utf8(batch.column(2))
            first, of, hashes, _ = _shared_windows(data, offsets, batch.column(3))
            window = gram_hashes(hashes, WINDOW)[first].view(np.int64) if len(first) else np.zeros(0, np.int64)
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(window), batch.column(0).take(of), batch.column(1).take(of)], names=["window", "node", "doc_id"])

    return sharers.select("node", F.col("first_id").alias("doc_id"), "text", "shared").mapInArrow(emit, "window long, node long, doc_id long")


def links_between(windows: DataFrame) -> DataFrame:
    """(node, owner), staged: the texts that hold a window of another document, and the window's owner.

    The owner of a window is the text of the smallest doc_id that holds it (of two under
    one doc_id, that of the smaller number).
    """
    holders = windows.groupBy("window").agg(F.min(F.struct("doc_id", "node")).alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first.doc_id < last")
    owners = stage(holders.select("window", F.col("first.node").alias("owner"), F.col("first.doc_id").alias("owner_id"), "n"), "owners")
    links = stage(joined_by_key(windows, owners, "window", "n").where("doc_id > owner_id").select("node", "owner").distinct(), "links")
    discard(owners)
    return links


class Automaton:
    """All blocks of the recurring passages of some owners, in one Aho-Corasick automaton.

    ``cover`` marks the words of a document that lie in a run of WINDOW or more
    consecutive words which an owner with a smaller id holds as well.
    """

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.vocabulary: dict[bytes, int] = {}
        self.owners: dict[int, tuple[int, np.ndarray]] = {}
        self.made = False

    def add(self, owner: int, doc: int, words: list[bytes], windows: np.ndarray) -> None:
        """``owner``: the text's number; ``windows``: ascending starts of its recurring windows."""
        if owner in self.owners:
            return
        ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words), np.int64, len(words))
        self.owners[owner] = (doc, ids)
        runs = np.split(windows, np.flatnonzero(np.diff(windows) > 1) + 1) if len(windows) else []
        for run in runs:
            for at in range(int(run[0]), int(run[-1]) + WINDOW - BLOCK + 1, BLOCK):
                pattern = "".join(f" {w.decode('utf-8', 'surrogateescape')}" for w in words[at : at + BLOCK]) + " "
                if pattern in self.automaton:
                    self.automaton.get(pattern).append((owner, at))
                else:
                    self.automaton.add_word(pattern, [(owner, at)])

    def cover(self, doc: int, words: list[bytes]) -> list[tuple[int, int]]:
        if not len(self.automaton):
            return []
        if not self.made:
            self.automaton.make_automaton()
            self.made = True
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        texts = [w.decode("utf-8", "surrogateescape") for w in words]
        stops = np.cumsum([len(w) + 1 for w in texts])  # places of the blanks after each word, the first blank being 0
        covered = np.zeros(len(words) + 1, np.int64)
        reached: dict[tuple[int, int], int] = {}
        done = np.zeros(len(words), bool)
        for stop, places in self.automaton.iter(" " + " ".join(texts) + " "):
            at = int(np.searchsorted(stops, stop)) - BLOCK + 1
            low, high = max(0, at - (WINDOW - BLOCK)), min(len(words), at + WINDOW)
            if done[low:high].all():
                continue
            for owner, owner_at in places:
                owner_id, own = self.owners[owner]
                if owner_id >= doc or reached.get((owner, at - owner_at), -1) >= at + BLOCK:
                    continue
                n = min(at, owner_at)
                differ = np.flatnonzero(ids[at - n : at][::-1] != own[owner_at - n : owner_at][::-1])
                left = int(differ[0]) if len(differ) else n
                m = min(len(ids) - at, len(own) - owner_at)
                differ = np.flatnonzero(ids[at : at + m] != own[owner_at : owner_at + m])
                right = int(differ[0]) if len(differ) else m
                reached[owner, at - owner_at] = at + right
                if left + right >= WINDOW:
                    covered[at - left] += 1
                    covered[at + right] -= 1
                    done[at - left : at + right] = True
        marks = np.cumsum(covered[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def spans_found(sharers: DataFrame, links: DataFrame) -> DataFrame:
    """(node, spans) of every occurrence of an owner's passages in the texts linked to it.

    Owners are dealt to shards, an automaton is compiled for each shard, and the
    shard's documents stream through it.  A shard with many documents is spread over
    several tasks, each with the owners' texts at hand.
    """
    n_owners = links.select("owner").distinct().count()
    shards = max(1, -(-n_owners // SHARD_OWNERS))
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards))
    routes = links.select(shard.alias("shard"), "node").distinct()
    loads = stage(routes.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", "n", F.ceil(F.col("n") / SHARD_DOCS).cast("int").alias("salts")), "loads")
    of_docs = joined_by_key(routes, loads, "shard", "n").select("shard", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node", F.lit(1).alias("kind"))
    owners = links.select("owner", shard.alias("shard")).distinct().join(loads, "shard")
    of_owners = owners.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("owner").alias("node"), F.lit(0).alias("kind"))
    wanted = stage(of_docs.unionByName(of_owners), "routes")
    rows = sharers.select("node", "first_id", "text", "shared").join(wanted, "node")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, automaton = None, None
        for batch in short(batches, 5):
            data, offsets = utf8(batch.column(5))
            first, of, _, (starts, ends, word_rows) = _shared_windows(data, offsets, batch.column(6))
            bounds, window_bounds = np.searchsorted(word_rows, np.arange(batch.num_rows + 1)), np.searchsorted(of, np.arange(batch.num_rows + 1))
            raw = data.tobytes()
            meta = [batch.column(i).to_pylist() for i in range(5)]
            out: list[tuple[int, list]] = []
            for i, (part, salt, kind, node, doc) in enumerate(zip(*meta, strict=True)):
                a, b = bounds[i], bounds[i + 1]
                words = [raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                if (part, salt) != current:
                    current, automaton = (part, salt), Automaton()
                if kind == 0:
                    automaton.add(node, doc, words, first[window_bounds[i] : window_bounds[i + 1]] - a)
                elif spans := automaton.cover(doc, words):
                    out.append((node, [x for span in spans for x in span]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["node", "spans"])

    dealt = rows.repartition(partitions(sharers), "shard", "salt").sortWithinPartitions("shard", "salt", "kind", "node")
    return dealt.select("shard", "salt", "kind", "node", "first_id", "text", "shared").mapInArrow(locate, "node long, spans array<long>")


def without_spans(sharers: DataFrame, spans: DataFrame) -> DataFrame:
    """(digest, n_removed, kept_sha256, kept_text) of the texts that lose words."""
    merged = spans.groupBy("node").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 1):
            out = []
            for key, text, spans_ in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                words = text.encode().translate(_BLANKS).split()
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, spans_[::2], 1)
                np.add.at(gone, spans_[1::2], -1)
                keep = np.cumsum(gone[:-1]) == 0
                kept = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)
                out.append((key, int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["digest", "n_removed", "kept_sha256", "kept_text"])

    rows = sharers.join(merged, "node").select("digest", "text", "spans")
    return rows.mapInArrow(cut, "digest binary, n_removed long, kept_sha256 string, kept_text string")


_BLANKS = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each word in a window of 50 words whose word sequence also starts in a document of a smaller id.

    1. Each text is scanned for anchors; copies of one text are handled as one.
    2. Texts that share an anchor are fetched, and the windows around those anchors
       are hashed.  A window in two documents is confirmed as recurring; its owner is
       the smallest document that holds it, and its other documents are linked to it.
    3. Owners' passages are compiled into sharded automata; every linked document
       streams through, and hits are extended word by word to the whole common run.

    Per row: doc_id, n_words, n_removed, kept_sha256; with ``with_text`` also
    kept_text (null where the whole text stays).  Windows are judged on the input.
    Defined cases: a null text has no words; a very long text is searched as a whole; a
    null doc_id is neither smaller nor larger than any, so its text stays; rows of one
    doc_id don't remove each other's words, whatever their texts; repeated rows are
    treated alike; an empty table gives an empty result; other columns are ignored.
    """
    rows = anchored(docs, ANCHOR, WINDOW, key, text)
    texts = representatives(rows)
    sharers = stage(with_texts(docs, sharing(texts), key, text), "sharers")
    links = links_between(window_rows(sharers))
    spans = stage(spans_found(sharers, links), "spans")
    cut = without_spans(sharers, spans).select("digest", "n_removed", F.col("kept_sha256").alias("cut_sha256"), *([F.col("kept_text")] if with_text else []))
    cut = stage(cut.dropDuplicates(["digest"]), "cut")

    # what is to be said of a text, once; texts without anchors stay whole
    told = texts.select("digest", "first_id", "n_rows").join(cut, "digest", "left").where((F.col("n_rows") > 1) | F.col("n_removed").isNotNull())
    told = stage(told.withColumn("digest", F.coalesce("digest", F.lit(b""))), "told")
    rows = rows.withColumn("digest", F.coalesce("digest", F.lit(b"")))
    found = joined_by_key(rows, told, "digest", "n_rows", "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW), F.lit(False))
    shorter = F.col("n_removed").isNotNull() & F.col("doc_id").isNotNull()
    out = [
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(shorter, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA256)).when(shorter, F.col("cut_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    if with_text:
        out.append(F.when(copy, F.lit("")).when(shorter, F.col("kept_text")).alias("kept_text"))
    result = found.select(*out)
    discard(sharers, links, spans)
    return result
