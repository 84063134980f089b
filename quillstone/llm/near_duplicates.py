"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.anchors import ragged
from quillstone.llm.components import components
from quillstone.llm.membership import PIECES, folded, likely, pieces_of
from quillstone.llm.neighbour_graph import bounds_of, whole_groups
from quillstone.llm.numbering import partitions
from quillstone.llm.skew import joined_by_key
from quillstone.llm.staging import digest, discard, stage
from quillstone.llm.words import gram_hashes, mix, short, span_hashes, utf8, word_spans

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity s shares a band with a chance of 1 - (1 - s**3)**12: 0.9998 at 0.8.
BANDS, BAND_ROWS = 12, 3
#: Counters of the document-frequency table (16 MB in a task) and of the piece of it that one row carries.
DF_BUCKETS, DF_PIECE = 1 << 22, 1 << 12
#: A shingle in fewer than one of so many documents weighs as much as one in a single document.
RARE = 1000
#: Shingles that are sampled at once.
CHUNK = 1 << 15
#: Members of each bucket that its other members are first held against.
PIVOTS = 2
#: Members of one side of a block; a larger bucket is compared block by block.
BLOCK = 512
#: Pairs that agree in fewer samples are not verified: at similarity 0.8 the chance of that is under 0.00001.
AGREEING = 18


def shingles(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row the distinct hashes of its shingles, ascending, and their counts.

    A text of fewer words than a shingle is one shingle; a text without words has none.
    """
    starts, ends, rows = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    grams = gram_hashes(words, SHINGLE)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1], return_counts=True)
        elif b > a:
            yield gram_hashes(words[a:b], b - a), np.ones(1, np.int64)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


def df_bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(42)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """How many documents hold a shingle of each counter, and how many have shingles at all.

    Every task counts all its rows in a table of fixed size; the tables are added up
    piece by piece.  Shingles share counters.  What others add to a shingle's count is
    on average (shingles of a document) / DF_BUCKETS of the documents, whatever the size
    of the corpus: one in ten thousand for documents of 400 words, which is well below
    what RARE tells apart.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DF_BUCKETS, np.uint32), 0
        for batch in short(batches, 0):
            for hashes, _ in shingles(*utf8(batch.column(0))):
                np.add.at(seen, df_bucket(hashes), np.uint32(1))
                n += len(hashes) > 0
        yield pieces_of(seen.astype("<u4").reshape(-1, DF_PIECE))
        yield pieces_of(np.array([[n]], "<u4"), DF_BUCKETS // DF_PIECE)

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a.astype(np.uint64) + b, 0xFFFFFFFF).astype("<u4")

    pieces = folded(docs.select(F.col(text).alias("text")).mapInArrow(count, PIECES), "<u4", add)
    out = np.zeros((DF_BUCKETS // DF_PIECE, DF_PIECE), np.uint32)
    n = int(pieces.pop(DF_BUCKETS // DF_PIECE, np.zeros(1))[0])
    for piece, counts in pieces.items():
        out[piece] = counts
    return out.ravel(), n


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    """A smoothed inverse document frequency per counter, on one scale at any size of the corpus.

    1 for what is in every document, rising with the logarithm of n / df, to 2 for what
    is in one of RARE documents or fewer.
    """
    out = np.empty(len(df), np.float16)
    for i in range(0, len(df), CHUNK):  # not all at once: doubles of the whole table take eight times its room
        rarity = np.log(max(n, 1) / np.clip(df[i : i + CHUNK], 1, max(n, 1))) / np.log(RARE)
        out[i : i + CHUNK] = 1 + np.minimum(rarity, 1)
    return out


def weights(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF, with a dampened count."""
    return ((1 + np.log10(counts)) * idf[df_bucket(hashes)]).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling.

    For each hash function a shingle of weight S has a gamma(2,1) variable r, another c
    and a uniform b, all fixed by its hash; with t = floor(ln S / r + b) and
    ln y = r (t - b), the sample is the (shingle, t) of the smallest ln c - ln y - r.
    Two documents agree with a chance of their weighted Jaccard similarity.
    """

    def __init__(self, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.r = draw.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
        self.log_c = np.log(draw.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
        self.odd = draw.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)

    def samples(self, hashes: np.ndarray, log_w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A 32-bit name of the sample for each row (``first``: starts of the rows' shingles) and hash function."""
        out = np.empty((len(first), len(self.odd)), np.uint64)
        low = np.uint64(0xFFFF)
        for k, odd in enumerate(self.odd):
            x = hashes * odd
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            r = self.r[x & low]
            b = ((x >> np.uint64(32)) & low).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(log_w / r + b)
            cost = self.log_c[(x >> np.uint64(16)) & low] - r * (t - b) - r
            bits = cost.view(np.int32).astype(np.int64)
            order = np.where(bits < 0, -(bits & 0x7FFFFFFF), bits) + (1 << 31)  # ascends with the cost
            name = ((x >> np.uint64(32)) + t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
            out[:, k] = np.minimum.reduceat((order.view(np.uint64) << np.uint64(32)) | name, first)
        return out & np.uint64(0xFFFFFFFF)

    def signatures(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The samples (rows x hash functions) of non-empty rows of (hashes, weights)."""
        out, i = [], 0
        while i < len(rows):
            j, n = i + 1, len(rows[i][0])
            while j < len(rows) and n + len(rows[j][0]) <= CHUNK:
                n += len(rows[j][0])
                j += 1
            sizes = [len(h) for h, _ in rows[i:j]]
            first = np.cumsum(sizes) - sizes
            out.append(self.samples(np.concatenate([h for h, _ in rows[i:j]]), np.log(np.concatenate([w for _, w in rows[i:j]])), first))
            i = j
        return np.concatenate(out)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row; keys of different bands differ."""
    names = signatures.reshape(len(signatures), BANDS, BAND_ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), names.shape[:2])
    for k in range(BAND_ROWS):
        keys = mix(keys * np.uint64(0xA24BAED4963EE407) + names[:, :, k])
    return keys


def name_of(text: str = "text"):
    """16 bytes that stand for a text; none for a null."""
    return F.coalesce(digest(text), F.lit(b""))


def sampled(docs: DataFrame, idf, key: str, text: str) -> DataFrame:
    """Staged, per row: doc_id, digest, bands (keys), signature (samples)."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in short(batches, 2):
            found = list(shingles(*utf8(batch.column(2))))
            at = np.array([i for i, (h, _) in enumerate(found) if len(h)], np.int64)
            names = sampler.signatures([(found[i][0], weights(*found[i], idf.value)) for i in at]) if len(at) else np.zeros((0, BANDS * BAND_ROWS), np.uint64)
            bands = ragged(band_keys(names).ravel().view(np.int64), np.repeat(at, BANDS), batch.num_rows, pa.int64())
            signature = ragged(names.ravel().astype(np.uint32).view(np.int32), np.repeat(at, BANDS * BAND_ROWS), batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], bands, signature], names=["doc_id", "digest", "bands", "signature"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), name_of(text).alias("digest"), F.col(text).alias("text"))
    return stage(rows.mapInArrow(sample, "doc_id long, digest binary, bands array<long>, signature array<int>"), "samples")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two rows of (hashes, weights)."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    same = hb[at] == ha
    both = float(np.minimum(wa[same], wb[at[same]]).sum())
    return both / (float(wa.sum()) + float(wb.sum()) - both)


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    return similarity(a, b) >= SIMILARITY - 1e-6


def weighed(column, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(h, weights(h, c, idf)) for h, c in shingles(*utf8(column))]


def verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) of similar texts, staged.  Each node is ``a`` in one pair at most."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 2):
            _, one, which = np.unique(batch.column(1).to_numpy(), return_index=True, return_inverse=True)
            left, right = weighed(batch.column(2), idf.value), weighed(batch.column(3).take(pa.array(one)), idf.value)
            mask = pa.array([similar(x, right[b]) for x, b in zip(left, which.tolist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    asked = stage(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "asked")
    heads = stage(asked.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"), "heads")
    both = joined_by_key(pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"), heads, "b", "n")
    links = stage(both.select("a", "b", "text_a", "text_b").mapInArrow(judge, "a long, b long"), "links")
    discard(asked, heads)
    return links


def pivot_links(members: DataFrame, buckets: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Links between nodes and the pivots that they share most bands with: most of a group of copies becomes one component.

    Of each bucket, PIVOTS members are chosen by their hashes, so a group of copies has
    the same pivots in most of its buckets.  Each node is held against one pivot.
    """
    salt = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
    chosen = members.groupBy("bucket", salt.alias("salt")).agg(F.min(F.struct(F.xxhash64("node", F.lit(1)).alias("draw"), "node")).alias("p"))
    of_bucket = chosen.groupBy("bucket").agg(F.collect_list("p.node").alias("pivots"))  # PIVOTS at most
    pivots = stage(of_bucket.join(buckets, "bucket"), "pivots")
    met = joined_by_key(members, pivots, "bucket", "n").select("node", F.explode("pivots").alias("pivot")).where("node <> pivot")
    shared = met.groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("bands"))
    best = shared.groupBy("node").agg(F.min(F.struct((-F.col("bands")).alias("order"), F.xxhash64("pivot", F.lit(1)).alias("draw"), "pivot")).alias("best"))
    pairs = stage(best.select(F.col("node").alias("a"), F.col("best.pivot").alias("b")), "pairs")
    links = verified(pairs, texts, idf)
    discard(pivots, pairs)
    return links


def block_rows(members: DataFrame) -> DataFrame:
    """The members of buckets with two components or more, dealt to the tasks that compare block with block.

    A bucket's largest component is one side: its members are compared with all others,
    not with each other.  A bucket of BLOCK members or fewer is one block.
    """
    of_comp = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n_comp"))
    sizes = of_comp.groupBy("bucket").agg(F.max(F.struct("n_comp", "comp")).alias("head"), F.sum("n_comp").alias("n"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    one = F.col("n") <= BLOCK
    sizes = stage(sizes.select("bucket", F.col("head.comp").alias("head"), "n", F.when(one, 1).otherwise(blocks(F.col("n") - F.col("head.n_comp"))).alias("outer"), F.when(one, 0).otherwise(blocks(F.col("head.n_comp"))).alias("inner")), "sizes")
    draw = F.xxhash64("node", F.lit(2))
    inside = (F.col("inner") > 0) & (F.col("comp") == F.col("head"))
    placed = joined_by_key(members, sizes, "bucket", "n").withColumn("block", F.when(inside, F.col("outer") + F.pmod(draw, F.col("inner"))).otherwise(F.pmod(draw, F.col("outer"))).cast("int"))
    last = F.when(F.col("block") < F.col("outer"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1
    others = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))
    rows = placed.withColumn("pair", F.explode(others))
    return rows.select(F.xxhash64("bucket", "pair.low", "pair.high").alias("task"), F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "block", "node", "comp", "band")


def compared(rows: DataFrame, idf) -> DataFrame:
    """Block against block.  ``rows``: task, low, high, block, node, comp, band, signature, and with texts also text.

    Signatures are compared as matrices, and no pair becomes a row.  A pair is live if
    it is in two components, agrees in enough samples, and met in no earlier band.
    Without texts: the (task, node) of live pairs.  With texts: the live pairs are
    verified, most agreeing first, and only links (a, b) that join two components of
    those in the task leave it.
    """
    whole = "text" in rows.columns
    names = ["task", "low", "high", "block", "node", "comp", "band", "signature", *(["text"] if whole else [])]
    dealt = rows.repartition(partitions(rows), "task").sortWithinPartitions("task", "node").select(*names)

    def live_pairs(part: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        low, high, block, comp = (part.column(i).to_numpy() for i in (1, 2, 3, 5))
        signature = part.column(7).combine_chunks().flatten().to_numpy().reshape(len(comp), -1)
        band = part.column(6)[0].as_py()
        left, right = np.flatnonzero(block == low[0]), np.flatnonzero(block == high[0])
        for i in left.tolist():
            js = right[right > i] if low[0] == high[0] else right
            js = js[comp[js] != comp[i]]
            if len(js):
                equal = signature[js] == signature[i]
                n = equal.sum(axis=1)
                bands = equal.reshape(len(js), BANDS, BAND_ROWS).all(axis=2)
                live = np.flatnonzero((n >= AGREEING) & (bands.argmax(axis=1) == band))  # its first shared band
                if len(live):
                    yield i, js[live[np.argsort(-n[live], kind="stable")]]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for table in whole_groups(batches):
            edges = bounds_of(table.column(0).to_numpy())
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                yield table.slice(lo, hi - lo)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tables(batches):
            found = np.zeros(part.num_rows, bool)
            for i, js in live_pairs(part):
                found[i] = True
                found[js] = True
            if found.any():
                yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in part.select(["task", "node"]).filter(pa.array(found)).columns], names=["task", "node"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tables(batches):
            comp, column, kept, parent = part.column(5).to_numpy(), part.column(8), {}, {}

            def text_of(i: int) -> tuple[np.ndarray, np.ndarray]:
                if i not in kept:
                    kept[i] = weighed(column.slice(i, 1), idf.value)[0]
                return kept[i]

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            found: list[tuple[int, int]] = []
            for i, js in live_pairs(part):
                for j in js.tolist():
                    a, b = root(int(comp[i])), root(int(comp[j]))
                    if a != b and similar(text_of(i), text_of(j)):
                        parent[a] = b
                        found.append((int(comp[i]), int(comp[j])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(links, "a long, b long") if whole else dealt.mapInArrow(candidates, "task long, node long")


def block_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Links between the components that pivots left in one bucket: enough to join all that belong together.

    ``members``: bucket, band, node, comp.  One short row per member and block finds the
    live pairs; texts are fetched only for members of live pairs.
    """
    rows = stage(block_rows(members).join(nodes.select("node", "signature"), "node"), "block-rows")
    live = stage(compared(rows, idf).distinct(), "live")
    links = stage(compared(rows.join(live, ["task", "node"]).join(texts, "node"), idf), "links")
    discard(rows, live)
    return links


def linked(members: DataFrame, buckets: DataFrame, nodes: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(node, comp) of the nodes with links; ``members``: bucket, band, node of the buckets with two nodes or more."""
    comps = components(pivot_links(members, buckets, texts, idf))
    state = stage(members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "state")
    more = components(block_links(state, nodes, texts, idf)).select(F.col("node").alias("comp"), F.col("comp").alias("upper"))
    discard(state)
    late = more.select(F.col("comp").alias("node"), "comp")  # nodes that had no link to a pivot
    both = comps.unionByName(late.join(comps.select("node"), "node", "left_anti"))
    return stage(both.join(more, "comp", "left").select("node", F.coalesce("upper", "comp").alias("comp")), "linked")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged, per row of the input: doc_id, digest, class_id, class_size, kept.

    Copies of one text are one node.  Two texts are linked if the weighted Jaccard
    similarity of their five-word shingles (TF-IDF weights) is 0.8 or more; a class is
    a connected component of links.  ``class_id`` is the smallest doc_id of the class,
    and ``kept`` is true for that document alone.

    Defined cases: null, empty and blank texts are linked to nothing but equal texts;
    a text of fewer than five words is one shingle; a very long text counts with all its
    shingles; null doc_ids come after all others, and class_id is null if a class has no
    other; of repeated rows of the kept document each is marked ``kept``
    (``deduplicated`` leaves one); an empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(*document_frequencies(docs, text)))  # DF_BUCKETS numbers
    rows = sampled(docs, idf, key, text)
    nodes = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # the number that is written stays
    each = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stage(shared, "buckets")
    members = stage(joined_by_key(each, buckets, "bucket", "n"), "members")

    no_id = F.lit(-(1 << 63))
    active = stage(nodes.select("node", "digest", F.coalesce("first_id", no_id).alias("first_id")).join(members.select("node").distinct(), "node"), "active")
    found = docs.select(F.coalesce(F.col(key).cast("long"), no_id).alias("first_id"), name_of(text).alias("digest"), F.col(text).alias("text"))
    names = [F.col("digest"), F.col("first_id")]
    texts = likely(found, names, active, names).join(active.hint("shuffle_hash"), ["digest", "first_id"]).select("node", "text")
    if rows.select("doc_id", "digest").distinct().count() < rows.count():  # repeated rows: one text each is enough
        texts = texts.dropDuplicates(["node"])
    texts = stage(texts, "active-texts")
    comps = linked(members, buckets, nodes, texts, idf)
    discard(texts, members, buckets, active)

    # classes of several nodes; any other node is a class of its own
    placed = stage(comps.join(nodes.select("node", "first_id", "n"), "node"), "placed")
    heads = placed.groupBy("comp").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"), F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("head"), F.count(F.lit(1)).alias("n_nodes"))
    heads = stage(heads.select("comp", "class_id", "class_size", F.col("head.node").alias("head"), "n_nodes"), "classes")
    joint = joined_by_key(placed.select("node", "comp"), heads, "comp", "n_nodes").select("node", "class_id", "class_size", "head")
    told = nodes.select("node", "digest", "first_id", "n").join(joint, "node", "left")
    alone = F.col("head").isNull()
    told = stage(
        told.select("digest", "first_id", "n", F.when(alone, F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("n")).otherwise(F.col("class_size")).alias("class_size"), F.when(alone, F.lit(True)).otherwise(F.col("head") == F.col("node")).alias("is_head")),
        "named",
    )
    out = joined_by_key(rows.select("doc_id", "digest"), told, "digest", "n")
    return stage(out.select("doc_id", "digest", "class_id", "class_size", (F.col("is_head") & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("kept")), "document-classes")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with all its columns: the one of the smallest doc_id.

    Defined cases: as for ``classes``; of repeated rows of the kept document one stays.
    """
    no_id = F.lit(-(1 << 63))
    kept = classes(docs, key, text).where("kept").select(F.coalesce("doc_id", no_id).alias("id"), "digest")
    repeated = not kept.groupBy("id", "digest").count().where("count > 1").isEmpty()
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("long"), no_id).alias("id"), name_of(text).alias("digest"))
    out = rows.join(kept.hint("shuffle_hash"), ["id", "digest"], "left_semi")
    if repeated:
        out = out.dropDuplicates(["id", "digest"])
    return out.select("row.*")
