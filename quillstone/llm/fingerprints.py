"""SimHash near-duplicates by an exact tiled comparison of fingerprints.

Distinct fingerprints are sorted by their population count, then by the counts of ever
smaller parts, and cut into tiles.  Two fingerprints differ in at least as many bits as
the counts of their parts do, summed up; so tile pairs, and within them pairs of short
runs, whose counts are further apart than the radius are skipped.  What is left is
compared in full, by exclusive-or and bit counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.components import components
from quillstone.llm.numbering import numbered
from quillstone.llm.skew import joined_by_key
from quillstone.llm.staging import digest, discard, stage
from quillstone.llm.words import short, utf8

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile; more where there are very many, so that tiles stay few.
TILE, TILES, LARGEST_TILE = 4096, 256, 1 << 20
#: Sorted fingerprints of a tile that are skipped or compared together.
RUN = 64
#: Parts of a fingerprint whose bits are counted: the whole, quarters, bytes.
PARTS = (1, 4, 8)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of the shingles of a text, repeats included: of the whole sequence if it has fewer words, none without words."""
    words = text.translate(_LOWER).split()  # on ASCII white space
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[: -SHINGLE]]]
    return [xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, ends[SHINGLE - 1 :], strict=True)]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Per text the bits that are set in over half of its shingles' hashes.

    Hashes are counted by the values of their bytes, and bits from those counts.
    """
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        found = shingle_hashes(text)
        if found:
            each = np.array(found, "<u8").view(np.uint8).reshape(-1, 8)
            at = (each + (np.arange(8) << 8)).ravel() if len(found) > 64 else None
            ones = np.bincount(at, minlength=2048).reshape(8, 256) @ _BITS if at is not None else _BITS[each].sum(axis=0)
            out[k] = np.packbits(ones.ravel() * 2 > len(found), bitorder="little").view("<u8")[0]
    return out


def printed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged, per row: doc_id, digest, print (the fingerprint as a signed long)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 2):
            data, offsets = utf8(batch.column(2))
            raw = data.tobytes()
            found = fingerprints([raw[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], names=["doc_id", "digest", "print"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), digest(text).alias("digest"), F.col(text).cast("string").alias("text"))
    return stage(rows.mapInArrow(scan, "doc_id long, digest binary, print long"), "fingerprints")


def part_count(part: int, of: int) -> Column:
    """Bits set in one of ``of`` equal parts of ``print``, from the top."""
    width = 64 // of
    return F.bit_count(F.shiftrightunsigned("print", 64 - width * (part + 1)).bitwiseAND(F.lit((1 << width) - 1)) if of > 1 else F.col("print"))


def sort_order() -> list[Column]:
    """The population count, then counts of smaller and smaller parts; the last of each is left out, as the others decide it."""
    finer = [part_count(i, 4) for i in range(3)] + [part_count(2 * i, 8) for i in range(4)]
    return [part_count(0, 1), *finer, F.col("print")]


def counts_of(prints: np.ndarray) -> list[np.ndarray]:
    """The counts of the parts, a matrix for each of PARTS."""
    each = np.bitwise_count(prints.astype(">u8").view(np.uint8).reshape(-1, 8)).astype(np.int16)
    return [each.reshape(len(each), n, 8 // n).sum(axis=2, dtype=np.int16) for n in PARTS]


def boxes(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The least and the largest counts of each run of RUN fingerprints."""
    first = np.arange(0, len(prints), RUN)
    return [(np.minimum.reduceat(c, first), np.maximum.reduceat(c, first)) for c in counts_of(prints)]


def near_runs(a: list[tuple[np.ndarray, np.ndarray]], k: int, b: list[tuple[np.ndarray, np.ndarray]], radius: int) -> np.ndarray:
    """The runs of ``b`` whose counts are not further than the radius from those of run ``k`` of ``a``."""
    keep = None
    for (low_a, high_a), (low_b, high_b) in zip(a, b, strict=True):
        gap = np.maximum(np.maximum(low_b - high_a[k], low_a[k] - high_b), 0).sum(axis=1)
        keep = gap <= radius if keep is None else keep & (gap <= radius)
    return np.flatnonzero(keep)


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        x = int(parent[x])
    return x


def spanning(a: np.ndarray, label_a: np.ndarray, b: np.ndarray | None, label_b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links between labels, as few as join all that near pairs of ``a`` and ``b`` join (within ``a``, if there is no ``b``).

    Labels are numbers from 0; those of ``b`` follow those of ``a``.  All near pairs are
    found, and those of labels that are joined already are passed over.
    """
    inner = b is None
    b, label_b = (a, label_a) if inner else (b, label_b)
    now = np.arange(int(max(label_a.max(), label_b.max())) + 1)
    box_a, box_b, links = boxes(a), boxes(b), []
    for k in range(-(-len(a) // RUN)):
        rows = slice(k * RUN, (k + 1) * RUN)
        runs = near_runs(box_a, k, box_b, radius)
        if inner:
            runs = runs[runs >= k]
        for part in np.array_split(runs, max(1, -(-len(runs) // RUN))):  # bounded memory
            at = (part[:, None] * RUN + np.arange(RUN)).ravel()
            at = at[at < len(b)]
            i, j = np.nonzero(np.bitwise_count(a[rows, None] ^ b[None, at]) <= radius)
            la, lb = now[label_a[rows][i]], now[label_b[at][j]]
            apart = la != lb
            if not apart.any():
                continue
            for code in np.unique(la[apart] * len(now) + lb[apart]).tolist():
                p, q = _root(now, code // len(now)), _root(now, code % len(now))
                if p != q:
                    now[max(p, q)] = min(p, q)
                    links.append((p, q))
            while (now[now] != now).any():
                now = now[now]
    return links


def tile_size(n: int) -> int:
    return min(max(TILE, -(-n // TILES)), LARGEST_TILE)


def local_labels(prints: np.ndarray, radius: int) -> np.ndarray:
    """Per fingerprint of a tile the place of the first one that it is joined to within the tile."""
    parent = np.arange(len(prints))
    for x, y in spanning(prints, parent.copy(), None, None, radius):
        p, q = _root(parent, x), _root(parent, y)
        parent[max(p, q)] = min(p, q)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def tiles(prints: DataFrame, n: int, radius: int) -> DataFrame:
    """Staged, per tile: tile, prints and heads (of each fingerprint the one that stands for its part of the tile), and the boxes ``low`` and ``high``.

    ``prints``: distinct fingerprints.  A tile has at most ``tile_size(n)`` of them.
    """
    size = tile_size(n)
    placed = numbered(prints.select("print"), *sort_order(), label="sorted-prints").withColumn("tile", F.floor(F.col("row_no") / size).cast("int"))
    packed = placed.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("row_no", "print"))).alias("rows")).select("tile", F.col("rows.print").alias("prints"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                mine = batch.column(1).slice(k, 1).flatten().to_numpy().view(np.uint64)
                low, high = [], []
                for c in counts_of(mine):
                    low += c.min(axis=0).tolist()
                    high += c.max(axis=0).tolist()
                heads = mine[local_labels(mine, radius)]
                yield pa.RecordBatch.from_pydict(
                    {"tile": [batch.column(0)[k].as_py()], "prints": [mine.tobytes()], "heads": [heads.tobytes()], "low": [low], "high": [high]},
                    schema=pa.schema([("tile", pa.int32()), ("prints", pa.binary()), ("heads", pa.binary()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))]),
                )

    return stage(packed.mapInArrow(join_up, "tile int, prints binary, heads binary, low array<int>, high array<int>"), "tiles")


def tile_pairs(found: DataFrame, radius: int) -> DataFrame:
    """(a, b): the pairs of tiles whose population counts are within the radius of each other, each once and with its ends dealt evenly.

    Tiles ascend by the whole count, so a tile's partners follow it without a gap: they
    are found by a table of the 65 counts, and the counts of the parts drop some of them.
    """
    boxes_ = found.select("tile", "low", "high")
    # the last tile that begins at a count of at most p, for each p from 0 to 64 + radius
    last = found.select(F.explode(F.sequence(F.col("low")[0], F.lit(64 + radius))).alias("count"), "tile").groupBy("count").agg(F.max("tile").alias("last"))
    reach = boxes_.withColumn("count", F.col("high")[0] + radius).join(F.broadcast(last), "count")  # 65 + radius rows
    pairs = reach.where("last > tile").select(F.col("tile").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence(F.col("tile") + 1, "last")).alias("b"))
    both = pairs.join(boxes_.select(F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b")), "b")
    gap = F.zip_with(F.zip_with("low_b", "high_a", lambda x, y: x - y), F.zip_with("low_a", "high_b", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0)))
    keep, at = F.lit(True), 1
    for n in PARTS:
        keep &= F.aggregate(F.slice(gap, at, n), F.lit(0), lambda s, x: s + x) <= radius
        at += n
    turned = (F.col("a") + F.col("b")) % 2 == 1
    return both.where(keep).select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))


def links_between(found: DataFrame, pairs: DataFrame, radius: int) -> DataFrame:
    """Staged links (a, b) between heads of different tiles."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, head_a, b, head_b = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in range(4))
                of_a, label_a = np.unique(head_a, return_inverse=True)
                of_b, label_b = np.unique(head_b, return_inverse=True)
                names = np.concatenate([of_a, of_b]).view(np.int64)
                links = np.array(spanning(a, label_a, b, label_b + len(of_a), radius), np.int64).reshape(-1, 2)
                if len(links):
                    yield pa.RecordBatch.from_arrays([pa.array(names[links[:, 0]]), pa.array(names[links[:, 1]])], names=["a", "b"])

    side = lambda x: found.select(F.col("tile").alias(x), F.col("prints").alias(f"prints_{x}"), F.col("heads").alias(f"heads_{x}"))
    rows = pairs.join(side("a").hint("shuffle_hash"), "a").join(side("b").hint("shuffle_hash"), "b")
    return stage(rows.select("prints_a", "heads_a", "prints_b", "heads_b").mapInArrow(compare, "a long, b long"), "print-links")


def classes(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged, per row of the input: doc_id, digest, fingerprint (16 hexadecimal digits), component_id, component (a number of its own).

    Fingerprints link if they differ in ``radius`` bits or fewer; a component is all that
    links reach, and ``component_id`` its smallest doc_id.  No pair is left out: only
    those are skipped whose counts of bits show that they are further apart.

    Defined cases: a null, empty or blank text has the fingerprint zero, which is linked
    like any other; a text of fewer than four words is one shingle; a very long text
    counts with all its shingles; rows of equal fingerprints (repeated rows, copies) are
    one to the comparison and in one component; null doc_ids are no smallest one, and
    component_id is null where a component has no other; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = printed(docs, key, text)
    each = stage(rows.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "prints")
    found = tiles(each, each.count(), radius)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(c)[k].as_buffer(), np.int64)) for c in (0, 1)], names=["print", "head"])

    heads = found.select("prints", "heads").mapInArrow(unpacked, "print long, head long")
    comps = components(links_between(found, tile_pairs(found, radius), radius)).select(F.col("node").alias("head"), "comp")
    named = stage(each.join(heads, "print").join(comps, "head", "left").withColumn("comp", F.coalesce("comp", "head")), "print-components")
    smallest = stage(named.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n_prints")), "component-ids")
    of_print = stage(joined_by_key(named.select("print", "n", "comp"), smallest, "comp", "n_prints").select("print", "n", "component_id", F.col("comp").alias("component")), "print-ids")
    out = joined_by_key(rows, of_print, "print", "n")
    out = stage(out.select("doc_id", "digest", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "component"), "simhash-classes")
    discard(rows, each, found, named, smallest, of_print)
    return out


def deduplicated(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one of the smallest doc_id (any, where all are null).

    Defined cases: as for ``classes``; of repeated rows of that document one stays.
    """
    no_id, no_text = F.lit(-(1 << 63)), F.lit(b"")
    found = classes(docs, radius, key, text).where("doc_id <=> component_id").select("component", F.struct(F.coalesce("doc_id", no_id).alias("id"), F.coalesce("digest", no_text).alias("name")).alias("k"))
    kept = stage(found.groupBy("component").agg(F.min("k").alias("k")).select("k.*"), "simhash-kept")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("long"), no_id).alias("id"), F.coalesce(digest(text), no_text).alias("name"))
    return rows.join(kept, ["id", "name"], "left_semi").dropDuplicates(["id", "name"]).select("row.*")
