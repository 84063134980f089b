"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.skew import joined_by_key
from quillstone.llm.staging import digest, discard, stage

#: An overlap is OVERLAP aligned words (an item of fewer: all its words) of which MATCHED in OVERLAP are equal.
OVERLAP, MATCHED = 13, 11
#: Word positions that each mask looks at, within SPAN words; the others may differ.  Any overlap of more than SPAN words holds one of them unharmed.
MASKS = ((0, 4, 6, 7, 8), (0, 1, 2, 5, 8), (0, 2, 3, 7, 8))
SPAN = 9
#: Benchmarks of up to so many seeds (about 100 MB in memory) are sent to all tasks; larger ones are joined by shuffle.
BROADCAST_SEEDS = 500_000
#: Alignments of a document that are verified with one copy of its words.
TOGETHER = 1000
NOT_WORD = r"[^\p{L}\p{N}]+"


def masks_of(words: int) -> tuple[int, list[tuple[int, ...]]]:
    """(span, masks) for items of so many words.

    An item of up to SPAN words is looked up as a whole: by all its words, or, where
    one of them may differ, by every second word, from the first and from the second.
    """
    if words > SPAN:
        return SPAN, list(MASKS)
    may_differ = words - -(-words * MATCHED // OVERLAP)
    return words, [tuple(range(words))] if not may_differ else [tuple(range(0, words, 2)), tuple(range(1, words, 2))]


def word_hashes(text: Column) -> Column:
    """The hashes of the lower-cased words (runs of letters and digits) of a text."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(hashes: str, words: int) -> Column:
    """The seeds that start at place ``at``; null where the span does not fit."""
    span, masks = masks_of(words)
    size = min(words, SPAN + 1)  # items of more words than SPAN have their seeds in common
    each = [F.xxhash64(F.lit(size), F.lit(n), *[F.try_element_at(hashes, F.col("at") + o + 1) for o in mask]) for n, mask in enumerate(masks)]
    return F.when(F.col("at") <= F.size(hashes) - span, F.array(*each))


def _seeded(df: DataFrame, hashes: str, words: list[int]) -> DataFrame:
    """The other columns of ``df`` with a row per place and mask of each size: ``seed``, and ``at``, the word where its span starts.

    Places are exploded first and hashed after, which keeps the hashing in generated
    code; the array itself is dropped, so a row is short however long its text is.
    """
    others = [c for c in df.columns if c != hashes]
    # outer, and no filter on the array before: either would compute the array twice
    places = df.select(*df.columns, F.posexplode_outer(hashes).alias("at", "word"))
    fitting = places.where(F.col("at") <= F.size(hashes) - min(masks_of(n)[0] for n in words))
    each = [_seeds(hashes, n) for n in words]
    seeds = each[0] if len(each) == 1 else F.flatten(F.array_compact(F.array(*each)))
    return fitting.select(*others, "at", F.explode(seeds).alias("seed"))


def best_overlap(doc: Column, item: Column, shift: Column) -> Column:
    """The most equal words of any OVERLAP aligned words, where the item's word j stands at the document's word j + shift.

    An item shorter than OVERLAP counts in full; null if too few words are aligned.
    """
    width = F.least(F.lit(OVERLAP), F.size(item))
    first = F.greatest(F.lit(0), -shift)
    last = F.least(F.size(item), F.size(doc) - shift) - width

    def equal(j: Column) -> Column:
        return F.aggregate(F.sequence(j, j + width - 1), F.lit(0), lambda n, t: n + F.when(item[t] == doc[t + shift], 1).otherwise(0))

    return F.when(last >= first, F.array_max(F.transform(F.sequence(first, last), equal)))


def contaminations(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that overlap benchmark items, staged: id, digest (of the text), item_id, equal (most equal words).

    One row for each document and item.  Words are compared in lower case, without
    punctuation.  Seeds that documents and items share tell where they may be aligned;
    each such alignment is verified word by word.  Items of any number of words are
    found: for those of SPAN words or fewer the seeds are as long as the item.
    """
    items = benchmark.select(F.col(item_key).alias("item_id"), word_hashes(F.col(item_text)).alias("item")).distinct().where(F.size("item") > 0)
    items = stage(items.withColumn("item_no", F.monotonically_increasing_id()), "benchmark-items")
    sizes = sorted(r.size for r in items.select(F.least(F.size("item"), F.lit(SPAN + 1)).alias("size")).distinct().collect())  # SPAN + 1 at most
    of_items = [_seeded(items.where(F.least(F.size("item"), F.lit(SPAN + 1)) == n).select("item_no", "item"), "item", [n]) for n in sizes]
    named = docs.select(F.col(key).alias("id"), digest(text).alias("digest"), F.col(text).alias("text"))
    if not sizes:
        return stage(named.select("id", "digest").limit(0).join(items.select("item_id", F.lit(0).alias("equal")).limit(0), F.lit(True)), "contaminations")
    seeds = of_items[0]
    for more in of_items[1:]:
        seeds = seeds.unionByName(more)
    seeds = stage(seeds.select("item_no", "seed", F.col("at").alias("item_at")), "benchmark-seeds")
    hashed = _seeded(named.select("id", "digest", word_hashes(F.col("text")).alias("doc")), "doc", sizes)
    small = seeds.count() <= BROADCAST_SEEDS
    if small:
        met = hashed.join(F.broadcast(seeds), "seed")
    else:  # a seed's places in items, as one row for each thousand; rows of very common seeds are dealt apart
        shared = hashed.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).join(seeds.select("seed").distinct(), "seed")
        common = joined_by_key(hashed, stage(shared, "seeds-met"), "seed", "n")
        salts = 16
        met = common.withColumn("salt", F.pmod(F.xxhash64("id", "digest", "at"), F.lit(salts))).join(seeds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["seed", "salt"])
    hits = stage(met.select("id", "digest", "item_no", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "seed-hits")

    # the texts of the documents with hits are fetched once for each TOGETHER hits; the hits are the smaller side
    name = [F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), F.coalesce("digest", F.lit(b"")).alias("of")]
    told = hits.select(*name, "item_no", "shift")
    counts = told.groupBy("name", "of").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
    each = told.join(counts, ["name", "of"]).withColumn("part", F.pmod(F.xxhash64("item_no", "shift"), F.col("parts")))
    grouped = stage(each.groupBy("name", "of", "part").agg(F.collect_set(F.struct("item_no", "shift")).alias("found")).drop("part"), "documents-with-hits")
    few = hits.count() <= BROADCAST_SEEDS
    texts = named.select("id", "digest", *name, "text").join(F.broadcast(grouped) if few else grouped.hint("shuffle_hash"), ["name", "of"])
    words = texts.select("id", "digest", word_hashes(F.col("text")).alias("doc"), "found")
    pairs = words.select("id", "digest", "doc", F.explode("found").alias("f")).select("id", "digest", "doc", "f.item_no", "f.shift")
    pairs = pairs.join(F.broadcast(items) if small else items, "item_no")
    judged = pairs.select("id", "digest", "item_id", best_overlap(F.col("doc"), F.col("item"), F.col("shift")).alias("equal"), F.least(F.lit(OVERLAP), F.size("item")).alias("width"))
    enough = F.col("equal") * OVERLAP >= F.col("width") * MATCHED
    found = stage(judged.where(enough).groupBy("id", "digest", "item_id").agg(F.max("equal").alias("equal")), "contaminations")
    discard(seeds, hits, grouped)
    return found


def _of_documents(docs: DataFrame, found: DataFrame, key: str, text: str, how: str) -> DataFrame:
    """Each input row as ``row`` with what was found of its id and text."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.coalesce(digest(text), F.lit(b"")).alias("of"))
    told = found.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), F.coalesce("digest", F.lit(b"")).alias("of"), *[c for c in found.columns if c not in ("id", "digest")])
    small = told.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    return rows.join(F.broadcast(told) if small else told.hint("shuffle_hash"), ["name", "of"], how)


def marked(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, contaminated, n_items, items (ascending, comma-joined), max_equal.

    Defined cases: a null or empty text, and one without words, is clean; a very long
    text is searched as a whole; a null doc_id is a document like any other; repeated
    rows are marked alike; an item without words is found nowhere; an item with a null
    id counts in n_items but is not listed; an empty benchmark marks nothing, and an
    empty table gives an empty result; other columns are ignored.
    """
    found = (
        contaminations(docs, benchmark, key, text)
        .groupBy("id", "digest")
        .agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda i: i.cast("string")), ",").alias("items"), F.max("equal").alias("max_equal"))
    )
    joined = _of_documents(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), stage(found, "contaminated"), "doc_id", "text", "left")
    return joined.select(
        "row.doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"),
        F.coalesce("max_equal", F.lit(0)).cast("int").alias("max_equal"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that overlap no benchmark item, with all their columns.

    Defined cases: as for ``marked``; a clean document stays as often as it is there.
    """
    found = stage(contaminations(docs, benchmark, key, text).select("id", "digest").distinct(), "contaminated")
    return _of_documents(docs, found, key, text, "left_anti").select("row.*")
