"""The operators against brute force on small documents with nulls, copies, ties and clashing columns."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontamination, language_id, license_rules, licenses, mixing, near_duplicates, neighbour_graph, queries, sharding, skew, substrings, suffixes, token_files
from tests.llm.fixtures import clashing, documents, empty, prose, rows, values

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


# --- 1 mixing -----------------------------------------------------------------------


def test_mixing_meets_its_targets(spark):
    big = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id")).alias("text"), F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("source"))
    out = mixing.mixed(big, {"hot": 1.0, "cold": 1.0})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["hot"] - 3000) < 250 and abs(n["cold"] - 3000) < 250
    counts = collections.Counter(r.n_copies for r in out.where("source = 'cold' AND copy = 0").collect())
    for k in (1, 2, 3):
        assert abs(counts[k] / 2000 - math.exp(-1.5) * 1.5**k / math.factorial(k)) < 0.04
    assert values(out) == values(mixing.mixed(big.repartition(7), {"hot": 1.0, "cold": 1.0}))


def test_mixing_takes_large_means_and_awkward_rows(spark, docs):
    few = spark.createDataFrame([(1, "a", "rare"), *[(i, "b", "many") for i in range(2, 2002)]], "doc_id long, text string, source string")
    out = mixing.mixed(few, {"rare": 1.0, "many": 1.0})
    assert abs(out.where("source = 'rare'").count() - 1000.5) < 150
    assert mixing.mixed(empty(spark)).count() == 0
    got = mixing.mixed(docs)
    assert got.where("source IS NULL").count() + got.where("source IS NOT NULL").count() == got.count()
    assert values(got.select("doc_id", "copy")) == values(mixing.mixed(clashing(spark)).select("doc_id", "copy"))


# --- 2 language ---------------------------------------------------------------------


def test_language_is_learned_and_calibrated(spark):
    alphabets = {"en": "abcde", "fr": "fghij", "de": "klmno"}
    data = [(i, prose(i, 40, alphabets[x]), x) for i, x in enumerate(list(alphabets) * 60)]
    out = language_id.identified(spark.createDataFrame([*data, (900, None, "en"), (901, "12 !", "en"), (902, "", None), (None, prose(1, 9, "abcde"), None)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in out.collect()}
    held = [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].held_out == (i in set(held)) for i, _, _ in data)
    assert sum(got[i].lang_pred == data[i][2] for i in held) / len(held) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_labels(spark, docs):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identified(unlabelled).collect()} == {"und"}
    assert language_id.identified(empty(spark)).count() == 0
    out = language_id.predict(clashing(spark), language_id.fit(clashing(spark)))
    assert out.count() == len(rows()) and dict(out.dtypes)["score"] == "double"


def test_ftrl_leaves_most_weights_at_zero():
    r = np.random.default_rng(0)
    data = [(np.sort(r.choice(1000, 20, replace=False)) + 1000 * (i % 2), np.full(20, 0.22)) for i in range(200)]
    w, _ = language_id.fit_ftrl(data, np.arange(200) % 2, 2)
    assert (w != 0).any(axis=1).sum() < 2001
    assert all((x @ w[at]).argmax() == i % 2 for i, (at, x) in enumerate(data))


def peak_mb(work) -> float:
    """The most memory of this process's Python that ``work`` took."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_fitted_rows_stay_packed_on_the_driver(spark):
    r = np.random.default_rng(4)
    texts = ["".join(map(chr, 0x4E00 + r.integers(0, 4000, 20_000))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert peak_mb(lambda: language_id.fit(docs)) < 45  # 1.3 million features; as lists of whole numbers they take well over that


def test_packed_rows_are_the_features():
    idf = np.linspace(1, 9, language_id.FEATURES)
    found = [language_id.features(t) for t in ("a bc abc " * 70_000, "漢字 é", "z")]
    packed = language_id.Sample([tuple(x.astype(k).tobytes() for x, k in zip(f, language_id.PACKED, strict=True)) for f in found], idf)
    assert len(packed) == 3 and found[0][1].max() > 65_535
    for (at, counts), (buckets, w) in zip(found, packed, strict=True):
        assert (at == buckets).all() and (language_id.weighted(counts, idf[at]) == w).all()


# --- 3 and 5 repeated passages ------------------------------------------------------


def repeated():
    """Per row the flags of its repeated words, by brute force."""
    first = {}
    for doc, text, *_ in rows():
        if doc is not None:
            w = WORD.findall(text or "")
            for i in range(len(w) - 49):
                k = tuple(w[i : i + 50])
                first[k] = min(doc, first.get(k, doc))
    out = []
    for doc, text, *_ in rows():
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if doc is not None and first.get(tuple(w[i : i + 50]), doc) < doc:
                gone[i : i + 50] = [True] * 50
        out.append((doc, w, gone))
    return out


def test_substring_dedup_is_exact(spark, docs):
    expected = []
    for doc, w, gone in repeated():
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert values(substrings.deduplicated(docs)) == sorted(expected, key=repr)
    assert values(substrings.deduplicated(clashing(spark))) == sorted(expected, key=repr)
    assert sum(x[2] for x in expected) > 200
    assert substrings.deduplicated(empty(spark)).count() == 0


def test_substring_dedup_of_periodic_texts(spark):
    line = " ".join(f"w{i}" for i in range(7))
    data = [(3, " ".join([line] * 30)), (5, "a b " + " ".join([line] * 40)), (4, " ".join(["x"] * 120)), (9, "y " + " ".join(["x"] * 60)), (2, " ".join(["x"] * 49))]
    got = {r.doc_id: r.n_removed for r in substrings.deduplicated(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[3] == 0 and got[4] == 0 and got[2] == 0
    assert got[5] == 280 and got[9] == 60


def test_suffix_repeats_cover_the_same_words(spark, docs):
    expected = {}
    for doc, w, gone in repeated():
        if any(gone):
            expected[doc] = {i for i, g in enumerate(gone) if g}
    for df in (docs, clashing(spark)):
        got = collections.defaultdict(set)
        for r in suffixes.repeats(df).collect():
            got[r.doc_id] |= set(range(r.start_word, r.end_word))
            assert r.keeper_doc_id < r.doc_id and r.n_words >= 50
        assert dict(got) == expected
    assert suffixes.repeats(empty(spark)).count() == 0


def two_texts_of_one_id():
    """Different texts under one doc_id, each sharing passages with others."""
    a, b, c = prose(71, 70), prose(72, 80), prose(73, 60)
    return [
        (5, a + " " + prose(74, 20)), (5, prose(75, 200) + " " + b), (3, "x " + a), (4, b + " y"), (9, c + " " + a), (9, b), (9, c), (7, prose(76, 11) + " " + c + " " + b), (9, c), (8, prose(75, 200)),
    ]


def covered_rows(texts):
    """(doc_id, text, places of its covered words) for each distinct row, by brute force."""
    first, out = {}, []
    for doc, text in texts:
        w = text.split()
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(doc, first.get(k, doc))
    for doc, text in sorted(set(texts)):
        w = text.split()
        out.append((doc, text, {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < doc for j in range(i, i + 50)}))
    return out


def test_two_texts_of_one_id_are_not_mixed_up(spark):
    texts = two_texts_of_one_id()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    expected = covered_rows(texts)
    got = collections.defaultdict(set)
    for r in suffixes.repeats(df).collect():
        got[r.doc_id, r.text_md5] |= set(range(r.start_word, r.end_word))
    assert dict(got) == {(d, hashlib.md5(t.encode()).hexdigest()): x for d, t, x in expected if x}
    cut = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.deduplicated(df).collect())
    covered = {(d, t): len(x) for d, t, x in expected}
    assert cut == collections.Counter((d, len(t.split()), covered[d, t]) for d, t in texts)


def test_siblings_of_a_passage_that_share_a_part_of_it(spark):
    texts, n = [], 0
    for family in range(40):
        passage = prose(300 + family, 52).split()
        for k in range(14):  # two share all 52 words, twelve share 40 of them
            own = passage if k in (5, 9) else [*passage[:40], *prose(9000 + 20 * family + k, 12).split()] if k % 2 else [*prose(7000 + 20 * family + k, 12).split(), *passage[12:]]
            texts.append((n * 7919 % 1000, " ".join([*prose(20000 + n, 8).split(), *own, *prose(40000 + n, 8).split()])))
            n += 1
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in suffixes.repeats(df).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert len(got) == 40 and dict(got) == covered_words(texts)


def covered_words(texts):
    """Per document the places of its words in 50-word windows that a document of a smaller id holds, by brute force."""
    first, out = {}, {}
    for doc, text in texts:
        w = text.split()
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(doc, first.get(k, doc))
    for doc, text in texts:
        w = text.split()
        if found := {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < doc for j in range(i, i + 50)}:
            out[doc] = found
    return out


def test_suffix_repeats_of_many_edited_copies(spark):
    r = random.Random(5)
    passage = prose(20, 130).split()
    texts = []
    for doc in r.sample(range(1000), 150):
        w = list(passage)
        for i in r.sample(range(len(w)), r.randint(0, 3)):
            w[i] = f"edit{r.randint(0, 2)}"
        texts.append((doc, " ".join([*prose(2000 + doc, 12).split(), *w, *prose(5000 + doc, 12).split()])))
    got = collections.defaultdict(set)
    for row in suffixes.repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got[row.doc_id] |= set(range(row.start_word, row.end_word))
    assert dict(got) == covered_words(texts)


# --- 4 near-duplicates --------------------------------------------------------------


def test_inverse_frequencies_are_made_piece_by_piece():
    df, out = np.random.default_rng(5).integers(0, 5000, near_duplicates.DF_BUCKETS).astype(np.uint32), []
    assert peak_mb(lambda: out.append(near_duplicates.inverse_frequencies(df, 5000))) < 20  # 8 MB of them are the result
    rarity = np.log(5000 / np.clip(df, 1, 5000)) / np.log(near_duplicates.RARE)
    assert (out[0] == (1 + np.minimum(rarity, 1)).astype(np.float16)).all()


def test_only_keys_of_many_rows_are_broadcast(spark):
    def joined(*sizes, how="inner"):
        rows = spark.createDataFrame([(k, i) for k, n in enumerate(sizes) for i in range(n)], "k long, i long")
        keyed = spark.createDataFrame([(k, n, f"v{k}") for k, n in enumerate(sizes)], "k long, n long, v string")
        out = skew.joined_by_key(rows, keyed, "k", "n", how)
        assert values(out.select("k", "i", "v")) == values(rows.join(keyed.drop("n"), "k", how).select("k", "i", "v"))
        return out._jdf.queryExecution().analyzed().toString()

    few = joined(1, 2, skew.FEW)
    assert "broadcast" not in few and "Union" not in few
    for how in ("inner", "left"):
        many = joined(1, 2, 1500, how=how)
        assert "broadcast" in many and "Union" in many
    all_hot = joined(skew.FEW + 1, skew.FEW + 2)
    assert "broadcast" in all_hot and "Union" not in all_hot


def test_near_duplicates(spark, docs):
    for df in (docs, clashing(spark)):
        found = near_duplicates.classes(df).collect()
        assert len(found) == len(rows())
        of = collections.defaultdict(set)
        for r in found:
            of[r.class_id].add(r.doc_id)
        assert of[0] == {0, 1, 2, None} and of[16] == {16, 17} and of[7] == {7, None}
        # a text written twice is no near copy of itself: its shingles weigh more
        assert all(len(v) == 1 for k, v in of.items() if k in (3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14))
    kept = near_duplicates.deduplicated(clashing(spark))
    assert kept.columns == clashing(spark).columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)).count(0) == 1
    assert near_duplicates.classes(empty(spark)).count() == 0 and near_duplicates.deduplicated(empty(spark)).count() == 0


def similar_pairs(data):
    """The pairs of rows (number, text) by brute force: exact document frequencies over rows, weights as the README states them."""
    bags = {}
    for _, t in data:
        w = WORD.findall(t or "")
        bags.setdefault(t, collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {})
    n = sum(bool(bags[t]) for _, t in data)
    df = collections.Counter(g for _, t in data for g in bags[t])
    weigh = {t: {g: (1 + math.log10(c)) * (1 + min(1, math.log(n / df[g]) / math.log(1000))) for g, c in bag.items()} for t, bag in bags.items()}
    total = {t: sum(w.values()) for t, w in weigh.items()}
    holders = collections.defaultdict(list)
    for t, w in weigh.items():
        for g in w:
            holders[g].append(t)
    out, texts = {}, list(weigh)
    for a in texts:
        both = collections.Counter()
        for g, w in weigh[a].items():
            for b in holders[g]:
                both[b] += min(w, weigh[b][g])
        for b, shared in both.items():
            if a is not b:
                out[a, b] = shared / (total[a] + total[b] - shared)
    return out


def judged_classes(spark, data):
    """(pairs of 0.8 or more, those of them in one class, classes that join what no chain of such pairs joins)."""
    of = {r.doc_id: r.class_id for r in near_duplicates.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    pairs = similar_pairs(data)
    row_of, parent = {}, {}
    for i, t in data:
        row_of.setdefault(t, i)

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    links = [(a, b) for (a, b), s in pairs.items() if s >= 0.8]
    for a, b in [k for k, s in pairs.items() if s >= 0.799]:  # the operator's weights are rounded
        parent[root(a)] = root(b)
    members = collections.defaultdict(set)
    for i, t in data:
        members[of[i]].add(root(t))
    return len(links), sum(of[row_of[a]] == of[row_of[b]] for a, b in links), sum(len(v) > 1 for v in members.values())


def edited_copies():
    """A star of copies far from each other, a chain of shifted windows, and copies of random distance."""
    base = [f"w{i}" for i in range(300)]
    data = [(0, " ".join(base))]
    for i in range(40):
        r = random.Random(i)
        data.append((i + 1, " ".join(f"c{i}" if r.random() < 0.02 else w for w in base)))
    data += [(100 + i, " ".join(f"v{j}" for j in range(4 * i, 4 * i + 200))) for i in range(12)]
    for k in range(60):
        r = random.Random(500 + k)
        text = prose(600 + k, r.randint(30, 200)).split()
        for c in range(3):
            data.append((1000 + 10 * k + c, " ".join(f"e{c}" if r.random() < 0.01 * c * (k % 4) else w for w in text)))
    return data


def test_classes_are_those_of_the_weighted_similarity(spark):
    links, found, wrong = judged_classes(spark, edited_copies())
    assert links > 200 and found >= 0.99 * links and wrong == 0


def test_classes_of_all_documents_are_those_of_the_weighted_similarity(spark):
    from quillstone.llm.staging import read
    from tests import oracle

    data = [(r.doc_id, r.text) for r in read(spark, oracle.SF, "documents").collect()]
    links, found, wrong = judged_classes(spark, data)
    assert found == links and wrong == 0


def test_large_buckets_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    monkeypatch.setattr(near_duplicates, "PIVOTS", 1)
    links, found, wrong = judged_classes(spark, edited_copies())
    assert found >= 0.99 * links and wrong == 0


def test_sampling_agrees_with_weighted_jaccard():
    r = np.random.default_rng(5)
    keys = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    wa, wb = r.gamma(2, 1, 300).astype(np.float32), r.gamma(2, 1, 300).astype(np.float32)
    wb[:200] = wa[100:]  # rows a: keys 0..299, b: keys 100..399
    a, b = keys[:300], keys[100:]
    s = near_duplicates.Sampler()
    hits = n = 0
    for turn in range(40):
        salt = np.uint64(2 * turn + 1)
        x = s.samples(np.concatenate([a * salt, b * salt]), np.log(np.concatenate([wa, wb])), np.array([0, 300]))
        hits, n = hits + int((x[0] == x[1]).sum()), n + x.shape[1]
    same = float(wa[100:].sum())
    assert abs(hits / n - same / (float(wa.sum()) + float(wb.sum()) - same)) < 0.05


# --- 6 sharding ---------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 64, 100, 1000])
def test_the_permutation_is_one(spark, n):
    got = [r.position for r in sharding.permuted(spark.range(n).withColumnRenamed("id", "row_no"), n, 5).collect()]
    assert sorted(got) == list(range(n)) and (n < 64 or got != list(range(n)))


def test_shards_are_even_and_gapless(spark, docs):
    got = sharding.sharded(docs).collect()
    assert len(got) == len(rows()) and {r.law for r in got} == {"rows"}
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes[i] for i in range(8)) - min(sizes[i] for i in range(8)) <= 1
    for shard in range(8):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    text = {i: t for i, t, *_ in rows()}
    for r in got:
        if r.doc_id is not None:
            assert r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
    assert values(sharding.sharded(clashing(spark).repartition(3))) == values(sharding.sharded(docs))
    assert sharding.sharded(empty(spark)).count() == 0


# --- 7 decontamination --------------------------------------------------------------


def best_overlap(text, item):
    """The most equal words of 13 aligned ones (a shorter item: all its words), if they are enough; by brute force."""
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    a, b = words(text), words(item)
    width = min(13, len(b))
    if not b:
        return 0
    best = max((sum(x == y for x, y in zip(a[i : i + width], b[j : j + width], strict=False)) for i in range(len(a) - width + 1) for j in range(len(b) - width + 1)), default=0)
    return best if best * 13 >= width * 11 else 0


def decontamination_rows():
    """Documents with parts of items of all lengths, some words replaced, and the items."""
    r = random.Random(8)
    items = [(n, prose(80 + n, n)) for n in range(1, 16)] + [(30, prose(50, 30)), (31, prose(51, 10)), (30, prose(50, 30)), (40, None), (41, " . "), (None, prose(52, 20)), (3, prose(53, 25))]
    docs = [(0, prose(60, 200)), (5, None), (6, ""), (None, items[15][1]), (7, items[15][1]), (7, items[15][1]), (8, items[15][1].upper().replace(" ", ", "))]
    for n, (_, text) in enumerate(items):
        w = (text or "").split()
        for k in range(6):  # nothing, or some words anywhere, replaced
            own = [f"other{r.random()}" if i in r.sample(range(len(w)), min(k // 2, len(w))) else x for i, x in enumerate(w)] if w else []
            docs.append((1000 + 10 * n + k, " ".join([*prose(3000 + 10 * n + k, r.choice([0, 3, 20])).split(), *own, *prose(6000 + 10 * n + k, r.choice([0, 3, 20])).split()])))
    return docs, items


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
        monkeypatch.setattr(decontamination, "TOGETHER", 2)
    docs, items = decontamination_rows()
    df = spark.createDataFrame([(i, t, 0, "z", 1, "q", 2) for i, t in docs], "doc_id long, text string, item_id int, digest string, _id int, _digest string, name int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for i, t in docs:
        found = collections.defaultdict(int)
        for k, x in items:
            if best := best_overlap(t, x):
                found[k] = max(best, found[k])
        expected.append((i, bool(found), len(found), ",".join(str(k) for k in sorted(k for k in found if k is not None)), max(found.values(), default=0)))
    got = [tuple(r) for r in decontamination.marked(df, bench).select("doc_id", "contaminated", "n_items", "items", "max_equal").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sum(x[1] for x in expected) > 60 and sum(not x[1] for x in expected) > 20
    clean = decontamination.decontaminated(df, bench)
    assert clean.columns == df.columns and clean.where("_id <> 1 OR _digest <> 'q' OR name <> 2").count() == 0
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((x[0] for x in expected if not x[1]), key=repr)
    assert decontamination.decontaminated(df, bench.limit(0)).count() == len(docs)
    assert decontamination.marked(df.limit(0), bench).count() == 0


def test_masks_find_every_overlap_that_counts():
    """For each length: whichever words differ, if enough are equal then one mask sees none of the others."""
    import itertools

    for n in range(1, 14):
        span, masks = decontamination.masks_of(n)
        for k in range(n - -(-n * 11 // 13) + 1):
            for differ in itertools.combinations(range(n), k):
                assert any(not set(differ) & {at + o for o in mask} for at in range(n - span + 1) for mask in masks), (n, differ)


# --- 8 token files ------------------------------------------------------------------


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    model = queries.tokenizer_json()
    plain = Tokenizer.from_str(model)
    manifest = token_files.write_token_files(clashing(spark), model)
    stored = []
    for r in manifest.orderBy("part").collect():
        store, _ = token_files.open_folder(r.folder)
        stored += [(k, s, ids.tolist()) for k, s, ids in token_files.read_documents(store, r.path, r.base)]
    key = lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(t[1].encode()).hexdigest() if t[1] is not None else "")
    expected, start = [], 0
    for doc, text in sorted(((d, t) for d, t, *_ in rows()), key=key):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        expected.append((doc, start, ids))
        start += len(ids)
    assert stored == expected
    digests = sorted(((d, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, s, i in expected), key=repr)
    assert values(token_files.read_token_files(manifest)) == digests
    assert token_files.token_files(empty(spark), model).count() == 0


def odd_texts():
    r = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "1", "!", "\u2003", "　", "\xa0", "\x1c", "<|endoftext|>", "<|endof", "\r\n", "漢", "😀", "\ufeff", "\x85"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 12))) for _ in range(3000)] + [None, "", "a <|endoftext|> b", "a  <|endoftext|>  b<|endoftext|>"]
    for first in "ab":  # words that polynomial hashes modulo a power of two can't tell apart
        word = first
        while len(word) < 4096:
            word += word.translate(str.maketrans("ab", "ba"))
        texts.append(f"x {word} y")
    return texts


def test_the_encoder_matches_the_tokenizer_on_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    e = token_files.Encoder(queries.tokenizer_json())
    plain = Tokenizer.from_str(queries.tokenizer_json())
    texts = odd_texts()
    expected = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert expected[texts.index("a <|endoftext|> b")] == [64, 220, 50256, 275]
    for _ in range(2):
        ids, counts = e(pa.array(texts))
        at = np.cumsum(counts) - counts
        assert [ids[i : i + n].tolist() for i, n in zip(at, counts, strict=True)] == expected


def test_new_pieces_are_encoded_as_lines_of_few_texts_and_words_without_their_signs():
    """Texts of all kinds of ASCII, contractions and wide signs equal the plain tokenizer's; few texts reach it, "word" and "word," share a piece."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    e, plain, draw = token_files.Encoder(queries.tokenizer_json()), Tokenizer.from_str(queries.tokenizer_json()), random.Random(8)
    signs = [*"aeZ059.,;!$-_<|>\"'` \t\n\r\x00\x1c\x7f", "'s", "'re", "''ll", "-'t", "  ", "\r\n", "é", "e\u0301", "ß5", "٣a", "\xa0", " \xa0x", "\u2003", "中文", "\U0001f600", "\u200d", "<|endoftext|>"]
    seen, encode = [], e._encode
    e._encode = lambda given: seen.append(len(given)) or encode(given)
    for some, size in ((signs, 12), (signs[:29], 60)):
        texts = ["".join(draw.choice(some) for _ in range(draw.randrange(size))) for _ in range(4000)]
        seen.clear()
        ids, n = e(pa.array(texts))
        assert sum(seen[:1]) < len(e.known) / 100
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    e._clear(), seen.clear()
    words = [f"{a}{b}q{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "rstuvwxyz"]
    e(pa.array([" ".join(words), ", ".join(words), "'s ".join(words)]))
    assert sum(seen) < 10 and len(e.known) == len(words) + 2  # a comma and a contraction


def test_token_files_of_all_documents_match_the_plain_tokenizer(spark):
    from tokenizers import Tokenizer

    from quillstone.llm.staging import read
    from tests import oracle

    plain = Tokenizer.from_str(queries.tokenizer_json())
    odd = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(odd_texts())], "doc_id long, text string")
    docs = read(spark, oracle.SF, "documents").select("doc_id", "text").unionByName(odd)
    expected, start = [], 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in token_files.token_files(docs, queries.tokenizer_json()).orderBy("doc_id").collect()] == expected


# --- 9 licences ---------------------------------------------------------------------


def scan(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in licenses.scanned(df).orderBy("doc_id").collect()]


def test_licence_detections(spark):
    got = scan(
        spark, "Released under the MIT License.", "Licensed under the Apache License, Version 2.0. mit-license MIT\nlicense", "the GNU General Public License, version 3",
        "Licensed under CC BY-NC 4.0.", "nothing, licensed to Smith", None, "", "émit license", "SPDX-License-Identifier: 0BSD", "mit license apache license general public license",
    )
    assert [(r.base_labels, r.labels) for r in got] == [
        ("mit", "mit"), ("apache,mit", "apache,apache-2.0,mit"), ("gpl", "gpl,gpl-3.0"), ("", "cc-by-nc-4.0"), ("", ""), ("", ""), ("", ""), ("", ""), ("", "0bsd"), ("apache,gpl,mit", "apache,gpl,mit"),
    ]
    assert [(r.n_words, r.n_base, r.first_word, r.last_word) for r in got[:3]] == [(5, 1, 3, 3), (12, 3, 3, 10), (7, 1, 2, 2)]
    assert got[5].n_words == 0 and got[5].first_word is None and all(0 <= r.score <= 1 for r in got)


def test_licence_texts_and_identifiers(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and\nassociated documentation files (the \"Software\"), to deal in the Software"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided\nthat the following conditions are met:"
    three = bsd + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
    got = scan(
        spark, mit, bsd, three, "SPDX-License-Identifier: MIT", "License: Zlib", "SPDX-License-Identifier: BSD-3-Clause", "# SPDX-License-Identifier: GPL-2.0-or-later",
        "You may not use this file except in compliance with the License.", "This is free and unencumbered software released into the public domain.", "permission to speak is granted", "a license fair to all",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "studied at MIT",
    )
    assert [r.labels for r in got] == ["mit", "bsd", "bsd,bsd-3-clause", "mit", "zlib", "bsd-3-clause", "gpl-2.0-or-later", "apache-2.0", "unlicense", "", "", "mpl-2.0", ""]


def test_licence_expressions_and_short_names(spark):
    got = scan(
        spark, "SPDX-License-Identifier: Apache-2.0 OR MIT", "// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */", "SPDX-License-Identifier: MIT. The and Zlib",
        "spdx-license-identifier: LicenseRef-own and\tISC\nand Zlib", "SPDX-License-Identifier: GPL-2.0+ AND ((MIT))\nx\nSPDX-License-Identifier: Zlib", "SPDX-License-Identifier:", "SPDX-License-Identifier: MIT " + "OR MIT " * 20000 + "OR ISC",
        "LGPL v2.1", "GPL v3", "lgplv2.1 or LGPLv3", "GNU AGPL v3", "MPL v2.0", "Lesser General Public License v3",
    )
    assert [r.labels for r in got] == [
        "apache-2.0,mit", "bsd-3-clause,gpl-2.0-only,linux-syscall-note", "mit", "isc", "gpl-2.0,gpl-2.0-or-later,mit,zlib", "", "isc,mit", "lgpl-2.1", "gpl-3.0", "lgpl-2.1,lgpl-3.0", "agpl-3.0", "mpl-2.0", "gpl,lgpl-3.0",
    ]
    assert [r.score for r in got[:6]] == [1.0] * 5 + [0.0]


def test_licence_sql_reads_expressions(spark):
    """The SQL has the operator's rows over texts with expressions, which the test tables lack."""
    import duckdb

    texts = ["SPDX-License-Identifier: Apache-2.0 OR MIT", "x SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) y\nSPDX-License-Identifier: Zlib", "SPDX-License-Identifier: MIT. The and Zlib", "LGPL v2.1 only", "spdx-license-identifier: LicenseRef-a AND ISC", None, "", "general public license v2"]
    rows = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, r.n_kept) for r in scan(spark, *texts)]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert sorted(db.execute(licenses.oracle_sql()).fetchall()) == rows


def test_each_licence_rule_finds_its_own_signature(spark):
    """Whatever a rule looks for passes the gate and is found, unless a longer signature holds it."""
    found = license_rules.rules()
    texts = [" ".join(w[1:-1].replace("|", " ").split()[0] if w[0] == "[" else w.split("|")[0].replace("[cs]", "c") for w in r.signature.split() if w != "[*]").replace("*", "x") for r in found]
    for rule, text, row in zip(found, texts, scan(spark, *texts), strict=True):
        assert re.search(rule.regex, " " + text.replace(" ", "  ") + " "), rule
        assert rule.label in row.labels.split(",") or row.n_kept > 0, rule


def test_licence_rules_are_ordered_and_many():
    found = license_rules.rules()
    assert len(found) > 300 and [r.order for r in found] == list(range(len(found)))
    assert all(re.compile(r.regex) for r in found)


def test_licence_scan_of_awkward_rows(spark, docs):
    assert licenses.scanned(docs).count() == len(rows()) and licenses.scanned(empty(spark)).count() == 0
    assert values(licenses.scanned(docs)) == values(licenses.scanned(clashing(spark)))
    many = scan(spark, "MIT License. " * 3000)[0]
    assert many.n_base == 3000 and many.last_word == 5998


# --- 10 nearest neighbours ----------------------------------------------------------


def brute(data, every, k):
    usable = {i: np.array(v, float) for i, v in data if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in usable:
        if q % every == 0:
            s = sorted((-round(float(usable[q] @ v / np.linalg.norm(usable[q]) / np.linalg.norm(v)), 9), i) for i, v in usable.items() if i != q)
            out[q] = [i for _, i in s[:k]]
    return out


def test_nearest_vectors(spark):
    r = np.random.default_rng(2)
    data = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(600)]
    data += [(700 + i, data[50][1]) for i in range(30)]  # one vector many times
    data += [(1000, None), (1050, []), (1100, [0.0] * 8), (1150, [1.0, None] + [0.0] * 6), (1200, [float("nan")] * 8), (1250, [1.0] * 7), (None, [1.0] * 8), (3, data[3][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, score string")
    got = collections.defaultdict(list)
    for row in neighbour_graph.nearest(df).orderBy("query_id", "rank").collect():
        got[row.query_id].append(row.vec_id)
    expected = brute(dict(data).items(), 50, 5)
    assert set(got) == set(expected) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(expected[q])) for q in got) / (5 * len(got)) >= 0.9
    assert got[50] == [700, 701, 702, 703, 704]


def test_hubs_are_thinned_out(spark, monkeypatch):
    monkeypatch.setattr(neighbour_graph, "SPARE", 1)
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(400)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for row in neighbour_graph.nearest(df).collect():
        got[row.query_id].add(row.vec_id)
    expected = brute([(x.vec_id, x.embedding) for x in df.collect()], 50, 5)
    assert sum(len(got[q] & set(expected[q])) for q in expected) >= 0.9 * 5 * len(expected)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_vectors_in_a_dense_cluster(spark, kind):
    r = np.random.default_rng(3)
    middle = r.normal(size=64)
    x = np.concatenate([middle + 0.01 * r.normal(size=(1000, 64)), r.normal(size=(500, 64))])
    x = (x.astype(np.float32) if kind == "float" else x).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = collections.defaultdict(set)
    for row in neighbour_graph.nearest(df).collect():
        got[row.query_id].add(row.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1000, 50):
        s = unit @ unit[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / 100 >= 0.95


@pytest.mark.parametrize("n", [0, 1, 2, 4, 30])
def test_few_vectors_are_all_found(spark, n):
    r = np.random.default_rng(n)
    df = spark.createDataFrame([(i, [float(x) for x in r.normal(size=8)]) for i in range(n)], "vec_id long, embedding array<float>")
    got = neighbour_graph.nearest(df).collect()
    assert len(got) == (min(5, n - 1) if n else 0)
    expected = brute([(r_.vec_id, r_.embedding) for r_ in df.collect()], 50, 5)
    assert [x.vec_id for x in sorted(got, key=lambda x: x["rank"])] == expected.get(0, [])
