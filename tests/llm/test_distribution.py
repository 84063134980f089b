"""Importance resampling, whitening and fingerprints against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from quillstone.llm import fingerprints, importance, queries, whitening
from tests import oracle
from tests.llm.fixtures import clashing, documents, empty, prose, values

# --- 11 importance ------------------------------------------------------------------

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text):
    w = LETTERS.findall(lowered(text))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def expected_draw(docs, target):
    """doc_id, n_features, weight, score, rank of (doc_id, text) pairs."""
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            np.add.at(counts, features(text)[0], 1)
    gain = [math.floor(1000 * math.log((float(b) + 1) * (float(s.sum()) + 10_000) / ((float(a) + 1) * (float(t.sum()) + 10_000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out, may = [], []
    for i, (key, text) in enumerate(docs):
        found, n = features(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), weight, score, None])
        if n >= 20:
            may.append((-score, key is None, key or 0, i))
    for place, (*_, i) in enumerate(sorted(may)[: 5 * len(may) // 100]):
        out[i][4] = place + 1
    return sorted((tuple(r) for r in out), key=repr)


ODD = ["É x9 ß", "漢字 " * 30, "a\x00b\nc", "w" * 70 + " " + "V" * 65 + " end " + "漢" * 30, "A-b_C.d", "--- ***", ""]


def test_features_are_hashed_as_by_zlib():
    import pyarrow as pa

    texts = [*ODD, None, *[prose(i, i, "aB1é") for i in range(60)], prose(99, 3000)]
    grams, whole, ends = importance.Features().buckets(pa.array(texts), 10_000)
    got = np.concatenate([g[w] for g, w in zip(grams, whole, strict=True)])
    assert sorted(got.tolist()) == sorted(b for t in texts for b in features(t)[0])
    assert np.diff(ends, prepend=0).tolist() == [features(t)[1] for t in texts]


def test_long_texts_are_cut_between_words(monkeypatch):
    import pyarrow as pa

    texts = [prose(1, 400), "x" * 500, *ODD, prose(2, 300)]
    whole = importance.Features().words(pa.array(texts))
    monkeypatch.setattr(importance, "SLAB", 64)
    cut = importance.Features().words(pa.array(texts))
    assert all((a == b).all() if isinstance(a, np.ndarray) else a == b for a, b in zip(whole, cut, strict=True))


def test_importance_of_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()] + [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, prose(i, 25)) for i in range(60)] + [(200, prose(0, 25))]
    target = [prose(3, 25), None, "", prose(5, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.scored(df, wanted).select("doc_id", "n_features", "weight", "score", "rank")
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert values(got) == expected_draw(rows, target)
    drawn = {r[0] for r in expected_draw(rows, target) if r[4]}
    assert {r.doc_id for r in importance.resampled(df, wanted).collect()} == drawn and len(drawn) > 2


def test_importance_keeps_columns_and_takes_empty_tables(spark):
    odd, none = clashing(spark), spark.createDataFrame([], "text string")
    assert values(importance.scored(odd, none)) == values(importance.scored(documents(spark), none))
    out = importance.resampled(odd, none, percent=50)
    assert out.schema == odd.schema and 0 < out.count() < odd.count()
    assert importance.scored(empty(spark), none).count() == 0
    assert importance.resampled(documents(spark), none, least_words=10**9).count() == 0


# --- 12 whitening -------------------------------------------------------------------


def test_scatter_is_exact():
    draw = np.random.default_rng(1)
    for low, high, n in ((-700, 700, 500), (0, 1, 3), (5, 6, 1), (-(1 << 52), 1 << 52, 70), (-(1 << 30), 1 << 30, 40)):
        y = draw.integers(low, high, (n, 5))
        big = y.astype(object)
        assert (whitening.scatter(y) == big.T @ big).all()


def expected_whitening(vectors):
    x = np.floor(1024 * vectors.astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    return ((n * x - s) ** 2).sum(axis=1), (c @ q / np.sqrt(e))[:, :8], e / e.sum()


def test_whitening_of_the_whole_table(spark):
    table = pq.read_table(f"{oracle.SF}/embeddings.parquet").to_pydict()
    deviation, white, share = expected_whitening(np.array(table["embedding"], np.float32))
    at = {v: i for i, v in enumerate(table["vec_id"])}
    got = queries.op12_embedding_whitening(spark, oracle.SF).collect()
    assert len(got) == 8 * len(at) and {r.n for r in got} == {len(at)} and max(r.identity_error for r in got) < 1e-9
    mine = np.zeros(white.shape)
    for r in got:
        assert r.deviation == deviation[at[r.vec_id]] and abs(r.explained / share[r.component - 1] - 1) < 1e-9
        mine[at[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-7


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 3), i / 7, 0.5]) for i in range(20)] + [(3, [0.0, 3 / 7, 0.5]), (None, [9.0, 1.0, 0.5])]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [nan, 1.0, 2.0]), (54, [inf, 1.0, 2.0]), (55, [1.0, 2.0]), (56, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in good + bad], "vec_id long, embedding array<double>, n int, whitened string, deviation int")
    got = whitening.whitened(df).collect()
    assert sorted({r.vec_id for r in got}, key=repr) == sorted({k for k, _ in good}, key=repr) and len(got) == 3 * len(good) and {r.n for r in got} == {len(good)}
    assert all((r.whitened is None) == (r.component == 3) for r in got) and max(r.identity_error for r in got) < 1e-9
    deviation, _, _ = expected_whitening(np.array([v for _, v in good])[:, :2])
    assert sorted(int(r.deviation) for r in got if r.component == 1) == sorted(deviation.tolist())
    for few in (df.where("vec_id = 50"), df.where("vec_id = 51"), df.limit(0)):
        assert whitening.whitened(few).count() == 0
    one = whitening.whitened(df.where("vec_id = 4")).collect()
    assert [(r.whitened, r.explained, int(r.deviation)) for r in one] == [(None, None, 0)] * 3


# --- 13 fingerprints ----------------------------------------------------------------


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected_components(prints):
    """The smallest id of each print's component, by comparing all pairs; prints: (id, fingerprint)."""
    distinct = sorted({p for _, p in prints})
    a = np.array(distinct, np.uint64)
    label = np.arange(len(a))
    while True:
        near = np.array([label[np.bitwise_count(a ^ x) <= 4].min() for x in a])
        if (near == label).all():
            break
        label = near
    group = dict(zip(distinct, label.tolist(), strict=True))
    least: dict = {}
    for i, p in prints:
        if i is not None:
            least[group[p]] = min(i, least.get(group[p], i))
    return {p: least.get(g) for p, g in group.items()}


def compared(got, docs):
    prints = [(i, fingerprint(t)) for i, t in docs]
    comp = expected_components(prints)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == sorted(((i, f"{p:016x}", comp[p]) for i, p in prints), key=repr)


def test_fingerprints_of_the_whole_table(spark):
    d = pq.read_table(f"{oracle.SF}/documents.parquet").to_pydict()
    compared(queries.op13_simhash_near_duplicates(spark, oracle.SF).collect(), list(zip(d["doc_id"], d["text"], strict=True)))


def test_fingerprints_of_awkward_rows(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()] + [(300 + i, t) for i, t in enumerate(["A b C d", "a B c\td e", "\x0b", "a\x00b c", "É é ß"])]
    got = fingerprints.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    compared(got, rows)
    assert values(fingerprints.classes(clashing(spark))) == values(fingerprints.classes(documents(spark)))
    assert fingerprints.classes(empty(spark)).count() == 0
    one = fingerprints.deduplicated(clashing(spark))
    assert one.schema == clashing(spark).schema
    ids = {r.component_id for r in fingerprints.classes(documents(spark)).collect()}
    assert sorted((r.doc_id for r in one.collect()), key=repr) == sorted(ids, key=repr)
    nameless = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "z y x w v")], "doc_id long, text string")
    assert fingerprints.deduplicated(nameless).count() == 2


@pytest.mark.parametrize("tile, run", [(4096, 64), (64, 8), (16, 4)])
def test_tiles_leave_no_pair_out(spark, monkeypatch, tile, run):
    """Chains, dense groups and lone fingerprints, with links across many tiles."""
    monkeypatch.setattr(fingerprints, "TILE", tile)
    monkeypatch.setattr(fingerprints, "TILES", 1 << 20)
    monkeypatch.setattr(fingerprints, "RUN", run)
    draw = np.random.default_rng(tile)
    flip = lambda x, n: int(np.bitwise_xor.reduce(np.append(np.uint64(1) << draw.choice(64, n, replace=False).astype(np.uint64), np.uint64(x))))
    prints = [int(x) for x in draw.integers(0, 1 << 63, 300)]
    chain = [prints[0]]
    for _ in range(150):
        chain.append(flip(chain[-1], 4))
    dense = [flip(prints[1], int(draw.integers(0, 3))) for _ in range(200)]
    edge = [flip(p, 5) for p in prints[2:60]]
    every = [*prints, *chain, *dense, *edge, 0, (1 << 64) - 1, 15, 31]
    pairs = list(enumerate(every))
    monkeypatch.setattr(fingerprints, "printed", lambda docs, key, text: docs)
    rows = spark.createDataFrame([(i, b"", x - (1 << 64) if x >> 63 else x) for i, x in pairs], "doc_id long, digest binary, print long")
    comp = expected_components(pairs)
    got = fingerprints.classes(rows).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, comp[p]) for i, p in pairs}
