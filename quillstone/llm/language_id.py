"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.words import short

#: Hash buckets of the n-grams of 1 to 3 characters.
FEATURES = 1 << 15
ORDERS = (1, 2, 3)
#: The fit takes about so many rows of each language, chosen by a hash over all rows.
FIT_ROWS = 1500
#: A quarter of the fitted rows is kept for the temperature.
CALIBRATION = 4
UNKNOWN = "und"
#: How a fitted row's buckets (under FEATURES) and counts travel to the driver, and stay on it.
PACKED = ("<u2", "<u4")

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """A table over all code points: is it a letter?"""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)
    return _letters


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the character n-grams of a whole text, in lower case.

    What is not a letter counts as one blank between words.  A text without a
    letter has no features.
    """
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return none, none
    codes = np.where(is_letter, codes, 32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint64)
    seen = np.zeros(FEATURES, np.int64)
    gram = np.zeros(len(codes), np.uint64)
    for order in ORDERS:
        if len(codes) < order:
            break
        gram = gram[: len(codes) - order + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[order - 1 :] + np.uint64(order)
        bucket = ((gram * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)).astype(np.int64)
        seen += np.bincount(bucket, minlength=FEATURES)
    at = np.flatnonzero(seen)
    return at, seen[at]


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of unit length, with dampened counts."""
    w = (1 + np.log(counts)) * idf
    return w / np.sqrt(w @ w)


class Sample:
    """The fitted rows, as packed numbers of six bytes a feature; a row's buckets and weights are made when it is read."""

    def __init__(self, packed: list[tuple[bytes, bytes]], idf: np.ndarray):
        self.packed, self.idf = packed, idf

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, counts = (np.frombuffer(x, kind).astype(np.int64) for x, kind in zip(self.packed[i], PACKED, strict=True))
        return at, weighted(counts, self.idf[at])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # FEATURES
    weights: np.ndarray  # FEATURES x languages, mostly zero
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weighted(counts, self.idf[at]) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = features(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        z = self.logits(at, counts) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def fit_ftrl(
    rows: Sequence[tuple[np.ndarray, np.ndarray]],
    classes: np.ndarray,
    n_classes: int,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
    epochs: int = 3,
    seed: int = 11,
) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader (proximal form) with elastic-net penalties.

    ``rows`` are sparse rows (buckets, weights).  Each coordinate's weight is a
    closed function of its gradient sum z and squared sum n, and is zero while
    |z| is at most ``l1``.  The last bucket is the unpenalised bias.
    """
    z, n = np.zeros((FEATURES + 1, n_classes)), np.zeros((FEATURES + 1, n_classes))

    def leader(at: np.ndarray) -> np.ndarray:
        za, na = z[at], n[at]
        penalty = np.where(at == FEATURES, 0.0, 1.0)[:, None]
        w = -(za - np.sign(za) * l1 * penalty) / ((beta + np.sqrt(na)) / alpha + l2 * penalty)
        return np.where(np.abs(za) <= l1 * penalty, 0.0, w)

    shuffle = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in shuffle.permutation(len(rows)):
            buckets, x = rows[i]
            at, x = np.append(buckets, FEATURES), np.append(x, 1.0)
            w = leader(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[classes[i]] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = leader(np.arange(FEATURES + 1))
    return w[:FEATURES], w[FEATURES]


def fit_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of the lowest log loss, by golden-section search on its logarithm."""
    if not len(classes):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(classes)), classes]).mean())

    low, high, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many of the texts each bucket occurs, over all of them; the last entry counts texts with letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, np.int64)
        for batch in short(batches, 0):
            for text in batch.column(0).to_pylist():
                at, _ = features(text)
                df[at] += 1
                df[FEATURES] += len(at) > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["bucket", "df"])

    rows = texts.mapInArrow(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()  # FEATURES + 1 rows at most
    out = np.zeros(FEATURES + 1, np.int64)
    for r in rows:
        out[r.bucket] = r.df
    return out


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, lang: str = "lang", text: str = "text", key: str = "doc_id") -> Model:
    """Fit a model to the labelled documents.

    The document frequencies come from all of them.  The weights and the
    temperature are fitted to a sample of about ``fit_rows`` rows of each language,
    chosen by a hash of key and text.  Without labelled rows the model has no languages.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0))
    df = document_frequencies(known.select(F.col(text).alias("text")))
    idf = np.log((1 + df[FEATURES]) / (1 + df[:FEATURES])) + 1

    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, fit_rows / n))])[F.col(lang)]
    draw = F.xxhash64(F.col(key), F.col(text), F.lit(5))
    sample = known.where(F.pmod(draw, F.lit(1 << 30)) < share * (1 << 30)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 1):
            found = [features(t) for t in batch.column(1).to_pylist()]
            at, counts = (pa.array([x[i].astype(kind).tobytes() for x in found], pa.binary()) for i, kind in enumerate(PACKED))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), at, counts], names=["lang", "draw", "at", "counts"])

    fitted = sorted((r.draw, r.lang, r.at, r.counts) for r in sample.mapInArrow(sparse, "lang string, draw long, at binary, counts binary").toLocalIterator() if r.at)
    classes = np.array([languages.index(language) for _, language, _, _ in fitted], np.int64)
    held = np.array([(draw_ >> 30) % CALIBRATION == 0 for draw_, _, _, _ in fitted], bool)
    rows = [(at, counts) for _, _, at, counts in fitted]
    use, kept = np.flatnonzero(~held), np.flatnonzero(held)
    weights, bias = fit_ftrl(Sample([rows[i] for i in use], idf), classes[use], len(languages))
    model = Model(languages, idf, weights.astype(np.float32), bias)
    model.temperature = fit_temperature(np.array([x @ weights[at] + bias for at, x in Sample([rows[i] for i in kept], idf)]), classes[kept])
    return model


def predicted(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``predict`` with the columns to keep (by default all) in one column, ``row``, so that no names can clash: row, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))  # FEATURES x languages numbers; plain arrays, for workers without this package
    keep = docs.columns if keep is None else keep
    inside = keep.index(text) if text in keep else None
    rows = docs.select(F.struct(*keep).alias("row"), *([] if text in keep else [F.col(text).alias("text")]))

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            yield pa.RecordBatch.from_arrays([row, batch.column(1) if inside is None else row.flatten()[inside]], names=["row", "text"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Model(**held.value)
        for batch in short(with_text(batches), 1):
            found = [learned.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["row", "lang_pred", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(label, schema)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the whole text alone.

    Columns of these names in the input are replaced; all others are kept as they are.
    Defined cases: a text that is null or has no letter is ``und`` with score 0, as is
    every text where nothing could be learned; a very long text is read as a whole;
    repeated rows get equal results; an empty table gives an empty result.
    """
    out = predicted(docs, model, text)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("lang_pred", "score")], "lang_pred", "score")


def held_out(key: str = "doc_id"):
    """The fold that is kept from learning: crc32 of the key's text has remainder 2 by 4; null keys learn."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """Per document doc_id, held_out, lang_pred, score; learned from the other three folds.

    Defined cases: as for ``predict``; a null doc_id is in a learning fold; a null lang
    teaches nothing; repeated rows are labelled each; other columns are ignored.
    """
    model = fit(docs.where(~held_out()))
    out = predicted(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score")
