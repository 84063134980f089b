"""The embedding job: batches, vectors from a caller's function, checks, a ledger, progress.

What has been embedded is kept in a ledger, by the hash of a batch's texts: a job that
starts again calls the function only for batches that are not in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH = 90
DIMENSIONS = 768

#: Fixed texts, shown to the user.
BAD_RESPONSE = "The embedding service returned an unexpected response"
SERVER_ERROR = "Processing failed due to a server error"
LEDGER = "key string, n int, vectors array<array<double>>"

#: Texts of one batch to one vector each, in order.
EmbedBatch = Callable[[list[str]], list[list[float]]]


def batched(chunks: DataFrame, size: int = BATCH, document: str = "document_id", index: str = "chunk_index") -> DataFrame:
    """``chunks`` with ``batch_no``: consecutive batches of at most ``size`` per document."""
    in_order = Window.partitionBy(document).orderBy(index)
    return chunks.withColumn("batch_no", F.floor((F.row_number().over(in_order) - 1) / size).cast("int"))


def hashed_words(dim: int) -> EmbedBatch:
    """A stand-in for a model: a unit vector of hashed word counts, the same on every machine."""

    def embed(texts: list[str]) -> list[list[float]]:
        import hashlib

        out, places = [], {}
        for text in texts:
            counts = [0.0] * dim
            for word in text.lower().split():
                if word not in places:
                    h = int.from_bytes(hashlib.md5(word.encode()).digest()[:4])
                    places[word] = h % dim, 1.0 if h >> 31 else -1.0
                i, sign = places[word]
                counts[i] += sign
            v = np.array(counts)
            n = float(np.sqrt(v @ v))
            out.append((v / n if n else v).tolist())
        return out

    return embed


def embedded(rows: DataFrame, embed: EmbedBatch | None = None, text: str = "input", vector: str = "embedding", batch: int = BATCH, dim: int = DIMENSIONS) -> DataFrame:
    """``rows`` with a vector per text, from the caller's function; it is called with at most ``batch`` texts."""
    embed = embed or hashed_words(dim)
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list = []
            texts = pdf[text].tolist()
            for i in range(0, len(texts), batch):
                vectors += embed(texts[i : i + batch])
            yield pdf.assign(**{vector: vectors})[[*names, vector]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{vector}` array<double>"
    return rows.mapInPandas(run, schema)


class EmbeddingFailed(Exception):
    """Raised by a caller's function; its message is shown to the user."""


def batch_key(inputs: Column | str, model: str, dim: int) -> Column:
    """What stands for a batch in the ledger: the hash of its texts, in order, and of the model."""
    inputs = F.col(inputs) if isinstance(inputs, str) else inputs
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(str(dim)), F.to_json(inputs)), 256)


def judged_call(embed: EmbedBatch, texts: list[str], dim: int) -> tuple[np.ndarray | None, str | None, str | None]:
    """(vectors, problem, cause) of one call.

    A call that fails, or gives another number of vectors, or one of another length or
    with a value that is null or not finite, has no vectors, a problem for the user and
    a cause for the log.
    """
    try:
        found = embed(texts)
        try:
            vectors = np.array(found, dtype=np.float64).reshape(len(found), -1 if found else dim)
            odd = len(found) if vectors.shape[1] != dim else int((~np.isfinite(vectors).all(axis=1)).sum())
        except (TypeError, ValueError):  # vectors of several lengths
            each = [np.array(v, dtype=np.float64) for v in found]
            vectors, odd = None, sum(v.shape != (dim,) or not np.isfinite(v).all() for v in each)
    except EmbeddingFailed as e:
        return None, str(e), repr(e)
    except Exception as e:  # the caller's function: whatever it raises fails this document alone
        return None, SERVER_ERROR, repr(e)[:1000]
    if vectors is None or odd or len(found) != len(texts):
        return None, BAD_RESPONSE, f"expected {len(texts)} vectors of {dim}, got {len(found)}, {odd} of them malformed"
    return vectors, None, None


FRESH = "array<struct<key: string, n: int, vectors: array<array<double>>>>"
KNOWN = "array<struct<batch_no: int, vectors: array<array<double>>>>"
#: Documents whose vectors are put together at once.
AT_ONCE = 64


def embedded_documents(docs: DataFrame, embed: EmbedBatch | None = None, dim: int = DIMENSIONS, batch: int = BATCH) -> DataFrame:
    """Whole documents with the vectors of all their passages, or of none.

    ``docs``: document_id, problem, n_chunks, chunks, inputs (texts, one for each chunk),
    keys (of its batches, for the ledger; may be null), known (vectors of batches that
    the ledger has; may be null).  Added: vectors, problem and cause of the first batch
    that fails, chunks_embedded, and fresh (batches that were embedded now, if there are
    keys).  Batches of one document are embedded one after the other, the others also
    where one has failed.
    """
    embed = embed or hashed_words(dim)

    def lists(parts: list[np.ndarray | None]) -> pa.Array:
        n = [0 if p is None else len(p) for p in parts]
        values = np.concatenate([p.ravel() for p in parts if p is not None] or [np.zeros(0)])
        inner = pa.ListArray.from_arrays(pa.array(np.arange(sum(n) + 1) * dim, pa.int32()), pa.array(values, pa.float64()))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), inner, mask=pa.array([p is None for p in parts]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                part = whole.slice(at, AT_ONCE)
                column = dict(zip(part.schema.names, part.columns, strict=True))
                vectors, problems, causes, embedded_n, fresh = [], column["problem"].to_pylist(), [], [], []
                for i, early in enumerate(problems):
                    texts = column["inputs"].slice(i, 1).flatten().to_pylist() if early is None else []
                    keys, known = column["keys"][i].as_py(), {k["batch_no"]: k["vectors"] for k in column["known"][i].as_py() or []}
                    found, problem, cause, new = [], early, None, []
                    for number, start in enumerate(range(0, len(texts), batch)):
                        if number in known:
                            found.append(np.array(known[number], np.float64).reshape(-1, dim))
                            continue
                        got, wrong, why = judged_call(embed, texts[start : start + batch], dim)
                        if got is None:
                            problem, cause = problem or wrong, cause or why
                            continue
                        found.append(got)
                        if keys:
                            new.append({"key": keys[number], "n": len(got), "vectors": got.tolist()})
                    vectors.append(np.concatenate(found) if problem is None and found else None)
                    problems[i] = problem
                    causes.append(cause)
                    embedded_n.append(sum(map(len, found)))
                    fresh.append(new)
                yield pa.RecordBatch.from_arrays(
                    [column["document_id"], column["n_chunks"], column["chunks"], lists(vectors), pa.array(problems, pa.string()), pa.array(causes, pa.string()), pa.array(embedded_n, pa.int64()), pa.array(fresh, _FRESH)],
                    names=["document_id", "n_chunks", "chunks", "vectors", "problem", "cause", "chunks_embedded", "fresh"],
                )

    _FRESH = pa.list_(pa.struct([("key", pa.string()), ("n", pa.int32()), ("vectors", pa.list_(pa.list_(pa.float64())))]))
    rows = docs.select("document_id", "problem", "n_chunks", "chunks", "inputs", "keys", "known")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("document_id", "chunks")}
    return rows.mapInArrow(run, f"document_id {kinds['document_id']}, n_chunks int, chunks {kinds['chunks']}, vectors array<array<double>>, problem string, cause string, chunks_embedded long, fresh {FRESH}")


def ledger_of(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``, empty if there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def known_vectors(docs: DataFrame, ledger: str) -> DataFrame:
    """(document_id, known) of the documents (document_id, keys) that the ledger has batches of; only keys and vectors are shuffled."""
    asked = docs.select("document_id", F.posexplode("keys").alias("batch_no", "key"))
    held = ledger_of(docs.sparkSession, ledger).select("key", "vectors").dropDuplicates(["key"])  # two jobs may have written one key
    return asked.join(held, "key").groupBy("document_id").agg(F.collect_list(F.struct("batch_no", "vectors")).alias("known"))


def ledger_progress(batches: DataFrame, ledger: str, document: str = "document_id") -> DataFrame:
    """Per document: chunks_total, chunks_embedded, working_until, stage, as the ledger has it; ``batches``: document, key, n."""
    done = ledger_of(batches.sparkSession, ledger).select("key", F.lit(True).alias("_done")).distinct()
    n = batches.join(done, "key", "left").groupBy(document).agg(F.sum("n").alias("chunks_total"), F.sum(F.when(F.col("_done"), F.col("n")).otherwise(0)).alias("chunks_embedded"))
    return n.withColumn("working_until", F.least(F.col("chunks_embedded") + BATCH, "chunks_total")).withColumn("stage", F.when(F.col("chunks_embedded") < F.col("chunks_total"), "embedding").otherwise("saving"))


def well_formed(vector: Column | str, dim: int) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(finite, F.lit(False))


def checked(asked: DataFrame, answered: DataFrame, item: str, dim: int = DIMENSIONS, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(good vectors, problems): an item without a vector, of another length, or with a value that is not finite."""
    rows = asked.select(item).join(answered.select(item, vector), item, "left")
    problem = F.when(F.col(vector).isNull(), "missing").when(F.size(vector) != dim, "wrong size").when(~well_formed(vector, dim), "not finite")
    rows = rows.withColumn("problem", problem)
    return rows.where("problem IS NULL").drop("problem"), rows.where("problem IS NOT NULL").select(item, "problem")


def progress(chunks: DataFrame, batch: int = BATCH, document: str = "document_id", vector: str = "embedding") -> DataFrame:
    """Per document: chunks_total, chunks_embedded, working_until (end of the batch in work), stage."""
    n = chunks.groupBy(document).agg(F.count(F.lit(1)).alias("chunks_total"), F.count(vector).alias("chunks_embedded"))
    stage = F.when(F.col("chunks_embedded") < F.col("chunks_total"), "embedding").otherwise("saving")
    return n.withColumn("working_until", F.least(F.col("chunks_embedded") + batch, "chunks_total")).withColumn("stage", stage)
