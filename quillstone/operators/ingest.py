"""Ingestion by whole documents: text to passages to vectors, and nothing of a document whose vectors are not all good.

One dataflow for tables and streams.  A document stays in one row from its text to the
vectors of all its passages, so what may be stored is decided there, and nothing is
shuffled; the number of passages of a document is bounded.  Each failure has its own
message and, for the log, its cause.  With a ledger, batches that it has are fetched
before, and new ones are added to it after.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.columns import has_text, normalised, passage_input, title, token_estimate
from quillstone.operators import chunking, embedding, text

#: Fixed text.
NO_PDF_TEXT = "No extractable text (scanned PDF?)"


@dataclass(frozen=True)
class Ingested:
    """``passages``: document_id, chunk_index, content, token_estimate, overlap_chars, embedding, of documents that are ready.

    ``outcomes``: per document document_id, status, error_message, cause, chunks_total,
    chunks_embedded.  ``batches``: document_id, batch_no, key, n, for progress by a ledger.
    """

    passages: DataFrame
    outcomes: DataFrame
    batches: DataFrame

    def failed(self) -> DataFrame:
        return self.outcomes.where("status = 'failed'")


def text_documents(docs: DataFrame) -> DataFrame:
    """(document_id, filename, text, kind) of text files (document_id, filename, text)."""
    return docs.select("document_id", "filename", normalised("text").alias("text"), F.lit("text").alias("kind"))


def page_documents(pages: DataFrame, names: DataFrame) -> DataFrame:
    """The same of page texts (document_id, page_no, text) and their files' names (document_id, filename)."""
    return names.select("document_id", "filename").join(text.extracted(pages), "document_id", "left").select("document_id", "filename", "text", F.lit("pdf").alias("kind"))


def chunked(docs: DataFrame, options: chunking.ChunkOptions, limit: int) -> DataFrame:
    """One row per document: document_id, problem, n_chunks, chunks and inputs (null where there is a problem)."""
    rows = chunking.chunk_array(docs.select("document_id", "kind", title("filename").alias("title"), F.when(has_text("text"), F.col("text")).alias("text")), options)
    there, n = F.col("text").isNotNull(), F.size("chunks")
    problem = F.when(~there, F.when(F.col("kind") == "pdf", NO_PDF_TEXT).otherwise(text.NO_TEXT)).when(n > limit, F.format_string(f"Document is too large to process: %d chunks (limit {limit})", n))
    rows = rows.withColumn("problem", problem).withColumn("n_chunks", F.when(there, n)).withColumn("chunks", F.when(F.col("problem").isNull(), F.col("chunks")))
    return rows.select("document_id", "problem", "n_chunks", "chunks", F.transform("chunks", lambda c: passage_input(F.col("title"), c["content"])).alias("inputs"))


def ingested(docs: DataFrame, work: str, options: chunking.ChunkOptions = chunking.ChunkOptions(), embed: embedding.EmbedBatch | None = None, dim: int = embedding.DIMENSIONS, ledger: str | None = None, model: str = "default", limit: int = chunking.MAX_CHUNKS, waves: int = 1) -> Ingested:
    """Ingest ``docs``: document_id (each once), filename, text, kind.

    ``work``: a new folder, which the result is read from.  ``ledger``: where vectors are
    kept beyond this run, by the hash of their batch's texts.  ``waves``: with a ledger,
    so many parts of the documents are embedded and added to it one after the other; what
    a run has finished when it is stopped is not embedded again.

    Defined cases: a document with a null text, or without letters and digits, has no
    text; one of more than ``limit`` passages is too large as a whole; one of whose
    vectors any is missing, of another length or not finite is failed, whatever the
    others are; of several failed batches the first one's problem is told; an empty
    table gives empty results.
    """
    spark = docs.sparkSession
    rows = chunked(docs, options, limit)
    none = lambda kind: F.lit(None).cast(kind)

    def written(df: DataFrame, name: str, at: str = "") -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{work}/{name}{at}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    if ledger is None:
        found = written(embedding.embedded_documents(rows.withColumn("keys", none("array<string>")).withColumn("known", none(embedding.KNOWN)), embed, dim), "embedded")
        batches = found.select("document_id", F.lit(0).alias("batch_no"), none("string").alias("key"), F.size("chunks").alias("n")).limit(0)
    else:
        size = embedding.BATCH
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.col("n_chunks") - 1) / size).cast("int")), lambda i: F.slice("inputs", i * size + 1, size))
        keys = F.when(F.col("problem").isNull(), F.transform(slices, lambda x: embedding.batch_key(x, model, dim)))
        rows = written(rows.withColumn("keys", keys), "chunked")
        for wave in range(waves):
            part = rows.where(F.pmod(F.xxhash64("document_id"), F.lit(waves)) == wave)
            part = part.join(embedding.known_vectors(part, ledger), "document_id", "left")
            found = written(embedding.embedded_documents(part, embed, dim), "embedded", f"/wave={wave}")
            fresh = spark.read.schema(found.schema).parquet(f"{work}/embedded/wave={wave}")
            fresh.select(F.explode("fresh").alias("f")).select("f.*").write.mode("append").parquet(ledger)
        at = F.col("batch_no") * size
        batches = rows.select("document_id", "n_chunks", F.posexplode("keys").alias("batch_no", "key")).select("document_id", "batch_no", "key", F.least(F.lit(size), F.col("n_chunks") - at).alias("n"))

    status = F.when(F.col("problem").isNull(), "ready").otherwise("failed")
    outcomes = found.select("document_id", status.alias("status"), F.col("problem").alias("error_message"), "cause", F.col("n_chunks").alias("chunks_total"), "chunks_embedded")
    # outer: a plain explode would be given a filter that looks at the vectors once more
    each = found.where("problem IS NULL").select("document_id", F.posexplode_outer(F.arrays_zip("chunks", "vectors")).alias("chunk_index", "p")).where("p IS NOT NULL")
    content = F.col("p.chunks.content")
    passages = each.select("document_id", "chunk_index", content.alias("content"), token_estimate(content).alias("token_estimate"), F.col("p.chunks.overlap_chars").alias("overlap_chars"), F.col("p.vectors").alias("embedding"))
    return Ingested(passages, outcomes, batches)
