"""Queries over whole-document ingestion, as a table job and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import embedding, ingest
from quillstone.plans import text_queries as T
from quillstone.plans import views as V
from quillstone.plans.registry import query
from quillstone.sources import store
from quillstone.sources.files import UNSUPPORTED
from quillstone.sources.tables import scratch, spread, table
from quillstone.streaming import streams

DIM = 64
#: Low, so that the tables hold documents of more passages.
LIMIT = 60
BUSY = "Busy, try again"


def flawed(texts: list[str]) -> list[list[float]]:
    """The stand-in for a model, which fails on texts by their hashes: not finite, too short, an error, a vector too few."""
    import hashlib

    marks = [hashlib.md5(t.encode()).hexdigest()[:2] for t in texts]
    if "02" in marks:
        raise embedding.EmbeddingFailed(BUSY)
    vectors = embedding.hashed_words(DIM)(texts)
    out = [[float("nan")] * DIM if m == "00" else v[1:] if m == "01" else v for m, v in zip(marks, vectors, strict=True)]
    return out[1:] if "03" in marks else out


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, filename, text: some without a letter; lines that close a sentence end a paragraph."""
    t = F.when(F.col("doc_id") % 50 == 7, "***").otherwise(F.regexp_replace("text", r"\.\n", ".\n\n"))
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("document_id"), F.expr("concat(lang, '_', cast(doc_id as string), '.txt')").alias("filename"), t.alias("text"))


_PROSE = r"""prose AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 50 = 7 THEN '***' ELSE regexp_replace(text, '\.\n', '.' || chr(10) || chr(10), 'g') END AS text FROM documents)"""
_PASSAGES = f"{_PROSE}, {T._PARAGRAPHS}, {T._SENTENCES}, {T._UNITS}, {T._PACKED}"
#: Outcomes by document: a batch is 90 passages, and the first failed batch is told.
_OUTCOMES = f"""inputs AS (SELECT t.document_id, c, content, overlap, c // 90 AS batch_no, left(md5(concat('title: ', d.lang, ' ', d.doc_id::VARCHAR, ' | text: ', content)), 2) AS mark FROM texts t JOIN documents d ON d.doc_id = t.document_id),
calls AS (SELECT document_id, batch_no, count(*) AS n, CASE WHEN bool_or(mark = '02') THEN '{BUSY}' WHEN bool_or(mark IN ('00', '01', '03')) THEN '{embedding.BAD_RESPONSE}' END AS problem FROM inputs GROUP BY 1, 2),
told AS (SELECT document_id, sum(n)::INTEGER AS chunks_total, coalesce(sum(n) FILTER (problem IS NULL), 0)::BIGINT AS chunks_embedded, arg_min(problem, batch_no) FILTER (problem IS NOT NULL) AS problem FROM calls GROUP BY 1),
outcomes AS (SELECT p.document_id, CASE WHEN NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 'File contains no text' WHEN chunks_total > {LIMIT} THEN 'Document is too large to process: ' || chunks_total || ' chunks (limit {LIMIT})' ELSE problem END AS error_message, chunks_total,
  CASE WHEN chunks_total > {LIMIT} THEN 0 ELSE chunks_embedded END AS chunks_embedded FROM prose p LEFT JOIN told t ON t.document_id = p.document_id)""".replace("\\\\p", "\\p")


def _ingested(spark: SparkSession, sf_dir: str) -> ingest.Ingested:
    docs = ingest.text_documents(_texts(spark, sf_dir))
    return ingest.ingested(docs, scratch(spark, "ingested"), T.OPTIONS, flawed, DIM, model="flawed", limit=LIMIT)


@query(f"""WITH RECURSIVE {_PASSAGES}, {_OUTCOMES}
  SELECT i.document_id, c::INTEGER AS chunk_index, content, ceil(length(content) / 4)::INTEGER AS token_estimate, overlap::INTEGER AS overlap_chars, {DIM} AS dim FROM inputs i JOIN outcomes o ON o.document_id = i.document_id WHERE error_message IS NULL""")
def h4_ingest_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of the documents all of whose vectors are good."""
    return _ingested(spark, sf_dir).passages.select("document_id", "chunk_index", "content", "token_estimate", "overlap_chars", F.size("embedding").alias("dim"))


@query(f"""WITH RECURSIVE {_PASSAGES}, {_OUTCOMES}
  SELECT document_id, CASE WHEN error_message IS NULL THEN 'ready' ELSE 'failed' END AS status, error_message, CASE WHEN error_message = 'File contains no text' THEN NULL ELSE chunks_total END AS chunks_total, CASE WHEN error_message = 'File contains no text' THEN 0 ELSE chunks_embedded END AS chunks_embedded FROM outcomes""")
def h4_ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's status and message; nothing of a failed one is stored."""
    return _ingested(spark, sf_dir).outcomes.select("document_id", "status", "error_message", "chunks_total", "chunks_embedded")


_NAME = "concat('in/', lang, '_', cast(doc_id as string), CASE WHEN doc_id % 6 = 4 THEN '.docx' ELSE '.txt' END)"
#: The same for Spark, whose concat is null where the language is; SQL's leaves it out.
_NAMED = _NAME.replace("concat(", "concat_ws('', ", 1)


@query(f"""WITH RECURSIVE {_PASSAGES}, {_OUTCOMES}, named AS (SELECT doc_id AS document_id, {_NAME.replace('cast(doc_id as string)', 'doc_id::VARCHAR')} AS path FROM documents),
kept AS (SELECT n.document_id, path, CASE WHEN ends_with(path, '.docx') THEN '{UNSUPPORTED}' ELSE error_message END AS error_message FROM named n JOIN outcomes o ON o.document_id = n.document_id)
  SELECT path, CASE WHEN error_message IS NULL THEN 'ready' ELSE 'failed' END AS status, error_message, c::INTEGER AS chunk_index, content, CASE WHEN c IS NOT NULL THEN {DIM} END AS dim FROM kept k LEFT JOIN inputs i ON i.document_id = k.document_id AND error_message IS NULL""")
def h4_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as arriving files, some of a kind that is refused: catalog rows with the passages of those that are ready."""
    inbox = scratch(spark, "inbox")
    d = _texts(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.expr(_NAMED).alias("path")), "document_id")
    content = F.encode("text", "UTF-8")
    d.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.length(content).cast("long").alias("length"), content.alias("content")).write.parquet(inbox)
    store_path, catalog_path = scratch(spark, "store"), scratch(spark, "catalog")
    arriving = spark.readStream.schema(streams.RAW).parquet(inbox)
    streams.stream_ingest(arriving, store_path, catalog_path, scratch(spark, "ingest"), T.OPTIONS, flawed, DIM, model="flawed", limit=LIMIT).awaitTermination()
    passages = store.read_store(spark, store_path).select(F.col("document_id").alias("path"), "chunk_index", "content", F.size("embedding").alias("dim"))
    return spark.read.parquet(catalog_path).select(F.col("document_id").alias("path"), "status", "error_message").join(passages, "path", "left")


@query(f"""WITH RECURSIVE {_PASSAGES}, {_OUTCOMES}
  SELECT c.document_id, sum(n)::BIGINT AS chunks_total, coalesce(sum(n) FILTER (problem IS NULL), 0)::BIGINT AS chunks_embedded, least(coalesce(sum(n) FILTER (problem IS NULL), 0) + 90, sum(n))::BIGINT AS working_until,
  CASE WHEN bool_or(problem IS NOT NULL) THEN 'embedding' ELSE 'saving' END AS stage FROM calls c JOIN outcomes o ON o.document_id = c.document_id WHERE o.error_message IS NULL OR o.error_message IN ('{BUSY}', '{embedding.BAD_RESPONSE}') GROUP BY 1""")
def d4_ledger_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress as the ledger has it after a run in which some batches have failed."""
    ledger = scratch(spark, "ledger")
    docs = ingest.text_documents(_texts(spark, sf_dir))
    got = ingest.ingested(docs, scratch(spark, "ingested"), T.OPTIONS, flawed, DIM, ledger, "flawed", LIMIT, waves=2)
    return embedding.ledger_progress(got.batches, ledger)
