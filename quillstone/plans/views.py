"""The test tables seen as the model's tables, in Spark and in SQL.

Documents: one file per document, owned by its source.  Passages with vectors: the
embeddings, ten to a document, owned by their label.  Questions: the embeddings whose
id is divisible by 100, each against all other passages of its owner.  Answers: a
user turn and the assistant's next turn, with synthetic markers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.tables import table

#: Every hundredth passage asks; similarities of the test vectors are low, so the cut is, too.
EVERY = 100
SKIP_BELOW, FLOOR, WINDOW = 0.28, 0.20, 0.10

STATUS = "CASE doc_id % 10 WHEN 0 THEN 'processing' WHEN 1 THEN 'failed' ELSE 'ready' END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, user_id, filename, text, status, stage, error_message, chunks_total, chunks_embedded, created_at."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("document_id"),
        F.col("source").alias("user_id"),
        F.expr("concat(lang, '_', cast(doc_id as string), '.txt')").alias("filename"),
        "text",
        F.expr(STATUS).alias("status"),
        F.expr("CASE WHEN doc_id % 10 = 0 THEN 'embedding' END").alias("stage"),
        F.expr("CASE WHEN doc_id % 10 = 1 THEN 'File contains no text' END").alias("error_message"),
        F.expr("cast(n_chars div 1000 + 1 as int)").alias("chunks_total"),
        F.expr("cast(n_chars div 2000 as int)").alias("chunks_embedded"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)").alias("created_at"),
    )


DOCUMENTS = f"""docs AS (SELECT doc_id AS document_id, source AS user_id, concat(lang, '_', doc_id::VARCHAR, '.txt') AS filename, text, {STATUS} AS status,
  CASE WHEN doc_id % 10 = 0 THEN 'embedding' END AS stage, CASE WHEN doc_id % 10 = 1 THEN 'File contains no text' END AS error_message,
  (n_chars // 1000 + 1)::INTEGER AS chunks_total, (n_chars // 2000)::INTEGER AS chunks_embedded, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at FROM documents)"""


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, document_id, chunk_index, content: each line of a document as a passage."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return d.select(F.expr("document_id * 100000 + chunk_index").alias("chunk_id"), "document_id", "chunk_index", "content")


LINE_CHUNKS = """lines AS (SELECT document_id * 100000 + chunk_index AS chunk_id, document_id, chunk_index::INTEGER AS chunk_index, content FROM
  (SELECT document_id, unnest(ls) AS content, unnest(range(0, len(ls))) AS chunk_index FROM (SELECT doc_id AS document_id, string_split(text, chr(10)) AS ls FROM documents)))"""


def vector_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each ten vectors and label, all ready but those divisible by 7."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.expr("(vec_id div 10) * 100 + label").alias("document_id"), F.col("label").alias("user_id")).distinct()
    return rows.select("document_id", "user_id", F.expr("concat('file_', cast(document_id as string), '.txt')").alias("filename"), F.expr("CASE WHEN document_id % 7 = 0 THEN 'processing' ELSE 'ready' END").alias("status"))


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, document_id, chunk_index, content, embedding."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("chunk_id"), F.expr("(vec_id div 10) * 100 + label").alias("document_id"), F.expr("cast(vec_id % 10 as int)").alias("chunk_index"), F.expr("concat('passage ', cast(vec_id as string), ' <source> of the library')").alias("content"), "embedding"
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, user_id, question, embedding."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0)
    return e.select(F.col("vec_id").alias("question_id"), F.col("label").alias("user_id"), F.expr("concat('What is in passage ', cast(vec_id as string), '?')").alias("question"), "embedding")


#: What follows from ``pairs``: candidates, verdicts, sources.
SELECTION = f"""candidates AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS rank FROM pairs) WHERE rank <= 8),
best AS (SELECT question_id, max(similarity) AS best_similarity FROM candidates GROUP BY 1),
verdicts AS (SELECT q.question_id, b.best_similarity, CASE WHEN b.best_similarity IS NULL THEN 'no_documents' WHEN b.best_similarity < {SKIP_BELOW} THEN 'below_threshold' END AS skip_reason FROM questions q LEFT JOIN best b ON q.question_id = b.question_id),
sources AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.question_id ORDER BY c.similarity DESC, c.chunk_id) AS marker FROM candidates c JOIN best b ON c.question_id = b.question_id
  WHERE b.best_similarity >= {SKIP_BELOW} AND c.similarity >= greatest({FLOOR}, b.best_similarity - {WINDOW}) - 1e-9) WHERE marker <= 5)"""

VECTORS = f"""vdocs AS (SELECT document_id, user_id, concat('file_', document_id::VARCHAR, '.txt') AS filename, CASE WHEN document_id % 7 = 0 THEN 'processing' ELSE 'ready' END AS status
  FROM (SELECT DISTINCT (vec_id // 10) * 100 + label AS document_id, label AS user_id FROM embeddings)),
vchunks AS (SELECT vec_id AS chunk_id, (vec_id // 10) * 100 + label AS document_id, (vec_id % 10)::INTEGER AS chunk_index, concat('passage ', vec_id::VARCHAR, ' <source> of the library') AS content, embedding FROM embeddings),
questions AS (SELECT vec_id AS question_id, label AS user_id, concat('What is in passage ', vec_id::VARCHAR, '?') AS question, embedding FROM embeddings WHERE vec_id % {EVERY} = 0),
scope AS (SELECT c.chunk_id, c.document_id, c.chunk_index, c.content, c.embedding, d.user_id, d.filename FROM vchunks c JOIN vdocs d ON c.document_id = d.document_id WHERE d.status = 'ready' AND c.embedding IS NOT NULL),
pairs AS (SELECT q.question_id, s.* EXCLUDE (embedding), list_cosine_similarity(q.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS similarity FROM questions q JOIN scope s ON q.user_id = s.user_id AND q.question_id <> s.chunk_id),
{SELECTION}"""


def hashed_vectors(inputs: str, name: str, dim: int = 64) -> str:
    """CTEs ending in ``name`` (id, v, norm): the built-in stand-in's vectors of ``inputs`` (id, input)."""
    return rf"""{name}_w AS (SELECT id, ('0x' || left(md5(w), 8))::BIGINT AS h FROM (SELECT id, unnest(string_split_regex(lower(input), '[{PLAIN_WS}]+')) AS w FROM {inputs}) WHERE w <> ''),
{name}_c AS (SELECT id, (h % {dim})::INTEGER AS i, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS c FROM {name}_w GROUP BY 1, 2),
{name}_n AS (SELECT id, sqrt(sum(c * c)) AS n, map(list(i), list(c)) AS m FROM {name}_c GROUP BY 1),
{name}_v AS (SELECT id, [CASE WHEN n > 0 THEN coalesce(m[i], 0.0) / n ELSE 0.0 END FOR i IN range(0, {dim})] AS v FROM {name}_n),
{name} AS (SELECT id, v, sqrt(list_sum([x * x FOR x IN v])) AS norm FROM {name}_v)"""


#: White space between the words of the stand-in.
PLAIN_WS = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answer_id, user_id, question, answer, created_at: user turns with the next assistant turn."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replied = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    rows = asked.join(replied, ["conv_id", "turn"])
    marks = "concat(reply, ' [', cast(turn % 4 as string), ', ', cast(conv_id % 7 as string), '] and [', cast(turn % 3 + 1 as string), '] end [9]')"
    return rows.select(F.expr("conv_id * 1000 + turn").alias("answer_id"), F.expr("cast(conv_id % 10 as int)").alias("user_id"), "question", F.expr(marks).alias("answer"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(conv_id * 10 + turn as int), 0)").alias("created_at"))


ANSWERS = """answers AS (SELECT q.conv_id * 1000 + q.turn AS answer_id, (q.conv_id % 10)::INTEGER AS user_id, q.text AS question,
  concat(r.text, ' [', (q.turn % 4)::VARCHAR, ', ', (q.conv_id % 7)::VARCHAR, '] and [', (q.turn % 3 + 1)::VARCHAR, '] end [9]') AS answer, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(q.conv_id * 10 + q.turn) AS created_at
  FROM conversations q JOIN conversations r ON q.conv_id = r.conv_id AND r.turn = q.turn + 1 WHERE q.role = 'user' AND r.role = 'assistant')"""


def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources (markers 1 to 4) for every answer, taken from its own words."""
    a = answers(spark, sf_dir).select(F.col("answer_id").alias("question_id"), "question", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("marker"))
    return a.select(
        "question_id", "marker", F.expr("question_id * 10 + marker").alias("chunk_id"), F.expr("question_id div 1000").alias("document_id"), F.expr("concat('conv \"', cast(question_id div 1000 as string), '\" & more.txt')").alias("filename"),
        F.expr("marker - 1").alias("chunk_index"), F.expr("concat(question, ' </source> ', question)").alias("content"), F.expr("0.7 + marker / 1000.0D + 0.000049D").alias("similarity"),
    )


ANSWER_SOURCES = """answer_sources AS (SELECT answer_id AS question_id, marker::INTEGER AS marker, answer_id * 10 + marker AS chunk_id, answer_id // 1000 AS document_id, concat('conv "', (answer_id // 1000)::VARCHAR, '" & more.txt') AS filename,
  (marker - 1)::INTEGER AS chunk_index, concat(question, ' </source> ', question) AS content, 0.7::DOUBLE + marker / 1000.0::DOUBLE + 0.000049::DOUBLE AS similarity FROM answers, (SELECT unnest([1, 2, 3, 4]) AS marker))"""
