"""Retrieval: exact cosine top-k inside each user's own library, and the relevance cut."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.columns import cosine, norm, round4, trimmed
from quillstone.operators import nearest

MAX_QUESTION_CHARS = 2000
DEFAULT_TOP_K, MAX_TOP_K = 5, 20
CANDIDATES = 8
#: Up to so many questions they are sent to all tasks (vectors of 768 doubles: about 60 MB); more are joined by user and salt.
BROADCAST_QUESTIONS, SALTS = 10_000, 32


@dataclass(frozen=True)
class Relevance:
    """When to skip a question, and which candidates to keep (fixed defaults)."""

    skip_below: float = 0.55
    floor: float = 0.50
    window: float = 0.10
    max_sources: int = 5


def cleaned_questions(questions: DataFrame, question: str = "question", top_k: str = "top_k") -> tuple[DataFrame, DataFrame]:
    """(valid questions, trimmed and with a default ``top_k``; rejected ones with ``error``).

    A table cannot tell a missing ``top_k`` from a null one: null means the default.
    """
    k_error = f"topK must be a whole number between 1 and {MAX_TOP_K}"
    asked = questions.withColumn("_raw", F.col(question)).withColumn(question, trimmed(question))
    error = (
        F.when(F.col("_raw").isNull(), "question is required and must be a string")
        .when(F.length(question) < 1, "question must not be empty")
        .when(F.length(question) > MAX_QUESTION_CHARS, f"Question is too long (max {MAX_QUESTION_CHARS:,} characters)")
        .when(F.col(top_k).isNotNull() & ((F.col(top_k) != F.floor(top_k)) | (F.col(top_k) < 1) | (F.col(top_k) > MAX_TOP_K)), k_error)
    )
    rows = asked.withColumn("error", error).drop("_raw")
    good = rows.where("error IS NULL").drop("error").withColumn(top_k, F.coalesce(F.col(top_k).cast("int"), F.lit(DEFAULT_TOP_K)))
    return good, rows.where("error IS NOT NULL")


def search_scope(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Passages that can be found: of ready documents, with a vector; with the owner and the file name."""
    ready = documents.where("status = 'ready'").select("document_id", "user_id", "filename")
    return chunks.drop("user_id", "filename").where("embedding IS NOT NULL").join(ready, "document_id")


def similarities(questions: DataFrame, scope: DataFrame) -> DataFrame:
    """(question_id, chunk_id, similarity, passage columns) for all passages of the asking user; zero vectors are left out."""
    asked = questions.select("question_id", "user_id", F.col("embedding").alias("_q")).withColumn("_qn", norm("_q"))
    passages = scope.withColumn("_cn", norm("embedding"))
    if asked.limit(BROADCAST_QUESTIONS + 1).count() <= BROADCAST_QUESTIONS:
        pairs = passages.join(F.broadcast(asked), "user_id")
    else:  # the passages of a large owner are dealt to SALTS tasks, each of which sees all of the owner's questions
        asked = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        passages = passages.withColumn("_salt", F.pmod(F.hash("chunk_id"), F.lit(SALTS)))
        pairs = passages.join(asked, ["user_id", "_salt"]).drop("_salt")
    pairs = pairs.withColumn("similarity", cosine("_q", "embedding", F.col("_qn"), F.col("_cn")))
    return pairs.where("similarity IS NOT NULL").drop("_q", "_qn", "_cn", "embedding")


def topk(question: list[float], scope: DataFrame, user_id, k: int = DEFAULT_TOP_K) -> DataFrame:
    """The ``k`` passages of one user nearest to one question vector."""
    if not 1 <= k <= MAX_TOP_K:
        raise ValueError(f"k must be between 1 and {MAX_TOP_K}")
    q = F.array(*[F.lit(float(x)) for x in question])
    found = scope.where(F.col("user_id") == user_id).withColumn("similarity", cosine(q, "embedding")).where("similarity IS NOT NULL")
    return found.drop("embedding").orderBy(F.desc("similarity"), "chunk_id").limit(k)


def topk_batch(questions: DataFrame, scope: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The ``k`` nearest passages of every question, with ``rank`` from 1; ties to the smaller chunk.

    Exact: tasks keep the ``k`` best of what they see, skipping groups of passages too
    far away to be among them.  Zero vectors, and those that are not finite, are left out.
    """
    few = questions.limit(BROADCAST_QUESTIONS + 1).count() <= BROADCAST_QUESTIONS
    near = nearest.near_broadcast(questions, scope, k) if few else nearest.near_shuffled(questions, scope, k)
    order = Window.partitionBy("question_id").orderBy(F.desc("similarity"), "chunk_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = F.broadcast(best) if few else best  # at most k rows of each question
    return best.join(scope.drop("embedding"), "chunk_id").select("question_id", *[c for c in scope.columns if c != "embedding"], "similarity", "rank")


def selected_sources(questions: DataFrame, candidates: DataFrame, rule: Relevance = Relevance()) -> tuple[DataFrame, DataFrame]:
    """(per question: skip_reason and best_similarity; sources with ``marker``, best first).

    No candidates or a best one that is too weak skip the question.  Else a source is
    at or above the floor and close enough to the best; the tolerance absorbs rounding.
    """
    best = candidates.groupBy("question_id").agg(F.max("similarity").alias("best_similarity"))
    reason = F.when(F.col("best_similarity").isNull(), "no_documents").when(F.col("best_similarity") < rule.skip_below, "below_threshold")
    verdicts = questions.select("question_id").join(best, "question_id", "left").withColumn("skip_reason", reason)
    of_question = Window.partitionBy("question_id")
    top = F.max("similarity").over(of_question)
    cut = F.greatest(F.lit(rule.floor), top - rule.window) - 1e-9
    kept = candidates.withColumn("_ok", (top >= rule.skip_below) & (F.col("similarity") >= cut)).where("_ok").drop("_ok")
    marker = F.row_number().over(of_question.orderBy(F.desc("similarity"), "chunk_id"))
    return verdicts, kept.withColumn("marker", marker).where(F.col("marker") <= rule.max_sources)


def retrieval_stats(questions: DataFrame, candidates: DataFrame, verdicts: DataFrame, sources: DataFrame) -> DataFrame:
    """Per question: candidates, sources_used, best_similarity (4 decimals), skip_reason."""
    n = candidates.groupBy("question_id").agg(F.count(F.lit(1)).alias("candidates"))
    used = sources.groupBy("question_id").agg(F.count(F.lit(1)).alias("sources_used"))
    rows = questions.select("question_id").join(n, "question_id", "left").join(used, "question_id", "left").join(verdicts, "question_id", "left")
    return rows.select("question_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("sources_used", F.lit(0)).alias("sources_used"), round4("best_similarity").alias("best_similarity"), "skip_reason")
