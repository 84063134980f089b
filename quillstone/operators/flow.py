"""Questions to checked answers, as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.columns import question_input
from quillstone.operators import answers as A
from quillstone.operators import embedding
from quillstone.operators import retrieval as R


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back, so that its branches compute it once."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def answered_questions(
    questions: DataFrame, scope: DataFrame, folder: str, embed: embedding.EmbedBatch | None = None, generate: A.Generate = A.first_sentences, rule: R.Relevance = R.Relevance(), dim: int = embedding.DIMENSIONS
) -> tuple[DataFrame, DataFrame]:
    """(answers to save, failures) of clean questions (question_id, user_id, question).

    Questions get vectors, candidates and sources; a question without a source good
    enough gets a fixed text; the others go to ``generate``, whose answers keep only
    citations of sources that were given.  Of a question whose vector or answer failed
    nothing is saved: it is among the failures, with its ``outcome`` and ``detail``.  Vectors,
    candidates and responses are written to ``folder`` once.
    """
    vectors = written(embedding.embedded(questions.withColumn("input", question_input("question")), embed, dim=dim).drop("input"), f"{folder}/questions")
    good = embedding.well_formed("embedding", dim)
    asked, unmeasured = vectors.where(good), vectors.where(~good)
    candidates = written(R.topk_batch(asked, scope), f"{folder}/candidates")
    verdicts, sources = R.selected_sources(asked, candidates, rule)
    responses = written(A.generated(A.prompts(asked, sources), generate), f"{folder}/responses")
    answered, failed = A.finished(A.outcomes(responses))
    checked = A.checked_citations(answered.select("question_id", F.col("text").alias("answer")), sources)
    canned = A.canned_answers(verdicts).select("question_id", "answer", F.expr("cast(array() as array<int>)").alias("invalid"))
    given = checked.select("question_id", "answer", "invalid").unionByName(canned)
    stats = R.retrieval_stats(asked, candidates, verdicts, sources)
    rows = asked.select("question_id", "user_id", "question").join(given, "question_id").join(A.citation_records(checked, sources), "question_id", "left").join(stats, "question_id")
    none = F.expr(f"cast(array() as array<{A.CITATION}>)")
    saved = rows.withColumn("citations", F.coalesce("citations", none)).withColumn("answered", F.size("citations") > 0)
    failures = failed.select("question_id", "outcome", "detail").unionByName(unmeasured.select("question_id", F.lit("bad_response").alias("outcome"), F.lit(None).cast("string").alias("detail")))
    return saved, failures
