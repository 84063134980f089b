"""Prompts, answers and checked citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.columns import WS, attribute, defused, round4, snippet, trimmed

#: Fixed texts and values.
REFUSAL = "I couldn't find the answer to that in your documents."
NO_DOCUMENTS = "You don't have any processed documents yet. Upload a document, then ask again."
BLOCKED = ("SAFETY", "RECITATION", "BLOCKLIST", "PROHIBITED_CONTENT", "SPII", "LANGUAGE")
DEFAULT_WAIT_MS, DAILY_QUOTA_MS = 20_000, 90_000
PROMPT_BLOCKED = "This question was blocked by the model's safety filters."
ANSWER_BLOCKED = "The answer was blocked by the model's safety filters."

#: A citation group: [1], [1, 2].  Ranges and words in brackets are none.
S = f"[{WS}]"
GROUP = rf"\[{S}*[0-9]+{S}*(?:,{S}*[0-9]+{S}*)*\]"
CITATION = "struct<marker: int, chunk_id: bigint, document_id: bigint, filename: string, chunk_index: int, similarity: double, snippet: string>"


def prompts(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(question_id, prompt): numbered sources in delimited blocks, the question after them."""
    block = F.concat(F.lit('<source id="'), F.col("marker").cast("string"), F.lit('" file="'), attribute("filename"), F.lit('">\n'), defused("content"), F.lit("\n</source>"))
    place = F.struct("marker", block.alias("block"))
    blocks = sources.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda b: b["block"]), "\n").alias("blocks"))
    text = F.concat(F.lit("<sources>\n"), F.col("blocks"), F.lit("\n</sources>\n\nQuestion: "), F.col("question"))
    return questions.join(blocks, "question_id").select("question_id", text.alias("prompt"))


#: Prompts of one batch to one raw response each: (text, finish_reason, block_reason).
Generate = Callable[[list[str]], list[tuple]]


def first_sentences(prompts_: list[str]) -> list[tuple]:
    """A stand-in for a model: the first words of the first two sources, each with its marker."""
    import re

    out = []
    for prompt in prompts_:
        bodies = re.findall(r'<source id="(\d+)"[^>]*>\n(.*?)\n</source>', prompt, re.S)[:2]
        out.append((" ".join(f"{' '.join(body.split()[:12])} [{n}]." for n, body in bodies), "STOP", None))
    return out


def generated(prompts_: DataFrame, generate: Generate = first_sentences) -> DataFrame:
    """(question_id, text, finish_reason, block_reason) from the caller's function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = generate(pdf["prompt"].tolist())
            yield pd.DataFrame({"question_id": pdf["question_id"], "text": [r[0] for r in rows], "finish_reason": [r[1] for r in rows], "block_reason": [r[2] for r in rows]})

    kind = prompts_.schema["question_id"].dataType.simpleString()
    return prompts_.select("question_id", "prompt").mapInPandas(run, f"question_id {kind}, text string, finish_reason string, block_reason string")


def canned_answers(verdicts: DataFrame) -> DataFrame:
    """(question_id, answer, model) of skipped questions: a fixed text, no model."""
    text = F.when(F.col("skip_reason") == "no_documents", NO_DOCUMENTS).otherwise(REFUSAL)
    return verdicts.where("skip_reason IS NOT NULL").select("question_id", text.alias("answer"), F.lit(None).cast("string").alias("model"))


def outcomes(raw: DataFrame) -> DataFrame:
    """``raw`` with trimmed ``text``, ``outcome`` (blocked, bad_response, ok), ``detail`` (what was blocked) and ``truncated``."""
    text = F.coalesce(trimmed("text"), F.lit(""))
    finish = F.coalesce("finish_reason", F.lit(""))
    outcome = (
        F.when(F.coalesce("block_reason", F.lit("")) != "", "blocked")
        .when(finish.isin(*BLOCKED), "blocked")
        .when(text == "", "bad_response")
        .when(~finish.isin("", "STOP", "MAX_TOKENS"), "bad_response")
        .otherwise("ok")
    )
    detail = F.when(F.coalesce("block_reason", F.lit("")) != "", PROMPT_BLOCKED).when(finish.isin(*BLOCKED), ANSWER_BLOCKED)
    return raw.withColumn("outcome", outcome).withColumn("detail", detail).withColumn("truncated", finish == "MAX_TOKENS").withColumn("text", text)


def failure_kinds(calls: DataFrame, status: str = "status", message: str = "message") -> DataFrame:
    """A call log with ``kind`` (rate-limit, transient, fatal), ``wait_ms`` and ``daily_quota``."""
    asked = F.regexp_extract(F.coalesce(F.col(message), F.lit("")), r'"retryDelay"\s*:\s*"([0-9]+(?:\.[0-9]+)?)s"', 1)
    delay = F.ceil(F.expr("try_cast(nullif(_asked, '') as double)") * 1000)
    kind = F.when(F.col(status) == 429, "rate-limit").when(F.col(status).isNull() | (F.col(status) >= 500), "transient").otherwise("fatal")
    rows = calls.withColumn("_asked", asked).withColumn("kind", kind)
    rows = rows.withColumn("wait_ms", F.when(F.col("kind") == "rate-limit", F.coalesce(delay, F.lit(DEFAULT_WAIT_MS))).cast("long"))
    return rows.withColumn("daily_quota", F.coalesce(F.col("wait_ms") > DAILY_QUOTA_MS, F.lit(False))).drop("_asked")


def groups(answer: Column) -> Column:
    """The citation groups of a text, in order."""
    return F.regexp_extract_all(answer, F.lit(rf"({GROUP})"), F.lit(1))


def numbers(group: Column) -> Column:
    """The numbers of a group; one too large for an integer counts as 0, which no source has."""
    inner = F.regexp_replace(group, rf"[\[\]{WS}]", "")
    return F.transform(F.split(inner, ","), lambda n: F.when(F.length(n) <= 9, n.try_cast("int")).otherwise(F.lit(0)))


def markers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """(question_id, group_no, marker): every number of every group."""
    rows = answers.select("question_id", F.posexplode(groups(F.col(answer))).alias("group_no", "group"))
    return rows.select("question_id", "group_no", F.explode(numbers(F.col("group"))).alias("marker"))


def checked_citations(answers: DataFrame, sources: DataFrame, answer: str = "answer") -> DataFrame:
    """(question_id, answer, cited, invalid): only numbers of real sources stay.

    Each group keeps its valid distinct numbers in their order; a group without any
    goes, with the blanks before it.
    """
    n = sources.groupBy("question_id").agg(F.max("marker").alias("n_sources"))
    rows = answers.join(n, "question_id", "left").withColumn("_n", F.coalesce("n_sources", F.lit(0)))
    rows = rows.withColumn("_groups", F.transform(groups(F.col(answer)), lambda g: numbers(g)))
    valid = lambda x: (x >= 1) & (x <= F.col("_n"))
    all_numbers = F.flatten("_groups")
    rows = rows.withColumn("cited", F.array_sort(F.array_distinct(F.filter(all_numbers, valid)))).withColumn("invalid", F.array_sort(F.array_distinct(F.filter(all_numbers, lambda x: ~valid(x)))))
    pieces = F.split(F.col(answer), GROUP, -1)

    def rendered(piece: Column, group: Column) -> Column:
        kept = F.array_distinct(F.filter(group, valid))
        shown = F.concat(piece, F.lit("["), F.array_join(F.transform(kept, lambda x: x.cast("string")), ", "), F.lit("]"))
        return F.when(group.isNull(), piece).when(F.size(kept) == 0, F.regexp_replace(piece, r"[ \t]+\z", "")).otherwise(shown)

    text = trimmed(F.array_join(F.zip_with(pieces, "_groups", rendered), ""))
    return rows.withColumn(answer, text).select("question_id", answer, "cited", "invalid")


def citation_records(checked: DataFrame, sources: DataFrame) -> DataFrame:
    """(question_id, citations): one struct per cited source, by marker."""
    each = checked.select("question_id", F.explode("cited").alias("marker")).join(sources, ["question_id", "marker"])
    record = F.struct(
        F.col("marker").cast("int").alias("marker"), "chunk_id", "document_id", "filename", F.col("chunk_index").cast("int").alias("chunk_index"), round4("similarity").alias("similarity"), snippet("content").alias("snippet")
    )
    return each.groupBy("question_id").agg(F.array_sort(F.collect_list(record)).alias("citations"))


def availability(history: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(answer_id, user_id, marker, chunk_id, available) for each stored citation.

    A citation is available if its chunk is still in the same user's documents.  Stored
    JSON that is not an array has no citations.
    """
    is_array = F.ltrim(F.col("citations")).startswith("[")
    kind = "array<struct<marker: int, chunk_id: bigint>>"
    rows = history.select("answer_id", "user_id", F.explode(F.when(is_array, F.from_json("citations", kind))).alias("c")).select("answer_id", "user_id", "c.marker", "c.chunk_id")
    owned = chunks.select("chunk_id", "document_id").join(documents.select("document_id", "user_id"), "document_id").select("chunk_id", "user_id").distinct().withColumn("available", F.lit(True))
    return rows.join(owned, ["chunk_id", "user_id"], "left").withColumn("available", F.coalesce("available", F.lit(False)))


def finished(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers to save, failures): answered or skipped questions are saved, nothing of the others."""
    done = F.col("outcome").isin("ok", "skipped")
    return answers.where(done), answers.where(~done)


#: code, status, message, seconds until a retry, worth a log line (fixed values)
FAILURES = [
    ("rate_limited", 503, "{0} is busy right now. Try again in a moment.", 30, False),
    ("quota_exhausted", 503, "The daily {1} quota has been reached. Try again tomorrow.", None, True),
    ("unavailable", 503, "{0} is temporarily unavailable. Try again later.", None, True),
    ("blocked", 422, None, None, True),
    ("cancelled", 503, None, None, False),
    ("rejected", 502, "{0} failed because of a problem with the AI service.", None, True),
    ("bad_response", 502, "{0} failed because of a problem with the AI service.", None, True),
    ("too_large", 502, "{0} failed because of a problem with the AI service.", None, True),
]


def known_failures(spark: SparkSession, action: str = "Answering") -> DataFrame:
    """(code, http_status, message, retry_after_seconds, log): what a user is told of each failure."""
    rows = [(c, s, m and m.format(action, action.lower()), r, log) for c, s, m, r, log in FAILURES]
    return spark.createDataFrame(rows, "code string, http_status int, message string, retry_after_seconds int, log boolean")


def failure_report(failures: DataFrame, action: str = "Answering") -> DataFrame:
    """Per failure code: class, text (null: the failure's own), retry hint, whether to log it, and how many."""
    known = known_failures(failures.sparkSession, action)
    return failures.groupBy("code").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(known), "code")  # 8 rows


def unanswered(rejected: DataFrame, failures: DataFrame, action: str = "Answering") -> DataFrame:
    """(question_id, code, http_status, message, retry_after_seconds, log) of all questions without an answer.

    ``rejected``: question_id and ``error``, for the asker to mend (``invalid``, 400);
    ``failures``: question_id, ``outcome`` and ``detail``, the failure's own text.
    """
    invalid = rejected.selectExpr("question_id", "'invalid' AS code", "400 AS http_status", "error AS message", "cast(null AS int) AS retry_after_seconds", "false AS log")
    told = failures.withColumnRenamed("outcome", "code").join(F.broadcast(known_failures(failures.sparkSession, action)), "code")
    failed = told.select("question_id", "code", "http_status", F.coalesce("message", "detail").alias("message"), "retry_after_seconds", "log")
    return invalid.unionByName(failed)
