"""Admission of uploaded files: kind by extension and bytes, with a reason for each refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 10 * 1024 * 1024
#: Reasons (fixed values, shown to the user).
NOT_PDF = "File has a .pdf extension but is not a PDF"
BINARY = "File is not plain text (contains binary data)"
NOT_UTF8 = "Text file is not valid UTF-8"
UNSUPPORTED = "Unsupported file type. Upload a .pdf, .txt or .md file."
TOO_LARGE = "File is too large (max 10 MB)"
EMPTY = "File is empty"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of the files under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def extension(path: Column) -> Column:
    """The last extension in lower case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"[^/]*\z", 0), r"\.[^.]*\z", 0))


def judged(files: DataFrame) -> DataFrame:
    """``files`` with ``kind`` (pdf, text or null) and ``reject_reason`` (null for accepted files)."""
    ext = extension(F.col("path"))
    content = F.col("content")
    pdf = F.when(F.left(content, F.lit(5)) == F.lit(b"%PDF-"), None).otherwise(NOT_PDF)
    text = F.when(F.contains(content, F.lit(b"\x00")), BINARY).when(~F.is_valid_utf8(content.cast("string")), NOT_UTF8)
    reason = (
        F.when(F.col("length") > MAX_BYTES, TOO_LARGE)
        .when(F.col("length") == 0, EMPTY)
        .when(ext == ".pdf", pdf)
        .when(ext.isin(".txt", ".md"), text)
        .otherwise(UNSUPPORTED)
    )
    kind = F.when(ext == ".pdf", "pdf").when(ext.isin(".txt", ".md"), "text")
    return files.withColumn("reject_reason", reason).withColumn("kind", F.when(F.col("reject_reason").isNull(), kind))


def admit(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files."""
    found = judged(files)
    return found.where("reject_reason IS NULL").drop("reject_reason"), found.where("reject_reason IS NOT NULL")


def registered(files: DataFrame, filename: str = "filename") -> DataFrame:
    """New catalog rows: the name trimmed and cut, or ``untitled``; processing starts with extraction."""
    name = F.left(F.trim(F.col(filename)), F.lit(255))
    return (
        files.withColumn(filename, F.coalesce(F.nullif(name, F.lit("")), F.lit("untitled")))
        .withColumn("status", F.lit("processing"))
        .withColumn("stage", F.lit("extracting"))
        .withColumn("error_message", F.lit(None).cast("string"))
        .withColumn("chunks_total", F.lit(None).cast("int"))
        .withColumn("chunks_embedded", F.lit(0))
    )
