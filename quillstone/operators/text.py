"""Text preparation: page lines to paragraphs, hyphens, pages to documents.

A document's pages are brought together once; its lines are then folded in order, with
the document's words at hand, by one function over Arrow batches: what a line is joined
to is all the text so far, so the fold carries state that no window over lines has.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.columns import has_text, normalised

NO_TEXT = "File contains no text"
#: A line shorter than this share of the page's longest line ends its paragraph.
SHORT_LINE = 0.7


def with_text(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with text, failures with ``error_message``)."""
    there = has_text(text)
    return docs.where(there), docs.where(~there).withColumn("error_message", F.lit(NO_TEXT))


def normalised_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, normalised(text))


def vocabulary(pages: DataFrame, document: str = "document_id", text: str = "text") -> DataFrame:
    """(document, word): the distinct lower-cased letter runs of each whole document.

    A page's distinct words stay one row until its document's pages are together.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\p{L}+)"), F.lit(1)))
    whole = pages.select(document, words.alias("_words")).groupBy(document).agg(F.array_distinct(F.flatten(F.collect_list("_words"))).alias("_words"))
    return whole.select(document, F.explode("_words").alias("word"))


def page_lines(pages: DataFrame, document: str = "document_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """One row per non-blank line, with the number of its paragraph within the page.

    A paragraph ends at a blank line, and after a line that is clearly shorter than the
    page's longest one unless it ends in a lower-case letter and a hyphen.
    """
    lines = pages.select(document, page, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "raw"))
    lines = lines.select(document, page, "line_no", F.trim(F.regexp_replace("raw", r"[\t ]+", " ")).alias("line"))
    of_page = Window.partitionBy(document, page)
    in_order = of_page.orderBy("line_no")
    ends = (F.length("line") < F.max(F.length("line")).over(of_page) * SHORT_LINE) & ~F.col("line").rlike(r"\p{Ll}-\z")
    lines = lines.withColumn("ends", (F.col("line") == "") | ends)
    before = F.coalesce(F.sum(F.col("ends").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("paragraph", before).where("line <> ''").drop("ends")


def line_fold() -> tuple[Callable, Callable]:
    """(unwrap, join) for one document's texts; made inside the workers."""
    import re
    from unicodedata import category

    import regex

    blanks, word, closes = re.compile(r"[\t ]+"), regex.compile(r"\p{L}+"), re.compile("[.!?:][\"'”’)\\]]?\\Z")

    def head(text: str) -> str:
        """The letters before a closing hyphen; empty if the text doesn't end in a lower-case letter and a hyphen."""
        if len(text) < 2 or text[-1] != "-" or category(text[-2]) != "Ll":
            return ""
        i = len(text) - 1
        while i and text[i - 1].isalpha():
            i -= 1
        return text[i:-1]

    def tail(text: str) -> str:
        """The letters that a text starts with; empty if the first is not in lower case."""
        if not text or category(text[0]) != "Ll":
            return ""
        return word.match(text)[0]

    class Words:
        """The lower-cased words of a document, looked for when they are first asked for."""

        def __init__(self, texts: list[str], known: set[str] | None = None):
            self.texts, self.known = texts, known

        def __contains__(self, x: str) -> bool:
            if self.known is None:
                self.known = {w for t in self.texts for w in word.findall(t.lower())}
            return x in self.known

    class Joined:
        """A text that grows line by line; it knows the word fragment at its end."""

        def __init__(self, words: Words):
            self.words, self.parts, self.head = words, [], ""

        def add(self, line: str, apart: bool = False) -> None:
            mine, start = head(line), ""
            if self.parts and apart:
                self.parts.append("\n\n")
            elif self.parts:
                start = tail(line) if self.head else ""
                if not start:
                    self.parts.append(" ")
                elif (self.head + start).lower() in self.words:
                    self.parts[-1] = self.parts[-1][:-1]
                    if len(mine) == len(line) - 1:  # the line is one fragment, which the word so far goes on into
                        mine = self.head + mine
            self.parts.append(line)
            self.head = mine

        def text(self) -> str:
            return "".join(self.parts)

    def unwrap(pages: list[str | None], known: list[str] | None = None) -> list[str | None]:
        words = Words([p for p in pages if p], None if known is None else set(known))
        out = []
        for page in pages:
            lines = [blanks.sub(" ", x).strip(" ") for x in (page or "").split("\n")]
            width = max(map(len, lines)) * SHORT_LINE
            done, now = [], Joined(words)
            for line in lines:
                if line:
                    now.add(line)
                if now.parts and (not line or (len(line) < width and not (line[-1] == "-" and len(line) > 1 and category(line[-2]) == "Ll"))):
                    done.append(now.text())
                    now = Joined(words)
            out.append("\n\n".join([*done, *([now.text()] if now.parts else [])]) or None)
        return out

    def join(pages: list[str | None], raw: list[str | None] | None = None, known: list[str] | None = None) -> str | None:
        pages = [p for p in pages if p]
        words = Words([p for p in (pages if raw is None else raw) if p], None if known is None else set(known))
        out = Joined(words)
        for page in pages:
            out.add(page, bool(out.parts and closes.search(out.parts[-1])))
        return out.text() if pages else None

    return unwrap, join


def by_document(pages: DataFrame, document: str = "document_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """(document, _pages): one row per document, with its (page, text) in order."""
    return pages.groupBy(document).agg(F.array_sort(F.collect_list(F.struct(page, text))).alias("_pages"))


def unwrapped_pages(pages: DataFrame, document: str = "document_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """(document, page, text): each page's hard-wrapped lines as paragraphs with empty lines between.

    A word split by a hyphen is rejoined if the document holds it whole; else the hyphen
    stays, without a blank; all other lines are joined by a blank.  A page without text
    (null or blank) has no row.
    """

    @F.pandas_udf("array<string>")
    def unwrapped(texts: pd.Series) -> pd.Series:
        unwrap, _ = line_fold()
        return pd.Series([unwrap(list(x)) for x in texts], dtype=object)

    rows = by_document(pages, document, page, text)
    rows = rows.select(document, F.col(f"_pages.{page}").alias("_nos"), unwrapped(F.col(f"_pages.{text}")).alias("_texts"))
    rows = rows.select(document, F.explode_outer(F.arrays_zip(F.col("_nos").alias("no"), F.col("_texts").alias("text"))).alias("_p"))
    return rows.select(document, F.col("_p.no").alias(page), F.col("_p.text").alias("text")).where("text IS NOT NULL")


def joined_pages(pages: DataFrame, words: DataFrame | None = None, document: str = "document_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """(document, text): non-empty pages in order.

    A page that ends in closing punctuation is followed by an empty line; any other goes
    on like a wrapped line.  ``words``: (document, word), where the vocabulary is not
    that of these pages.
    """

    @F.pandas_udf("string")
    def joined(texts: pd.Series, known: pd.Series) -> pd.Series:
        _, join = line_fold()
        return pd.Series([join(list(x), known=None if k is None else list(k)) for x, k in zip(texts, known, strict=True)], dtype=object)

    rows = by_document(pages.where(F.coalesce(F.col(text) != "", F.lit(False))), document, page, text)
    if words is None:
        rows = rows.withColumn("_words", F.lit(None).cast("array<string>"))
    else:
        rows = rows.join(words.groupBy(document).agg(F.collect_set("word").alias("_words")), document, "left").withColumn("_words", F.coalesce("_words", F.array().cast("array<string>")))
    return rows.select(document, joined(F.col(f"_pages.{text}"), "_words").alias("text")).where("text IS NOT NULL")


def extracted(pages: DataFrame, document: str = "document_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """(document, text): a document's page texts as one clean text, with the vocabulary of all its pages; null without text."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        unwrap, join = line_fold()
        return pd.Series([join(unwrap(list(x)), list(x)) for x in texts], dtype=object)

    return by_document(pages, document, page, text).select(document, clean(F.col(f"_pages.{text}")).alias("text"))
