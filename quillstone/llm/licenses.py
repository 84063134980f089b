"""Licence scan: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.license_rules import GATE_PATTERN, GATE_WORDS, operands, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A stated expression: identifiers, ``OR``, ``AND``, ``WITH`` and brackets, to the end of what can be one (in lower case).
EXPRESSION = r"spdx-license-identifier:[ \t]*([ \t()0-9a-z.+-]*)"
#: What keeps an expression's words apart.
BETWEEN = r"[ \t()]+"
OPERATORS = ("or", "and", "with")
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def spaced_words(text: Column) -> Column:
    """The words of a text in lower case (A-Z only), each between two blanks of its own."""
    runs = F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATORS, "  ")
    inner = F.trim(runs)
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def gated(text: Column) -> Column:
    """Can the text hold a signature at all?"""
    lower = F.lower(text)
    found = text.rlike(GATE_PATTERN)
    for word in GATE_WORDS[::-1]:
        found = F.contains(lower, F.lit(word)) | found
    return found


def _words(x: Column) -> Column:
    return F.expr("0") + ((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("int")


def detections(spaced: Column) -> Column:
    """All matches of all rules whose keyword occurs: rule fields, place among the rule's matches, words before it since the last one, and words in it."""
    fields = "array<struct<rule: int, label: string, keyword: string, regex: string, priority: int, score: double, base: boolean>>"
    told = [{"rule": r.order, "label": r.label, "keyword": r.keyword, "regex": r.regex, "priority": r.priority, "score": r.score, "base": r.base} for r in rules()]
    table = F.from_json(F.lit(json.dumps(told)), fields)  # a constant: the optimizer reads it once

    def found(r: Column) -> Column:
        pieces = F.arrays_zip(F.split(spaced, r["regex"], -1).alias("gap"), F.regexp_extract_all(spaced, r["regex"], F.lit(0)).alias("hit"))
        return F.transform(
            F.filter(pieces, lambda p: p["hit"].isNotNull()),
            lambda p, i: F.struct(r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), r["score"].alias("score"), r["base"].alias("base"), i.alias("nth"), _words(p["gap"]).alias("gap"), _words(p["hit"]).alias("len")),
        )

    live = F.filter(table, lambda r: F.contains(spaced, F.concat(F.lit(" "), r["keyword"], F.lit(" "))))
    return F.flatten(F.transform(live, found))


def stated(text: Column) -> Column:
    """The labels of all known licences and exceptions in the text's licence expressions.

    An expression goes on while every second word is an operator, so prose behind an
    identifier is not read.  A full stop at a word's end is not part of it.
    """
    table = F.from_json(F.lit(json.dumps(operands())), "map<string, string>")  # a constant: the optimizer reads it once

    def measured(words: Column) -> Column:
        other = F.transform(words, lambda w, i: (i % 2 == 1) & ~w.isin(*OPERATORS))
        return F.struct(words.alias("words"), F.array_position(other, True).alias("stop"))  # 0 if there is none

    def labels(e: Column) -> Column:
        read = F.filter(e["words"], lambda w, i: (i % 2 == 0) & ((e["stop"] == 0) | (i < e["stop"])))
        return F.transform(F.array_distinct(read), lambda w: F.try_element_at(table, F.rtrim(w, F.lit("."))))

    # one array after the other, so that no part of an expression is worked out again for each of its words
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(EXPRESSION), F.lit(1))
    words = F.transform(found, lambda x: F.filter(F.split(x, BETWEEN), lambda w: w != ""))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(F.transform(words, measured), labels))))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan every whole text for licences.

    A rule is tried only where its keyword occurs, and only in texts that pass a
    coarse gate.  A detection that lies inside another one goes: of equal intervals
    the higher priority stays, then the earlier rule.  Base phrases always stay.
    In an SPDX licence expression every known operand and exception counts, not only
    the first one that the rules find.

    Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (of the best detection that stays, 1 with an operand of an expression; 0 without
    any) and n_kept, the signatures that stay.  Defined cases: a null text is empty; a text without words
    has empty labels; a very long text is scanned as a whole; repeated rows are scanned
    each; an empty table gives an empty result; other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(
        F.col(key).alias("doc_id"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_words"),
        F.when(gated(body), spaced_words(body)).alias("spaced"),
        F.when(F.contains(F.lower(body), F.lit("spdx-license-identifier:")), stated(body)).alias("stated"),
        F.monotonically_increasing_id().alias("_row"),  # read once only: one exchange below keeps a row's detections together
    )
    hits = read.withColumn("found", F.when(F.col("spaced").isNotNull(), detections(F.col("spaced"))))
    rows = hits.select("_row", "doc_id", "n_words", "stated", F.explode_outer("found").alias("d")).select("_row", "doc_id", "n_words", "stated", "d.*").repartition("_row")

    of_rule = Window.partitionBy("_row", "rule").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("len")).over(of_rule.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    outer = Window.partitionBy("_row").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(~F.col("base"), F.col("end"))).over(outer)
    judged = placed.withColumn("kept", F.col("rule").isNotNull() & (F.col("base") | F.coalesce(reach < F.col("end"), F.lit(True))))

    def labels(which: Column, more: Column | None = None) -> Column:
        found = F.collect_set(F.when(which, F.col("label")))
        return F.concat_ws(",", F.array_sort(found if more is None else F.array_union(found, more)))

    base = F.col("base") & F.col("rule").isNotNull()
    operand = F.coalesce(F.first("stated"), F.array().cast("array<string>"))
    return (
        judged.groupBy("_row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            labels(base).alias("base_labels"),
            labels(F.col("kept"), operand).alias("labels"),
            F.when(F.size(operand) > 0, 1.0).otherwise(F.coalesce(F.max(F.when(F.col("kept"), F.col("score"))), F.lit(0.0))).alias("score"),
            F.count(F.when(F.col("kept") & ~F.col("base"), 1)).alias("n_kept"),
        )
        .drop("_row")
    )


def oracle_sql() -> str:
    """The same scan in DuckDB's SQL."""
    values = ", ".join(f"({r.order}, '{r.label}', '{r.keyword}', '{r.regex}', {r.priority}, {r.score}::DOUBLE, {str(r.base).lower()})" for r in rules())
    known = ", ".join(f"('{word}', '{label}')" for word, label in operands().items())
    operators = ", ".join(f"'{x}'" for x in OPERATORS)
    words = "(length({0}) - length(replace({0}, ' ', ''))) // 2"
    return f"""
WITH rules(rule, label, keyword, re, priority, score, base) AS (VALUES {values}),
operands(word, label) AS (VALUES {known}),
numbered AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
expressions AS (SELECT rid, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{EXPRESSION}', 1)) AS expression FROM numbered),
listed AS (SELECT rid, row_number() OVER () AS of, list_filter(string_split_regex(expression, '{BETWEEN}'), lambda w: w <> '') AS words FROM expressions),
split AS (SELECT rid, of, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS nth FROM listed),
read AS (SELECT rid, word, nth, min(CASE WHEN nth % 2 = 0 AND word NOT IN ({operators}) THEN nth END) OVER (PARTITION BY of) AS stop FROM split),
stated AS (SELECT rid, list(DISTINCT label) AS more FROM read JOIN operands ON rtrim(read.word, '.') = operands.word WHERE nth % 2 = 1 AND coalesce(nth < stop, true) GROUP BY rid),
body AS (SELECT rid, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}', '  ', 'g'), ' ') AS inner_words FROM numbered),
docs AS (SELECT rid, doc_id, CASE WHEN inner_words = '' THEN '' ELSE ' ' || inner_words || ' ' END AS spaced FROM body),
hits AS (SELECT rid, rule, label, priority, score, base, spaced, string_split_regex(spaced, re) AS gaps, regexp_extract_all(spaced, re) AS found FROM docs, rules WHERE contains(spaced, ' ' || keyword || ' ') AND regexp_matches(spaced, re)),
each AS (SELECT rid, rule, label, priority, score, base, unnest(range(1, len(found) + 1)) AS nth, gaps, found FROM hits),
sized AS (SELECT rid, rule, label, priority, score, base, nth, {words.format("gaps[nth]")} AS gap, {words.format("found[nth]")} AS len FROM each),
ended AS (SELECT *, sum(gap + len) OVER (PARTITION BY rid, rule ORDER BY nth) AS stop FROM sized),
placed AS (SELECT *, stop - len AS start FROM ended),
judged AS (SELECT *, base OR coalesce(max(CASE WHEN NOT base THEN stop END) OVER (PARTITION BY rid ORDER BY start, stop DESC, priority DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < stop, true) AS kept FROM placed)
SELECT d.doc_id, any_value({words.format("spaced")})::BIGINT AS n_words, count(CASE WHEN base THEN 1 END)::BIGINT AS n_base,
  min(CASE WHEN base THEN start END)::BIGINT AS first_word, max(CASE WHEN base THEN start END)::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list(label) FILTER (kept), any_value(more)))), ','), '') AS labels,
  (CASE WHEN any_value(more) IS NOT NULL THEN 1.0 ELSE coalesce(max(CASE WHEN kept THEN score END), 0.0) END)::DOUBLE AS score, count(CASE WHEN kept AND NOT base THEN 1 END)::BIGINT AS n_kept
FROM docs d LEFT JOIN judged j ON d.rid = j.rid LEFT JOIN stated s ON d.rid = s.rid GROUP BY d.rid, d.doc_id"""
