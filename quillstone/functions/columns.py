"""Column expressions: text rules, similarity, snippets, estimates.

Lengths count code points.  White space is one explicit class wherever a rule says
"any white space", because the engines' own shorthands differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a character-class body, valid in Java and RE2 alike.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same without the blank; the first look tells most characters from it by one comparison.
ODD_WS = r"(?=[\t-\r\x{A0}\x{1680}-\x{FEFF}])[" + WS.replace(r"\r ", r"\r") + "]"
#: The same as characters.
WS_CHARACTERS = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
CHARS_PER_TOKEN = 4
SNIPPET_CHARS = 300
#: Words after which a full stop does not end a sentence (fixed values).
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|Fig|Figs|Eq|No|Vol|Inc|Ltd|Co|Corp|vs|etc|al|cf|pp|approx|e\\.g|i\\.e"


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x: Column | str) -> Column:
    return F.btrim(as_col(x), F.lit(WS_CHARACTERS))


def collapsed(x: Column | str) -> Column:
    """White-space runs as one blank, none at the ends; single blanks, which are most, are no match."""
    return F.trim(F.regexp_replace(as_col(x), rf"{ODD_WS}[{WS}]*| [{WS}]+", " "))


def normalised(x: Column | str) -> Column:
    """File text: no byte-order mark, line feeds only, no blanks at line ends, at most one empty line in a row, trimmed."""
    x = F.regexp_replace(as_col(x), r"^\x{FEFF}", "")
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+(\n|\z)", "$1")
    return trimmed(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def has_text(x: Column | str) -> Column:
    """Is there a letter or digit of any script?"""
    return F.coalesce(as_col(x).rlike(r"[\p{L}\p{N}]"), F.lit(False))


def title(filename: Column | str) -> Column:
    """A file name as a title: no last extension; underscores and bars are blanks."""
    x = F.regexp_replace(as_col(filename), r"\.[^.]+\z", "")
    return collapsed(F.regexp_replace(x, r"[_|]+", " "))


def passage_input(title_: Column | str, text: Column | str) -> Column:
    """What is embedded for a passage (fixed format)."""
    return F.concat(F.lit("title: "), F.coalesce(F.nullif(as_col(title_), F.lit("")), F.lit("none")), F.lit(" | text: "), as_col(text))


def question_input(question: Column | str) -> Column:
    """What is embedded for a question (fixed format)."""
    return F.concat(F.lit("task: search result | query: "), as_col(question))


def token_estimate(text: Column | str) -> Column:
    return F.ceil(F.length(as_col(text)) / CHARS_PER_TOKEN).cast("int")


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity in double precision; null if a vector is zero.  Norms may be passed if they are known."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.try_divide(dot(a, b), n)


def round4(x: Column | str) -> Column:
    """Four decimals, halves towards plus infinity."""
    return F.floor(as_col(x) * 10000 + 0.5) / 10000


def round_half_up(x: Column | str) -> Column:
    return F.floor(as_col(x) + 0.5)


def snippet(content: Column | str, limit: int = SNIPPET_CHARS) -> Column:
    """The first ``limit`` characters, cut at a blank if that keeps more than 60 % of them."""
    text = collapsed(content)
    cut = F.left(text, F.lit(limit))
    blank = limit - F.instr(F.reverse(cut), " ")  # characters before the last blank
    short = F.when((F.instr(cut, " ") > 0) & (blank > limit * 0.6), F.left(cut, blank)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(short), F.lit("…")))


def defused(text: Column | str) -> Column:
    """Tags that look like the prompt's own are made harmless."""
    return F.regexp_replace(as_col(text), r"(?i)<([\t\n\x0B\f\r ]*/?[\t\n\x0B\f\r ]*sources?\b)", "&lt;$1")


def attribute(value: Column | str) -> Column:
    x = as_col(value)
    for plain, escaped in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(plain), F.lit(escaped))
    return x


def without_markers(answer: Column | str) -> Column:
    """An answer as plain prose: citation markers go, with the blanks before them."""
    return F.regexp_replace(as_col(answer), r"[ \t]*\[[0-9]+(?:, *[0-9]+)*\]", "")
