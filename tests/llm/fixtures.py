"""Small documents with the awkward rows that every operator must take."""

import random

#: Columns beyond those of documents, with names that the operators use themselves.
CLASHING = (
    "digest string, node int, score string, labels int, rate int, copy int, first_id int, row_no int, lang_pred int, spans int, doc int, item_id int, _id string, _digest int, _source string, _rate int, _docs int, "
    "_share int, _row int, row int, name int, of int, id int, key int, of_source int, text_md5 int, n_copies string, shuffle_key string, kept int, class_id int, found int, shared int, bucket int, held_out int"
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, words: str = "abcdefghij") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(words) for _ in range(r.randint(2, 7))) for _ in range(n))


def rows():
    base, other = prose(1, 120), prose(2, 150)
    shared = prose(3, 60)
    words = base.split()
    near = " ".join([*words[:50], "changed", *words[51:]])
    texts = [
        base, base, near, other, prose(4, 30) + " " + shared + " " + prose(5, 30), shared + " " + prose(6, 80), other + "\n\n" + other,
        None, "", "   \t\n ", "one", "two words", "x" * 3000, prose(7, 5000), "*** 123 !!!", prose(8, 49), prose(9, 50), prose(9, 50), "é ß 漢字   😀 " * 20,
    ]
    out = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[0], (None, base, None, None, None), (None, None, None, None, None), (None, prose(10, 60) + " " + shared, "en", "s1", 9)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def clashing(spark):
    """The same documents with extra columns."""
    from pyspark.sql import functions as F

    names = [x.split() for x in CLASHING.split(", ")]
    return documents(spark).select("*", *[F.lit("7").cast(kind).alias(name) for name, kind in names])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
