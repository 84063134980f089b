"""Worked examples of the operators' rules, and their edge cases."""

import datetime as dt
import json
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import columns as C
from quillstone.operators import admission, answers, catalog, chunking, embedding, flow, ingest, nearest, retrieval, text, usage
from quillstone.plans import registry
from quillstone.sources import files, store
from quillstone.streaming import streams
from tests import oracle


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# --- text ---------------------------------------------------------------------------


def test_normalised_text(spark):
    assert one(spark, C.normalised(F.lit("﻿a  \r\nb\t\r\r\n\n\n\nc \n"))) == "a\nb\n\nc"


def test_a_vocabulary_shuffles_a_row_for_a_page_not_for_a_word(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "One two ONE"), ("a", 2, "two three"), ("b", 1, "one"), ("b", 2, None), ("c", 1, "1 2"), (None, 1, "x"), (None, 2, "X y")], "document_id string, page_no int, text string")
    words = text.vocabulary(pages)
    assert values(words) == sorted([("a", "one"), ("a", "two"), ("a", "three"), ("b", "one"), (None, "x"), (None, "y")], key=repr)
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # words are made rows after the only aggregate
    assert plan.count("Aggregate") == 1


def test_titles(spark):
    got = [one(spark, C.title(F.lit(x))) for x in ("My_long__file.v2.pdf", "a|b.txt", ".txt", "plain")]
    assert got == ["My long file.v2", "a b", "", "plain"]


def test_pages_are_unwrapped_and_joined(spark):
    pages = spark.createDataFrame(
        [
            ("a", 1, "This long line is split infor-\nmation is at its end here ok\nShort.\n\nthe soft-\nware x information"),
            ("a", 2, ""),
            ("a", 3, "goes on (here).\nA"),
            ("a", 4, "Last"),
            ("b", 1, None),
        ],
        "document_id string, page_no int, text string",
    )
    clean = {(r.document_id, r.page_no): r.text for r in text.unwrapped_pages(pages).collect()}
    assert clean["a", 1] == "This long line is split information is at its end here ok Short.\n\nthe soft-ware x information"
    rows = spark.createDataFrame([(k[0], k[1], v) for k, v in clean.items()], pages.schema)
    assert text.joined_pages(rows, text.vocabulary(pages)).where("document_id = 'a'").first().text.endswith("x information goes on (here). A Last")


def test_words_split_between_pages_are_looked_up_in_their_document(spark):
    pages = spark.createDataFrame([("a", 1, "An infor-"), ("a", 2, ""), ("a", 3, "mation, or INFORMATION."), ("b", 1, "infor-"), ("b", 2, "mation")], "document_id string, page_no int, text string")
    assert {r.document_id: r.text for r in text.joined_pages(pages).collect()} == {"a": "An information, or INFORMATION.", "b": "infor-mation"}


def test_a_line_joins_the_text_so_far(spark):
    """A line that is one word fragment goes on in the word before it."""
    pages = spark.createDataFrame(
        [("a", 1, "An infor-\nma-\ntion, or information, infor\nma, informa"), ("a", 2, "Short.\n\n x-\ny\n" + "w" * 9), ("b", 1, "infor-\nma-\ntion"), ("c", 1, None), ("c", 2, " \n\t"), ("d", 1, "a-"), ("d", 2, "É-\né-"), ("d", 3, "-\n-")],
        "document_id string, page_no int, text string",
    )
    got = {(r.document_id, r.page_no): r.text for r in text.unwrapped_pages(pages).collect()}
    assert got == {("a", 1): "An information, or information, infor ma, informa", ("a", 2): "Short.\n\nx-y\n\n" + "w" * 9, ("b", 1): "infor-ma-tion", ("d", 1): "a-", ("d", 2): "É- é-", ("d", 3): "- -"}
    whole = {r.document_id: r.text for r in text.extracted(pages).collect()}
    assert whole == {"a": got["a", 1] + " " + got["a", 2], "b": "infor-ma-tion", "c": None, "d": "a- É- é- - -"}
    assert text.extracted(pages.limit(0)).count() == text.unwrapped_pages(pages.limit(0)).count() == text.joined_pages(pages.limit(0)).count() == 0


def test_a_document_is_chunked_without_an_exchange(spark):
    df = spark.createDataFrame([(1, "A. b"), (2, None)], "document_id int, text string")
    assert "Exchange" not in chunking.chunks(df)._jdf.queryExecution().executedPlan().toString()
    pages = df.withColumn("page_no", F.lit(1))
    assert text.extracted(pages)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_packing_by_brute_force():
    """Each packed range against the rules, stated once more over all candidates of a step."""
    import random

    import numpy as np

    options = chunking.ChunkOptions(target=20, max=30, overlap=5, min=8)
    target, longest, overlap, least = options.chars()
    draw = random.Random(3)
    for n in [0, 1, 2, 3, *range(4, 60)]:
        lengths, gaps = [draw.choice([1, 5, 9, 30, 70, 119]) for _ in range(n)], [draw.choice([0, 1, 2]) for _ in range(n)]
        size = lambda a, b: sum(lengths[a : b + 1]) + sum(gaps[a + 1 : b + 1])  # noqa: B023, E731
        got = chunking.packed(np.array(lengths, np.int64), np.array(gaps, np.int64), options)
        new = [0, *[e + 1 for _, e, _ in got[:-1]]]
        assert [e for _, e, _ in got] == sorted({e for _, e, _ in got}) and (not n or got[-1][1] == n - 1)
        for i, (s, e, o) in enumerate(got):
            assert o == (size(s, new[i] - 1) if s < new[i] else 0) and s <= new[i] <= e
            merged = i == len(got) - 1 and any(size(s, k) > target and size(s, k - 1) >= least for k in range(new[i] + 1, e + 1))
            assert merged or size(s, e) <= longest or s == e
            if i:
                first = got[i - 1][0]
                fits = [k for k in range(max(first + 1, new[i] - overlap // 2 - 2), new[i]) if (size(k, new[i] - 1) <= overlap or (k == new[i] - 1 and lengths[k] <= 2 * overlap)) and size(k, new[i]) <= longest]
                assert s == min(fits, default=new[i])
            if i < len(got) - 1:
                assert size(s, e + 1) > longest or (size(s, e + 1) > target and size(s, e) >= least)


def test_documents_without_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, " *** "), (3, None), (4, "٣")], "id int, text string")
    good, bad = text.with_text(df)
    assert [r.id for r in good.collect()] == [1, 4] and {r.id for r in bad.collect()} == {2, 3}


# --- passages -----------------------------------------------------------------------


def chunks_of(spark, body, **sizes):
    df = spark.createDataFrame([(1, body)], "document_id int, text string")
    return [(r.content, r.overlap_chars) for r in chunking.chunks(df, chunking.ChunkOptions(**sizes)).orderBy("chunk_index").collect()]


def _sentences_by_rules(text: str) -> list[str]:
    """Unicode's sentence rules, place by place, with the property as another library has it; then trimmed and abbreviations glued."""
    kinds = {k: regex.compile(rf"\p{{SB={k}}}") for k in ("ATerm", "STerm", "Close", "Sp", "Sep", "SContinue", "Numeric", "Upper", "Lower", "OLetter", "Extend", "Format")}
    kind = [next((k for k, p in kinds.items() if p.match(c)), "Other") for c in text]
    seen = [i for i, k in enumerate(kind) if k not in ("Extend", "Format") or i == 0 or kind[i - 1] == "Sep"]
    cuts = []
    for i in range(1, len(text)):
        if kind[i - 1] == "Sep":
            cuts.append(i)
        elif i in seen:
            before, after = [kind[j] for j in seen if j < i], [kind[j] for j in seen if j >= i]
            k = len(before)
            k -= before[:k][-1:] == ["Sep"]
            while k and before[k - 1] == "Sp":
                k -= 1
            blanks = len(before) - k
            while k and before[k - 1] == "Close":
                k -= 1
            if not k or before[k - 1] not in ("ATerm", "STerm"):
                continue
            closes, full_stop = len(before) - blanks - k, before[k - 1] == "ATerm"
            ahead = next((x for x in after if x in ("OLetter", "Upper", "Lower", "Sep", "ATerm", "STerm")), None)
            bare = full_stop and not blanks and not closes
            if (bare and after[0] == "Numeric") or (bare and k > 1 and before[k - 2] in ("Upper", "Lower") and after[0] == "Upper") or (full_stop and ahead == "Lower"):
                continue
            if after[0] in ("SContinue", "ATerm", "STerm", "Sp", "Sep") or (after[0] == "Close" and not blanks):
                continue
            cuts.append(i)
    out, pending = [], ""
    for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
        if part := text[a:b].strip(" "):
            pending = f"{pending} {part}" if pending else part
            if not regex.search(rf"(?:^|[\s(])(?:{C.ABBREVIATIONS})\.$", pending):
                out.append(pending)
                pending = ""
    return out + ([pending] if pending else [])


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Pi is 3.14. Yes.", ["Pi is 3.14.", "Yes."]),
        ("The U.S.A. and more", ["The U.S.A. and more"]),
        ("It ended.Then more", ["It ended.Then more"]),
        ("He left.) (Then so did I.", ["He left.)", "(Then so did I."]),
        ("Stop! and go? on.", ["Stop!", "and go?", "on."]),
        ("\u4ed6\u6765\u4e86\u3002\u6211\u8d70\u4e86\uff01\u300d\u597d", ["\u4ed6\u6765\u4e86\u3002", "\u6211\u8d70\u4e86\uff01\u300d", "\u597d"]),
        ("Wait... what? No... Now.", ["Wait... what?", "No...", "Now."]),
        ("So! - she said", ["So! - she said"]),
        ("See no. 5 or No. 5. Or (cf. Vol. 2)", ["See no. 5 or No. 5.", "Or (cf. Vol. 2)"]),
        ("No.\u65e5 x", ["No. \u65e5 x"]),
        ("a\x85b.\x85C", ["a\x85", "b.\x85", "C"]),
        ("Ends. \u0301 Next", ["Ends. \u0301", "Next"]),
        ("", []),
    ],
)
def test_sentences_end_where_the_rules_say(spark, text, expected):
    assert _sentences_by_rules(text) == expected
    assert spark.createDataFrame([(text,)], "p string").select(chunking.sentence_array(F.col("p"))).first()[0] == expected


def test_sentences_of_random_texts_equal_the_rules_stepped_through(spark):
    draw, alphabet = random.Random(5), [*"aBc.1?! ,:-)\"(", " ", ".", ". ", "Dr", "No.", "\u0301", "\u200b", "\u3002", "\u65e5", "\u00ab", "\u2019", "\x85", "\uff0e", "\u0589", "\u10d0", "\u01c5", "\u0663", "\u2014"]
    texts = sorted({regex.sub(" +", " ", "".join(draw.choices(alphabet, k=draw.randint(1, 14)))).strip(" ") for _ in range(6_000)})
    rows = spark.createDataFrame([(x,) for x in texts], "p string").select("p", chunking.sentence_array(F.col("p")).alias("s")).collect()
    assert not [(r.p, r.s, _sentences_by_rules(r.p)) for r in rows if r.s != _sentences_by_rules(r.p)][:5]


def test_a_long_run_of_stops_and_closing_marks_is_marked_in_one_pass(spark):
    text = "x" + ".)" * 200_000 + " Y"
    assert [len(x) for x in spark.createDataFrame([(text,)], "p string").select(chunking.sentence_array(F.col("p"))).first()[0]]


def test_abbreviations_do_not_end_sentences(spark):
    df = spark.createDataFrame([(1, "Dr. Smith came, e.g. by car. See Fig. 3 (etc.) now. No. that is it! x")], "document_id int, text string")
    got = [r.sentence for r in chunking.sentences(chunking.paragraphs(df)).orderBy("sentence_no").collect()]
    assert got == ["Dr. Smith came, e.g. by car.", "See Fig. 3 (etc.) now.", "No. that is it!", "x"]


def test_chunks_keep_sizes_and_overlap(spark):
    body = "\n\n".join(" ".join(f"Sentence number {p}-{s} has a number of words in it." for s in range(8)) for p in range(10))
    got = chunks_of(spark, body, target=100, max=140, overlap=20, min=30)
    assert len(got) > 5 and all(len(c) <= 560 for c, _ in got)
    for (before, _), (after, n) in zip(got, got[1:], strict=False):
        assert before.endswith(after[:n])
    assert "".join(c[n:] for c, n in got).replace("\n", " ").replace("  ", " ").split() == body.split()


def test_giant_words_and_tails(spark):
    got = chunks_of(spark, "Start here. " + "x" * 500 + " end.", target=20, max=30, overlap=2, min=5)
    assert "".join(c[n:] for c, n in got).replace(" ", "") == ("Start here. " + "x" * 500 + " end.").replace(" ", "")
    assert len(chunks_of(spark, "A long sentence of many words that fills the chunk up now. Two more.", target=20, max=40, overlap=2, min=5)) == 1
    assert chunks_of(spark, "", target=20, max=40, overlap=2, min=5) == [] and chunks_of(spark, None) == []


def test_chunk_options_are_checked():
    with pytest.raises(ValueError):
        chunking.ChunkOptions(target=10, max=5)
    with pytest.raises(ValueError):
        chunking.ChunkOptions(overlap=600)


# --- embedding and retrieval --------------------------------------------------------


def test_vectors_are_checked(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "item_id string")
    got = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", [1.0, float("nan")])], "item_id string, embedding array<double>")
    good, bad = embedding.checked(asked, got, "item_id", 2)
    assert values(good.select("item_id")) == [("a",)]
    assert values(bad) == [("b", "wrong size"), ("c", "not finite"), ("d", "missing")]


def test_embedding_calls_are_bounded(spark):
    sizes = spark.sparkContext.accumulator(0)

    def embed(texts):
        assert len(texts) <= 90
        sizes.add(len(texts))
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(250)], "id int, input string")
    out = embedding.embedded(rows, embed, dim=1).collect()
    assert len(out) == 250 and sizes.value == 250 and all(r.embedding == [len(r.input)] for r in out)


def test_cosine(spark):
    assert one(spark, C.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))) == 0.0
    assert one(spark, C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


@pytest.mark.parametrize(
    "sims, reason, kept",
    [
        ([], "no_documents", []),
        ([0.5424], "below_threshold", []),
        ([0.55, 0.51], None, [0.55, 0.51]),
        ([0.7736, 0.7421, 0.4998], None, [0.7736, 0.7421]),
        ([0.8, 0.7, 0.6999], None, [0.8, 0.7]),
        ([0.80, 0.79, 0.78, 0.77, 0.76, 0.75, 0.74], None, [0.80, 0.79, 0.78, 0.77, 0.76]),
    ],
)
def test_relevance_rule(spark, sims, reason, kept):
    q = spark.createDataFrame([(1,)], "question_id int")
    c = spark.createDataFrame([(1, i, s) for i, s in enumerate(sims)], "question_id int, chunk_id int, similarity double")
    verdicts, sources = retrieval.selected_sources(q, c)
    assert verdicts.first().skip_reason == reason
    assert [r.similarity for r in sources.orderBy("marker").collect()] == kept


def test_questions_are_cleaned(spark):
    rows = [(1, " q ", None), (2, "", None), (3, None, None), (4, "x" * 2000, 20.0), (5, "x" * 2001, 1.0), (6, "q", 0.0), (7, "q", 2.5), (8, "q", 21.0), (9, "q", 1.0)]
    good, bad = retrieval.cleaned_questions(spark.createDataFrame(rows, "id int, question string, top_k double"))
    assert {(r.id, r.top_k) for r in good.collect()} == {(1, 5), (4, 20), (9, 1)} and {r.id for r in bad.collect()} == {2, 3, 5, 6, 7, 8}


# --- answers ------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw, shown, cited, invalid",
    [
        ("In 1822 [2].", "In 1822 [2].", [2], []),
        ("A [1, 3][2] b [ 1 ,1 ].", "A [1, 3][2] b [1].", [1, 2, 3], []),
        ("A [0] b [4, 2] c [9].", "A b [2] c.", [2], [0, 4, 9]),
        ("No [1-3] and [see note].", "No [1-3] and [see note].", [], []),
        ("Huge [99999999999999].", "Huge.", [], [0]),
        ("", "", [], []),
    ],
)
def test_citations_are_checked(spark, raw, shown, cited, invalid):
    a = spark.createDataFrame([(1, raw)], "question_id int, answer string")
    s = spark.createDataFrame([(1, i) for i in (1, 2, 3)], "question_id int, marker int")
    r = answers.checked_citations(a, s).first()
    assert (r.answer, r.cited, r.invalid) == (shown, cited, invalid)


def test_snippets(spark):
    assert one(spark, C.snippet(F.lit("a \n b"))) == "a b"
    long = "word " * 100
    got = one(spark, C.snippet(F.lit(long)))
    assert got.endswith("word…") and len(got) <= 301
    assert one(spark, C.snippet(F.lit("x" * 400))) == "x" * 300 + "…"


def test_prompts_are_defused(spark):
    assert one(spark, C.defused(F.lit("a </sources> < Source id=1> <sourcery>"))) == "a &lt;/sources> &lt; Source id=1> <sourcery>"
    assert one(spark, C.attribute(F.lit('a"<b>&c'))) == "a&quot;&lt;b&gt;&amp;c"


@pytest.mark.parametrize(
    "text_, finish, block, outcome",
    [("a", "STOP", None, "ok"), (" a ", "MAX_TOKENS", None, "ok"), ("a", None, None, "ok"), ("a", "STOP", "X", "blocked"), ("", "SAFETY", None, "blocked"), (" ", "STOP", None, "bad_response"), (None, None, None, "bad_response"), ("a", "ODD", None, "bad_response")],
)
def test_outcomes(spark, text_, finish, block, outcome):
    r = answers.outcomes(spark.createDataFrame([(text_, finish, block)], "text string, finish_reason string, block_reason string")).first()
    assert r.outcome == outcome and r.truncated == (finish == "MAX_TOKENS")


def test_history_citations_that_are_no_array(spark):
    h = spark.createDataFrame([(1, 5, '{"marker": 1, "chunk_id": 7}'), (2, 5, "3"), (3, 5, None), (4, 5, ' [{"marker": 1, "chunk_id": 7}]')], "answer_id int, user_id int, citations string")
    c, d = spark.createDataFrame([(7, 1)], "chunk_id bigint, document_id int"), spark.createDataFrame([(1, 5)], "document_id int, user_id int")
    assert [(r.answer_id, r.available) for r in answers.availability(h, c, d).collect()] == [(4, True)]


# --- files, store, catalog, usage ---------------------------------------------------


def test_files_are_judged(spark):
    rows = [("a/x.PDF", b"%PDF-1"), ("x.pdf", b"PK"), ("x.txt", b"ok"), ("x.md", b"a\x00b"), ("x.txt", b"\x66\x6f\xff\x6f"), ("x", b"ok"), ("x.docx", b"ok"), ("x.txt", b"")]
    df = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, length bigint, content binary")
    got = [(r.kind, r.reject_reason) for r in files.judged(df).collect()]
    assert got == [("pdf", None), (None, files.NOT_PDF), ("text", None), (None, files.BINARY), (None, files.NOT_UTF8), (None, files.UNSUPPORTED), (None, files.UNSUPPORTED), (None, files.EMPTY)]
    big = spark.createDataFrame([("x.txt", files.MAX_BYTES + 1, b"x")], df.schema)
    assert files.judged(big).first().reject_reason == files.TOO_LARGE


def test_store_replaces_whole_documents(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read_store(spark, path) is None
    first = spark.createDataFrame([(d, i, f"old {d} {i}") for d in range(20) for i in range(3)], "document_id int, chunk_index int, content string")
    assert store.write_replaced(spark, path, first) == 0
    again = spark.createDataFrame([(3, 0, "new"), (30, 0, "new")], first.schema)
    for number in (1, 2):
        assert store.write_replaced(spark, path, again, removed=spark.createDataFrame([(4,), (99,)], "document_id int")) == number
        got = store.read_store(spark, path)
        assert got.count() == 56 and values(got.where("document_id = 3").select("content")) == [("new",)] and got.where("document_id = 4").count() == 0
    assert store.read_store(spark, path, version=0).count() == 60
    assert store.write_replaced(spark, path, again.limit(0), removed=first) == 3 and store.read_store(spark, path).where("document_id < 20").count() == 0
    store.forget(spark, path, keep=1)
    assert store.versions(spark, path) == [3] and store.read_store(spark, path).count() == 1


def test_a_write_that_is_killed_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(d, "old") for d in range(40)], "document_id int, content string")
    store.write_replaced(spark, path, rows)
    with monkeypatch.context() as m:  # all buckets are written, the manifest is not
        m.setattr(store, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.write_replaced(spark, path, rows.withColumn("content", F.lit("new")))
    assert {r.content for r in store.read_store(spark, path).collect()} == {"old"}
    store.write_replaced(spark, path, rows.limit(1).withColumn("content", F.lit("new")))
    assert store.read_store(spark, path).where("content = 'new'").count() == 1 and store.read_store(spark, path).count() == 40


def test_a_second_writer_on_the_same_base_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a")], "document_id int, content string")
    store.write_replaced(spark, path, rows)
    with pytest.raises(store.Superseded):
        store.write_replaced(spark, path, rows, base=-1)
    publish = store.publish

    def late(spark_, path_, version, content):
        publish(spark_, path_, version, content | {"writers": {"other": 1}})  # another one is faster
        publish(spark_, path_, version, content)

    monkeypatch.setattr(store, "publish", late)
    with pytest.raises(store.Superseded):
        store.write_replaced(spark, path, rows, base=0)
    monkeypatch.undo()
    assert store.versions(spark, path) == [0, 1] and store.manifest(spark, path, 1)["writers"] == {"other": 1}
    assert store.write_replaced(spark, path, rows, writer=("me", 5)) == 2 == store.write_replaced(spark, path, rows.limit(0), removed=rows, writer=("me", 5))
    assert store.read_store(spark, path).count() == 1


def test_refused_starts_take_no_slot(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 23, 0) + dt.timedelta(minutes=m)
    rows = [(i, 7, t(0), None) for i in range(5)] + [(5, 8, t(1), t(3)), (6, 7, t(30), t(31)), (7, 8, t(30), t(20)), (8, 9, t(30), t(90)), (9, None, t(30), t(32)), (10, 9, t(31), t(32)), (11, 9, None, t(40))]
    jobs = spark.createDataFrame(rows, "job_id long, user_id int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = {r.job_id: (r.reason, r.retry_after, r.open_user, r.open_total) for r in admission.admitted(jobs, str(tmp_path / "w")).collect()}
    assert got == {
        0: (None, None, 1, 1), 1: (None, None, 2, 2), 2: (None, None, 3, 3), 3: ("user", 30, 3, 3), 4: ("user", 30, 3, 3), 5: ("server", 60, 0, 3),
        6: (None, None, 1, 1), 7: (None, None, 1, 2), 8: (None, None, 1, 2), 9: (None, None, 1, 3), 10: (None, None, 2, 3),
    }
    assert admission.admitted(jobs.limit(0), str(tmp_path / "none")).count() == 0


def decided_in_order(rows, per_user, per_server, backstop):
    held, out = [], {}
    for job, user, start, end in sorted(rows, key=lambda r: (r[2], r[0])):
        held = [(u, e) for u, e in held if e > start]
        mine = sum(u == user for u, _ in held)
        reason = "user" if mine >= per_user else "server" if len(held) >= per_server else None
        if not reason:
            limit = start + dt.timedelta(minutes=backstop)
            held.append((user, min(end or limit, limit)))
        out[job] = (reason, sum(u == user for u, _ in held), len(held))
    return out


@pytest.mark.parametrize("per_user, per_server, stretch, every", [(1, 3, 30, 40), (3, 3, 45, 240), (2, 50, 60, 20), (1, 2, 30, 600)])
def test_stretches_side_by_side_decide_as_one_fold(spark, tmp_path, per_user, per_server, stretch, every):
    """Logs with no pause at all, and with pauses; slots that are held over the cuts."""
    import random

    draw = random.Random(every)
    start = lambda: dt.datetime(2024, 1, 1, 12) + dt.timedelta(seconds=draw.randrange(0, 600 * every))
    rows = [(i, draw.randrange(5), s := start(), draw.choice([None, s + dt.timedelta(seconds=draw.randrange(0, 3000))])) for i in range(600)]
    jobs = spark.createDataFrame(rows, "job_id long, user_id int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = admission.admitted(jobs, str(tmp_path / "w"), per_user, per_server, 30, stretch).collect()
    assert {r.job_id: (r.reason, r.open_user, r.open_total) for r in got} == decided_in_order(rows, per_user, per_server, 30)
    assert all(r.user_id == rows[r.job_id][1] and r.admitted == (r.reason is None) for r in got)


def test_histories_that_never_meet_take_few_rounds(spark, tmp_path):
    """A dense log whose slots are all held for the same time: what the first stretch leaves is felt to the end."""
    start = lambda i: dt.datetime(2024, 1, 1, 12) + dt.timedelta(seconds=i * 7 + (i * i) % 5)
    rows = [(i, i % 50, start(i), None) for i in range(12_000)]
    jobs = spark.createDataFrame(rows, "job_id long, user_id int, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = admission.admitted(jobs, str(tmp_path / "w"), stretch=30).collect()  # 47 stretches
    assert {r.job_id: (r.reason, r.open_user, r.open_total) for r in got} == decided_in_order(rows, 3, 3, 30)
    rounds = [p.name for p in (tmp_path / "w").glob("*/round=*")]
    assert 2 < len(rounds) <= 5


def test_limits_chain(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    e = spark.createDataFrame([(i, "k", t(i)) for i in range(5)] + [(9, "k", t(65)), (10, "j", t(3))], "event_id int, user_id string, ts timestamp_ntz")
    one_ = {r.event_id: (r.nth, r.allowed, r.retry_after) for r in usage.limited(e, usage.Policy(60, 3)).collect()}
    assert one_[3] == (4, False, 57) and one_[9] == (1, True, 55) and one_[10] == (1, True, 57)
    two = {r.event_id: r.blocked_by for r in usage.chained(e, (usage.Policy(60, 3), usage.Policy(3600, 3))).collect()}
    assert two == {0: None, 1: None, 2: None, 3: 0, 4: 0, 9: 1, 10: None}


def test_owners_move_only_to_verified_users(spark):
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "document_id int, user_id string")
    hist = spark.createDataFrame([(1, "a")], "answer_id int, user_id string")
    for provider, owner in (("google", "b"), ("test", "a")):
        accounts = spark.createDataFrame([("b", provider)], "user_id string, provider string")
        out = catalog.transfer_ownership(users, accounts, docs, hist, "a", "b")
        assert {r.user_id for r in out["documents"].where("document_id = 1").collect()} == {owner}
        assert (out["users"].where("user_id = 'a'").count() == 0) == (owner == "b")


IDENTITY = "seq int, provider string, provider_account_id string, email string, name string, image string"
USER, ACCOUNT = "user_id string, email string, name string, image string", "user_id string, provider string, provider_account_id string"


def test_sign_ins_that_arrive_together_make_one_user(spark):
    ids = spark.createDataFrame([(1, "g", "1", "e@x", "N", "i"), (1, "m", "2", "e@x", "N", "i")], IDENTITY)
    out = catalog.resolve_users(ids, spark.createDataFrame([], USER), spark.createDataFrame([], ACCOUNT))
    assert out["users"].count() == 1 and out["accounts"].select("user_id").distinct().count() == 1 and out["accounts"].count() == 2


def sign_ins_one_by_one(identities, users, accounts):
    """(resolved, users, accounts) by the rule as it stands; new users are named by their emails."""
    people, owner, out = {u: [e, n, i] for u, e, n, i in users}, {(p, a): u for u, p, a in accounts}, []
    none = lambda row: [(x is not None, x) for x in row]
    for seq, provider, pid, email, name, image in sorted(identities, key=none):
        user, how = owner.get((provider, pid)), "matched"
        if user is None:
            user, how = next((u for u in sorted(people) if email is not None and people[u][0] == email), None), "linked"
            if user is None:
                user, how = f"new {email or (provider, pid)}", "created"
                people[user] = [email, name, image]
            owner[provider, pid] = user
        people[user][1:] = [name, image]
        out.append((seq, provider, pid, email, user, how))
    return out, people, owner


def test_an_account_is_one_user_whatever_its_emails(spark):
    import random

    for seed in range(4):
        draw = random.Random(seed)
        emails, names = ["a@x", "b@x", "c@x", "d@x", "e@x", None], ["N", "M", None]
        ids = [(i // 2, draw.choice("gm"), str(draw.randrange(8)), draw.choice(emails), draw.choice(names), draw.choice(names)) for i in range(60)]
        users = [("old-1", "a@x", "N", None), ("old-2", "b@x", None, None), ("old-3", None, "K", "k")]
        accounts = [("old-1", "g", "1"), ("old-3", "m", "2")]
        want, people, owner = sign_ins_one_by_one(ids, users, accounts)
        out = catalog.resolve_users(spark.createDataFrame(ids, IDENTITY), spark.createDataFrame(users, USER), spark.createDataFrame(accounts, ACCOUNT))
        got = [(r.seq, r.provider, r.provider_account_id, r.email, r.user_id, r.how) for r in out["resolved"].collect()]
        assert sorted((r[:4] + (r[5],) for r in got), key=repr) == sorted((r[:4] + (r[5],) for r in want), key=repr)
        mine = {(r.provider, r.provider_account_id): r.user_id for r in out["accounts"].collect()}
        assert out["accounts"].count() == len(mine) == len(owner) and set(mine) == set(owner)
        same = {(owner[k], mine[k]) for k in owner}  # one name for each user on either side
        assert len(same) == len({a for a, _ in same}) == len({b for _, b in same})
        named = {b: a for a, b in same}
        after = {named.get(r.user_id, r.user_id): [r.email, r.name, r.image] for r in out["users"].collect()}
        assert after == people and all(mine[r[1], r[2]] == r[4] for r in got)


# --- streams ------------------------------------------------------------------------


EVENT = "question_id string, seq int, event string, data string, at timestamp"
NOON = dt.datetime(2024, 1, 1, 12)


def test_answer_events_fold_alike_as_table_and_stream(spark, tmp_path):
    e = [("a", 0, "stage", {"stage": "searching"}), ("a", 1, "sources", {"n": 2}), ("a", 2, "stage", {"stage": "writing"}), ("a", 3, "delta", {"text": "x"}), ("a", 4, "delta", {"text": "y"}), ("a", 5, "done", {"answer": "xy!"}), ("a", 6, "delta", {"text": "late"})]
    e += [("b", 0, "delta", {"text": "x"}), ("b", 1, "error", {"message": "busy"}), ("c", 0, "delta", {"text": "x"})]
    rows = spark.createDataFrame([(q, s, k, json.dumps(d), NOON) for q, s, k, d in e], EVENT)
    want = [("a", "done", 2, "xy!", None), ("b", "error", 0, "", "busy"), ("c", "error", 0, "", usage.DROPPED)]
    assert values(usage.folded_answer_events(rows)) == want
    for part in ("seq % 2 = 1", "seq % 2 = 0"):  # later numbers arrive before earlier ones
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.run_to_table(streams.stream_answer_events(stream), ["question_id"], str(tmp_path / "out"), str(tmp_path / "state"))
    assert values(streams.settled(out)) == want
    assert [(r.phase, r.text) for r in out.where("question_id = 'c'").collect()] == [("searching", "x")]


def test_silent_questions_end_and_leave_the_state(spark, tmp_path):
    """The clock passes: open questions end as dropped ones, ended ones go quietly, and nothing that comes after changes them."""

    def arrive(*events):
        rows = [(q, s, k, json.dumps(d), NOON + dt.timedelta(seconds=t)) for q, s, k, d, t in events]
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
        out = streams.run_to_table(streams.stream_answer_events(stream, patience=60, late="10 seconds"), ["question_id"], str(tmp_path / "out"), str(tmp_path / "state"), streams.ended())
        return {r.question_id: (r.phase, r.n_sources, r.text, r.message) for r in out.collect()}

    def held():
        """Questions in the state, as its reader tells."""
        return sorted(r.key.question_id for r in spark.read.format("statestore").load(str(tmp_path / "state")).collect())

    got = arrive(("open", 0, "sources", {"n": 3}, 0), ("open", 1, "delta", {"text": "x"}, 1), ("ended", 0, "done", {"answer": "all"}, 2))
    assert got == {"open": ("searching", 3, "x", None), "ended": ("done", 0, "all", None)} and held() == ["ended", "open"]
    got = arrive(("ended", 1, "delta", {"text": "more"}, 20), ("open", 2, "delta", {"text": "y"}, 21))  # still held: no change, and the clock of a live one starts anew
    assert got == {"open": ("searching", 3, "xy", None), "ended": ("done", 0, "all", None)}
    dropped = {"open": ("error", 3, "", usage.DROPPED), "ended": ("done", 0, "all", None)}
    got = arrive(("next", 0, "delta", {"text": "z"}, 200))
    assert got == dropped | {"next": ("searching", 0, "z", None)} and held() == ["next"]
    got = arrive(("open", 3, "done", {"answer": "too late"}, 30), ("open", 4, "done", {"answer": "after the end"}, 201), ("next", 1, "delta", {"text": "!"}, 202))
    assert got == dropped | {"next": ("searching", 0, "z!", None)}


def test_questions_in_slices_are_told_like_questions_with_states_of_their_own(spark, tmp_path):
    """Batches of many questions, one without a name: equal rows, timers' included, from a state for each slice alone."""
    import random

    draw, names, makers = random.Random(3), [None, *(f"q{i}" for i in range(40))], {"stage": ("stage", "writing"), "sources": ("n", 2), "delta": ("text", "x"), "done": ("answer", "xy"), "error": ("message", "busy")}
    for turn in range(3):
        asked = draw.sample(names, 25)
        places = sorted({(draw.choice(asked), draw.randrange(7)) for _ in range(90)}, key=repr)
        kinds = draw.choices(list(makers), [2, 2, 6, 1, 1], k=len(places))
        rows = [(q, i, k, json.dumps(dict([makers[k]])), NOON + dt.timedelta(seconds=turn * 70 + draw.randrange(40))) for (q, i), k in zip(places, kinds, strict=True)]
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        told, states = [], []
        for slices in (None, 3):
            stream, at = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), f"{tmp_path}/{slices}"
            streams.run_to_table(streams.stream_answer_events(stream, patience=60, late="10 seconds", slices=slices), ["question_id"], f"{at}/out", f"{at}/state")
            told.append(sorted(spark.read.parquet(f"{at}/out").collect(), key=repr))
            states.append(spark.read.format("statestore").load(f"{at}/state").count())
        assert told[0] == told[1] and any(r.message == usage.DROPPED for r in told[1]) == (turn > 0)
        assert states[1] <= 3 < states[0]


def test_questions_are_waited_for_in_any_session_zone(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        for part, slices in (("a", None), ("b", 3)):
            for second in (0, 30):  # well within the patience
                spark.createDataFrame([("q", second, "delta", json.dumps({"text": "x"}), NOON + dt.timedelta(seconds=second))], EVENT).write.mode("append").parquet(f"{tmp_path}/{part}/in")
                stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/{part}/in")
                out = streams.run_to_table(streams.stream_answer_events(stream, patience=60, late="10 seconds", slices=slices), ["question_id"], f"{tmp_path}/{part}/out", f"{tmp_path}/{part}/state")
            assert [(r.phase, r.text) for r in out.collect()] == [("searching", "xx")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_windows_close_once_and_late_rows_are_told_apart(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long"

    def arrive(kind, make, *events):
        at = str(tmp_path / kind)
        spark.createDataFrame([(i, NOON + dt.timedelta(minutes=m), u) for i, m, u in events], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        rows, run = streams.run_appended(make(spark.readStream.schema(schema).parquet(f"{at}/in"), 3600, 2, "30 minutes"), f"{at}/out", f"{at}/state")
        return rows, streams.late_rows(run)

    first = [(1, 0, 7), (2, 1, 7), (2, 1, 7), (3, 50, 7), (4, 55, 8), (5, 70, 7)]
    second = [(6, 45, 8), (7, 58, 8), (8, 200, 9)]  # late, but not too late: the watermark is 12:40
    third = [(9, 20, 7), (10, 150, 8), (11, 185, 9), (12, 190, 9), (13, 195, 9)]  # two of them after the watermark, 14:50
    told = lambda rows: sorted((r.window_start.hour, r.user_id, r.n, r.over_limit) for r in rows.collect())
    assert [told(rows) + [late] for rows, late in [arrive("w", streams.final_rates, *first)]] == [[0]]
    rows, late = arrive("w", streams.final_rates, *second)
    closed = [(12, 7, 3, True), (12, 8, 3, True), (13, 7, 1, False)]
    assert told(rows) == closed and late == 0
    rows, late = arrive("w", streams.final_rates, *third)
    assert told(rows) == closed and late == 2
    rows, late = arrive("w", streams.final_rates, (14, 400, 1))
    assert told(rows) == [*closed, (15, 9, 4, True)] and late == 0

    alerts = lambda rows: sorted((r.window_start.hour, r.user_id, r.event_id) for r in rows.collect())
    assert alerts(arrive("a", streams.rate_alerts, *first)[0]) == [(12, 7, 3)]  # at once, though no window is closed
    assert alerts(arrive("a", streams.rate_alerts, *second)[0]) == [(12, 7, 3), (12, 8, 7)]
    rows, late = arrive("a", streams.rate_alerts, *third)
    assert alerts(rows) == [(12, 7, 3), (12, 8, 7), (15, 9, 12)] and late == 2


def test_guards_of_the_sentence_pattern_change_nothing(spark):
    """The pattern against the same rules without their quick first looks, over random texts of all its classes."""
    import random

    from quillstone.functions import sentence_breaks as B

    tail = rf"[{B.CLOSE}{B.EXTEND}]*+(?: [{B.EXTEND}]++)*+"
    behind, letter = rf"(?![{B.GOES_ON}{B.FULL_STOP}{B.STOP}{B.NEXT_LINE}])", rf"[{B.LOWER}{B.UPPER}][{B.EXTEND}]{{0,{B.MARKS}}}"
    stop = rf"(?:(?<={letter})[{B.FULL_STOP}][{B.EXTEND}]*+(?!{B.UPPER})|(?<!{letter})[{B.FULL_STOP}][{B.EXTEND}]*+)(?![{B.NUMERIC}])"
    plain = rf"(?:([{B.STOP}]{tail}) ?+{behind}|({stop}{tail}) ?+(?!{B.NO_LETTER}*+{B.LOWER}){behind}|({B.NEXT_LINE}) ?)"
    draw = random.Random(1)
    signs = "..!?  aZ1,-:;\"'()[]»«”“’…。！？｡؟।።‼．․\u0301\u00ad\u200d\u0345ßéÉǅაᲐ中\U0001d400\U0001f676٣٫—、\x85\u05f3ªº©"
    rows = [("".join(draw.choice(signs) for _ in range(60)),) for _ in range(4000)]
    df = spark.createDataFrame(rows, "t string").select("t", F.regexp_replace("t", B.SENTENCE_END, "$1$2$3|").alias("quick"), F.regexp_replace("t", plain, "$1$2$3|").alias("whole"))
    assert df.where("quick LIKE '%|%'").count() > 3000
    assert df.where("quick <> whole").collect() == []


def test_alerts_make_a_call_for_each_slice_of_users_not_for_each_user(spark, tmp_path):
    """Two batches of many users and hours, some of them without a name: alerts as told one by one, from a state for each slice alone."""
    import collections
    import random

    draw, schema = random.Random(5), "event_id long, ts timestamp_ntz, user_id long"
    big = (1 << 60) + 1
    batches = [[(big + b * 1000 + i, NOON + dt.timedelta(minutes=draw.randrange(0, 300)), draw.choice([None, *range(60)])) for i in range(700)] for b in (0, 1)]
    expected, counts = [], collections.Counter()
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        out, run = streams.run_appended(streams.rate_alerts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3600, 2, "1 day"), str(tmp_path / "out"), str(tmp_path / "state"))
        for event, at, user in sorted(rows, key=lambda r: (r[1], r[0])):
            counts[user, at.hour] += 1
            expected += [(at.hour, user, event)] if counts[user, at.hour] == 3 else []
        assert sorted(((r.window_start.hour, r.user_id, r.event_id) for r in out.collect()), key=repr) == sorted(expected, key=repr)
    assert run.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= streams.SLICES < len(counts)


def test_streamed_queries_give_all_rows(spark):
    q, sf = registry.QUERIES, "/root/testdata/sf0.001"
    batch = q["h5_request_rates"](spark, sf)
    assert values(q["h5_stream_request_rates"](spark, sf).select(F.col("window_start").cast("timestamp_ntz"), *batch.columns[1:])) == values(batch)
    out = q["h6_stream_answer_events"](spark, sf)
    assert out.count() == out.select("question_id").distinct().count() == q["h6_fold_answer_events"](spark, sf).count()


def test_a_streamed_result_keeps_the_last_row_of_each_key(spark, tmp_path):
    for i, data in enumerate(["x", "y"]):
        spark.createDataFrame([("a", i, "delta", json.dumps({"text": data}), NOON)], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.run_to_table(streams.stream_answer_events(stream), ["question_id"], str(tmp_path / "out"), str(tmp_path / "state"))
    assert [(r.question_id, sorted(r.text)) for r in out.collect()] == [("a", ["x", "y"])]


def ingest_folder(spark, tmp_path, turn=0, **options):
    """Catalog rows by file name, and the store."""
    paths = [str(tmp_path / x) for x in ("store", "catalog", f"checkpoint{turn}")]
    streams.stream_ingest(streams.arriving_files(spark, str(tmp_path / "in")), *paths, dim=8, **options).awaitTermination()
    rows = spark.read.parquet(paths[1]).collect()
    return {r.document_id.rsplit("/", 1)[1]: (r.status, r.error_message) for r in rows}, store.read_store(spark, paths[0])


def test_files_are_ingested_as_they_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One sentence. Another one.\n\nA paragraph.")
    (tmp_path / "in" / "b.docx").write_text("x")
    (tmp_path / "in" / "c.txt").write_text("***")
    status, kept = ingest_folder(spark, tmp_path)
    assert [(r.chunk_index, r.content, len(r.embedding)) for r in kept.collect()] == [(0, "One sentence. Another one.\n\nA paragraph.", 8)]
    assert status == {"a.txt": ("ready", None), "b.docx": ("failed", files.UNSUPPORTED), "c.txt": ("failed", text.NO_TEXT)}


def test_a_document_without_a_language_is_a_file_as_the_others(spark, tmp_path):
    rows = [(1, "One sentence. Another one.", "en"), (2, "Two words here.", None), (10, "Of a kind that is refused.", None)]
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "text": t, "lang": lang, "source": "src1", "n_chars": len(t)} for i, t, lang in rows]), tmp_path / "documents.parquet")
    query, folder = registry.QUERIES["h4_stream_ingest"], str(tmp_path)
    assert sorted((r.path, r.status) for r in query(spark, folder).collect()) == [("in/_10.docx", "failed"), ("in/_2.txt", "ready"), ("in/en_1.txt", "ready")]
    oracle.same(spark, query, registry.ORACLE_SQL["h4_stream_ingest"], folder)


def test_a_too_large_file_is_refused_alone_and_with_its_message(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One sentence.")
    (tmp_path / "in" / "b.txt").write_text("A sentence of some words. " * 400)
    status, _ = ingest_folder(spark, tmp_path, limit=1)
    assert status["a.txt"] == ("ready", None)
    assert status["b.txt"][0] == "failed" and status["b.txt"][1].startswith("Document is too large to process")


def test_a_document_with_a_bad_vector_is_failed_as_a_whole_and_loses_its_older_passages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Fine words. " * 400)
    (tmp_path / "in" / "b.txt").write_text("Other words. " * 400)
    words, small = embedding.hashed_words(8), chunking.ChunkOptions(50, 60, 5, 10)
    _, kept = ingest_folder(spark, tmp_path, options=small)
    assert kept.select("document_id").distinct().count() == 2

    def embed(texts):
        return [[float("nan")] * 8 if "last" in t else v for t, v in zip(texts, words(texts), strict=True)]

    (tmp_path / "in" / "a.txt").write_text("Fine words. " * 400 + "The last sentence.")
    status, kept = ingest_folder(spark, tmp_path, 1, options=small, embed=embed)
    assert status == {"a.txt": ("failed", embedding.BAD_RESPONSE), "b.txt": ("ready", None)}
    assert {r.document_id.rsplit("/", 1)[1] for r in kept.collect()} == {"b.txt"}


def documents_with(spark, *bodies):
    return ingest.text_documents(spark.createDataFrame([(i, f"f_{i}.txt", b) for i, b in enumerate(bodies)], "document_id int, filename string, text string"))


def test_each_failure_has_its_message_and_cause(spark, tmp_path):
    words = embedding.hashed_words(8)

    def embed(texts):
        if any("busy" in t for t in texts):
            raise embedding.EmbeddingFailed("Busy, try again")
        if any("crash" in t for t in texts):
            raise KeyError("inner detail")
        out = words(texts)
        if any("few" in t for t in texts):
            return out[1:]
        return [v[1:] if "short" in t else [None] * 8 if "null" in t else [float("inf")] * 8 if "inf" in t else v for t, v in zip(texts, out, strict=True)]

    docs = documents_with(spark, "good", None, "--- ***", "busy", "crash", "few", "short", "null", "inf", "good")
    got = ingest.ingested(docs, str(tmp_path / "w"), embed=embed, dim=8)
    told = {r.document_id: (r.status, r.error_message) for r in got.outcomes.collect()}
    bad = ("failed", embedding.BAD_RESPONSE)
    assert told == {0: ("ready", None), 1: ("failed", text.NO_TEXT), 2: ("failed", text.NO_TEXT), 3: ("failed", "Busy, try again"), 4: ("failed", embedding.SERVER_ERROR), 5: bad, 6: bad, 7: bad, 8: bad, 9: ("ready", None)}
    causes = {r.document_id: r.cause for r in got.failed().collect()}
    assert "inner detail" in causes[4] and causes[5] == "expected 1 vectors of 8, got 0, 0 of them malformed" and causes[6].endswith("got 1, 1 of them malformed")
    assert values(got.passages.select("document_id", "content")) == [(0, "good"), (9, "good")]
    none = ingest.ingested(docs.limit(0), str(tmp_path / "none"), embed=embed, dim=8)
    assert none.passages.count() == none.outcomes.count() == 0


def test_passages_meet_their_own_vectors(spark, tmp_path):
    bodies = [" ".join(f"Sentence {d}-{i} is here." for i in range(300)) for d in range(3)]
    got = ingest.ingested(documents_with(spark, *bodies), str(tmp_path / "w"), chunking.ChunkOptions(8, 12, 1, 2), dim=16)
    rows, embed = got.passages.collect(), embedding.hashed_words(16)
    assert len(rows) > 600 and all(r.embedding == embed([f"title: f {r.document_id} | text: {r.content}"])[0] for r in rows)
    assert sorted((r.document_id, r.chunk_index) for r in rows) == sorted((r.document_id, r.chunk_index) for r in chunking.chunks(documents_with(spark, *bodies), chunking.ChunkOptions(8, 12, 1, 2)).collect())


def test_embedding_resumes_where_it_stopped(spark, tmp_path):
    """The function fails half way; the second run calls it for the rest alone."""
    calls = spark.sparkContext.accumulator(0)
    words = embedding.hashed_words(8)

    def failing(texts):
        if any(f"Doc{i} " in t for t in texts for i in range(5)):
            raise ValueError("down")
        return words(texts)

    def counted(texts):
        calls.add(len(texts))
        return words(texts)

    docs, ledger = documents_with(spark, *[f"Doc{i} has words." for i in range(10)]), str(tmp_path / "ledger")
    first = ingest.ingested(docs, str(tmp_path / "a"), embed=failing, dim=8, ledger=ledger, waves=3)
    assert first.failed().count() == 5
    assert values(embedding.ledger_progress(first.batches, ledger).select("document_id", "chunks_embedded", "stage")) == [(i, int(i > 4), "saving" if i > 4 else "embedding") for i in range(10)]
    second = ingest.ingested(docs, str(tmp_path / "b"), embed=counted, dim=8, ledger=ledger)
    assert calls.value == 5 and second.failed().count() == 0 and second.passages.count() == 10
    third = ingest.ingested(docs, str(tmp_path / "c"), embed=counted, dim=8, ledger=ledger)
    assert third.passages.count() == 10 and calls.value == 5
    other = ingest.ingested(docs, str(tmp_path / "d"), embed=counted, dim=8, ledger=ledger, model="another")
    assert other.passages.count() == 10 and calls.value == 15


def test_page_texts_are_ingested_with_the_vocabulary_of_the_document(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "All infor-\nmation here is"), (1, 2, "information."), (2, 1, " "), (2, 2, None)], "document_id int, page_no int, text string")
    names = spark.createDataFrame([(1, "a.pdf"), (2, "scan.pdf"), (3, "none.pdf")], "document_id int, filename string")
    got = ingest.ingested(ingest.page_documents(pages, names), str(tmp_path / "w"), dim=8)
    assert values(got.passages.select("content")) == [("All information here is information.",)]
    assert values(got.failed().select("document_id", "error_message")) == [(2, ingest.NO_PDF_TEXT), (3, ingest.NO_PDF_TEXT)]


def test_a_batch_without_a_text_file_is_ingested(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "in" / "b.docx").write_text("x")
    for turn in range(2):  # the second time as a repeated batch
        status, kept = ingest_folder(spark, tmp_path, turn)
        assert status == {"a.pdf": ("processing", None), "b.docx": ("failed", files.UNSUPPORTED)} and kept.count() == 0


def test_several_failures_of_a_document_leave_one_row(spark):
    docs = spark.createDataFrame([(1, "processing", None), (2, "ready", None)], "document_id int, status string, error_message string")
    chunks = spark.createDataFrame([(1, 0), (2, 0)], "document_id int, chunk_index int")
    errors = spark.createDataFrame([(1, "inner", False), (1, "Could not read it", True), (1, "Could not read it", True)], "document_id int, message string, user_facing boolean")
    after, left = catalog.mark_failed(docs, chunks, errors)
    assert values(after) == [(1, "failed", "Could not read it"), (2, "ready", None)] and values(left) == [(2, 0)]


def test_a_large_owner_is_searched_in_parts(spark, monkeypatch):
    scope = spark.createDataFrame([(i, 1 + i % 2, [float(i % 7), float(i % 5), 1.0]) for i in range(200)], "chunk_id long, user_id int, embedding array<double>")
    questions = spark.createDataFrame([(i, 1 + i % 3, [1.0, float(i), 2.0]) for i in range(9)], "question_id long, user_id int, embedding array<double>")
    sent = values(retrieval.topk_batch(questions, scope, 4))
    monkeypatch.setattr(retrieval, "BROADCAST_QUESTIONS", 0)
    assert len(sent) == 24 and values(retrieval.topk_batch(questions, scope, 4)) == sent


def _ranked(q, p, k, chunk_ids):
    """All pairs measured one by one, best first."""
    out = set()
    for i, x in enumerate(q):
        near = sorted((-float(nearest.measured(x[None], y[None], np.zeros(1, int), np.zeros(1, int))[0]), c) for y, c in zip(p, chunk_ids, strict=True))
        out |= {(i, c, -s) for s, c in near[:k]}
    return out


@pytest.mark.parametrize("kind", ["groups", "random", "equal", "few"])
def test_nearest_with_pruning_equals_all_pairs(kind):
    rng, k = np.random.default_rng(3), 5
    centres = rng.normal(size=(12, 8))
    p = {"groups": centres[rng.integers(0, 12, 700)] + rng.normal(size=(700, 8)) * 0.02, "random": rng.normal(size=(700, 8)), "equal": np.repeat(centres[:2], 200, axis=0), "few": centres[:3]}[kind]
    q = (centres[rng.integers(0, 12, 150)] + rng.normal(size=(150, 8)) * 0.02)[: 150 if kind != "equal" else 90]
    ids = rng.permutation(len(p)) + 100
    best = nearest.Best(q, k)
    multiplied = sum(best.see(p[i : i + 400], ids[i : i + 400]) for i in range(0, len(p), 400))
    assert {(int(a), int(c), float(s)) for a, c, s in zip(best.at, best.ids, best.sim, strict=True)} == _ranked(q, p, k, ids.tolist())
    assert kind != "groups" or multiplied < len(q) * len(p) / 3


@pytest.mark.parametrize("limit", [10_000, 0])
def test_topk_batch_equals_sparks_own_cosines(spark, monkeypatch, limit):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(retrieval, "BROADCAST_QUESTIONS", limit)
    monkeypatch.setattr(nearest, "PASSAGES", 40)
    monkeypatch.setattr(nearest, "QUESTIONS", 7)
    rows = [(f"c{i}", 1 + i % 3, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]
    rows += [("zero", 1, [0.0] * 4), ("none", 1, None), ("nan", 1, [1.0, float("nan"), 0.0, 0.0]), ("null", 1, [1.0, None, 0.0, 0.0]), ("short", 1, [1.0]), ("stray", None, [1.0] * 4)]
    scope = spark.createDataFrame(rows, "chunk_id string, user_id int, embedding array<double>")
    asked = [(i, 1 + i % 4, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)] + [(99, 1, [0.0] * 4), (100, None, [1.0] * 4)]
    questions = spark.createDataFrame(asked, "question_id long, user_id int, embedding array<double>")
    order = Window.partitionBy("question_id").orderBy(F.desc("similarity"), "chunk_id")
    all_pairs = retrieval.similarities(questions, scope).where("NOT isnan(similarity)").withColumn("rank", F.row_number().over(order)).where("rank <= 6")
    assert values(retrieval.topk_batch(questions, scope, 6).select("question_id", "chunk_id", "user_id", "similarity", "rank")) == values(all_pairs.select("question_id", "chunk_id", "user_id", "similarity", "rank"))
    empty = questions.limit(0)
    assert retrieval.topk_batch(empty, scope, 6).count() == 0 and retrieval.topk_batch(questions, scope.limit(0), 6).count() == 0


def test_questions_are_answered_and_failures_kept_apart(spark, tmp_path):
    words = embedding.hashed_words(16)

    def embed(texts):
        return [[float("nan")] * 16 if "broken" in t else words([t])[0] for t in texts]

    def generate(prompts):
        return [("", None, "SAFETY") if "unsafe" in p else (" Red apples [1] [7]. ", "STOP", None) for p in prompts]

    rows = [(1, 5, "apples"), (2, 5, "apples unsafe"), (3, 5, "broken"), (4, 6, "apples"), (5, 5, "zebra quartz vortex lumen")]
    questions = spark.createDataFrame(rows, "question_id long, user_id int, question string")
    inputs = spark.createDataFrame([(10, 1, 0, 5, "fruit.txt", "apples are red", "task: search result | query: apples")], "chunk_id long, document_id long, chunk_index int, user_id int, filename string, content string, input string")
    scope = embedding.embedded(inputs, embed, dim=16).drop("input")
    saved, failures = flow.answered_questions(questions, scope, str(tmp_path), embed, generate, retrieval.Relevance(skip_below=0.8), 16)
    got = {r.question_id: r for r in saved.collect()}
    assert values(failures) == [(2, "blocked", answers.PROMPT_BLOCKED), (3, "bad_response", None)]
    rejected = spark.createDataFrame([(9, "question must not be empty")], "question_id long, error string")
    told = {r.question_id: (r.code, r.http_status, r.message, r.log) for r in answers.unanswered(rejected, failures).collect()}
    assert told == {9: ("invalid", 400, "question must not be empty", False), 2: ("blocked", 422, answers.PROMPT_BLOCKED, True), 3: ("bad_response", 502, "Answering failed because of a problem with the AI service.", True)}
    assert set(got) == {1, 4, 5}
    assert got[1].answer == "Red apples [1]." and got[1].invalid == [7] and [c.chunk_id for c in got[1].citations] == [10] and got[1].answered
    assert got[4].answer == answers.NO_DOCUMENTS and got[5].answer == answers.REFUSAL and not got[5].answered and got[5].skip_reason == "below_threshold"


def test_white_space_of_all_kinds(spark):
    body = C.WS_CHARACTERS
    assert one(spark, C.trimmed(F.lit(body + "a" + body + "b" + body))) == "a" + body + "b"
    assert one(spark, C.collapsed(F.lit(body + "a" + body + "b c  d\te \n f​" + body))) == "a b c d e f​"
    import re

    kinds = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and re.match(r"\s|﻿", chr(i)) and chr(i) not in "\x1c\x1d\x1e\x1f\x85"]
    assert sorted(body) == sorted(kinds)
