"""Queries over sources, text preparation, passages and the embedding job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import columns as C
from quillstone.functions import sentence_breaks as B
from quillstone.operators import chunking, embedding, text
from quillstone.plans import views as V
from quillstone.plans.registry import query
from quillstone.sources import files, store
from quillstone.sources.tables import spread, table

WS = C.WS
#: Files made from the documents: name, and content with or without a flaw.
FILE_NAME = "concat('in/', cast(doc_id as string), CASE doc_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' WHEN 2 THEN '.txt' WHEN 3 THEN '.md' WHEN 4 THEN '.docx' ELSE '.txt' END)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    body = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit(b"%PDF-"), body)).when(F.col("doc_id") % 12 == 5, F.concat(body, F.lit(b"\x00"))).when(F.col("doc_id") % 12 == 2, F.concat(body, F.lit(b"\xff"))).otherwise(body)
    return d.select("doc_id", F.expr(FILE_NAME).alias("path"), content.alias("content")).withColumn("length", F.length("content").cast("long"))


@query(f"""SELECT doc_id, {FILE_NAME} AS path, CASE WHEN doc_id % 6 = 1 AND NOT starts_with(text, '%PDF-') THEN '{files.NOT_PDF}' WHEN doc_id % 6 = 4 THEN '{files.UNSUPPORTED}' WHEN doc_id % 12 = 5 THEN '{files.BINARY}' WHEN doc_id % 12 = 2 THEN '{files.NOT_UTF8}' END AS reject_reason,
  CASE WHEN doc_id % 6 = 0 THEN 'pdf' WHEN doc_id % 6 IN (1, 4) OR doc_id % 12 IN (5, 2) THEN NULL ELSE 'text' END AS kind FROM documents""")
def a1_admit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.judged(_files(spark, sf_dir)).select("doc_id", "path", "reject_reason", "kind")


@query("""SELECT doc_id, coalesce(nullif(left(trim(name), 255), ''), 'untitled') AS filename, 'processing' AS status, 'extracting' AS stage, 0 AS chunks_embedded
  FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '   ' ELSE concat('  ', replace(text, chr(10), ' '), ' ') END AS name FROM documents)""")
def a2_register_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 5 == 0, "   ").otherwise(F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" ")))
    return files.registered(d.select("doc_id", name.alias("filename"))).select("doc_id", "filename", "status", "stage", "chunks_embedded")


@query(f"""WITH {V.LINE_CHUNKS}, batch AS (SELECT doc_id AS document_id, 0 AS chunk_index, upper(lang) AS content FROM documents WHERE source = 'src1')
  SELECT document_id, chunk_index, content FROM lines WHERE document_id NOT IN (SELECT document_id FROM batch) UNION ALL SELECT * FROM batch""")
def a3_replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of one source are ingested again and come out as one passage each."""
    batch = table(spark, sf_dir, "documents").where("source = 'src1'").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.upper("lang").alias("content"))
    return store.replaced(V.line_chunks(spark, sf_dir).select("document_id", "chunk_index", "content"), batch)


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def a5_read_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


_ROUGH = "concat(chr(65279), ' ', replace(replace(text, '. ', '. ' || chr(9) || chr(13) || chr(10)), ', ', ',' || chr(10) || chr(10) || ' ' || chr(13) || chr(10) || chr(10)), ' ')"


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_ROUGH}, '^\x{{FEFF}}', ''), '\r\n?', chr(10), 'g'), '[ \t]+(\n|\z)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[{WS}]+|[{WS}]+$', '', 'g') AS text FROM documents""")
def b1_normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rough = "concat(decode(X'EFBBBF', 'UTF-8'), ' ', replace(replace(text, '. ', '. ' || chr(9) || chr(13) || chr(10)), ', ', ',' || chr(10) || chr(10) || ' ' || chr(13) || chr(10) || chr(10)), ' ')"
    return table(spark, sf_dir, "documents").select("doc_id", C.normalised(F.expr(rough)).alias("text"))


@query(r"""SELECT doc_id, CASE WHEN NOT regexp_matches(t, '[\p{L}\p{N}]') THEN 'File contains no text' END AS error_message FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[\p{L}\p{N}]', '', 'g') ELSE text END AS t FROM documents)""")
def b2_drop_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"[\p{L}\p{N}]", "")).otherwise(F.col("text"))
    good, bad = text.with_text(table(spark, sf_dir, "documents").select("doc_id", t.alias("text")))
    return good.select("doc_id", F.lit(None).cast("string").alias("error_message")).unionByName(bad.select("doc_id", "error_message"))


#: Pages whose lines are hard-wrapped, some of them inside words.
_WRAPPED = r"regexp_replace(text, '([\p{Ll}]{{3}})([\p{Ll}]{{4}}) ', '{one}-' || chr(10) || '{two} '{g})"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace("text", r"(\p{Ll}{3})(\p{Ll}{4}) ", "$1-\n$2 ")
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_no"), t.alias("text"))


_PAGES = r"""pages_ AS (SELECT doc_id AS document_id, 1 AS page_no, regexp_replace(text, '(\p{Ll}{3})(\p{Ll}{4}) ', '\1-' || chr(10) || '\2 ', 'g') AS text FROM documents)"""
_LINES = r"""raw_lines AS (SELECT document_id, page_no, unnest(ls) AS raw, unnest(range(0, len(ls))) AS line_no FROM (SELECT *, string_split(text, chr(10)) AS ls FROM pages_)),
clean AS (SELECT document_id, page_no, line_no, trim(regexp_replace(raw, '[\t ]+', ' ', 'g')) AS line FROM raw_lines),
flagged AS (SELECT *, line = '' OR (length(line) < max(length(line)) OVER (PARTITION BY document_id, page_no) * 0.7 AND NOT regexp_matches(line, '\p{Ll}-\z')) AS ends FROM clean),
page_lines AS (SELECT document_id, page_no, line_no, line, paragraph FROM (SELECT *, coalesce(sum(ends::INTEGER) OVER (PARTITION BY document_id, page_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS paragraph FROM flagged) WHERE line <> '')"""
_VOCABULARY = r"""vocabulary AS (SELECT DISTINCT document_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM pages_)"""


@query(f"WITH {_PAGES}, {_LINES} SELECT * FROM page_lines")
def b3_unwrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.page_lines(_pages(spark, sf_dir)).select("document_id", "page_no", "line_no", "line", "paragraph")


@query(f"WITH {_PAGES}, {_VOCABULARY} SELECT * FROM vocabulary")
def b4_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.vocabulary(_pages(spark, sf_dir))


@query(rf"""WITH {_PAGES}, {_LINES}, {_VOCABULARY},
nexts AS (SELECT *, lead(line) OVER (PARTITION BY document_id, page_no, paragraph ORDER BY line_no) AS nxt FROM page_lines),
halves AS (SELECT *, regexp_extract(line, '(\p{{L}}*\p{{Ll}})-\z', 1) AS head, regexp_extract(coalesce(nxt, ''), '^\p{{Ll}}\p{{L}}*') AS tail FROM nexts),
pieces AS (SELECT h.*, CASE WHEN nxt IS NULL THEN line WHEN v.word IS NOT NULL THEN left(line, length(line) - 1) WHEN head <> '' AND tail <> '' THEN line ELSE line || ' ' END AS piece
  FROM halves h LEFT JOIN vocabulary v ON h.document_id = v.document_id AND h.head <> '' AND h.tail <> '' AND v.word = lower(h.head || h.tail)),
paras AS (SELECT document_id, page_no, paragraph, string_agg(piece, '' ORDER BY line_no) AS text FROM pieces GROUP BY 1, 2, 3)
SELECT document_id, page_no, string_agg(text, chr(10) || chr(10) ORDER BY paragraph) AS text FROM paras GROUP BY 1, 2""")
def b5_dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.unwrapped_pages(_pages(spark, sf_dir))


@query(r"""WITH pages_ AS (SELECT conv_id AS document_id, turn AS page_no, text FROM conversations),
vocabulary AS (SELECT DISTINCT document_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM pages_),
nexts AS (SELECT *, lead(text) OVER (PARTITION BY document_id ORDER BY page_no) AS nxt FROM pages_ WHERE text <> ''),
halves AS (SELECT *, regexp_extract(text, '(\p{L}*\p{Ll})-\z', 1) AS head, regexp_extract(coalesce(nxt, ''), '^\p{Ll}\p{L}*') AS tail FROM nexts),
pieces AS (SELECT h.document_id, page_no, CASE WHEN nxt IS NULL THEN text WHEN regexp_matches(text, '[.!?:]["''”’)\]]?\z') THEN text || chr(10) || chr(10) WHEN v.word IS NOT NULL THEN left(text, length(text) - 1) WHEN head <> '' AND tail <> '' THEN text ELSE text || ' ' END AS piece
  FROM halves h LEFT JOIN vocabulary v ON h.document_id = v.document_id AND h.head <> '' AND h.tail <> '' AND v.word = lower(h.head || h.tail))
SELECT document_id, string_agg(piece, '' ORDER BY page_no) AS text FROM pieces GROUP BY 1""")
def b6_join_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return text.joined_pages(c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_no"), "text"))


_TITLE = rf"trim(regexp_replace(regexp_replace(regexp_replace(filename, '\.[^.]+\z', ''), '[_|]+', ' ', 'g'), '[{WS}]+', ' ', 'g'))"


@query(f"""WITH {V.DOCUMENTS}, {V.LINE_CHUNKS}, named AS (SELECT document_id, CASE WHEN document_id % 9 = 0 THEN '.txt' ELSE concat('My__', filename, '|x.md') END AS filename FROM docs)
  SELECT l.document_id, l.chunk_index, {_TITLE} AS title, concat('title: ', coalesce(nullif({_TITLE}, ''), 'none'), ' | text: ', l.content) AS input, concat('task: search result | query: ', l.content) AS query_input FROM lines l JOIN named n ON l.document_id = n.document_id""")
def b8_embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("document_id") % 9 == 0, ".txt").otherwise(F.concat(F.lit("My__"), "filename", F.lit("|x.md")))
    named = V.documents(spark, sf_dir).select("document_id", C.title(name).alias("title"))
    rows = V.line_chunks(spark, sf_dir).join(named, "document_id")
    return rows.select("document_id", "chunk_index", "title", C.passage_input("title", "content").alias("input"), C.question_input("content").alias("query_input"))


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines that close a sentence end a paragraph."""
    t = F.regexp_replace("text", r"\.\n", ".\n\n")
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("document_id"), t.alias("text"))


_PROSE = r"""prose AS (SELECT doc_id AS document_id, regexp_replace(text, '\.\n', '.' || chr(10) || chr(10), 'g') AS text FROM documents)"""
_PARAGRAPHS = rf"""paragraphs AS (SELECT document_id, paragraph_no::INTEGER AS paragraph_no, trim(regexp_replace(raw, '[{WS}]+', ' ', 'g')) AS paragraph FROM
  (SELECT document_id, unnest(ps) AS raw, unnest(range(0, len(ps))) AS paragraph_no FROM (SELECT document_id, string_split_regex(text, '\n[{WS}]*\n') AS ps FROM prose)) WHERE trim(regexp_replace(raw, '[{WS}]+', ' ', 'g')) <> '')"""
#: The engines' letter classes for SQL, which has no lookarounds: a piece ends behind each stop, and pieces that no rule parts are joined again; then abbreviations are glued to what follows.
_ANY_STOP, _CASED, _BLANKS = B.FULL_STOP + B.STOP, r"\p{Ll}\p{Lu}\p{Lt}", rf"[{B.CLOSE}{B.EXTEND}]*(?: [{B.EXTEND}]*)*".replace("'", "''")
_SENTENCES = rf"""pieces AS (SELECT document_id, paragraph_no, piece, piece_no, coalesce(lead(piece) OVER (PARTITION BY document_id, paragraph_no ORDER BY piece_no), '') AS nxt FROM (SELECT document_id, paragraph_no, unnest(xs) AS piece, unnest(range(0, len(xs))) AS piece_no FROM
  (SELECT document_id, paragraph_no, string_split(regexp_replace(paragraph, '([{_ANY_STOP}]{_BLANKS})', '\1' || chr(30), 'g'), chr(30)) AS xs FROM paragraphs)) WHERE piece <> ''),
parted AS (SELECT *, (regexp_matches(nxt, '^[{B.GOES_ON}{_ANY_STOP}]')
    OR (regexp_matches(piece, '[{B.FULL_STOP}][{B.EXTEND}]*\z') AND regexp_matches(nxt, '^[{B.NUMERIC}]'))
    OR (regexp_matches(piece, '[{_CASED}][{B.EXTEND}]*[{B.FULL_STOP}][{B.EXTEND}]*\z') AND regexp_matches(nxt, '^[\p{{Lu}}\p{{Lt}}]'))
    OR (regexp_matches(piece, '[{B.FULL_STOP}]{_BLANKS}\z') AND regexp_matches(nxt, '^[^\p{{L}}\p{{Nl}}{_ANY_STOP}]*\p{{Ll}}')))::INTEGER AS joins FROM pieces),
numbered AS (SELECT *, coalesce(sum(1 - joins) OVER (PARTITION BY document_id, paragraph_no ORDER BY piece_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part_no FROM parted),
parts AS (SELECT document_id, paragraph_no, part_no, trim(string_agg(piece, '' ORDER BY piece_no)) AS part FROM numbered GROUP BY 1, 2, 3),
placed AS (SELECT *, coalesce(sum(1 - regexp_matches(part, '(?:^|[{WS}(])(?:{C.ABBREVIATIONS})\.\z')::INTEGER) OVER (PARTITION BY document_id, paragraph_no ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence_no FROM parts WHERE part <> ''),
sentences AS (SELECT document_id, paragraph_no, sentence_no, string_agg(part, ' ' ORDER BY part_no) AS sentence FROM placed GROUP BY 1, 2, 3)"""
#: Stops of other scripts, breaks without a blank, numbers, abbreviations and closing marks, put into the texts.
_STOPS = "replace(replace(replace(replace(replace(replace(text, ', ', '。'), ' de ', ' Dr.De (No. 5) '), ' a', '.») A'), ' e', '.5 U.S. E'), '. S', '?! (S'), ' t', '… “T')"
_STOPPED = f"prose AS (SELECT doc_id AS document_id, {_STOPS} AS text FROM documents)"


@query(f"WITH {_STOPPED}, {_PARAGRAPHS}, {_SENTENCES} SELECT * FROM sentences")
def c2_sentence_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("document_id"), F.expr(_STOPS).alias("text"))
    return chunking.sentences(chunking.paragraphs(docs))


@query(f"WITH {_PROSE}, {_PARAGRAPHS} SELECT * FROM paragraphs")
def c1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.paragraphs(_prose(spark, sf_dir))


@query(f"WITH {_PROSE}, {_PARAGRAPHS}, {_SENTENCES} SELECT * FROM sentences")
def c3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sentences(chunking.paragraphs(_prose(spark, sf_dir)))


#: Small sizes, so that packing, overlap, cut sentences and tails all occur.
OPTIONS = chunking.ChunkOptions(target=100, max=140, overlap=20, min=30)
_T, _M, _O, _L = OPTIONS.chars()
#: Words of over-long sentences, stepped one by one: a piece is closed when the next word does not fit; words longer than a piece do not occur in these tables.
_UNITS = f"""words AS (SELECT document_id, paragraph_no, sentence_no, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT *, string_split(sentence, ' ') AS ws FROM sentences WHERE length(sentence) > {_M})),
cuts AS (SELECT document_id, paragraph_no, sentence_no, i, w, 0 AS piece_no, length(w) AS size FROM words WHERE i = 1
  UNION ALL SELECT w.document_id, w.paragraph_no, w.sentence_no, w.i, w.w, CASE WHEN c.size + 1 + length(w.w) > {_T} THEN c.piece_no + 1 ELSE c.piece_no END, CASE WHEN c.size + 1 + length(w.w) > {_T} THEN length(w.w) ELSE c.size + 1 + length(w.w) END
  FROM cuts c JOIN words w ON w.document_id = c.document_id AND w.paragraph_no = c.paragraph_no AND w.sentence_no = c.sentence_no AND w.i = c.i + 1),
all_pieces AS (SELECT document_id, paragraph_no, sentence_no, 0 AS piece_no, sentence AS unit FROM sentences WHERE length(sentence) <= {_M}
  UNION ALL SELECT document_id, paragraph_no, sentence_no, piece_no, string_agg(w, ' ' ORDER BY i) FROM cuts GROUP BY 1, 2, 3, 4),
units AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY paragraph_no, sentence_no, piece_no) - 1 AS k, unit, CASE WHEN row_number() OVER (PARTITION BY document_id, paragraph_no ORDER BY sentence_no, piece_no) = 1 THEN 2 ELSE 1 END AS gap FROM all_pieces),
sized AS (SELECT document_id, k, unit, gap, length(unit) AS len, sum(length(unit) + gap) OVER (PARTITION BY document_id ORDER BY k) AS stop FROM units),
docs_ AS (SELECT document_id, list(len ORDER BY k) AS lens, list(stop ORDER BY k) AS stops, count(*) AS n FROM sized GROUP BY 1)"""


def _size(s: str, e: str) -> str:
    return f"(d.stops[{e} + 1] - d.stops[{s} + 1] + d.lens[{s} + 1])"


_CARRY = f"coalesce(list_min(list_filter(range(greatest(p.s + 1, p.k + 1 - {_O // 2 + 2}), p.k + 1), lambda j: ({_size('j', 'p.k')} <= {_O} OR (j = p.k AND d.lens[j + 1] <= {2 * _O})) AND {_size('j', '(p.k + 1)')} <= {_M})), p.k + 1)"
_FITS = f"({_size('p.s', '(p.k + 1)')} <= {_T} OR ({_size('p.s', 'p.k')} < {_L} AND {_size('p.s', '(p.k + 1)')} <= {_M}))"
_PACKED = f"""steps AS (SELECT document_id, 0::BIGINT AS k, 0::BIGINT AS s, 0::BIGINT AS nf, 0::BIGINT AS c FROM docs_
  UNION ALL SELECT p.document_id, p.k + 1, CASE WHEN {_FITS} THEN p.s ELSE {_CARRY} END, CASE WHEN {_FITS} THEN p.nf ELSE p.k + 1 END, CASE WHEN {_FITS} THEN p.c ELSE p.c + 1 END FROM steps p JOIN docs_ d ON p.document_id = d.document_id WHERE p.k + 1 < d.n),
drafts AS (SELECT document_id, c, any_value(s) AS s, max(k) AS e, any_value(nf) AS nf FROM steps GROUP BY 1, 2),
tails AS (SELECT x.*, max(c) OVER (PARTITION BY x.document_id) AS last_c FROM drafts x),
merges AS (SELECT p.document_id, t.e AS e FROM tails t JOIN tails p ON t.document_id = p.document_id AND t.c = t.last_c AND p.c = t.c - 1 JOIN docs_ d ON d.document_id = t.document_id WHERE {_size('t.nf', 't.e')} < {_L} AND {_size('p.s', 't.e')} <= {_M}),
ranges AS (SELECT t.document_id, t.c, t.s, CASE WHEN m.e IS NOT NULL AND t.c = t.last_c - 1 THEN m.e ELSE t.e END AS e, t.nf FROM tails t LEFT JOIN merges m ON t.document_id = m.document_id WHERE NOT (m.e IS NOT NULL AND t.c = t.last_c)),
texts AS (SELECT r.document_id, r.c, r.s, r.nf, string_agg((CASE WHEN u.k = r.s THEN '' WHEN u.gap = 2 THEN chr(10) || chr(10) ELSE ' ' END) || u.unit, '' ORDER BY u.k) AS content,
  sum(CASE WHEN u.k < r.nf THEN u.len + (CASE WHEN u.k = r.s THEN 0 ELSE u.gap END) ELSE 0 END) AS overlap FROM ranges r JOIN sized u ON u.document_id = r.document_id AND u.k BETWEEN r.s AND r.e GROUP BY 1, 2, 3, 4)"""


@query(f"WITH RECURSIVE {_PROSE}, {_PARAGRAPHS}, {_SENTENCES}, {_UNITS}, {_PACKED} SELECT document_id, c::INTEGER AS chunk_index, content, ceil(length(content) / 4)::INTEGER AS token_estimate, overlap::INTEGER AS overlap_chars FROM texts")
def c8_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(_prose(spark, sf_dir), OPTIONS)


@query(f"""WITH {V.LINE_CHUNKS}, n AS (SELECT document_id, count(*) AS n FROM lines GROUP BY 1)
  SELECT document_id, NULL::INTEGER AS chunk_index, 'Document is too large to process: ' || n || ' chunks (limit 12)' AS error_message FROM n WHERE n > 12
  UNION ALL SELECT l.document_id, l.chunk_index, NULL FROM lines l JOIN n ON l.document_id = n.document_id WHERE n <= 12""")
def c9_cap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, failed = chunking.capped(V.line_chunks(spark, sf_dir), 12)
    return failed.select("document_id", F.lit(None).cast("int").alias("chunk_index"), "error_message").unionByName(kept.select("document_id", "chunk_index", F.lit(None).cast("string").alias("error_message")))


@query(f"WITH {V.LINE_CHUNKS} SELECT document_id, chunk_index, ((row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1) // 90)::INTEGER AS batch_no FROM lines")
def d1_plan_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.batched(V.line_chunks(spark, sf_dir)).select("document_id", "chunk_index", "batch_no")


#: A vector in three numbers: its length, its norm, and its components weighed by their places.
DIGEST = ["size(embedding) AS dim", "round(sqrt(aggregate(embedding, 0D, (s, x) -> s + x * x)), 6) AS norm", "round(aggregate(transform(embedding, (x, i) -> x * (i + 1)), 0D, (s, x) -> s + x), 6) AS weighed"]
DIGEST_SQL = "len(v)::INTEGER AS dim, round(norm, 6) AS norm, round(list_sum([v[i] * i FOR i IN range(1, 65)]), 6) AS weighed"


@query(f"WITH {V.LINE_CHUNKS}, inputs AS (SELECT chunk_id AS id, concat('title: none | text: ', content) AS input FROM lines), {V.hashed_vectors('inputs', 'e')} SELECT id AS chunk_id, {DIGEST_SQL} FROM e")
def d2_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.line_chunks(spark, sf_dir).select("chunk_id", C.passage_input(F.lit(""), "content").alias("input"))
    return embedding.embedded(rows, dim=64).selectExpr("chunk_id", *DIGEST)


@query("""SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'missing' WHEN vec_id % 11 = 1 THEN 'wrong size' WHEN vec_id % 11 = 2 THEN 'not finite' WHEN len(embedding) <> 64 THEN 'wrong size' END AS problem FROM embeddings""")
def d3_check_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    bad = F.when(F.col("vec_id") % 11 == 1, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 11 == 2, F.transform("embedding", lambda x, i: F.when(i == 5, F.lit(float("nan")).cast("float")).otherwise(x))).otherwise(F.col("embedding"))
    good, problems = embedding.checked(e, e.where("vec_id % 11 <> 0").select("vec_id", bad.alias("embedding")), "vec_id", 64)
    return good.select("vec_id", F.lit(None).cast("string").alias("problem")).unionByName(problems)


@query(f"""WITH {V.LINE_CHUNKS}, n AS (SELECT document_id, count(*) AS chunks_total, count(CASE WHEN chunk_index < 7 THEN 1 END) AS chunks_embedded FROM lines GROUP BY 1)
  SELECT document_id, chunks_total, chunks_embedded, least(chunks_embedded + 90, chunks_total) AS working_until, CASE WHEN chunks_embedded < chunks_total THEN 'embedding' ELSE 'saving' END AS stage FROM n""")
def d4_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.line_chunks(spark, sf_dir).withColumn("embedding", F.when(F.col("chunk_index") < 7, F.array(F.lit(1.0))))
    return embedding.progress(rows)
