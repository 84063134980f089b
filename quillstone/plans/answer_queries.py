"""Queries over retrieval, prompts, answers and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import columns as C
from quillstone.operators import answers as A
from quillstone.operators import embedding, flow
from quillstone.operators import retrieval as R
from quillstone.plans import views as V
from quillstone.plans.registry import query
from quillstone.plans.text_queries import DIGEST, DIGEST_SQL
from quillstone.sources.tables import scratch, table

RULE = R.Relevance(V.SKIP_BELOW, V.FLOOR, V.WINDOW, 5)
WS = C.WS


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search_scope(V.vector_chunks(spark, sf_dir), V.vector_documents(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight candidates of every question, itself left out."""
    q = V.questions(spark, sf_dir)
    found = R.topk_batch(q, _scope(spark, sf_dir), R.CANDIDATES + 1).where("chunk_id <> question_id")
    again = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
    return found.withColumn("rank", again).where(F.col("rank") <= R.CANDIDATES)


def _selected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    q, c = V.questions(spark, sf_dir), _candidates(spark, sf_dir)
    return (q, c, *R.selected_sources(q, c, RULE))


@query("""SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], [CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END FOR i IN range(0, len(embedding))]::DOUBLE[]) AS similarity FROM embeddings""")
def e1_cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = F.transform("embedding", lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", C.cosine("embedding", axis).alias("similarity"))


@query(f"WITH {V.VECTORS} SELECT user_id, document_id, filename, chunk_id, chunk_index FROM scope")
def e2_search_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scope(spark, sf_dir).select("user_id", "document_id", "filename", "chunk_id", "chunk_index")


@query(f"""WITH {V.VECTORS} SELECT chunk_id, document_id, similarity FROM (SELECT s.chunk_id, s.document_id, list_cosine_similarity([1.0 FOR i IN range(0, len(s.embedding))]::DOUBLE[], s.embedding::DOUBLE[]) AS similarity
  FROM scope s WHERE s.user_id = 3 ORDER BY similarity DESC, chunk_id LIMIT 20)""")
def e3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 passages of one user nearest to one question (a top-k report)."""
    dim = 64
    return R.topk([1.0] * dim, _scope(spark, sf_dir), 3, 20).select("chunk_id", "document_id", "similarity")


@query(f"WITH {V.VECTORS} SELECT question_id, rank::INTEGER AS rank, chunk_id, document_id, similarity FROM candidates")
def e4_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("question_id", "rank", "chunk_id", "document_id", "similarity")


@query(f"WITH {V.VECTORS} SELECT question_id, chunk_id, floor(similarity * 10000 + 0.5) / 10000 AS similarity FROM pairs")
def e5_round4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = R.similarities(V.questions(spark, sf_dir), _scope(spark, sf_dir)).where("question_id <> chunk_id")
    return pairs.select("question_id", "chunk_id", C.round4("similarity").alias("similarity"))


@query(rf"""WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 5 THEN NULL WHEN turn % 7 = 6 THEN '   ' ELSE concat('  ', text, chr(10)) END AS raw, CASE turn % 5 WHEN 0 THEN NULL WHEN 1 THEN 21.0 WHEN 2 THEN 2.5 ELSE 7.0 END AS top_k FROM conversations),
  t AS (SELECT *, regexp_replace(raw, '^[{WS}]+|[{WS}]+$', '', 'g') AS question FROM q)
  SELECT conv_id, turn, question, CASE WHEN raw IS NULL THEN 'question is required and must be a string' WHEN length(question) < 1 THEN 'question must not be empty' WHEN length(question) > 2000 THEN 'Question is too long (max 2,000 characters)'
    WHEN top_k IN (21.0, 2.5) THEN 'topK must be a whole number between 1 and 20' END AS error FROM t""")
def e6_clean_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    raw = F.when(F.col("turn") % 7 == 5, None).when(F.col("turn") % 7 == 6, "   ").otherwise(F.concat(F.lit("  "), "text", F.lit("\n")))
    k = F.expr("CASE turn % 5 WHEN 0 THEN NULL WHEN 1 THEN 21.0D WHEN 2 THEN 2.5D ELSE 7.0D END")
    good, bad = R.cleaned_questions(c.select("conv_id", "turn", raw.alias("question"), k.alias("top_k")))
    return good.select("conv_id", "turn", "question", F.lit(None).cast("string").alias("error")).unionByName(bad.select("conv_id", "turn", "question", "error"))


@query(f"WITH {V.VECTORS} SELECT v.question_id, v.skip_reason, s.marker::INTEGER AS marker, s.chunk_id, s.similarity FROM verdicts v LEFT JOIN sources s ON v.question_id = s.question_id")
def e7_select_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, verdicts, sources = _selected(spark, sf_dir)
    return verdicts.join(sources, "question_id", "left").select("question_id", "skip_reason", "marker", "chunk_id", "similarity")


@query(f"""WITH {V.VECTORS} SELECT v.question_id, coalesce(n, 0) AS candidates, coalesce(m, 0) AS sources_used, floor(v.best_similarity * 10000 + 0.5) / 10000 AS best_similarity, v.skip_reason
  FROM verdicts v LEFT JOIN (SELECT question_id, count(*) AS n FROM candidates GROUP BY 1) c ON v.question_id = c.question_id LEFT JOIN (SELECT question_id, count(*) AS m FROM sources GROUP BY 1) s ON v.question_id = s.question_id""")
def e8_retrieval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retrieval_stats(*_selected(spark, sf_dir))


_ESCAPED = "replace(replace(replace(replace(filename, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')"
_DEFUSED = r"regexp_replace(content, '(?i)<([\t\n\x0B\f\r ]*/?[\t\n\x0B\f\r ]*sources?\b)', '&lt;\1', 'g')"


@query(f"""WITH {V.ANSWERS}, {V.ANSWER_SOURCES} SELECT s.question_id, concat('<sources>', chr(10), string_agg(concat('<source id="', marker::VARCHAR, '" file="', {_ESCAPED}, '">', chr(10), {_DEFUSED}, chr(10), '</source>'), chr(10) ORDER BY marker), chr(10), '</sources>', chr(10), chr(10), 'Question: ', any_value(a.question)) AS prompt
  FROM answer_sources s JOIN answers a ON s.question_id = a.answer_id GROUP BY 1""")
def f1_build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = V.answers(spark, sf_dir).select(F.col("answer_id").alias("question_id"), "question")
    return A.prompts(asked, V.answer_sources(spark, sf_dir).drop("question"))


#: What the stand-in makes of the first two sources, and what it cites.
_GENERATED = f"generated AS (SELECT question_id, string_agg(array_to_string(string_split({_DEFUSED}, ' ')[1:12], ' ') || ' [' || marker || '].', ' ' ORDER BY marker) AS text, string_agg(marker || ':' || chunk_id || ':' || filename, ', ' ORDER BY marker) AS cited FROM sources WHERE marker <= 2 GROUP BY 1)"


@query(f"WITH {V.VECTORS}, {_GENERATED} SELECT question_id, text, 'STOP' AS finish_reason, NULL::VARCHAR AS block_reason FROM generated")
def f3_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _, _, sources = _selected(spark, sf_dir)
    return A.generated(A.prompts(q, sources))


@query(f"""WITH {V.VECTORS} SELECT question_id, CASE skip_reason WHEN 'no_documents' THEN $${A.NO_DOCUMENTS}$$ ELSE $${A.REFUSAL}$$ END AS answer, NULL::VARCHAR AS model FROM verdicts WHERE skip_reason IS NOT NULL""")
def f4_canned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.canned_answers(_selected(spark, sf_dir)[2])


_RAW = "CASE conv_id % 5 WHEN 0 THEN 'STOP' WHEN 1 THEN 'MAX_TOKENS' WHEN 2 THEN 'SAFETY' WHEN 3 THEN 'OTHER' END AS finish_reason, CASE WHEN turn % 6 = 5 THEN 'PROHIBITED' END AS block_reason, CASE WHEN conv_id % 4 = 3 THEN '  ' ELSE concat(' ', text, ' ') END AS text"


@query(rf"""SELECT conv_id, turn, regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g') AS text, CASE WHEN block_reason IS NOT NULL OR coalesce(finish_reason, '') = 'SAFETY' THEN 'blocked' WHEN regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g') = '' OR coalesce(finish_reason, '') = 'OTHER' THEN 'bad_response' ELSE 'ok' END AS outcome,
  coalesce(finish_reason, '') = 'MAX_TOKENS' AS truncated FROM (SELECT conv_id, turn, {_RAW} FROM conversations)""")
def f5_response_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", *_raw_columns())
    return A.outcomes(raw).select("conv_id", "turn", "text", "outcome", "truncated")


def _raw_columns() -> list[str]:
    finish, rest = _RAW.split(" AS finish_reason, ")
    block, body = rest.split(" AS block_reason, ")
    return [f"{finish} AS finish_reason", f"{block} AS block_reason", body]


_CALLS = """CASE event_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 WHEN 4 THEN NULL ELSE 429 END AS status,
  CASE event_id % 6 WHEN 0 THEN concat('{"retryDelay": "', cast(event_id % 50 AS {text}), '.25s"}') WHEN 1 THEN 'busy' WHEN 5 THEN '{"retryDelay" : "3600s"}' ELSE 'x' END AS message"""


@query(f"""WITH calls AS (SELECT event_id, {_CALLS.replace('{text}', 'VARCHAR')} FROM events), k AS (SELECT *, CASE WHEN status = 429 THEN 'rate-limit' WHEN status IS NULL OR status >= 500 THEN 'transient' ELSE 'fatal' END AS kind FROM calls),
  w AS (SELECT event_id, kind, CASE WHEN kind = 'rate-limit' THEN coalesce(ceil(try_cast(nullif(regexp_extract(message, '"retryDelay"\\s*:\\s*"([0-9]+(?:\\.[0-9]+)?)s"', 1), '') AS DOUBLE) * 1000), 20000)::BIGINT END AS wait_ms FROM k)
  SELECT *, coalesce(wait_ms > 90000, false) AS daily_quota FROM w""")
def f6_call_failure_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, message = _CALLS.replace("{text}", "STRING").split(" AS status,")
    calls = table(spark, sf_dir, "events").selectExpr("event_id", f"{status} AS status", message.strip())
    return A.failure_kinds(calls).select("event_id", "kind", "wait_ms", "daily_quota")


_GROUPS = rf"string_to_array(regexp_replace(g, '[\[\]{WS}]', '', 'g'), ',')"
_CHECKED = rf"""marks AS (SELECT answer_id AS question_id, answer, regexp_extract_all(answer, '{A.GROUP}') AS gs, string_split_regex(answer, '{A.GROUP}') AS ps FROM answers),
each AS (SELECT question_id, gi, unnest({_GROUPS})::INTEGER AS n, generate_subscripts({_GROUPS}, 1) AS ni FROM (SELECT question_id, unnest(gs) AS g, generate_subscripts(gs, 1) AS gi FROM marks)),
firsts AS (SELECT question_id, gi, n, min(ni) AS ni FROM each WHERE n BETWEEN 1 AND 4 GROUP BY 1, 2, 3),
shown AS (SELECT question_id, gi, '[' || string_agg(n::VARCHAR, ', ' ORDER BY ni) || ']' AS shown FROM firsts GROUP BY 1, 2),
parts AS (SELECT question_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS gi, len(gs) AS m FROM marks),
texts AS (SELECT p.question_id, regexp_replace(string_agg(CASE WHEN p.gi > p.m THEN p.p WHEN s.shown IS NULL THEN regexp_replace(p.p, '[ \t]+\z', '') ELSE p.p || s.shown END, '' ORDER BY p.gi), '^[{WS}]+|[{WS}]+$', '', 'g') AS answer FROM parts p LEFT JOIN shown s ON p.question_id = s.question_id AND p.gi = s.gi GROUP BY 1),
sets AS (SELECT m.question_id, coalesce(list_sort(list_distinct(list(n) FILTER (n BETWEEN 1 AND 4))), []) AS cited, coalesce(list_sort(list_distinct(list(n) FILTER (NOT n BETWEEN 1 AND 4))), []) AS invalid FROM marks m LEFT JOIN each e ON m.question_id = e.question_id GROUP BY 1)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.answers(spark, sf_dir).withColumnRenamed("answer_id", "question_id")


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.checked_citations(_answers(spark, sf_dir).select("question_id", "answer"), V.answer_sources(spark, sf_dir))


@query(f"WITH {V.ANSWERS}, {_CHECKED} SELECT question_id, (gi - 1)::INTEGER AS group_no, n AS marker FROM each")
def f7_extract_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.markers(_answers(spark, sf_dir))


@query(f"WITH {V.ANSWERS}, {_CHECKED} SELECT t.question_id, t.answer, array_to_string(cited, ',') AS cited, array_to_string(invalid, ',') AS invalid FROM texts t JOIN sets s ON t.question_id = s.question_id")
def f8_check_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return _checked(spark, sf_dir).select("question_id", "answer", joined("cited"), joined("invalid"))


@query(f"WITH {V.ANSWERS}, {_CHECKED} SELECT question_id, len(cited) > 0 AS answered FROM sets")
def f9_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("question_id", (F.size("cited") > 0).alias("answered"))


_PLAIN = rf"trim(regexp_replace(content, '[{WS}]+', ' ', 'g'))"
_SNIPPET = f"CASE WHEN length({_PLAIN}) <= 300 THEN {_PLAIN} ELSE rtrim(CASE WHEN contains(left({_PLAIN}, 300), ' ') AND 300 - instr(reverse(left({_PLAIN}, 300)), ' ') > 180 THEN left({_PLAIN}, 300 - instr(reverse(left({_PLAIN}, 300)), ' ')) ELSE left({_PLAIN}, 300) END) || '…' END"


@query(f"""WITH {V.ANSWERS}, {V.ANSWER_SOURCES}, {_CHECKED}, c AS (SELECT question_id, unnest(cited) AS marker FROM sets)
  SELECT s.question_id, s.marker, s.chunk_id, s.document_id, s.filename, s.chunk_index, floor(s.similarity * 10000 + 0.5) / 10000 AS similarity, {_SNIPPET} AS snippet FROM c JOIN answer_sources s ON c.question_id = s.question_id AND c.marker = s.marker""")
def f10_citation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = A.citation_records(_checked(spark, sf_dir), V.answer_sources(spark, sf_dir))
    return records.select("question_id", F.explode("citations").alias("c")).select("question_id", "c.*")


@query(f"WITH x AS (SELECT doc_id, text AS content FROM documents) SELECT doc_id, {_SNIPPET} AS snippet FROM x")
def f11_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.snippet("text").alias("snippet"))


@query(rf"WITH {V.ANSWERS} SELECT answer_id, regexp_replace(answer, '[ \t]*\[[0-9]+(?:, *[0-9]+)*\]', '', 'g') AS prose FROM answers")
def f12_strip_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.answers(spark, sf_dir).select("answer_id", C.without_markers("answer").alias("prose"))


@query("""WITH h AS (SELECT vec_id AS answer_id, label AS user_id, vec_id % 3 AS kind, vec_id AS c1, vec_id + 10000000 AS c2, vec_id - vec_id % 10 AS c3 FROM embeddings WHERE vec_id % 3 <> 1),
  e AS (SELECT answer_id, user_id, unnest([1, 2, 3]) AS marker, unnest([c1, c2, c3]) AS chunk_id FROM h)
  SELECT e.answer_id, e.user_id, e.marker, e.chunk_id, o.chunk_id IS NOT NULL AS available FROM e LEFT JOIN (SELECT DISTINCT vec_id AS chunk_id, label AS user_id FROM embeddings) o ON e.chunk_id = o.chunk_id AND e.user_id = o.user_id""")
def f13_citation_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = "concat('{\"marker\": 1, \"chunk_id\": ', cast(vec_id as string), '}')"
    three = "concat('[{\"marker\": 1, \"chunk_id\": ', cast(vec_id as string), '}, {\"marker\": 2, \"chunk_id\": ', cast(vec_id + 10000000 as string), '}, {\"marker\": 3, \"chunk_id\": ', cast(vec_id - vec_id % 10 as string), '}]')"
    h = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS answer_id", "label AS user_id", f"CASE WHEN vec_id % 3 = 1 THEN {one} ELSE {three} END AS citations")
    return A.availability(h, V.vector_chunks(spark, sf_dir), V.vector_documents(spark, sf_dir))


@query("SELECT conv_id, turn, outcome, outcome IN ('ok', 'skipped') AS saved FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'skipped' WHEN 2 THEN 'blocked' ELSE 'bad_response' END AS outcome FROM conversations)")
def f14_finished_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "CASE turn % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'skipped' WHEN 2 THEN 'blocked' ELSE 'bad_response' END AS outcome")
    good, bad = A.finished(rows)
    return good.withColumn("saved", F.lit(True)).unionByName(bad.withColumn("saved", F.lit(False)))


_CODES = [c for c, *_ in A.FAILURES]


@query(
    "WITH f AS (SELECT code, count(*) AS n FROM (SELECT CASE event_id % 8 "
    + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES))
    + " END AS code FROM events) GROUP BY 1), k(code, http_status, message, retry_after_seconds, log) AS (VALUES "
    + ", ".join(f"('{c}', {s}, {'NULL' if m is None else repr(m.format('Answering', 'answering'))}, {r or 'NULL'}, {str(log).lower()})" for c, s, m, r, log in A.FAILURES)
    + ") SELECT k.*, f.n FROM f JOIN k ON f.code = k.code"
)
def f15_failure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END AS code"
    return A.failure_report(table(spark, sf_dir, "events").selectExpr(code))


_FLAGSHIP = rf"""{V.VECTORS.split("pairs AS")[0].rstrip(", \n")},
passages AS (SELECT chunk_id AS id, concat('title: ', replace(regexp_replace(filename, '\.[^.]+$', ''), '_', ' '), ' | text: ', content) AS input FROM scope),
asked AS (SELECT question_id AS id, concat('task: search result | query: passage ', question_id, ' of the library') AS input FROM questions),
{V.hashed_vectors('passages', 'pv')}, {V.hashed_vectors('asked', 'qv')},
pairs AS (SELECT q.question_id, s.* EXCLUDE (embedding), list_sum([qv.v[i] * pv.v[i] FOR i IN range(1, 65)]) / (qv.norm * pv.norm) AS similarity FROM questions q JOIN scope s ON q.user_id = s.user_id JOIN qv ON qv.id = q.question_id JOIN pv ON pv.id = s.chunk_id),
{V.SELECTION}"""


@query(f"""WITH {_FLAGSHIP}, {_GENERATED} SELECT q.question_id, q.user_id, concat('passage ', q.question_id, ' of the library') AS question, coalesce(g.text, CASE v.skip_reason WHEN 'no_documents' THEN $${A.NO_DOCUMENTS}$$ ELSE $${A.REFUSAL}$$ END) AS answer, g.text IS NOT NULL AS answered,
  coalesce(g.cited, '') AS cited, coalesce(n, 0) AS candidates, coalesce(m, 0) AS sources_used, floor(v.best_similarity * 10000 + 0.5) / 10000 AS best_similarity, v.skip_reason
  FROM questions q JOIN verdicts v ON q.question_id = v.question_id LEFT JOIN generated g ON q.question_id = g.question_id LEFT JOIN (SELECT question_id, count(*) AS n FROM candidates GROUP BY 1) c ON q.question_id = c.question_id LEFT JOIN (SELECT question_id, count(*) AS m FROM sources GROUP BY 1) s ON q.question_id = s.question_id""")
def f16_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: clean questions → vectors → candidates → sources → prompts → answers → checked citations → statistics.

    Passages and questions get their vectors from one function.
    """
    folder = scratch(spark, "answers")
    passages = _scope(spark, sf_dir).drop("embedding").withColumn("input", C.passage_input(C.title("filename"), "content"))
    scope = flow.written(embedding.embedded(passages, dim=64).drop("input"), f"{folder}/passages")
    asked = V.questions(spark, sf_dir).select("question_id", "user_id", F.expr("concat('passage ', cast(question_id as string), ' of the library')").alias("question"), F.lit(None).cast("int").alias("top_k"))
    good, _ = R.cleaned_questions(asked)
    saved, _ = flow.answered_questions(good, scope, folder, rule=RULE, dim=64)
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["marker"].cast("string"), c["chunk_id"].cast("string"), c["filename"])), ", ")
    return saved.select("question_id", "user_id", "question", "answer", "answered", cited.alias("cited"), "candidates", "sources_used", "best_similarity", "skip_reason")


#: Turns as questions, some of them malformed; words that the stand-ins below fail on.
_KIND = "(conv_id * 7 + turn) % 12"
_RAW_QUESTION = f"CASE {_KIND} WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 3 THEN repeat('long ', 500) ELSE concat(' passage ', cast(conv_id AS varchar(20)), ' of the library', CASE {_KIND} WHEN 4 THEN ' unsafe' WHEN 5 THEN ' forbidden' WHEN 6 THEN ' silent' WHEN 7 THEN ' odd' WHEN 8 THEN ' broken' ELSE '' END) END"
_TOP_K = f"CASE {_KIND} WHEN 2 THEN 21 ELSE 5 END"


def _flawed_vectors(dim: int):
    words = embedding.hashed_words(dim)
    return lambda texts: [[float("nan")] * dim if "broken" in t else v for t, v in zip(texts, words(texts), strict=True)]


def _flawed_answers(prompts: list[str]) -> list[tuple]:
    def answer(prompt: str, whole: tuple) -> tuple:
        asked = prompt.rsplit("Question: ", 1)[-1]
        flaws = {"unsafe": (None, "SAFETY", None), "forbidden": (None, None, "PROHIBITED"), "silent": ("  ", "STOP", None), "odd": (whole[0], "OTHER", None)}
        return next((raw for word, raw in flaws.items() if word in asked), whole)

    return [answer(p, w) for p, w in zip(prompts, A.first_sentences(prompts), strict=True)]


def _code_values(*codes: str) -> str:
    return ", ".join(f"('{c}', {s}, {'NULL' if m is None else repr(m.format('Answering', 'answering'))}, {r or 'NULL'}, {str(log).lower()})" for c, s, m, r, log in A.FAILURES if c in codes)


@query(rf"""WITH raw AS (SELECT conv_id * 1000 + turn AS question_id, (conv_id % 10)::INTEGER AS user_id, {_KIND} AS kind, {_RAW_QUESTION} AS raw, {_TOP_K} AS top_k FROM conversations),
judged AS (SELECT *, trim(raw) AS question, CASE WHEN raw IS NULL THEN 'question is required and must be a string' WHEN trim(raw) = '' THEN 'question must not be empty' WHEN length(trim(raw)) > 2000 THEN 'Question is too long (max 2,000 characters)' WHEN top_k > 20 THEN 'topK must be a whole number between 1 and 20' END AS error FROM raw),
{V.VECTORS.split("questions AS")[0]}scope AS (SELECT c.chunk_id, c.content, d.user_id, d.filename FROM vchunks c JOIN vdocs d ON c.document_id = d.document_id WHERE d.status = 'ready' AND c.embedding IS NOT NULL),
asked AS (SELECT question_id AS id, concat('task: search result | query: ', question) AS input FROM judged WHERE error IS NULL AND kind <> 8),
passages AS (SELECT chunk_id AS id, concat('title: ', replace(regexp_replace(filename, '\.[^.]+$', ''), '_', ' '), ' | text: ', content) AS input FROM scope),
{V.hashed_vectors('passages', 'pv')}, {V.hashed_vectors('asked', 'qv')},
best AS (SELECT j.question_id, max(list_sum([qv.v[i] * pv.v[i] FOR i IN range(1, 65)]) / (qv.norm * pv.norm)) AS best FROM judged j JOIN qv ON qv.id = j.question_id JOIN scope s ON s.user_id = j.user_id JOIN pv ON pv.id = s.chunk_id GROUP BY 1),
failed AS (SELECT question_id, CASE WHEN kind IN (4, 5) THEN 'blocked' ELSE 'bad_response' END AS code, CASE kind WHEN 4 THEN $${A.ANSWER_BLOCKED}$$ WHEN 5 THEN $${A.PROMPT_BLOCKED}$$ END AS detail FROM judged JOIN best USING (question_id) WHERE kind IN (4, 5, 6, 7) AND best >= {RULE.skip_below}
  UNION ALL SELECT question_id, 'bad_response', NULL FROM judged WHERE kind = 8),
known(code, http_status, message, retry_after_seconds, log) AS (VALUES {_code_values("blocked", "bad_response")})
SELECT question_id, 'invalid' AS code, 400 AS http_status, error AS message, NULL::INTEGER AS retry_after_seconds, false AS log FROM judged WHERE error IS NOT NULL
UNION ALL SELECT question_id, code, http_status, coalesce(message, detail), retry_after_seconds, log FROM failed JOIN known USING (code)""")
def f16_unanswered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's other half: questions that were refused, and those whose vector or answer failed, with what their askers are told."""
    folder = scratch(spark, "unanswered")
    passages = _scope(spark, sf_dir).drop("embedding").withColumn("input", C.passage_input(C.title("filename"), "content"))
    scope = flow.written(embedding.embedded(passages, dim=64).drop("input"), f"{folder}/passages")
    turns = table(spark, sf_dir, "conversations")
    asked = turns.selectExpr("conv_id * 1000 + turn AS question_id", "cast(conv_id % 10 AS int) AS user_id", f"{_RAW_QUESTION} AS question", f"{_TOP_K} AS top_k")
    good, rejected = R.cleaned_questions(asked)
    _, failures = flow.answered_questions(good, scope, folder, _flawed_vectors(64), _flawed_answers, RULE, 64)
    return A.unanswered(rejected, failures)


@query(f"WITH inputs AS (SELECT item_id AS id, concat('task: search result | query: ', text) AS input FROM benchmark), {V.hashed_vectors('inputs', 'e')} SELECT id AS item_id, {DIGEST_SQL} FROM e")
def d2_embed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, embedded by the same function as passages."""
    b = table(spark, sf_dir, "benchmark").select("item_id", C.question_input("text").alias("input"))
    return embedding.embedded(b, dim=64).selectExpr("item_id", *DIGEST)
