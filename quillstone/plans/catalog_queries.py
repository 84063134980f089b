"""Queries over the catalog, the history and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import catalog as G
from quillstone.plans import views as V
from quillstone.plans.registry import query
from quillstone.sources.tables import table

AS_OF = "2024-01-01 08:00:00"


@query(f"""WITH {V.DOCUMENTS}, {V.LINE_CHUNKS}, n AS (SELECT document_id, count(*) AS n FROM lines GROUP BY 1)
  SELECT user_id, d.document_id, filename, status, coalesce(n, 0) AS chunk_count, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, d.document_id)::INTEGER AS place FROM docs d LEFT JOIN n ON d.document_id = n.document_id""")
def g1_list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = V.line_chunks(spark, sf_dir)
    return G.list_documents(V.documents(spark, sf_dir), chunks).select("user_id", "document_id", "filename", "status", "chunk_count", "place")


@query(f"WITH {V.DOCUMENTS}, {V.LINE_CHUNKS} SELECT d.user_id, l.document_id, l.chunk_index, length(content)::INTEGER AS char_count, ceil(length(content) / 4)::INTEGER AS token_estimate FROM lines l JOIN docs d ON l.document_id = d.document_id")
def g2_document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.document_chunks(V.documents(spark, sf_dir), V.line_chunks(spark, sf_dir))


#: Deletions asked for: every seventh document, by its owner or (every fourteenth) by someone else.
_REQUESTS = "SELECT doc_id AS document_id, CASE WHEN doc_id % 14 = 0 THEN 'nobody' ELSE source END AS user_id FROM documents WHERE doc_id % 7 = 0"


@query(f"""WITH {V.DOCUMENTS}, {V.LINE_CHUNKS}, r AS ({_REQUESTS}), gone AS (SELECT d.document_id FROM docs d JOIN r ON d.document_id = r.document_id AND d.user_id = r.user_id)
  SELECT 'documents' AS table_name, document_id, count(*) AS n FROM docs WHERE document_id NOT IN (SELECT * FROM gone) GROUP BY 2
  UNION ALL SELECT 'chunks', document_id, count(*) FROM lines WHERE document_id NOT IN (SELECT * FROM gone) GROUP BY 2 UNION ALL SELECT 'deleted', NULL, (SELECT count(*) FROM gone)""")
def g3_delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").selectExpr("doc_id AS document_id", "CASE WHEN doc_id % 14 = 0 THEN 'nobody' ELSE source END AS user_id")
    out = G.delete_documents(requests, V.documents(spark, sf_dir), V.line_chunks(spark, sf_dir))
    count = lambda name: out[name].groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "document_id", "n")
    deleted = out["deleted"].select(F.lit("deleted").alias("table_name"), F.lit(None).cast("long").alias("document_id"), F.col("deleted").alias("n"))
    return count("documents").unionByName(count("chunks")).unionByName(deleted)


@query(f"""WITH {V.DOCUMENTS}, {V.LINE_CHUNKS}, gone AS (SELECT DISTINCT source AS user_id FROM documents WHERE lang = 'es'),
  users AS (SELECT DISTINCT user_id FROM docs)
  SELECT 'users' AS table_name, count(*) AS n FROM users WHERE user_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'documents', count(*) FROM docs WHERE user_id NOT IN (SELECT * FROM gone)
  UNION ALL SELECT 'chunks', count(*) FROM lines WHERE document_id NOT IN (SELECT document_id FROM docs WHERE user_id IN (SELECT * FROM gone))""")
def g3_delete_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.documents(spark, sf_dir)
    users = docs.select("user_id").distinct()
    gone = table(spark, sf_dir, "documents").where("lang = 'es'").select(F.col("source").alias("user_id"))
    out = G.delete_users(gone, users, docs, V.line_chunks(spark, sf_dir), users, users)
    parts = [out[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name in ("users", "documents", "chunks")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {V.ANSWERS} SELECT user_id, answer_id, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, answer_id) AS place FROM answers) WHERE place <= 20")
def g4_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's 20 newest answers (the feature's own limit)."""
    return G.history(V.answers(spark, sf_dir)).select("user_id", "answer_id", "place")


@query(f"""WITH {V.DOCUMENTS}, {V.LINE_CHUNKS}, n AS (SELECT document_id, count(*) AS n FROM lines GROUP BY 1)
  SELECT user_id, count(*) AS ready_documents, sum(coalesce(n, 0))::BIGINT AS passages FROM docs d LEFT JOIN n ON d.document_id = n.document_id WHERE status = 'ready' GROUP BY 1""")
def g5_library_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.library_totals(V.documents(spark, sf_dir), V.line_chunks(spark, sf_dir))


@query(f"WITH {V.LINE_CHUNKS} SELECT document_id, floor(avg(ceil(length(content) / 4)) + 0.5)::BIGINT AS mean_tokens FROM lines GROUP BY 1")
def g6_mean_chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mean_chunk_tokens(V.line_chunks(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id AS document_id, n_chars // 20 AS total, CASE WHEN doc_id % 2 = 0 THEN n_chars // 40 END AS embedded FROM documents), h AS (SELECT document_id, unnest([0, total // 3, total - 1]) AS chunk_index FROM d),
  c AS (SELECT *, greatest(1, least(total, 96)) AS cells FROM d), b AS (SELECT *, unnest(range(0, cells)) AS bin FROM c),
  r AS (SELECT *, floor(bin * (total::DOUBLE / cells))::BIGINT AS first, greatest(floor(bin * (total::DOUBLE / cells))::BIGINT + 1, floor((bin + 1) * (total::DOUBLE / cells))::BIGINT) AS stop FROM b)
  SELECT document_id, bin::INTEGER AS bin, first, stop AS end, CASE WHEN embedded IS NULL OR stop <= embedded THEN 'done' WHEN first < least(embedded + 90, total) THEN 'working' ELSE 'waiting' END AS state,
    EXISTS (SELECT 1 FROM h WHERE h.document_id = r.document_id AND h.chunk_index >= r.first AND h.chunk_index < r.stop AND h.chunk_index < r.total) AS hit FROM r""")
def g7_strip_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id AS document_id", "n_chars div 20 AS total", "CASE WHEN doc_id % 2 = 0 THEN n_chars div 40 END AS embedded")
    hits = d.selectExpr("document_id", "explode(array(0L, total div 3, total - 1)) AS chunk_index")
    return G.strip_bins(d, hits)


_SNAPSHOT = "CASE WHEN (doc_id + step) % 5 < 2 THEN 'processing' WHEN (doc_id + step) % 5 = 2 THEN 'ready' ELSE 'failed' END"


@query(f"""WITH s AS (SELECT doc_id AS document_id, step AS snapshot_ts, {_SNAPSHOT} AS status FROM documents, (SELECT unnest([1, 2, 3, 4]) AS step)), l AS (SELECT *, lag(status) OVER (PARTITION BY document_id ORDER BY snapshot_ts) AS was FROM s)
  SELECT document_id, snapshot_ts, status FROM l WHERE was = 'processing' AND status IN ('ready', 'failed')""")
def g8_status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("step"))
    return G.status_changes(steps.selectExpr("doc_id AS document_id", "step AS snapshot_ts", f"{_SNAPSHOT} AS status")).select("document_id", "snapshot_ts", "status")


@query(f"""WITH {V.DOCUMENTS}, {V.LINE_CHUNKS}, e AS (SELECT doc_id AS document_id, CASE WHEN quality = 1 THEN 'Could not read the file' ELSE '{G.GENERIC_FAILURE}' END AS message FROM labels WHERE toxic = 1),
  n AS (SELECT document_id, count(*) AS n FROM lines WHERE document_id NOT IN (SELECT document_id FROM e) GROUP BY 1)
  SELECT d.document_id, CASE WHEN e.message IS NOT NULL THEN 'failed' ELSE status END AS status, coalesce(e.message, error_message) AS error_message, coalesce(n, 0) AS chunk_count FROM docs d LEFT JOIN e ON d.document_id = e.document_id LEFT JOIN n ON d.document_id = n.document_id""")
def g9_mark_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "labels").where("toxic = 1").selectExpr("doc_id AS document_id", "'Could not read the file' AS message", "quality = 1 AS user_facing")
    docs, chunks = G.mark_failed(V.documents(spark, sf_dir), V.line_chunks(spark, sf_dir), errors)
    return docs.join(G.chunk_counts(chunks), "document_id", "left").select("document_id", "status", "error_message", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


@query(f"""WITH {V.DOCUMENTS}, s AS (SELECT *, status = 'processing' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTE AS stale FROM docs)
  SELECT document_id, stale, CASE WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN '{G.INTERRUPTED}' ELSE error_message END AS error_message FROM s""")
def g10_fail_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fail_stale(V.documents(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz")).select("document_id", "stale", "status", "error_message")


@query(f"""WITH {V.DOCUMENTS}, u AS (SELECT doc_id AS document_id, seq, CASE WHEN seq = 3 AND doc_id % 20 = 0 THEN 'ready' END AS status, CASE WHEN seq >= 2 THEN 'saving' END AS stage, (doc_id + seq)::INTEGER AS chunks_total, seq::INTEGER AS chunks_embedded FROM documents, (SELECT unnest([1, 2, 3]) AS seq) WHERE doc_id % 3 <> 1),
  l AS (SELECT * FROM u WHERE seq = 3)
  SELECT d.document_id, CASE WHEN d.status = 'processing' THEN coalesce(l.status, d.status) ELSE d.status END AS status, CASE WHEN d.status = 'processing' AND l.status = 'ready' THEN NULL WHEN d.status = 'processing' THEN coalesce(l.stage, d.stage) ELSE d.stage END AS stage,
    CASE WHEN d.status = 'processing' THEN coalesce(l.chunks_total, d.chunks_total) ELSE d.chunks_total END AS chunks_total, CASE WHEN d.status = 'processing' THEN coalesce(l.chunks_embedded, d.chunks_embedded) ELSE d.chunks_embedded END AS chunks_embedded
  FROM docs d LEFT JOIN l ON d.document_id = l.document_id""")
def g11_apply_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "documents").where("doc_id % 3 <> 1").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq"))
    u = u.selectExpr("doc_id AS document_id", "seq", "CASE WHEN seq = 3 AND doc_id % 20 = 0 THEN 'ready' END AS status", "CASE WHEN seq >= 2 THEN 'saving' END AS stage", "cast(doc_id + seq as int) AS chunks_total", "seq AS chunks_embedded")
    return G.apply_progress(V.documents(spark, sf_dir), u).select("document_id", "status", "stage", "chunks_total", "chunks_embedded")


@query(f"""WITH {V.DOCUMENTS}, {V.ANSWERS}, a AS (SELECT *, concat('src', user_id::VARCHAR) AS owner FROM answers)
  SELECT 'documents' AS table_name, 'before' AS moment, count(CASE WHEN user_id = 'src1' THEN 1 END) AS source_rows, count(CASE WHEN user_id = 'src2' THEN 1 END) AS target_rows FROM docs
  UNION ALL SELECT 'documents', 'after', 0, count(CASE WHEN user_id IN ('src1', 'src2') THEN 1 END) FROM docs
  UNION ALL SELECT 'answers', 'before', count(CASE WHEN owner = 'src1' THEN 1 END), count(CASE WHEN owner = 'src2' THEN 1 END) FROM a
  UNION ALL SELECT 'answers', 'after', 0, count(CASE WHEN owner IN ('src1', 'src2') THEN 1 END) FROM a""")
def g12_transfer_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.documents(spark, sf_dir)
    users = docs.select("user_id").distinct()
    accounts = users.select("user_id", F.lit(G.VERIFIED_PROVIDER).alias("provider"))
    answers = V.answers(spark, sf_dir).withColumn("user_id", F.concat(F.lit("src"), F.col("user_id").cast("string")))
    return G.transfer_ownership(users, accounts, docs, answers, "src1", "src2")["counts"]


#: Customers sign in, in an order that mixes them: known accounts, known emails with another provider, new people with two
#: accounts, and accounts that come back under the email of another customer, before or after that customer is known.
_EMAIL = "concat(lower(replace(c_name, '#', '.')), '@example.org')"
_OTHER = "concat('customer.', lpad(cast((c_custkey * 7) % 150 + 1 as {text}), 9, '0'), '@example.org')"
_SIGN_INS = f"""c AS (SELECT c_custkey AS k, {_EMAIL} AS email, {_OTHER.format(text='varchar')} AS other, c_name AS name FROM customer),
  users AS (SELECT concat('old-', k::VARCHAR) AS user_id, email, name, NULL::VARCHAR AS image FROM c WHERE k % 3 <> 0),
  accounts AS (SELECT concat('old-', k::VARCHAR) AS user_id, 'google' AS provider, k::VARCHAR AS pid FROM c WHERE k % 3 = 1),
  ids AS (SELECT (k * 37) % 101 AS seq, 'google' AS provider, k::VARCHAR AS pid, email, CASE WHEN k % 2 = 0 THEN name ELSE upper(name) END AS name, 'p.png' AS image FROM c
    UNION ALL SELECT (k * 53) % 97, 'mail', k::VARCHAR, email, name, 'p.png' FROM c WHERE k % 6 = 0 UNION ALL SELECT (k * 29) % 103, 'google', k::VARCHAR, other, name, NULL FROM c WHERE k % 5 < 2),
  numbered AS (SELECT *, row_number() OVER (ORDER BY seq, provider, pid, email, name, image NULLS FIRST) AS n FROM ids),
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, pid ORDER BY n) AS nth FROM numbered) x WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM accounts a WHERE a.provider = x.provider AND a.pid = x.pid))"""
#: Of the first sign-ins of new accounts, in order, each looks at the emails of known users and of those made before it.
_WHO = """new AS (SELECT f.provider, f.pid, f.n, f.email, u.user_id AS old, row_number() OVER (PARTITION BY f.email ORDER BY f.n) AS place FROM firsts f LEFT JOIN users u ON u.email = f.email),
  who AS (SELECT provider, pid, user_id, NULL::BIGINT AS n, 'matched' AS how, NULL::VARCHAR AS email FROM accounts UNION ALL
    SELECT provider, pid, coalesce(old, 'u-' || left(sha256(email), 16)), n, CASE WHEN old IS NOT NULL OR place > 1 THEN 'linked' ELSE 'created' END, email FROM new),
  resolved AS (SELECT i.*, w.user_id, CASE WHEN w.n = i.n THEN w.how ELSE 'matched' END AS how FROM numbered i JOIN who w ON w.provider = i.provider AND w.pid = i.pid)"""


@query(f"WITH {_SIGN_INS}, {_WHO} SELECT seq, provider, pid AS provider_account_id, email, user_id, how FROM resolved")
def g13_resolve_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)["resolved"].select("seq", "provider", "provider_account_id", "email", "user_id", "how")


@query(f"""WITH {_SIGN_INS}, {_WHO}, last AS (SELECT user_id, arg_max(coalesce(name, '-'), n) AS name, arg_max(coalesce(image, '-'), n) AS image FROM resolved GROUP BY 1), made AS (SELECT user_id, email FROM who WHERE how = 'created'),
  every AS (SELECT user_id, email, name, image FROM users UNION ALL SELECT user_id, email, NULL, NULL FROM made)
  SELECT e.user_id, e.email, CASE WHEN l.user_id IS NULL THEN e.name ELSE nullif(l.name, '-') END AS name, CASE WHEN l.user_id IS NULL THEN e.image ELSE nullif(l.image, '-') END AS image,
    l.user_id IS NOT NULL AND (e.name IS DISTINCT FROM nullif(l.name, '-') OR e.image IS DISTINCT FROM nullif(l.image, '-')) AS changed FROM every e LEFT JOIN last l ON l.user_id = e.user_id""")
def g13_users_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' table after the sign-ins of g13_resolve_users."""
    return _resolved(spark, sf_dir)["users"].select("user_id", "email", "name", "image", "changed")


@query(f"WITH {_SIGN_INS}, {_WHO} SELECT provider, pid AS provider_account_id, user_id FROM who")
def g13_accounts_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounts' table after the sign-ins of g13_resolve_users: one row for each account."""
    return _resolved(spark, sf_dir)["accounts"].select("provider", "provider_account_id", "user_id")


def _resolved(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", f"{_EMAIL} AS email", f"{_OTHER.format(text='string')} AS other", "c_name AS name")
    users = c.where("k % 3 <> 0").selectExpr("concat('old-', cast(k as string)) AS user_id", "email", "name", "cast(null as string) AS image")
    accounts = c.where("k % 3 = 1").selectExpr("concat('old-', cast(k as string)) AS user_id", "'google' AS provider", "cast(k as string) AS provider_account_id")
    ids = c.selectExpr("(k * 37) % 101 AS seq", "'google' AS provider", "cast(k as string) AS provider_account_id", "email", "CASE WHEN k % 2 = 0 THEN name ELSE upper(name) END AS name", "'p.png' AS image")
    more = c.where("k % 6 = 0").selectExpr("(k * 53) % 97 AS seq", "'mail' AS provider", "cast(k as string) AS provider_account_id", "email", "name", "'p.png' AS image")
    back = c.where("k % 5 < 2").selectExpr("(k * 29) % 103 AS seq", "'google' AS provider", "cast(k as string) AS provider_account_id", "other AS email", "name", "cast(null as string) AS image")
    return G.resolve_users(ids.unionByName(more).unionByName(back), users, accounts)
