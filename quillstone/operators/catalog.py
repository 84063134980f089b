"""Catalog and history: listings, deletions, status, ownership, identities.

Changes are computed as the next state of a table; a store writes that state and
switches to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.columns import round_half_up, token_estimate

#: Fixed texts and values.
GENERIC_FAILURE = "Processing failed due to a server error"
INTERRUPTED = "Interrupted by server restart. Please upload again."
STALE_MINUTES = 10
HISTORY, MAX_HISTORY = 20, 50
STRIP_CELLS, EMBED_BATCH = 96, 90
VERIFIED_PROVIDER = "google"


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))


def list_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every user's documents with their number of passages, newest first for each user."""
    rows = documents.join(chunk_counts(chunks), "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "document_id"))
    return rows.withColumn("place", place)


def document_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Passages of owned documents by index, with characters and token estimate."""
    owned = documents.select("document_id", "user_id")
    rows = chunks.drop("user_id").join(owned, "document_id")
    return rows.select("user_id", "document_id", "chunk_index", F.length("content").alias("char_count"), token_estimate("content").alias("token_estimate"))


def delete_documents(requests: DataFrame, documents: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """Remove the (user_id, document_id) pairs that the user owns, with their passages; history stays."""
    gone = documents.join(requests.select("user_id", "document_id").distinct(), ["user_id", "document_id"], "left_semi").select("document_id")
    return {"documents": documents.join(gone, "document_id", "left_anti"), "chunks": chunks.join(gone, "document_id", "left_anti"), "deleted": gone.agg(F.count(F.lit(1)).alias("deleted"))}


def delete_users(user_ids: DataFrame, users: DataFrame, documents: DataFrame, chunks: DataFrame, answers: DataFrame, accounts: DataFrame) -> dict[str, DataFrame]:
    """Remove users and all that hangs on them: documents, passages, answers, accounts."""
    ids = user_ids.select("user_id").distinct()
    gone = documents.join(ids, "user_id", "left_semi").select("document_id")
    out = {name: df.join(ids, "user_id", "left_anti") for name, df in (("users", users), ("documents", documents), ("answers", answers), ("accounts", accounts))}
    return out | {"chunks": chunks.join(gone, "document_id", "left_anti")}


def history(answers: DataFrame, n: int = HISTORY) -> DataFrame:
    """Each user's last ``n`` answers, newest first."""
    if not 1 <= n <= MAX_HISTORY:
        raise ValueError(f"n must be between 1 and {MAX_HISTORY}")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "answer_id"))
    return answers.withColumn("place", place).where(F.col("place") <= n)


def library_totals(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per user: ready documents and their passages."""
    ready = documents.where("status = 'ready'").join(chunk_counts(chunks), "document_id", "left")
    return ready.groupBy("user_id").agg(F.count(F.lit(1)).alias("ready_documents"), F.sum(F.coalesce("chunk_count", F.lit(0))).alias("passages"))


def mean_chunk_tokens(chunks: DataFrame) -> DataFrame:
    """Per document the mean token estimate, rounded half up."""
    return chunks.groupBy("document_id").agg(round_half_up(F.avg(token_estimate("content"))).cast("long").alias("mean_tokens"))


def strip_bins(documents: DataFrame, hits: DataFrame, cells: int = STRIP_CELLS) -> DataFrame:
    """Consecutive bins of each document's passages, at most ``cells``.

    ``documents``: document_id, total, embedded (null once ready).  ``hits``: cited
    (document_id, chunk_index).  Per bin: first, end (exclusive), state, hit.
    """
    n = F.greatest(F.lit(1), F.least("total", F.lit(cells)))
    rows = documents.withColumn("_cells", n).withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)))
    per = F.col("total") / F.col("_cells")
    rows = rows.withColumn("first", F.floor(F.col("bin") * per).cast("long"))
    rows = rows.withColumn("end", F.greatest(F.col("first") + 1, F.floor((F.col("bin") + 1) * per).cast("long")))
    until = F.least(F.col("embedded") + EMBED_BATCH, F.col("total"))
    state = F.when(F.col("embedded").isNull() | (F.col("end") <= F.col("embedded")), "done").when(F.col("first") < until, "working").otherwise("waiting")
    # a cited passage finds its bin by its own index, so no range join is needed
    of_hit = hits.join(documents.select("document_id", "total").withColumn("_cells", n), "document_id").where("chunk_index < total")
    guess = F.floor(F.try_divide(F.col("chunk_index") * F.col("_cells"), F.col("total"))).cast("int")
    near = of_hit.withColumn("bin", F.explode(F.array(guess - 1, guess, guess + 1))).select("document_id", "bin", "chunk_index")
    bins = rows.withColumn("state", state).select("document_id", "bin", "first", "end", "state")
    marked = bins.join(near, ["document_id", "bin"]).where("chunk_index >= first AND chunk_index < end").select("document_id", "bin", F.lit(True).alias("hit")).distinct()
    return bins.join(marked, ["document_id", "bin"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def status_changes(snapshots: DataFrame) -> DataFrame:
    """Documents that went from processing to ready or failed between consecutive snapshots."""
    before = F.lag("status").over(Window.partitionBy("document_id").orderBy("snapshot_ts"))
    rows = snapshots.withColumn("was", before)
    return rows.where((F.col("was") == "processing") & F.col("status").isin("ready", "failed"))


def mark_failed(documents: DataFrame, chunks: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) after the failures (document_id, message, user_facing): their passages go.

    Of several failures of a document one is told: one for users' eyes if there is one.
    """
    told = F.when(F.col("user_facing"), F.col("message")).otherwise(GENERIC_FAILURE)
    known = errors.groupBy("document_id").agg(F.max(F.struct("user_facing", told.alias("message"))).alias("_told")).select("document_id", F.col("_told.message").alias("_message"))
    rows = documents.join(known, "document_id", "left")
    failed = F.col("_message").isNotNull()
    after = rows.withColumn("status", F.when(failed, "failed").otherwise(F.col("status"))).withColumn("error_message", F.coalesce("_message", "error_message")).drop("_message")
    return after, chunks.join(known.select("document_id"), "document_id", "left_anti")


def fail_stale(documents: DataFrame, as_of: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Documents still processing that were created more than ``minutes`` before ``as_of`` have failed."""
    stale = (F.col("status") == "processing") & (F.col("created_at") < as_of - F.make_dt_interval(mins=F.lit(minutes)))
    return documents.withColumn("stale", F.coalesce(stale, F.lit(False))).withColumn("error_message", F.when(F.col("stale"), INTERRUPTED).otherwise(F.col("error_message"))).withColumn("status", F.when(F.col("stale"), "failed").otherwise(F.col("status")))


def apply_progress(documents: DataFrame, updates: DataFrame) -> DataFrame:
    """The latest update (by ``seq``) of each document, only where it is still processing; ready clears stage and error."""
    fields = ["status", "stage", "chunks_total", "chunks_embedded"]
    latest = updates.groupBy("document_id").agg(F.max_by(F.struct(*fields), "seq").alias("u"))
    rows = documents.join(latest, "document_id", "left")
    live = (F.col("status") == "processing") & F.col("u").isNotNull()
    ready = live & (F.col("u.status") == "ready")
    out = {f: F.when(live, F.coalesce(F.col(f"u.{f}"), F.col(f))).otherwise(F.col(f)) for f in fields}
    out["stage"] = F.when(ready, None).otherwise(out["stage"])
    out["error_message"] = F.when(ready, None).otherwise(F.col("error_message"))
    return rows.withColumns(out).drop("u")


def transfer_ownership(users: DataFrame, accounts: DataFrame, documents: DataFrame, answers: DataFrame, source: str, target: str) -> dict[str, DataFrame]:
    """Move documents and answers from one user to another; the emptied source user is removed.

    Nothing moves unless the target has an account with the verified provider.
    ``counts`` has per table the rows of both users before and after.
    """
    verified = accounts.where((F.col("user_id") == target) & (F.col("provider") == VERIFIED_PROVIDER)).select(F.lit(source).alias("user_id")).distinct()
    allowed = users.join(verified, "user_id", "left_semi").select("user_id", F.lit(True).alias("_move"))

    def moved(df: DataFrame) -> DataFrame:
        rows = df.join(F.broadcast(allowed), "user_id", "left")  # one row at most
        return rows.withColumn("user_id", F.when(F.col("_move"), F.lit(target)).otherwise(F.col("user_id"))).drop("_move")

    def counted(df: DataFrame, table: str, when: str) -> DataFrame:
        one = lambda user: F.count(F.when(F.col("user_id") == user, 1))
        return df.agg(F.lit(table).alias("table_name"), F.lit(when).alias("moment"), one(source).alias("source_rows"), one(target).alias("target_rows"))

    docs, hist = moved(documents), moved(answers)
    counts = counted(documents, "documents", "before").unionByName(counted(docs, "documents", "after")).unionByName(counted(answers, "answers", "before")).unionByName(counted(hist, "answers", "after"))
    return {"users": users.join(allowed, "user_id", "left_anti"), "documents": docs, "answers": hist, "counts": counts}


def resolve_users(identities: DataFrame, users: DataFrame, accounts: DataFrame) -> dict[str, DataFrame]:
    """Users and accounts after sign-ins in the order of ``seq``: known account, else known email (linked), else a new user.

    ``identities``: seq, provider, provider_account_id, email, name, image.  An account
    keeps the user of its first sign-in, whatever emails it comes with later, and a
    user's email never changes; so of each new account only the first sign-in looks at
    an email, and of each new email only the first such sign-in makes a user.  That
    needs no fold: two smallest rows, each aggregated before it is shuffled.  New users
    get an id made from their email, so sign-ins that arrive together give one user.
    Every sign-in sets its user's name and photo; the last one stays.

    ``resolved``: per sign-in user_id and how (matched, linked, created); ``users`` with
    ``changed``; ``accounts``: one row per (provider, provider_account_id).

    Defined cases: sign-ins of one ``seq`` come by provider, account, email, name and
    photo, and equal ones count as one; a null email is known to nobody, and makes a
    user of its account's; several users of one email (there should be none) count as
    the one of the smallest id; several rows of one account likewise.
    """
    account, order = ["provider", "provider_account_id"], ["seq", "provider", "provider_account_id", "email", "name", "image"]
    own = F.concat_ws("\x1f", F.lit(""), *account)  # stands for an email where there is none
    by_account = accounts.groupBy(*account).agg(F.min("user_id").alias("_a"))
    by_email = users.where("email IS NOT NULL").groupBy("email").agg(F.min("user_id").alias("_e"))
    rows = identities.select(*order).withColumn("_at", F.struct(*order))

    first = rows.groupBy(*account).agg(F.min("_at").alias("_first")).join(by_account, account, "left")
    new = first.where("_a IS NULL").withColumn("email", F.col("_first.email")).withColumn("_mail", F.coalesce("email", own)).join(by_email, "email", "left")
    makers = new.groupBy("_mail").agg(F.min("_first").alias("_maker"))
    new = new.join(makers, "_mail").withColumn("user_id", F.coalesce("_e", F.concat(F.lit("u-"), F.left(F.sha2("_mail", 256), F.lit(16)))))
    how = F.when(F.col("_e").isNotNull() | (F.col("_first") != F.col("_maker")), "linked").otherwise("created")
    told = first.where("_a IS NOT NULL").select(*account, "_first", F.col("_a").alias("user_id"), F.lit("matched").alias("_how")).unionByName(new.select(*account, "_first", "user_id", how.alias("_how")))

    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in account]
    joined = rows.alias("r").join(told.alias("t"), same[0] & same[1])
    resolved = joined.select(*[F.col(f"r.{c}").alias(c) for c in order], "user_id", F.when(F.col("r._at") == F.col("t._first"), F.col("_how")).otherwise("matched").alias("how"))

    made = new.where(how == "created").groupBy("user_id").agg(F.min("email").alias("_email"))
    seen = resolved.groupBy("user_id").agg(F.max(F.struct(*order)).alias("_last")).join(made, "user_id", "left")
    profile = seen.select("user_id", "_email", F.col("_last.name").alias("_name"), F.col("_last.image").alias("_image"), F.lit(True).alias("_seen"))
    merged = users.join(profile, "user_id", "full")
    is_seen = F.coalesce("_seen", F.lit(False))
    changed = is_seen & (~F.col("name").eqNullSafe(F.col("_name")) | ~F.col("image").eqNullSafe(F.col("_image")))
    after = merged.select("user_id", F.coalesce("email", "_email").alias("email"), F.when(is_seen, F.col("_name")).otherwise(F.col("name")).alias("name"), F.when(is_seen, F.col("_image")).otherwise(F.col("image")).alias("image"), changed.alias("changed"))
    linked = accounts.groupBy(*account).agg(F.min("user_id").alias("user_id")).unionByName(new.select(*account, "user_id"))
    return {"resolved": resolved, "users": after, "accounts": linked.select("user_id", *account)}
