"""Usage limits over request logs.

Windows are aligned to the epoch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed text.
DROPPED = "The connection closed before the answer finished. Try again."


@dataclass(frozen=True)
class Policy:
    seconds: int
    limit: int


#: Fixed values.
ADDRESS = (Policy(60, 300),)
ASK = (Policy(60, 10), Policy(86_400, 150))
UPLOAD = (Policy(3_600, 10), Policy(86_400, 40))
SEARCH = (Policy(60, 30),)


def micros_of(ts: Column) -> Column:
    """Microseconds since the epoch of a time without zone, taken as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def limited(events: DataFrame, policy: Policy, key: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """``events`` with ``nth`` (of its key and window), ``allowed`` and ``retry_after`` seconds."""
    micros = micros_of(F.col(ts))
    width = policy.seconds * 1_000_000
    rows = events.withColumn("_bucket", F.floor(micros / width).cast("long"))
    nth = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(ts, event))
    left = F.ceil(((F.col("_bucket") + 1) * width - micros) / 1_000_000).cast("long")
    return rows.withColumn("nth", nth).withColumn("allowed", F.col("nth") <= policy.limit).withColumn("retry_after", F.greatest(F.lit(1), left)).drop("_bucket")


def chained(events: DataFrame, policies: tuple[Policy, ...], key: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """``events`` with ``blocked_by``: the index of the first limit that refuses it, or null.

    Only what a limit lets through counts against the next one.
    """
    blocked, passed = None, events
    for i, policy in enumerate(policies):
        judged = limited(passed, policy, key, ts, event)
        refused = judged.where("NOT allowed").select(*events.columns, F.lit(i).alias("blocked_by"))
        blocked = refused if blocked is None else blocked.unionByName(refused)
        passed = judged.where("allowed").select(*events.columns)
    return passed.withColumn("blocked_by", F.lit(None).cast("int")).unionByName(blocked)


def folded_answer_events(events: DataFrame) -> DataFrame:
    """Per question the state after its ordered events (question_id, seq, event, data as JSON).

    Events after the first ``done`` or ``error`` do not count.  ``done`` replaces the
    text, ``error`` clears it; without either the connection was dropped.
    """
    ends = events.where("event IN ('done', 'error')").groupBy("question_id").agg(F.min("seq").alias("_end"))
    rows = events.join(ends, "question_id", "left").where("_end IS NULL OR seq <= _end")
    field = lambda name: F.get_json_object("data", f"$.{name}")
    is_ = lambda name: F.col("event") == name
    deltas = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_("delta"), F.struct("seq", field("text").alias("text"))))), lambda d: d["text"]), "")
    state = rows.groupBy("question_id").agg(
        F.max_by("event", F.when(F.col("event").isin("done", "error"), F.col("seq"))).alias("closed_by"),
        F.max_by(field("stage"), F.when(is_("stage"), F.col("seq"))).alias("stage"),
        F.max_by(field("n"), F.when(is_("sources"), F.col("seq"))).cast("int").alias("n_sources"),
        deltas.alias("deltas"),
        F.max(F.when(is_("done"), field("answer"))).alias("answer"),
        F.max(F.when(is_("error"), field("message"))).alias("message"),
    )
    dropped = F.col("closed_by").isNull()
    return state.select(
        "question_id",
        F.when(dropped | (F.col("closed_by") == "error"), "error").otherwise("done").alias("phase"),
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        F.when(F.col("closed_by") == "done", F.col("answer")).otherwise(F.lit("")).alias("text"),
        F.when(dropped, DROPPED).otherwise(F.col("message")).alias("message"),
    )
