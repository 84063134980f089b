"""Queries over request logs, jobs, history writes and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import admission
from quillstone.operators import usage as H
from quillstone.plans import views as V
from quillstone.plans.registry import query
from quillstone.sources import store
from quillstone.sources.tables import scratch, table
from quillstone.streaming import streams

#: The test log is thin, so the limits are low.
HOUR, DAY = H.Policy(3600, 2), H.Policy(86400, 6)

_LIMITED = "SELECT *, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // {w} ORDER BY ts, event_id) AS nth FROM {t}"


@query(f"""WITH n AS ({_LIMITED.format(w=3600000000, t='events')})
  SELECT event_id, user_id, nth::INTEGER AS nth, nth <= 2 AS allowed, greatest(1, ceil(((epoch_us(ts) // 3600000000 + 1) * 3600000000 - epoch_us(ts)) / 1000000.0))::BIGINT AS retry_after FROM n""")
def h1_window_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.limited(table(spark, sf_dir, "events"), HOUR).select("event_id", "user_id", "nth", "allowed", "retry_after")


@query(f"""WITH a AS ({_LIMITED.format(w=3600000000, t='events')}), p AS (SELECT * EXCLUDE (nth) FROM a WHERE nth <= 2), b AS ({_LIMITED.format(w=86400000000, t='p')})
  SELECT event_id, 0 AS blocked_by FROM a WHERE nth > 2 UNION ALL SELECT event_id, CASE WHEN nth > 6 THEN 1 END FROM b""")
def h2_chained_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.chained(table(spark, sf_dir, "events"), (HOUR, DAY)).select("event_id", "blocked_by")


#: Each start in order, with the list of slots that are held: those that have ended are dropped, then the limits are looked at.
@query("""WITH RECURSIVE j AS MATERIALIZED (SELECT event_id AS job_id, user_id, ts AS start_ts, least(CASE WHEN event_id % 5 <> 0 THEN ts + to_minutes(1 + event_id % 60) ELSE ts + INTERVAL 30 MINUTE END, ts + INTERVAL 30 MINUTE) AS stop, row_number() OVER (ORDER BY ts, event_id) AS k FROM events),
  steps AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS job_id, NULL::BIGINT AS user_id, []::STRUCT(u BIGINT, stop TIMESTAMP)[] AS slots, NULL::VARCHAR AS reason
  UNION ALL SELECT k, job_id, user_id, CASE WHEN why IS NULL THEN list_append(live, {'u': user_id, 'stop': stop}) ELSE live END, why FROM
    (SELECT *, CASE WHEN len(list_filter(live, lambda x: x.u = user_id)) >= 3 THEN 'user' WHEN len(live) >= 3 THEN 'server' END AS why FROM
      (SELECT j.*, list_filter(s.slots, lambda x: x.stop > j.start_ts) AS live FROM steps s JOIN j ON j.k = s.k + 1)))
  SELECT job_id, user_id, reason IS NULL AS admitted, reason, CASE reason WHEN 'user' THEN 30 WHEN 'server' THEN 60 END AS retry_after, len(list_filter(slots, lambda x: x.u = user_id))::INTEGER AS open_user, len(slots)::INTEGER AS open_total FROM steps WHERE k > 0""")
def h3_concurrent_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), "user_id", F.col("ts").alias("start_ts"), F.expr("CASE WHEN event_id % 5 <> 0 THEN ts + make_dt_interval(0, 0, cast(1 + event_id % 60 as int), 0) END").alias("end_ts"))
    return admission.admitted(jobs, scratch(spark, "admission"))


_RATES = "SELECT date_trunc('hour', ts) AS window_start, user_id, count(*) AS n, count(*) > 2 AS over_limit FROM events GROUP BY 1, 2"


@query(_RATES)
def h5_request_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the streaming job: the same function over the whole table."""
    out = streams.request_rates(table(spark, sf_dir, "events"), 3600, 2)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(_RATES)
def h5_stream_request_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a stream; windows that are still open are out with their counts so far."""
    raw = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir, "events"))
    out = streams.run_to_table(streams.request_rates(raw, 3600, 2), ["window_start", "user_id"], scratch(spark, "rates-out"), scratch(spark, "rates"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as they arrive, some of them delivered twice."""
    path, e = scratch(spark, "events"), table(spark, sf_dir, "events")
    e.unionByName(e.where("event_id % 10 = 3")).write.parquet(path)
    return spark.readStream.schema(e.schema).parquet(path)


@query("""SELECT date_trunc('hour', ts) AS window_start, user_id, count(*) AS n, count(*) > 2 AS over_limit FROM events GROUP BY 1, 2 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events)""")
def h5_stream_final_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed, each out once; six hours are waited for late rows."""
    rows, _ = streams.run_appended(streams.final_rates(_events_stream(spark, sf_dir), 3600, 2, "6 hours"), scratch(spark, "windows-out"), scratch(spark, "windows"))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "n", "over_limit")


@query("""SELECT window_start, user_id, event_id, ts AS at FROM (SELECT *, date_trunc('hour', ts) AS window_start, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS nth FROM events) WHERE nth = 3""")
def h5_stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert for each user and hour over the limit, with the event that passed it; no window has to close first."""
    rows, _ = streams.run_appended(streams.rate_alerts(_events_stream(spark, sf_dir), 3600, 2, "6 hours"), scratch(spark, "alerts-out"), scratch(spark, "alerts"))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", "event_id", F.col("at").cast("timestamp_ntz").alias("at"))


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder that a streaming source can watch, holding the table's rows."""
    path = scratch(spark, name)
    table(spark, sf_dir, name).write.parquet(path)
    return path


_FOLDED = """SELECT concat(conv_id::VARCHAR, '-', turn::VARCHAR) AS question_id, CASE WHEN (conv_id * 31 + turn) % 7 < 2 THEN 'error' ELSE 'done' END AS phase, ((conv_id * 31 + turn) % 5)::INTEGER AS n_sources,
  CASE WHEN (conv_id * 31 + turn) % 7 < 2 THEN '' ELSE text END AS text, CASE (conv_id * 31 + turn) % 7 WHEN 0 THEN 'The connection closed before the answer finished. Try again.' WHEN 1 THEN 'Try again' END AS message FROM conversations"""


@query(_FOLDED)
def h6_stream_answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold as a stream with states for slices of the questions; timers end what has been silent, and the rest is dropped as the log has ended."""
    path = scratch(spark, "answer-events")
    _answer_events(spark, sf_dir).write.parquet(path)
    raw = spark.readStream.schema("question_id string, seq int, event string, data string, at timestamp").parquet(path)
    return streams.settled(streams.run_to_table(streams.stream_answer_events(raw, slices=streams.QUESTION_SLICES), ["question_id"], scratch(spark, "answers-out"), scratch(spark, "answer-state"), streams.ended()))


#: Answer events made from the conversations: a stage, sources, the words of the turn as deltas, and an end that every seventh lacks.
def _answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.expr("concat(cast(conv_id as string), '-', cast(turn as string))").alias("question_id"), F.expr("conv_id * 31 + turn").alias("k"), F.split("text", " ").alias("w"))
    kinds = F.concat(F.array(F.lit("stage"), F.lit("sources")), F.transform("w", lambda x: F.lit("delta")), F.when(F.col("k") % 7 == 0, F.expr("cast(array() as array<string>)")).when(F.col("k") % 7 == 1, F.array(F.lit("error"))).otherwise(F.array(F.lit("done"))))
    rows = c.select("question_id", "k", "w", F.posexplode(kinds).alias("seq", "event"))
    pair = lambda name, value: F.to_json(F.struct(value.alias(name)))
    data = (
        F.when(F.col("event") == "stage", pair("stage", F.lit("searching")))
        .when(F.col("event") == "sources", pair("n", (F.col("k") % 5)))
        .when(F.col("event") == "delta", pair("text", F.concat(F.expr("try_element_at(w, seq - 1)"), F.lit(" "))))
        .when(F.col("event") == "done", pair("answer", F.concat_ws(" ", "w")))
        .otherwise(pair("message", F.lit("Try again")))
    )
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("k") * 2 + F.col("seq") / 1000)
    return rows.select("question_id", "seq", "event", data.alias("data"), at.alias("at"))


@query(_FOLDED)
def h6_fold_answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.folded_answer_events(_answer_events(spark, sf_dir))


@query(f"WITH {V.ANSWERS} SELECT answer_id, user_id, strftime(created_at, '%Y-%m-%d') AS day FROM answers")
def a4_append_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended in two writes, read back."""
    path = scratch(spark, "history")
    a = V.answers(spark, sf_dir).select("answer_id", "user_id", "created_at")
    store.append_answers(a.where("answer_id % 2 = 0"), path)
    store.append_answers(a.where("answer_id % 2 = 1"), path)
    return spark.read.parquet(path).select("answer_id", "user_id", F.col("day").cast("string").alias("day"))
