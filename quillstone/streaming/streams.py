"""Structured Streaming forms of ingestion, request limits and the answer-event fold."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstone.operators import chunking, embedding, ingest, usage
from quillstone.sources import files, store

RAW = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder as a stream, as they arrive."""
    return spark.readStream.format("binaryFile").schema(RAW).load(folder)


def file_name(path: str = "path") -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def stream_ingest(
    arriving: DataFrame, store_path: str, catalog_path: str, checkpoint: str, options: chunking.ChunkOptions = chunking.ChunkOptions(), embed: embedding.EmbedBatch | None = None, dim: int = embedding.DIMENSIONS, ledger: str | None = None, model: str = "default", limit: int = chunking.MAX_CHUNKS
) -> StreamingQuery:
    """Ingest files (path, length, content) as they arrive; the path names the document.

    A batch's passages are published at once, and those that its failed documents had
    before go in the same step; its catalog rows (document_id, status, error_message,
    cause, chunks_total, chunks_embedded) follow, in a folder of their own.  A repeated
    batch publishes nothing twice and writes its catalog rows again.  A batch without a
    readable text is no special case.  The text of an accepted PDF comes from elsewhere,
    so it is still processing.
    """
    spark = arriving.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        work = f"{store_path.rstrip('/')}_batches/{uuid.uuid4().hex}"
        judged = files.judged(df)
        accepted = judged.where("kind = 'text'").select(F.col("path").alias("document_id"), file_name().alias("filename"), F.col("content").cast("string").alias("text"))
        got = ingest.ingested(ingest.text_documents(accepted), work, options, embed, dim, ledger, model, limit)
        refused = judged.where("reject_reason IS NOT NULL").select(F.col("path").alias("document_id"), F.lit("failed").alias("status"), F.col("reject_reason").alias("error_message"))
        waiting = judged.where("kind = 'pdf'").select(F.col("path").alias("document_id"), F.lit("processing").alias("status"), F.lit(None).cast("string").alias("error_message"))
        rows = got.outcomes.unionByName(refused.unionByName(waiting), allowMissingColumns=True)
        failed = rows.where("status = 'failed'").select("document_id")
        store.write_replaced(spark, store_path, got.passages, removed=failed, writer=(checkpoint, number), written=True)
        rows.write.mode("overwrite").parquet(f"{catalog_path.rstrip('/')}/batch={number}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(work)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_rates(events: DataFrame, seconds: int, limit: int, late: str = "1 hour") -> DataFrame:
    """Requests per key and tumbling window as they arrive, with ``over_limit``; works on streams and tables.

    The event time must be a TIMESTAMP for the watermark, so it is cast.
    """
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    counted = rows.groupBy(F.window("at", f"{seconds} seconds"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "user_id", "n", (F.col("n") > limit).alias("over_limit"))


def once(events: DataFrame, late: str, event: str = "event_id") -> DataFrame:
    """``events`` (ts) with the event time ``at`` and its watermark, each event once though it may be delivered again."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([event])


def final_rates(events: DataFrame, seconds: int, limit: int, late: str = "1 hour", event: str = "event_id") -> DataFrame:
    """A stream of closed windows: window_start, window_end, user_id, n, over_limit, each once and never changed after it.

    A window is closed when the watermark, ``late`` behind the latest event, passes its
    end.  Rows that come later than the watermark do not count in any window; how many
    there were is told by ``late_rows``.
    """
    counted = once(events, late, event).groupBy(F.window("at", f"{seconds} seconds"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "user_id", "n", (F.col("n") > limit).alias("over_limit"))


#: Users are dealt to so many states; each holds the counts of all its users' open windows.
SLICES = 64


def rate_alerts(events: DataFrame, seconds: int, limit: int, late: str = "1 hour", event: str = "event_id", slices: int = SLICES) -> DataFrame:
    """A stream of alerts (window_start, user_id, event_id, at): one for a key and window over the limit, told as soon as it is.

    A state counts the events of many users and windows, each until its limit is passed,
    and drops those of a window when the watermark closes it: a batch makes one call for
    each of ``slices``, however many users and windows it holds.  The number of slices
    must stay the same for a job that goes on.
    """
    rows = once(events, late, event)
    user, id_ = rows.schema["user_id"].dataType, rows.schema[event].dataType
    window, none = F.window("at", f"{seconds} seconds"), F.lit("0").cast(id_)
    rows = rows.select(
        F.pmod(F.xxhash64("user_id"), F.lit(slices)).alias("slice"), "at", F.unix_micros("at").alias("us"), F.unix_micros(window.start).alias("start_us"),
        # no nulls, which pandas would hold as floats
        F.coalesce(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("-")).alias("who"), F.coalesce(F.col(event), none).alias("event_id"), F.col(event).isNull().alias("unnamed"),
    )
    width, pair = seconds * 1_000_000, ["start_us", "who"]

    def alert(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        closed = state.getCurrentWatermarkMs() * 1000 - width
        counts = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else pd.DataFrame({"start_us": pd.Series(dtype="int64"), "who": pd.Series(dtype="object"), "n": pd.Series(dtype="int64")})
        if not state.hasTimedOut:
            seen = pd.concat([f[[*pair, "us", "unnamed", "event_id"]] for f in frames]).sort_values(["us", "unnamed", "event_id"])
            seen = seen.merge(counts, "left", pair)
            before = seen["n"].fillna(0).astype("int64")
            first = seen[seen.groupby(pair).cumcount() + before == limit]
            if len(first):
                yield first[[*pair, "event_id", "unnamed", "us"]]
            counts = pd.concat([counts, seen.groupby(pair).size().rename("n").reset_index()]).groupby(pair, as_index=False)["n"].sum()
            counts["n"] = counts["n"].clip(upper=limit + 1)
        counts = counts[counts["start_us"] > closed]
        if not len(counts):
            if state.exists:
                state.remove()
            return
        held = pa.BufferOutputStream()
        with pa.ipc.new_stream(held, (batch := pa.RecordBatch.from_pandas(counts, preserve_index=False)).schema) as out:
            out.write_batch(batch)
        state.update((held.getvalue().to_pybytes(),))
        state.setTimeoutTimestamp(max(int(counts["start_us"].min() + width) // 1000, state.getCurrentWatermarkMs() + 1))

    told = rows.groupBy("slice").applyInPandasWithState(alert, f"start_us long, who string, event_id {id_.simpleString()}, unnamed boolean, us long", "counts binary", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select(
        F.timestamp_micros("start_us").alias("window_start"), F.when(F.col("who") != "-", F.expr("substr(who, 2)")).cast(user).alias("user_id"), F.when(~F.col("unnamed"), F.col("event_id")).alias("event_id"), F.timestamp_micros("us").alias("at")
    )


def late_rows(run: StreamingQuery) -> int:
    """The rows that a finished or running query has left out because they came after the watermark (at its first stateful step)."""
    return sum(p["stateOperators"][-1]["numRowsDroppedByWatermark"] for p in run.recentProgress if p["stateOperators"])


def run_appended(df: DataFrame, folder: str, checkpoint: str) -> tuple[DataFrame, StreamingQuery]:
    """Run a streaming job in append mode over what is there now: (all its rows so far, from Parquet files in ``folder``; the run)."""
    run = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
    run.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(folder), run


OUT = "question_id string, phase string, n_sources int, text string, message string"
STATE = "seqs array<int>, kinds array<string>, bodies array<string>, latest long"


def _question_rules():
    """The rules of a question's events, held as {seq: (kind, body)}: (what still counts, its row, its row once it is silent)."""
    ends = ("done", "error")

    def counting(held: dict) -> dict:
        end = min((s for s, (k, _) in held.items() if k in ends), default=None)
        return held if end is None else {s: e for s, e in held.items() if s == end or (s < end and e[0] == "sources")}

    def told(held: dict) -> tuple:
        import json

        bodies: dict[str, list[dict]] = {}
        for s in sorted(held):
            bodies.setdefault(held[s][0], []).append(json.loads(held[s][1]))
        last = lambda kind, field, default=None: bodies[kind][-1].get(field, default) if kind in bodies else default
        if "done" in bodies:
            phase, text_ = "done", last("done", "answer")
        elif "error" in bodies:
            phase, text_ = "error", ""
        else:
            phase, text_ = last("stage", "stage", "searching"), "".join(b["text"] for b in bodies.get("delta", []))
        return phase, last("sources", "n", 0), text_, last("error", "message")

    def silent(held: dict) -> tuple | None:
        import json

        if any(k in ends for k, _ in held.values()):
            return None
        # nothing for too long: the connection is gone
        return "error", json.loads(next((held[s][1] for s in sorted(held, reverse=True) if held[s][0] == "sources"), "{}")).get("n", 0), "", usage.DROPPED

    return counting, told, silent


def event_fold(patience: int):
    """The answer-event fold with a state for each question: one row per question and batch; ``patience`` in seconds."""
    counting, told, silent = _question_rules()
    names = [c.split()[0] for c in OUT.split(", ")]

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, latest = {}, 0
        if state.exists:
            *columns, latest = state.get
            held = {s: (k, b) for s, k, b in zip(*columns, strict=True)}
        if state.hasTimedOut:
            state.remove()
            if row := silent(held):
                yield pd.DataFrame([(key[0], *row)], columns=names)
            return
        for frame in frames:
            for seq, kind, body, ms in zip(frame["seq"].tolist(), frame["event"], frame["data"], frame["ms"].tolist(), strict=True):
                held.setdefault(seq, (kind, body))
                latest = max(latest, ms)
        held = counting(held)
        order = sorted(held)
        state.update((order, [held[s][0] for s in order], [held[s][1] for s in order], latest))
        state.setTimeoutTimestamp(max(latest + patience * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *told(held))], columns=names)

    return fold


def sliced_event_fold(patience: int):
    """The same fold with a state for many questions: each keeps its own events and its own deadline."""
    counting, told, silent = _question_rules()
    names = [c.split()[0] for c in OUT.split(", ")]

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        schema = pa.schema([("question_id", pa.string()), ("seq", pa.int32()), ("kind", pa.string()), ("body", pa.string()), ("latest", pa.int64()), ("deadline", pa.int64())])
        now, held, clocks = state.getCurrentWatermarkMs(), {}, {}
        if state.exists:
            for question, seq, kind, body, *clock in zip(*(c.to_pylist() for c in pa.ipc.open_stream(state.get[0]).read_all().columns), strict=True):
                held.setdefault(question, {})[seq] = (kind, body)
                clocks[question] = clock
        heard: dict = {}
        for frame in () if state.hasTimedOut else frames:
            for question, seq, kind, body, ms in zip(*(frame[c].tolist() for c in ("question_id", "seq", "event", "data", "ms")), strict=True):
                if (events := held.get(question)) is None:
                    events = held[question] = {}
                if seq not in events:
                    events[seq] = (kind, body)
                if ms > heard.get(question, -1):
                    heard[question] = ms
                else:
                    heard.setdefault(question, 0)
        rows = []
        for question, ms in heard.items():
            latest = max(ms, clocks.get(question, (0,))[0])
            clocks[question] = [latest, max(latest + patience * 1000, now + 1)]
            held[question] = counting(held[question])
            rows.append((question, *told(held[question])))
        for question in [q for q, (_, deadline) in clocks.items() if deadline < now]:
            del clocks[question]
            if row := silent(held.pop(question)):
                rows.append((question, *row))
        if held:
            columns = zip(*((q, s, *events[s], *clocks[q]) for q, events in held.items() for s in sorted(events)), strict=True)
            table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            packed = pa.BufferOutputStream()
            with pa.ipc.new_stream(packed, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(table)
            state.update((packed.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(min(deadline for _, deadline in clocks.values()), now, 1))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return fold


#: Slices for streams of very many questions: a batch of 100 million events leaves some 100,000 to a call.
QUESTION_SLICES = 1024


def stream_answer_events(events: DataFrame, patience: int = 600, late: str = "1 minute", slices: int | None = None) -> DataFrame:
    """Questions' states as their events arrive (question_id string, seq int, event, data, at timestamp).

    Events count by their ``seq``, in whatever order and batches they arrive; of equal
    numbers the first to arrive.  The state holds a question's events up to its first
    end; with that end known, only the end and the sources.  A question that has been
    silent for ``patience`` seconds of event time, as the watermark tells, leaves the
    state: one without an end as a dropped connection.  Until then an end that has been
    told stays, so what comes after it changes nothing; events that come later than
    the watermark are not looked at.

    Without ``slices`` each question has a state of its own, which can be looked up by its
    key, and costs a call for its events and one for its timer.  With it questions are
    dealt to so many states and a batch makes a call for each of those; the rows are the
    same.  The number must stay the same for a job that goes on.
    """
    rows = events.withWatermark("at", late).select("question_id", "seq", "event", "data", "at", F.unix_millis("at").alias("ms"))
    if slices is None:
        return rows.groupBy("question_id").applyInPandasWithState(event_fold(patience), OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("question_id"), F.lit(slices)))
    return dealt.groupBy("slice").applyInPandasWithState(sliced_event_fold(patience), OUT, "questions binary", "update", GroupStateTimeout.EventTimeTimeout)


def ended() -> Column:
    """Whether a state is a question's last one."""
    return F.col("phase").isin("done", "error")


def settled(states: DataFrame) -> DataFrame:
    """The states once no more events will come: a question without an end has lost its connection."""
    open_ = ~ended()
    return states.select(
        "question_id",
        F.when(open_, "error").otherwise(F.col("phase")).alias("phase"),
        "n_sources",
        F.when(open_, "").otherwise(F.col("text")).alias("text"),
        F.when(open_, usage.DROPPED).otherwise(F.col("message")).alias("message"),
    )


def run_to_table(df: DataFrame, keys: list[str], folder: str, checkpoint: str, final: Column | None = None) -> DataFrame:
    """Run a streaming job in update mode over what is there now; of each key its last row, from Parquet files in ``folder``.

    Where a row is ``final``, the first such row of the key stays, whatever comes after
    it.  A repeated batch replaces its own files; a job that has run before goes on.
    """
    spark = df.sparkSession
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{folder}/batch=-1")

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", folder).parquet(folder)
    place = F.col("batch") if final is None else F.when(final, F.lit(1 << 40) - F.col("batch")).otherwise(F.col("batch"))
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), place).alias("last"))
    return last.select("*", "last.*").select(*df.columns)
