"""Slots for jobs that run at once: each start is decided in order, and a refused one takes no slot.

What is decided depends on all that was decided before, so the log is folded in order.
It is cut into stretches of time that are folded side by side, each from the slots that
are held at its beginning.  These are not known at first: every stretch begins without
any, and those whose beginning turns out otherwise are folded again, in runs of ever more
stretches one after the other.  Where two histories soon hold the same slots, two or three
rounds do.  In a dense log they may never, and then nothing but one fold over all the log
can tell: the runs reach it after a number of rounds that is a logarithm of the stretches,
and it is made over packed arrays, in which all starts between a full server and its next
free slot are passed over at once.  The rounds look for the slots alone; the starts are
decided after them, all stretches side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of a user and of the server, and minutes after which a slot is free again.
PER_USER, PER_SERVER = 3, 3
BACKSTOP_MINUTES = 30
#: Seconds to wait after a refusal.
RETRY_AFTER = {"user": 30, "server": 60}
#: Minutes of a stretch; a slot must not outlast the stretch after its own.
STRETCH_MINUTES = 360
#: Each round's runs are so many times as long as those of the round before.
LONGER = 4
#: Starts in a packed array.
PACKED = 4096

SLOTS = "array<struct<until: long, owner: string>>"
STATE = f"stretch long, began {SLOTS}, ended {SLOTS}"
DECIDED = "job_id long, owner string, reason string, open_user int, open_total int"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts in order (stretch, at, until, owner, job_id) as (stretch, part, starts): Arrow batches of one stretch each, numbered."""
    now, part = None, 0
    for batch in batches:
        stretch = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), len(stretch)]
        out = []
        for first, end in zip(cuts, cuts[1:]):
            for at in range(first, end, PACKED):
                if stretch[at] != now:
                    now, part = stretch[at], 0
                piece = batch.slice(at, min(PACKED, end - at)).select(["at", "until", "owner", "job_id"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema) as f:
                    f.write_batch(piece)
                out.append((int(now), part, sink.getvalue().to_pybytes()))
                part += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["stretch", "part", "starts"])


def _folder(per_user: int, per_server: int):
    """A maker of folds: (the slots, a function over packed starts); made inside the workers."""

    def make(slots: list[dict]):
        import heapq

        held = [(x["until"], x["owner"]) for x in slots]
        heapq.heapify(held)
        of: dict[str, int] = {}
        for _, name in held:
            of[name] = of.get(name, 0) + 1

        def free(at: int, code: dict, mine: np.ndarray) -> None:
            while held and held[0][0] <= at:
                name = heapq.heappop(held)[1]
                of[name] -= 1
                if name in code:
                    mine[code[name]] -= 1
                if not of[name]:
                    del of[name]

        def left(at: int) -> list[dict]:
            """The slots that are still held."""
            free(at, {}, np.zeros(0))
            return [{"until": u, "owner": o} for u, o in sorted(held)]

        def fold(starts: bytes, told: bool) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray] | None:
            """Go through the starts; if they are to be told, their job_id, owner, reason (0: none, 1: user, 2: server) and counts."""
            batch = pa.ipc.open_stream(starts).read_next_batch()
            at, until = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            owners = batch.column(2).dictionary_encode()
            names, codes = owners.dictionary.to_pylist(), owners.indices.to_numpy()
            code = {name: i for i, name in enumerate(names)}
            mine = np.array([of.get(name, 0) for name in names], np.int32)
            n, i = len(at), 0
            reason, user, total = np.zeros(n, np.int8), np.zeros(n, np.int32), np.zeros(n, np.int32)
            while i < n:
                free(at[i], code, mine)
                if len(held) >= per_server:  # nothing changes before the next slot is free
                    j = i + int(np.searchsorted(at[i:], held[0][0]))
                    if told:
                        user[i:j] = mine[codes[i:j]]
                        reason[i:j], total[i:j] = np.where(user[i:j] >= per_user, 1, 2), len(held)
                    i = j
                    continue
                c = codes[i]
                if mine[c] >= per_user:
                    reason[i] = 1
                else:
                    heapq.heappush(held, (int(until[i]), names[c]))
                    of[names[c]] = of.get(names[c], 0) + 1
                    mine[c] += 1
                user[i], total[i] = mine[c], len(held)
                i += 1
            return (batch.column(3), batch.column(2), reason, user, total) if told else None

        return fold, left

    return make


def _states(per_user: int, per_server: int, width: int):
    """Of packed starts in order (run, stretch, part, starts, entry): stretch, the slots at its beginning, and at its end."""
    maker = _folder(per_user, per_server)
    kind = pa.list_(pa.struct([("until", pa.int64()), ("owner", pa.string())]))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = now = fold = left = began = None
        done: list[tuple] = []
        for batch in batches:
            for i, (r, stretch) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if stretch != now:
                    if now is not None:
                        done.append((now, began, left((now + 1) * width)))
                    if r != run:
                        run, (fold, left) = r, maker(batch.column(4)[i].as_py() or [])
                    now, began = stretch, left(stretch * width)
                fold(batch.column(3)[i].as_buffer(), False)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), kind, kind), strict=True)], names=["stretch", "began", "ended"])
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, began, left((now + 1) * width)), (pa.int64(), kind, kind), strict=True)], names=["stretch", "began", "ended"])

    return states


def _decisions(per_user: int, per_server: int):
    """Of packed starts in order (stretch, part, starts, began): each start with what is decided."""
    maker = _folder(per_user, per_server)

    def decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = fold = None
        reasons = pa.array([None, "user", "server"])
        for batch in batches:
            for i, stretch in enumerate(batch.column(0).to_pylist()):
                if stretch != now:
                    now, (fold, _) = stretch, maker(batch.column(3)[i].as_py() or [])
                job, owner, reason, user, total = fold(batch.column(2)[i].as_buffer(), True)
                yield pa.RecordBatch.from_arrays([job, owner, reasons.take(pa.array(reason)), pa.array(user), pa.array(total)], names=["job_id", "owner", "reason", "open_user", "open_total"])

    return decisions


def admitted(jobs: DataFrame, work: str, per_user: int = PER_USER, per_server: int = PER_SERVER, backstop: int = BACKSTOP_MINUTES, stretch: int = STRETCH_MINUTES) -> DataFrame:
    """Per job: job_id, user_id, admitted, reason (user, server or null), retry_after, open_user, open_total.

    ``jobs``: job_id, user_id, start_ts, end_ts (null: never closed).  The counts are of
    slots that are held after the decision.  A slot is free again at its job's end, after
    ``backstop`` minutes at the latest, and before a start of the same moment; starts of
    one moment come by job_id.  The user's limit is looked at before the server's.
    ``work``: a new folder for what each round has found.

    Defined cases: a job without a start has no row; one that ends before it starts holds
    its slot for no time; jobs without a user are one user's; repeated job_ids are told
    apart only by their order.
    """
    if stretch < backstop:
        raise ValueError("a slot must not outlast the stretch after its own")
    spark, width = jobs.sparkSession, stretch * 60_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    at = micros("start_ts")
    limit = at + backstop * 60_000_000
    owner = F.coalesce(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("-"))
    rows = jobs.where("start_ts IS NOT NULL").select(((at - F.pmod(at, F.lit(width))) / width).cast("long").alias("stretch"), at.alias("at"), F.least(F.coalesce(micros("end_ts"), limit), limit).alias("until"), owner.alias("owner"), F.col("job_id").cast("long").alias("job_id"))
    rows.repartition("stretch").sortWithinPartitions("stretch", "at", "job_id", "until").mapInArrow(_pack, "stretch long, part int, starts binary").write.parquet(f"{work}/packed")
    packed = spark.read.schema("stretch long, part int, starts binary").parquet(f"{work}/packed")
    none: Column = F.array().cast(SLOTS)
    todo, turn, span = packed.select("*", F.col("stretch").alias("run"), none.alias("entry")), 0, 1
    while True:
        dealt = todo.select("run", "stretch", "part", "starts", "entry").repartition("run").sortWithinPartitions("run", "stretch", "part")
        dealt.mapInArrow(_states(per_user, per_server, width), STATE).withColumn("turn", F.lit(turn)).write.parquet(f"{work}/slots/round={turn}")
        every = spark.read.schema(f"{STATE}, turn int").parquet(f"{work}/slots")
        last = every.groupBy("stretch").agg(F.max_by(F.struct("began", "ended"), "turn").alias("s")).select("stretch", "s.*")
        # what a stretch leaves to the next one is what it left in its last round
        after = last.join(last.select((F.col("stretch") + 1).alias("stretch"), F.col("ended").alias("before")), "stretch", "left").select("stretch", "began", F.coalesce("before", none).alias("entry"))
        after.write.parquet(f"{work}/known/{turn}")
        known = spark.read.schema(f"stretch long, began {SLOTS}, entry {SLOTS}").parquet(f"{work}/known/{turn}")
        wrong = known.where("began <> entry")
        if not wrong.limit(1).count():
            break
        turn, span = turn + 1, span * LONGER
        first = known.agg(F.min("stretch")).first()[0]
        run = F.floor((F.col("stretch") - first) / span)
        todo = packed.withColumn("run", run).join(wrong.select(run.alias("run")).distinct(), "run", "left_semi").join(known.select("stretch", "entry"), "stretch")
    begun = packed.join(known.select("stretch", "began"), "stretch").select("stretch", "part", "starts", "began").repartition("stretch").sortWithinPartitions("stretch", "part")
    decided = begun.mapInArrow(_decisions(per_user, per_server), DECIDED)
    wait = F.create_map(*[F.lit(x) for pair in RETRY_AFTER.items() for x in pair])
    user = F.when(F.col("owner") != "-", F.col("owner").substr(F.lit(2), F.length("owner"))).cast(jobs.schema["user_id"].dataType)
    return decided.select("job_id", user.alias("user_id"), F.col("reason").isNull().alias("admitted"), "reason", F.try_element_at(wait, F.col("reason")).alias("retry_after"), "open_user", "open_total")
