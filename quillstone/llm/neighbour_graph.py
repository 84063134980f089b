"""Approximate nearest neighbours: NN-descent builds a graph by joins, queries walk it greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quillstone.llm.anchors import ragged
from quillstone.llm.numbering import numbered
from quillstone.llm.staging import discard, stage
from quillstone.llm.words import mix

#: Neighbours of a node in the graph.
DEGREE = 40
#: Fresh and settled neighbours that a node shows to its neighbours in a round, each way.
SAMPLE = 12
#: Those that list a node beyond SPARE * SAMPLE are thinned out by lot before the shuffle, if they are more than one in HUBS of all edges.
SPARE, HUBS = 64, 100_000
#: Best partners that a meeting proposes to each of its members.
PROPOSALS = 6
#: The descent ends when fewer than this share of all list places changed, or after so many rounds.
SETTLED, ROUNDS = 0.03, 9
#: A query keeps so many nodes, opens so many of them in a step, and re-ranks so many by their original vectors.
BEAM, OPENED, RERANKED = 128, 48, 40
STEPS = 10


#: The graph: lists by similarity; which neighbours have not been shown yet; those shown in the next round; the least similarity of a full list; new neighbours.
GRAPH = "node long, code binary, ids array<long>, sims array<double>, fresh array<boolean>, shown_fresh array<long>, shown_old array<long>, worst double, changed int"
GRAPH_NAMES = [column.split()[0] for column in GRAPH.split(", ")]


def encoded(x: np.ndarray, width: int) -> list[bytes]:
    """The vectors as they are, in floats of ``width`` bytes, and a last byte that names the width."""
    return [row.tobytes() + bytes([width]) for row in x.astype(f"<f{width}")]


def decoded(column) -> np.ndarray:
    """The vectors of a binary column as unit vectors in double precision."""
    rows = column.to_pylist()
    if not rows:
        return np.zeros((0, 1))
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    x = raw[:, :-1].copy().view(f"<f{raw[0, -1]}").astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Sorted batches regrouped so that no key is cut in two."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None:
        yield rest


def bounds_of(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def distinct_nodes(vectors: DataFrame, keep: int, width: int = 8) -> tuple[DataFrame, DataFrame]:
    """(nodes, members), both staged: each distinct vector is a node, numbered from 0.

    nodes: node, vector (doubles), code (the same in floats of ``width`` bytes).  members: node, vec_id; the ``keep`` smallest
    of each node are marked ``near``.
    """
    named = vectors.withColumn("name", F.xxhash64("vector"))
    firsts = named.groupBy("name").agg(F.min("vec_id").alias("first_id"))
    nodes = numbered(firsts, "first_id", "name", label="vector-numbers").select(F.col("row_no").alias("node"), "name", "first_id")
    nodes = stage(nodes, "vector-names")
    mine = vectors.select(F.col("vec_id").alias("first_id"), "vector")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(encoded(x, width), pa.binary())], names=["node", "vector", "code"])

    full = nodes.join(mine, "first_id").select("node", "vector").mapInArrow(encode, "node long, vector array<double>, code binary")
    place = F.row_number().over(Window.partitionBy("name").orderBy("vec_id"))
    near = named.select("name", "vec_id").withColumn("place", place).where(F.col("place") <= keep).select("name", "vec_id")
    return stage(full, "nodes"), stage(near.join(nodes, "name").select("node", "vec_id"), "members")


def first_graph(nodes: DataFrame, n: int, degree: int, sample: int) -> DataFrame:
    """Each node with ``degree`` pseudo-random others (all others, if there are no more), not yet measured."""
    if n <= degree + 1:
        ids = F.sequence(F.lit(0).cast("long"), F.lit(max(n - 1, 0)).cast("long"))
    else:
        ids = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(degree)), lambda j: F.pmod(F.xxhash64("node", j), F.lit(n))))
    ids = F.filter(ids, lambda i: i != F.col("node"))
    first = nodes.select("node", "code", ids.alias("ids"))
    shown = F.slice("ids", 1, sample)
    return first.select(
        "node", "code", "ids", F.transform("ids", lambda i: F.lit(-2.0)).alias("sims"), F.transform("ids", lambda i, k: k >= sample).alias("fresh"),
        shown.alias("shown_fresh"), F.slice("ids", 1, 0).alias("shown_old"), F.lit(-3.0).alias("worst"), F.size("ids").alias("changed"),
    )


def hubs(picked: DataFrame, n: int, sample: int) -> DataFrame:
    """(host, n): the nodes that more than one in HUBS of all shown edges lead to, fewer than HUBS of them."""
    least = max(SPARE * sample, 2 * sample * n // HUBS)
    return picked.groupBy(F.col("other").alias("host")).agg(F.count(F.lit(1)).alias("shown")).where(F.col("shown") > least)


def meetings(graph: DataFrame, n: int, turn: int, sample: int, proposals: int) -> tuple[DataFrame, DataFrame]:
    """(the hubs, staged; and node, ids, sims): for each member of a meeting the closest other members that would improve its list.

    A node hosts the neighbours that it shows in this round, those that show it, and
    itself.  Of the very many that show a hub, most stay away before anything is shuffled.
    """
    card = graph.select("node", "code", "worst", "shown_fresh", "shown_old")
    shows = [card.select("node", "code", "worst", F.explode(c).alias("other"), F.lit(fresh).alias("fresh")) for c, fresh in (("shown_fresh", True), ("shown_old", False))]
    shows = shows[0].unionByName(shows[1])
    names = lambda host, member, kind: [host.alias("host"), member.alias("member"), F.col("fresh"), F.lit(kind).alias("kind"), F.col("code"), F.col("worst")]
    forward = shows.select("node", "other", "fresh").join(card.select(F.col("node").alias("other"), "code", "worst").hint("shuffle_hash"), "other").select(*names(F.col("node"), F.col("other"), 1))
    backward = shows.select(*names(F.col("other"), F.col("node"), 2))
    crowded = stage(hubs(shows, n, sample), "hubs")
    if crowded.limit(1).count():
        lot = F.pmod(F.xxhash64("member", "host", F.lit(turn), F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
        crowd = backward.join(F.broadcast(crowded), "host", "left")
        backward = crowd.where(F.col("shown").isNull() | (lot * F.col("shown") < SPARE * sample)).drop("shown")
    own = card.withColumn("fresh", F.lit(False)).select(*names(F.col("node"), F.col("node"), 0))
    rows = forward.unionByName(backward).unionByName(own).withColumn("draw", F.xxhash64("host", "member", F.lit(turn)))
    dealt = rows.repartition("host").sortWithinPartitions("host", "kind", "fresh", "draw").select("host", "member", "fresh", "kind", "code", "worst")

    def limited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At most ``sample`` rows of a host, kind and freshness; the rest of a long run passes by."""
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            run = batch.column(0).to_numpy() * 8 + batch.column(3).to_numpy() * 2 + batch.column(2).to_numpy(zero_copy_only=False)
            edges = bounds_of(run)
            rank = np.arange(len(run)) - np.repeat(edges[:-1], np.diff(edges))
            if run[0] == last:
                rank[: edges[1]] += count
            last, count = run[-1], int(rank[-1]) + 1
            yield batch.filter(pa.array(rank < sample))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(limited(batches)):
            hosts, members = table.column(0).to_numpy(), table.column(1).to_numpy()
            fresh, worst = table.column(2).to_numpy(), table.column(5).to_numpy()
            x = decoded(table.column(4))
            nodes, ids, sims = [], [], []
            edges = bounds_of(hosts)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a < 2 or not fresh[a:b].any():
                    continue
                m, f = members[a:b], fresh[a:b]
                s = x[a:b] @ x[a:b].T
                s[~(f[:, None] | f[None, :]) | (m[:, None] == m[None, :]) | (s <= worst[a:b, None])] = -9
                k = min(proposals, b - a)
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(s, at, 1)
                nodes.append(np.repeat(m, k))
                ids.append(m[at].ravel())
                sims.append(best.ravel())
            if nodes:
                node, other, sim = np.concatenate(nodes), np.concatenate(ids), np.concatenate(sims)
                live = sim > -9
                node, other, sim = node[live], other[live], sim[live]
                order = np.lexsort((other, node))
                node, other, sim = node[order], other[order], sim[order]
                once = np.ones(len(node), bool)
                once[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
                node, other, sim = node[once], other[once], sim[once]
                e = bounds_of(node) if len(node) else np.zeros(1, np.int64)
                rows = np.repeat(np.arange(len(e) - 1), np.diff(e))
                yield pa.RecordBatch.from_arrays([pa.array(node[e[:-1]], pa.int64()), ragged(other, rows, len(e) - 1, pa.int64()), ragged(sim, rows, len(e) - 1, pa.float64())], names=["node", "ids", "sims"])

    return crowded, dealt.mapInArrow(meet, "node long, ids array<long>, sims array<double>")


def improved(graph: DataFrame, proposals: DataFrame, turn: int, sample: int, degree: int) -> DataFrame:
    """The graph after a round: the best of old list and proposals, what each node shows next, and how many of its neighbours are new."""
    old = graph.select("node", F.lit(0).alias("kind"), "code", "ids", "sims", "fresh")
    new = proposals.select("node", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("code"), "ids", "sims", F.transform("ids", lambda i: F.lit(True)).alias("fresh"))
    dealt = old.unionByName(new).repartition("node").sortWithinPartitions("node", "kind")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            table = table.combine_chunks()
            rows = table.column(0).to_numpy()
            lists = table.column(3).combine_chunks()
            counts = np.diff(lists.offsets.to_numpy())
            node = np.repeat(rows, counts)
            kind = np.repeat(table.column(1).to_numpy(), counts)
            ids = lists.flatten().to_numpy()
            sims = table.column(4).combine_chunks().flatten().to_numpy()
            fresh = table.column(5).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            # a known neighbour keeps its mark, but takes a measured similarity
            order = np.lexsort((kind, ids, node))
            node, ids, sims, fresh = node[order], ids[order], sims[order], fresh[order]
            one = np.concatenate([[True], (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])]) if len(node) else np.zeros(0, bool)
            at = np.flatnonzero(one)
            sims = np.maximum.reduceat(sims, at) if len(at) else sims
            node, ids, fresh = node[at], ids[at], fresh[at]
            order = np.lexsort((ids, -sims, node))
            node, ids, sims, fresh = node[order], ids[order], sims[order], fresh[order]
            e = bounds_of(node) if len(node) else np.zeros(1, np.int64)
            keep = np.arange(len(node)) - np.repeat(e[:-1], np.diff(e)) < degree
            node, ids, sims, fresh = node[keep], ids[keep], sims[keep], fresh[keep]

            # the first of each kind by a hash are shown next; a fresh one that is shown is settled then
            draw = mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(turn))
            order = np.lexsort((draw, fresh, node))
            run = bounds_of(node[order] * 2 + fresh[order]) if len(node) else np.zeros(1, np.int64)
            shown = np.zeros(len(node), bool)
            shown[order] = np.arange(len(node)) - np.repeat(run[:-1], np.diff(run)) < sample

            first = table.column(1).to_numpy() == 0
            names = rows[first]
            of, n = np.searchsorted(names, node), len(names)
            e = np.searchsorted(of, np.arange(n + 1))
            worst = np.full(n, -3.0)
            full = np.diff(e) >= degree
            worst[full] = sims[e[1:][full] - 1]
            lists = [ragged(ids[shown & (fresh == kind)], of[shown & (fresh == kind)], n, pa.int64()) for kind in (True, False)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.int64()), table.column(2).combine_chunks().filter(pa.array(first)), ragged(ids, of, n, pa.int64()), ragged(sims, of, n, pa.float64()), ragged(fresh & ~shown, of, n, pa.bool_()),
                    *lists, pa.array(worst), pa.array(np.bincount(of, weights=fresh, minlength=n).astype(np.int32)),
                ],
                names=GRAPH_NAMES,
            )

    return dealt.mapInArrow(merge, GRAPH)


def descend(nodes: DataFrame, n: int, degree: int = DEGREE, sample: int = SAMPLE, proposals: int = PROPOSALS, rounds: int = ROUNDS) -> DataFrame:
    """NN-descent: the graph, staged.

    In each round a node's sampled neighbours, and the nodes that sampled it, meet at
    it; pairs with a fresh member are measured, and each member takes what improves
    its list.  Both the lists and the meetings are of bounded size, so a round is
    linear in the number of nodes.
    """
    graph = stage(first_graph(nodes, n, degree, sample), "graph")
    for turn in range(rounds if n > 1 else 0):
        crowded, found = meetings(graph, n, turn, sample, proposals)
        after = stage(improved(graph, found, turn, sample, degree), "graph")
        discard(graph, crowded)
        graph = after
        changed = graph.agg(F.sum("changed")).first()[0] or 0
        if changed <= SETTLED * degree * n:
            break
    return graph


def walked(graph: DataFrame, queries: DataFrame, beam: int = BEAM, opened: int = OPENED, steps: int = STEPS) -> DataFrame:
    """(query, ids): the closest nodes that a greedy walk finds for each query node, staged.

    A walk starts at the query's own list.  Each step opens the best unopened nodes of
    its beam and measures their neighbours that it has not seen; it ends when the
    whole beam has been opened.
    """
    schema = "query long, code binary, ids array<long>, sims array<double>, seen array<long>, open array<long>"

    def next_nodes(ids: np.ndarray, done: set[int]) -> np.ndarray:
        return np.array([i for i in ids[:beam].tolist() if i not in done][:opened], np.int64)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q, code, ids, sims in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                first = next_nodes(np.array(ids, np.int64), set())
                out.append((q, code, ids, sims, [q, *ids], first.tolist()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["query", "code", "ids", "sims", "seen", "open"])

    own = graph.join(queries.select(F.col("query").alias("node")).distinct(), "node").select("node", "code", "ids", "sims")
    # ``ids`` and ``sims`` hold every measured node, best first; ``done`` is what was opened
    state = stage(own.mapInArrow(start, schema).withColumn("done", F.col("open")), "walks")
    lists = graph.select(F.col("node").alias("at"), F.col("ids").alias("near"))
    codes = graph.select(F.col("node").alias("candidate"), F.col("code").alias("candidate_code"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            queries_ = table.column(0).to_numpy()
            edges = bounds_of(queries_)
            out = []
            x = decoded(table.column(2))
            kind = table.column(1).to_numpy()
            candidates = table.column(3).to_numpy()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if kind[a] != 0:
                    continue
                ids, sims, seen, done = (np.array(table.column(i)[a].as_py(), t) for i, t in ((4, np.int64), (5, np.float64), (6, np.int64), (7, np.int64)))
                new = candidates[a + 1 : b]
                all_ids = np.concatenate([ids, new])
                all_sims = np.concatenate([sims, x[a + 1 : b] @ x[a]])
                order = np.lexsort((all_ids, -all_sims))[:beam]
                opened_now = next_nodes(all_ids[order], set(done.tolist()))
                out.append((int(queries_[a]), table.column(2)[a].as_py(), all_ids[order].tolist(), all_sims[order].tolist(), np.concatenate([seen, new]).tolist(), opened_now.tolist(), np.concatenate([done, opened_now]).tolist()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["query", "code", "ids", "sims", "seen", "open", "done"])

    for _ in range(steps):
        if not state.where(F.size("open") > 0).limit(1).count():
            break
        asked = state.select("query", F.explode("open").alias("at"))
        reached = asked.join(lists, "at").select("query", F.explode("near").alias("candidate")).distinct()
        known = state.select("query", F.explode("seen").alias("candidate"))
        new = reached.join(known, ["query", "candidate"], "left_anti").join(codes, "candidate")
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<long>"), ("sims", "array<double>"), ("seen", "array<long>"), ("done", "array<long>"))]
        rows = state.select("query", F.lit(0).alias("kind"), "code", F.lit(None).cast("long").alias("candidate"), "ids", "sims", "seen", "done")
        rows = rows.unionByName(new.select("query", F.lit(1).alias("kind"), F.col("candidate_code").alias("code"), "candidate", *nothing))
        rows = rows.withColumn("candidate", F.coalesce("candidate", F.lit(-1)))
        dealt = rows.repartition("query").sortWithinPartitions("query", "kind")
        after = stage(dealt.select("query", "kind", "code", "candidate", "ids", "sims", "seen", "done").mapInArrow(measure, schema + ", done array<long>"), "walks")
        discard(state)
        state = after
    return state.select("query", "ids")


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)) * F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return dot / norm


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``: its ``k`` nearest other rows.

    query_id, rank (from 1), vec_id, score (cosine of the original vectors in double
    precision); nearest first, ties to the smaller vec_id.  All rows are indexed.

    Defined cases: a vector that is null, zero, or holds a null or non-finite component
    takes no part, nor does a null id, nor a vector of another length than most; of
    rows with one id one takes part; equal vectors are one node of the graph, and each
    of them can be found; with fewer than ``k`` others all are returned; an empty table
    gives an empty result; other columns are ignored.
    """
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), doubles.alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = sizes[0].dim if sizes else 0
    rows = rows.where(F.size("vector") == dim).dropDuplicates(["vec_id"])
    rows = stage(rows, "vectors")
    single = isinstance(vectors.select(vector).schema[0].dataType.elementType, FloatType)
    nodes, members = distinct_nodes(rows, k + 1, 4 if single else 8)
    graph = descend(nodes, nodes.count())
    queries = stage(rows.where(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64("vector").alias("name"), "vector"), "queries")
    names = nodes.select("node", F.xxhash64("vector").alias("name"))
    asked = stage(queries.join(names, "name").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"), F.col("vector").alias("query_vector")), "asked")
    found = walked(graph, asked)
    best = found.select("query", F.explode(F.slice("ids", 1, RERANKED)).alias("node")).unionByName(asked.select("query", F.col("query").alias("node")).distinct())
    scored = asked.join(best, "query").join(nodes.select("node", "vector"), "node").select("query_id", "node", cosine(F.col("query_vector"), F.col("vector")).alias("score"))
    pairs = scored.join(members, "node").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
