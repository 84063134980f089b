"""Exact nearest passages: blocks of vectors multiplied where they can matter, bounded lists kept.

A block's passages are gathered around pivots.  By the triangle inequality of angles no
passage of a group is nearer to a question than the pivot's angle less the group's
radius; a group that cannot reach a question's k-th best is not multiplied with it.
What survives is measured again in the order of the components, as Spark's own fold
does, so that equal vectors have equal similarities wherever they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounding of a product of unit vectors, with room to spare.
SLACK = 1e-9
#: Questions of one product; passages and questions of one group where both sides are shuffled; pairs measured again at once.
TILE, PASSAGES, QUESTIONS, PAIRS = 512, 20_000, 4_000, 100_000


def norms(v: np.ndarray) -> np.ndarray:
    """Lengths of rows, squares added in the order of the components."""
    return np.sqrt(np.cumsum(v * v, axis=1)[:, -1])


def measured(q: np.ndarray, p: np.ndarray, qi: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, products added in the order of the components."""
    qn, pn, out = norms(q), norms(p), np.empty(len(qi))
    for i in range(0, len(qi), PAIRS):
        a, b = qi[i : i + PAIRS], pi[i : i + PAIRS]
        out[i : i + PAIRS] = np.cumsum(q[a] * p[b], axis=1)[:, -1] / (qn[a] * pn[b])
    return out


def grouped(unit: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows by their nearest of about sqrt(n) pivots: members of each group, pivots, and the groups' radii as angles."""
    n = len(unit)
    pivots = unit[np.linspace(0, n - 1, max(1, int(np.sqrt(n)))).astype(int)]
    near = unit @ pivots.T
    home = near.argmax(axis=1)
    angle = np.arccos(np.clip(near[np.arange(n), home], -1, 1))
    order = np.argsort(home, kind="stable")
    starts = np.searchsorted(home[order], np.arange(len(pivots) + 1))
    members = [order[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return members, pivots, np.array([angle[m].max() if len(m) else 0.0 for m in members])


def reaching(q: np.ndarray, p: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows of ``q``, rows of ``p``, pairs multiplied), tile by tile: all pairs that may be among a question's ``k`` nearest.

    ``least`` is a similarity that each question's k-th best has already.
    """
    uq, up = q / norms(q)[:, None], p / norms(p)[:, None]
    members = [np.arange(len(p))]
    worth = len(q) > 4 * np.sqrt(len(p)) and len(p) > 16 * k  # groups cost a product with each pivot
    if worth:
        members, pivots, radii = grouped(up)
    none = np.zeros(0, np.int64)
    for t in range(0, len(q), TILE):
        tile, best, multiplied = uq[t : t + TILE], least[t : t + TILE].copy(), 0
        if worth:
            to_pivots = tile @ pivots.T
            multiplied += to_pivots.size
            best = np.maximum(best, np.partition(to_pivots, -k, axis=1)[:, -k]) if len(pivots) >= k else best
            bound = np.cos(np.maximum(np.arccos(np.clip(to_pivots, -1, 1)) - radii - 1e-7, 0))
        top, found = np.full((len(tile), k), -np.inf), []
        for g in np.argsort(-bound.max(axis=0)) if worth else [0]:
            live = np.flatnonzero(bound[:, g] >= best - SLACK) if worth else np.arange(len(tile))
            if not len(live) or not len(members[g]):
                continue
            near = tile[live] @ up[members[g]].T
            multiplied += near.size
            kept = near if near.shape[1] <= k else np.partition(near, -k, axis=1)[:, -k:]
            top[live] = np.partition(np.hstack([top[live], kept]), -k, axis=1)[:, -k:]
            best[live] = np.maximum(best[live], top[live].min(axis=1))
            a, b = np.nonzero(near >= (best[live] - SLACK)[:, None])
            found.append((live[a], members[g][b], near[a, b]))
        a, b, sim = (np.concatenate(x) for x in zip((none, none, np.zeros(0)), *found, strict=True))
        ok = sim >= best[a] - SLACK
        yield a[ok] + t, b[ok], multiplied


class Best:
    """The ``k`` best passages so far of each of a user's questions: similarity down, then the smaller id."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k, self.least = q, k, np.full(len(q), -np.inf)
        self.at, self.sim, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def see(self, p: np.ndarray, ids: np.ndarray) -> int:
        """Take in a block of passages; how many pairs were multiplied for it."""
        multiplied = 0
        for a, b, n in reaching(self.q, p, self.k, self.least):
            multiplied += n
            at, sim = np.concatenate([self.at, a]), np.concatenate([self.sim, measured(self.q, p, a, b)])
            all_ids = ids[b] if self.ids is None else np.concatenate([self.ids, ids[b]])
            order = np.lexsort((all_ids, -sim, at))
            sorted_at = at[order]
            place = np.arange(len(at)) - np.searchsorted(sorted_at, sorted_at)
            last = order[place == self.k - 1]
            self.least[at[last]] = sim[last]
            keep = order[place < self.k]
            self.at, self.sim, self.ids = at[keep], sim[keep], all_ids[keep]
        return multiplied


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the largest set of usable vectors of one length: not null, finite, not zero, without null components."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy()) * np.asarray(lists.is_valid())
    if not sizes.any():
        return np.zeros(0, np.int64), np.zeros((0, 0))
    dim = np.bincount(sizes[sizes > 0]).argmax()
    rows = np.flatnonzero(sizes == dim)
    flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    with np.errstate(over="ignore", invalid="ignore"):
        length = norms(flat)
    good = np.isfinite(length) & (length > 0)
    return rows[good], flat[good]


def keys(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_pylist(), dtype=str) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_numpy()


def _schema(questions: DataFrame, scope: DataFrame) -> str:
    kinds = questions.schema["question_id"].dataType.simpleString(), scope.schema["chunk_id"].dataType.simpleString()
    return f"question_id {kinds[0]}, chunk_id {kinds[1]}, similarity double"


def near_broadcast(questions: DataFrame, scope: DataFrame, k: int) -> DataFrame:
    """Each task's ``k`` nearest passages of every question; the questions (a checked number) travel to all tasks, passages stay where they are."""
    asked = questions.select("question_id", "user_id", "embedding").where("user_id IS NOT NULL").toArrow()
    at, matrix = vectors(asked["embedding"])
    of_user: dict = {}
    for i, row in enumerate(at.tolist()):
        of_user.setdefault(asked["user_id"][row].as_py(), []).append(i)
    q_ids, dim = asked["question_id"].take(pa.array(at)).combine_chunks(), matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kind = {}, None
        for batch in batches:
            kind = batch.schema.field("chunk_id").type
            rows, p = vectors(batch["embedding"])
            if not len(rows) or p.shape[1] != dim:
                continue
            users, ids = batch["user_id"].take(pa.array(rows)).dictionary_encode(), keys(batch["chunk_id"])[rows]
            codes = users.indices.to_numpy(zero_copy_only=False)
            for code, user in enumerate(users.dictionary.to_pylist()):
                if user in of_user:
                    best = seen.setdefault(user, Best(matrix[of_user[user]], k))
                    best.see(p[codes == code], ids[codes == code])
        for user, best in seen.items():
            if len(best.at):
                mine = q_ids.take(pa.array(np.array(of_user[user])[best.at]))
                yield pa.RecordBatch.from_arrays([mine, pa.array(best.ids.tolist(), kind), pa.array(best.sim)], ["question_id", "chunk_id", "similarity"])

    return scope.select("chunk_id", "user_id", "embedding").mapInArrow(run, _schema(questions, scope))


def near_shuffled(questions: DataFrame, scope: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest passages of every question in each block of its user's passages.

    A user's passages and questions are cut into as many blocks as their number asks
    for, and each pair of blocks is one bounded group.
    """
    blocks = lambda n, size: F.ceil(F.count(F.lit(1)) / size).cast("int").alias(n)
    sizes = scope.groupBy("user_id").agg(blocks("_nb", PASSAGES)).join(questions.groupBy("user_id").agg(blocks("_nq", QUESTIONS)), "user_id")
    passages = scope.select("chunk_id", "user_id", "embedding").join(sizes, "user_id").withColumn("_b", F.pmod(F.hash("chunk_id"), "_nb")).withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
    asked = questions.select("question_id", "user_id", "embedding").join(sizes, "user_id").withColumn("_a", F.pmod(F.hash("question_id"), "_nq")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at, q = vectors(left["embedding"])
        rows, p = vectors(right["embedding"])
        best = Best(q, k)
        if len(at) and len(rows) and q.shape[1] == p.shape[1]:
            best.see(p, keys(right["chunk_id"])[rows])
        ids = pa.array([] if best.ids is None else best.ids.tolist(), right.schema.field("chunk_id").type)
        return pa.table({"question_id": left["question_id"].take(pa.array(at[best.at])), "chunk_id": ids, "similarity": pa.array(best.sim)})

    by = ["user_id", "_a", "_b"]
    return asked.select(*by, "question_id", "embedding").groupBy(*by).cogroup(passages.select(*by, "chunk_id", "embedding").groupBy(*by)).applyInArrow(run, _schema(questions, scope))
