"""Exact top-k by inner product: columnar branch and bound.

Vectors are held in blocks in vertical layout (one row of the matrix for each
dimension).  A lane is a set of candidate blocks; every block of queries meets
every lane, each meeting being one stream: first the queries, then candidate
blocks one after another, so a task holds one block of each.  Scores
accumulate over blocks of dimensions.  After each, the candidates whose score so
far plus the largest possible rest (the product of the norms of the dimensions
still to come) stays below the query's k-th best score are dropped, and the
others compacted.  Bounds err upwards, and candidates that reach the threshold
exactly stay, so ties are decided by the smaller id and the result is exact.
Scores under 2**53 are summed as floats, larger ones as 64-bit integers, and those
of components that are too large for that as integers of any length.

Queries that meet all rows in blocks are the feature here; lanes and blocks
bound what one task holds.  Each lane returns k rows for a query, and a
window takes the best k of the lanes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

DIMS = 16
QUERY_BLOCK, CANDIDATE_BLOCK, LANE_BLOCKS = 16_384, 8_192, 16


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding -> vec_id, v: the components as doubles.  Vectors that are null or hold a null or non-finite component, and null ids, are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))


#: Components from here on are integers already, so that 64 * x is exact.
WHOLE = 2.0**52


def floors(x: np.ndarray) -> np.ndarray:
    """floor(64 * x) as doubles; beyond ``WHOLE`` it may round or overflow, see ``exact_floors``."""
    with np.errstate(over="ignore"):
        return np.floor(64 * x)


def exact_floors(x: np.ndarray) -> np.ndarray:
    """floor(64 * x) as Python integers."""
    out = np.empty(x.shape, object)
    for at, value in np.ndenumerate(x):
        out[at] = 64 * int(value) if abs(value) >= WHOLE else math.floor(64 * float(value))
    return out


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors: ids, dims, and the values dimension by dimension; shorter vectors are filled up with zeros."""

    def run(batches):
        held, n = [], 0

        def flush():
            ids = np.concatenate([h[0] for h in held])
            dims = max(h[1].shape[1] for h in held)
            values = np.concatenate([np.pad(h[1], ((0, 0), (0, dims - h[1].shape[1]))) for h in held])
            return pa.RecordBatch.from_pydict({"ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "dims": pa.array([dims], pa.int32()), "data": pa.array([np.ascontiguousarray(values.T).astype("<f8").tobytes()], pa.binary())})

        for batch in batches:
            ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            length = np.asarray(column.value_lengths())
            flat, width = column.flatten().to_numpy(zero_copy_only=False), int(length.max(initial=0))
            values = np.zeros((len(ids), width))
            values[np.arange(width) < length[:, None]] = flat
            for lo in range(0, len(ids), size):
                if n and n + len(ids[lo : lo + size]) > size:
                    yield flush()
                    held, n = [], 0
                held.append((ids[lo : lo + size], values[lo : lo + size]))
                n += len(ids[lo : lo + size])
        if held:
            yield flush()

    return rows.mapInArrow(run, "ids binary, dims int, data binary")


def _matrix(ids: bytes, dims: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(data, "<f8").reshape(dims, len(i))


class Search:
    """The best k candidates so far of each query of a block."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.values, self.k = ids, values, k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.floor = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, values: np.ndarray) -> None:
        dims = max(len(values), len(self.values))
        x, y = (np.pad(v, ((0, dims - len(v)), (0, 0))) for v in (self.values, values))
        q, c = floors(x), floors(y)
        most_q, most_c = (np.abs(v).max(0, initial=0) * max(dims, 1) ** 0.5 for v in (q, c))
        # Queries or candidates so large that a sum of products might not fit 64 bits.
        big_q, big_c = most_q >= 2.0**31, most_c >= 2.0**31
        q, small = np.where(big_q, 0.0, q), np.flatnonzero(~big_c)
        if len(small):
            part = c[:, small] if big_c.any() else c
            wide = float(most_q[~big_q].max(initial=0)) * float(most_c[small].max(initial=0)) >= 2.0**53
            self._add(np.flatnonzero(~big_q), q.astype(np.int64) if wide else q, ids[small], part.astype(np.int64) if wide else part)
        if big_q.any() or big_c.any():
            self._add_exactly(np.flatnonzero(big_q), x, ids, y)
            self._add_exactly(np.flatnonzero(~big_q), x, ids[big_c], y[:, big_c])

    def _add_exactly(self, queries: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        """Python integers; a score beyond a long becomes the nearest long."""
        if not len(queries) or not len(ids):
            return
        c = exact_floors(y)
        for i in queries.tolist():
            other = ids != self.ids[i]
            score = exact_floors(x[:, i]) @ c[:, other]
            self._keep(i, np.array([max(-(2**63), min(2**63 - 1, s)) for s in score], np.int64), ids[other])

    def _add(self, queries: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
        rest_q, rest_c = _rests(q), _rests(c)
        for lo in range(0, len(queries), 256):
            at = queries[lo : lo + 256]
            head = q[:DIMS, at].T @ c[:DIMS]
            for i, score in zip(at.tolist(), head, strict=True):
                self._one(i, score, ids, q[:, i], c, rest_q[:, i], rest_c)

    def _one(self, i, score, ids, q, c, rest_q, rest_c) -> None:
        keep = np.flatnonzero(ids != self.ids[i])
        score = score[keep]
        for b in range(1, len(rest_q)):
            rest, least = rest_q[b] * rest_c[b][keep], self.floor[i]
            alive = score + rest + 1e-9 * (np.abs(score) + rest) >= least - 1e-9 * abs(least) - 1e-3
            if not alive.all():
                keep, score = keep[alive], score[alive]
            if not len(keep):
                return
            if b * DIMS < len(q):
                part = slice(b * DIMS, (b + 1) * DIMS)
                score = score + q[part] @ (c[part] if len(keep) == c.shape[1] else c[part][:, keep])
        self._keep(i, score.astype(np.int64), ids[keep])

    def _keep(self, i: int, score: np.ndarray, found: np.ndarray) -> None:
        old_score, old_ids = self.best[i]
        score, found = np.concatenate([old_score, score]), np.concatenate([old_ids, found])
        if len(score) > self.k:
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, found = score[score >= least], found[score >= least]
        order = np.lexsort([found, -score])[: self.k]
        self.best[i] = score[order], found[order]
        if len(order) == self.k:
            self.floor[i] = score[order[-1]]


def _rests(m: np.ndarray) -> np.ndarray:
    """Norms of what is left from each block of dimensions on; the last row is 0."""
    squares = m.astype(np.float64) ** 2
    steps = [np.sqrt(squares[b:].sum(0)) for b in range(0, max(len(m), 1), DIMS)]
    return np.stack([*steps, np.zeros(m.shape[1])])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, lane_blocks: int = LANE_BLOCKS) -> DataFrame:
    """vec_id, v of both -> query_id, rank (from 1), vec_id, score; a candidate with the query's own id is no candidate.

    Ties go to the smaller id; all candidates are returned where there are
    fewer than k.  Vectors of unequal length compare as if filled up with zeros.
    Repeated rows are candidates as often as they come; of queries that share an id
    the least vector is used.  An empty side gives an empty result.  A score that does not fit a long
    becomes the nearest long.  ``v`` holds finite doubles, of which floor(64 * x) is compared; other columns are ignored.
    """
    queries, candidates = queries.groupBy("vec_id").agg(F.min("v").alias("v")), candidates.select("vec_id", "v")
    counts = [x.count() for x in (queries, candidates)]
    n_q = max(1, math.ceil(counts[0] / query_block))
    # As many lanes as memory asks for, or as there are cores to use.
    cores = queries.sparkSession.sparkContext.defaultParallelism
    lanes = max(1, math.ceil(counts[1] / (candidate_block * lane_blocks)), min(cores, math.ceil(counts[1] / candidate_block)))
    sent = []
    for kind, rows, n, size, own, other, many in ((0, queries, n_q, query_block, "q", "lane", lanes), (1, candidates, lanes, candidate_block, "lane", "q", n_q)):
        blocks = _blocks(rows.repartition(n), size).withColumn(own, F.spark_partition_id() % n).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
        sent.append(blocks.select("q", "lane", F.lit(kind).alias("kind"), "ids", "dims", "data"))
    met = sent[0].unionByName(sent[1]).repartition(n_q * lanes, "q", "lane").sortWithinPartitions("q", "lane", "kind")

    def run(batches):
        at, searches = None, []

        def flush():
            for s in searches:
                rows = [(int(i), r + 1, int(v), int(x)) for i, (score, ids) in zip(s.ids, s.best, strict=True) for r, (x, v) in enumerate(zip(score, ids, strict=True))]
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[lo : lo + 10_000], strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for q, lane, kind, ids, dims, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (q, lane) != at:
                    yield from flush()
                    at, searches = (q, lane), []
                block = _matrix(ids, dims, data)
                if kind == 0:
                    searches.append(Search(*block, k))
                else:
                    for s in searches:
                        s.add(*block)
        yield from flush()

    best = met.mapInArrow(run, "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def query(spark, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors)


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
