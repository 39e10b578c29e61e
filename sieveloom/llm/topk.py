"""Exact top-k by inner product, pruned by segment statistics.

Vectors become integers floor(scale * x). Cut a vector into segments, and keep
each segment's mean m and deviation s (the norm of what is left after the mean).
In a segment of length n the squared distance of two vectors is at least
n (m - m')^2 + (s - s')^2, so with their norms known the inner product is at most
the sum over segments of n m m' + s s'. The search is coarse to fine: all
candidates of a block under 4 segments, survivors under 16, and exact products
for those whose bound still reaches the k-th best score found so far.

Queries and candidates are dealt to blocks, and every pair of a query block and
a candidate block is one group of bounded size; each group gives its best k per
query, and these are merged. No score of all pairs is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 16384
TILE = 512
LEVELS = (4, 16)
#: Products of integers below this are exact in doubles for 2**12 components; larger
#: ones are multiplied as 64-bit integers.
EXACT = 1 << 20
#: Components are clipped here, so that all finite ones have an integer.
LARGEST = 1 << 62
NO_SCORE = np.iinfo(np.int64).min


def quantised(frame: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id (long), v (binary of little-endian int64): rows whose vector and id are
    not null and whose components are all finite numbers."""
    import pyspark.sql.types as T

    chosen = frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    chosen = chosen.where(F.col("id").isNotNull() & F.col("x").isNotNull())
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            flat = lists.flatten()
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64) if len(flat) else np.zeros(0)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])  # a null component is a nan here
            good = bad[offsets[1:]] == bad[offsets[:-1]]
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(x * scale)
            whole = np.clip(np.nan_to_num(whole, nan=0.0, posinf=LARGEST, neginf=-LARGEST), -LARGEST, LARGEST).astype("<i8")
            rows = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array([whole[offsets[i] : offsets[i + 1]].tobytes() for i in rows], pa.binary())], names=["id", "v"])

    return chosen.mapInArrow(run, schema)


def _matrix(values: list[bytes]) -> np.ndarray:
    """Rows of integers; shorter vectors end in zeros."""
    parts = [np.frombuffer(v, "<i8") for v in values]
    out = np.zeros((len(parts), max(map(len, parts), default=0)), np.int64)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each segment sqrt(n) * mean and deviation, side by side: the product of
    two rows of these bounds the inner product of the vectors."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    columns = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            part = x[:, a:b]
            centre = part.sum(1) / np.sqrt(b - a)
            columns += [centre, np.sqrt(np.maximum((part * part).sum(1) - centre * centre, 0))]
    return np.stack(columns, 1) if columns else np.zeros((len(x), 1))


def search_block(query_ids, queries, ids, candidates, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k candidates of each query in one block: (query row, id, score), score
    descending, then id ascending. A candidate with the query's id is its own."""
    width = max(queries.shape[1], candidates.shape[1])
    q = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    c = np.pad(candidates, ((0, 0), (0, width - candidates.shape[1])))
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    small = max(np.abs(qf).max(initial=0), np.abs(cf).max(initial=0)) < EXACT and width <= 4096
    left, right = (qf, cf) if small else (q, c)  # bounds are doubles either way, products exact
    levels = [(_statistics(qf, s), _statistics(cf, s)) for s in LEVELS if s < width]
    # Candidates with large norms come first, so that the k-th best rises early.
    order = np.lexsort((ids, -(cf * cf).sum(1)))
    slack = 1e-9 * np.sqrt((qf * qf).sum(1).max(initial=0) * (cf * cf).sum(1).max(initial=0)) + 1e-6
    n = len(q)
    best_score = np.zeros((n, 0), np.int64)
    best_id = np.zeros((n, 0), np.int64)
    for at in range(0, len(c), TILE):
        tile = order[at : at + TILE]
        floor = np.full(n, -np.inf)
        if best_score.shape[1] == k:
            floor = np.where(best_score[:, -1] == NO_SCORE, floor, best_score[:, -1].astype(np.float64))
        alive = np.ones((n, len(tile)), bool)
        for own, other in levels:
            if alive.mean() > 0.05:
                alive &= own @ other[tile].T + slack >= floor[:, None]
            else:
                i, j = np.nonzero(alive)
                alive[i, j] = np.einsum("ij,ij->i", own[i], other[tile[j]]) + slack >= floor[i]
        alive &= query_ids[:, None] != ids[tile][None, :]
        scores = np.full((n, len(tile)), NO_SCORE)
        if alive.mean() > 0.05:
            np.copyto(scores, (left @ right[tile].T).astype(np.int64), where=alive)
        else:
            i, j = np.nonzero(alive)
            scores[i, j] = np.einsum("ij,ij->i", left[i], right[tile[j]]).astype(np.int64)
        rows = np.flatnonzero(alive.any(1))
        if not len(rows) and best_score.shape[1] == k:
            continue
        if best_score.shape[1] < k:
            rows = np.arange(n)
        all_scores = np.concatenate([best_score[rows], scores[rows]], 1)
        all_ids = np.concatenate([best_id[rows], np.broadcast_to(ids[tile], (len(rows), len(tile)))], 1)
        pick = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]  # ~x falls as x rises, without overflow
        top_scores, top_ids = np.take_along_axis(all_scores, pick, 1), np.take_along_axis(all_ids, pick, 1)
        if best_score.shape[1] < top_scores.shape[1]:
            best_score, best_id = top_scores, top_ids
        else:
            best_score[rows], best_id[rows] = top_scores, top_ids
    i, j = np.nonzero(best_score != NO_SCORE)
    return i, best_id[i, j], best_score[i, j]


def top_k(spark: SparkSession, frame: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``, its k best other rows.

    Returns query_id, rank (from 1), vec_id and score (integer inner product of
    the floors); ties go to the smaller id, and fewer than k rows give fewer
    results. Rows with a null id or vector, or with a component that is null or
    not finite, take no part. A shorter vector counts as ending in zeros. Rows
    that share an id are each other's own and never meet; a repeated candidate
    counts as often as it stands, a repeated query once. Components are clipped at
    2**62; scores beyond 64 bits are not defined. An empty table gives no rows,
    and columns beside the two named are not read.
    """
    from .common import stage

    rows = stage(spark, quantised(frame, scale, id_col, vector_col), "vectors")
    queries = rows.where(F.col("id") % every == 0).distinct()
    n, n_queries = rows.count(), queries.count()
    across, down = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    asked = queries.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(across)).cast("int").alias("qb")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    offered = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(down)).cast("int").alias("cb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c = _matrix(left["v"].to_pylist()), _matrix(right["v"].to_pylist())
        query_ids, ids = left["id"].to_numpy(), right["id"].to_numpy()
        if len(q) and len(c):
            i, found, scores = search_block(query_ids, q, ids, c, k)
        else:
            i = found = scores = np.zeros(0, np.int64)
        return pa.table({"query_id": query_ids[i].astype(np.int64), "v": left["v"].take(pa.array(i)), "vec_id": found, "score": scores})

    found = asked.groupBy("qb", "cb").cogroup(offered.groupBy("qb", "cb")).applyInArrow(pair, "query_id long, v binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
