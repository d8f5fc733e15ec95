"""Operator 6, nearest neighbours by a block matrix join.

Vectors are packed into tiles: rows of one dimension, scaled to int8 with a scale for each vector. A query tile times a row tile
is one integer matrix product; it gives each distance up to a bound that follows from the two quantisation errors and from the
rounding of what is computed in double precision. In a tile pair every row stays whose least possible distance is within the k-th
least possible upper distance of the query; those rows are computed again in double precision, and a heap of the k best for each
query is carried through a task. Tasks' heaps are then merged. No true neighbour is lost: bounds grow with the vectors' lengths,
tiles are scaled by a power of two so that nothing overflows, and what cannot be compared (NaN) stays.

Queries grow with the table, so they are never broadcast: a group of rows is shuffled once and stays where it is, tiles of queries
are copied to the groups, and a task meets one of them at a time.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components take no part; vectors of another
dimension than a query's are not compared with it. Distances of vectors whose squares leave the range of doubles are computed on
scaled vectors, so they are finite wherever the distance itself is. Equal distances: smaller vec_id first. Rows that repeat a
vec_id are candidates each; all rows with the query's id are left out, and one of them asks. Rows with null vec_id take no part.
With fewer than k candidates all are returned; an empty table gives no rows. Long vectors: a tile holds fewer of them, one at
least. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqpack.llm import common
from seqpack.llm.common import cut

K, EVERY = 10, 100
#: Components (vectors times dimension) of a query tile and of a row group, queries and rows of one matrix product.
QUERY_TILE, ROW_GROUP, QUERIES, ROWS = 1 << 18, 1 << 21, 256, 2048


#: Beyond two to this power, or below its inverse, vectors are scaled before anything is squared; slack for what underflows then.
FAR, EPS, LEAST = 400, np.finfo(np.float64).eps, 2.0**-1060


def exponent(*arrays: np.ndarray) -> int:
    """The power of two that the largest component of all arrays is below, or 0 in the range where squares are safe."""
    e = int(np.frexp(max(np.abs(a).max(initial=0.0) for a in arrays))[1])
    return e if abs(e) > FAR else 0


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and upper bounds of the Euclidean norms of what rounding took away."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / np.where(scale > 1e-290, scale, np.inf)[:, None])
    left, size = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    return codes.astype(np.int8), scale, left + EPS * (8 + x.shape[1]) * (left + size) + 2.0**-530


def distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squares are summed from the first component to the last, so that equal vectors have equal distances in any tile."""
    e = np.frexp(np.maximum(np.abs(rows).max(axis=1), np.abs(query).max()))[1]
    e = np.where(np.abs(e) > FAR, e + 1, 0)
    if e.any():
        gap = np.ldexp(rows, -e[:, None]) - np.ldexp(query, -e[:, None])
        return np.ldexp(np.sqrt(np.cumsum(gap * gap, axis=1)[:, -1]), e)
    gap = rows - query
    return np.sqrt(np.cumsum(gap * gap, axis=1)[:, -1])


def survivors(q: tuple, r: tuple, k: int, best: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which pairs of a tile can still be among a query's k best. best: each query's k-th distance so far; own: pairs to leave out."""
    (qc, qs, qe), (rc, rs, re) = q, r
    dim = qc.shape[1]
    exact = np.float32 if dim <= 1024 else np.float64  # whole numbers below 2**24 or 2**53
    product = (qc.astype(exact) @ rc.astype(exact).T).astype(np.float64)
    qn, rn = (qc.astype(np.int64) ** 2).sum(axis=1) * qs**2, (rc.astype(np.int64) ** 2).sum(axis=1) * rs**2
    both = qn[:, None] + rn[None, :]
    about, slack = both - 2 * product * (qs[:, None] * rs[None, :]), 32 * EPS * both + LEAST
    error, near = qe[:, None] + re[None, :], EPS * (dim + 16)  # near: what rounding does to a distance that is computed again
    upper = (np.sqrt(np.maximum(about, 0) + slack) + error) * (1 + near)
    upper = np.where(own | np.isnan(upper), np.inf, upper)
    lower = (np.sqrt(np.maximum(about - slack, 0)) - error) * (1 - near)
    limit = np.minimum(best, np.partition(upper, k - 1, axis=1)[:, k - 1]) if upper.shape[1] >= k else best
    return ~(lower > (limit * (1 + 8 * EPS) + LEAST)[:, None]) & ~own


def _sound(vectors: DataFrame) -> DataFrame:
    whole = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole).select("vec_id", F.size("v").alias("dim"), "v")


def _merged(heap: list, d: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Push pairs on a heap of the k least (distance, id), the worst on top."""
    for j in np.lexsort((ids, d))[:k]:
        pair = (-float(d[j]), -int(ids[j]))
        if len(heap) < k:
            heapq.heappush(heap, pair)
        elif pair > heap[0]:
            heapq.heapreplace(heap, pair)
        else:
            break


def _matched(k: int):
    """Each row holds a query tile and a group of rows."""

    def run(batches):
        for b in batches:
            for asked, group in zip(b.column("asked"), b.column("rows"), strict=True):
                q_ids, queries = asked.values.field("vec_id").to_numpy(), _matrix(asked.values)
                ids, vectors = group.values.field("vec_id").to_numpy(), _matrix(group.values)
                heaps: list[list] = [[] for _ in q_ids]
                for at in range(0, len(ids), ROWS):
                    here = slice(at, at + ROWS)
                    for first in range(0, len(q_ids), QUERIES):
                        some = np.arange(first, min(len(q_ids), first + QUERIES))
                        e = exponent(queries[some], vectors[here])
                        best = np.ldexp(np.array([-heaps[i][0][0] if len(heaps[i]) == k else np.inf for i in some]), -e)
                        left = survivors(quantised(np.ldexp(queries[some], -e)), quantised(np.ldexp(vectors[here], -e)), k, best, q_ids[some][:, None] == ids[None, here])
                        for i in np.flatnonzero(left.any(axis=1)):
                            rows = at + np.flatnonzero(left[i])
                            _merged(heaps[first + i], distances(queries[first + i], vectors[rows]), ids[rows], k)
                found = [(q, -v, -d) for q, heap in zip(q_ids.tolist(), heaps, strict=True) for d, v in heap]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return run


def _matrix(rows: pa.StructArray) -> np.ndarray:
    return rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row of vectors (vec_id, embedding, ...) whose id is divisible by every."""
    sound = cut(_sound(vectors))
    asks = F.col("vec_id") % every == 0
    spread = F.lit(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = lambda count, most: F.ceil(count * F.col("dim") / F.lit(most)).cast("int")
    sizes = sound.groupBy("dim").agg(F.count("*").alias("n"), F.sum(asks.cast("int")).alias("q"))
    sizes = cut(sizes.where("q > 0").select("dim", F.greatest(n(F.col("n"), ROW_GROUP), F.least(spread, F.ceil(F.col("n") / 64).cast("int"))).alias("groups"), n(F.col("q"), QUERY_TILE).alias("tiles")))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    packed = lambda name: F.collect_list(F.struct("vec_id", "v")).alias(name)
    rows = sound.join(F.broadcast(sizes), "dim").withColumn("group", F.pmod(F.xxhash64("vec_id", "v"), F.col("groups")).cast("int"))
    rows = rows.groupBy("dim", "group").agg(packed("rows"))
    asked = sound.where(asks).dropDuplicates(["vec_id"]).join(F.broadcast(sizes), "dim").withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
    asked = asked.groupBy("dim", "tile", "groups").agg(packed("asked")).select("dim", upto("groups").alias("group"), "asked")
    found = asked.join(rows.hint("merge"), ["dim", "group"]).select("asked", "rows").mapInArrow(_matched(k), "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.select("query_id", F.row_number().over(place).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op6_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"))


ORACLE = f"""
with v as (select vec_id, embedding::double[] as x from embeddings where vec_id is not null and embedding is not null),
sound as (select vec_id, x from v where not list_contains(list_transform(x, lambda c: c is null or isnan(c) or isinf(c)), true) and list_contains(list_transform(x, lambda c: c <> 0), true)),
pairs as (select q.vec_id as query_id, r.vec_id, sqrt(list_sum(list_transform(list_zip(q.x, r.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) as score from sound q join sound r on q.vec_id % {EVERY} = 0 and q.vec_id <> r.vec_id and len(q.x) = len(r.x))
select query_id, (row_number() over (partition by query_id order by score, vec_id))::int as rank, vec_id, score from pairs
qualify row_number() over (partition by query_id order by score, vec_id) <= {K}
"""
