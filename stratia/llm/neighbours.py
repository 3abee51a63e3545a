"""Exact nearest neighbours by a block matrix join.

Vectors are scaled to length one and quantised to int8 with one step a vector. Blocks of query vectors meet blocks of
all vectors; the product of two int8 tiles gives every cosine up to a proven error (half a step of each side times
the other side's absolute sum). A pair survives if its upper bound reaches the k-th best lower bound of its query
in the tile; survivors are computed again in double precision from the original vectors and merged by heaps, first
inside a block pair, then over all of them.

The query set is stated (ids divisible by `every`), so the join is that set against all rows. It is dealt out as a grid of
block rows and block columns, so that a tile of queries is copied once a column and one of candidates once a row; their
numbers follow the sizes of both sides. Each row of the join holds one tile of queries and one of candidates. Codes,
steps and sums are made once, when vectors are packed. The original vectors travel with them, in the precision of the
column: where a third of all rows are nearly alike their error bounds overlap, and pairs that survive would be far more
than the tiles that they come from.

Defined cases: vectors that are null, empty, zero, of another length than `dimension` (that of most vectors, smallest
on ties, unless given), or hold null or non-finite components take no part, as queries or as candidates; a null id takes no part; ties go to the
smaller id; rows that share an id are candidates of their own for other queries and none for their own id; repeated
queries are one query; an empty table gives an empty result. Other columns play no part, so that their names cannot clash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.llm.common import table
from stratia.session import materialize, shuffle_partitions

EVERY, NEAREST, QUERY_TILE, TILE = 50, 5, 1024, 4096


def usable(df: DataFrame, key: str, vector: str, dimension: int | None = None) -> DataFrame:
    """(id, v): the rows whose vector takes part, as array<float> if the column is one, else as array<double>."""
    v = F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(fine)
    if dimension is None:
        sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
        dimension = sizes[0]["d"] if sizes else 0
    return rows.filter(F.size("v") == dimension)


TILES = "ids binary, vectors binary, codes binary, steps binary, sums binary, n int"


def tiles(rows: DataFrame, most: int) -> DataFrame:
    """Pack (id, v) into rows of up to `most` vectors with their codes, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []

        def out(n: int) -> pa.RecordBatch:
            i, v = np.concatenate(ids), np.concatenate(vectors)
            ids[:], vectors[:] = [i[n:]], [v[n:]]
            i, v = i[:n], v[:n]
            columns = [i, v, *quantise(v.astype(np.float64))]
            return pa.RecordBatch.from_arrays([*(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns), pa.array([len(i)], pa.int32())], names=["ids", "vectors", "codes", "steps", "sums", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            vectors.append(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            while sum(map(len, ids)) >= most:
                yield out(most)
        if sum(map(len, ids)):
            yield out(most)

    return rows.mapInArrow(run, TILES)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the vectors at length one, each vector's step, and the sum of its absolute components."""
    top = np.abs(v).max(axis=1, keepdims=True)
    unit = v / top  # first, so that squares neither vanish nor overflow
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    step = np.abs(unit).max(axis=1) / 127
    return np.rint(unit / step[:, None]).astype(np.int8), step, np.abs(unit).sum(axis=1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, with sums in the order of the components, so that equal vectors give equal values."""
    ab, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for d in range(a.shape[1]):
        x, y = a[:, d], b[:, d]
        ab, aa, bb = ab + x * y, aa + x * x, bb + y * y
    return ab / (np.sqrt(aa) * np.sqrt(bb))


#: Components whose int8 products sum exactly in single precision: 1024 * 127 * 127 < 2 ** 24.
EXACT = 1024


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of all pairs of int8 rows, exact for any number of components."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        out += a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T
    return out


def nearest_in_tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, of_q=None, of_c=None) -> list[tuple[int, float, int]]:
    """(query, cosine, candidate): of each query the k best of the tile; of_q, of_c: what quantise gives, where it is known."""
    (a, sa, la), (b, sb, lb) = of_q or quantise(q.astype(np.float64)), of_c or quantise(c.astype(np.float64))
    about = code_products(a, b) * sa[:, None] * sb[None, :]
    # Half a step of each side against the other side, both halves together, and the rounding of sums of d products.
    rounding = 8 * (q.shape[1] + 8) * 2.0**-52
    error = 0.5 * (sa[:, None] * lb[None, :] + la[:, None] * sb[None, :]) + 0.25 * q.shape[1] * sa[:, None] * sb[None, :] + rounding
    low = np.where(qid[:, None] == cid[None, :], -np.inf, about - error)
    reach = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q), -np.inf)
    i, j = np.nonzero((about + error >= reach[:, None]) & (qid[:, None] != cid[None, :]))
    best: dict[int, list] = {}
    for at in range(0, len(i), 1 << 16):
        ii, jj = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        for x, s, y in zip(qid[ii].tolist(), cosine(q[ii].astype(np.float64), c[jj].astype(np.float64)).tolist(), cid[jj].tolist(), strict=True):
            heap = best.setdefault(x, [])
            if len(heap) < k:
                heapq.heappush(heap, (s, -y))
            else:
                heapq.heappushpop(heap, (s, -y))
    return [(x, s, -y) for x, heap in best.items() for s, y in heap]


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = NEAREST, dimension: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): of each id divisible by `every` the k other rows of largest cosine."""
    spark = df.sparkSession
    rows = usable(df, key, vector, dimension)
    kind = np.float32 if rows.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    candidates = materialize(tiles(rows, TILE), "candidates")
    queries = materialize(tiles(rows.filter(F.col("id") % every == 0).dropDuplicates(["id"]), QUERY_TILE), "queries")
    # Of about as many blocks as shuffle partitions, block rows for queries and columns for candidates by the sizes of both.
    of_q, of_c = (max(1, df.agg(F.sum("n")).first()[0] or 0) for df in (queries, candidates))
    groups = max(1, shuffle_partitions(spark))
    down = max(1, min(groups, round(math.sqrt(groups * of_q / of_c))))
    across = max(1, groups // down)
    place = lambda n, name: F.pmod(F.xxhash64("ids"), F.lit(n)).alias(name)
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    parts = ("ids", "vectors", "codes", "steps", "sums")
    left = candidates.select(place(across, "x"), each(down, "y"), *(F.col(c).alias(f"c_{c}") for c in parts))
    right = queries.select(each(across, "x"), place(down, "y"), *(F.col(c).alias(f"q_{c}") for c in parts))
    pairs = left.join(right.hint("merge"), ["x", "y"]).select(*(f"{side}_{c}" for side in "qc" for c in parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                read = [np.frombuffer(b.column(i)[at].as_buffer(), t) for i, t in enumerate((np.int64, kind, np.int8, np.float64, np.float64) * 2)]
                (qid, qv, *of_q), (cid, cv, *of_c) = read[:5], read[5:]
                for n, side in ((len(qid), of_q), (len(cid), of_c)):
                    side[0] = side[0].reshape(n, -1)
                found = nearest_in_tile(qid, qv.reshape(len(qid), -1), cid, cv.reshape(len(cid), -1), k, of_q, of_c)
                columns = list(zip(*found, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())], names=["query_id", "score", "id"])

    found = pairs.mapInArrow(run, "query_id long, score double, id long")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by query: keep a heap of k for the query at hand."""
        heap, at = [], None

        def out() -> pa.RecordBatch:
            best = sorted(heap, reverse=True)
            return pa.RecordBatch.from_arrays([pa.array([at] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([-y for _, y in best], pa.int64()), pa.array([s for s, _ in best], pa.float64())], names=["query_id", "rank", "id", "score"])

        for b in batches:
            for x, s, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if x != at:
                    if heap:
                        yield out()
                    heap, at = [], x
                if len(heap) < k:
                    heapq.heappush(heap, (s, -y))
                else:
                    heapq.heappushpop(heap, (s, -y))
        if heap:
            yield out()

    kept = found.repartition(shuffle_partitions(spark), "query_id").sortWithinPartitions("query_id")
    return kept.mapInArrow(merge, "query_id long, rank int, id long, score double")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "embeddings"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_sql() -> str:
    return """
        WITH rows AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        fine AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM rows WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v) / (q.norm * c.norm) AS score FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """
