"""Centroid clustering of vectors in exact integers.

A component x becomes the integer floor(SCALE * x). Squared distances come from |x|^2 - 2 x.c + |c|^2, with the
products of a tile of vectors and all centroids as one float64 matrix product. Where dimension * (max|x| + max|c|)^2 is
below 2^53 every term and partial sum is an integer that a double holds, so the result is exact in any order of
summation; a row beyond that bound is done in int64 if the same bound is below 2^63, and in Python's integers if not.
Each round assigns every vector, and a treeAggregate over the tiles combines counts and sums, also exact; only
k x dimension sums reach the driver.

Plan: vectors are packed once into tiles of TILE rows, in the narrowest integers that hold them, without a shuffle,
and written to the shared folder, so that a round reads a compact table and a lost executor costs its tiles alone. A
round ships the k centroids to the tasks. Equal vectors, in any number, are rows of tiles like any other.

Defined cases: vectors that are null, of another length than `dimension`, or hold null or non-finite components take no
part and are not returned; a null id counts as the text '' in the hash of the start, and its rows keep a null id; rows
that share an id are vectors of their own, in the start ordered by their components; fewer rows than k give as many
centroids; ties go to the smaller number; empty centroids stay; a distance or a sum that no long holds is null; an
empty table gives an empty result. Other columns play no part, so that their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.llm.common import table
from stratia.session import materialize

CLUSTERS, ROUNDS, DIMENSION, SCALE, SEED = 8, 10, 64, 1024, 3
#: Vectors in a tile; bounds under which doubles and longs are exact.
TILE, EXACT, LONG = 4096, 1 << 53, 1 << 63
TILES = "ids array<long>, body binary, kind string, n int"


@dataclass
class Clusters:
    """Final centroids (rows of Python integers), and of each the number of its vectors and their summed distance."""

    centroids: list[list[int]]
    sizes: list[int]
    inertia: list[int]


def scaled(v: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) in int64, and which rows need larger integers (0 there); exact as scale is a power of two."""
    with np.errstate(over="ignore"):
        y = np.floor(v * float(scale))
    large = (np.abs(y) >= 2.0**62).any(axis=1)
    return np.where(large[:, None], 0, y).astype(np.int64), large


def large_integers(v: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The same in Python's integers."""

    def one(x: float) -> int:
        n, d = float(x).as_integer_ratio()
        return n * scale // d

    return np.array([[one(x) for x in row] for row in v.tolist()], object).reshape(v.shape)


def tiles(rows: DataFrame, most: int = TILE, scale: int = SCALE) -> DataFrame:
    """Pack (id, v) into tiles of up to `most` vectors; those beyond int64 in tiles of their own, as text."""

    def pack(ids: pa.Array, ints: np.ndarray) -> pa.RecordBatch:
        if ints.dtype == object:
            kind, body = "text", " ".join(map(str, ints.ravel())).encode()
        else:
            top = int(np.abs(ints).max(initial=0))
            kind = "i2" if top < 1 << 15 else "i4" if top < 1 << 31 else "i8"
            body = ints.astype(kind).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([body], pa.binary()), pa.array([kind]), pa.array([len(ids)], pa.int32())], names=["ids", "body", "kind", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0

        def out() -> pa.RecordBatch:
            done = pack(pa.concat_arrays(ids), np.concatenate(parts))
            ids.clear(), parts.clear()
            return done

        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                ints, large = scaled(v, scale)
                if large.any():
                    yield pack(part.column(0).filter(pa.array(large)), large_integers(v[large], scale))
                    part, ints = part.filter(pa.array(~large)), ints[~large]
                ids.append(part.column(0))
                parts.append(ints)
                held += len(ints)
                if held >= most:
                    yield out()
                    held = 0
        if held:
            yield out()

    return rows.mapInArrow(run, TILES)


def unpacked(body: bytes, kind: str, n: int) -> np.ndarray:
    flat = np.array([int(x) for x in bytes(body).split()], object) if kind == "text" else np.frombuffer(body, kind).astype(np.int64)
    return flat.reshape(n, -1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all centroids, as int64, or as Python's integers where some need them."""
    d = max(x.shape[1], 1)
    reach = int(np.abs(centroids).max(initial=0))
    top = np.abs(x).max(axis=1, initial=0)
    # The bound d * (top + reach)^2 < limit, as a bound on top.
    below = lambda limit: top < max(int(((limit - 1) // d) ** 0.5) - 1 - reach, 0)
    if below(EXACT).all():
        return _by_product(x.astype(np.float64), centroids.astype(np.float64)).astype(np.int64)
    fine, wide = below(EXACT), below(LONG)
    out = np.zeros((len(x), len(centroids)), np.int64 if wide.all() else object)
    if fine.any():
        out[fine] = _by_product(x[fine].astype(np.float64), centroids.astype(np.float64)).astype(np.int64)
    for rows, kind in ((wide & ~fine, np.int64), (~wide, object)):
        if rows.any():
            some = x[rows].astype(kind)
            for j, c in enumerate(centroids.astype(kind)):
                out[rows, j] = ((some - c) ** 2).sum(axis=1)
    return out


def _by_product(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact in doubles by the caller's bound."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller on ties, and the squared distance to it."""
    found = distances(x, centroids)
    best = found.argmin(axis=1)
    return best, found[np.arange(len(x)), best]


def total(x: np.ndarray) -> np.ndarray:
    """Column sums, in int64 where none can overflow, else in Python's integers."""
    safe = x.dtype != object and len(x) * int(np.abs(x).max(initial=0)) < LONG
    return x.sum(axis=0) if safe else x.astype(object).sum(axis=0)


def _centroids(rows: list[list[int]]) -> np.ndarray:
    held = np.array(rows, object)
    return held if np.abs(held).max(initial=0) >= 1 << 62 else held.astype(np.int64)


def aggregate(packed: DataFrame, rows: list[list[int]]) -> tuple[list[int], list[list[int]], list[int]]:
    """Of each centroid the number of its vectors, their componentwise sums, and their summed distances; all exact."""
    k, d = len(rows), len(rows[0])

    def add(held, row):
        counts, sums, inertia = held or ([0] * k, np.zeros((k, d), object), [0] * k)
        x = unpacked(row["body"], row["kind"], row["n"])
        best, distance = nearest(x, _centroids(rows))
        for j in np.unique(best).tolist():
            mine = best == j
            counts[j] += int(mine.sum())
            sums[j] += total(x[mine]).astype(object)
            inertia[j] += int(total(distance[mine]))
        return counts, sums, inertia

    def join(a, b):
        if a is None or b is None:
            return a or b
        return [x + y for x, y in zip(a[0], b[0], strict=True)], a[1] + b[1], [x + y for x, y in zip(a[2], b[2], strict=True)]

    counts, sums, inertia = packed.select("body", "kind", "n").rdd.treeAggregate(None, add, join) or ([0] * k, np.zeros((k, d), object), [0] * k)
    return counts, [[int(x) for x in row] for row in sums], inertia


def usable(df: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """(id, v): the rows that take part."""
    v = F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v"))
    return rows.filter((F.size("v") == dimension) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))


def start(rows: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = rows.orderBy(F.sha2(name, 256), "v").limit(k).collect()
    return [large_integers(np.array([r["v"]], np.float64), scale)[0].tolist() for r in first]


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, Clusters]:
    """(packed tiles, clusters) after so many rounds of assignment and update."""
    if scale & scale - 1:
        raise ValueError("scale is a power of two, so that products are exact")
    rows = usable(df, key, vector, dimension)
    packed = materialize(tiles(rows, TILE, scale), "centroid-tiles")
    held = start(rows, k, seed, scale)
    if not held:
        return packed, Clusters([], [], [])
    for _ in range(rounds):
        counts, sums, _ = aggregate(packed, held)
        held = [[s // n for s in row] if n else old for n, row, old in zip(counts, sums, held, strict=True)]
    sizes, _, inertia = aggregate(packed, held)
    return packed, Clusters(held, sizes, inertia)


def fits(n: int) -> int | None:
    return n if n < LONG else None


def assigned(packed: DataFrame, found: Clusters) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector."""
    rows = found.centroids
    names = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in rows], pa.string())
    each, whole = pa.array([fits(x) for x in found.inertia], pa.int64()), fits(sum(found.inertia))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                best, distance = nearest(unpacked(r["body"], r["kind"], r["n"]), _centroids(rows))
                at = pa.array(best)
                columns = [pa.array(r["ids"], pa.int64()), at.cast(pa.int32()), pa.array([fits(int(x)) for x in distance] if distance.dtype == object else distance, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, each.take(at), pa.array([whole] * r["n"], pa.int64()), names.take(at)], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return packed.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(*cluster(table(spark, sf_dir, "embeddings")))


def op13_sql() -> str:
    """Rounds written out: a<i> assigns all vectors to the centroids c<i>, which the sums of a<i - 1> have made."""
    d = ", ".join(f"CAST(floor(1024 * CAST(embedding[{i}] AS DOUBLE)) AS BIGINT)" for i in range(1, DIMENSION + 1))
    assign = """a{0} AS MATERIALIZED (
            SELECT row, arg_min(num, (dist, num)) AS num, min(dist) AS dist
            FROM (SELECT row, num, CAST(list_sum(list_transform(range(1, {1} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS dist FROM vectors, c{0})
            GROUP BY row)"""
    update = """s{0} AS (SELECT num, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM vectors JOIN a{0} USING (row), range(1, {1} + 1) r(i) GROUP BY num, i),
        c{2} AS MATERIALIZED (SELECT num, coalesce(m, c) AS c FROM c{0} LEFT JOIN (SELECT num, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{0} GROUP BY num) USING (num))"""
    steps = ",\n        ".join(x.format(i, DIMENSION, i + 1) for i in range(ROUNDS) for x in (assign, update))
    return f"""
        WITH vectors AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, [{d}] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS num, v AS c FROM (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM vectors ORDER BY h, v LIMIT {CLUSTERS})),
        {steps},
        {assign.format(ROUNDS, DIMENSION)}
        SELECT vec_id, CAST(num AS INTEGER) AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY num) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM vectors JOIN a{ROUNDS} USING (row) JOIN c{ROUNDS} USING (num)
    """
