"""SimHash near-duplicates: fingerprints, a grid over bit counts of segments, exact check, components.

A fingerprint has 32 segments of two bits. Its embedding is the vector of their bit counts; the Manhattan distance
of two such vectors is never above the Hamming distance of the fingerprints. The vector is kept in one long, each
count in unary (0: 00, 1: 10, 2: 11), so that the Manhattan distance is the number of differing bits.

The grid: the 32 coordinates form `BLOCKS` blocks. Vectors within distance `d` agree on at least BLOCKS - d blocks, so
each choice of that many blocks gives a grid cell, and any two that link share a cell. One shuffle brings the cells
together, sorted by the sum of all coordinates. Inside a cell that is a range join: two vectors within distance d have sums
that differ by at most d, so a fingerprint meets only those of that range, first by the lower bound, then by the exact
distance. A cell of more than CELL fingerprints gets a finer grid, over the sums of the two halves of the coordinates with
steps of d + 1: a fingerprint goes to its own cell and to those neighbours that it can reach within d, so that what links
meets in one of them. What is still over CELL there is dealt out as pairs of chunks of CHUNK, so that no task holds more;
inside a cell only edges that join two groups are kept, which loses no link between components.

Defined cases: a null text is an empty text; texts without words have fingerprint zero and link like any other;
a null id takes part, and a component's id is its smallest non-null one (null if there is none); repeated rows
each give a row; an empty table gives none. Fingerprints and components have columns of their own besides the key, which must
not be named fp, root or component; near_dedup keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratia.functions.components import connected_components
from stratia.llm.common import slices, table
from stratia.session import materialize, shuffle_partitions

SHINGLE, SEED, DISTANCE, BLOCKS = 4, 42, 4, 8
#: Fingerprints of a cell that one task compares, and of a chunk of a cell that stays larger.
CELL, CHUNK = 4096, 8192
#: Fingerprints in a part that is written between steps, and the fewest parts that a step may use.
PART, LEAST_PARTS = 10_000, 8
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16
EVEN = 0x5555555555555555
#: A column for a text's digest while rows are told apart.
DIGEST = "digest_of_text_"


def _spans(text: bytes, size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words with one space between, and where its shingles start and end in that."""
    words = text.lower().split()  # of bytes: lower() changes A-Z alone, split() parts at 0x20 and 0x09-0x0D
    joined, count = b" ".join(words), min(len(words), max(len(words) - size + 1, 1))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends])[:count]
    return joined, starts, ends[len(words) - count :] - 1


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    """Runs of `size` words, with repeats, of a text whose A-Z are lower-cased; all words, if there are fewer."""
    joined, starts, ends = _spans(text, size)
    return [joined[a:e] for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint: bit i is set if over half the shingles' XXH64 values have it."""
    import xxhash

    joined, starts, ends = _spans((text or "").encode(), SHINGLE)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), AT_ONCE):
        cut = slice(at, at + AT_ONCE)
        values = np.array([xxhash.xxh64_intdigest(joined[a:e], SEED) for a, e in zip(starts[cut].tolist(), ends[cut].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """(key, fp, more): the fingerprint of each row as a signed long, and other columns of it."""
    schema = T.StructType([df.schema[key], T.StructField("fp", T.LongType(), False), *(df.schema[c] for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            values = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64)), *b.columns[2:]], names=schema.names)

    return df.select(key, text, *more).mapInArrow(run, schema)


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 segments, each in unary in its two bits."""
    low, high = fp.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    return F.shiftleft(low.bitwiseOR(high), 1).bitwiseOR(low.bitwiseAND(high))


def cell_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Of each choice of blocks that must agree, the bits of the embedding, as signed longs."""
    edges = [64 * i // blocks // 2 * 2 for i in range(blocks + 1)]
    part = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _counts(fp: np.ndarray) -> np.ndarray:
    low, high = fp & np.uint64(EVEN), (fp >> np.uint64(1)) & np.uint64(EVEN)
    return ((low | high) << np.uint64(1)) | (low & high)


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Of each pair, whether it links: pairs above the distance in the embedding are out, the others are checked."""
    out = np.bitwise_count(_counts(a) ^ _counts(b)) <= distance
    out[out] = np.bitwise_count(a[out] ^ b[out]) <= distance
    return out


def forest(fp: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges that join what links within one cell, one fewer than members for each group.

    A fingerprint is compared with those not yet joined whose sum of coordinates is within the distance of its own.
    """
    sums = np.bitwise_count(fp).astype(np.int64)
    left = np.argsort(sums, kind="stable")
    of_left, frontier, edges = sums[left], [], []
    while frontier or len(left):
        if not frontier:
            frontier, left, of_left = [int(left[0])], left[1:], of_left[1:]
        at = frontier.pop()
        low, high = np.searchsorted(of_left, [sums[at] - distance, sums[at] + distance + 1])
        hit = _near(np.broadcast_to(fp[at], high - low), fp[left[low:high]], distance)
        if hit.any():
            found = left[low:high][hit].tolist()
            edges += [(at, x) for x in found]
            frontier += found
            keep = np.ones(len(left), bool)
            keep[low:high] = ~hit
            left, of_left = left[keep], of_left[keep]
    return edges


def _scan(split: bool, distance: int):
    """A scan over rows sorted by cell: (cell, a, b, hot). Hot rows hand back the members of cells over CELL."""
    names, small = ["cell", "a", "b", "hot"], 8

    def batch(cell, a, b, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), hot))], names=names)

    def links(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """cell, fp: whole cells, none of them over CELL if they are to be split."""
        cuts = np.flatnonzero(np.diff(cell)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(cell)]])
        size = ends - starts
        brief = np.repeat(size <= small, size)
        for d in range(1, small):
            i = np.flatnonzero((cell[:-d] == cell[d:]) & brief[:-d])
            i = i[_near(fp[i], fp[i + d], distance)] if len(i) else i
            if len(i):
                yield batch(cell[i], fp[i], fp[i + d], False)
        for s, e in zip(starts[size > small].tolist(), ends[size > small].tolist(), strict=True):
            pairs = np.array(forest(fp[s:e], distance), dtype=np.int64).reshape(-1, 2)
            if len(pairs):
                yield batch(np.full(len(pairs), cell[s]), fp[s + pairs[:, 0]], fp[s + pairs[:, 1]], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held_fp, hot = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for b in batches:
            cell = np.concatenate([held_cell, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held_fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if hot is not None:
                n = int(np.searchsorted(cell, hot, side="right")) if cell[0] == hot else 0
                if n:
                    yield batch(cell[:n], fp[:n], fp[:n], True)
                cell, fp = cell[n:], fp[n:]
                if not len(cell):
                    held_cell, held_fp = cell, fp
                    continue
                hot = None
            last = int(np.searchsorted(cell, cell[-1], side="left"))  # the last cell may go on in the next batch
            if last:
                yield from whole(cell[:last], fp[:last])
            held_cell, held_fp = cell[last:], fp[last:]
            if split and len(held_cell) > CELL:
                yield batch(held_cell, held_fp, held_fp, True)
                hot, held_cell, held_fp = held_cell[0], held_cell[:0], held_fp[:0]
        if len(held_cell):
            yield from whole(held_cell, held_fp)

    def whole(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if split:
            _, at, size = np.unique(cell, return_index=True, return_counts=True)
            for s, n in zip(at[size > CELL].tolist(), size[size > CELL].tolist(), strict=True):
                yield batch(cell[s : s + n], fp[s : s + n], fp[s : s + n], True)
            keep = np.repeat(size <= CELL, size)
            cell, fp = cell[keep], fp[keep]
        if len(cell) > 1:
            yield from links(cell, fp)

    return run


def finer(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(cell, fp) in a finer grid over the sums of both halves of the coordinates, each row in every cell it can reach.

    Of two rows that link, the cell of the larger step in either half holds both.
    """
    step = distance + 1
    sums = [F.bit_count(F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))), F.bit_count(F.shiftrightunsigned("fp", 32))]
    (a, b), (to_a, to_b) = ([F.floor(s / step) for s in sums], [step - s % step for s in sums])
    near = lambda i, j: F.when(i * to_a + j * to_b <= distance, F.struct((a + i).alias("i"), (b + j).alias("j")))
    reached = F.explode(F.filter(F.array(near(0, 0), near(1, 0), near(0, 1), near(1, 1)), lambda x: x.isNotNull()))
    return rows.select("cell", "fp", reached.alias("at")).select(F.xxhash64("cell", "at.i", "at.j").alias("cell"), "fp")


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) that give the components of all links."""
    spark = distinct.sparkSession
    n = shuffle_partitions(spark)
    masks = F.array(*(F.lit(m).cast("long") for m in cell_masks(blocks, distance)))
    cells = distinct.select("fp", embedding(F.col("fp")).alias("counts"), F.posexplode(masks).alias("choice", "mask"))
    cells = cells.select(F.xxhash64("choice", F.col("counts").bitwiseAND(F.col("mask"))).alias("cell"), "fp")
    schema = "cell long, a long, b long, hot boolean"

    def scan(rows: DataFrame, split: bool) -> DataFrame:
        return rows.repartition(n, "cell").sortWithinPartitions("cell", F.bit_count("fp")).mapInArrow(_scan(split, distance), schema)

    def hot(scanned: DataFrame) -> DataFrame:
        return scanned.filter("hot").select("cell", F.col("a").alias("fp"))

    first = materialize(scan(cells, True), "simhash-links")
    second = materialize(scan(finer(hot(first), distance), True), "simhash-links-finer")
    large = hot(second)
    chunks = large.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).alias("n"))
    dealt = large.join(chunks, "cell").withColumn("i", F.pmod(F.xxhash64("fp"), "n")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select(F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "fp")
    third = scan(dealt, False)
    found = first.union(second).filter("not hot").select("a", "b").union(third.select("a", "b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(key, fp, component): of each row its fingerprint and the smallest key that links reach."""
    return _grouped(df, key, text, distance).select(key, "fp", "component")


def _grouped(df: DataFrame, key: str, text: str, distance: int, *more: str) -> DataFrame:
    """(key, fp, more, root, component): components also by a fingerprint of theirs, as keys can be null or repeat."""
    marked = materialize(fingerprints(df, key, text, *more), "simhash")
    # Later tables have at most a row a document: they are written in parts that follow that number, not the setting for shuffles.
    width = max(LEAST_PARTS, -(-marked.count() // PART))
    first = materialize(marked.groupBy("fp").agg(F.min(key).alias("first")).coalesce(width), "simhash-distinct")
    roots = connected_components(links(first.select("fp"), distance), width=width)
    linked = roots.join(first, roots.node == first.fp)
    smallest = linked.groupBy("root").agg(F.min("first").alias("least"))
    of_linked = roots.join(smallest, "root").select(F.col("node").alias("fp"), "root", "least")
    # Written out, so that both sides of the last join are plain shuffles and Spark can split a fingerprint that many rows share.
    of_each = materialize(first.join(of_linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component")).coalesce(width), "simhash-components")
    return marked.join(of_each, "fp")


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay: of each component the one with the smallest (key, nulls last, fingerprint, digest).

    Rows are told apart by key and text, so that a key on unlike texts loses none of them, and copies without a key
    are copies. Of rows with one key and one text that with the smallest other columns stays.
    """
    marked = df.withColumn(DIGEST, F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("")))
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "fp", F.col(DIGEST).alias("digest"))
    best = _grouped(marked, key, text, DISTANCE, DIGEST).groupBy("root").agg(F.min(order).alias("b")).select("b.key", "b.digest")
    stay = marked.join(best, marked[key].eqNullSafe(best["key"]) & (marked[DIGEST] == best["digest"]), "left_semi")
    return stay.groupBy(key, DIGEST).agg(F.min(F.struct(*df.columns)).alias("row")).select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
