"""Sets of numbers packed as bytes: a row holds what one key has of one range of numbers, however many those are.

A number is its chunk (number >> SHIFT) and its place inside it. Places of a row are kept in order as gaps of 7 bits a byte, so
that a row has at most 2^SHIFT bytes or so. Rows of a key are joined while a sorted part streams by; a task holds one batch and
one row. The columns `chunk` and `set` go with whatever key columns the caller has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHIFT = 22
PLACE = (1 << SHIFT) - 1
#: Numbers that are counted at a time.
HELD = 4_000_000

Batches = Iterator[pa.RecordBatch]


def pack(places: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of so many places each, which ascend inside a row; no row is empty."""
    gaps, first = np.diff(places, prepend=0), np.cumsum(counts) - counts
    gaps[first] = places[first]
    width = 1 + (gaps >= 1 << 7) + (gaps >= 1 << 14) + (gaps >= 1 << 21)
    at = np.cumsum(width) - width
    data = np.empty(int(width.sum()), np.uint8)
    for k in range(4):
        m = width > k
        data[at[m] + k] = (gaps[m] >> 7 * k & 127) | (width[m] > k + 1).astype(np.int64) << 7
    offsets = np.append(at[first], len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpack(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of all rows, one after another, and how many each row has."""
    if not len(sets):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    offsets = np.frombuffer(sets.buffers()[1], np.int32, len(sets) + 1, sets.offset * 4)
    data = np.frombuffer(sets.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1)
    width, gaps = ends - starts, (data[starts] & 127).astype(np.int64)
    for k in (1, 2, 3):
        m = np.flatnonzero(width >= k)
        gaps[m] |= (data[starts[m] + k] & 127).astype(np.int64) << 7 * k
    last = np.searchsorted(ends, offsets[1:] - offsets[0])
    counts = np.diff(last, prepend=0)
    sums = np.append(0, np.cumsum(gaps))
    return sums[1:] - np.repeat(sums[last - counts], counts), counts


def numbers(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of all that the rows of a batch hold."""
    places, counts = unpack(b["set"])
    row = np.repeat(np.arange(b.num_rows), counts)
    return row, b["chunk"].to_numpy().astype(np.int64)[row] << SHIFT | places


def without_own(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """numbers() but for a row's own number, in column i, or null where it has none."""
    row, number = numbers(b)
    other = pc.fill_null(b["i"], -1).to_numpy(zero_copy_only=False)[row] != number
    return row[other], number[other]


def starts(b: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    """The rows of a sorted batch that differ from the one before in a key."""
    changed = np.ones(b.num_rows, bool)
    changed[1:] = False
    for k in keys:
        changed[1:] |= pc.not_equal(b[k][1:], b[k][:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)


def merge(b: pa.RecordBatch, keys: tuple[str, ...]) -> tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A sorted batch with one row a key, and (row, place, times) of what stood in its rows more than once, times over."""
    first = starts(b, keys)
    places, counts = unpack(b["set"])
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, b.num_rows)))
    both = np.sort(np.repeat(group, counts) << SHIFT | places, kind="stable")  # rows are runs already
    at = np.flatnonzero(np.diff(both, prepend=-1))
    both, times = both[at], np.diff(np.append(at, len(both)))
    sets = pack(both & PLACE, np.bincount(both >> SHIFT, minlength=len(first)))
    more = times > 1
    columns = [sets if name == "set" else b[name].take(pa.array(first)) for name in b.schema.names]
    return pa.RecordBatch.from_arrays(columns, names=b.schema.names), (both[more] >> SHIFT, both[more] & PLACE, times[more] - 1)


def sweep(batches: Batches, run: tuple[str, ...], keys: tuple[str, ...] | None = None, seen: Callable | None = None) -> Batches:
    """Whole runs of a sorted part, with one row for each of `keys`, a longer key than that of the run or the same.

    seen(batch, doubles, done) is called at each merge, and what it gives is yielded in place of the runs; the first `done`
    rows of the batch are whole.
    """
    keys, held = keys or run, None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b.cast(held.schema)]).combine_chunks().to_batches()[0]
        one, doubles = merge(b, keys)
        at = int(starts(one, run)[-1])
        if seen:
            yield from seen(one, doubles, at)
        elif at:
            yield one.slice(0, at)
        held = one.slice(at)
    if held is not None:
        none = (np.empty(0, np.int64),) * 3
        yield from seen(held, none, held.num_rows) if seen else [held]


def repeated(batches: Batches) -> Batches:
    """(node, i, n): of rows of sets how often a number stands in more than one of a node; its own number counts each time."""

    def seen(one: pa.RecordBatch, doubles: tuple, done: int) -> Batches:
        row, place, n = doubles
        own, number = numbers(one.slice(0, done))
        same = pc.fill_null(one["i"], -1).to_numpy(zero_copy_only=False)[own] == number
        chunk = one["chunk"].to_numpy().astype(np.int64)
        rows, found = np.append(row, own[same]), np.append(chunk[row] << SHIFT | place, number[same])
        yield pa.RecordBatch.from_arrays([one["node"].take(pa.array(rows)), pa.array(found, pa.int64()), pa.array(np.append(n, np.ones(same.sum(), np.int64)), pa.int64())], names=["node", "i", "n"])

    yield from sweep(batches, ROW, seen=seen)


def again(batches: Batches) -> Batches:
    """(i, mask): of rows (node, mask, chunk, set), sorted by node and chunk, each number as often as its node has it beyond once.

    Nodes are numbers; a node's own number counts each time. Whole runs are looked at as they are, only the last one of a
    batch is joined and kept.
    """

    def out(b: pa.RecordBatch, row: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        chunk = b["chunk"].to_numpy().astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(chunk[row] << SHIFT | place, pa.int64()), b["mask"].take(pa.array(row))], names=["i", "mask"])

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        first = starts(b, ROW)
        places, counts = unpack(b["set"])
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, b.num_rows)))
        both = np.sort(np.repeat(group, counts) << SHIFT | places)
        node, chunk = b["node"].to_numpy()[first], b["chunk"].to_numpy()[first]
        own = (np.arange(len(first)) << SHIFT | node & PLACE)[node >> SHIFT == chunk]
        own = own[both[np.minimum(np.searchsorted(both, own), len(both) - 1)] == own]
        found = np.append(both[1:][both[1:] == both[:-1]], own)
        return out(b, first[found >> SHIFT], found & PLACE)

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b.cast(held.schema)]).combine_chunks().to_batches()[0]
        at = int(starts(b, ROW)[-1])
        if at:
            yield whole(b.slice(0, at))
        held, (row, place, n) = merge(b.slice(at), ROW)
        yield out(held, np.repeat(row, n), np.repeat(place, n))
    if held is not None:
        yield whole(held)


def lists(batches: Batches) -> Batches:
    """(node, chunk, set) of sorted rows (node, i) of numbers, which differ; a node may have several rows of a chunk."""
    for b in batches:
        if b.num_rows:
            node, i = b["node"].to_numpy(), b["i"].to_numpy()
            changed = np.append(True, (node[1:] != node[:-1]) | (i[1:] >> SHIFT != i[:-1] >> SHIFT))
            first = np.flatnonzero(changed)
            sets = pack(i & PLACE, np.diff(np.append(first, len(i))))
            yield pa.RecordBatch.from_arrays([pa.array(node[first]), pa.array(i[first] >> SHIFT, pa.int32()), sets], names=["node", "chunk", "set"])


def bits(masks: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each mask, lowest bit first."""
    return np.unpackbits(masks.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def sorted_parts(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by its first key, each part in the order of the keys."""
    return df.repartition(keys[0]).sortWithinPartitions(*keys)


def singles(df: DataFrame) -> DataFrame:
    """(node, i, chunk, set): of each (node, i) the set of its own number."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                i = b["i"].to_numpy()
                yield pa.RecordBatch.from_arrays([b["node"], b["i"], pa.array(i >> SHIFT, pa.int32()), pack(i & PLACE, np.ones(len(i), np.int64))], names=["node", "i", "chunk", "set"])

    return df.select("node", "i").mapInArrow(run, SETS)


SETS = "node string, i long, chunk int, set binary"
ROW = ("node", "chunk")


def onward(ends: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, i, chunk, set): the set of each edge's end for its source; ends: (src, at, dst), `at` the source's number."""
    return ends.join(sets.select("node", "chunk", "set"), F.col("dst") == F.col("node")).select(F.col("src").alias("node"), F.col("at").alias("i"), "chunk", "set")


def union(sets: DataFrame) -> DataFrame:
    """(node, i, chunk, set) with one row for a node and chunk."""
    return sorted_parts(sets.select("node", "i", "chunk", "set"), *ROW).mapInArrow(lambda batches: sweep(batches, ROW), SETS)


def fresh(step: DataFrame, seen: DataFrame) -> DataFrame:
    """What step has and seen has not, both (node, i, chunk, set); one row for a node and chunk."""

    def run(batches: Batches) -> Batches:
        for b in sweep(batches, ROW, (*ROW, "old")):
            places, counts = unpack(b["set"])
            first = starts(b, ROW)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, b.num_rows)))
            both, old = np.repeat(group, counts) << SHIFT | places, np.repeat(b["old"].to_numpy(zero_copy_only=False), counts)
            left = np.setdiff1d(both[~old], both[old], assume_unique=True)
            if len(left):
                groups, counts = np.unique(left >> SHIFT, return_counts=True)
                rows = pa.array(first[groups])
                yield pa.RecordBatch.from_arrays([*(b[c].take(rows) for c in ("node", "i", "chunk")), pack(left & PLACE, counts)], names=["node", "i", "chunk", "set"])

    flagged = lambda df, old: df.select("node", "i", "chunk", "set", F.lit(old).alias("old"))
    return sorted_parts(flagged(step, False).union(flagged(seen, True)), *ROW, "old").mapInArrow(run, SETS)


def sized(batches: Batches) -> Batches:
    """(node, n, low) of rows of sets: how many numbers but its own each has, and the smallest; none where there is no other."""
    for b in batches:
        row, number = without_own(b)
        rows, at, n = np.unique(row, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([b["node"].take(pa.array(rows)), pa.array(n, pa.int64()), pa.array(number[at], pa.int64())], names=["node", "n", "low"])


def counted(batches: Batches) -> Batches:
    """(i, n): in how many rows of sets a number stands, their own aside; a number comes up again after HELD others."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        number, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(n, pa.int64())], names=["i", "n"])

    for b in batches:
        held.append(without_own(b)[1])
        size += len(held[-1])
        if size > HELD:
            yield out()
            held, size = [], 0
    if size:
        yield out()
