"""FLAC media columns: mono streams of up to 16 bits, encoded and decoded in bulk.

Encoding: of each block the cheapest of constant, verbatim, fixed predictors of order 0 to 2 and linear prediction of
order LPC, with Rice residuals and a seek point for each block. Decoding: constant, verbatim, fixed (0 to 4) and linear
predictors, Rice partitions with escapes, CRC-8 of headers, CRC-16 of frames, MD5 of the samples. A task works on the
frames of many streams in step: sample i of all frames at once, so that the serial nature of Rice codes and of linear
prediction costs a few array operations per sample position.

Decoded samples are PCM blocks: (first_sample, n_samples, pcm), where first_sample is the offset by which a range of
samples is found.

Defined cases: a null payload is an empty payload; a stream without samples decodes to no blocks; a damaged
stream (checksum, marker or length) raises ValueError naming the fault; stereo and more than 16 bits raise too. Payloads
of any length are cut into blocks of at most BLOCK samples; repeated rows give equal streams; an empty table gives an
empty result; an added column whose name the input has raises.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratia.llm.common import fresh, slices, table
from stratia.session import materialize

BLOCK, RATE, SLICE = 4096, 8000, 1 << 20
#: Order, bits and shift of linear prediction: coefficients are multiples of 2**-SHIFT.
LPC, PRECISION, SHIFT = 4, 8, 5
#: Binomial signs of the fixed predictors' differences.
DIFFERENCES = [[1], [1, -1], [1, -2, 1], [1, -3, 3, -1], [1, -4, 6, -4, 1]]


def _crc8_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x << 1 ^ 0x07 if x & 0x80 else x << 1) & 0xFF
        out.append(x)
    return out


CRC8 = _crc8_table()


def crc8(data: bytes) -> int:
    x = 0
    for b in data:
        x = CRC8[x ^ b]
    return x


class _Crc16:
    """CRC-16 (0x8005) of many byte ranges: the XOR of a table entry for each byte and its distance to the end."""

    def __init__(self):
        x = np.arange(256, dtype=np.uint32) << 8
        for _ in range(8):
            x = np.where(x & 0x8000, x << 1 ^ 0x8005, x << 1) & 0xFFFF
        self.one, self.table = x.astype(np.uint16), x.astype(np.uint16)[None]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        while len(self.table) < size.max(initial=1):
            rows = [self.table[-1]]
            for _ in range(max(256, min(len(self.table), 8192))):
                rows.append((rows[-1] << 8) ^ self.one[rows[-1] >> 8])
            self.table = np.concatenate([self.table, rows[1:]])
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.arange(size.sum()) - np.repeat(first - starts, size)
        far = np.repeat(ends, size) - 1 - at
        return np.bitwise_xor.reduceat(self.table[far, data[at]], first)


CRC16 = _Crc16()


def _number(n: int) -> bytes:
    """The frame number in the extended UTF-8 form of frame headers."""
    if n < 0x80:
        return bytes([n])
    out = []
    limit = 0x40
    while True:
        out.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
        if n < limit:
            return bytes([0x100 - 2 * limit | n, *reversed(out)])


def _read_number(data, at: int) -> tuple[int, int]:
    b = data[at]
    if b < 0x80:
        return b, at + 1
    extra = 7 - (0xFF ^ b).bit_length()
    n = b & (0x3F >> extra)
    for k in range(1, extra + 1):
        n = n << 6 | data[at + k] & 0x3F
    return n, at + 1 + extra


def _segments(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the segments starts in one row of samples, and of each sample its segment."""
    return np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64), np.repeat(np.arange(len(length)), length)


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """One FLAC stream for each payload, whose bytes are signed 8-bit mono samples."""
    length = np.array([min(block, len(p) - at) for p in payloads for at in range(0, len(p), block)], np.int64)
    frames = [-(-len(p) // block) for p in payloads]
    if not len(length):
        return [_stream(p, [], [], block) for p in payloads]
    x = np.frombuffer(b"".join(payloads), np.int8).astype(np.int32)
    start, owner = _segments(length)
    inside = np.arange(len(x)) - start[owner]
    best = order = residual = None
    linear, weights = np.zeros(len(length), bool), _predictors(x, start, owner, inside, length)
    for o in (0, 1, 2, LPC):
        r = np.zeros_like(x)
        for i, c in enumerate(DIFFERENCES[o] if o < LPC else [1]):
            r[o:] += c * x[o - i : len(x) - i]
        if o == LPC:
            said = np.zeros_like(x)
            for i in range(LPC):
                said[o:] += weights[owner[o:], i] * x[o - 1 - i : len(x) - 1 - i]
            r -= said >> SHIFT
        r[inside < o] = 0
        # About the bits of a Rice code with the best parameter, and what the predictor itself takes.
        mean = np.add.reduceat(np.abs(r), start) / length
        cost = length * np.log2(mean + 0.5) + 8 * o + (9 + PRECISION * LPC) * (o == LPC)
        if o == 0:
            best, order, residual = cost, np.zeros(len(length), np.int64), r
        else:
            better = (cost < best) & (length > o)
            best, order = np.where(better, cost, best), np.where(better, o, order)
            residual = np.where(better[owner], r, residual)
            linear = better if o == LPC else linear
    coded = inside >= order[owner]
    z = (residual << 1) ^ (residual >> 31)
    mean = np.add.reduceat(np.where(coded, z, 0), start) / np.maximum(length - order, 1)
    k = np.clip(np.ceil(np.log2(np.maximum(mean * 0.6931, 1e-9))), 0, 14).astype(np.int64)
    bits_of = np.where(coded, (z >> k[owner]) + 1 + k[owner], 0)
    said = (9 + PRECISION * LPC) * linear  # precision, shift and coefficients
    rice = 8 + 8 * order + said + 10 + np.add.reduceat(bits_of, start)
    constant = np.maximum.reduceat(x, start) == np.minimum.reduceat(x, start)
    verbatim = ~constant & (rice >= 8 + 8 * length)
    size = np.where(constant, 16, np.where(verbatim, 8 + 8 * length, rice))
    size = -(-size // 8)
    number = np.concatenate([np.arange(n) for n in frames]).tolist()
    heads = [_header(n, m) for n, m in zip(number, length.tolist(), strict=True)]
    head = np.array([len(h) for h in heads])
    whole = head + size + 2
    begin = np.concatenate([[0], np.cumsum(whole)[:-1]])
    bits = np.zeros(8 * int(whole.sum()), np.uint8)
    body = 8 * (begin + head)
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(linear, 31 + order, 8 + order)))
    for j in range(6):  # after a zero bit; the wasted-bits flag stays zero
        bits[body + 1 + j] = kind >> (5 - j) & 1
    raw = np.where(constant[owner], inside == 0, verbatim[owner] | (inside < order[owner]))
    at = body[owner[raw]] + 8 + 8 * inside[raw]
    for j in range(8):
        bits[at + j] = x[raw] >> (7 - j) & 1
    use = ~(constant | verbatim)
    after = body + 8 + 8 * order
    told = use & linear
    for at, width, value in [(0, 4, PRECISION - 1), (4, 5, SHIFT), *((9 + PRECISION * i, PRECISION, weights[told, i]) for i in range(LPC))]:
        for j in range(width):
            bits[after[told] + at + j] = value >> (width - 1 - j) & 1
    after = after + said
    for j in range(4):  # two bits of method and four of partition order are zero, then the parameter
        bits[(after + 6 + j)[use]] = (k >> (3 - j) & 1)[use]
    pick = coded & use[owner]
    before = np.cumsum(bits_of) - bits_of
    zp, kp = z[pick], k[owner[pick]]
    one = (after + 10)[owner[pick]] + before[pick] - before[start][owner[pick]] + (zp >> kp)
    bits[one] = 1
    for j in range(int(kp.max(initial=0))):
        wide = kp > j
        bits[one[wide] + kp[wide] - j] = zp[wide] >> j & 1
    data = np.packbits(bits)
    for b, h in zip(begin.tolist(), heads, strict=True):
        data[b : b + len(h)] = np.frombuffer(h, np.uint8)
    end = begin + whole
    check = CRC16(data, begin, end - 2)
    data[end - 2], data[end - 1] = check >> 8, check & 0xFF
    out, f = [], 0
    for p, n in zip(payloads, frames, strict=True):
        out.append(_stream(p, whole[f : f + n].tolist(), length[f : f + n].tolist(), block) + data[begin[f] : end[f + n - 1]].tobytes() if n else _stream(p, [], [], block))
        f += n
    return out


def _predictors(x: np.ndarray, start: np.ndarray, owner: np.ndarray, inside: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of each frame the coefficients of linear prediction, as whole numbers of PRECISION bits, most recent sample first."""
    lags = []
    for j in range(LPC + 1):
        product = np.zeros(len(x))
        product[j:] = x[j:].astype(np.float64) * x[: len(x) - j]
        product[inside < j] = 0
        lags.append(np.add.reduceat(product, start))
    # Levinson's recursion, for all frames at once.
    error, a = np.maximum(lags[0], 1e-9) * (1 + 1e-9), np.zeros((LPC, len(length)))
    for i in range(LPC):
        reflect = (lags[i + 1] - sum(a[j] * lags[i - j] for j in range(i))) / error
        a[:i] = a[:i] - reflect * a[:i][::-1]
        a[i] = reflect
        error = np.maximum(error * (1 - reflect * reflect), 1e-9)
    return np.clip(np.rint(a.T * (1 << SHIFT)), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int32)


def _header(number: int, samples: int) -> bytes:
    out = bytes([0xFF, 0xF8, 0x74, 0x02]) + _number(number) + struct.pack(">H", samples - 1)
    return out + bytes([crc8(out)])


def _stream(payload: bytes, sizes: list[int], lengths: list[int], block: int) -> bytes:
    """Marker, stream information and seek points."""
    packed = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = struct.pack(">HH", block, block) + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(payload).digest()
    points, at, first = [], 0, 0
    for size, n in zip(sizes, lengths, strict=True):
        points.append(struct.pack(">QQH", first, at, n))
        at, first = at + size, first + n
    seek = b"".join(points)
    return b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek


class _Stream:
    """Metadata of one stream inside a joined buffer."""

    def __init__(self, data: bytes, base: int):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, []
        while not last:
            last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + n]
            if len(body) < n:
                raise ValueError("metadata is cut off")
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.block, self.total, self.md5 = int.from_bytes(body[:2], "big"), packed & (1 << 36) - 1, body[18:34]
                self.bits = (packed >> 36 & 31) + 1
                if packed >> 41 & 7 or self.bits > 16:
                    raise ValueError("only mono streams of up to 16 bits are read")
            elif kind == 3:
                self.points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
            at += 4 + n
        self.first, self.end = base + at, base + len(data)


def decode(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """Of each stream its PCM blocks, in order: (first sample, samples)."""
    found, base = [], 0
    for s in streams:
        found.append(_Stream(s, base))
        base += len(s)
    data = np.frombuffer(b"".join(streams) + bytes(8), np.uint8)
    out: list[dict[int, np.ndarray]] = [{} for _ in streams]
    # Frames that seek points name are read together; what no point names follows, one frame a stream and round.
    jobs = [(i, s.first + p[1]) for i, s in enumerate(found) for p in (s.points or [(0, 0, 0)]) if s.total]
    while jobs:
        ends = _frames(data, [at for _, at in jobs], [found[i] for i, _ in jobs])
        reached = {(i, at) for i, at in jobs}
        more = []
        for (i, _), (first, samples, end) in zip(jobs, ends, strict=True):
            out[i][first] = samples
            if end < found[i].end and (i, end) not in reached:
                more.append((i, end))
        jobs = more
    result = []
    for s, blocks in zip(found, out, strict=True):
        rows, at = [], 0
        for first in sorted(blocks):
            if first != at:
                raise ValueError("samples are missing between blocks")
            rows.append((first, blocks[first]))
            at += len(blocks[first])
        if at != s.total:
            raise ValueError("the stream has not as many samples as it says")
        wide = np.int8 if s.bits <= 8 else np.dtype("<i2")
        if any(s.md5) and hashlib.md5(b"".join(b.astype(wide).tobytes() for _, b in rows)).digest() != s.md5:
            raise ValueError("the samples' MD5 differs")
        result.append(rows)
    return result


def _frame_header(data, at: int, s: _Stream) -> tuple[int, int, int]:
    """First sample, number of samples, and where the subframe starts."""
    d = data[at : at + 32].tolist()
    if d[0] != 0xFF or d[1] & 0xFE != 0xF8:
        raise ValueError("a frame does not start with its marker")
    number, p = _read_number(d, 4)
    code, rate = d[2] >> 4, d[2] & 15
    if d[3] >> 4:
        raise ValueError("only mono streams of up to 16 bits are read")
    if code == 6:
        n, p = d[p] + 1, p + 1
    elif code == 7:
        n, p = (d[p] << 8 | d[p + 1]) + 1, p + 2
    else:
        n = 192 if code == 1 else 576 << code - 2 if 2 <= code <= 5 else 256 << code - 8
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(bytes(d[:p])) != d[p]:
        raise ValueError("a frame header's CRC-8 differs")
    return number if d[1] & 1 else number * s.block, n, at + p + 1


def _frames(data: np.ndarray, starts: list[int], streams: list[_Stream]) -> list[tuple[int, np.ndarray, int]]:
    """Decode frames that start at the given bytes: (first sample, samples, the byte after the frame)."""
    heads = [_frame_header(data, at, s) for at, s in zip(starts, streams, strict=True)]
    length = np.array([h[1] for h in heads])
    rank_by = np.argsort(-length, kind="stable")  # the frames that are in work at sample i are a prefix
    starts_a, body = np.array(starts)[rank_by], np.array([h[2] for h in heads])[rank_by]
    length, depth = length[rank_by], np.array([s.bits for s in streams])[rank_by]
    low, high = int(starts_a.min()), int(max(s.end for s in streams)) + 8
    data, shift = data[low:high], low
    body = body - shift
    wide = data.astype(np.int64)
    window = (wide[:-4] << 32) | (wide[1:-3] << 24) | (wide[2:-2] << 16) | (wide[3:-1] << 8) | wide[4:]  # 40 bits from each byte

    def take(pos: np.ndarray, bits) -> np.ndarray:
        """Unsigned numbers of up to 32 bits at bit positions."""
        return window[pos >> 3] >> (40 - (pos & 7) - bits) & ((1 << np.asarray(bits, np.int64)) - 1)

    def signed(pos: np.ndarray, bits) -> np.ndarray:
        n = take(pos, bits)
        return n - ((n >> (np.asarray(bits, np.int64) - 1) & 1) << np.asarray(bits, np.int64))

    kind = take(8 * body + 1, 6)
    if (data[body] & 1).any():
        raise ValueError("wasted bits are not read")
    lpc = kind >= 32
    order = np.where(lpc, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    rice = lpc | (kind >= 8)
    base, owner = _segments(length)
    inside = np.arange(len(owner)) - base[owner]
    value = np.zeros(len(owner), np.int64)
    pos = 8 * body + 8
    # Whole samples: constants, verbatim blocks and warm-up samples.
    one = kind == 0
    raw = np.where(one[owner], inside == 0, (kind == 1)[owner] | (inside < order[owner]))
    value[raw] = signed((pos + 0)[owner[raw]] + depth[owner[raw]] * inside[raw], depth[owner[raw]])
    if one.any():
        fill = one[owner]
        value[fill] = value[base[owner[fill]]]
    end = pos + np.where(one, 1, np.where(kind == 1, length, order)) * depth
    coefficients: dict[int, tuple[np.ndarray, int]] = {}
    for f in np.flatnonzero(lpc).tolist():
        precision, move = int(take(end[f : f + 1], 4)[0]) + 1, int(signed(end[f : f + 1] + 4, 5)[0])
        coefficients[f] = signed(end[f] + 9 + precision * np.arange(order[f]), precision), move
        end[f] += 9 + precision * order[f]
    if rice.any():
        _residuals(data, take, signed, value, end, rice, order, length, base)
    # Undo the fixed predictors: sums of sums of the differences.
    for o in range(1, 5):
        mine = (~lpc & (order == o))[owner]
        if not mine.any():
            continue
        v, m = value[mine], owner[mine]
        s0, n0 = _segments(length[~lpc & (order == o)])
        warm = [v[s0 + j].copy() for j in range(o)]
        for j in reversed(range(o)):
            for i in range(j):
                v[s0 + i] = 0
            v[s0 + j] = sum(c * warm[j - i] for i, c in enumerate(DIFFERENCES[j]))
            total = np.cumsum(v)
            v = total - (total[s0] - v[s0])[n0]
        for j in range(o):
            v[s0 + j] = warm[j]
        value[mine] = v
        del m
    _predict(value, base, length, order, coefficients)
    stop = -(-end // 8)
    got = CRC16(data, starts_a - shift, stop)
    if (got != (data[stop].astype(np.uint16) << 8 | data[stop + 1])).any():
        raise ValueError("a frame's CRC-16 differs")
    out: list = [None] * len(starts)
    for r, f in enumerate(rank_by.tolist()):
        out[f] = (heads[f][0], value[base[r] : base[r] + length[r]], int(stop[r]) + 2 + shift)
    return out


def _predict(value: np.ndarray, base: np.ndarray, length: np.ndarray, order: np.ndarray, coefficients: dict[int, tuple[np.ndarray, int]]) -> None:
    """Add what linear prediction says to the residuals, for all frames in step; they come sorted, longest first."""
    if not coefficients:
        return
    frames = np.array(sorted(coefficients))
    most = int(order[frames].max())
    weights, shift = np.zeros((most, len(frames)), np.int64), np.array([coefficients[f][1] for f in frames.tolist()])
    for row, f in enumerate(frames.tolist()):
        weights[: order[f], row] = coefficients[f][0]
    n, first, o = length[frames], base[frames], order[frames]
    if (shift < 0).any():
        raise ValueError("a negative shift of linear prediction")
    live_at = np.searchsorted(-n, -np.arange(int(n.max())), side="left")
    known = np.zeros((most, len(frames)), np.int64)  # the samples before this one, the latest first
    for i in range(int(n.max())):
        live = int(live_at[i])
        at = first[:live] + i
        said = (weights[:, :live] * known[:, :live]).sum(axis=0) >> shift[:live]
        now = value[at] + (said if i >= most else np.where(i >= o[:live], said, 0))
        value[at] = now
        known[1:, :live] = known[:-1, :live]
        known[0, :live] = now


def _residuals(data, take, signed, value, end, rice, order, length, base) -> None:
    """Read the Rice codes of all frames in step into value; end moves behind them."""
    frames = np.flatnonzero(rice)
    pos = end[frames].astype(np.int64)
    method, parts = take(pos, 2), take(pos + 2, 4)
    if (method > 1).any():
        raise ValueError("an unknown coding of residuals")
    width, n, o = 4 + method, length[frames], order[frames]
    bits = np.unpackbits(data)
    ones = np.flatnonzero(bits)
    rank = np.cumsum(bits, dtype=np.int32) - bits  # how many ones stand before a bit
    ones = np.append(ones, len(bits))
    each = n >> parts  # samples of a partition, the first one less by the order
    k, raw = np.zeros(len(frames), np.int64), np.zeros(len(frames), bool)
    pos = pos + 6
    ends, ks = np.zeros(len(value), np.int64), np.zeros(len(value), np.int8)
    begins = np.zeros(len(value), np.int64)
    where = base[frames]
    live_at = np.searchsorted(-n, -np.arange(int(n.max(initial=0))), side="left")  # n falls: how many are longer than i
    least = int(o.min(initial=0))
    simple = bool((parts == 0).all())
    starts_from = int(o.max(initial=0))
    for i in range(least, int(n.max(initial=0))):
        live = int(live_at[i])
        if not simple or i <= starts_from:
            fresh = (i == o[:live]) | ((i % each[:live] == 0) & (i > o[:live]))
            f = np.flatnonzero(fresh)
            if len(f):
                k[f] = take(pos[f], width[f])
                raw[f] = k[f] == (1 << width[f]) - 1
                pos[f] += width[f]
                esc = f[raw[f]]
                k[esc] = take(pos[esc], 5)
                pos[esc] += 5
        idx = where[:live] + i
        if raw.any() or i < starts_from:
            for f in np.flatnonzero(raw[:live] & (i >= o[:live])).tolist():
                if k[f]:
                    r = int(signed(pos[f : f + 1], k[f])[0])
                    value[idx[f]] = r
                pos[f] += k[f]
                ks[idx[f]] = -1
            go = np.flatnonzero(~raw[:live] & (i >= o[:live]))
            e = ones[rank[pos[go]]]
            begins[idx[go]], ends[idx[go]], ks[idx[go]] = pos[go], e, k[go]
            pos[go] = e + 1 + k[go]
        else:
            p = pos[:live]
            e = ones[rank[p]]
            begins[idx], ends[idx], ks[idx] = p, e, k[:live]
            pos[:live] = e + 1 + k[:live]
    coded = np.flatnonzero(ends > 0)
    kc = ks[coded].astype(np.int64)
    z = (ends[coded] - begins[coded]) << kc | take(ends[coded] + 1, kc)
    value[coded] = (z >> 1) ^ -(z & 1)
    end[frames] = pos


def _no_clash(df: DataFrame, keep: list[str], added: list[str]) -> None:
    clash = {c.lower() for c in keep} & {c.lower() for c in added}
    if clash:
        raise ValueError(f"the input has a column named {min(clash)}")


def encode_column(df: DataFrame, payload: str, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with a FLAC stream of each payload's bytes in place of the payload."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != payload]
    _no_clash(df, keep, [media])
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, payload, SLICE):
            streams = encode([p or b"" for p in b.column(b.schema.get_field_index(payload)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(streams, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


BLOCKS = T.ArrayType(T.StructType([T.StructField("first_sample", T.LongType()), T.StructField("n_samples", T.IntegerType()), T.StructField("pcm", T.BinaryType())]), False)
_BLOCKS = pa.list_(pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())]))


def decode_column(df: DataFrame, media: str = "media", blocks: str = "blocks", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with each stream's PCM blocks, sizes and digest of the stream; null for a null stream.

    pcm holds 8-bit samples, or 16-bit little-endian ones.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != media]
    names = [blocks, "media_bytes", "media_sha256"]
    _no_clash(df, keep, names)
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t in zip(names, (BLOCKS, T.LongType(), T.StringType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, media, SLICE):
            streams = b.column(b.schema.get_field_index(media)).to_pylist()
            found = iter(decode([m for m in streams if m is not None]))
            rows = [None if m is None else [(first, len(x), x.astype(np.int8 if _Stream(m, 0).bits <= 8 else "<i2").tobytes()) for first, x in next(found)] for m in streams]
            added = [pa.array(rows, _BLOCKS), pa.array([m if m is None else len(m) for m in streams], pa.int64()), pa.array([m if m is None else hashlib.sha256(m).hexdigest() for m in streams], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *added], names=schema.names)

    return df.mapInArrow(run, schema)


def pcm_blocks(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row for each PCM block: key, block, first_sample, n_samples, pcm.

    A range of samples is the blocks whose [first_sample, first_sample + n_samples) meet it.
    """
    found = decode_column(df.select(key, media), media, fresh(df, "blocks_")[0], [key])
    return found.select(key, F.posexplode(found.columns[1]).alias("block", "b")).select(key, "block", "b.first_sample", "b.n_samples", "b.pcm")


def seek(blocks: list[dict], start: int, end: int) -> bytes:
    """The 8-bit samples [start, end) of a stream, from the blocks that meet the range."""
    out = []
    for b in blocks:
        first, n = b["first_sample"], b["n_samples"]
        if first < end and start < first + n:
            out.append(b["pcm"][max(start - first, 0) : end - first])
    return b"".join(out)


def features(samples: np.ndarray) -> str:
    """Sum, energy, sign changes and peak of the samples, as text."""
    s = samples.astype(np.int64)
    return f"sum={s.sum()};energy={(s * s).sum()};crossings={int(((s[1:] < 0) != (s[:-1] < 0)).sum())};peak={int(np.abs(s).max(initial=0))}"


def read_digests(df: DataFrame, blocks: str, keep: list[str]) -> DataFrame:
    """What PCM blocks of 8-bit samples hold: columns `keep`, size, digests and features; the tail is read by its offset."""
    added = (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("feature", T.StringType()))
    _no_clash(df, keep, [n for n, _ in added])
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t in added)])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for value in b.column(b.schema.get_field_index(blocks)):
                found = value.as_py() or []
                total = sum(x["n_samples"] for x in found)
                read = seek(found, 0, total)
                rows.append((total, hashlib.sha256(read).hexdigest(), zlib.crc32(seek(found, max(total - 64, 0), total)), features(np.frombuffer(read, np.int8))))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=schema.names)

    return df.mapInArrow(run, schema)


def padded(text: str = "text"):
    """A text's UTF-8 bytes, followed by zero bytes up to a positive multiple of 64; and how many bytes it has."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    fill = F.when(n == 0, 64).otherwise(F.pmod(-n, F.lit(64)))
    return F.concat(raw, F.repeat(F.decode(F.unhex(F.lit("00")), "UTF-8"), fill).cast("binary")), n.cast("long")


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload, n = padded("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", n.alias("n_bytes"), payload.alias("payload"))
    stored = materialize(encode_column(rows, "payload"), "flac", "zstd")
    return read_digests(decode_column(stored), "blocks", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
