"""MD5 of many texts that start alike, as arrays: their first 64 bits, which order them but for ties."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Texts that are worked on at a time.
TILE = 4096


def _block(state: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    a, b, c, d = state
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + SINES[i] + words[g]
        a, d, c, b = d, c, b, b + (f << TURNS[i] | f >> 32 - TURNS[i])
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def _messages(texts: pa.Array, start: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, padded messages) of the texts behind `start` free bytes, by how many blocks they take."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    sizes, out = np.diff(offsets), []
    blocks = (sizes + start + 8) // 64 + 1
    for n in np.unique(blocks):
        rows = np.flatnonzero(blocks == n)
        size = sizes[rows]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        message = np.zeros((len(rows), 64 * n), np.uint8)
        message[np.repeat(np.arange(len(rows)), size), start + place] = data[np.repeat(offsets[rows], size) + place]
        message[np.arange(len(rows)), start + size] = 0x80
        message[:, -8:] = (8 * (size + start)).astype("<u8").view(np.uint8).reshape(-1, 8)
        out.append((rows, message))
    return out


def md5_heads(prefixes: list[bytes], texts: pa.Array) -> np.ndarray:
    """The first eight bytes of the MD5 of each prefix and text (strings, no nulls) as numbers, a row a prefix."""
    out = np.empty((len(prefixes), len(texts)), np.uint64)
    for at in range(0, len(texts), TILE):
        part = texts.slice(at, TILE)
        padded = {start: _messages(part, start) for start in {len(p) for p in prefixes}}
        for i, prefix in enumerate(prefixes):
            for rows, message in padded[len(prefix)]:
                message[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
                words = np.ascontiguousarray(message.view("<u4").T)
                state = [np.full(len(rows), x) for x in START]
                for k in range(0, len(words), 16):
                    state = _block(state, words[k : k + 16])
                out[i, at + rows] = state[0].byteswap().astype(np.uint64) << np.uint64(32) | state[1].byteswap()
    return out
