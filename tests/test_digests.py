"""MD5 of many texts at once against the library, one by one."""

import hashlib

import pyarrow as pa

from stratia.functions import digests


def test_heads_of_texts_of_all_lengths():
    texts = ["", "é" * 30, *("x" * n for n in range(45, 70)), *(f"order:{i}" for i in range(5000)), "y" * 200]
    prefixes = [b"7:a:3:", b"7:b:13:", b""]
    got = digests.md5_heads(prefixes, pa.array(texts).slice(1))
    want = [[int.from_bytes(hashlib.md5(p + t.encode()).digest()[:8], "big") for t in texts[1:]] for p in prefixes]
    assert got.tolist() == want and digests.md5_heads(prefixes, pa.array([], pa.string())).shape == (3, 0)
