"""Importance resampling against a plain version that counts each document by itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stratia.llm import importance

SCHEMA = "doc_id long, text string, lang string, rank long, score string"
RUN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return RUN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_features(text))
    for text in target:
        t.update(plain_features(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for i, text in docs:
        f = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    enough = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(enough[: 5 * len(enough) // 100])}
    return [(r[0], r[1], r[2], r[3], ranks.get(id(r))) for r in rows]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcXYé9漢") for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["w" * 70, "long" * 40]
    texts = [rng.choice([" ", ", ", "\n", "\x85"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 21, 60]))) for _ in range(400)]
    texts += ["same copy of a text " * 6] * 150 + [None, "", " .,; "] + ["a b " * 30_000]
    docs = list(enumerate(texts))
    docs += docs[20:25] + [(None, "without an id " * 9)]
    target = [t for t in texts[5:40] if t] + [None, ""]
    return docs, target, spark.createDataFrame([(i, t, "en", 7, "s") for i, t in docs], SCHEMA), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_equals_plain_version(tables):
    docs, target, df, to = tables
    got = [tuple(r) for r in importance.resample(df, to).collect()]
    assert sorted(got, key=key) == sorted(plain(docs, target), key=key)
    assert sum(r[4] is not None for r in got) >= 10


def test_reruns_and_layout_agree(tables):
    _, _, df, to = tables
    a, b = (sorted(map(tuple, importance.resample(x, to).collect()), key=key) for x in (df, df.repartition(7)))
    assert a == b


@pytest.mark.parametrize("length", [0, 1, 5, 63, 64, 65, 1000, 70_001])
def test_codes_of_runs_are_combined(length):
    rng = random.Random(length)
    a, b = rng.randbytes(13), rng.randbytes(length)
    got = importance.after(np.array([zlib.crc32(a)] * 2, np.uint32), np.array([length] * 2)) ^ np.uint32(zlib.crc32(b))
    assert got.tolist() == [zlib.crc32(a + b)] * 2


def test_pieces_and_blocks_do_not_cut_runs(monkeypatch):
    text = "alpha beta Gamma delta é " * 50
    want = Counter(plain_features(text))
    monkeypatch.setattr(importance, "AT_ONCE", 7)
    monkeypatch.setattr(importance, "word_runs", lambda t, letters: __import__("stratia.llm.common", fromlist=["x"]).word_runs(t, letters, 16))
    sizes, found = importance.features([text, "", text])
    by = [Counter(), Counter(), Counter()]
    for owner, bucket in found:
        for o, b in zip(owner.tolist(), bucket.tolist(), strict=True):
            by[o][b] += 1
    assert by == [want, Counter(), want] and sizes.tolist() == [250, 0, 250]


def test_empty_tables(spark, tables):
    _, _, df, to = tables
    assert importance.resample(df.limit(0), to).count() == 0
    got = importance.resample(df, to.limit(0)).collect()
    assert len(got) == df.count() and all(r.weight <= 0 for r in got if r.n_features == 0)


def test_query_equals_plain_version_on_a_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert sorted(map(tuple, importance.op12_importance(spark, d).collect()), key=key) == sorted(plain(docs, target), key=key)
