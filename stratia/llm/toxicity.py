"""Toxicity by multiple-instance learning: sentence scores under noisy-or, learned from labels of documents.

A sentence's score is the logistic function of a bias and its words' weights; a document is toxic if any of its sentences is:
P = 1 - prod(1 - p_s). Labels of documents alone train it, by the gradient of that likelihood, and the sentence scores
then say where the offence is. A word's weight is the sum over hashed features of the word: the whole word, beginnings
of 3 to 5 characters and an ending of 3.

The fit uses a bounded sample: about FIT_ROWS labelled documents of about FIT_BYTES together at most, drawn by digests of their ids, in
one task. Nothing but weights (a fixed size) reaches the driver. Scoring reads every whole text once, without a
shuffle.

Defined cases: null and empty texts have no sentence and score 0; labels other than 0 and 1 and null labels don't
train, and of repeated labels of an id the largest counts; repeated rows score alike; without usable labels all
weights stay zero but the bias, and every text scores near 0.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratia.llm.common import fold, slices, table

FOLDS, HELD, THRESHOLD = 4, 2, 0.3
FIT_ROWS, FIT_BYTES, STEPS = 6144, 32 << 20, 100
#: Hashed features, features of a word, where the bias starts.
SIZE, PER_WORD, BIAS = 1 << 18, 5, -6.0
#: Size of a step, the pull towards zero, what holds rare features back, and the fewest occurrences of one.
RATE, PULL, RARE, LEAST = 0.3, 0.4, 10, 3
TOKENS = re.compile(r"\w+|[.!?。！？\n]")
ENDS = ".!?。！？\n"
REMEMBERED = 400_000


def word_features(word: str) -> list[int]:
    """The PER_WORD features of a lower-cased word."""
    parts = (f"={word}", f"3{word[:3]}", f"4{word[:4]}", f"5{word[:5]}", f"e{word[-3:]}")
    return [zlib.crc32(p.encode()) % SIZE for p in parts]


def tokens(text: str | None) -> list[str]:
    """Words and the marks that end sentences, in order, lower-cased; a word or mark right after itself counts once."""
    found = TOKENS.findall((text or "").lower())
    return [t for t, before in zip(found, chain([None], found), strict=False) if t != before]


def noisy_or(scores: np.ndarray, owner: np.ndarray, documents: int) -> np.ndarray:
    """P of each document from the log-odds of its sentences."""
    return -np.expm1(-np.bincount(owner, np.logaddexp(0, scores), minlength=documents))


class _Words(dict):
    """Weights of words, computed once a word; a mark has an infinite one."""

    def __init__(self, weights: np.ndarray):
        super().__init__((m, np.inf) for m in ENDS)
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
            self.update((m, np.inf) for m in ENDS)
        out = self[word] = float(self.weights[word_features(word)].sum())
        return out


def sentence_scores(values: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds of each sentence of one text, from its tokens' weights with an infinite one at each end."""
    ends = np.isinf(values)
    part = np.cumsum(ends) - ends  # the mark belongs to the sentence it ends
    words = ~ends
    if not words.any():
        return np.empty(0)
    index, part = np.unique(part[words], return_inverse=True)
    return bias + np.bincount(part, values[words], minlength=len(index))


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that climb the likelihood of the documents' labels, all documents at once in each step.

    A step divides each feature's slope by how often the feature occurs, plus a constant that keeps rare ones back, and
    pulls every weight towards zero by a fixed amount, so that few features stay. Features that fewer than LEAST
    pairs of a document and a word have take no part.
    """
    names: dict[str, int] = {}
    word_at, sentence_at, owner = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        open_sentence = False
        for t in tokens(text):
            if t in ENDS:
                open_sentence = False
                continue
            if not open_sentence:
                owner.append(d)
                open_sentence = True
            word_at.append(names.setdefault(t, len(names)))
            sentence_at.append(len(owner) - 1)
    w, b, n, docs = np.zeros(SIZE), BIAS, len(owner), max(len(texts), 1)
    if not n:
        return w.astype(np.float32), b
    word_at, sentence_at, owner = (np.frombuffer(x, np.int32) for x in (word_at, sentence_at, owner))
    features = np.array([word_features(t) for t in names]).reshape(-1, PER_WORD)
    seen = np.unique(owner[sentence_at].astype(np.int64) * len(names) + word_at) % len(names)
    often = sum(np.bincount(features[seen, j], minlength=SIZE) for j in range(PER_WORD))
    scale, use, y = often / docs + RARE / docs, often >= LEAST, labels.astype(np.float64)
    move, move_b = np.zeros(SIZE), 0.0
    for _ in range(steps):
        s = b + np.bincount(sentence_at, w[features].sum(axis=1)[word_at], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
        whole = np.clip(noisy_or(s, owner, len(y)), 1e-9, 1 - 1e-12)
        slope = np.where(y[owner] > 0, -((1 - whole) / whole)[owner], 1.0) * p / docs
        back = np.bincount(word_at, slope[sentence_at], minlength=len(names))
        move = 0.9 * move + np.bincount(features.ravel(), np.repeat(back, PER_WORD), minlength=SIZE) / scale
        move_b = 0.9 * move_b + 2 * slope.sum()
        w, b = w - RATE * move, b - RATE * move_b
        w = np.where(use, np.sign(w) * np.maximum(np.abs(w) - RATE * PULL / (scale * docs), 0), 0)
    return w.astype(np.float32), float(b)


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", use=None, rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias from the labelled documents whose key column meets `use` (all, if None).

    rows and FIT_BYTES bound the sample: each labelled id stays with a probability of at most rows over their number, which
    falls further by FIT_BYTES over the bytes of the texts that this draws. Texts of any length can be drawn.
    """
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    if use is not None:
        known = known.filter(use(F.col("id")))
    docs, total = df.select(F.col(key).alias("id"), F.col(text).alias("text")), known.count()
    number = F.conv(F.substring(F.md5(F.concat(F.lit("fit:"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    chance = min(1.0, rows / max(total, 1))
    size = docs.select("id", F.octet_length("text").alias("n")).join(F.broadcast(known.filter(number < chance)), "id").agg(F.sum("n").alias("n")).first()["n"] or 0
    known = known.filter(number < chance * min(1.0, FIT_BYTES / max(size, 1)))
    # The sample's ids are at most about `rows`, so they are broadcast; the texts stay where they are.
    sample = docs.join(F.broadcast(known), "id").groupBy("id").agg(F.min(F.struct("text", "toxic")).alias("row")).select(F.lit(0).alias("all"), "id", "row.text", "row.toxic")

    def climb(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        w, b = train(list(pdf["text"]), pdf["toxic"].to_numpy())
        return pd.DataFrame({"w": [w.tobytes()], "b": [b]})

    found = sample.groupBy("all").applyInPandas(climb, "w binary, b double").collect()  # one row of a fixed size
    if not found:
        return np.zeros(SIZE, np.float32), BIAS
    return np.frombuffer(found[0]["w"], np.float32), found[0]["b"]


def score(df: DataFrame, model: tuple[np.ndarray, float], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all of df, if None) and score, n_sentences, worst_sentence and worst_score of each row's text."""
    keep = keep if keep is not None else df.columns
    clash = {"score", "n_sentences", "worst_sentence", "worst_score"} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"the input has a column named {min(clash)}")
    shared = df.sparkSession.sparkContext.broadcast(model)
    added = (("score", T.DoubleType(), pa.float64()), ("n_sentences", T.IntegerType(), pa.int32()), ("worst_sentence", T.IntegerType(), pa.int32()), ("worst_score", T.DoubleType(), pa.float64()))
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t, _ in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        words = _Words(weights)
        for b in slices(batches, text):
            rows = []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                found = tokens(t)
                s = sentence_scores(np.fromiter(map(words.__getitem__, found), np.float64, len(found)), bias)
                if not len(s):
                    rows.append((0.0, 0, None, None))
                    continue
                worst = int(s.argmax())
                rows.append((float(-np.expm1(-np.logaddexp(0, s).sum())), len(s), worst, float(1 / (1 + np.exp(-np.clip(s[worst], -40, 40))))))
            columns = zip(*rows, strict=True) if rows else [[]] * len(added)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *(pa.array(c, k) for c, (_, _, k) in zip(columns, added, strict=True))], names=schema.names)

    return df.mapInArrow(run, schema) if set(keep) == set(df.columns) else df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def offending(df: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, sentence, start, end, score): the sentences that score at least the threshold, by character."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([df.schema[key], T.StructField("sentence", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        words = _Words(weights)
        for b in slices(batches, text):
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, start, at, total = 0, None, 0, bias
                for m in [*TOKENS.finditer(t or ""), None]:
                    if m is None or m[0] in ENDS:
                        if start is not None:
                            p = float(1 / (1 + np.exp(-np.clip(total, -40, 40))))
                            if p >= threshold:
                                rows.append((k, n, start, m.end() if m else at, p))
                            n += 1
                        start, total = None, bias
                        continue
                    start, at = m.start() if start is None else start, m.end()
                    total += sum(words[x] for x in tokens(m[0]))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, float]:
    """The model of the registered query and the pipeline: it learns from all folds but the held-out one."""
    text = lambda c: F.crc32(c.cast("string").cast("binary")) % FOLDS != HELD
    return fit(docs, table(spark, sf_dir, "labels"), use=text)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), trained(spark, docs, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "worst_sentence", "worst_score")
