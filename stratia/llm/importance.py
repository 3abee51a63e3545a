"""Resampling of documents towards a target distribution, by hashed n-gram features.

A text's features are its runs of 1 to 3 consecutive words, joined by one space, with repeats; a feature's bucket is
the CRC-32 of its UTF-8 bytes modulo BUCKETS. A bucket's gain is the floor of 1000 times the log of its smoothed share
in the target over that in the source; a document's weight is the sum of its features' gains. Gumbel noise by document,
from a hash of its id, makes the highest scores a draw without replacement in proportion to exp(weight / 1000).

Plan: identical texts are collapsed by grouping full text, whose map-side part leaves one row a text and task, however
many copies there are. Distinct texts are written once; features are taken from them in two passes, one that counts
(times multiplicity; each task sends at most one row a bucket) and one that weighs. Weights go back to the documents by
a join on the text's digest, where a text with very many copies is one row on the small side and an ordinary skewed
key on the other, which adaptive execution splits; only then does a document get its own noise. Ranks come from ranges
of the score and running sums over parts, so that no task holds all documents. What reaches the driver is a row a bucket.

CRCs of runs are combined, not computed: CRC-32 is linear, so the code of "a b" follows from that of "a", that of " b"
and the length of " b" by table look-ups over whole arrays. Each distinct word of a slice is hashed once.

Defined cases: a null text has no words and is collapsed with the empty one; texts without words weigh 0; a null id
counts as the text '' in the noise, and comes last among ties; repeated rows are documents of their own, with equal
scores, and take ranks in any order; a text of any length is read in pieces of bounded memory, and its runs cross the
pieces; an empty source gives an empty result, an empty target gives every bucket the smoothed share of nothing. Other
columns play no part, so that their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratia.functions.numbering import numbered
from stratia.llm.common import slices, table, word_runs
from stratia.session import materialize

BUCKETS, LONGEST, LEAST, SHARE, SEED = 10_000, 3, 20, 5, 42
#: Bytes of text, and words, that are hashed at once.
SLICE, AT_ONCE = 16 << 20, 1 << 18
#: Bytes that belong to words (digits, letters, all beyond ASCII) to themselves, A-Z to a-z, all others to a space.
WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def _apply(tables: np.ndarray, which: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits by four look-ups, a byte each; `which` names the map of each code."""
    base = np.asarray(which, np.int64) * 1024
    flat = tables.reshape(-1)
    out = flat[base + (crc & np.uint32(0xFF))]
    for k in (1, 2, 3):
        out = out ^ flat[base + 256 * k + (crc >> np.uint32(8 * k) & np.uint32(0xFF))]
    return out


def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """What 0 to 63 zero bytes, and 2 ** j of them, do to a CRC: tables [map, byte's place, byte]."""
    units = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & np.uint32(1), byte >> np.uint32(1) ^ np.uint32(0xEDB88320), byte >> np.uint32(1))
    few = [units]
    for _ in range(63):
        few.append(byte[few[-1] & np.uint32(0xFF)] ^ few[-1] >> np.uint32(8))
    powers = [few[1]]
    for _ in range(39):
        powers.append(_apply(powers[-1], 0, powers[-1]))
    return np.stack(few), np.stack(powers)


FEW, POWERS = _shifts()


def after(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The codes (without their final complement's effect) moved over so many bytes: after(crc(a), len(b)) ^ crc(b) is crc(a + b)."""
    out = _apply(FEW, zeros & 63, crc)
    high, j = zeros >> 6, 6
    while high.any():
        odd = (high & 1).astype(bool)
        out[odd] = _apply(POWERS, j, out[odd])
        high, j = high >> 1, j + 1
    return out


def features(texts: list[str], buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """How many words each text has, and (text's place, bucket) of all features, some at a time."""
    seen: dict[bytes, int] = {}
    parts, sizes = [np.empty(0, np.int32)], []
    for t in texts:
        n = 0
        for words in word_runs(t.encode(), WORDS):
            parts.append(np.array([seen.setdefault(w, len(seen)) for w in words], np.int32))
            n += len(words)
        sizes.append(n)
    flat, sizes = np.concatenate(parts), np.array(sizes, np.int64)
    alone = np.array([zlib.crc32(w) for w in seen], np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in seen], np.uint32)
    length = np.array([len(w) + 1 for w in seen], np.int64)
    ends = np.cumsum(sizes)

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(flat), AT_ONCE):
            n = min(AT_ONCE, len(flat) - at)
            place = np.arange(at, at + n)
            owner = np.searchsorted(ends, place, side="right")
            code = alone[flat[at : at + n]]
            yield owner, code % np.uint32(buckets)
            for k in range(1, longest):
                inside = place + k < ends[owner]
                place, owner, code = place[inside], owner[inside], code[inside]
                word = flat[place + k]
                code = after(code, length[word]) ^ spaced[word]
                yield owner, code % np.uint32(buckets)

    return sizes, found()


def number_of_features(words: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    return sum(np.maximum(words - k, 0) for k in range(longest))


def collapsed(df: DataFrame, text: str = "text") -> DataFrame:
    """(text, n): each different text once with its number of rows; null counts as empty."""
    return df.select(F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """The features in each bucket over (text, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, "text", SLICE):
            n = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            _, found = features(b.column(0).to_pylist(), buckets, longest)
            for owner, bucket in found:
                np.add.at(total, bucket, n[owner])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text", "n").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, in doubles."""
    s, t, b = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


WEIGHTS = T.StructType([T.StructField("digest", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])


def weighed(texts: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(digest, n_words, n_features, weight) of each distinct text."""
    shared = texts.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in slices(batches, "text", SLICE):
            weight = np.zeros(b.num_rows, np.int64)
            words, found = features(b.column(1).to_pylist(), len(gain), longest)
            for owner, bucket in found:
                weight += np.bincount(owner, gain[bucket], minlength=len(weight)).astype(np.int64)  # small integers: exact in doubles
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(number_of_features(words, longest)), pa.array(weight)], names=WEIGHTS.names)

    return texts.select(digest("text").alias("digest"), "text").mapInArrow(run, WEIGHTS)


def digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def noise(key: str, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of a hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", share: int = SHARE, least: int = LEAST, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(key, n_features, weight, score, rank) of each document: of the N with at least `least` words the floor(share * N / 100) highest scores have a rank."""
    texts = materialize(collapsed(df, text), "importance-texts")
    gain = gains(bucket_counts(texts, buckets, longest), bucket_counts(collapsed(target, target_text), buckets, longest))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("key", digest("text").alias("digest"))
    scored = rows.join(weighed(texts, gain, longest), "digest").select("key", "n_words", "n_features", "weight", (F.col("weight") + noise("key", seed)).alias("score"))
    scored = materialize(scored, "importance-scores")
    enough = scored.filter(F.col("n_words") >= least).withColumn("row", F.monotonically_increasing_id())
    drawn = share * enough.count() // 100
    placed = numbered(enough, F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("row"), column="place")
    ranked = placed.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    others = scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    names = [F.col("key").alias(key), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    return ranked.select(names).union(others.select(names))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sql() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = " UNION ALL ".join(f"SELECT row, array_to_string(w[i : i + {k}], ' ') AS f FROM (SELECT row, w, unnest(range(1, len(w) + 1 - {k})) AS i FROM {{0}} WHERE len(w) > {k})" for k in range(LONGEST))
    return f"""
        WITH crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
        b AS MATERIALIZED (SELECT row_number() OVER () AS row, {words} AS w FROM benchmark),
        df AS MATERIALIZED (SELECT row, f, count(*) AS n FROM ({runs.format("d")}) GROUP BY ALL),
        bf AS MATERIALIZED (SELECT f, count(*) AS n FROM ({runs.format("b")}) GROUP BY f),
        hashed AS MATERIALIZED (
            SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen(f)), lambda k: CAST('0x' || substr(hex(f), 2 * k + 1, 2) AS BIGINT))),
                lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % {BUCKETS} AS bucket
            FROM (SELECT f FROM df UNION SELECT f FROM bf), crc_table),
        s AS (SELECT bucket, sum(n) AS s FROM df JOIN hashed USING (f) GROUP BY bucket),
        t AS (SELECT bucket, sum(n) AS t FROM bf JOIN hashed USING (f) GROUP BY bucket),
        gain AS MATERIALIZED (
            SELECT bucket, floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(n), 0) FROM df) AS DOUBLE) + {BUCKETS})
                / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (CAST((SELECT coalesce(sum(n), 0) FROM bf) AS DOUBLE) + {BUCKETS})))) AS g
            FROM s FULL JOIN t USING (bucket)),
        w AS (SELECT row, sum(n * g) AS weight FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY row),
        scored AS (
            SELECT doc_id, len(d.w) AS n_words, {" + ".join(f"greatest(len(d.w) - {k}, 0)" for k in range(LONGEST))} AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
            FROM d LEFT JOIN w USING (row)),
        placed AS (SELECT *, CASE WHEN n_words >= {LEAST} THEN row_number() OVER (PARTITION BY n_words >= {LEAST} ORDER BY score DESC, doc_id) END AS place FROM scored)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
            CAST(CASE WHEN place <= {SHARE} * (SELECT count(*) FROM scored WHERE n_words >= {LEAST}) // 100 THEN place END AS BIGINT) AS rank
        FROM placed
    """
