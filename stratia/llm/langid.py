"""Language of texts: per-language piece probabilities, summed over all segmentations.

The pieces are those of a fixed public vocabulary (`lattice.load_vocabulary`). Each language gets a probability of each
piece, learned by expectation maximisation over all segmentations of its training words, with the vocabulary's own
weights as PRIOR uses beside them. A text's evidence for a language is the sum of log P(word) over its words, where
P(word) sums over all segmentations of the word by a forward recursion in log space (`lattice.Lattice`), plus the log of
the language's share of the training rows. `score` is the posterior probability of the language that is returned, with
ties to the smaller name.

Words are runs of letters a-z and of characters beyond ASCII, in lower case; each begins with the vocabulary's mark of a
word. Whole texts count. Characters that no piece has go through the byte pieces.

Plan: rows are counted by language (one row a language reaches the driver). The fit takes about FIT_ROWS rows of each
language, chosen by a hash of id and text; their words are counted before they are shuffled, and rounds of expectation
are grouped sums, of at most one row a language and piece. Scoring is one pass over the texts without any shuffle: the
distinct words of a slice are scored once each in the lattice, for LANGUAGES_AT_ONCE languages at a time, so that memory
follows neither the number of languages nor the length of a text. A hot language, source or text is spread like any
other rows.

Bounds: FIT_ROWS is the sample of the fit. A table with more than MOST_LANGUAGES different languages raises, because
each needs a row of weights in each task.

Defined cases: a null text, or one without any letter, is `und` with score 0; so is any text if nothing was learned; a
null id counts as the text '' in the fold and its rows keep a null id; training rows without words count only for their
language's share; repeated rows are scored like any other; a text of any length is read in pieces of bounded memory; an
empty table gives an empty result. Of clashing names, `lang_pred` and `score` of the input give way to the results, and
other columns are carried along or left out by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratia.llm.common import fold, fresh, slices, table, word_runs
from stratia.llm.lattice import Lattice, _vocabulary, load_vocabulary
from stratia.session import materialize

FOLDS, HELD = 5, 0
#: Training rows of a language that the fit takes, rounds, uses that the vocabulary's own weights count for.
FIT_ROWS, ROUNDS, PRIOR = 2_000, 2, 10_000.0
MOST_LANGUAGES, LANGUAGES_AT_ONCE = 200, 8
#: Bytes of text that are scored together: the more, the fewer times a word is scored.
SLICE = 16 << 20
UNKNOWN = "und"
#: Bytes of a word to themselves, all others to a space; texts come in lower case.
LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # a row of log-probabilities of pieces for each language
    share: np.ndarray  # log of each language's share of the training rows
    vocabulary: tuple[tuple[str, ...], tuple[float, ...]]


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def indexed(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as numbers, and how many each text has."""
    seen: dict[bytes, int] = {}
    parts, sizes = [np.empty(0, np.int32)], []
    for t in texts:
        n = 0
        for words in word_runs(t.lower().encode(), LETTERS):
            parts.append(np.array([seen.setdefault(w, len(seen)) for w in words], np.int32))
            n += len(words)
        sizes.append(n)
    return [w.decode() for w in seen], np.concatenate(parts), np.array(sizes, np.int64)


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", use: Column | None = None, rows: int = FIT_ROWS, rounds: int = ROUNDS, vocabulary: str | None = None) -> Model:
    """The model of the rows that have a language and meet `use` (all, if None)."""
    spark, pieces = df.sparkSession, load_vocabulary(vocabulary)
    known = df.filter(F.col(lang).isNotNull() if use is None else F.col(lang).isNotNull() & use)
    known = known.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = sorted((r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect())
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: {counts[0][0]}, ...")
    if not counts:
        return Model([], np.empty((0, len(pieces[0]))), np.empty(0), pieces)
    languages, n = [c[0] for c in counts], np.array([c[1] for c in counts], np.float64)
    chances = spark.createDataFrame([(name, i, min(1.0, rows / c)) for i, (name, c) in enumerate(counts)], "lang string, i int, chance double")
    number = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 32)).cast("double") / float(1 << 32)
    sample = known.join(F.broadcast(chances), "lang").filter(number < F.col("chance")).select("i", "text")  # at most MOST_LANGUAGES rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            which = b.column(0).to_numpy(zero_copy_only=False)
            words, flat, sizes = indexed([t or "" for t in b.column(1).to_pylist()])
            pairs, uses = np.unique(np.repeat(which, sizes).astype(np.int64) * max(len(words), 1) + flat, return_counts=True)
            for at in range(0, len(pairs), 50_000):
                p = pairs[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array((p // len(words)).astype(np.int32)), pa.array([words[j] for j in (p % len(words)).tolist()], pa.string()), pa.array(uses[at : at + 50_000].astype(np.int64))], names=["i", "word", "n"])

    words = materialize(sample.mapInArrow(count, "i int, word string, n long").groupBy("i", "word").agg(F.sum("n").alias("n")), "langid-words")
    start = _vocabulary(*pieces).start
    logp = np.tile(start, (len(languages), 1))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, logp))
        found = words.mapInArrow(_expect(shared), "i int, piece int, uses double").groupBy("i", "piece").agg(F.sum("uses").alias("uses")).toArrow()  # at most a row a language and piece
        uses = PRIOR * np.tile(np.exp(start), (len(languages), 1))
        at, piece, x = (found.column(c).to_numpy() for c in ("i", "piece", "uses"))
        uses[at, piece] += x  # each pair comes once
        with np.errstate(divide="ignore"):
            logp = np.log(uses / uses.sum(axis=1, keepdims=True))
    return Model(languages, logp, np.log(n / n.sum()), pieces)


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (pieces, logp), totals = shared.value, {}
        known = _vocabulary(*pieces)
        for b in batches:
            which, words, n = b.column(0).to_numpy(zero_copy_only=False), b.column(1), b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            for i in np.unique(which).tolist():
                rows = np.flatnonzero(which == i)
                got = Lattice(known, logp[i]).expected(words.take(pa.array(rows)).to_pylist(), n[rows])
                totals[i] = totals[i] + got if i in totals else got
        for i, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)), pa.array(total[used])], names=["i", "piece", "uses"])

    return run


def evidence(texts: list[str], model: Model) -> np.ndarray:
    """Of each text (rows) and language (columns) the log of share times probability."""
    words, flat, sizes = indexed(texts)
    out, owner, known = np.tile(model.share, (len(texts), 1)), np.repeat(np.arange(len(texts)), sizes), _vocabulary(*model.vocabulary)
    for at in range(0, len(model.languages), LANGUAGES_AT_ONCE):
        some = model.logp[at : at + LANGUAGES_AT_ONCE]
        for i, lp in enumerate(Lattice(known, *some).scores(words)):
            out[:, at + i] += np.bincount(owner, lp[flat], minlength=len(texts))
    return out


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all of df, if None) with lang_pred and score of each row's text."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    (held,) = fresh(df.select(keep), "text_")
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, held, SLICE):
            texts = b.column(b.num_columns - 1).to_pylist()
            lettered = np.array([bool(t) and has_letter(t) for t in texts], bool)
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if model.languages and lettered.any():
                rows = np.flatnonzero(lettered)
                found = evidence([texts[i] for i in rows], model)
                best = found.argmax(axis=1)  # the first of equal ones: names are sorted
                names[rows] = np.array(model.languages, object)[best]
                scores[rows] = 1 / np.exp(found - found.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return df.select(*keep, F.col(text).alias(held)).mapInArrow(run, schema)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, use=fold("doc_id", FOLDS) != HELD)
    return predict(docs.select("doc_id", "text", (fold("doc_id", FOLDS) == HELD).alias("held_out")), model, keep=["doc_id", "held_out"])
