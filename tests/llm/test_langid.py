"""Language of texts: brute force over all segmentations, held-out rows and edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratia.llm import langid
from stratia.llm.lattice import SPACE, _vocabulary, load_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"xx": ["alpha", "river", "the", "stone", "and"], "yy": ["größe", "straße", "und", "über", "nicht"], "zz": ["ñandú", "perro", "los", "camino", "pero"]}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 40))) + rng.choice([".", " 42!", ""]), lang, "s", 0) for i, lang in enumerate(rng.choice(sorted(WORDS)) for _ in range(240))]
    return spark.createDataFrame(rows + rows[3:6] + [(900, None, "xx", "s", 0), (901, "", "yy", "s", 0), (902, "12 34 ²½ ...", "yy", "s", 0), (None, "the river", None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def model(labelled):
    return langid.learn(labelled, use=F.col("doc_id") % 5 != 0)


def brute(word: str, pieces: dict, byte: list, logp: np.ndarray) -> float:
    """Sum over all segmentations, in plain probabilities."""
    s = SPACE + word
    ways = [1.0] + [0.0] * len(s)
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in pieces:
                ways[j] += ways[i] * math.exp(logp[pieces[s[i:j]]])
        if s[i] not in pieces:
            ways[i + 1] += ways[i] * math.exp(sum(logp[byte[b]] for b in s[i].encode()))
    return math.log(ways[-1])


def test_evidence_sums_all_segmentations(model):
    names, _ = model.vocabulary
    plain = {p: i for i, p in enumerate(names) if not (p.startswith("<") and p.endswith(">") and len(p) > 2)}
    byte = [names.index(f"<0x{b:02X}>") for b in range(256)]
    texts = ["The river, und über!", "ñandú 漢字 x", "stone"]
    got = langid.evidence(texts, model)
    for i, words in enumerate((["the", "river", "und", "über"], ["ñandú", "漢字", "x"], ["stone"])):
        for k in range(3):
            assert got[i, k] == pytest.approx(model.share[k] + sum(brute(w, plain, byte, model.logp[k]) for w in words), rel=1e-9)


def test_one_round_is_the_plain_expectation(spark, labelled):
    """Weights after one round: expected uses over all segmentations, by enumeration, beside the prior."""
    few = spark.createDataFrame([(1, "the und the", "xx", "s", 0)], SCHEMA)
    got = langid.learn(few, rounds=1)
    names, scores = load_vocabulary()
    start = _vocabulary(names, scores).start
    plain = {p: i for i, p in enumerate(names)}
    uses = langid.PRIOR * np.exp(start)
    for word, n in (("the", 2), ("und", 1)):
        s, ways = SPACE + word, []

        def cut(at, path):
            if at == len(s):
                ways.append(path)
            for j in range(at + 1, len(s) + 1):
                if s[at:j] in plain:
                    cut(j, [*path, plain[s[at:j]]])

        cut(0, [])
        p = np.array([math.exp(sum(start[i] for i in w)) for w in ways])
        for share, w in zip(p / p.sum(), ways, strict=True):
            for i in w:
                uses[i] += n * share
    assert np.allclose(np.exp(got.logp[0]), uses / uses.sum(), rtol=1e-9, atol=0)


def test_held_out_rows_and_defined_cases(spark, labelled, model):
    got = {(r.doc_id, r.text): r for r in langid.predict(labelled, model).collect()}
    assert langid.predict(labelled, model).count() == labelled.count()
    held = [r for r in got.values() if r.doc_id is not None and r.doc_id % 5 == 0 and r.doc_id < 900]
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    for i, t in ((900, None), (901, ""), (902, "12 34 ²½ ...")):
        assert got[i, t].lang_pred == "und" and got[i, t].score == 0
    assert got[None, "the river"].lang_pred == "xx"


def test_labels_and_other_columns_are_no_inputs(spark, labelled, model):
    plain = langid.predict(labelled.select("doc_id", "text"), model).collect()
    odd = labelled.select("doc_id", "text", F.lit("yy").alias("lang"), F.lit(1).alias("score"), F.lit("q").alias("text_"))
    other = langid.predict(odd, model)
    assert other.columns == ["doc_id", "text", "lang", "text_", "lang_pred", "score"]
    assert sorted((r.lang_pred, r.score) for r in plain) == sorted((r.lang_pred, r.score) for r in other.collect())


def test_texts_longer_than_a_piece_and_many_languages(spark, model, monkeypatch):
    text = "the river and stone " * 400 + "x" * 300
    want = langid.evidence([text], model)
    monkeypatch.setattr(langid, "word_runs", lambda t, letters: __import__("stratia.llm.common", fromlist=["x"]).word_runs(t, letters, 64))
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", 2)
    assert np.allclose(langid.evidence([text], model), want, rtol=1e-12)
    wide = spark.createDataFrame([(i, "a", f"l{i}", None, 0) for i in range(langid.MOST_LANGUAGES + 1)], SCHEMA)
    with pytest.raises(ValueError, match="languages"):
        langid.learn(wide)


def test_nothing_learned_and_empty_table(spark, labelled, model):
    none = langid.learn(labelled.filter("lang = 'never'"))
    assert {r.lang_pred for r in langid.predict(labelled, none).collect()} == {"und"}
    assert langid.predict(labelled.limit(0), model).count() == 0


def test_query_on_a_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text")
    got = langid.op11_language(spark, d).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held if r.text]) >= 0.95
