"""Operators of the training-data pipeline: edge cases, and brute force where SQL cannot state a result."""

import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratia.llm import bpe, flac, lattice, mixing, neighbours, pii, sharding, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["one two three four five six", "One two THREE four five six", None, "", "  \t\n ", "é 漢字 🙂 mixed\x85text don't 123", "stay away you idiot now. the rest is fine."]


def docs(spark, texts=TEXTS, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def many(spark):
    """Documents with nulls, blanks, ties, repeated rows, near copies and a very long text; a null id at the end."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(150)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    texts += [t.replace("a", "b", 1) for t in texts[:10]] + texts[:10] + ["word " * 30_000] + TEXTS
    rows = [(i, t, "en", f"s{i % 5}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[5:8] + [(None, "one without an id", None, "s1", None)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# Mixing


def mix(df):
    plan, rows = mixing.plan(df)
    return mixing.apply(plan, rows).withColumn("taken", F.col("taken_copies") * F.col("size"))


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 40), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(900)]
    got = mix(spark.createDataFrame(rows, DOCS)).toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    by = got.groupby("src").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert (abs(by.taken - by.target) <= 0.03 * by.target + 40).all() and (by.target <= 3 * by["size"] + 1e-9).all()
    assert by.target.sum() == pytest.approx(got["size"].sum())
    again = mix(spark.createDataFrame(rows, DOCS).repartition(7)).toPandas()
    assert dict(zip(got.id, got.taken, strict=True)) == dict(zip(again.id, again.taken, strict=True))


def test_targets_stop_at_three_times_and_share_the_rest(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got == {"a": 30.0, "b": pytest.approx((1100 - 30) * 2 / 3), "c": 270.0, None: 0.0} or got["a"] == 30.0
    assert sum(got.values()) == pytest.approx(1100) and got["c"] <= 270


def test_boost_changes_rates_inside_a_source(spark):
    rows = [(i, "w " * 10, "en", "a" if i % 2 else "b", 4 if i % 4 == 1 else 1) for i in range(400)]
    plan, d = mixing.plan(spark.createDataFrame(rows, DOCS), boost="n_chars")
    got = mixing.apply(plan, d).groupBy("src", "boost").agg(F.avg("taken_copies").alias("c")).toPandas()
    a = got[got.src == "sa"].set_index("boost").c
    assert a[4.0] > a[1.0]


def test_inclusion_differs_inside_a_ranking_and_follows_size(spark):
    rng = random.Random(12)
    rows = [(i, "w " * rng.choice([1, 3, 10, 40, 200]), "en", rng.choice("ab"), 0) for i in range(3000)]
    d = spark.createDataFrame(rows, DOCS)
    got = mix(d).toPandas()
    drawn = got[got.p > 0]
    assert (drawn.groupby("cell").p.nunique() >= 3).any()
    # Rates fall with size; p is what a document of that size gets on average, over seeds.
    assert all(g.sort_values("size").eval("copies + p").is_monotonic_decreasing for _, g in got.groupby("src"))
    hits = Counter()
    for seed in range(4):
        plan, docs_ = mixing.plan(d, seed=f"s{seed}")
        for r in mixing.apply(plan, docs_).groupBy("src", "size").agg(F.avg(F.col("taken_copies") - F.col("copies")).alias("c")).collect():
            hits[r.src, r["size"]] += r.c / 4
    for (src, size), g in got.groupby(["src", "size"]):
        assert hits[src, size] == pytest.approx(g.p.iloc[0], abs=0.1)


def test_alike_rows_are_taken_as_far_as_they_fit(spark):
    rows = [(None, "w " * 10, "en", s, 0) for s in "abc" for _ in range(600)] + [(i, "w " * 10, "en", "d", 0) for i in range(600)]
    d = spark.createDataFrame(rows, DOCS)
    by = mix(d).groupBy("src").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 10 for r in by)
    assert mixing.mixed_documents(d).count() * 10 == sum(r.taken for r in by)


def test_mix_edge_cases(spark, many):
    got = mix(many).toPandas()
    assert len(got) == many.count() and (got.taken[got["size"] == 0] == 0).all()
    assert mix(empty(spark)).count() == 0
    copies = mixing.mixed_documents(many.withColumn("size", F.lit(1)).withColumn("rank", F.lit("x")))
    assert copies.columns == [*many.columns, "size", "rank"] and copies.count() == int(got.taken_copies.sum())


# Sharding


def test_table_is_filled_evenly_and_moves_little():
    shards = sharding.default_shards(10)
    before = sharding.fill(shards, 1009)
    counts = Counter(before)
    assert set(counts) == set(range(10)) and max(counts.values()) - min(counts.values()) <= 1
    after = sharding.fill(shards[:-1], 1009)
    kept = sum(b == a for b, a in zip(before, after, strict=True) if b != 9)
    assert kept > 0.75 * (1009 - counts[9])
    heavy = Counter(sharding.fill(shards, 1009, [2] + [1] * 9))
    assert 1.8 < heavy[0] / heavy[1] < 2.2
    with pytest.raises(ValueError):
        sharding.fill(shards, 1000)
    with pytest.raises(ValueError):
        sharding.fill(["a", "a"], 7)


def test_placement_follows_the_table(spark, many):
    got = sharding.place(many).collect()
    table = sharding.fill(sharding.default_shards())
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, f"shard-{table[slot]:03d}")
    assert len(got) == many.count() and sharding.place(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="slot"):
        sharding.place(many.withColumn("Slot", F.lit(1)))


# Personal data


def test_surrogates_keep_kind_format_and_identity(spark):
    texts = ["jo.81@mail7.example.com, JO.81@MAIL7.EXAMPLE.COM; +1 (900) 555-2077 or +1-900-555-2077", "96.153.118.61 4111 1111 1111 1111 4111111111111111", 'token = "' + "9b0b3c6a" * 5 + '" 123-45-6789', "Mr. William Smith met Mrs Smith and Katherine Brown; Госпожа Иванова и Сергей Иванов.", None, "", "plain 2015-2016, v4.0.  x"]
    got = [r.text for r in pii.pseudonymise(docs(spark, texts), count="n").orderBy("doc_id").collect()]
    mail, upper = got[0].split(", ")[0], got[0].split(", ")[1].split(";")[0]
    assert mail != "jo.81@mail7.example.com" and mail.upper() == upper and mail.endswith(".com")
    phones = got[0].split("; ")[1].split(" or ")
    digits = ["".join(c for c in p if c.isdigit()) for p in phones]
    assert digits[0] == digits[1] != "19005552077" and phones[0].startswith("+1 (") and digits[0][0] == "1"
    ip, *card = got[1].split(" ")
    assert all(0 <= int(x) < 256 for x in ip.split(".")) and "".join(card[:4]) == card[4] != "4111111111111111"
    double = [int(c) * (1 + i % 2) for i, c in enumerate(card[4][::-1])]
    assert sum(x - 9 * (x > 9) for x in double) % 10 == 0
    assert len(got[2]) == len(texts[2]) and "9b0b3c6a" not in got[2] and "123-45-6789" not in got[2]
    words = got[3].replace(";", "").split()
    assert words[0] == "Mr." and words[1] in pii.GIVEN["m", "latin"] and words[2] == words[5] != "Smith" and words[7] in pii.GIVEN["f", "latin"]
    assert words[9] == "Госпожа" and words[10].endswith("ова") and words[12] in pii.GIVEN["m", "cyrillic"] and words[13].rstrip(".").endswith("ов")
    assert got[4:] == texts[4:]


def test_surrogates_are_distinct_and_keyed(spark):
    phones = [f"+1 (900) 555-{i:04d}" for i in range(400)]
    rows = docs(spark, phones + [f"Mr. Name{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)])
    a = [r.text for r in pii.pseudonymise(rows, key="a").orderBy("doc_id").collect()]
    b = [r.text for r in pii.pseudonymise(rows, key="b").orderBy("doc_id").collect()]
    assert len(set(a)) == len(a) == 700 and sum(x == y for x, y in zip(a, b, strict=True)) == 0


class PlainSurrogates:
    """The surrogates in plain Python, from the module's fixed values and the docstring's rules; level 0 for all."""

    def __init__(self, key):
        import regex

        # Classes of Java's patterns are ASCII.
        out, inside, at = "", False, 0
        while at < len(pii.ENTITY):
            c = pii.ENTITY[at : at + 2] if pii.ENTITY[at] == "\\" else pii.ENTITY[at]
            plain = {"\\d": "0-9", "\\w": "A-Za-z0-9_"}.get(c)
            inside = (inside or c == "[") and c != "]"
            out, at = out + (c if plain is None else plain if inside else f"[{plain}]"), at + len(c)
        self.key, self.entity = key, regex.compile(out)

    @staticmethod
    def hash(*parts):
        return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()

    def cycle(self, left, right, a, b, salt):
        number = lambda i, x: int(self.hash(salt, i, x)[:15], 16)
        for i in range(1, 7):
            left, right = ((left + number(i, right)) % a, right) if i % 2 else (left, (right + number(i, left)) % b)
        value = (left * b + right + 1) % (a * b)
        left, right = divmod(value, b)
        for i in range(6, 0, -1):
            left, right = ((left - number(i, right)) % a, right) if i % 2 else (left, (right - number(i, left)) % b)
        return left, right

    def digits(self, text, salt):
        n = len(text)
        a, b = n // 2, n - n // 2
        left, right = self.cycle(int(text[:a] or 0), int(text[a:]), 10**a, 10**b, f"{salt}|{n}")
        return (f"{left:0{a}d}" if a else "") + f"{right:0{b}d}"

    def spelled(self, word, salt, n):
        first, second = pii.SYLLABLES[self.script(word)]
        seed = self.hash(salt, word)
        places = [int(seed[2 * i : 2 * i + 2], 16) % 32 for i in range(n)]
        return "".join(first[p // 4] + second[p % 4] for p in places)

    @staticmethod
    def script(word):
        return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "greek" if any("Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" for c in word) else "latin"

    def word(self, role, word):
        salt, script = f"{self.key}|{role}", self.script(word)
        if role == "surname":
            return self.spelled(word, salt, 6) + ("" if script != "cyrillic" else "ова" if word[-1] in "ая" else "ов")
        return self.spelled(word, salt, 4) + pii.ENDINGS[script][role[-1]]

    def name(self, mention):
        words, listed = mention.split(" "), {}
        for (gender, script), names in pii.GIVEN.items():
            order = sorted(names, key=lambda n: self.hash(self.key, gender, script, n))
            listed |= {n: order[(i + 1) % len(order)] for i, n in enumerate(order)}
        title, out = pii.TITLED.get(words[0]), []
        for i, w in enumerate(words):
            low, cased = w.lower(), (str.upper if w.upper() == w and len(w) > 1 else str.capitalize)
            if i == 0 and title is not None:
                out.append(w)
            elif len(w) == 2 and w[0].isupper() and w[1] == ".":
                out.append(self.spelled(low, f"{self.key}|initial", 1)[0].upper() + ".")
            elif w.capitalize() in listed and i < len(words) - 1:
                out.append(cased(listed[w.capitalize()]))
            elif i == (title is not None) and i < len(words) - 1:
                suggested = "f" if low[-1] in "aeаяαη" or low.endswith(("ie", "ία")) else "m"
                out.append(cased(self.word(f"given-{title or suggested}", low)))
            else:
                out.append(cased(self.word("surname", low)))
        return " ".join(out)

    def shaped(self, text, seed):
        letter = dict(zip("0123456789abcdef", "abdefgiklmnoprst", strict=True))
        digit = lambda c: str("abcdef".index(c)) if c in "abcdef" else c
        return "".join(letter[seed[i % 64]] if c.isalpha() else digit(seed[i % 64]) if c in "0123456789" else c for i, c in enumerate(text))

    def mention(self, m):
        only = "".join(c for c in m if c in "0123456789")

        def fill(new):
            left = iter(new)
            return "".join(next(left) if c in "0123456789" else c for c in m)

        import re

        upper = str.upper if m.upper() == m and m.lower() != m else str
        if "@" in m:
            local, domain = m.lower().rsplit("@", 1)
            front, last = domain.rsplit(".", 1)
            seed, other = self.hash(f"{self.key}|email|0", m.lower()), self.hash(f"{self.key}|email", "@" + domain)
            return upper(self.shaped(local, seed) + "".join("abdefgiklmnoprst"[int(c, 16)] for c in seed[40:52]) + "@" + self.shaped(front, other) + "." + last)
        if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", m):
            o = [int(x) for x in m.split(".")]
            left, right = self.cycle(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, f"{self.key}|ip")
            return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
        if re.match(r"[+(]|[0-9]{3}([.\- ])[0-9]{3}\1[0-9]{4}$", m):
            spelled = re.match(r"\+([0-9]{1,3})[ .\-(]", m)
            code = spelled[1] if spelled else "1" if len(only) == 11 and m.startswith("+1") else ""
            return fill(code + self.digits(only[len(code) :], f"{self.key}|phone|{code}"))
        if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
            return fill(self.digits(only, f"{self.key}|ssn"))
        if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}[ \-].*", m):
            luhn = lambda d: sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(d[::-1])))
            front = self.digits(only[:-1], f"{self.key}|card")
            return fill(front + str((luhn(only) - luhn(front + "0")) % 10))
        if re.fullmatch("[0-9A-Fa-f]{32,64}", m):
            return upper((self.hash(f"{self.key}|secret|0", m.lower()) + self.hash(f"{self.key}|secret|0", m.lower(), "2"))[: len(m)])
        return self.name(m)

    def text(self, t):
        return None if t is None else self.entity.sub(lambda m: self.mention(m[0]), t)


def test_surrogates_equal_a_plain_version_on_a_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = ["Dr. J. Smith, Mrs. Zelda Fitz-Roy and MR. NO; Ms Anna Q. Bell", "555.123.4567 or 555 123 4567, (555) 123 4567 not 1.555.123.4567", "3782 822463 10005; 4111-1111-1111-1112 1234567890123", "Госпожа Анфиса Петрова, Κύριος Φίλιππος Παπαδόπουλος", "a@b.co A.B@c-d.example.org 10.0.0.1 " + "AB" * 20, "00000 999-99-9999 +44 20 7946 0958"]
    d = d.union(docs(spark, extra).select(F.col("doc_id") + 10**6, "text"))
    plain, changed = PlainSurrogates(pii.KEY), 0
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in pii.pseudonymise(d).collect():
        assert r.text == plain.text(texts[r.doc_id]), texts[r.doc_id]
        changed += r.text != texts[r.doc_id]
    assert changed >= 15


def test_dense_phones_settle(spark):
    """Fifty full ranges of four digits: each code's numbers are a permutation without fixed points."""
    codes = [f"+{c}" for c in range(210, 260)]
    rows = spark.range(50 * 10_000).select(F.col("id").alias("doc_id"), F.concat(F.element_at(F.array(*map(F.lit, codes)), (F.col("id") / 10_000).cast("int") + 1), F.lit(" "), F.lpad((F.col("id") % 10_000).cast("string"), 4, "0")).alias("canon"))
    known = rows.select(F.lit("phone").alias("kind"), F.concat(F.substring("canon", 2, 3), F.lit("|"), F.substring("canon", 6, 4)).alias("canon"))
    made = pii.settle(known, "k")
    got = known.withColumn("new", made.of(F.col("kind"), F.col("canon"))).agg(F.countDistinct("new").alias("n"), F.count_if(F.col("new") == F.col("canon")).alias("kept")).first()
    assert (got.n, got.kept) == (500_000, 0)


@pytest.mark.parametrize("bound", [2000, 3])
def test_colliding_names_are_settled_alone(spark, monkeypatch, bound):
    monkeypatch.setattr(pii, "_surname", lambda word, salt, level: F.concat(F.substring(pii._letters(pii._hash(salt, word)), F.lit(1), 1 + level)))
    monkeypatch.setattr(pii, "EXCEPTIONS", bound)
    known = spark.createDataFrame([("surname", f"n{i}") for i in range(40)] + [("surname", "a")], "kind string, canon string")
    found = pii.settle(known, "k")
    made = known.select("canon", found.of(F.col("kind"), F.col("canon")).alias("x")).collect()
    assert len({r.x for r in made}) == 41 and not {r.x for r in made} & {r.canon for r in made}
    assert bool(found.levels["surname"]) == (bound == 3) and max(Counter(k for k, _ in found.own).values(), default=0) <= bound


def test_gender_follows_title_list_or_ending(spark):
    got = [r.text for r in pii.pseudonymise(docs(spark, ["Mrs. Zorblat Quux", "Mr. Zorblat Quux", "Dr. Zorblata Quux", "Mr. Peter Quux", "Peter Quux"])).orderBy("doc_id").collect()]
    first = [t.replace("Mrs. ", "").replace("Mr. ", "").replace("Dr. ", "").split(" ")[0] for t in got]
    assert first[0].endswith("a") and first[1].endswith("n") and first[2].endswith("a") and first[3] == first[4] in pii.GIVEN["m", "latin"]
    assert len({t.split(" ")[-1] for t in got}) == 1


def test_names_in_capitals_are_found_and_corefer(spark):
    texts = ["Mr. John Smith", "Mr. JOHN SMITH", "JOHN SMITH", "John Smith", "MR. JOHN SMITH", "DR SMITH", "ОЛЬГА ИВАНОВА", "Ольга Иванова", "A JOINT STATEMENT OF NOBODY"]
    got = [r.text for r in pii.pseudonymise(docs(spark, texts)).orderBy("doc_id").collect()]
    given, last = got[3].split()
    assert given in pii.GIVEN["m", "latin"] and given != "John" and last != "Smith"
    assert got[:6] == [f"Mr. {given} {last}", f"Mr. {given.upper()} {last.upper()}", f"{given} {last}".upper(), f"{given} {last}", f"MR. {given.upper()} {last.upper()}", f"DR {last.upper()}"]
    assert got[6] == got[7].upper() and got[7].split()[0] in pii.GIVEN["f", "cyrillic"] and got[8] == texts[8]


def test_pii_edge_cases(spark, many):
    got = pii.pseudonymise(many.withColumn("pieces_", F.lit(7)))
    assert got.columns == [*many.columns, "pieces_"] and got.drop("pieces_").exceptAll(many).count() == 0
    assert pii.pseudonymise(empty(spark)).count() == 0


# Toxicity


def test_toxic_sentences_are_found_from_document_labels(spark):
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(60)]
    sentence = lambda bad: " ".join(rng.choice(words) for _ in range(8)) + (" vermin" if bad else "") + "."
    texts, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        where = rng.randrange(6) if bad else None
        texts.append(" ".join(sentence(s == where) for s in range(6)))
        labels.append((i, int(bad)))
    d, y = docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, y, use=lambda c: c % 4 != 2)
    got = toxicity.score(d, model, keep=["doc_id"]).toPandas().set_index("doc_id")
    held = [i for i in range(400) if i % 4 == 2]
    assert all((got.score[i] >= 0.3) == (i % 5 == 0) for i in held)
    spans = toxicity.offending(d, model).toPandas()
    assert all("vermin" in texts[r.doc_id][r.start : r.end] for r in spans.itertuples()) and set(spans.doc_id) == {i for i in range(400) if i % 5 == 0}
    assert all(got.worst_sentence[r.doc_id] == r.sentence for r in spans.itertuples())


def test_noisy_or_is_one_minus_the_product():
    s = np.array([-2.0, 0.5, 3.0])
    p = 1 / (1 + np.exp(-s))
    assert toxicity.noisy_or(s, np.array([0, 0, 1]), 3) == pytest.approx([1 - (1 - p[0]) * (1 - p[1]), p[2], 0])


def test_toxicity_edge_cases(spark, many):
    nothing = spark.createDataFrame([(1, None), (None, 1), (2, 5)], "doc_id long, toxic int")
    model = toxicity.fit(many, nothing)
    got = toxicity.score(many.withColumn("extra", F.lit("x")), model).toPandas()
    assert len(got) == many.count() and got.score.between(0, 1).all() and (got.score[got.text.fillna("").str.strip() == ""] == 0).all()
    assert toxicity.score(empty(spark), model).count() == 0
    with pytest.raises(ValueError, match="score"):
        toxicity.score(many.withColumn("Score", F.lit(1)), model)


# WARC

PAGES = "page_id long, url string, html string"


def test_archives_round_trip_with_any_split(spark, tmp_path):
    rng = random.Random(2)
    html = [None, "", "<p>x</p>", "é" * 5000, bytes(rng.randrange(32, 127) for _ in range(30_000)).decode(), "<p>x</p>", "\x1f\x8b\x08 not a record"]
    rows = [(i, f"http://h/{i}" if i % 2 else None, h) for i, h in enumerate(html)] + [(None, "u", "<p>x</p>"), (2, "u", "<p>x</p>")]
    pages = spark.createDataFrame(rows, PAGES).repartition(2)
    files = spark.createDataFrame(warc.write(pages, str(tmp_path / "w")).collect())
    expected = sorted((str(i), len((h or "").encode()), warc.payload_digest((h or "").encode())) for i, _, h in rows)
    for split in (300, 4096, 1 << 20):
        got = warc.read(files, str(tmp_path / "w"), split).collect()
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == expected
        assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(0, "response", None), (1, "revisit", 0), (2, "response", None), (3, "response", None), (4, "response", None), (5, "revisit", 2), (6, "response", None), (None, "revisit", 2)}
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_damage_is_reported():
    data = warc.record(1, "u", b"payload" * 100, warc.payload_digest(b"payload" * 100), None)
    whole = list(warc.records(io.BytesIO(data), len(data), 0, len(data)))
    assert warc.parse(whole[0][1])["payload"] == b"payload" * 100
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(io.BytesIO(data[:-20]), len(data) - 20, 0, len(data) - 20))


class _Counting(io.BytesIO):
    """A file that counts the bytes that are read."""

    total = 0

    def read(self, n=-1):
        data = super().read(n)
        self.total += len(data)
        return data


def test_ranges_read_little_more_than_their_bytes():
    rng = random.Random(8)
    members = []
    for i in range(3000):
        payload = bytes(rng.randrange(256) for _ in range(rng.randrange(400)))
        members.append(warc.record(i, None, payload, warc.payload_digest(payload), None))
    data = b"".join(members)
    file, found = _Counting(data), []
    for at in range(0, len(data), len(data) // 4):
        found += [warc.parse(w)["page_id"] for _, w in warc.records(file, len(data), at, min(at + len(data) // 4, len(data)))]
    assert found == list(range(3000)) and file.total < 1.5 * len(data) + 8 * warc.WINDOW


def test_candidates_need_whole_headers_and_records_their_length():
    lone = warc._gzip(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno length")
    good = warc.record(7, "u", b"x" * 50, warc.payload_digest(b"x" * 50), None)
    assert [at for at, _ in warc.records(io.BytesIO(lone + good), len(lone + good), 1, len(lone + good))] == [len(lone)]
    with pytest.raises(ValueError, match="no record starts"):
        list(warc.records(io.BytesIO(good + b"junk"), len(good) + 4, 0, len(good) + 4))
    short = warc._gzip(b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: <a>\r\nWARC-Date: d\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    with pytest.raises(ValueError, match="not as long"):
        list(warc.records(io.BytesIO(short), len(short), 0, len(short)))
    with pytest.raises(ValueError, match="damaged"):
        list(warc.records(io.BytesIO(good[:-6] + b"\0\0" + good[-4:]), len(good), 0, len(good)))


def test_archives_keep_clashing_names_apart(spark):
    pages = spark.createDataFrame([(1, "u", "ab", 5), (2, "u", "ab", 6)], PAGES + ", digest_ int")
    assert {(r.page_id, r.digest_, r.refers_to) for r in warc.with_responses(pages, "page_id", "html").collect()} == {(1, 5, None), (2, 6, 1)}
    with pytest.raises(ValueError, match="refers_to"):
        warc.with_responses(pages.withColumnRenamed("digest_", "refers_to"), "page_id", "html")


def test_small_payloads_can_all_be_responses(spark):
    rows = warc.with_responses(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], PAGES), "page_id", "html", 3).collect()
    assert all(r.refers_to is None for r in rows)


# SimHash


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values)) if values else 0


def brute_components(pairs):
    """(key, fp) rows to the smallest key that links reach, by comparing all pairs."""
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(pairs):
        for j in range(i):
            if (a ^ pairs[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(pairs):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(pairs))]


def test_fingerprints_and_components_equal_brute_force(spark, many):
    got = simhash.components(many).collect()
    texts = {r.doc_id: r.text for r in many.collect()}
    assert len(got) == many.count()
    for r in got:
        assert r.fp % (1 << 64) == plain_fingerprint(texts[r.doc_id])
    expected = brute_components([(r.doc_id, r.fp % (1 << 64)) for r in got])
    assert [r.component for r in got] == expected
    assert simhash.components(empty(spark)).count() == 0


@pytest.mark.parametrize("cell", [4096, 16])
def test_links_of_a_dense_group_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "CHUNK", 2 * cell)
    rng = random.Random(cell)
    center, values = rng.getrandbits(64), set()
    for _ in range(250):
        v = center
        for b in rng.sample(range(24), rng.randint(0, 9)):
            v ^= 1 << b
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(100)}
    values = sorted(values)
    fp = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    root = list(range(len(values)))
    place = {v: i for i, v in enumerate(values)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in simhash.links(fp).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        root[find(place[a])] = find(place[b])
    smallest = {}
    for i, v in enumerate(values):
        smallest[find(i)] = min(smallest.get(find(i), v), v)
    assert [smallest[find(i)] for i in range(len(values))] == brute_components([(v, v) for v in values])


def test_what_links_meets_in_the_finer_grid(spark):
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in values[:40]:
        for b in [rng.sample(range(64), k) for k in (1, 2, 3, 4, 4, 4)]:
            values.append(v ^ sum(1 << x for x in b))
    values = sorted(set(values))
    rows = spark.createDataFrame([(1, v - (1 << 64) if v >> 63 else v) for v in values], "cell long, fp long")
    cells = {}
    for r in simhash.finer(rows).collect():
        cells.setdefault(r.fp % (1 << 64), set()).add(r.cell)
    assert all(cells[a] & cells[b] for a in values for b in values if (a ^ b).bit_count() <= 4)
    assert sum(map(len, cells.values())) < 4 * len(values)


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(9)
    for _ in range(300):
        a, b = rng.getrandbits(64), rng.getrandbits(64)
        counts = lambda x: [(x >> 2 * i & 3).bit_count() for i in range(32)]
        l1 = sum(abs(x - y) for x, y in zip(counts(a), counts(b), strict=True))
        e = simhash._counts(np.array([a, b], np.uint64))
        assert int(e[0] ^ e[1]).bit_count() == l1 <= (a ^ b).bit_count()


def test_one_document_of_each_group_stays(spark, many):
    kept = simhash.near_dedup(many).collect()
    found = {r.doc_id: r.component for r in simhash.components(many).collect()}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for k, c in found.items() if k is not None})
    assert sum(r.doc_id is None for r in kept) == 1


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    a, b = ("alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven eight nine ten")
    c, d = ("red orange yellow green blue indigo violet black white grey", "north south east west up down left right in out")
    rows = [(5, a), (5, b), (3, b), (7, c), (7, d), (None, c), (None, "x y z"), (None, "x y z"), (5, a)]
    prints = {t: simhash.fingerprint(t) for _, t in rows}
    assert min((x ^ y).bit_count() for t, x in prints.items() for u, y in prints.items() if t != u) > simhash.DISTANCE
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        got = sorted(((r.doc_id or 0), r.text) for r in simhash.near_dedup(df).collect())
        assert got == sorted([(5, a), (3, b), (7, c), (7, d), (0, "x y z")])


# Lattice


@pytest.mark.parametrize(("in_step", "at_once"), [(48, 100_000), (3, 4), (48, 7)])
def test_lattice_sums_over_all_segmentations(monkeypatch, in_step, at_once):
    monkeypatch.setattr(lattice, "IN_STEP", in_step)
    monkeypatch.setattr(lattice, "AT_ONCE", at_once)
    pieces = ["<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "ab", "▁a", "▁ab", "ba"]
    v = lattice.Vocabulary(tuple(pieces), tuple(-float(i) for i in range(len(pieces))))
    p = dict(zip(pieces, np.exp(v.start), strict=True))

    def total(word):
        text = "▁" + word
        ways = [1.0] + [0.0] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(j):
                if text[i:j] in p:
                    ways[j] += ways[i] * p[text[i:j]]
                elif j == i + 1:
                    ways[j] += ways[i] * np.prod([p[f"<0x{b:02X}>"] for b in text[i].encode()])
        return np.log(ways[-1])

    words = ["ab", "aba", "b", "éa", "", "abababab", "bé漢"]
    model = lattice.Lattice(v, v.start)
    assert model.score(words) == pytest.approx([total(w) for w in words])
    other = v.start - np.arange(len(pieces)) / 50
    assert lattice.Lattice(v, v.start, other).scores(words)[1] == pytest.approx(lattice.Lattice(v, other).score(words))
    # Expected uses are the slopes of the likelihood.
    uses = model.expected(words, np.arange(1.0, len(words) + 1))
    i, step = pieces.index("ab"), 1e-6
    moved = v.start.copy()
    moved[i] += step
    slope = sum(n * (b - a) for n, a, b in zip(range(1, len(words) + 1), model.score(words), lattice.Lattice(v, moved).score(words), strict=True)) / step
    assert uses[i] == pytest.approx(slope, rel=1e-4)


def test_scores_equal_brute_force(spark, many):
    marked = many.withColumn("held", F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False)))
    got = lattice.score_texts(marked, held="held").toPandas()
    rows = [(r.doc_id, (r.text or "").encode().lower().split(), r.held) for r in marked.collect()]
    count = Counter(w for _, words, held in rows if not held for w in [*words, None])
    n, v = sum(count.values()), len(count)
    expected = sorted((str(k), len(w) + 1, sum(count[x] > 0 for x in [*w, None]), round(sum(np.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None]), 4)) for k, w, _ in rows)
    assert sorted((str(None if np.isnan(r.doc_id) else int(r.doc_id)), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got.itertuples()) == expected
    assert (got.train_tokens == n).all() and np.isfinite(got.score).all() and (got.score <= 1e-9).all() and (got.vocabulary_score < 0).all() and (got.mixed_score < 0).all()
    assert lattice.score_texts(empty(spark)).count() == 0


# Byte-level BPE


def test_ids_equal_tiktoken_and_decode_back(spark, many):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode(many, offsets="offsets")
    back = bpe.decode(coded, keep=["doc_id", "ids", "offsets", "text"]).collect()
    assert len(back) == many.count()
    for r in back:
        text = r.text or ""
        assert r.ids == e.encode_ordinary(text) and bytes(r.decoded).decode() == text and len(r.offsets) == len(r.ids)
        assert all(text[o.start : o.end].encode().find(e.decode_single_token_bytes(i)) >= 0 for i, o in zip(r.ids, r.offsets, strict=True))
    for r in bpe.round_trip(many).collect():
        text = {str(x.doc_id): x.text or "" for x in back}[str(r.doc_id)]
        ids = e.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_characters) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), len(text))
    plain = bpe.encode(many).select("doc_id", "ids").collect()
    assert sorted((str(r.doc_id), r.ids) for r in plain) == sorted((str(r.doc_id), r.ids) for r in back)
    assert bpe.round_trip(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(many.withColumn("IDS", F.lit(1)))


def test_split_characters(spark):
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = bpe.ByteBpe(f.read(), P.PATTERN)
    (ids,) = coder.encode(["🙂"])
    ((_, spans),) = coder.encode_with_offsets(["a🙂"])
    assert spans == [(0, 1), *[(1, 2)] * len(ids)] and coder.inside_characters(coder.encode(["a🙂"])[0]) == len(ids) - 1
    assert len(ids) > 1 and coder.decode(ids) == "🙂".encode() and bpe.decoded_text(coder.decode(ids[:1])) == "�"
    for unknown in ([60_000], [-1]):
        with pytest.raises(ValueError):
            coder.decode(unknown)


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = bpe.ByteBpe(f.read(), P.PATTERN)
    rng = random.Random(4)
    texts = ["".join(rng.choice(["it's", " ", "  ", "\n", "a", " b", "9", "é", " 漢", "🙂", ".", " ,"]) for _ in range(3000)), "x" * 500, " " * 500]
    whole = coder.encode_with_offsets(texts)
    cut = bpe.parts
    monkeypatch.setattr(bpe, "parts", lambda t: cut(t, 40))
    assert len(bpe.parts(texts[0])) > 20 and coder.encode_with_offsets(texts) == whole


# Nearest neighbours


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 64)
    monkeypatch.setattr(neighbours, "QUERY_TILE", 3)
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(size=8).astype(np.float32) for i in range(400)}
    vectors |= {i: vectors[50] for i in range(300, 340)} | {i: (vectors[100] * 1e-30).astype(np.float32) for i in (350, 351)}
    rows = [(i, [float(x) for x in v], 0) for i, v in vectors.items()]
    bad = [(1000, None, 0), (1050, [0.0] * 8, 0), (1100, [1.0, None] * 4, 0), (1150, [float("nan")] * 8, 0), (1200, [1.0] * 5, 0), (1250, [], 0), (None, rows[0][1], 0), rows[0]]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, id int")
    got = neighbours.nearest(df).orderBy("query_id", "rank").collect()
    ids = np.array([*vectors, 0])
    m = np.array([vectors[i] for i in ids], np.float64)
    for q in range(0, 400, 50):
        s = neighbours.cosine(np.broadcast_to(vectors[q].astype(np.float64), m.shape), m)
        order = sorted((-x, i) for x, i in zip(s.tolist(), ids.tolist(), strict=True) if i != q)[:5]
        assert [(r.id, r.score) for r in got if r.query_id == q] == [(i, -x) for x, i in order]
    assert {r.query_id for r in got} == set(range(0, 400, 50))
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_code_products_are_exact_for_long_vectors():
    a, b = (np.full((2, 9001), x, np.int8) for x in (127, -127))
    b[1, ::2] = 126
    assert neighbours.code_products(a, b).tolist() == (a.astype(np.int64) @ b.astype(np.int64).T).tolist()


# FLAC


def test_streams_round_trip_and_checks_hold():
    rng = random.Random(6)
    payloads = [b"", b"\0" * 64, b"x", bytes(rng.randrange(256) for _ in range(5000)), b"hello world " * 900, bytes(range(256)) * 70]
    streams = flac.encode(payloads)
    for p, blocks in zip(payloads, flac.decode(streams), strict=True):
        assert b"".join(x.astype(np.int8).tobytes() for _, x in blocks) == p
        assert [f for f, _ in blocks] == list(range(0, len(p), flac.BLOCK))
    for at in (3, 30, len(streams[4]) // 2, len(streams[4]) - 1):
        damaged = bytearray(streams[4])
        damaged[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            flac.decode([bytes(damaged)])
    # Without seek points the frames follow one another.
    s = flac._Stream(streams[4], 0)
    bare = streams[4][:42].replace(b"\x00\x00\x00\x22", b"\x80\x00\x00\x22", 1) + streams[4][s.first :]
    assert b"".join(x.astype(np.int8).tobytes() for _, x in flac.decode([bare])[0]) == payloads[4]


def test_linear_prediction_partitions_and_escapes_decode():
    """A 16-bit frame written by hand: order 2 prediction, two partitions, the second one escaped."""
    bits = []
    put = lambda v, n: bits.extend(v >> (n - 1 - i) & 1 for i in range(n))
    residual = [3, -4, 5, 0, -1, 2, 7, -8, 1, 0, 6, -3, 2, 2]
    put(0, 1), put(32 + 1, 6), put(0, 1)
    for warm in (100, 110):
        put(warm, 16)
    put(4, 4), put(1, 5), put(3, 5), put(-1 & 31, 5)
    put(0, 2), put(1, 4), put(2, 4)
    for r in residual[:6]:
        z = 2 * r if r >= 0 else -2 * r - 1
        put(1, (z >> 2) + 1), put(z & 3, 2)
    put(15, 4), put(5, 5)
    for r in residual[6:]:
        put(r & 31, 5)
    bits += [0] * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x64, 0x08, 0, 15])
    frame = head + bytes([flac.crc8(head)]) + np.packbits(bits).tobytes()
    crc = int(flac.CRC16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    samples = [100, 110]
    for r in residual:
        samples.append(r + ((3 * samples[-1] - samples[-2]) >> 1))
    packed = (8000 << 44 | 15 << 36 | 16).to_bytes(8, "big")
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + packed + hashlib.md5(np.array(samples, "<i2").tobytes()).digest()
    stream = b"fLaC" + bytes([0x80, 0, 0, 34]) + info + frame + crc.to_bytes(2, "big")
    ((first, got),) = flac.decode([stream])[0]
    assert first == 0 and got.tolist() == samples


def test_flac_digests_and_blocks(spark, many):
    payload, n = flac.padded("text")
    stored = flac.encode_column(many.select("doc_id", n.alias("n_bytes"), payload.alias("p"), "text"), "p", keep=["doc_id", "n_bytes", "text"])
    for r in flac.read_digests(flac.decode_column(stored), "blocks", ["doc_id", "n_bytes", "text", "media_bytes"]).collect():
        raw = (r.text or "").encode()
        raw += bytes(-len(raw) % 64 or 64 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((r.text or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    blocks = flac.pcm_blocks(stored.filter("doc_id = 140"), "doc_id").orderBy("block").collect()
    assert [b.first_sample for b in blocks] == [i * flac.BLOCK for i in range(len(blocks))] and b"".join(bytes(b.pcm) for b in blocks).rstrip(b"\0") == b"word " * 30_000
    assert flac.encode_column(many.select("doc_id", F.lit(None).cast("binary").alias("p")).limit(0), "p").count() == 0
    rows = [r.asDict() for r in blocks]
    whole = flac.seek(rows, 0, 10**9)
    for a, b in ((0, 1), (4090, 4100), (100, 9000), (149_990, 150_016), (5, 5)):
        assert flac.seek(rows, a, b) == whole[a:b]
    with pytest.raises(ValueError, match="media"):
        flac.encode_column(many.select(F.lit(b"x").alias("p"), F.lit(1).alias("Media")), "p")
    assert flac.decode_column(many.select("doc_id", F.lit(None).cast("binary").alias("media"))).filter("blocks is not null").count() == 0


def test_linear_prediction_is_chosen_and_decodes():
    t = np.arange(9000)
    waves = [np.rint(100 * np.sin(t / 9) * np.cos(t / 50)).astype(np.int8).tobytes(), np.rint(60 * np.sin(t[:700] / 2.5)).astype(np.int8).tobytes(), b"the rain in spain falls mainly " * 40, bytes(range(5)), b"\x80\x7f" * 300]
    streams = flac.encode(waves)
    assert len(streams[0]) < 0.5 * len(waves[0])
    kinds = set()
    for s in streams:
        m = flac._Stream(s, 0)
        for _, offset, _ in m.points:
            kinds.add(s[flac._frame_header(np.frombuffer(s, np.uint8), m.first + offset, m)[2]] >> 1 & 63)
    assert 31 + flac.LPC in kinds
    for p, blocks in zip(waves, flac.decode(streams), strict=True):
        assert b"".join(x.astype(np.int8).tobytes() for _, x in blocks) == p


# Pipeline


def test_pipeline_stages_equal_brute_force(spark, many, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = many.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i == 147), 1) for i in range(148)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    d, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in pipeline.STAGES[:4]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == pipeline.COLUMNS, name
        kept.append(sorted((r.doc_id, r.text or "") for r in d.collect()))
    model = toxicity.trained(spark, rows, str(tmp_path))
    fine = {r.doc_id for r in toxicity.score(rows, model).collect() if r.score < toxicity.THRESHOLD}
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert {i for i, _ in kept[0]} == fine
    prints = [(i, plain_fingerprint(texts[i])) for i in sorted(fine)]
    assert {i for i, _ in kept[1]} == set(brute_components(prints))
    assert [i for i, _ in kept[2]] == [i for i, _ in kept[1]] and {i for i, _ in kept[3]} <= {i for i, _ in kept[2]}
    assert max(Counter(i for i, _ in kept[3]).values()) <= 3
    final = pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(final.doc_id) == [i for i, _ in kept[3]]
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept[3]}
    assert all(want[i] == h for i, h in zip(final.doc_id, final.decoded_sha256, strict=True))


# Long headers and object stores


@pytest.mark.parametrize("length", [10, 5_000, 70_000, 1_000_000])
def test_records_with_long_addresses_are_read_at_every_cut(length):
    rng = random.Random(length)
    url = "http://" + "".join(rng.choice("abcdefghij0123456789/") for _ in range(length))
    members = [warc.record(i, url if i % 2 else "u", b"body %d" % i, warc.payload_digest(b"body %d" % i), None) for i in range(4)]
    data = b"".join(members)
    starts = [sum(map(len, members[:i])) for i in range(4)]
    cuts = sorted({0, len(data), *starts, *(s + d for s in starts[1:] for d in (-1, 1, 7)), *range(0, len(data), max(len(data) // 9, 1))})
    found = [(at, warc.parse(w)["page_id"], warc.parse(w)["url"]) for a, b in zip(cuts, cuts[1:], strict=False) for at, w in warc.records(io.BytesIO(data), len(data), a, b)]
    assert found == [(s, i, url if i % 2 else "u") for i, s in enumerate(starts)]


def test_a_damaged_record_with_a_long_address_raises():
    url = "http://" + "".join(random.Random(1).choice("abcdefghij0123456789/") for _ in range(90_000))
    data = bytearray(warc.record(1, url, b"x", warc.payload_digest(b"x"), None))
    data[len(data) // 2] ^= 0xFF
    with pytest.raises(ValueError, match="record"):
        list(warc.records(io.BytesIO(bytes(data)), len(data), 0, len(data)))


def test_members_that_only_begin_like_headers_are_passed_over():
    odd = warc._gzip(b"WARC/1.1\r\nthis line has no mark\r\n" + b"z" * 200_000)
    good = warc.record(7, "u", b"x" * 50, warc.payload_digest(b"x" * 50), None)
    assert [at for at, _ in warc.records(io.BytesIO(odd + good), len(odd + good), 1, len(odd + good))] == [len(odd)]


def test_addresses_of_object_stores_get_the_names_that_readers_know():
    assert warc.address("s3a://bucket/a/b") == "s3://bucket/a/b" and warc.address("wasbs://c@a.blob.core.windows.net/x") == "abfss://c@a.blob.core.windows.net/x"
    assert warc.address("file:///a") == "file:///a" and warc.address("hdfs://h:1/a") == "hdfs://h:1/a" and warc.address("/plain") == "/plain"


def test_warc_digests_meet_rows_both_ways(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"u{i}", f"body {i % 7}" if i % 5 else None) for i in range(60)] + [(None, None, "body 1"), (3, "again", "body 3")], PAGES)
    want = sorted(map(str, warc.with_responses(pages, "page_id", "html").collect()))
    monkeypatch.setattr(warc, "MOST_SENT", 0)
    assert sorted(map(str, warc.with_responses(pages, "page_id", "html").collect())) == want


# Fit and score of a whole table, plainly


def test_toxicity_equals_a_plain_fit_and_score_of_a_table(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r.doc_id: int(r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.toxic in (0, 1)}
    use = sorted(i for i in labels if i in rows and rows[i] is not None and zlib.crc32(str(i).encode()) % 4 != 2)
    w, b = toxicity.train([rows[i] for i in use], np.array([labels[i] for i in use]))
    for r in toxicity.op4_toxicity(spark, d).collect():
        none, sentences = 1.0, [[]]
        for t in toxicity.tokens(rows[r.doc_id] or ""):
            sentences[-1].append(t)
            if t in toxicity.ENDS:
                sentences.append([])
        for s in sentences:
            inside = [t for t in s if t not in toxicity.ENDS]
            if inside:
                z = b + sum(float(w[f]) for t in inside for f in toxicity.word_features(t))
                none *= 1 - 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        assert r.score == pytest.approx(1 - none, abs=2e-3), r.doc_id
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_flac_columns_against_plain_counts(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in flac.op10_flac(spark, d).collect():
        raw = rows[r.doc_id]
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        s = [x - 256 if x > 127 else x for x in payload]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(s, s[1:], strict=False))
        assert r.feature == f"sum={sum(s)};energy={sum(x * x for x in s)};crossings={crossings};peak={max(map(abs, s))}"
        (stream,) = flac.encode([payload])
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
