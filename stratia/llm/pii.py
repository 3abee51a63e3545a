r"""PII surrogates: detected entities give way to keyed replacements of their kind. DataFrame functions only.

Kinds: email, ip, phone, ssn, card, secret (hex tokens of 32 to 64 characters), and persons' names (a title with
capitalised words or initials, or a known given name with a surname). A surrogate depends on the key and the entity
alone, so that an entity has the same surrogate in every document and spelling (coreference), and no mention has to be
joined to a table:

* digits (phones after the country code, cards, social security numbers, addresses): a keyed permutation of all
  strings of that length, filled into the mention's own punctuation. It is P^-1(P(x) + 1) for a Feistel network P: a
  permutation, so distinct entities stay distinct, and one without fixed points, so no entity keeps its own. Of cards the
  digits before the last are permuted, and the last keeps its distance to the Luhn check: valid cards stay valid.
* emails: letters and digits of the local part change in place and keyed letters follow; the domain changes by a key of
  its own and keeps its last part.
* secrets: as many keyed hex digits, in the case of the mention.
* given names of the lists: the next name in a keyed order of the list of the same gender and script. Other given names
  (the first of two words behind a title) become keyed syllables of their script with an ending of their gender: the
  title's, or where that says none the one that the name's own ending suggests. Surnames become keyed syllables, with
  the ending that a feminine Cyrillic surname has; titles stay, an initial becomes another. Upper case stays upper case.

Collision check: the distinct entities of the whole corpus (aggregated before the shuffle) get their surrogates. An
email, secret or name that shares its surrogate with an entity before it, keeps its own or meets a real entity is settled
alone: it is made again at a level with more syllables or letters, until none is left. Such entities are few, and go into
the plan as a literal map of at most EXCEPTIONS entries a kind; a kind with more gets wider surrogates as a whole, which divides
their number by hundreds each time.

Defined cases: a null text stays null; an empty text stays empty; repeated rows change alike; an empty table gives an
empty result; other columns stay, whatever their names. Texts are processed whole; a text without entities stays as it is,
byte for byte. Titles and given names are found as the lists have them and in capitals. Not detected: names without a title
whose given name is not in the lists. A permuted number can be that of another entity of the corpus, whose own mentions have
then moved on to another; which of the two it was can't be told without the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.llm.common import fresh, table
from stratia.session import materialize

#: Kinds whose surrogates are hashes and can collide; those of the others are permutations.
HASHED = ("email", "secret", "given-f", "given-m", "surname")
KEY, MOST_ROUNDS, EXCEPTIONS = "change-this-key", 40, 2000

# Common given names of one gender and script.
GIVEN = {
    ("f", "latin"): "Alice Amelia Anna Anneliese Beatrice Camille Carmen Caroline Catherine Charlotte Claire Deborah Eleanor Elena Elizabeth Emily Emma Francesca Gabriela Hannah Helen Ingrid Isabella Jennifer Jessica Julia Katherine Laura Linda Lucia Margaret Maria Marie Mary Nancy Olivia Patricia Rebecca Samantha Sarah Sofia Sophie Stephanie Susan Teresa Victoria".split(),
    ("m", "latin"): "Alexander Andrew Anthony Antonio Benjamin Carlos Charles Christopher Daniel David Dominic Edward Francisco Frederick George Giovanni Guillermo Henry Jacques James John Jonathan Joseph Juan Leonardo Louis Luigi Manuel Marco Martin Matthew Michael Miguel Nicholas Oliver Patrick Paul Peter Philip Pierre Richard Robert Sebastian Stefan Theodore Thomas Vincent William".split(),
    ("f", "cyrillic"): "Александра Анастасия Анна Валентина Вера Екатерина Елена Ирина Людмила Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Владимир Григорий Дмитрий Иван Константин Михаил Николай Павел Пётр Сергей Юрий".split(),
    ("f", "greek"): "Αικατερίνη Άννα Βασιλική Δήμητρα Ελένη Ιωάννα Μαρία Σοφία".split(),
    ("m", "greek"): "Αθανάσιος Ανδρέας Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης".split(),
}
# Titles by the gender that they say; "" says none.
TITLES = {"m": "Mr Herr Señor Monsieur Господин Κύριος".split(), "f": "Mrs Ms Miss Frau Señora Madame Госпожа Κυρία".split(), "": "Dr Prof".split()}
SYLLABLES = {"latin": ("bdklmnrt", "aeio"), "cyrillic": ("бдклмнрт", "аеио"), "greek": ("βδκλμνρτ", "αειο")}
#: Endings of made-up given names.
ENDINGS = {"latin": {"f": "a", "m": "n"}, "cyrillic": {"f": "ия", "m": "ий"}, "greek": {"f": "ία", "m": "ος"}}



def both_cases(words: list[str]) -> list[str]:
    return [*words, *(w.upper() for w in words)]


CAPITALISED = r"\p{Lu}[\p{L}'’\-]+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[.\- ]\d{4}(?!\d)|(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-])|(?<![\w.\-])\d{3}\.\d{3}\.\d{4}(?!\w|\.\d)|(?<![\w.,\-])(?<!\d )[2-9]\d\d [2-9]\d\d \d{4}(?!\w|[ .,\-]\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\p{L}\d.\-])(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,4}|3[47]\d{2}[ \-]\d{6}[ \-]\d{5}|\d{13,19})(?![\p{L}\d])",
    "secret": r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\d])",
    "name": rf"(?=\p{{Lu}})(?:(?:{'|'.join(t for ts in TITLES.values() for t in both_cases(ts))})\.?(?: \p{{Lu}}\.){{0,2}} {CAPITALISED}(?: (?:\p{{Lu}}\. )?{CAPITALISED})?|(?:{'|'.join(n for names in GIVEN.values() for n in both_cases(names))})(?: \p{{Lu}}\.)? {CAPITALISED})(?!\p{{L}})",
}
#: One pattern for a single scan: inside a word it fails after a character class and one look back.
ENTITY = "(?=[+(0-9])(?:{ip}|{phone}|{ssn}|{card})|(?<![\\p{{L}}\\p{{N}}])(?:{email}|{secret}|{name})".format(**PATTERNS)
#: Stands before marks inside a text while it is cut; where a text has it, a second character follows it meanwhile.
MARK, ESCAPE = "", ""


def kind_of(mention: Column) -> Column:
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(mention.rlike(r"^[+(]|^\d{3}([.\- ])\d{3}\1\d{4}$"), "phone")
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(mention.rlike(r"^(?:\d{13,19}|\d{4}[ \-].*)$"), "card")
        .when(mention.rlike(r"^[0-9A-Fa-f]{32,64}$"), "secret")
        .otherwise("name")
    )


def canonical(mention: Column, kind: Column) -> Column:
    """What mentions of one entity have in common; of a phone with its country code and a bar in front."""
    digits = F.regexp_replace(mention, r"\D", "")
    spelled = F.regexp_extract(mention, r"^\+(\d{1,3})[ .\-(]", 1)
    code = F.when(spelled != "", spelled).when((F.length(digits) == 11) & mention.startswith("+1"), "1").otherwise("")
    phone = F.concat(code, F.lit("|"), F.substring(digits, F.length(code) + 1, F.lit(32)))
    return F.when(kind.isin("email", "secret"), F.lower(mention)).when(kind == "phone", phone).when(kind == "ip", mention).otherwise(digits)


def let(value: Column, body) -> Column:
    """body of a value that is computed once: a lambda's variable stands for it, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts)).cast("binary"), 256)


def _number(*parts: Column | str) -> Column:
    return F.conv(F.substring(_hash(*parts), 1, 15), 16, 10).cast("long")


def _feistel(left: Column, right: Column, over_left: Column, over_right: Column, salt: Column, rounds: int = 6) -> Column:
    """P^-1(P(x) + 1) of a pair (left < over_left, right < over_right), for a keyed Feistel network P of two radices.

    P is a permutation, so this is one too, and it runs through all pairs in one cycle: none stays where it is.
    """
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(sign: int):
        def step(s: Column, i: Column) -> Column:
            l, r = s["l"], s["r"]  # noqa: E741
            move = lambda x, y, over: F.pmod(x + sign * (_number(salt, i.cast("string"), y.cast("string")) % over), over)
            return F.when(i % 2 == 1, F.struct(move(l, r, over_left).alias("l"), r.alias("r"))).otherwise(F.struct(l.alias("l"), move(r, l, over_right).alias("r")))

        return step

    ahead = F.aggregate(F.array(*(F.lit(i) for i in range(1, rounds + 1))), start, turn(1))
    carried = let(ahead, lambda s: F.struct(F.when(s["r"] + 1 == over_right, F.pmod(s["l"] + 1, over_left)).otherwise(s["l"]).alias("l"), F.pmod(s["r"] + 1, over_right).alias("r")))
    return F.aggregate(F.array(*(F.lit(i) for i in range(rounds, 0, -1))), carried, turn(-1))


def permute_digits(digits: Column, salt: Column) -> Column:
    """Another digit string of the same length; distinct ones stay distinct."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    b = n - a
    size = lambda x: F.pow(F.lit(10), x).cast("long")
    part = lambda x: F.coalesce(F.when(F.length(x) > 0, x.cast("long")), F.lit(0).cast("long"))
    out = _feistel(part(F.substring(digits, F.lit(1), a)), part(F.substring(digits, a + 1, b)), size(a), size(b), F.concat_ws("|", salt, n.cast("string")))
    return let(out, lambda s: F.concat(F.when(a > 0, F.lpad(s["l"].cast("string"), a, F.lit("0"))).otherwise(""), F.lpad(s["r"].cast("string"), b, F.lit("0"))))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, from its last digit."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _card(digits: Column, salt: Column) -> Column:
    """The digits before the last are permuted; the Luhn sum's last digit stays, which is 0 for a valid card."""
    front = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return let(permute_digits(front, salt), lambda b: F.concat(b, F.pmod(luhn_sum(digits) - luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))


def _ip(address: Column, salt: Column) -> Column:
    part = lambda x: F.concat(F.floor(x / 256).cast("string"), F.lit("."), (x % 256).cast("string"))
    halves = lambda o: _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), salt)
    return let(F.transform(F.split(address, r"\."), lambda x: x.cast("int")), lambda o: let(halves(o), lambda s: F.concat(part(s["l"]), F.lit("."), part(s["r"]))))


def _letters(hexes: Column) -> Column:
    return F.translate(hexes, "0123456789abcdef", "abdefgiklmnoprst")


def _shaped(text: Column, seed: Column) -> Column:
    """Letters become keyed letters and digits keyed digits, each by its place; other characters stay."""
    return F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c, i: F.when(c.rlike(r"\p{L}"), _letters(F.substring(seed, F.pmod(i, F.lit(64)) + 1, F.lit(1)))).when(c.rlike(r"\d"), F.translate(F.substring(seed, F.pmod(i, F.lit(64)) + 1, F.lit(1)), "abcdef", "012345")).otherwise(c),
        ),
        "",
    )


def _email(email: Column, salt: Column, level: Column) -> Column:
    local, domain = F.substring_index(email, "@", 1), F.substring_index(email, "@", -1)
    last = F.substring_index(domain, ".", -1)
    front = F.substring(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
    own = F.concat_ws("|", salt, level.cast("string"))
    name = let(_hash(own, email), lambda seed: F.concat(_shaped(local, seed), _letters(F.substring(seed, F.lit(41), F.least(12 + 2 * level, F.lit(24))))))
    return F.concat(name, F.lit("@"), let(_hash(salt, F.concat(F.lit("@"), domain)), lambda seed: _shaped(front, seed)), F.lit("."), last)


def _secret(token: Column, salt: Column, level: Column) -> Column:
    own = F.concat_ws("|", salt, level.cast("string"))
    return F.substring(F.concat(_hash(own, token), _hash(own, token, "2")), F.lit(1), F.length(token))


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"[Ѐ-ӿ]"), "cyrillic").when(word.rlike(r"[Ͱ-Ͽἀ-῿]"), "greek").otherwise("latin")


def _spelled(word: Column, salt: Column, syllables: Column) -> Column:
    """Keyed syllables in the script of the (lower-cased) word."""
    places = let(_hash(salt, word), lambda seed: F.transform(F.sequence(F.lit(0), F.least(syllables, F.lit(32)) - 1), lambda i: F.conv(F.substring(seed, 1 + 2 * i, F.lit(2)), 16, 10).cast("int") % 32))

    def spell(script: str) -> Column:
        first, second = SYLLABLES[script]
        syllable = lambda p: F.concat(F.substring(F.lit(first), F.floor(p / 4).cast("int") + 1, F.lit(1)), F.substring(F.lit(second), p % 4 + 1, F.lit(1)))
        return F.array_join(F.transform(places, syllable), "")

    script = script_of(word)
    return F.when(script == "cyrillic", spell("cyrillic")).when(script == "greek", spell("greek")).otherwise(spell("latin"))


def _surname(word: Column, salt: Column, level: Column) -> Column:
    ending = F.when(script_of(word) != "cyrillic", "").when(word.rlike("[ая]$"), "ова").otherwise("ов")
    return F.concat(_spelled(word, salt, 6 + 2 * level), ending)


def _other_given(word: Column, gender: str, salt: Column, level: Column) -> Column:
    ending = lambda script: F.lit(ENDINGS[script][gender])
    script = script_of(word)
    return F.concat(_spelled(word, salt, 4 + 2 * level), F.when(script == "cyrillic", ending("cyrillic")).when(script == "greek", ending("greek")).otherwise(ending("latin")))


#: Titles with and without a dot, and the gender that each says.
TITLED = {t + dot: gender for gender, ts in TITLES.items() for t in both_cases(ts) for dot in ("", ".")}
LISTED = [n for names in GIVEN.values() for n in names]


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def name_parts(mention: Column) -> Column:
    """(role, word) of a name's words: title, initial, known (a given name of the lists), given-f, given-m or surname."""
    titled = _literal_map(TITLED)

    def parts(words: Column) -> Column:
        gender = F.element_at(titled, words[0])
        first = F.when(gender.isNull(), 0).otherwise(1)  # where the words behind a title start
        suggested = lambda w: F.when(F.lower(w).rlike("(?:[aeаяαη]|ie|ία)$"), "given-f").otherwise("given-m")
        given = lambda w: F.when(gender == "f", "given-f").when(gender == "m", "given-m").otherwise(suggested(w))
        last = F.size(words) - 1

        def role(w: Column, i: Column) -> Column:
            known = F.array_contains(F.array(*map(F.lit, LISTED)), F.initcap(w)) & (i < last)
            return F.when((i == 0) & gender.isNotNull(), "title").when(w.rlike(r"^\p{Lu}\.$"), "initial").when(known, "known").when((i == first) & (i < last), given(w)).otherwise("surname")

        return F.transform(words, lambda w, i: F.struct(role(w, i).alias("role"), w.alias("word")))

    return let(F.split(mention, " "), parts)


class Surrogates:
    """Expressions for one key, the level of each hashed kind, and entities (kind, canon) with a level of their own."""

    def __init__(self, key: str, levels: dict[str, int] | None = None, own: dict[tuple[str, str], int] | None = None):
        self.key, self.levels, self.own = key, levels or {}, own or {}

    def salt(self, kind: str) -> Column:
        return F.lit(f"{self.key}|{kind}")

    def level(self, kind: str, canon: Column) -> Column:
        usual = F.lit(self.levels.get(kind, 0))
        mine = {c: n for (k, c), n in self.own.items() if k == kind}
        return F.coalesce(F.element_at(_literal_map(mine), canon), usual) if mine else usual

    def given(self) -> dict[str, str]:
        """Each given name to the next one of its gender and script, in the keyed order of its list."""
        out = {}
        for (gender, script), names in GIVEN.items():
            order = sorted(names, key=lambda n: hashlib.sha256(f"{self.key}|{gender}|{script}|{n}".encode()).hexdigest())
            out |= dict(zip(order, [*order[1:], order[0]], strict=True))
        return out

    def of(self, kind: Column, canon: Column) -> Column:
        """The canonical form of an entity's surrogate."""
        code, rest = F.substring_index(canon, "|", 1), F.substring_index(canon, "|", -1)
        return (
            F.when(kind == "email", _email(canon, self.salt("email"), self.level("email", canon)))
            .when(kind == "ip", _ip(canon, self.salt("ip")))
            .when(kind == "phone", F.concat(code, F.lit("|"), permute_digits(rest, F.concat_ws("|", self.salt("phone"), code))))
            .when(kind == "ssn", permute_digits(canon, self.salt("ssn")))
            .when(kind == "card", _card(canon, self.salt("card")))
            .when(kind == "secret", _secret(canon, self.salt("secret"), self.level("secret", canon)))
            .otherwise(self.word(kind, canon))
        )

    def word(self, kind: Column, canon: Column) -> Column:
        given = lambda g: _other_given(canon, g, self.salt(f"given-{g}"), self.level(f"given-{g}", canon))
        return F.when(kind == "given-f", given("f")).when(kind == "given-m", given("m")).otherwise(_surname(canon, self.salt("surname"), self.level("surname", canon)))

    def mention(self, mention: Column) -> Column:
        """What a text has in place of a mention."""
        upper = (F.upper(mention) == mention) & (F.lower(mention) != mention)

        def put(kind: Column, new: Column) -> Column:
            return F.when(kind.isin("phone", "ssn", "card"), fill(mention, F.regexp_replace(new, r"\|", ""))).when(upper, F.upper(new)).otherwise(new)

        def replace(kind: Column) -> Column:
            other = let(canonical(mention, kind), lambda canon: let(self.of(kind, canon), lambda new: put(kind, new)))
            return F.when(kind == "name", self.name(mention)).otherwise(other)

        return let(kind_of(mention), replace)

    def name(self, mention: Column) -> Column:
        listed = _literal_map(self.given())

        def made(part: Column) -> Column:
            role, w = part["role"], part["word"]
            cased = lambda new: F.when((F.upper(w) == w) & (F.length(w) > 1), F.upper(new)).otherwise(F.initcap(new))
            letter = F.concat(F.upper(F.substring(_spelled(F.lower(w), self.salt("initial"), F.lit(1)), 1, 1)), F.lit("."))
            return F.when(role == "title", w).when(role == "initial", letter).when(role == "known", let(F.element_at(listed, F.initcap(w)), cased)).otherwise(let(self.word(role, F.lower(w)), cased))

        return F.array_join(F.transform(name_parts(mention), made), " ")


def fill(mention: Column, digits: Column) -> Column:
    """The mention with its digits replaced, in order."""
    start = F.struct(F.lit("").alias("o"), F.lit(0).alias("n"))

    def put(s: Column, c: Column) -> Column:
        return F.when(c.rlike(r"\d"), F.struct(F.concat(s["o"], F.substring(digits, s["n"] + 1, F.lit(1))).alias("o"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["n"].alias("n")))

    return F.aggregate(F.split(mention, ""), start, put, lambda s: s["o"])


def entities(df: DataFrame, text: str = "text") -> DataFrame:
    """The distinct (kind, canon) of all texts, in one pass; of names each word that is made up anew."""
    found = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(ENTITY), F.lit(0))).alias("m")).groupBy("m").count()
    kind, m = F.col("kind"), F.col("m")
    words = F.transform(name_parts(m), lambda p: F.struct(p["role"].alias("kind"), F.lower(p["word"]).alias("canon")))
    one = F.array(F.struct(kind.alias("kind"), canonical(m, kind).alias("canon")))
    every = found.select("m", kind_of(m).alias("kind")).select(F.explode(F.when(kind == "name", words).otherwise(one)).alias("e")).select("e.*")
    return every.filter(~kind.isin("title", "initial", "known")).distinct()


def settle(known: DataFrame, key: str) -> Surrogates:
    """Surrogates under which no two entities (kind, canon) meet, none keeps its own and none meets a real one."""
    known = known.filter(F.col("kind").isin(*HASHED))
    levels, own = dict.fromkeys(HASHED, 0), {}
    for _ in range(MOST_ROUNDS):
        made = known.withColumn("new", Surrogates(key, levels, own).of(F.col("kind"), F.col("canon")))
        real = known.select("kind", F.col("canon").alias("new"), F.lit(True).alias("real"))
        # Names of all roles are words of one text, so a real name of any role counts.
        name = F.when(F.col("kind").isin("email", "secret"), F.col("kind")).otherwise("name")
        firsts = made.groupBy(name.alias("group"), "new").agg(F.min(F.struct("kind", "canon")).alias("first"), F.count("*").alias("n"))
        real = real.groupBy(name.alias("group"), "new").agg(F.first("real").alias("real"))
        fault = firsts.join(real, ["group", "new"], "left").filter((F.col("n") > 1) | F.col("real"))
        bad = made.withColumn("group", name).join(fault, ["group", "new"]).filter(F.col("real") | (F.struct("kind", "canon") != F.col("first"))).select("kind", "canon")
        bad = materialize(bad, "pii-unsettled")
        counts = {r["kind"]: r["count"] for r in bad.groupBy("kind").count().collect()}  # of a few kinds
        if not counts:
            return Surrogates(key, levels, own)
        wide = [k for k, n in counts.items() if n + sum(kind == k for kind, _ in own) > EXCEPTIONS]
        for k in wide:
            levels[k] += 1
            own = {e: n for e, n in own.items() if e[0] != k}
        for r in bad.filter(~F.col("kind").isin(wide) if wide else F.lit(True)).collect():  # at most EXCEPTIONS a kind
            own[r["kind"], r["canon"]] = own.get((r["kind"], r["canon"]), levels[r["kind"]]) + 1
    raise RuntimeError(f"surrogates of {sorted(counts)} still collide")


def pseudonymise(df: DataFrame, text: str = "text", key: str = KEY, count: str | None = None) -> DataFrame:
    """df with surrogates in its texts, and with `count` the number of mentions that were replaced."""
    if count and count.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input has a column named {count}")
    made = settle(materialize(entities(df, text), "pii-entities"), key)
    (pieces,) = fresh(df, "pieces_")
    marked = F.regexp_replace(F.replace(F.col(text), F.lit(MARK), F.lit(MARK + ESCAPE)), F.lit(ENTITY), F.lit(f"{MARK}1$0{MARK}2"))
    cut = df.withColumn(pieces, F.split(marked, f"{MARK}(?=[12])", -1))
    new = F.transform(F.col(pieces), lambda p, i: F.when(i == 0, p).when(p.startswith("1"), made.mention(F.substring(p, F.lit(2), F.length(p)))).otherwise(F.substring(p, F.lit(2), F.length(p))))
    joined = F.replace(F.array_join(new, ""), F.lit(MARK + ESCAPE), F.lit(MARK))
    n = F.coalesce(F.floor(F.size(pieces) / 2), F.lit(0)).cast("long")
    out = cut.withColumn(text, F.when(F.size(pieces) > 1, joined).otherwise(F.col(text)))
    if count:
        out = out.withColumn(count, F.greatest(n, F.lit(0)))
    return out.drop(pieces)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities")
