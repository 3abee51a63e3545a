"""Language-model scores of texts: a subword lattice over an existing unigram vocabulary.

The vocabulary's pieces are given with scores, which weigh all segmentations: a piece's prior is 1 / (1 + |score|), made
to sum to one. A word's probability is the sum over all its segmentations into pieces, by a forward recursion in log
space; a text's is the product over its words and one end. Characters outside the vocabulary go through its byte
pieces. The model learns from the training texts by expectation maximisation over all segmentations, in which the
prior counts as PRIOR uses beside those of the texts: more text outweighs it. Returned are

* `score`: the marginal probability of the text under the fitted pieces;
* `vocabulary_score`: the same under the vocabulary's own scores, without any learning;
* `mixed_score`: with each training word as one more edge of its own, with its discounted frequency. The discount's
  mass goes to the ways through pieces: P(word) = (count - d) / N + d * V / N * P(ways through pieces), with
  d = n1 / (n1 + 2 n2) from the words seen once and twice.

Plan: one pass over the texts makes blocks (a few thousand documents each). A block keeps its tokens as numbers,
and hands out each distinct word once with its training count. Words are counted over all blocks, scored once each in
the lattice, and joined back to the blocks by word; one shuffle by block returns the values to the numbers. A very
common word is thus one row a block, not one a use, and nothing but the piece probabilities (a fixed size) reaches
the driver.

Tokens: words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and one end a text. Base score: add-a-half word frequencies.

Defined cases: a null text is an empty text, of one token; a null id counts as the text '' in the fold and its rows
keep a null id; repeated rows count and score like any other; without training tokens the base has probability one
a token and the lattice the vocabulary's weights; words of any length are summed whole, in pieces of bounded memory; an
empty table gives an empty result. Other columns of the input play no part, so that their names cannot clash.
"""

from __future__ import annotations

import math
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratia.llm.common import fold, slices, table
from stratia.session import materialize, shuffle_partitions

FOLDS, HELD, EM_ROUNDS, PRIOR = 5, 1, 2, 10_000.0
#: Bytes of text in a block, characters that the lattice takes at once, and the longest word that goes in step with others.
BLOCK, AT_ONCE, IN_STEP = 16 << 20, 100_000, 48
SPACE, END = "▁", "</s>"


class Vocabulary:
    """Pieces as a tree of characters, and starting log-probabilities from the scores of the file.

    The tree's steps are one open-addressing table, so that many words take a step in a few array operations.
    """

    BITS, EMPTY = 20, np.uint64((1 << 64) - 1)

    def __init__(self, pieces: tuple[str, ...], scores: tuple[float, ...]):
        named = {p: i for i, p in enumerate(pieces)}
        plain = {p: i for p, i in named.items() if not (p.startswith("<") and p.endswith(">") and len(p) > 2)}
        self.byte, self.end = [named[f"<0x{b:02X}>"] for b in range(256)], named[END]
        weight = 1 / (1 + np.minimum(np.abs(np.array(scores)), 1e9))  # the scores are minus a piece's rank
        weight[[self.end, *self.byte]] = weight.min()
        used = np.zeros(len(pieces), bool)
        used[[*plain.values(), *self.byte, self.end]] = True
        weight[~used] = 0
        with np.errstate(divide="ignore"):
            self.start = np.log(weight / weight.sum())
        steps: dict[int, int] = {}
        piece_of = [-1]
        self.longest = max(map(len, plain), default=1)
        for p, i in plain.items():
            node = 0
            for c in p:
                node = steps.setdefault(node << 21 | ord(c), len(piece_of))
                if node == len(piece_of):
                    piece_of.append(-1)
            piece_of[node] = i
        self.piece_of = np.array(piece_of)
        if len(steps) > 1 << self.BITS - 2:
            raise ValueError("the vocabulary is too large for its table")
        self.keys, self.next = np.full(1 << self.BITS, self.EMPTY), np.zeros(1 << self.BITS, np.int64)
        keys = np.fromiter(steps, np.uint64, len(steps))
        for key, at, to in zip(keys.tolist(), self._place(keys).tolist(), steps.values(), strict=True):
            while self.keys[at] != self.EMPTY:
                at = at + 1 & (1 << self.BITS) - 1
            self.keys[at], self.next[at] = key, to

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The node that each character leads to, -1 where there is none."""
        keys = nodes.astype(np.uint64) << np.uint64(21) | codes.astype(np.uint64)
        out, todo, at = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._place(keys)
        while len(todo):
            found = self.keys[at]
            hit = found == keys
            out[todo[hit]] = self.next[at[hit]]
            more = ~hit & (found != self.EMPTY)
            todo, keys, at = todo[more], keys[more], at[more] + 1 & (1 << self.BITS) - 1
        return out


@lru_cache(maxsize=2)
def _vocabulary(pieces: tuple[str, ...], scores: tuple[float, ...]) -> Vocabulary:
    return Vocabulary(pieces, scores)


def load_vocabulary(path: str | None = None) -> tuple[tuple[str, ...], tuple[float, ...]]:
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    n = model.get_piece_size()
    return tuple(model.id_to_piece(i) for i in range(n)), tuple(model.get_score(i) for i in range(n))


class Lattice:
    """Forward and backward recursions in log space, over all segmentations of many words.

    Words stand one behind another as characters; a word of n characters has n + 1 nodes. All edges are found by as
    many steps as the longest piece has characters, from every character at once. Words of up to IN_STEP characters then
    sum in step, node by node; a longer one alone, in windows.
    """

    def __init__(self, vocabulary: Vocabulary, *logp: np.ndarray):
        self.v, self.logp = vocabulary, logp[0]
        self.every = np.stack(logp)  # weights by which words are scored, all with the same edges
        self.ways: dict[int, np.ndarray] = {}

    def _batches(self, words: list[str]) -> Iterator[list[int]]:
        """Places of words, by length, with about AT_ONCE characters in each batch; long words alone."""
        batch, size = [], 0
        for i in sorted(range(len(words)), key=lambda i: len(words[i])):
            n = len(words[i]) + 1
            if batch and (size + n > AT_ONCE or n > IN_STEP):
                yield batch
                batch, size = [], 0
            batch.append(i)
            size += n
        if batch:
            yield batch

    def _bytes(self, code: int) -> np.ndarray:
        """Log-probabilities of a character by its bytes' pieces, for each set of weights."""
        if code not in self.ways:
            self.ways[code] = self.every[:, [self.v.byte[b] for b in chr(code).encode()]].sum(axis=1)
        return self.ways[code]

    def _edges(self, codes: np.ndarray, stop: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece, weights) of the edges from the first `starts` characters; piece -1 stands for bytes.

        stop: of each character the end of its word.
        """
        at, nodes, found = np.arange(starts), np.zeros(starts, np.int64), []
        for j in range(self.v.longest):
            nodes = self.v.step(nodes, codes[at + j])
            piece = np.where(nodes < 0, -1, self.v.piece_of[nodes])
            hit = piece >= 0
            found.append((at[hit], np.full(int(hit.sum()), j + 1), piece[hit], self.every[:, piece[hit]]))
            if j == 0 and not hit.all():
                lone, place = np.unique(codes[~hit], return_inverse=True)
                ways = np.array([self._bytes(c) for c in lone.tolist()]).T
                found.append((at[~hit], np.ones(len(place), np.int64), np.full(len(place), -1), ways[:, place]))
            alive = (nodes >= 0) & (at + j + 1 < stop[at])
            at, nodes = at[alive], nodes[alive]
            if not len(at):
                break
        return tuple(np.concatenate([f[i] for f in found], axis=-1) for i in range(4))

    @staticmethod
    def _sums(key: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, out: np.ndarray) -> None:
        """out[b] = log of the sum of exp(out[a] + w) over the edges of each b; edges go by rising key, whole keys at a time."""
        order = np.lexsort((b, key))
        key, a, b, w = key[order], a[order], b[order], w[:, order]
        cuts = np.flatnonzero(np.diff(key)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            x, to = out[:, a[s:e]] + w[:, s:e], b[s:e]
            first = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1])
            most = np.maximum.reduceat(x, first, axis=1)
            sizes = np.diff(np.append(first, e - s))
            out[:, to[first]] = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, sizes, axis=1)), first, axis=1))

    def _lattice(self, words: list[str]):
        """Edges of a batch of words: (start node, end node, piece, weights, depth of start, depth of end), nodes by word."""
        size = np.array([len(w) + 1 for w in words])
        codes = np.frombuffer("".join(SPACE + w for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), size)
        stop = np.cumsum(size)
        start, length, piece, w = self._edges(codes, stop[owner], len(codes))
        depth = start - (stop - size)[owner[start]]
        node = start + owner[start]  # each word before this one has one node more than characters
        return node, node + length, piece, w, depth, depth + length, size[owner[start]], codes[start], owner[start], stop - size + np.arange(len(words)), stop + np.arange(len(words))

    def scores(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability over all segmentations, a row for each set of weights."""
        out = np.zeros((len(self.every), len(words)))
        for rows in self._batches(words):
            part = [words[i] for i in rows]
            if len(part) == 1 and len(part[0]) >= IN_STEP:
                out[:, rows[0]] = self._ahead(part[0])[:, -1]
                continue
            a, b, _, w, _, depth, _, _, _, first, last = self._lattice(part)
            sums = np.full((len(self.every), int(last[-1]) + 1), -np.inf)
            sums[:, first] = 0
            self._sums(depth, a, b, w, sums)
            out[:, rows] = sums[:, last]
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """The scores under the first weights."""
        return self.scores(words)[0]

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the counted words, under the first weights."""
        total = np.zeros(len(self.logp))
        for rows in self._batches(words):
            part = [words[i] for i in rows]
            if len(part) == 1 and len(part[0]) >= IN_STEP:
                self._expect_long(part[0], float(counts[rows[0]]), total)
                continue
            a, b, piece, w, near, far, size, code, owner, first, last = self._lattice(part)
            ahead, behind = (np.full((len(self.every), int(last[-1]) + 1), -np.inf) for _ in range(2))
            ahead[:, first] = 0
            behind[:, last] = 0
            self._sums(far, a, b, w, ahead)
            self._sums(size - near, b, a, w, behind)
            share = np.exp(ahead[0, a] + w[0] + behind[0, b] - ahead[0, last[owner]]) * counts[np.array(rows)[owner]]
            self._count(piece, code, share, total)
        return total

    def _count(self, piece: np.ndarray, code: np.ndarray, share: np.ndarray, total: np.ndarray) -> None:
        known = piece >= 0
        total += np.bincount(piece[known], share[known], minlength=len(total))
        lone, place = np.unique(code[~known], return_inverse=True)
        for c, x in zip(lone.tolist(), np.bincount(place, share[~known], minlength=len(lone)).tolist(), strict=True):
            for b in chr(c).encode():
                total[self.v.byte[b]] += x

    def _windows(self, word: str, back: bool = False) -> Iterator[tuple[int, np.ndarray, tuple]]:
        """(first character, characters, edges that start there) of a long word, window by window."""
        codes = np.frombuffer((SPACE + word).encode("utf-32-le"), np.uint32)
        places = range(0, len(codes), AT_ONCE)
        for at in reversed(places) if back else places:
            part = codes[at : at + AT_ONCE + self.v.longest].astype(np.int64)
            start, length, piece, w = self._edges(part, np.full(len(part), len(part)), min(AT_ONCE, len(codes) - at))
            order = np.argsort(start, kind="stable")
            yield at, part, (start[order], length[order], piece[order], w[:, order])

    def _ahead(self, word: str) -> np.ndarray:
        """Of each node of a long word the log of the summed probability of the ways to it."""
        out = np.full((len(self.every), len(word) + 2), -np.inf)
        for k in range(len(self.every)):
            sums = array("d", [-math.inf]) * (len(word) + 2)
            sums[0] = 0.0
            for at, _, (start, length, _, w) in self._windows(word):
                for s, n, x in zip(start.tolist(), length.tolist(), w[k].tolist(), strict=True):
                    x += sums[at + s]
                    now = sums[at + s + n]
                    sums[at + s + n] = x + math.log1p(math.exp(now - x)) if x > now else now + math.log1p(math.exp(x - now)) if x > -math.inf else now
            out[k] = sums
        return out

    def _expect_long(self, word: str, count: float, total: np.ndarray) -> None:
        ahead = self._ahead(word)[0]
        behind = array("d", [-math.inf]) * len(ahead)
        behind[-1] = 0.0
        for at, codes, (start, length, piece, w) in self._windows(word, back=True):
            for s, n, x in zip(start[::-1].tolist(), length[::-1].tolist(), w[0, ::-1].tolist(), strict=True):
                x += behind[at + s + n]
                now = behind[at + s]
                behind[at + s] = x + math.log1p(math.exp(now - x)) if x > now else now + math.log1p(math.exp(x - now)) if x > -math.inf else now
            known = np.frombuffer(behind, np.float64)
            share = np.exp(ahead[at + start] + w[0] + known[at + start + length] - ahead[-1]) * count
            self._count(piece, codes[start], share, total)


BLOCKS = T.StructType([T.StructField("block", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("body", T.BinaryType())])


def blocks(df: DataFrame, key: str, text: str, held: str) -> DataFrame:
    """Rows of two kinds: i = -1 has a block's documents and tokens, i >= 0 its i-th word with its training count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, BLOCK):
            keys, texts, out = b.column(0), b.column(1), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            seen: dict[bytes, int] = {}
            parts = []
            for t in texts:
                words = (t.as_py() or "").encode().lower().split()  # of bytes: A-Z alone, and 0x20, 0x09-0x0D alone
                parts.append(np.array([seen.setdefault(w, len(seen)) for w in words], np.int32))
            sizes = np.array([len(p) for p in parts], np.int64)
            flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
            trains = np.bincount(flat[np.repeat(~out, sizes)], minlength=len(seen))
            kept = pa.RecordBatch.from_arrays([keys, pa.array(out)], names=["key", "held"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as w:
                w.write_batch(kept)
            head = sink.getvalue().to_pybytes()
            body = len(head).to_bytes(8, "little") + head + len(sizes).to_bytes(8, "little") + sizes.tobytes() + flat.tobytes()
            name = uuid.uuid4().int >> 65
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int32()), pa.array([None], pa.string()), pa.array([int((~out).sum())], pa.int64()), pa.array([zlib.compress(body, 1)], pa.binary())], names=BLOCKS.names)
            words = pa.array(list(seen), pa.binary()).cast(pa.string())
            for at in range(0, len(words), 50_000):
                n = min(50_000, len(words) - at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name, np.int64)), pa.array(np.arange(at, at + n, dtype=np.int32)), words[at : at + n], pa.array(trains[at : at + n].astype(np.int64)), pa.nulls(n, pa.binary())], names=BLOCKS.names)

    return df.select(key, text, held).mapInArrow(run, BLOCKS)


def _unpack(body: bytes) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    data = zlib.decompress(body)
    n = int.from_bytes(data[:8], "little")
    kept = pa.ipc.open_stream(data[8 : 8 + n]).read_next_batch()
    docs = int.from_bytes(data[8 + n : 16 + n], "little")
    sizes = np.frombuffer(data, np.int64, docs, 16 + n)
    return kept, sizes, np.frombuffer(data, np.int32, -1, 16 + n + 8 * docs)


def fit(words: DataFrame, ends: int, vocabulary: tuple[list[str], list[float]], rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log-probabilities of the pieces, from (word, n) with training counts n and the number of ends."""
    pieces, scores = vocabulary
    known = _vocabulary(pieces, scores)
    logp = known.start
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast((vocabulary, logp))
        found = words.filter("n > 0").mapInArrow(_expect(shared), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()  # at most one row a piece
        uses = np.zeros(len(pieces))
        for r in found:
            uses[r["piece"]] = r["uses"]
        uses[known.end] += ends
        if not uses.sum():
            return logp
        uses += PRIOR * np.exp(known.start)
        with np.errstate(divide="ignore"):
            logp = np.log(uses / uses.sum())
    return logp


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, logp = shared.value
        lattice, total = Lattice(_vocabulary(*vocabulary), logp), np.zeros(len(logp))
        for b in batches:
            total += lattice.expected(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "uses"])

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, logp = shared.value
        known = _vocabulary(*vocabulary)
        lattice = Lattice(known, logp, known.start)
        for b in batches:
            lp = lattice.scores(b.column(0).to_pylist()) / np.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lp[0]), pa.array(lp[1].astype(np.float32))], names=["word", "n", "lp", "vp"])

    return run


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", held: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score, mixed_score) of each row; rows with `held` don't train."""
    spark = df.sparkSession
    pieces = load_vocabulary(vocabulary)
    rows = df.select(F.col(key), F.col(text), (F.lit(False) if held is None else F.coalesce(F.col(held), F.lit(False))).alias("held_"))
    cut = materialize(blocks(rows, key, text, "held_"), "lattice-blocks")
    words = materialize(cut.filter("i >= 0").groupBy("word").agg(F.sum("n").alias("n")), "lattice-words")
    ends = cut.filter("i < 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    seen = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).first()
    tokens, distinct = seen["n"] + ends, seen["v"] + (ends > 0)
    discount = seen["n1"] / (seen["n1"] + 2 * seen["n2"]) if seen["n1"] else 0.5
    logp = fit(words, ends, pieces)
    shared = spark.sparkContext.broadcast((pieces, logp))
    scored = words.mapInArrow(_score(shared), "word string, n long, lp double, vp float")
    values = cut.filter("i >= 0").select("block", "i", "word").join(scored, "word").select("block", "i", "n", "lp", "vp", F.lit(None).cast("binary").alias("body"))
    nothing = F.lit(None).cast("double")
    bodies = cut.filter("i < 0").select("block", "i", F.lit(None).cast("long").alias("n"), nothing.alias("lp"), nothing.cast("float").alias("vp"), "body")
    together = values.union(bodies).repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", "i")
    end_lp, end_vp = (float(x[pieces[0].index(END)] / np.log(10)) for x in (logp, _vocabulary(*pieces).start))
    schema = T.StructType([df.schema[key], *(T.StructField(n, t) for n, t in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("vocabulary_score", T.DoubleType()), ("mixed_score", T.DoubleType())))])

    def whole(c, lp):
        """log10 of a token's probability from its training count and that of its ways through pieces."""
        if not tokens:
            return lp
        return np.log10(np.maximum(c - discount, 0) / tokens + discount * distinct / tokens * 10.0**lp + 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: a block's body, then its words in order."""
        body, counts, lps, vps = None, [], [], []

        def finish() -> pa.RecordBatch:
            kept, sizes, flat = _unpack(body)
            c = np.concatenate([*counts, np.empty(0, np.int64)]).astype(np.int64)
            lp, vp = (np.concatenate([*x, np.empty(0)]) for x in (lps, vps))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            base = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
            total = lambda x: np.bincount(owner, x[flat], minlength=len(sizes))
            base_end = np.log10((ends + 0.5) / (tokens + 0.5 * (distinct + 1)))
            columns = [pa.array(sizes + 1), pa.array(total((c > 0).astype(np.float64)).astype(np.int64) + (ends > 0)), pa.array(np.full(len(sizes), tokens, np.int64)), pa.array(total(base) + base_end), pa.array(total(lp) + end_lp), pa.array(total(vp) + end_vp), pa.array(total(whole(c, lp)) + whole(ends, end_lp))]
            return pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), *columns], names=schema.names)

        for b in batches:
            i = b.column(1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(i < 0).tolist()
            for s, e in zip([0, *starts], [*starts, len(i)], strict=True):
                if e > s and i[s] < 0:
                    if body is not None:
                        yield finish()
                    body, counts, lps, vps, s = b.column(5)[s].as_py(), [], [], [], s + 1
                if e > s:
                    for kept, column in ((counts, 2), (lps, 3), (vps, 4)):
                        kept.append(b.column(column)[s:e].to_numpy(zero_copy_only=False))
        if body is not None:
            yield finish()

    return together.mapInArrow(run, schema)


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", FOLDS) == HELD).alias("held"))
    return score_texts(docs, held="held")
