"""Byte-level BPE encoding and decoding.

The tokenizers library runs over Arrow batches: its byte table writes bytes as visible characters, its model merges them
by the ranks of the file. For ids with offsets (`encode(offsets=...)`) it takes whole texts and gives each token's offsets in
characters; for ids alone each distinct match of the pattern once, and no offsets are read. Decoding reverses that table over the characters of the vocabulary's tokens. Ids equal those of the tiktoken
library with the same ranks and pattern.

Defined cases: a null text is an empty text (no ids, zero bytes); an id outside the vocabulary raises; bytes that
end inside a character decode to exactly those bytes, and the text form shows U+FFFD there; the offsets of tokens that
share a character all hold that character; repeated rows and null keys of rows pass through unchanged; an empty table
gives an empty result; columns of the input stay, and an added column whose name the input has raises. A text of over
1 MB is cut where the pattern surely ends a piece, so that no task holds the tokens of a whole long text.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stratia.llm.common import slices, table


def byte_characters() -> list[str]:
    """The character of each byte: printable Latin-1 stays, the others count up from 256."""
    keeps = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in keeps:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, of a file with one base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def merge_rules(ranks: dict[bytes, int]) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """The vocabulary in characters of bytes, and merges that act as the ranks say.

    The ranks merge any two neighbours whose joined bytes are a token, so every split of a token into two
    tokens becomes a merge, in the order of ranks.
    """
    chars = byte_characters()
    text = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [(text[t[:i]], text[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return {text[t]: r for t, r in ranks.items()}, merges


def _members(known) -> str:
    """The characters up to U+FFFF that a compiled one-character pattern matches, as ranges of a class."""
    spans: list[list[int]] = []
    for cp in (*range(0xD800), *range(0xE000, 0x10000)):
        if known(chr(cp)):
            if spans and spans[-1][1] == cp - 1:
                spans[-1][1] = cp
            else:
                spans.append([cp, cp])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)


def piece_finder(pattern: str):
    """A function from a text to its pieces.

    The standard library's matcher is twice as fast but has no Unicode properties: they are written out for it as
    character ranges up to U+FFFF. Texts with characters beyond take the regex library.
    """
    import regex

    full, out, inside, at = regex.compile(pattern), "", False, 0
    while at < len(pattern):
        m = regex.compile(r"\\p\{\w+\}|\\[sS]|\\.|.", regex.S).match(pattern, at)
        token, at = m[0], m.end()
        if token.startswith("\\p") or token in (r"\s", r"\S"):
            members = _members(regex.compile(token.lower() if token == r"\S" else token).match)
            if token == r"\S" and inside:
                return full.findall
            token = members if inside else f"[{'^' * (token == r'\S')}{members}]"
        inside = (inside or token == "[") and token != "]"
        out += token
    fast, beyond = re.compile(out).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: full.findall(text) if beyond(text) else fast(text)


#: Distinct pieces that a task remembers with their ids, and the longest of them in characters.
REMEMBERED, LONGEST = 200_000, 48
#: Bytes of text, and ids, that a task turns at once; a longer text is cut where its pieces surely end.
SLICE, IDS = 1 << 20, 500_000
CUT = re.compile(r"(?<=\S) (?=[A-Za-z])")


def parts(text: str, most: int = SLICE) -> list[tuple[int, str]]:
    """(start, part) of a text, each of about `most` characters.

    A piece of the pattern never goes on over a space between a character that is none and a letter: such a space
    starts a piece of its own. Where there is none, a part grows until there is one.
    """
    out, at = [], 0
    while len(text) - at > most:
        m = CUT.search(text, at + most)
        if m is None:
            break
        out.append((at, text[at : m.start()]))
        at = m.start()
    return [*out, (at, text[at:])]


class ByteBpe:
    """Encoder and decoder of one rank file, for use inside a task.

    The library's tokenizer cuts texts by the pattern, writes bytes as characters, merges, and gives each token's
    offsets. Ids alone need it once a distinct piece: matches of the pattern stand alone, so texts are cut by the same
    pattern here, which takes half the time, and pieces that came before keep their ids. Decoding turns ids into bytes by the same table, reversed over the vocabulary's characters.
    """

    def __init__(self, content: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        vocab, merges = merge_rules(read_ranks(content))
        # Built from its parts: a definition as JSON takes three times the memory.
        self.tokenizer = Tokenizer(BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pieces, self.seen = piece_finder(pattern), {}
        # Each token's characters go back through the byte table once; None where there is no token.
        byte_of = {ord(c): b for b, c in enumerate(byte_characters())}
        self.bytes_of: list[bytes | None] = [None] * (max(vocab.values(), default=-1) + 1)
        for token, rank in vocab.items():
            self.bytes_of[rank] = token.translate(byte_of).encode("latin-1")
        #: Whether a token starts inside a character.
        self.inside = np.array([bool(b) and b[0] & 0xC0 == 0x80 for b in self.bytes_of])

    def _coded(self, texts: list[str]) -> Iterator[list[tuple[int, object]]]:
        """Of each text its parts: where one starts, and what the library makes of it."""
        cut = [parts(t) for t in texts]
        coded = iter(self.tokenizer.encode_batch([x for row in cut for _, x in row], add_special_tokens=False))
        for row in cut:
            yield [(start, next(coded)) for start, _ in row]

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and, of each, the first character that its bytes touch and the one after the last."""
        return [([i for _, e in row for i in e.ids], [(a + start, b + start) for start, e in row for a, b in e.offsets]) for row in self._coded(texts)]

    def encode_with_ends(self, texts: list[str]) -> list[tuple[list[int], int]]:
        """Ids, and the summed length of the pieces in characters, where the last one ends."""
        split = [self.pieces(t) for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        new = list({*chain.from_iterable(split)}.difference(self.seen))
        ids = {p: e.ids for p, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True)}
        self.seen.update((p, x) for p, x in ids.items() if len(p) <= LONGEST)
        known = ChainMap(self.seen, ids) if any(len(p) > LONGEST for p in new) else self.seen
        return [(list(chain.from_iterable(map(known.__getitem__, row))), sum(map(len, row))) for row in split]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids for ids, _ in self.encode_with_ends(texts)]

    def decode(self, ids: list[int]) -> bytes:
        try:
            if len(ids) and min(ids) < 0:
                raise IndexError
            return b"".join(map(self.bytes_of.__getitem__, ids))
        except (IndexError, TypeError):
            raise ValueError("an id is not in the vocabulary") from None

    def inside_characters(self, ids: list[int]) -> int:
        """How many tokens start inside a character."""
        return int(self.inside[ids].sum()) if len(ids) else 0


@lru_cache(maxsize=2)
def _coder(content: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(content, pattern)


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    """The rank file (a fixed file of less than a megabyte) and the pattern, sent once to each executor."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        content = f.read()
    if len(content) > 64 << 20:
        raise ValueError("a rank file of over 64 MB is not sent to executors")
    return spark.sparkContext.broadcast((content, pattern or public_tokenizers.PATTERN))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", offsets: str | None = None, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with the ids of each text, and with `offsets` also each token's (start, end) in characters."""
    clash = [c for c in (ids, offsets) if c and c.lower() in {x.lower() for x in df.columns}]
    if clash:
        raise ValueError(f"the input has a column named {clash[0]}")
    shared = _vocabulary(df.sparkSession, ranks, pattern)
    pair = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    if offsets:
        schema.add(offsets, T.ArrayType(pair))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(*shared.value)
        for b in slices(batches, text, SLICE):
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            found = coder.encode_with_offsets(texts) if offsets else coder.encode_with_ends(texts)
            added = [_lists([x for x, _ in found])]
            if offsets:
                added.append(pa.array([[{"start": a, "end": e} for a, e in y] for _, y in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=schema.names)

    return df.mapInArrow(run, schema)


def _lists(rows: list[list[int]]) -> pa.Array:
    ends = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in rows], out=ends[1:])
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in rows]) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """df (or its columns `keep`) with the bytes that each row's ids stand for; null ids give no bytes."""
    keep = list(keep if keep is not None else df.columns)
    if decoded.lower() in {c.lower() for c in keep}:
        raise ValueError(f"the input has a column named {decoded}")
    shared = _vocabulary(df.sparkSession, ranks, pattern)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(*shared.value)
        for whole in batches:
            counts = pc.fill_null(pc.list_value_length(whole.column(whole.schema.get_field_index(ids))), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(counts) // IDS)) + 1
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows], strict=True):
                b = whole.slice(at, end - at)
                out = pa.array([coder.decode(x.values.to_pylist() if x.is_valid else []) for x in b.column(b.schema.get_field_index(ids))], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), out], names=schema.names)

    return df.mapInArrow(run, schema)


def decoded_text(decoded: bytes) -> str:
    """Text of decoded bytes; a character that the ids hold only in part shows as U+FFFD."""
    return decoded.decode("utf-8", errors="replace")


def round_trip(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text; one row per row, with counts and digests of both directions.

    n_characters is the summed length of the pieces, n_split how many tokens start inside a character.
    Both directions run in one pass over small slices, so that no list of ids leaves its task.
    """
    shared = _vocabulary(df.sparkSession, None, None)
    long, string = T.LongType(), T.StringType()
    schema = T.StructType([df.schema[id_column], *(T.StructField(n, t) for n, t in (("n_tokens", long), ("ids_sha256", string), ("decoded_sha256", string), ("n_characters", long), ("n_split", long)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(*shared.value)
        number = [str(i) for i in range(len(coder.bytes_of))].__getitem__
        for b in slices(batches, text, SLICE):
            found = coder.encode_with_ends([t or "" for t in b.column(1).to_pylist()])
            rows, ends = [x for x, _ in found], [y for _, y in found]
            listed = [hashlib.sha256(" ".join(map(number, ids)).encode()).hexdigest() for ids in rows]
            decoded = [hashlib.sha256(coder.decode(ids)).hexdigest() for ids in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, rows)), pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string()), pa.array(ends, pa.int64()), pa.array(list(map(coder.inside_characters, rows)), pa.int64())], names=schema.names)

    return df.select(id_column, text).mapInArrow(run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
