"""Sharding by a permutation-filled lookup table. DataFrame functions only on the rows' path.

Each shard has a permutation of the slots of a prime-sized table, (offset + j * skip) mod size from two digests of its
name; shards take turns, each claiming the next free slot of its permutation, and a shard of weight w takes w turns a
round. A row's digest gives a slot, the slot's entry its shard. The table has a fixed size whatever the rows are: it is
built once, and goes to the executors as one literal array inside the plan, where a lookup is one index. When a shard
goes, its slots are dealt to the others and few other rows move.

Defined cases: a null key goes where the empty text goes; equal keys go to one shard; repeated rows stay; an empty
table gives an empty result. The text takes no part, so its length and nulls do not matter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.llm.common import table

#: Slots (a prime, over 100 for each shard) and shards of the registered query.
SLOTS, SHARDS = 65537, 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """Of each slot the index of its shard."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime, not below the number of shards")
    numbers = [[int.from_bytes(hashlib.md5(f"{way}:{s}".encode()).digest()[:8], "big") for way in ("offset", "skip")] for s in shards]
    at, skip = [a % slots for a, _ in numbers], [b % (slots - 1) + 1 for _, b in numbers]
    turns = [i for i, w in enumerate(weights or [1] * len(shards)) for _ in range(w)]
    if not turns:
        raise ValueError("a shard needs a positive weight")
    out, free = [-1] * slots, slots
    while True:
        for i in turns:
            while out[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            out[at[i]] = i
            free -= 1
            if not free:
                return out


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its text's digest, modulo the number of slots."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS, weights: list[int] | None = None, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with the slot and the shard's name of each row's key; no shuffle."""
    clash = {slot.lower(), shard.lower()} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"the input has a column named {min(clash)}")
    shards = shards or default_shards()
    entries = F.split(F.lit(",".join(map(str, fill(shards, slots, weights)))), ",").cast("array<int>")
    names = F.array(*map(F.lit, shards))
    out = df.withColumn(slot, slot_of(F.col(key), slots))
    return out.withColumn(shard, F.get(names, F.get(entries, F.col(slot))))


def default_shards(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"))


def op2_sql() -> str:
    entries = ",".join(map(str, fill(default_shards())))
    return f"""
        WITH placed AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} AS INTEGER) AS slot FROM documents),
        entries AS (SELECT unnest(range({SLOTS})) AS slot, unnest(string_split('{entries}', ',')) AS entry)
        SELECT doc_id, CAST(p.slot AS INTEGER) AS slot, 'shard-' || lpad(entry, 3, '0') AS shard FROM placed p JOIN entries e ON p.slot = e.slot
    """
