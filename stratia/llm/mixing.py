"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share a budget; a target stops at
`most` times its source's size and the excess goes to the others by weight (a water level, found in rounds of sums over
one row a source). A target over a source's size makes its rate: the whole part of the rate is copies that every
document gets for certain, the rest is the inclusion probability p of one more copy.

Rates differ inside a source: short documents are taken more often than long ones, so that no few long texts make up a
source. By default a document's rate goes with the fourth root of its size class (sizes of as many binary digits), or
with a column that the caller names. Rates over `most` stop there and the others share what is left.

The sample: u is a document's random number, from a keyed digest of its id and text; documents rank by the random odds
u/(1-u) divided by the inclusion odds p/(1-p), and a source's smallest ranks are taken until its remaining words
are used up. Where to cut is found without sorting a source: word sums over bins of the rank, twice refined, then
a running sum inside one last bin. Long documents (over a hundredth of the words still to be drawn) are drawn
first in the same way, and what they took corrects the cut of the others, so that one long document at the
boundary does not move the total.

Defined cases: a null text has size 0 and may be taken with 0 words; sources without words get target 0; a null id counts
as the empty text; rows that share id and text are alike and share a rank: of those at the cut as many are taken as fit,
numbered in salted groups, and which of them is not fixed; repeated rows are documents of their own; an empty table gives
an empty result; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratia.functions.numbering import numbered
from stratia.llm.common import table
from stratia.session import checkpoint, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, LONG = (5, 2, 1), 3, 0.01
#: The rates of sizes of 1, 2, ... binary digits, in steps of 1/64 so that sums of sizes by rate are exact; the last is for all above.
BY_SIZE = "by size"
SIZE_RATES = [round(1024 * 2 ** (-digits / 4)) / 64 for digits in range(1, 41)]
#: Rows of a table with one row a source up to which it is broadcast.
BROADCAST_ROWS = 100_000


def words(text: str = "text") -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """(source, source_size, target), from one row a source: (source, source_size).

    The water level rises in rounds: sources whose cap lies below their part of it stop there, and the others share
    what is left, until no more stop. Each round is one sum over the sources, however many there are.
    """
    known = numbered(sizes.select("source", "source_size"), F.col("source").asc_nulls_last())
    known = known.select("source", "source_size", (F.col("source_size") * most).alias("cap"), F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")).cast("long").alias("w"))
    known = checkpoint(known)
    budget, stopped, level = (known.agg(F.sum("source_size")).first()[0] or 0) * share, F.lit(False), None
    while True:
        sums = known.agg(F.coalesce(F.sum(F.when(stopped, F.col("cap"))), F.lit(0)).alias("cap"), F.coalesce(F.sum(F.when(~stopped, F.col("w"))), F.lit(0)).alias("w")).first()
        if not sums["w"] or (now := (budget - sums["cap"]) / sums["w"]) == level:
            break
        level = now
        stopped = F.col("cap") <= F.lit(float(level)) * F.col("w")
    target = F.when(stopped, F.col("cap").cast("double")).otherwise(F.lit(float(level or 0)) * F.col("w"))
    return known.select("source", "source_size", target.alias("target"))


def random_number(key: str, seed: str) -> Column:
    """A number strictly between 0 and 1 from a keyed digest of the id's text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def small(df: DataFrame) -> DataFrame:
    """A checkpointed table of one row a source: broadcast if it is counted as small, else left to a shuffle join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _cuts(rows: DataFrame, rooms: DataFrame) -> DataFrame:
    """(cell, cut_key, cut_id, cut_size, cut_n, cut_m): the last row of the order that each cell takes.

    rows: cell, key, id, size, n (how many rows are alike); rooms: cell, room, the words to take. A row is taken if
    the middle of its words lies in the room; of the cut_n last rows, which are alike, cut_m are.
    """
    held = rooms.select("cell", "room", F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("bin"))
    taken = F.col("size") * F.col("n")
    inside, shift = rows, 0
    for shift in (40, 30):
        sums = inside.groupBy("cell", F.shiftright("key", shift).alias("at")).agg(F.sum(taken).alias("words"))
        run = Window.partitionBy("cell").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(run)).join(held, "cell").filter(F.col("done") + F.col("upto") > F.col("room"))
        first = sums.groupBy("cell").agg(F.min(F.struct("at", (F.col("done") + F.col("upto") - F.col("words")).alias("done"))).alias("first"))
        held = small(checkpoint(rooms.join(first, "cell").select("cell", "room", "first.done", F.col("first.at").alias("bin"))))
        inside = rows.join(held.select("cell", "bin"), "cell").filter(F.shiftright("key", shift) == F.col("bin")).select(rows.columns)
    order = Window.partitionBy("cell").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.groupBy("cell", "key", "id", "size").agg(F.sum("n").alias("n"))
    left = F.col("room") - F.col("done") - (F.col("upto") - taken)
    fits = F.when(F.col("size") == 0, F.when(left >= 0, F.col("n")).otherwise(0)).otherwise(F.least(F.col("n"), F.floor(left / F.col("size") + 0.5)))
    last = last.withColumn("upto", F.sum(taken).over(order)).join(held, "cell").withColumn("m", fits).filter("m >= 1")
    last = last.groupBy("cell").agg(F.max(F.struct("key", "id", "size", "n", "m")).alias("last"))
    found = rooms.select("cell").join(held.select("cell", "bin"), "cell", "left").join(last, "cell", "left")
    edge = F.when(F.col("bin").isNull(), F.lit(1 << 51)).otherwise(F.shiftleft("bin", shift))
    return checkpoint(found.select("cell", F.coalesce("last.key", edge).alias("cut_key"), F.col("last.id").alias("cut_id"), F.col("last.size").alias("cut_size"), F.col("last.n").alias("cut_n"), F.col("last.m").alias("cut_m")))


def _before_cut() -> Column:
    """Whether a row stands before its cell's cut; without a last row, what stands before the bin."""
    k, i = F.col("key"), F.col("id")
    return (k < F.col("cut_key")) | ((k == F.col("cut_key")) & F.coalesce((i < F.col("cut_id")) | ((i == F.col("cut_id")) & (F.col("size") < F.col("cut_size"))), F.lit(False)))


def _at_cut() -> Column:
    return F.coalesce((F.col("key") == F.col("cut_key")) & (F.col("id") == F.col("cut_id")) & (F.col("size") == F.col("cut_size")), F.lit(False))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with their `place` from 1 inside their cell, in any order; a cell's rows are spread over salted groups."""
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shuffle_partitions(rows.sparkSession))).alias("salt")
    held = checkpoint(rows.select("*", salt))
    before = Window.partitionBy("cell").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy("cell", "salt").agg(F.count("*").alias("c")).withColumn("first", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    inside = F.row_number().over(Window.partitionBy("cell", "salt").orderBy(F.lit(0)))
    return held.withColumn("inside", inside).join(counts, ["cell", "salt"]).withColumn("place", F.col("first") + F.col("inside")).drop("salt", "first", "inside")


class Plan:
    """What decides a mix: one row a source, and one cut for each source's long and other documents."""

    def __init__(self, sources: DataFrame, cuts: DataFrame, seed: str, most: int):
        self.sources, self.cuts, self.seed, self.most = sources, cuts, seed, most
        #: Whether a cut goes through rows that are alike.
        self.partial = not cuts.filter("cut_m < cut_n").isEmpty()


def _documents(df: DataFrame, key: str, text: str, source: str, boost: str | None, *more: Column) -> DataFrame:
    """(id, src, size, boost, more) of each row; id tells rows apart by key and text."""
    own = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    out = df.select(*more, own.alias("id"), _source(F.col(source)).alias("src"), words(text).alias("size"), F.lit(1.0).alias("boost") if boost in (None, BY_SIZE) else _stepped(F.col(boost)).alias("boost"))
    if boost == BY_SIZE:
        digits = F.least(F.length(F.bin("size")), F.lit(len(SIZE_RATES)))
        out = out.withColumn("boost", F.element_at(F.array(*map(F.lit, SIZE_RATES)), digits))
    return out


def _stepped(boost: Column) -> Column:
    return (F.greatest(F.lit(1.0), F.least(F.lit(4096.0), F.round(F.coalesce(boost, F.lit(1.0)) * 64))) / 64).cast("double")


def _binary(x: Column) -> Column:
    """A number of words down to a step of 1/1024, so that the order of a sum does not show."""
    return F.floor(x * 1024) / 1024


def _source(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), column), F.lit("n"))


def _ranked(docs: DataFrame, sources: DataFrame, seed: str, most: int) -> DataFrame:
    """docs (id, src, size, boost) with the copies that are certain, p of one more, and the rank's key and cell."""
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("rate") * F.col("boost"))).otherwise(0.0)
    out = docs.join(sources.drop("source"), "src").withColumn("copies", F.floor(rate)).withColumn("p", rate - F.col("copies"))
    u = random_number("id", seed)
    odds = u / (1 - u) * (1 - F.col("p")) / F.col("p")
    key = F.when(F.col("p") > 0, F.floor(odds / (1 + odds) * F.lit(float(1 << 50))))
    return out.withColumn("key", key).withColumn("cell", F.concat(F.col("src"), F.when(F.col("size") > F.col("long_from"), "+").otherwise("-")))


def plan(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", boost: str | None = BY_SIZE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0, seed: str = "mix") -> tuple[Plan, DataFrame]:
    """The plan of a mix, and the checkpointed (key0, source, id, src, size, boost) of each document.

    boost says how a document's rate differs within its source: by its size, by a positive column of that name (in steps
    of 1/64 up to 64, so that a source has a bounded number of levels; null counts as 1), or not at all (None).
    """
    docs = checkpoint(_documents(df, key, text, source, boost, F.col(key).alias("key0"), F.col(source).alias("source")))
    levels = checkpoint(docs.groupBy("source", "src", "boost").agg(F.sum("size").alias("size")))
    known = targets(levels.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, share).withColumn("src", _source(F.col("source")))
    # A source's rate: boosts from the largest down stop at `most` copies; the others share what is left.
    down = Window.partitionBy("src").orderBy(F.col("boost").desc())
    before, behind = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    of_level = levels.drop("source").join(known, "src")
    of_level = of_level.withColumn("rate", F.try_divide(F.col("target") - most * F.coalesce(F.sum("size").over(before), F.lit(0)), F.sum(F.col("size") * F.col("boost")).over(behind)))
    rates = of_level.filter(F.col("rate") * F.col("boost") <= most).groupBy("src").agg(F.min_by("rate", -F.col("boost")).alias("rate"))
    sources = known.join(rates, "src", "left").withColumn("rate", F.coalesce("rate", F.lit(float(most))))
    # Words that are drawn by lot, and from which size a document is long.
    lot = F.least(F.lit(float(most)), F.col("rate") * F.col("boost"))
    rooms = levels.drop("source").join(sources.select("src", "rate"), "src").groupBy("src").agg(_binary(F.sum((lot - F.floor(lot)) * F.col("size"))).alias("room"))
    sources = small(checkpoint(sources.join(rooms, "src").withColumn("long_from", F.col("room") * LONG)))
    drawn = _ranked(docs, sources, seed, most).filter("p > 0").select("cell", "src", "key", "id", "size", F.lit(1).cast("long").alias("n"), "p")
    long, rest = drawn.filter(F.col("cell").endswith("+")), drawn.filter(F.col("cell").endswith("-"))
    first = small(_cuts(long, checkpoint(long.groupBy("cell", "p").agg(F.sum("size").alias("size")).groupBy("cell").agg(_binary(F.sum(F.col("p") * F.col("size"))).alias("room")))))
    got = _taken(long.join(first, "cell"), first).groupBy("src").agg(F.sum("size").alias("got"))
    left = sources.join(got, "src", "left").select(F.concat("src", F.lit("-")).alias("cell"), (F.col("room") - F.coalesce("got", F.lit(0))).alias("room"))
    second = _cuts(rest, checkpoint(left))
    return Plan(sources, small(checkpoint(first.union(second))), seed, most), docs


def _taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """(src, size) of the drawn rows; of a cell's last rows, which are alike, one row with the words that fit."""
    before = rows.filter(_before_cut()).select("src", "size")
    last = cuts.filter("cut_m is not null").select(F.expr("substring(cell, 1, length(cell) - 1)").alias("src"), (F.col("cut_size") * F.col("cut_m")).alias("size"))
    return before.union(last)


def apply(plan: Plan, docs: DataFrame) -> DataFrame:
    """docs with source_size, target and `taken_copies`; no shuffle while sources are few and no cut parts alike rows."""
    ranked = _ranked(docs, plan.sources, plan.seed, plan.most).join(plan.cuts, "cell", "left")
    drawn, whole = F.col("p") > 0, F.coalesce(F.col("cut_m") == F.col("cut_n"), F.lit(False))
    extra = drawn & F.coalesce(_before_cut() | (_at_cut() & whole), F.lit(False))
    out = ranked.withColumn("taken_copies", F.col("copies") + F.when(extra, 1).otherwise(0))
    if not plan.partial:
        return out
    parted = drawn & _at_cut() & ~whole
    alike = _numbered(out.filter(parted))
    alike = alike.withColumn("taken_copies", F.col("copies") + F.when(F.col("place") <= F.col("cut_m"), 1).otherwise(0)).drop("place")
    return out.filter(~F.coalesce(parted, F.lit(False))).unionByName(alike)


def mixed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", boost: str | None = BY_SIZE, **options) -> DataFrame:
    """The rows of df, each as often as the mix takes it."""
    decided, _ = plan(df, key, text, source, boost, **options)
    taken = apply(decided, _documents(df, key, text, source, boost, F.struct(*df.columns).alias("row"))).filter("taken_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("taken_copies").cast("int")))).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided, docs = plan(table(spark, sf_dir, "documents"))
    return apply(decided, docs).select(F.col("key0").alias("doc_id"), "size", "source_size", "target", (F.col("taken_copies") * F.col("size")).alias("taken"), F.col("copies").cast("long").alias("copies"), F.col("p").alias("inclusion"))


def op1_sql() -> str:
    return f"""
        WITH texts AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
        docs AS (SELECT *, CAST({SIZE_RATES} AS DOUBLE[])[least(length(bin(size)), {len(SIZE_RATES)})] AS boost FROM texts),
        sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM docs GROUP BY source),
        caps AS (SELECT *, [5, 2, 1][n % 3 + 1] AS w, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM sizes),
        levels AS (SELECT *, (budget - CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM caps),
        water AS (SELECT min_by(level, cap / w) AS height FROM levels WHERE level * w < cap),
        targets AS (SELECT source, source_size, CASE WHEN height IS NULL OR cap <= height * w THEN CAST(cap AS DOUBLE) ELSE height * w END AS target FROM levels, water),
        boosts AS (SELECT source, boost, CAST(sum(size) AS DOUBLE) AS words FROM docs GROUP BY source, boost),
        falling AS (SELECT b.*, t.target, (t.target - 3 * coalesce(sum(words) OVER (PARTITION BY b.source ORDER BY boost DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / nullif(sum(words * boost) OVER (PARTITION BY b.source ORDER BY boost DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS rate
            FROM boosts b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
        rates AS (SELECT source, max_by(rate, boost) AS rate FROM falling WHERE rate * boost <= 3 GROUP BY source),
        lots AS (SELECT b.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, coalesce(r.rate, 3.0::DOUBLE) * b.boost) ELSE 0 END AS lot
            FROM boosts b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source LEFT JOIN rates r ON b.source IS NOT DISTINCT FROM r.source),
        rooms AS (SELECT source, floor(sum((lot - floor(lot)) * words) * 1024) / 1024 AS room FROM lots GROUP BY source),
        ranked AS (SELECT d.*, l.source_size, l.target, CAST(floor(l.lot) AS BIGINT) AS copies, l.lot - floor(l.lot) AS p, r.room, size > r.room * 0.01 AS long, (CAST(('0x' || substr(md5('mix:' || id), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
            FROM docs d JOIN lots l ON d.source IS NOT DISTINCT FROM l.source AND d.boost = l.boost JOIN rooms r ON d.source IS NOT DISTINCT FROM r.source),
        keyed AS (SELECT *, u / (1 - u) * (1 - p) / p AS odds FROM ranked WHERE p > 0),
        binned AS (SELECT *, CAST(floor(odds / (1 + odds) * 1125899906842624.0::DOUBLE) AS BIGINT) AS k FROM keyed),
        alike AS (SELECT source, long, k, id, size, any_value(p) AS p, any_value(room) AS room, count(*) AS n, sum(size) AS words FROM binned GROUP BY source, long, k, id, size),
        upto AS (SELECT *, CAST(sum(words) OVER (PARTITION BY source, long ORDER BY k, id, size) - words AS BIGINT) AS behind, floor(sum(p * words) OVER (PARTITION BY source, long) * 1024) / 1024 AS share FROM alike),
        first AS (SELECT *, CASE WHEN size = 0 THEN CASE WHEN behind <= share THEN n ELSE 0 END ELSE greatest(0, least(n, floor((share - behind) / size + 0.5))) END AS m FROM upto WHERE long),
        got AS (SELECT source, sum(m * size) AS got FROM first GROUP BY source),
        rest AS (SELECT u.*, u.room - coalesce(g.got, 0) AS free FROM upto u LEFT JOIN got g ON u.source IS NOT DISTINCT FROM g.source WHERE NOT u.long),
        second AS (SELECT *, CASE WHEN size = 0 THEN CASE WHEN behind <= free THEN n ELSE 0 END ELSE greatest(0, least(n, floor((free - behind) / size + 0.5))) END AS m FROM rest),
        picked AS (SELECT source, id, size, long, m FROM first UNION ALL SELECT source, id, size, long, m FROM second),
        placed AS (SELECT *, row_number() OVER (PARTITION BY source, id, size, long) AS place FROM ranked)
        SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, r.source_size, r.target, CAST((r.copies + CASE WHEN r.place <= coalesce(p.m, 0) THEN 1 ELSE 0 END) * r.size AS BIGINT) AS taken, r.copies, r.p AS inclusion
        FROM placed r LEFT JOIN picked p ON r.source IS NOT DISTINCT FROM p.source AND r.id = p.id AND r.size = p.size AND r.long = p.long
    """
