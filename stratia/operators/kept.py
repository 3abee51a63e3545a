"""An index of statements that is kept: parsed once, extended by deliveries, read without the text of statements.

An index lies in a folder under a digest of its settings. A delivery is a slice of declarations with a number; it is parsed
and written once, under its number and a digest of its rows:

    statements   the parsed rows
    keys         (key, size, n): by how much the delivery changes the number of declarations that have a key,
                 by ranges of keys, so that a look-up reads few files
    done         one row, written last: what is not there was not finished, and is written again

A name that comes again replaces what it stood for before: its old keys count down in the delivery that replaces it.
Counts of all deliveries therefore sum to those of an index built at once from the last row of each name.

Defined cases: of repeated names in a delivery the row with the largest seq counts; rows without a parsed statement
withdraw what their name stood for; a delivery that is done already changes nothing; its number with other rows raises, and
so does a number below one that is there; an index without deliveries is empty.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratia.operators import statements as st
from stratia.session import checkpoint, shuffle_partitions

VERSION = 1
DONE = "number int, digest string, live long"
KEYS = "key string, size int, n long"


def settings(of: str = "root") -> dict:
    """What a kept key depends on."""
    return {"version": VERSION, "of": of, "closed": st.CLOSED, "open": st.OPEN}


def digest_of(decls: DataFrame) -> str:
    """A digest of rows (seq, name, kind, module, stmt), whatever their order; digests of rows are summed, not gathered."""
    each = F.conv(F.substring(F.sha2(F.to_json(F.struct("seq", "name", "kind", "module", "stmt")), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    r = decls.agg(F.count("*").alias("n"), F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("s")).first()
    return hashlib.sha256(f"{r['n']}:{r['s']}".encode()).hexdigest()[:16]


class Kept:
    """An index in a folder. of: the column of terms whose subterms are keys, root or concludes."""

    def __init__(self, spark: SparkSession, root: str, of: str = "root"):
        name = hashlib.sha256(json.dumps(settings(of), sort_keys=True).encode()).hexdigest()[:16]
        self.spark, self.of, self.folder = spark, of, f"{root.rstrip('/')}/{name}"

    def _there(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def deliveries(self) -> list[tuple[int, str, int]]:
        """(number, digest, change of the number of statements) of what is done, a row a delivery."""
        if not self._there(f"{self.folder}/done"):
            return []
        rows = self.spark.read.schema(DONE).parquet(f"{self.folder}/done/*").collect()
        return sorted((r["number"], r["digest"], r["live"]) for r in rows)

    def _paths(self, what: str) -> list[str]:
        return [f"{self.folder}/{what}/{n:09d}-{d}" for n, d, _ in self.deliveries()]

    def total(self) -> int:
        return sum(live for _, _, live in self.deliveries())

    def statements(self) -> DataFrame:
        """The parsed statements (as st.parse gives them), the last of each name."""
        return self._live(self._paths("statements")).filter("root is not null").drop("number")

    def _live(self, paths: list[str]) -> DataFrame:
        schema = f"number int, {st.PARSED}"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if len(paths) < 2:
            return rows
        last = rows.groupBy("name").agg(F.max("number").alias("number"))
        return rows.join(last, ["name", "number"])

    def _keys(self, parsed: DataFrame, sign: int) -> DataFrame:
        found = st.subterms(parsed, self.of).filter(F.col("size") >= F.when(F.col("closed"), st.CLOSED).otherwise(st.OPEN))
        return found.groupBy("key").agg(F.max("size").alias("size"), (F.count("*") * sign).alias("n"))

    def add(self, decls: DataFrame, number: int) -> str:
        """Add a delivery (seq, name, kind, module, stmt); its digest. Numbers grow."""
        digest, known = digest_of(decls), {n: d for n, d, _ in self.deliveries()}
        if known.get(number) == digest:
            return digest
        if number in known or any(n > number for n in known):
            raise ValueError(f"delivery {number} comes late or with other rows")
        place = f"{number:09d}-{digest}"
        top = decls.groupBy("name").agg(F.max("seq").alias("seq"))
        rows = decls.join(top, ["name", "seq"]).dropDuplicates(["name"])
        parsed = st.parse(rows)
        # Names without a statement are written too, as they withdraw what was there.
        whole = rows.select("seq", "name").join(parsed.drop("seq"), "name", "left")
        fields = [x.split()[0] for x in st.PARSED.split(", ")]
        whole.select(F.lit(number).alias("number"), *fields).write.mode("overwrite").parquet(f"{self.folder}/statements/{place}")
        mine = self.spark.read.schema(f"number int, {st.PARSED}").parquet(f"{self.folder}/statements/{place}")
        old = checkpoint(self.statements().join(mine.select("name"), "name", "left_semi"))
        now = mine.filter("root is not null")
        change = self._keys(now, 1).union(self._keys(old, -1)).groupBy("key").agg(F.max("size").alias("size"), F.sum("n").alias("n")).filter("n <> 0")
        change.repartitionByRange(shuffle_partitions(self.spark), "key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{self.folder}/keys/{place}")
        live = now.count() - old.count()
        self.spark.createDataFrame([(number, digest, live)], DONE).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/done/{place}")
        return digest

    def counts(self) -> DataFrame:
        """(key, n, size): how many declarations have each key, summed over deliveries; no statement is read."""
        paths = self._paths("keys")
        rows = self.spark.read.schema(KEYS).parquet(*paths) if paths else self.spark.createDataFrame([], KEYS)
        return rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("size").alias("size")).filter("n > 0")

    def postings(self) -> DataFrame:
        """(key, n, size, idf), as st.postings gives them for the whole corpus."""
        return self.counts().withColumn("idf", F.log(F.lit(float(max(self.total(), 1))) / F.col("n")))
