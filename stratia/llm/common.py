"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step holds at once; one longer row is held alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the text ''."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(folds)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, for columns that are added for a while."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the named column has about `most` bytes in each piece."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start = size = 0
        for i, n in enumerate(lengths(column)):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def lengths(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return [n or 0 for n in pc.binary_length(column).to_pylist()]


def word_runs(text: bytes, letters: bytes, most: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, some at a time, each from about `most` bytes; `letters` takes bytes between words to spaces."""
    text = text.translate(letters)
    start = 0
    while start < len(text):
        end = len(text) if start + most >= len(text) else text.find(b" ", start + most)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end
