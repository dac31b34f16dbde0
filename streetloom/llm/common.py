"""Tables in and out, and the small pieces that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.session import shared_path

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = 9223372036854775807


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet below the shared checkpoint folder and reads it back: lineage ends there, so a lost
    executor costs no more than the tasks that read from it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else untouched. Pure ASCII takes the fast path of ``lower``, which gives the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_crc(column: Column) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(column.cast("string").cast("binary"))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose texts have about ``most_bytes`` together (one row at least), so that a batch of long texts does not become
    Python objects all at once."""
    sizes, start, held = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most_bytes or i == len(sizes) - 1:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
