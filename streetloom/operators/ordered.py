"""Ordered computations over groups of any size.

A plain window over a key puts the whole group in one task. Here each group is first cut into chunks by *value* (an
expression that grows with the order), chunk totals are computed with partial aggregation, and only the totals, one
row per chunk, go through a window over the key. Chunks are chosen by value, not by partition number, so a task that
is run again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


def _offsets(df: DataFrame, keys: list[str], aggs: list[Column], carried: list[str]) -> DataFrame:
    """One row per (key, chunk) with the sum of each aggregate over the chunks before it."""
    totals = df.groupBy(*keys, CHUNK).agg(*aggs)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, CHUNK, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in carried])


def _same(keys: list[str]) -> list[str]:
    return [*keys, CHUNK]


def numbered(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], name: str = "rn") -> DataFrame:
    """Exact ``row_number`` (from 1) per key. ``chunk`` must not decrease along ``order``."""
    cut = df.withColumn(CHUNK, chunk)
    offsets = _offsets(cut, keys, [F.count("*").alias("_before")], ["_before"])
    inside = Window.partitionBy(*_same(keys)).orderBy(*order)
    return (cut.withColumn("_in", F.row_number().over(inside))
            .join(offsets, _same(keys))
            .withColumn(name, (F.col("_before") + F.col("_in")).cast("long"))
            .drop(CHUNK, "_in", "_before"))


def even_chunk(df: DataFrame, column: str, parts: int = 64) -> Column:
    """A chunk number that grows with a numeric column and holds about as many rows as any other: bounds come from approximate
    quantiles (``parts`` numbers for the driver), so sparse values do not make one chunk per row."""
    bounds = sorted(set(df.approxQuantile(column, [k / parts for k in range(1, parts)], 0.2 / parts)))
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b <= F.col(column)))


def running_sum(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], value: str, name: str) -> DataFrame:
    """Exact running sum of ``value`` including the current row."""
    cut = df.withColumn(CHUNK, chunk)
    offsets = _offsets(cut, keys, [F.sum(value).alias("_before")], ["_before"])
    inside = (Window.partitionBy(*_same(keys)).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (cut.withColumn("_in", F.sum(value).over(inside))
            .join(offsets, _same(keys))
            .withColumn(name, F.col("_before") + F.col("_in"))
            .drop(CHUNK, "_in", "_before"))


def with_previous(df: DataFrame, keys: list[str], chunk: Column, order: list[str], columns: list[str],
                  name: str = "prev") -> DataFrame:
    """The struct ``columns`` of the row before, across chunk borders too (NULL for the first row of a key)."""
    cut = df.withColumn(CHUNK, chunk)
    kept = F.struct(*columns)
    tails = cut.groupBy(*keys, CHUNK).agg(F.max_by(kept, F.struct(*order)).alias("_tail"))
    carry = tails.select(*keys, CHUNK, F.lag("_tail").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("_carry"))
    inside = Window.partitionBy(*_same(keys)).orderBy(*order)
    return (cut.withColumn("_in", F.lag(kept).over(inside))
            .join(carry.where(F.col("_carry").isNotNull()), _same(keys), "left")
            .withColumn(name, F.coalesce("_in", "_carry"))
            .drop(CHUNK, "_in", "_carry"))


def last_known(events: DataFrame, keys: list[str], time: str, bucket: Column, is_plan: str, columns: list[str],
               name: str = "known") -> DataFrame:
    """As-of lookup for any group size: every row gets the struct ``columns`` of the latest plan row of its key at or
    before its time. ``events`` holds plan and observation rows together; at equal times plans come first."""
    cut = events.withColumn(CHUNK, bucket)
    value = F.when(F.col(is_plan), F.struct(*columns))
    tails = cut.where(F.col(is_plan)).groupBy(*keys, CHUNK).agg(F.max_by(F.struct(*columns), F.struct(time, *columns)).alias("_tail"))
    # One row per key and bucket, plans or not, so that a bucket without plans passes on what came before.
    slots = cut.select(*keys, CHUNK).distinct().join(tails, _same(keys), "left")
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = slots.select(*keys, CHUNK, F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(*_same(keys)).orderBy(F.col(time), F.col(is_plan).desc(), *columns).rowsBetween(Window.unboundedPreceding, 0)
    return (cut.withColumn("_in", F.last(value, ignorenulls=True).over(inside))
            .join(carry.where(F.col("_carry").isNotNull()), _same(keys), "left")
            .withColumn(name, F.coalesce("_in", "_carry")).drop("_in", "_carry", CHUNK))
