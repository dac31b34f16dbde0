"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from streetloom.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
CELLS = 256
SEED = 7


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_number(text: Column, digits: int) -> Column:
    """The first hex digits of a text's md5 as a number: the same in any engine, so that reruns agree."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: src (its place by code point, null last), source, source_size, target, offset.

    Targets are weight times one level, or ``most`` times the source's size where that is less: what resharing the excess by
    weight comes to. Sources reach their stop in the order of stop / weight, so running sums in that order give the level at
    which each would still be free; the level is that of the first free one. The windows here see one row per source."""
    one = Window.orderBy(F.col("source").asc_nulls_last())
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("src", F.row_number().over(one))
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src") - 1) % len(weights) + 1)).withColumn(
        "stop", (F.col("source_size") * most).cast("double"))
    rise = Window.orderBy(F.col("stop") / F.col("weight"), "src")
    before, rest = rise.rowsBetween(Window.unboundedPreceding, -1), rise.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("goal", F.sum("source_size").over(Window.partitionBy()) * F.lit(share)).withColumn(
        "level", (F.col("goal") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    free = F.max(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("level"))).over(Window.partitionBy())
    return by.withColumn("free", free).select(
        "src", "source", "source_size", F.least(F.col("stop"), F.col("free") * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
             share: float = SHARE, most: int = MOST, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (words), source_size, target, copies, taken (copies * size).

    Each document of a source has the same expected copies r = target / source_size. Documents stand in order of (size,
    hash of the id, id), so that neighbours are of like size and the words taken differ from the target by about one document;
    the k-th gets floor(r k + offset) - floor(r (k - 1) + offset) copies, one for each whole number crossed. The offset comes
    from the seed and the source's place. The place k is a sum of three: documents of the source in smaller sizes, of the same
    size in smaller hash cells, and in the same cell; so a source or size that holds a third of all rows is spread.

    Null texts have size 0, and a null source is one of its own. A document of size 0 takes no words. Rows with the same id are
    documents of their own; with ``row_col``, a unique number of each row, that is returned too, and texts put them in order. Empty input gives no rows."""
    extra = {} if row_col is None else {"__tie": F.xxhash64(F.col(text_col)), row_col: F.col(row_col)}
    sizes = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *[c.alias(k) for k, c in extra.items()]), "mix-sizes")
    sources = stored(source_targets(sizes, weights, share, most).withColumn("offset", hex_number(
        F.concat(F.lit(f"{seed}:"), F.col("src").cast("string")), 8) / F.lit(2.0**32)), "mix-sources")
    cell = (hex_number(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 4) % CELLS).alias("cell")
    placed = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select(
        "doc_id", sizes["source"], "src", "size", cell, "source_size", "target", "offset", *extra)
    cells = placed.groupBy("src", "size", "cell").agg(F.count("*").alias("n"))
    same = Window.partitionBy("src", "size").orderBy("cell")
    inner = cells.withColumn("in_size", F.sum("n").over(same) - F.col("n"))
    by_size = cells.groupBy("src", "size").agg(F.sum("n").alias("n"))
    smaller = by_size.withColumn("in_source", F.sum("n").over(Window.partitionBy("src").orderBy("size")) - F.col("n")).drop("n")
    starts = inner.join(smaller, ["src", "size"]).select("src", "size", "cell", (F.col("in_size") + F.col("in_source")).alias("start"))
    nth = F.row_number().over(Window.partitionBy("src", "size", "cell").orderBy(F.col("doc_id").asc_nulls_last(), *extra))
    ranked = placed.withColumn("nth", nth).join(starts, ["src", "size", "cell"])
    k, r = F.col("start") + F.col("nth"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(r * k + F.col("offset")) - F.floor(r * (k - 1) + F.col("offset"))
    copies = F.least(crossed, F.ceil(r)).cast("long")
    return ranked.select(*([] if row_col is None else [row_col]), "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it. Rows are numbered and written once, so that each has its own copies,
    documents without words and without id too."""
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    plan = mix_plan(rows, id_col, text_col, source_col, row_col="__row", **options).select("__row", F.col("copies").alias("__n")).where("__n > 0")
    return rows.join(plan, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*docs.columns)
