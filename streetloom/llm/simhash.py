"""SimHash near-duplicates. Candidates come from covering locality-sensitive hashing (Pagh, 2016)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from streetloom.llm.common import stored
from streetloom.operators.network import components

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2
CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text. A bit is set if it is set in over half the shingle hashes; the words are
    split and lower-cased in ASCII only. Shingles are hashed in chunks, so memory is bounded by the text itself."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    n = len(words) - width + 1
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, CHUNK):
        stop = min(n, start + CHUNK)
        grams = map(b" ".join, zip(*(words[start + k : stop + k] for k in range(width)), strict=True))
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), dtype="<u8", count=stop - start)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


@arrow_udf(LongType())
def fingerprint_of(text: pa.Array) -> pa.Array:
    return pa.array((fingerprint(t) for t in text.cast(pa.binary()).to_pylist()), type=pa.int64())


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks. Bit i carries the nonzero vector 1 + i mod (2^(radius+1) - 1) of radius + 1 binary
    coordinates; mask v keeps the bits whose vector has an odd product with v. The vectors of up to ``radius`` differing bits
    span less than the whole space, so some v is orthogonal to all of them: its mask blots out every difference."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin((1 + i % n) & v).count("1") % 2) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def close_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``fp`` whose classes are those of all pairs at ``radius`` 2 or fewer bits.

    Every pair within the radius falls into one bucket of some mask. Inside a bucket two fingerprints differ in the masked-out
    bits alone, and two that differ in at most two bits have a point at one bit or less from both. So each member of a
    bucket of two or more is filed at itself and at its neighbours over the masked-out bits. All that meet at a point are
    within two bits of each other, and at most one for each free bit and one more can meet there; they are linked to the
    smallest. No pairs are made, whatever the size of a bucket."""
    if radius != 2:
        raise ValueError("points between two fingerprints are worked out for a radius of 2")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)])
    filed = prints.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    shared = filed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key")
    shared = stored(shared, "simhash-buckets")  # the join deals both sides anew, so Spark can split a large bucket
    flips = F.array(*[F.array(*[F.lit(0), *[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1]]) for m in masks])
    points = filed.join(shared, ["t", "key"], "left_semi").select(
        "t", "fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
    met = points.groupBy("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    lead = met.select(F.array_min("fps").alias("a"), "fps").distinct()
    return lead.select("a", F.explode("fps").alias("b")).where("a <> b").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), component_id (the smallest doc_id reachable by links of two or
    fewer differing bits).

    Empty and null texts have fingerprint 0 and are linked like any other. Equal texts share a fingerprint and so a class.
    A row without id keeps its fingerprint and gets the id of its class, null if no member has an id. Other columns are not read."""
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_of(F.col(text_col)).alias("fp")), "simhash")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    rooted = class_roots(prints)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = stored(rooted.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def class_roots(prints: DataFrame) -> DataFrame:
    """``prints`` (one row per ``fp``) with ``root``, the smallest fingerprint of its class."""
    links = stored(close_links(prints.select("fp")), "simhash-links")
    roots = components(links).select(F.col("node_id").alias("fp"), F.col("component").alias("root"))
    return prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with exactly one left of each class of fingerprints: the row with the smallest id (none comes last), of
    those with one id the one whose text has the smallest hashes; of equal rows any one.

    Rows are numbered once, in a written table, so that a row is known by itself and not by an id that others share."""
    numbered = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n")), "simhash-rows")
    text, ident = F.col("row")[text_col], F.col("row")[id_col].cast("long")
    rows = stored(numbered.select("n", ident.alias("ident"), F.xxhash64(text).alias("x"), F.hash(text).alias("y"), fingerprint_of(text).alias("fp")), "simhash")
    # One candidate per fingerprint before the classes are known: equal texts, however many, meet in a partial minimum.
    first = F.min(F.struct(F.col("ident").isNull().alias("none"), "ident", "x", "y", "n")).alias("first")
    rooted = class_roots(stored(rows.groupBy("fp").agg(first), "simhash-distinct"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.n").alias("n"))
    return numbered.join(kept, "n", "left_semi").select("row.*")
