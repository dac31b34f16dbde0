"""Lines that several documents share: dropped from all but the first. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.llm.common import LAST_ID, SPACES, ascii_lower, stored

MIN_DOCS = 2
MIN_CHARS = 10


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h, g, first_id) of the line hashes that at least ``min_docs`` different documents hold. Minimum and maximum combine
    before the shuffle, so a line that a third of the documents hold is as cheap as any other, and they already tell one
    document from two. More than two are counted, over the lines that are left; Spark counts distinct ids in two steps, by
    (hash, id) and then by hash, so that is spread as well."""
    shared = lines.groupBy("h", "g").agg(F.min("ident").alias("first_id"), F.max("ident").alias("last_id")).where(
        "first_id < last_id").select("h", "g", "first_id")
    if min_docs <= 2:
        return shared
    enough = lines.join(shared, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.countDistinct("ident").alias("docs")).where(
        F.col("docs") >= min_docs).select("h", "g")
    return shared.join(enough, ["h", "g"])


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                        min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs`` in the struct ``row``, and kept_text, n_lines, n_dropped.

    Texts are split at \\n; null and empty texts are one empty line. A line's key is the line stripped of ASCII space and with
    A-Z lower-cased. Keys of ``min_chars`` code points or more found in ``min_docs`` documents or more lose their lines
    everywhere but in the smallest id that holds them (all repeats there stay). Rows with the same id count as one document;
    rows without id count as one more, which comes after all others. kept_text of a document that loses all lines is empty.

    Keys are compared by 96 bits of hash. Each row of ``docs`` is known by its id and 96 bits of hash of its text, so repeated rows are
    treated alike and different texts without id, or with one id, are not."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    known = ident.alias("ident"), F.xxhash64(text).alias("mark"), F.hash(text).alias("mark2")
    split = docs.select(*known, F.posexplode(F.split(ascii_lower(text), "\n", -1)).alias("pos", "line"))
    keyed = split.select("ident", "mark", "mark2", "pos", F.btrim("line", F.lit(SPACES)).alias("key")).where(F.char_length("key") >= min_chars)
    lines = stored(keyed.select("ident", "mark", "mark2", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("g")), "lines")
    # Written, so that the join deals both sides anew by hash and Spark can split the part of a very common line.
    shared = stored(repeated_lines(lines, min_docs), "lines-shared")
    lost = lines.join(shared, ["h", "g"]).where("ident > first_id").select("ident", "mark", "mark2", "pos")
    drops = lost.groupBy("ident", "mark", "mark2").agg(F.collect_set("pos").alias("drops"))
    rows = docs.select(F.struct("*").alias("row"), *known, text.alias("whole"))
    joined = rows.join(drops, ["ident", "mark", "mark2"], "left")
    parts = F.split("whole", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("drops"))
    return joined.withColumn("parts", parts).select(
        "row",
        F.when(F.col("drops").isNull(), F.col("whole")).otherwise(
            F.array_join(F.transform(kept, lambda i: F.get("parts", i)), "\n")).alias("kept_text"),
        F.size("parts").cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"))
