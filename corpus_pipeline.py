"""The training-data pipeline: each stage takes the documents its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.llm.common import stored, table
from streetloom.llm.lines import drop_repeated_lines
from streetloom.llm.mixing import mix
from streetloom.llm.pieces import encode_pieces
from streetloom.llm.simhash import drop_near_duplicates
from streetloom.llm.toxicity import drop_toxic
from streetloom.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. The model learns from the labelled documents among those it is given."""
    return drop_toxic(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that other documents had first go; a document that loses its last line stays, with an empty text."""
    kept = drop_repeated_lines(docs)
    return kept.select("row.doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source", F.char_length("kept_text").cast("long").alias("n_chars"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy of every document as piece ids: the end of the pipeline."""
    best = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return best.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_pieces"), "ids", F.transform("nbest", lambda x: x["score"]).alias("scores"), "round_trip")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("source_mix", source_mix), ("sentencepiece", sentencepiece)]

#: The first and the last stage cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
