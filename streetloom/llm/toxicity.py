"""Toxic passages: maximum-scoring segments of word log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from streetloom.llm.common import id_crc, slices, stored
from streetloom.llm.segments import chance_factor, decay_rate, runs

WORDS = re.compile(r"[^\W\d_]+")
SAMPLE = 8000
UNITS = 20_000
PRIOR = 0.5
SURE = 4.5
DRIFT = 1.0
SIGNIFICANT = 0.5
PREFIXES = (6, 5, 4)
SLOTS = 4
HELD = 200_000
THRESHOLD = 0.7


def units_of(word: str) -> Iterator[str]:
    yield word
    for k in PREFIXES:
        if len(word) > k:
            yield word[:k] + "*"


class Scores(dict):
    """Word -> score. A word without a score of its own takes that of its longest prefix that has one; else it is plain."""

    def __init__(self, units: dict[str, float]):
        super().__init__()
        self.units = units

    def __missing__(self, word: str) -> float:
        score = next((self.units[u] for u in units_of(word) if u in self.units), 0.0) - DRIFT
        if len(self) >= HELD:
            self.clear()
        self[word] = score
        return score


@dataclass
class ToxicModel:
    """``units``: log-odds of telling words and prefixes, at most UNITS of either. The rest are four numbers."""

    units: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, float] = (-4.0, 1.0)

    def passages(self, text: str | None, scores: Scores) -> tuple[int, list[tuple[int, int, float]]]:
        words = WORDS.findall((text or "").lower())
        marks = list(map(scores.__getitem__, words))
        positive = [(i, s) for i, s in enumerate(marks) if s > 0]
        return len(words), runs(positive, len(words), -DRIFT) if positive else []

    def expected(self, n: int, score: float) -> float:
        """How many segments of that score clean text of n words holds by chance."""
        return self.k * max(n, 1) * math.exp(-self.lam * score)

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float, float]]]:
        kept = [(a, b, s, e) for a, b, s in found if (e := self.expected(n, s)) <= SIGNIFICANT]
        return math.log1p(sum(-math.log(max(e, 1e-300)) for _, _, _, e in kept)), kept

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.weights[0] + self.weights[1] * evidence))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Weights of sigmoid(a + b x), by Newton's method; the ridge keeps them finite where classes do not mix."""
    features, beta, n = np.stack([np.ones_like(x), x], axis=1), np.zeros(2), len(x)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        hessian = (features * (p * (1 - p))[:, None]).T @ features / n + ridge * np.eye(2)
        step = np.linalg.solve(hessian, features.T @ (p - y) / n + ridge * beta)
        beta -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def training_sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(toxic, text) of at most ``size`` ids of each class, those with the lowest hash among labelled ids whose crc32 mod 3 is not 1.
    An id with several labels is toxic if one of them says so, one with several texts has the smallest. At most 2 * ``size`` ids are broadcast."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (id_crc(F.col("doc_id")) % 3 != 1)).groupBy(
        F.col("doc_id").cast("long").alias("known_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("known_id"), F.col("known_id")
    ids = known.where("toxic = 1").orderBy(*order).limit(size).unionByName(known.where("toxic = 0").orderBy(*order).limit(size))
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("known_id")).groupBy("known_id")
    return rows.agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")


def minima(text: str | None) -> list[int]:
    """Least hashes of the three-word shingles under SLOTS hash functions: texts that share a part j of their shingles agree in each with
    probability j."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return [0] * SLOTS
    width = min(3, len(words))
    grams = map(b" ".join, zip(*(words[k : len(words) - width + 1 + k] for k in range(width)), strict=True))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams), dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = [(hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF) for k in range(SLOTS)]
    return [int((m ^ (m >> np.uint64(29))).min().astype(np.int64)) for m in mixed]


def different_texts(sample: DataFrame) -> DataFrame:
    """The sample without copies and near copies: a text goes if an earlier one has the same least hash in any slot. Copies are not evidence of their
    own; counted, they would make every word of a copied toxic text look toxic. Of texts with 0.8 of their shingles in common 1 in 600 stays."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [minima(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.int64()))], names=["key", "minima"])

    slots = stored(sample.select("key", "text").mapInArrow(measure, "key long, minima array<long>"), "toxic-minima").select("key", F.posexplode("minima").alias("slot", "least"))
    first = slots.groupBy("slot", "least").agg(F.min("key").alias("first"))
    again = slots.join(first, ["slot", "least"]).where("key > first").select("key").distinct()
    return sample.join(again, "key", "left_anti").select("toxic", "text")


def count_units(sample: DataFrame) -> DataFrame:
    """unit, n1, n0: in how many toxic and clean documents of the sample. Each task adds up before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(seen[0] | seen[1])
            out = pa.RecordBatch.from_pydict({"unit": names, "n0": [seen[0][u] for u in names], "n1": [seen[1][u] for u in names]})
            seen[0].clear()
            seen[1].clear()
            return out

        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen[toxic].update({u for w in set(WORDS.findall((text or "").lower())) for u in units_of(w)})
                if len(seen[0]) + len(seen[1]) > 4 * HELD:
                    yield flush()
        if seen[0] or seen[1]:
            yield flush()
    return sample.mapInArrow(count, "unit string, n0 long, n1 long").groupBy("unit").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def telling_units(counts: DataFrame, docs0: int, docs1: int, limit: int) -> DataFrame:
    """unit, score, n0, n1 of the units that toxic documents hold more often than chance would have it: the root of twice the log-likelihood
    ratio is SURE or more. The score is the log-odds between the classes, smoothed by a Dirichlet prior of PRIOR per unit and class."""
    n0, n1, share = F.col("n0"), F.col("n1"), docs1 / (docs0 + docs1)
    both = n0 + n1
    ratio = 2 * (n1 * F.log(n1 / (both * share)) + F.when(n0 > 0, n0 * F.log(n0 / (both * (1 - share)))).otherwise(0.0))
    odds = F.log((n1 + PRIOR) / (docs1 + PRIOR)) - F.log((n0 + PRIOR) / (docs0 + PRIOR))
    telling = counts.where((n1 > 0) & (n1 > both * share) & (ratio >= SURE * SURE))
    return telling.select("unit", odds.alias("score"), "n0", "n1").orderBy(F.desc("score"), "unit").limit(limit)


def learn_toxicity(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, units: int = UNITS) -> ToxicModel:
    """Fits the model on a bounded sample (at most ``size`` documents of each class, near copies taken once). Words are tried first; then prefixes, by what they are
    beyond the words already found, so that an insult does not taint the clean words that begin like it. At most ``units`` of either
    reach the driver. Without labelled documents of both classes nothing scores above 0."""
    drawn = stored(training_sample(docs, labels, size).withColumn("key", F.monotonically_increasing_id()), "toxic-drawn")
    sample = stored(different_texts(drawn), "toxic-sample")
    counts = stored(count_units(sample), "toxic-units")
    classes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not classes.get(0) or not classes.get(1):
        return ToxicModel()
    is_prefix = F.col("unit").endswith("*")
    words = telling_units(counts.where(~is_prefix), classes[0], classes[1], units).collect()
    known: dict[str, list[int]] = {}
    for r in words:
        for u in list(units_of(r["unit"]))[1:]:
            have = known.setdefault(u, [0, 0])
            have[0], have[1] = have[0] + r["n0"], have[1] + r["n1"]
    spark = docs.sparkSession
    minus = spark.createDataFrame([(u, *n) for u, n in known.items()], "unit string, m0 long, m1 long")
    beyond = counts.where(is_prefix).join(minus, "unit", "left").select(
        "unit", F.greatest(F.lit(0), F.col("n0") - F.coalesce("m0", F.lit(0))).alias("n0"), F.greatest(F.lit(0), F.col("n1") - F.coalesce("m1", F.lit(0))).alias("n1"))
    top = words + telling_units(beyond, classes[0], classes[1], units).collect()
    model = ToxicModel({r["unit"]: r["score"] for r in top})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model.units)
        for batch in batches:
            rows = [(x, *model.passages(text, scores)) for x, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "toxic": pa.array([r[0] for r in rows], pa.int32()), "n": pa.array([r[1] for r in rows], pa.int64()),
                "segments": pa.array([[s for _, _, s in r[2]] for r in rows], pa.list_(pa.float64()))})

    measured = sample.mapInArrow(measure, "toxic int, n long, segments array<double>").collect()
    clean = [r for r in measured if not r["toxic"] and r["n"]]
    scores = np.array([s for r in clean for s in r["segments"]])
    lengths = np.array([r["n"] for r in clean], dtype=np.float64)
    model.lam = decay_rate(scores, int(lengths.sum()), -DRIFT)
    model.k = chance_factor(np.array([max(r["segments"], default=0.0) for r in clean]), lengths, model.lam)
    evidence = np.array([model.evidence(r["n"], [(0, 0, s) for s in r["segments"]])[0] for r in measured])
    model.weights = logistic(evidence, np.array([r["toxic"] for r in measured]))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), passages (first word, end, score, expected by chance) of every significant
    segment, in order. Null and empty texts have no passage and the lowest score. Whole texts are scanned, of any length."""
    kind = "doc_id long, score double, passages array<struct<first:long,end:long,score:double,expected:double>>"
    passage = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model.units)
        for part in (p for batch in batches for p in slices(batch, "text")):
            found = [model.evidence(*model.passages(text, scores)) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([model.probability(x) for x, _ in found], pa.float64()),
                pa.array([[dict(zip(("first", "end", "score", "expected"), p, strict=True)) for p in kept] for _, kept in found], passage)],
                names=["doc_id", "score", "passages"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, kind)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``: learned and applied on the same documents. Texts do not move."""
    model = learn_toxicity(docs, labels)

    def scan(texts: pa.Array) -> pa.Array:
        scores = Scores(model.units)
        return pa.array([model.probability(model.evidence(*model.passages(t, scores))[0]) for t in texts.to_pylist()], pa.float64())

    return docs.where(arrow_udf(scan, DoubleType())(F.col(text_col)) < threshold)
