"""Quality by nearest neighbours: labelled documents in a latent-semantic space vote, weighted by cosine."""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.llm.common import id_crc, slices, stored

TOKENS = re.compile(r"\w+|[^\w\s]+")
SAMPLE = 3000
TERMS = 8192
RANK = 32
SPARE = 8
PASSES = 4
VOTERS = 16
LAGS = (1, 2, 3, 4)
CHUNK = 1 << 20
HELD = 200_000
BLOCK = 256
PARTS = 4
THRESHOLD = 0.3
NONE = 0.5


def shape(token: str) -> str | None:
    """A mark for how a word is written; None for runs of signs. Marks begin with NUL, which no token holds beside other characters."""
    if not (token[0].isalnum() or token[0] == "_"):
        return None
    if token.isupper() and len(token) > 1:
        return "\0upper"
    return "\0title" if token[0].isupper() else "\0lower" if token.islower() else "\0other"


def chunks(text: str) -> Iterator[list[str]]:
    """The tokens of a text, about CHUNK characters at a time: a long text never stands in memory as one list."""
    start = 0
    while start < len(text):
        stop = start + CHUNK
        while stop < len(text) and not text[stop].isspace() and stop < start + 2 * CHUNK:
            stop += 1
        yield TOKENS.findall(text, start, stop)
        start = stop


def token_counts(text: str | None) -> tuple[Counter[str], dict[int, int]]:
    """How often each token occurs in a text as it is written, and for each lag how many tokens equal the one that many places before."""
    raw: Counter[str] = Counter()
    again = dict.fromkeys(LAGS, 0)
    before: list[str] = []
    for tokens in chunks(text or ""):
        raw.update(tokens)
        joined = before + tokens
        for lag in LAGS:
            begin = max(0, len(before) - lag)
            again[lag] += sum(map(operator.eq, joined[begin:], joined[begin + lag :]))
        before = joined[-LAGS[-1] :]
    return raw, again


def terms_of(token: str) -> list[str]:
    """The terms that a token counts for: the word in lower case or the run of signs, and its shape."""
    mark = shape(token)
    return [token.lower(), mark] if mark else [token]


def term_counts(text: str | None) -> Counter[str]:
    """How often each term occurs in a text; a lag's term is ``again_term``."""
    raw, again = token_counts(text)
    out: Counter[str] = Counter()
    for token, n in raw.items():
        for term in terms_of(token):
            out[term] += n
    out.update({again_term(lag): n for lag, n in again.items() if n})
    return out


def again_term(lag: int) -> str:
    return f"\0again{lag}"


class Routes(dict):
    """Token -> places of its terms that are known; at most HELD tokens are kept."""

    def __init__(self, places: dict[str, int]):
        super().__init__()
        self.places = places

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= HELD:
            self.clear()
        found = self[token] = tuple(self.places[t] for t in terms_of(token) if t in self.places)
        return found

    def weighted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The places of a text's known terms in order and their weights, 1 + log count, scaled to length 1."""
        raw, again = token_counts(text)
        counts: dict[int, int] = {}
        for token, n in raw.items():
            for place in self[token]:
                counts[place] = counts.get(place, 0) + n
        for lag, n in again.items():
            if n and (place := self.places.get(again_term(lag))) is not None:
                counts[place] = n
        at, n = np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))
        order = np.argsort(at)
        x = 1.0 + np.log(n[order])
        return at[order], x / max(1e-300, float(np.sqrt(x @ x)))


@dataclass
class NeighbourModel:
    """``places``: term -> row of ``axes`` (terms x RANK). ``voters``: unit rows in the latent space, with the label and the weight of each vote."""

    places: dict[str, int] = field(default_factory=dict)
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK)))
    voters: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK)))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    neighbours: int = VOTERS

    @property
    def prior(self) -> float:
        return float((self.weights * self.labels).sum() / self.weights.sum()) if len(self.weights) else NONE

    def points(self, texts: list[str | None], routes: Routes) -> np.ndarray:
        """Texts as unit rows in the latent space, zero without a known term."""
        rows = np.zeros((len(texts), self.axes.shape[1]))
        for i, text in enumerate(texts):
            at, x = routes.weighted(text)
            rows[i] = x @ self.axes[at]
        return unit(rows)

    def votes(self, points: np.ndarray) -> np.ndarray:
        """Scores of rows in the latent space: labels of the nearest voters (all that tie with the last of them vote too), weighted by the square
        of a positive cosine. Rows without a voter on their side get the prior."""
        out = np.full(len(points), self.prior)
        if not len(self.voters):
            return out
        k = min(self.neighbours, len(self.voters))
        for s in range(0, len(points), BLOCK):
            cosine = points[s : s + BLOCK] @ self.voters.T
            last = np.partition(cosine, -k, axis=1)[:, -k]
            near = np.where(cosine >= np.maximum(last, 1e-9)[:, None] - 1e-12, np.maximum(cosine, 0.0) ** 2, 0.0) * self.weights
            total = near.sum(axis=1)
            found = total > 0
            out[s : s + BLOCK][found] = np.clip((near @ self.labels)[found] / total[found], 0.0, 1.0)
        return out


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.where(norms > 1e-12, rows / np.maximum(norms, 1e-12), 0.0)


def labelled_texts(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(text, label, weight) of at most ``size`` labelled ids of each class, those with the lowest hash among ids whose crc32 mod 5 is not 0. An
    id with several labels has the largest, an id with several texts the smallest. Each different text is one voter, with the mean of its labels; a vote
    weighs as many documents of its class as it stands for, so that a class drawn more thinly does not lose by it. At most 2 * ``size`` ids are broadcast."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (id_crc(F.col("doc_id")) % 5 != 0)).groupBy(
        F.col("doc_id").cast("long").alias("known_id")).agg(F.max("quality").cast("double").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("known_id"), F.col("known_id")
    drawn = [known.where(F.col("label") == y).orderBy(*order).limit(size).withColumn("weight", F.lit(totals.get(y, 0) / max(1, min(size, totals.get(y, 0))))) for y in (0.0, 1.0)]
    rows = docs.join(F.broadcast(drawn[0].unionByName(drawn[1])), F.col("doc_id") == F.col("known_id"))
    texts = rows.groupBy("known_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("weight").alias("weight"))
    return texts.groupBy("text").agg(F.avg("label").alias("label"), F.avg("weight").alias("weight"))


def frequent_terms(sample: DataFrame, limit: int) -> list[str]:
    """The ``limit`` terms that most texts of the sample hold, those of two texts at least. Each task counts before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        flush = lambda: pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())})
        for batch in batches:
            for text in batch.column("text"):
                seen.update(set(term_counts(text.as_py())))
                if len(seen) > HELD:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    found = sample.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where("n > 1")
    return [r["term"] for r in found.orderBy(F.desc("n"), "term").limit(limit).collect()]


def latent_axes(vectors: DataFrame, width: int, rank: int) -> np.ndarray:
    """width x rank: the leading right singular vectors of the sample's term matrix, by subspace iteration. Each pass sends the current basis to PARTS
    tasks, which add up their rows' part of the product; the driver gets PARTS matrices of width x (rank + SPARE), whatever the texts hold."""
    columns = min(rank + SPARE, width)
    basis = np.linalg.qr(np.random.default_rng(7).normal(size=(width, columns)))[0]
    product = np.zeros_like(basis)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, columns))
        for batch in batches:
            for at, x in zip(batch.column("at"), batch.column("x"), strict=True):
                at, x = at.values.to_numpy(), x.values.to_numpy()
                total[at] += x[:, None] * (x @ basis[at])
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    for _ in range(PASSES):
        parts = vectors.select("at", "x").coalesce(PARTS).mapInArrow(multiply, "part binary").collect()
        product = sum((np.frombuffer(r["part"]).reshape(width, columns) for r in parts), np.zeros((width, columns)))
        basis, turned = np.linalg.qr(product)
    return (basis @ np.linalg.svd(turned)[0])[:, :rank]


def learn_neighbours(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, terms: int = TERMS, rank: int = RANK, neighbours: int = VOTERS) -> NeighbourModel:
    """Fits the space on a bounded sample: at most ``size`` ids of each class, ``terms`` terms, ``rank`` dimensions. Without labelled documents (or words
    in them) there are no voters, and every score is that of an empty model, 0.5."""
    sample = stored(labelled_texts(docs, labels, size), "quality-sample")
    places = {t: i for i, t in enumerate(frequent_terms(sample, terms))}
    if not places:
        return NeighbourModel(neighbours=neighbours)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes = Routes(places)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = list(map(routes.weighted, part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("weight"), pa.array([a for a, _ in rows], pa.list_(pa.int64())), pa.array([x for _, x in rows], pa.list_(pa.float64()))],
                    names=["label", "weight", "at", "x"])

    found = stored(sample.mapInArrow(vectors, "label double, weight double, at array<long>, x array<double>"), "quality-vectors").where("size(at) > 0")
    axes = latent_axes(found, len(places), min(rank, len(places)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.values.to_numpy() @ axes[at.values.to_numpy()] for at, x in zip(batch.column("at"), batch.column("x"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("weight"), pa.array(rows, pa.list_(pa.float64()))], names=["label", "weight", "point"])

    voters = sorted(found.mapInArrow(project, "label double, weight double, point array<double>").collect())
    points = unit(np.array([r["point"] for r in voters]).reshape(len(voters), axes.shape[1]))
    return NeighbourModel(places, axes, points, np.array([r["label"] for r in voters]), np.array([r["weight"] for r in voters]), neighbours)


def score_quality(docs: DataFrame, model: NeighbourModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and score, 0 to 1, higher the more of the nearest labelled documents have label 1. Every document is
    compared with every voter, in blocks. Null and empty texts, and texts without a known term, have the share of label 1 among all labelled documents. The model, of
    a size that its parameters bound, is broadcast; rows with equal ids or texts are scored each; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        routes = Routes(m.places)
        for batch in batches:
            for part in slices(batch, "text"):
                points = m.points(part.column("text").to_pylist(), routes)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(m.votes(points), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, score double")
