"""Quality rules: base rules by counts, then lines labelled content or boilerplate by a linear-chain conditional random field."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.llm.common import SPACES, slices
from streetloom.llm.crf import forward_backward, viterbi

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
CONTENT_SHARE = 0.5
SAMPLE = 1500
SAMPLE_CHARS = 20_000
LINES_AT_ONCE = 1 << 16
ROUNDS = 60

#: Features of a line: each sort has as many values as it has bounds, and one more. One value of each holds.
SORTS = {
    "words": (3, 6, 11, 31), "word_length": (2.5, 4, 7, 12), "capital_words": (0.05, 0.2, 0.5, 0.9), "symbols_a_word": (0.02, 0.1, 0.3, 0.8), "bangs_a_word": (0.02, 0.1, 0.5),
    "digits": (0.02, 0.1, 0.3), "same_as_next_word": (0.02, 0.1, 0.4), "different_words": (0.3, 0.6, 0.9), "sentence_end": (0.5,), "seen_before": (0.5,), "marks_of_links": (0.5,), "edge": (0.5,),
}
STARTS = np.cumsum([0, *(len(b) + 1 for b in SORTS.values())])
N_FEATURES = int(STARTS[-1])
DIGIT, LINK = re.compile(r"[0-9]"), re.compile(r"://|www\.|@|©|\(c\)", re.IGNORECASE)


def mix(h: np.ndarray, factor: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(factor)
        return h ^ (h >> np.uint64(29))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more. Equal windows have equal hashes, so a text without equal hashes has none; windows
    with equal hashes are compared word by word."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter(map(known.setdefault, words, range(len(words))), dtype=np.int64, count=len(words))
    if len(known) == len(words):
        return 0
    h = np.zeros(n, dtype=np.uint64)
    word = mix(ids.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(window):
            h = h * np.uint64(0xD6E8FEB86659FD93) + word[j : j + n]
    order = np.argsort(h, kind="stable")
    twin = h[order[1:]] == h[order[:-1]]
    if not twin.any():
        return 0
    at = np.unique(np.concatenate((order[1:][twin], order[:-1][twin])))
    rows, inverse, counts = np.unique(ids[at[:, None] + np.arange(window)], axis=0, return_inverse=True, return_counts=True)
    at = at[counts[inverse.ravel()] > 1]
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int(np.count_nonzero(np.cumsum(change)))


def counts_of(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def line_features(text: str) -> np.ndarray:
    """Lines with a word x sorts: which value of each sort holds, as places in the weights."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    out = np.empty((len(lines), len(SORTS)))
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split() or [line]
        n, chars = len(words), sum(map(len, words))
        out[i] = (
            n, chars / n, sum(map(str.isupper, words)) / n, sum(map(line.count, SYMBOLS)) / n, line.count("!") / n, len(DIGIT.findall(line)) / chars,
            sum(map(operator.eq, words, words[1:])) / n, len(set(words)) / n, line.rstrip()[-1:] in ".?…", line in seen, LINK.search(line) is not None, i == 0 or i == len(lines) - 1)
        seen.add(line)
    return np.stack([np.searchsorted(np.array(b), out[:, j], side="right") + STARTS[j] for j, b in enumerate(SORTS.values())], axis=1) if lines else np.empty((0, len(SORTS)), np.int64)


@dataclass
class LineModel:
    """Weights of features and transitions; label 0 is content, label 1 boilerplate."""

    weights: np.ndarray
    transitions: np.ndarray

    def labels(self, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return viterbi(self.weights[places].sum(axis=1), lengths, self.transitions)


def fit(places: np.ndarray, lengths: np.ndarray, good: np.ndarray, rounds: int = ROUNDS) -> LineModel:
    """Fits the field on documents of known quality. Lines of good documents are content. Lines of bad ones are boilerplate where a
    classifier of single lines, fitted on the documents' labels first, finds them more likely so; the field then learns from the line labels in sequence."""
    weights = np.zeros((N_FEATURES, 2))
    line_bad = np.repeat(~good, lengths)
    if good.all() or not good.any() or not len(places):
        weights[0 : STARTS[1], 0] = 1.0
        return LineModel(weights, np.zeros((2, 2)))

    def climb(truth: np.ndarray, chain: bool) -> LineModel:
        w, t = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        target = np.stack([~truth, truth], axis=1).astype(float)
        inside = np.ones(len(places), dtype=bool)
        inside[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (truth[:-1][inside[1:]].astype(int), truth[1:][inside[1:]].astype(int)), 1)
        squares, squares_t = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
        alone = np.ones(len(places), dtype=np.int64)
        for _ in range(rounds):
            p, pairs = forward_backward(w[places].sum(axis=1), lengths if chain else alone, t, pairs=True)
            error = (target - p) / len(places)
            step = np.stack([np.bincount(places.ravel(), np.repeat(error[:, k], places.shape[1]), N_FEATURES) for k in (0, 1)], axis=1) - 1e-5 * w
            squares += step**2
            w += 0.3 * step / np.sqrt(squares)
            if chain:
                step_t = (seen - pairs) / len(places) - 1e-5 * t
                squares_t += step_t**2
                t += 0.2 * step_t / np.sqrt(squares_t)
        return LineModel(w, t)

    first = climb(line_bad, chain=False)
    likely = first.weights[places].sum(axis=1)
    return climb(line_bad & (likely[:, 1] > likely[:, 0]), chain=True)


def learn_lines(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> LineModel:
    """Fits the model on at most ``size`` documents (of up to SAMPLE_CHARS characters) of either quality, those whose ids have the lowest hashes; an id with
    several labels is bad if one of them says so, one with several texts has the smallest. The driver gets the features of their lines and nothing else. Without labelled documents of both
    kinds every line is content."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("known_id")).agg(F.min("quality").alias("quality"))
    order = F.xxhash64("known_id"), F.col("known_id")
    ids = known.where("quality = 1").orderBy(*order).limit(size).unionByName(known.where("quality = 0").orderBy(*order).limit(size))
    sample = docs.join(F.broadcast(ids), F.col(id_col) == F.col("known_id")).where(F.length(text_col) <= SAMPLE_CHARS).groupBy("known_id").agg(F.first("quality").alias("quality"), F.min(text_col).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features(t or "").ravel().tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("known_id"), batch.column("quality"), pa.array(found, pa.list_(pa.int32()))], names=["known_id", "quality", "places"])

    kind = sample.schema["quality"].dataType.simpleString()
    rows = sorted(sample.mapInArrow(measure, f"known_id long, quality {kind}, places array<int>").collect(), key=lambda r: (r["known_id"], r["places"]))
    lengths = np.array([len(r["places"]) // len(SORTS) for r in rows], dtype=np.int64)
    places = np.array([p for r in rows for p in r["places"]], dtype=np.int64).reshape(-1, len(SORTS))
    return fit(places, lengths, np.array([r["quality"] == 1 for r in rows], dtype=bool))


def judge_quality(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share (words in content lines
    of all words), line_labels (c, b, or - for a line without a word), kept.

    Words are runs of anything but ASCII space. The base fails under LEAST_WORDS words or with over REPEAT_PERCENT % of the words in repeated windows.
    Null and empty texts have no words and fail. Whole texts are read, of any length."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "text")):
            ids, texts = part.column("doc_id"), [t or "" for t in part.column("text").to_pylist()]
            start, held, places = 0, 0, []
            for i, text in enumerate(texts):
                places.append(line_features(text))
                held += len(places[-1])
                if held >= LINES_AT_ONCE or i == len(texts) - 1:
                    yield verdicts(ids[start : i + 1], texts[start : i + 1], places)
                    start, held, places = i + 1, 0, []

    def verdicts(ids: pa.Array, texts: list[str], places: list[np.ndarray]) -> pa.RecordBatch:
        labels = model.labels(np.concatenate(places), np.array([len(p) for p in places]))
        rows, at = [], 0
        for text in texts:
            n_words, *counts = counts_of(text)
            marks, content = [], 0
            for line in text.split("\n"):
                if not line.strip(SPACES):
                    marks.append("-")
                    continue
                marks.append("cb"[labels[at]])
                content += 0 if labels[at] else len(line.encode("utf-8", "surrogatepass").split())
                at += 1
            failed = n_words < LEAST_WORDS or 100 * counts[3] > REPEAT_PERCENT * n_words
            part = content / n_words if n_words else 0.0
            rows.append((n_words, *counts, failed, part, "".join(marks), not failed and part >= share))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "line_labels", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, line_labels string, kept boolean")
