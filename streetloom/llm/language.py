"""Language of each word and document: a linear-chain conditional random field over affixes, character n-grams and a lexicon."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from streetloom.llm.common import id_crc, slices
from streetloom.llm.crf import forward_backward

WORDS = re.compile(r"[^\W\d_]+")
SAMPLE = 300
SAMPLE_CHARS = 20_000
LANGUAGES = 100
TRAIN_WORDS = 150_000
FRAGMENT = 12
WHOLE = 400
ROUNDS = 25
BUCKETS = 1 << 18
HELD = 300_000
AT_ONCE = 1 << 18
NONE = "und"
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. Fractions, superscripts, circled and Roman numerals are numbers that the pattern takes along; they part words."""
    found = WORDS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ((w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def bucket(codes: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of rows of character codes; ``kind`` keeps sorts of features apart."""
    with np.errstate(over="ignore"):
        h = np.full(len(codes), kind * 0x27D4EB2F165667C5 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for j in range(codes.shape[1]):
            h = (h ^ codes[:, j]) * MIX[j]
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(13)).astype(np.int64) & (BUCKETS - 1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word, value) of all features: n-grams of one to three characters with word ends (together as much as one feature),
    prefixes and suffixes of up to three characters, and the word itself."""
    lengths = np.array([len(w) + 2 for w in words])
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    begin = np.cumsum(lengths) - lengths
    end = begin + lengths - 1
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for n in (1, 2, 3):
        at = np.nonzero(owner[: len(codes) - n + 1] == owner[n - 1 :])[0]
        out.append((bucket(np.stack([codes[at + j] for j in range(n)], axis=1), n), owner[at], 3.0 / lengths[owner[at]]))
        has = np.nonzero(lengths - 2 >= n)[0]
        for kind, place in ((10 + n, begin[has] + 1), (20 + n, end[has] - n)):
            out.append((bucket(np.stack([codes[place + j] for j in range(n)], axis=1), kind), has, np.ones(len(has))))
    whole = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
    out.append((bucket(whole[:, None], 30), np.arange(len(words)), np.ones(len(words))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class LanguageModel:
    """One weight per bucket and language, and one per transition: a fixed size for a given number of languages."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        at, word, value = features(words)
        return np.stack([np.bincount(word, self.weights[at, k] * value, len(words)) for k in range(len(self.languages))], axis=1)


class Tagger:
    """Expected words of each language in a text. Scores of words are kept for the next texts, HELD words at most."""

    def __init__(self, model: LanguageModel):
        self.model, self.rows = model, {}
        self.table = np.empty((HELD + AT_ONCE, len(model.languages)))

    def ids(self, words: list[str]) -> list[int]:
        rows = self.rows
        fresh = list(set(words).difference(rows))
        if len(rows) + len(fresh) > HELD:
            rows.clear()
            fresh = list(set(words))
        for s in range(0, len(fresh), 1 << 15):
            part = fresh[s : s + (1 << 15)]
            self.table[len(rows) : len(rows) + len(part)] = self.model.scores(part)
            rows.update(zip(part, range(len(rows), len(rows) + len(part)), strict=True))
        return list(map(rows.__getitem__, words))

    def expected(self, texts: list[str | None]) -> np.ndarray:
        """Rows: texts; columns: languages. Texts are worked together, up to AT_ONCE words; a longer one goes in stretches of that
        length, each a chain of its own."""
        total = np.zeros((len(texts), len(self.model.languages)))
        words: list[str] = []
        lengths: list[int] = []
        owners: list[int] = []

        def flush() -> None:
            if words:
                places = forward_backward(self.table[self.ids(words)], np.array(lengths), self.model.transitions)[0]
                np.add.at(total, owners, np.add.reduceat(places, np.cumsum(lengths) - lengths, axis=0))
                words.clear()
                lengths.clear()
                owners.clear()

        for i, text in enumerate(texts):
            found = words_of(text or "")
            for s in range(0, len(found), AT_ONCE):
                part = found[s : s + AT_ONCE]
                if len(words) + len(part) > AT_ONCE:
                    flush()
                words.extend(part)
                lengths.append(len(part))
                owners.append(i)
        flush()
        return total


def spliced(texts: list[list[list[str]]], total: int, seed: int = 11) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Training sequences: fragments of sample texts of one language after the other, so that changes of language are seen; every
    fourth sequence is one text, or WHOLE words from any place of it. Returns words, labels and lengths."""
    rng = np.random.default_rng(seed)
    words, labels, lengths = [], [], []
    known = [k for k, t in enumerate(texts) if t]
    while len(words) < total:
        start = len(words)
        if len(lengths) % 4 == 0:
            k = known[len(lengths) // 4 % len(known)]
            text = texts[k][rng.integers(len(texts[k]))]
            at = rng.integers(max(1, len(text) - WHOLE + 1))
            words.extend(text[at : at + WHOLE])
            labels.extend([k] * len(text[at : at + WHOLE]))
        else:
            for _ in range(rng.integers(2, 6)):
                k = known[rng.integers(len(known))]
                text = texts[k][rng.integers(len(texts[k]))]
                at = rng.integers(max(1, len(text) - FRAGMENT))
                part = text[at : at + 1 + rng.geometric(1 / FRAGMENT)]
                words.extend(part)
                labels.extend([k] * len(part))
        lengths.append(len(words) - start)
    return words, np.array(labels), np.array(lengths)


def fit(languages: list[str], texts: list[list[list[str]]], total: int = TRAIN_WORDS, rounds: int = ROUNDS) -> LanguageModel:
    """Weights by AdaGrad on the log-likelihood of the spliced sequences."""
    k = len(languages)
    weights, transitions = np.zeros((BUCKETS, k)), np.zeros((k, k))
    if k < 2:
        return LanguageModel(languages, weights, transitions)
    words, labels, lengths = spliced(texts, total)
    unique, ids = np.unique(np.array(words, dtype=object), return_inverse=True)
    at, word, value = features(list(unique))
    truth = np.zeros((len(words), k))
    truth[np.arange(len(words)), labels] = 1
    inside = np.ones(len(words), dtype=bool)
    inside[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (labels[:-1][inside[1:]], labels[1:][inside[1:]]), 1)
    squares, squares_t = np.full(BUCKETS, 1e-8), np.full((k, k), 1e-8)
    for _ in range(rounds):
        scores = np.stack([np.bincount(word, weights[at, j] * value, len(unique)) for j in range(k)], axis=1)
        places, pairs = forward_backward(scores[ids], lengths, transitions, pairs=True)
        error = (truth - places) / len(words)
        by_word = np.stack([np.bincount(ids, error[:, j], len(unique)) for j in range(k)], axis=1)
        step = np.stack([np.bincount(at, by_word[word, j] * value, BUCKETS) for j in range(k)], axis=1) - 1e-7 * weights
        squares += (step**2).sum(axis=1)
        weights += 0.5 * step / np.sqrt(squares)[:, None]
        step_t = (seen - pairs) / len(words)
        squares_t += step_t**2
        transitions += 0.3 * step_t / np.sqrt(squares_t)
    return LanguageModel(languages, weights.astype(np.float32), transitions)


def learn_languages(docs: DataFrame, size: int = SAMPLE, limit: int = LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits the model on about ``size`` documents of each language (of up to SAMPLE_CHARS characters), chosen by a hash of the id among rows with a language whose
    crc32 mod 4 is not 2; at most the ``limit`` most frequent languages. It learns from
    TRAIN_WORDS words, drawn with repetition. The driver gets this sample and nothing else."""
    known = docs.where(F.col(lang_col).isNotNull() & F.coalesce(id_crc(F.col(id_col)) % 4 != 2, F.lit(False))).where(
        F.length(text_col).between(1, SAMPLE_CHARS)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(limit).collect()
    if not counts:
        return LanguageModel([], np.zeros((0, 0)), np.zeros((0, 0)))
    rare = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2 * size / r["n"]))])
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    drawn = known.where(draw < F.coalesce(F.try_element_at(rare, F.col("lang")), F.lit(0.0)))
    ranked = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text"))).where(F.col("nth") <= size)
    texts: dict[str, list[list[str]]] = {r["lang"]: [] for r in counts}
    for r in ranked.select("lang", "text").orderBy("lang", "text").collect():
        words = words_of(r["text"])
        if words:
            texts[r["lang"]].append(words)
    languages = sorted(lang for lang, t in texts.items() if t)
    return fit(languages, [texts[lang] for lang in languages])


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, words (language -> expected words of that language). The prediction is the
    language with the most expected words (ties: the lower by code point), the score its share. Null texts, texts without a letter, and all texts if no language
    was learned are ``und`` with score 0."""
    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model) if model.languages else None
        for part in (p for batch in batches for p in slices(batch, "text")):
            texts = part.column("text").to_pylist()
            total = tagger.expected(texts) if tagger else np.zeros((len(texts), 1))
            best, sums = total.argmax(axis=1), total.sum(axis=1)
            share = np.divide(total.max(axis=1), sums, out=np.zeros(len(texts)), where=sums > 0)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([model.languages[b] if s > 0 else NONE for b, s in zip(best, sums, strict=True)], pa.string()),
                pa.array(np.minimum(share, 1.0)),
                pa.array([list(zip(model.languages, row.tolist(), strict=True)) if s > 0 else [] for row, s in zip(total, sums, strict=True)], pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tag, "doc_id long, lang_pred string, score double, words map<string,double>")
