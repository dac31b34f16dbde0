"""Collocations by stripes: each prefix keys a counter of the words that come next."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from streetloom.llm.common import slices, stored

LEAST = 10
WORDS = 3
TOP = 2000
SUBSUMED = 50
SCALE = 1_000_000
#: A prefix with one in HEAVY of all words, or more, has its stripe in SHARDS parts; there are HEAVY such prefixes at most.
HEAVY, SHARDS = 10_000, 64
HELD = 1 << 21
WAITING = 1 << 16
ID_BITS = 20
CHUNK = 1 << 20
SALT = 64
MAP_BITS = 26
#: Cuts pieces apart; no UTF-8 text holds this byte.
CUT = b"\xff"
PIECES = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", CUT * 10)
GAP = re.compile(rb"[\x20\x09\xff]")
STRIPE = "lang string, size int, prefix binary, shard int, nexts array<binary>, counts array<long>"


def token_runs(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, lower-cased in ASCII, with CUT between pieces; about CHUNK bytes at a time, cut between words."""
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + CHUNK)
        stop = gap.start() if gap else len(text)
        yield text[start:stop].replace(CUT, b" \xff ").split()
        start = stop


def word_code(lang: str, word: bytes) -> int:
    return zlib.crc32(word, zlib.crc32(lang.encode("utf-8", "surrogatepass")))


def place(code: int) -> int:
    """The bit of a single word, as in ``places``."""
    h = code * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 29) >> 64 - MAP_BITS


def places(codes: list[np.ndarray]) -> np.ndarray:
    """Bits of phrases given by the codes of their words, one array per place."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes[0]), dtype=np.uint64)
        for c in codes:
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


class Words(dict):
    """Numbers of the words of one language, from 1; CUT has 0. ``codes`` and ``common``, whether a word has its bit, are there for the words up to the last ``look``."""

    def __init__(self, lang: str, bits: bytes | None):
        super().__init__({CUT: 0})
        self.seed, self.bits, self.names = word_code(lang, b""), bits, [CUT]
        self.codes, self.common = np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=bool)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append(word)
        return number

    def look(self) -> None:
        more = self.names[len(self.codes) :]
        codes = np.fromiter(map(zlib.crc32, more, repeat(self.seed)), np.uint64, len(more))
        found = np.ones(len(more), dtype=bool) if self.bits is None else is_set(np.frombuffer(self.bits, dtype=np.uint8), places([codes]))
        self.codes, self.common = np.concatenate((self.codes, codes)), np.concatenate((self.common, found))


class Stripes:
    """What one task has counted of phrases of ``size`` words and a next word: for each language, prefix -> next word -> count. It combines before the
    shuffle and is given away when it holds HELD phrases (single words are sums of a task) or 2^ID_BITS words. Only phrases are counted whose shorter ones have their bit in
    ``common`` (``common[k]``: of phrases of k + 1 words). Texts wait, as numbers of their words, until there are WAITING of them."""

    def __init__(self, size: int, common: list[bytes], heavy: frozenset[tuple[str, bytes]] = frozenset()):
        self.size, self.common, self.heavy = size, common, heavy
        self.words: dict[str, Words] = {}
        self.runs: dict[str, array] = {}
        self.phrases: dict[str, list[np.ndarray]] = {}
        self.singles: dict[str, np.ndarray] = {}
        self.waiting, self.held = 0, 0

    def add(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        for tokens in token_runs(text.lower().translate(PIECES)):
            full = sum(map(len, self.words.values())) + len(tokens) >= 1 << ID_BITS
            if full or self.size and self.held + self.waiting + len(tokens) > HELD:
                yield from self.give()
            if full:
                last = [self.words[lang].names[i] for i in self.runs.get(lang, ())]
                self.words, self.runs = {}, {}
                self.number(lang, last)
            self.number(lang, tokens)
            if self.waiting >= WAITING:
                self.count_all()
        if lang in self.runs:
            self.runs[lang].append(0)

    def number(self, lang: str, tokens: list[bytes]) -> None:
        if lang not in self.words:
            self.words[lang] = Words(lang, self.common[0] if self.common else None)
        self.runs.setdefault(lang, array("q")).extend(map(self.words[lang].__getitem__, tokens))
        self.waiting += len(tokens)

    def count_all(self) -> None:
        """Counts what waits; of each language the last ``size`` words stay, since the text may go on."""
        for lang, waits in self.runs.items():
            run = np.array(waits, dtype=np.int64)
            self.runs[lang] = waits[len(waits) - min(self.size, len(waits)) :]
            if self.size:
                self.count(lang, run)
            else:
                sums = np.bincount(run, minlength=len(self.words[lang].names))
                if lang in self.singles:
                    sums[: len(self.singles[lang])] += self.singles[lang]
                self.singles[lang] = sums
        self.waiting = 0

    def count(self, lang: str, run: np.ndarray) -> None:
        n, words = len(run) - self.size, self.words[lang]
        if n <= 0:
            return
        words.look()
        good = words.common[run]
        at = np.nonzero(np.all([good[k : k + n] for k in range(self.size + 1)], axis=0))[0]
        if self.size > 1:
            bits = np.frombuffer(self.common[self.size - 1], dtype=np.uint8)
            for k in (0, 1):
                at = at[is_set(bits, places([words.codes[run[at + k + j]] for j in range(self.size)]))]
        key = run[at]
        for k in range(1, self.size + 1):
            key = key << ID_BITS | run[at + k]
        self.phrases.setdefault(lang, []).append(key)
        self.held += len(key)

    def give(self) -> Iterator[pa.RecordBatch]:
        """Rows of STRIPE, and, with words, one of size -1 per language with its number of words."""
        self.count_all()
        if self.singles:
            many = len(self.singles)
            yield stripe_rows(list(self.singles), -1, [b""] * many, np.arange(many), [b""] * many, np.array([x[1:].sum() for x in self.singles.values()]), np.zeros(many, dtype=bool))
        mask = (1 << ID_BITS) - 1
        for lang, parts in (self.phrases or self.singles).items():
            if self.size:
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            else:
                keys = np.nonzero(parts[1:])[0] + 1
                counts = parts[keys]
            names = self.words[lang].names
            if not len(keys):
                continue
            prefix, next_ = keys >> ID_BITS, keys & mask
            heads, code = np.unique(prefix, return_inverse=True) if self.size else (np.zeros(1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64))
            spelled = [b" ".join([names[h >> ID_BITS * k & mask] for k in range(self.size - 1, -1, -1)]) for h in heads.tolist()]
            split = np.array([self.size == 0 or (lang, p) in self.heavy for p in spelled])
            yield stripe_rows([lang], self.size, spelled, code, [names[i] for i in next_.tolist()], counts, split)
        self.phrases, self.singles, self.held = {}, {}, 0


def stripe_rows(langs: list[str], size: int, prefixes: list[bytes], prefix: np.ndarray, nexts: list[bytes], counts: np.ndarray, split: np.ndarray) -> pa.RecordBatch:
    """Entries as stripes: one row per prefix, or per prefix and part where it is ``split`` by its next words."""
    shards = np.zeros(len(nexts), dtype=np.int32)
    for i in np.nonzero(split[prefix])[0].tolist():
        shards[i] = zlib.crc32(nexts[i]) % SHARDS
    order = np.lexsort((shards, prefix))
    first = np.nonzero(np.append(True, (np.diff(prefix[order]) != 0) | (np.diff(shards[order]) != 0)))[0]
    offsets, lead = pa.array(np.append(first, len(order)), pa.int32()), order[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(langs if size < 0 else langs * len(first), pa.string()), pa.array(np.full(len(first), size), pa.int32()), pa.array(prefixes, pa.binary()).take(pa.array(prefix[lead])),
         pa.array(shards[lead]), pa.ListArray.from_arrays(offsets, pa.array(nexts, pa.binary()).take(pa.array(order))), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)[order]))],
        names=["lang", "size", "prefix", "shard", "nexts", "counts"])


def stripes(docs: DataFrame, size: int, common: list[Broadcast], heavy: frozenset[tuple[str, bytes]], text_col: str, lang_col: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stripes(size, [b.value for b in common], heavy)
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    yield from held.add(lang, text)
        yield from held.give()

    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(count, STRIPE)


def merged_stripes(docs: DataFrame, size: int, least: int, common: list[Broadcast], heavy: frozenset[tuple[str, bytes]], text_col: str, lang_col: str) -> DataFrame:
    """lang, size, phrase, f of the phrases of ``size`` + 1 words that occur ``least`` times or more. Stripes are dealt by (language, prefix, part) and merged there elementwise."""
    dealt = stripes(docs, size, common, heavy, text_col, lang_col).repartition("lang", "size", "prefix", "shard")
    entries = dealt.select("lang", "size", "prefix", "shard", F.explode(F.arrays_zip("nexts", "counts")).alias("x"))
    merged = entries.groupBy("lang", "size", "prefix", "shard", F.col("x.nexts").alias("next")).agg(F.sum("x.counts").alias("f"))
    phrase = F.when(F.col("size") > 0, F.concat_ws(" ", F.col("prefix").cast("string"), F.col("next").cast("string"))).otherwise(F.col("next").cast("string"))
    return merged.where((F.col("size") < 0) | (F.col("f") >= least)).select("lang", F.when(F.col("size") < 0, -1).otherwise(F.col("size") + 1).alias("size"), phrase.alias("phrase"), "f")


def bit_map(phrases: DataFrame) -> Broadcast:
    """The bits of ``phrases``, 2^MAP_BITS of them however many phrases there are. A bit that several phrases share lets a rare phrase be counted, no more."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [[word_code(lang, w) for w in phrase.encode("utf-8", "surrogatepass").split(b" ")] for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(places(list(np.array(codes, dtype=np.uint64).T)) if codes else [], pa.int64())], names=["at"])

    found = phrases.select("lang", "phrase").mapInArrow(mark, "at long").groupBy(F.shiftright("at", 6).alias("row")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << MAP_BITS - 6, dtype="<i8")
    bits[found.column("row").to_numpy()] = found.column("bits").to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(bits.tobytes())


def phrase_counts(docs: DataFrame, words: int, least: int, text_col: str, lang_col: str) -> DataFrame:
    """lang, size, phrase, f of every phrase of up to ``words`` words that occurs ``least`` times or more, and of every language its number of words (size -1).

    A phrase's parts occur as often as it does. So words are counted first, then pairs of common words, then triples of common pairs; which are common goes to the
    tasks as bits of fixed number."""
    levels, common, heavy, total = [], [], frozenset(), 0
    for size in range(words):
        levels.append(stored(merged_stripes(docs, size, least, common, heavy, text_col, lang_col), "phrases"))
        if size < words - 1:
            common.append(bit_map(levels[-1].where(F.col("size") > 0)))
            total = total or levels[0].where("size = -1").agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
            most = levels[-1].where((F.col("size") > 0) & (F.col("f") * HEAVY >= total)).select("lang", "phrase").collect()
            heavy = frozenset((r["lang"], r["phrase"].encode("utf-8", "surrogatepass")) for r in most)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)), exact: counts of up to 14 digits, whose products pass 64 bits, as decimals."""
    d = {x: f"cast({x} as decimal(14,0))" for x in (a, left, right)}
    return F.expr(f"({d[a]} * {d[a]} * cast({SCALE} as decimal(7,0))) div ({d[left]} * {d[right]})")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", words: int = WORDS, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language.

    Texts are lower-cased in ASCII and cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. Null texts are empty, null languages are ``und``. A phrase of
    2 to ``words`` words that occurs ``least`` times is a candidate; of its cuts in two the one that scores lowest counts (ties: after fewer words). It goes if a longer candidate
    holds it and occurs in ``subsumed`` percent of its places or more. Order: score and count, largest first, then the phrase by its bytes. Empty tables and languages without candidates have no rows;
    rows with equal ids count each; other columns are not read. ``words`` is 2 or 3."""
    if words not in (2, 3):
        raise ValueError("phrases of two or three words")
    found = phrase_counts(docs, words, least, text_col, lang_col)
    counts = found.where("size > 0").select("lang", "phrase", "f")
    candidates = found.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns(
        {"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")})
    heads = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "left"]).join(tails, ["lang", "right"]).withColumn("score", score("a", "l", "r"))
    best = scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")
    if words > 2:
        held = candidates.where("size > 2").withColumn("inner", F.explode(inner_phrases(words))).groupBy("lang", F.col("inner").alias("phrase")).agg(F.max("a").alias("over"))
        best = best.join(held, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < subsumed * F.col("a")))
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    # First the best of parts of a language, then of those: no task sorts all candidates of one.
    parts = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("nth") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = found.where("size = -1").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def inner_phrases(words: int) -> Column:
    """All runs of 2 or more words inside ``phrase``, shorter than it."""
    parts = F.split("phrase", " ")
    runs = [F.when((F.col("size") > n) & (F.col("size") >= s + n), F.array_join(F.slice(parts, s + 1, n), " ")) for n in range(2, words) for s in range(words - n + 1)]
    return F.array_distinct(F.array_compact(F.array(*runs)))
