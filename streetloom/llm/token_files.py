"""Token ids of whole documents, written as packed files in order of doc_id and read back."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from streetloom.llm.common import LAST_ID, slices, stored
from streetloom.llm.packed_ids import from_bytes, to_bytes
from streetloom.session import shared_path

END_ID = 1
FILE_IDS = 1 << 22
CACHE_WORDS = 600_000
WORDS_A_CALL = 5_000


ASCII = re.compile(rb"([A-Za-z]+)([.,]*)")
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]*)")
#: How a byte-level vocabulary writes bytes: the printable ones of Latin-1 as they are, the others as characters from 256 up.
HIDDEN = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


class WordEncoder:
    """Ids of whole texts, by their words. The tokenizer cuts at white space before it merges, so a text's ids are those of its words
    one after the other; a word is encoded once and then looked up. The store is emptied when it holds ``CACHE_WORDS``. Latin words,
    which need no other cleaning than lower case, go to the tokenizer's model at once; that is how most new words come. What is left of such a word
    without capitals and marks is a word too, so it is kept and looked up as one."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {b"": b""}

    def whole(self, words: list[str]) -> list[bytes]:
        """Ids of each word by all steps of the tokenizer."""
        found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4").tobytes()
        ends = (np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(words)), side="right") * 4).tolist()
        return [ids[b:e] for b, e in zip([0, *ends], ends, strict=False)]

    def plain(self, letters: bytes) -> bytes:
        """Ids of Latin letters in lower case."""
        text = letters.decode() if letters.isascii() else letters.decode("latin-1").translate(HIDDEN)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def learn(self, words: list[bytes]) -> None:
        others, known = [], self.known
        for word in words:
            if (found := ASCII.fullmatch(word)) is not None:
                letters, marks = found[1].lower(), found[2]
            elif (found := PLAIN.fullmatch(text := word.decode("utf-8", "replace"))) is not None:
                letters, marks = found[1].lower().encode(), found[2].encode()
            else:
                others.append((word, text))
                continue
            if (mark := self.marks.get(marks)) is None:
                mark = self.whole([marks.decode()])[0]
                if len(self.marks) < 64:
                    self.marks[marks] = mark
            if (ids := known.get(letters)) is None:
                ids = known[letters] = self.plain(letters)
            if word != letters:
                known[word] = ids + mark
        for s in range(0, len(others), WORDS_A_CALL):
            part = others[s : s + WORDS_A_CALL]
            self.known.update(zip((w for w, _ in part), self.whole([t for _, t in part]), strict=True))

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids, without an end id."""
        words = text.split()
        fresh = set(words).difference(self.known)
        if fresh:
            if len(self.known) + 2 * len(fresh) > CACHE_WORDS:
                self.known.clear()
                fresh = set(words)
            self.learn(list(fresh))
        return b"".join(map(self.known.__getitem__, words))


_encoders: dict[str, WordEncoder] = {}


def encoder(tokenizer_path: str) -> WordEncoder:
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = WordEncoder(tokenizer_path)
    return _encoders[tokenizer_path]


def write_whole(path: str, data: bytes) -> None:
    """Writes under a name of its own and renames, so that a repeated task replaces the file with the same bytes."""
    system, plain = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    system.create_dir(os.path.dirname(plain), recursive=True)
    draft = f"{os.path.dirname(plain)}/_{os.path.basename(plain)}.{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, plain)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
                      file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of every row's whole text, each with ``end_id`` after it, into ``folder``; returns one row per file: file, n_docs,
    n_ids. File names sort in ascending order of the document ids, rows without id last, rows with the same id by text.

    Documents are dealt by ranges of ids and then encoded in order; a task closes a file when it has ``file_ids`` ids or more, so it
    holds one file's ids and one batch of texts. Null and empty texts are the end id alone."""
    last = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("ident")
    rows = docs.select(last, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("ident", F.col("doc_id").isNull()).sortWithinPartitions("ident", F.col("doc_id").isNull(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer_path).encode, TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        ids, parts, held, seq = [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{task:06d}-{seq:06d}.s8b"
            lengths = np.array([len(p) // 4 for p in parts], dtype=np.int64)
            write_whole(f"{folder}/{name}", to_bytes(ids, lengths, np.frombuffer(b"".join(parts), dtype="<u4")))
            return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(ids)], "n_ids": [int(lengths.sum())]})

        for part in (p for batch in batches for p in slices(batch, "text")):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                ids.append(doc_id)
                parts.append(encode(text) + end)
                held += len(parts[-1]) // 4
                if held >= file_ids:
                    yield close()
                    ids, parts, held, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    return stored(rows.mapInArrow(write, "file string, n_docs long, n_ids long"), "token-files")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files in ``folder``, from their bytes alone: doc_id, file, before (ids of the file's documents before it), n_tokens,
    ids (little-endian unsigned 32-bit)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, lengths, ids = from_bytes(batch.column("content")[k].as_py())
                data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                for s in range(0, len(doc_ids), 512):
                    e = min(s + 512, len(doc_ids))
                    begins = (ends - lengths)[s:e].tolist()
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(doc_ids[s:e], pa.int64()), "file": [batch.column("file")[k].as_py()] * (e - s), "before": begins,
                        "n_tokens": lengths[s:e].tolist(), "ids": pa.array([bytes(data[4 * b : 4 * f]) for b, f in zip(begins, ends[s:e].tolist(), strict=True)], pa.binary())})

    return files.mapInArrow(read, "doc_id long, file string, before long, n_tokens long, ids binary")


def token_index(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Writes the files and reads them back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. Empty input gives
    no rows."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "packed-ids")
    written = write_token_files(docs, folder, tokenizer_path, **options)
    total = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    base = written.select("file", F.coalesce(F.sum("n_ids").over(total), F.lit(0)).alias("base"))
    if written.isEmpty():
        return written.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("ids_crc32"))
    read = read_token_files(spark, folder).select("doc_id", "file", "before", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return read.join(base, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
