"""Queries against DuckDB, and against plain Python where there is no SQL, on the smallest tables."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from streetloom.llm import catalog
from streetloom.llm.pieces import Encoder
from tests.conftest import SMALL
from tests.oracle import connect, rows


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    df = catalog.queries()[name](spark, SMALL)
    mine = rows(df.columns, df.collect())
    cur = connect(SMALL).execute(catalog.oracle_sql()[name])
    assert mine and mine == rows([d[0] for d in cur.description], cur.fetchall())


def test_a_query_for_each_operator():
    assert [n.split("_")[0] for n in catalog.queries()] == [f"op{k}" for k in range(1, 14)]


def test_simhash_against_all_pairs(spark):
    got = {r.doc_id: r for r in catalog.queries()["op3_simhash_near_dedup"](spark, SMALL).collect()}
    docs = connect(SMALL).execute("SELECT doc_id, text FROM documents").fetchall()
    prints = {}
    for i, text in docs:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i].fingerprint == f"{prints[i]:016x}"
    assert {i: r.component_id for i, r in got.items()} == classes(prints)


def classes(prints: dict) -> dict:
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(prints), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_token_files_against_the_library(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in catalog.queries()["op10_token_files"](spark, SMALL).collect()}
    start = 0
    for i, text in connect(SMALL).execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_quality_counts_against_plain_python(spark):
    got = {r.doc_id: r for r in catalog.queries()["op6_quality_rules"](spark, SMALL).collect()}
    for i, text in connect(SMALL).execute("SELECT doc_id, text FROM documents").fetchall():
        words = (text or "").encode().split()
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        often = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        r = got[i]
        assert r.n_words == len(words) and r.word_chars == sum(len(w.decode()) for w in words)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "") and r.n_dup_lines == len(lines) - len(set(lines))
        if often is not None:
            assert r.n_repeat_words == len({k + j for k, w in enumerate(windows) if w in often for j in range(8)})
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words)) and not (r.base_failed and r.kept)


MEDIUM = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    truth = dict(connect(MEDIUM).execute("SELECT doc_id, lang FROM documents").fetchall())
    held = [r for r in catalog.queries()["op8_language_id"](spark, MEDIUM).collect() if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert len(held) > 200 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_toxicity_on_held_out_documents(spark):
    truth = dict(connect(MEDIUM).execute("SELECT doc_id, toxic FROM labels").fetchall())
    got = catalog.queries()["op4_toxicity"](spark, MEDIUM).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 1000 and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert np.mean([r.predicted for r in held if truth[r.doc_id]]) > 0.7
    assert np.mean([r.predicted for r in held if not truth[r.doc_id]]) < 0.02


def test_quality_keeps_clean_documents(spark):
    truth = dict(connect(MEDIUM).execute("SELECT doc_id, quality FROM labels").fetchall())
    got = [r for r in catalog.queries()["op6_quality_rules"](spark, MEDIUM).collect() if r.doc_id in truth and not r.base_failed]
    assert np.mean([r.kept for r in got if truth[r.doc_id]]) > 0.98 and np.mean([r.kept for r in got if not truth[r.doc_id]]) < 0.2


def test_pieces_round_trip(spark):
    got = catalog.queries()["op9_sentencepiece"](spark, SMALL).collect()
    assert len(got) == len(connect(SMALL).execute("SELECT doc_id FROM documents").fetchall())
    assert all(r.round_trip and list(r.scores) == sorted(r.scores, reverse=True) for r in got)


def test_query_ids_are_those_of_the_model(spark):
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: sp.encode(t or "") for i, t in connect(SMALL).execute("SELECT doc_id, text FROM documents").fetchall()}
    for r in catalog.queries()["op9_sentencepiece"](spark, SMALL).collect():
        assert (r.n_pieces, r.ids_crc32) == (len(want[r.doc_id]), zlib.crc32(np.array(want[r.doc_id], dtype="<u4").tobytes()))


def test_four_best_of_every_text_with_as_many(spark):
    e = Encoder(public_tokenizers.path("piece_bpe_32k.model"), 4)
    want = {i: [s for s, _ in e.encode(t or "")[1]] for i, t in connect(SMALL).execute("SELECT doc_id, text FROM documents").fetchall()}
    assert max(map(len, want.values())) == 4
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for got in (catalog.queries()["op9_sentencepiece"](spark, SMALL), corpus_pipeline.sentencepiece(spark, docs, SMALL)):
        assert all(list(r.scores) == pytest.approx(want[r.doc_id]) for r in got.collect())
