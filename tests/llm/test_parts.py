"""The parts that run without Spark, against brute force."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streetloom.llm import crf, pieces
from streetloom.llm.embeddings import block_links, unit_rows
from streetloom.llm.packed_ids import BLOCK, from_bytes, pack, read_block, to_bytes, unpack
from streetloom.llm.pieces import Encoder, Pieces, alternative
from streetloom.llm.quality import repeated_words
from streetloom.llm.segments import chance_factor, decay_rate, maximal_segments, runs
from streetloom.llm.simhash import covering_masks
from streetloom.llm.token_files import WordEncoder


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(0, 40))
def test_packed_ids_round_trip(ids, times):
    ids = np.array(ids * times, dtype=np.uint64)
    words, offsets, upper = pack(ids)
    assert (unpack(words, upper) == ids).all()
    data = to_bytes([None, 5, -7], np.array([0, 0, len(ids)]), ids)
    numbers, lengths, back = from_bytes(data)
    assert numbers == [None, 5, -7] and lengths.tolist() == [0, 0, len(ids)] and (back == ids).all()
    for k in range(len(offsets) - 1):
        assert (read_block(data, k) == ids[k * BLOCK : (k + 1) * BLOCK]).all()


def test_broken_file_is_refused():
    data = bytearray(to_bytes([1], np.array([3]), np.array([7, 8, 9])))
    data[60] ^= 1
    with pytest.raises(ValueError):
        from_bytes(bytes(data))


@pytest.mark.parametrize("piece", [2, 3, 64])
@pytest.mark.parametrize("k", [2, 3])
def test_chain_against_all_paths(monkeypatch, piece, k):
    monkeypatch.setattr(crf, "PIECE", piece)
    rng = np.random.default_rng(piece * 10 + k)
    lengths = np.array([1, 5, 0, 7, 2, 6])
    scores, moves = rng.normal(size=(lengths.sum(), k)) * 2, rng.normal(size=(k, k))
    places, pairs = crf.forward_backward(scores, lengths, moves, pairs=True)
    best = crf.viterbi(scores, lengths, moves)
    at, wanted = 0, np.zeros((k, k))
    for n in lengths[lengths > 0]:
        paths = {y: sum(scores[at + t, y[t]] for t in range(n)) + sum(moves[y[t - 1], y[t]] for t in range(1, n)) for y in itertools.product(range(k), repeat=int(n))}
        total = sum(map(np.exp, paths.values()))
        for t in range(n):
            for j in range(k):
                assert places[at + t, j] == pytest.approx(sum(np.exp(s) for y, s in paths.items() if y[t] == j) / total)
        for y, s in paths.items():
            for t in range(1, n):
                wanted[y[t - 1], y[t]] += np.exp(s) / total
        assert tuple(best[at : at + n]) == max(paths, key=paths.get)
        at += n
    assert np.allclose(pairs, wanted)


def all_maximal(scores):
    """Ruzzo and Tompa's definition: split around the best segment (leftmost, shortest) and go on in both rests."""
    spans = [(sum(scores[a:b]), -a, -(b - a)) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    if not spans or max(spans)[0] <= 0:
        return []
    _, a, n = max(spans)
    a, b = -a, -a - n
    return [(x, y) for x, y in all_maximal(scores[:a])] + [(a, b)] + [(x + b, y + b) for x, y in all_maximal(scores[b:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-7, 7), max_size=14))
def test_segments_against_all_spans(raw):
    scores = [s + (k + 1) * 1e-3 for k, s in enumerate(raw)]  # no ties
    found = maximal_segments(scores)
    assert [(a, b) for a, b, _ in found] == all_maximal(scores)
    assert all(s == pytest.approx(sum(scores[a:b])) for a, b, s in found)


@given(st.lists(st.booleans(), max_size=40))
def test_runs_are_the_same_segments(marks):
    scores = [3.5 if m else -1.0 for m in marks]
    assert runs([(i, 3.5) for i, m in enumerate(marks) if m], len(marks), -1.0) == [pytest.approx(x) for x in maximal_segments(scores)]


def test_extreme_value_fit():
    lam = decay_rate(np.array([2.0] * 10), 1000, -1.0)
    assert (10 * np.exp(2 * lam) + np.exp(2 * lam) + 990 * np.exp(-lam)) / 1001 == pytest.approx(1, abs=1e-6)
    assert chance_factor(np.zeros(4), np.array([10.0] * 4), 1.0) == pytest.approx(0.1)


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2):
        masks = covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in itertools.combinations(range(64), radius):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words(words):
    windows = [tuple(words[k : k + 8]) for k in range(max(0, len(words) - 7))]
    assert repeated_words(words) == len({k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)})


def test_tiles_against_all_pairs():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 40))
    x = np.concatenate([centres[rng.integers(6, size=150)] + rng.normal(size=(150, 40)) * 0.12, rng.normal(size=(150, 40)), centres[[0]] * 7.0])
    copies = rng.integers(1, 4, size=len(x))
    unit = unit_rows(x)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1].copy()
    everything = np.arange(len(x))
    ids, links, roots = block_links(everything, x, copies, everything, everything, axes, 0.95, tile=64)
    assert dict(zip(ids.tolist(), links.tolist(), strict=True)) == {i: int((near[i] * copies).sum()) for i in everything.tolist() if near[i].any()}
    reach = np.linalg.matrix_power((near | np.eye(len(x), dtype=bool)).astype(float) / 50, 12) > 0
    assert all(r == np.nonzero(reach[i])[0][0] for i, r in zip(ids.tolist(), roots.tolist(), strict=True))


ODD = ["", " \n", "don't <|endoftext|> x<|startoftext|>y", "c\x1cd\x85e ＡＢΣΣ 12ab'S 'll", "İI ǅ \U0001F9FF ẞ ẹ́ Å", "'s't", "ÀÉß. Straße,, ÿÿ ŸŒœ a. .. ÷×", "힣 각 a b"]


def test_word_encoder_is_the_tokenizer():
    e = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in [*ODD, "The Thinking of the thing, again. " * 50]:
        assert np.frombuffer(e.encode(text.encode()), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_capitals_and_marks_do_not_tokenize_a_word_again(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    e, asked, plain = WordEncoder(path), [], WordEncoder.plain
    monkeypatch.setattr(WordEncoder, "plain", lambda self, letters: asked.append(letters) or plain(self, letters))
    texts = ["Word word, WORD. word,, wörd Wörd. WÖRD, x", "wörd word Ünter ünter. don't \u00d7 \u00ffa,"]
    for text in texts:
        assert list(memoryview(e.encode(text.encode())).cast("I")) == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == sorted(x.encode() for x in ("word", "wörd", "x", "ünter", "ÿa"))


def test_bounds_of_flat_vectors_leave_few_pairs_and_lose_none():
    from streetloom.llm.embeddings import STEPS, THRESHOLD, Side
    r = np.random.default_rng(5)
    x = unit_rows(r.normal(size=(1200, 64)))
    other = unit_rows(r.normal(size=(1200, 64)))
    other = unit_rows(other - (other * x).sum(axis=1, keepdims=True) * x)
    cosine = 0.95 + r.choice([-1e-9, -1e-12, 0, 1e-12, 1e-9], 1200)
    x = np.vstack((x, cosine[:, None] * x + np.sqrt(1 - cosine**2)[:, None] * other))
    axes = np.linalg.qr(r.normal(size=(64, 64)))[0]
    bounds = Side(x, axes, STEPS).bounds[STEPS[0]]
    assert np.count_nonzero(bounds @ bounds.T >= THRESHOLD - 1e-5) < 4 * len(x)
    n, ids, unit = len(x), np.arange(len(x)), unit_rows(x)
    met, links, _ = block_links(ids, x, np.ones(n, dtype=np.int64), ids, ids, axes, THRESHOLD)
    want = np.array([np.count_nonzero(np.einsum("ij,ij->i", unit, np.broadcast_to(u, unit.shape)) >= THRESHOLD) - 1 for u in unit])
    assert np.array_equal(met, np.nonzero(want)[0]) and np.array_equal(links, want[want > 0])


@pytest.mark.parametrize("n", [1, 2, 4])
def test_n_best_against_all_segmentations(n):
    e = Encoder(public_tokenizers.path("piece_bpe_32k.model"), n)
    p = e.pieces

    def paths(s, at=0):
        if at == len(s):
            return [(0.0, [])]
        ends = [k for k in range(at + 1, len(s) + 1) if s[at:k] in p.pieces]
        edges = [(k, p.scores[p.pieces[s[at:k]]], [p.pieces[s[at:k]]]) for k in ends]
        if at + 1 not in ends:
            edges.append((at + 1, p.worst, p.spare(s[at])))
        return [(x + y, ids + rest) for k, x, ids in edges for y, rest in paths(s, k)]

    for text in ("hello wor", "a b", "the\ncat", "éxß 中", "x▁y  z", "thethe an"):
        every = sorted(paths(e.normal(text)), key=lambda x: -x[0])
        ids, best = e.encode(text)
        assert [s for s, _ in best] == pytest.approx([s for s, _ in every[:n]])
        found = [alternative(ids, c) for _, c in best]
        assert len(set(found)) == len(found)
        for (score, _), f in zip(best, found, strict=True):
            assert (score, list(memoryview(f).cast("I"))) in [(pytest.approx(s), i) for s, i in every]
        assert e.decode(ids) == text.replace("▁", " ") == p.sp.decode(list(memoryview(ids).cast("I")))


def test_ids_are_those_of_the_model():
    e = Encoder(public_tokenizers.path("piece_bpe_32k.model"), 2)
    texts = ["The information about government policy", "different  words,\n\tx▁y \U0001F9FF\u2581 éxß 中", " ", "a" * 300, *ODD]
    for text, (own, _, _) in zip(texts, e.encode_both(texts), strict=True):
        assert list(memoryview(own).cast("I")) == e.pieces.sp.encode(text)
    assert len(e.encode_both(texts[:1])[0][0]) == 4 * 5


def test_stretches_end_where_no_piece_goes_on():
    e = Encoder(public_tokenizers.path("piece_bpe_32k.model"), 4)
    text = e.normal("Word, (word). word&&& déjà-vu 12,5  x")
    names = e.pieces.cut.findall(text)
    ends, starts = set(np.cumsum(list(map(len, names))).tolist()), {"▁Word", ",", "▁(", "word", ").", "▁word", "&&&", "▁déjà", "vu"}
    assert starts <= set(names) and "".join(names) == text
    for k in range(len(text)):
        for x in range(k + 1, len(text) + 1):
            assert text[k:x] not in e.pieces.pieces or not any(k < end < x for end in ends)
    e.encode_both(["one word, then", "the word. And a word"])
    assert sum("word" in x for x in e.known) == 1


def test_short_stretches_are_searched_side_by_side(monkeypatch):
    p = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(9)
    words = ["▁" + "".join(r.choice("abcdefghijklmnopéüß京Ŀ0123.,") for _ in range(r.randrange(0, 24))) for _ in range(400)] + ["aaaaaaaaaaaaaaaa", "▁", "ༀ"]
    for n in (1, 2, 4, 7):
        with monkeypatch.context() as m:
            m.setattr(pieces, "MANY", len(words) + 1)
            alone = list(p.best(words, n))
        with monkeypatch.context() as m:
            m.setattr(Pieces, "search", lambda *a: pytest.fail("a short stretch went alone"))
            assert list(p.best(words, n)) == alone
        assert max(map(len, alone)) == n
