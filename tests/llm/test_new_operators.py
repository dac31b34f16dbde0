"""Neighbour votes, collocations and clusters: brute force, held-out accuracy and awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from streetloom.llm import catalog
from streetloom.llm.clusters import Centroids, cluster_vectors, reassign, search, squared
from streetloom.llm.neighbours import Routes, learn_neighbours, score_quality, term_counts
from streetloom.llm.phrases import Stripes, collocations
from streetloom.llm.phrases import score as phrase_score
from tests.conftest import SMALL
from tests.llm.fixtures import VECTORS, doc_rows, docs, long_text, plain_docs
from tests.oracle import connect

LABELS = "doc_id long, quality int, toxic int"


def quality_labels(spark, rows):
    return spark.createDataFrame(list(rows), LABELS)


# ---- neighbours ----------------------------------------------------------------------------------------------------

def test_votes_are_those_of_all_labelled_documents(spark):
    """Every score again from the model's voters, one cosine at a time."""
    con = connect(SMALL)
    texts = con.execute("SELECT doc_id, text FROM documents").fetchall()
    tables = [spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")]
    model = learn_neighbours(*tables)
    got = {r.doc_id: r.score for r in score_quality(tables[0], model).collect()}
    routes = Routes(model.places)
    assert len(got) == len(texts) and len(model.voters) > 20
    for i, text in texts[:60]:
        counts = {model.places[t]: n for t, n in term_counts(text).items() if t in model.places}
        raw = {p: 1 + math.log(n) for p, n in counts.items()}
        at, x = routes.weighted(text)
        norm = math.sqrt(sum(v * v for v in raw.values()))
        assert dict(zip(at.tolist(), x.tolist(), strict=True)) == pytest.approx({p: v / norm for p, v in raw.items()})
        point = [sum(v * model.axes[p, d] for p, v in raw.items()) for d in range(model.axes.shape[1])]
        length = math.sqrt(sum(v * v for v in point)) or 1.0
        cosines = sorted(((sum(a * b for a, b in zip(point, row, strict=True)) / length, k) for k, row in enumerate(model.voters.tolist())), reverse=True)
        near = [(c, k) for c, k in cosines if c >= cosines[model.neighbours - 1][0] - 1e-12 and c > 0]
        votes = [(c * c * model.weights[k], model.labels[k]) for c, k in near]
        assert got[i] == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=1e-9)


def test_axes_are_the_leading_singular_vectors(spark):
    model = learn_neighbours(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"), rank=8)
    assert np.allclose(model.axes.T @ model.axes, np.eye(8), atol=1e-9)
    assert np.allclose((model.voters**2).sum(axis=1), 1.0)


def test_quality_held_out(spark):
    """Learned from four fifths, right on the last one."""
    sf = "/root/testdata/sf0.01"
    truth = dict(connect(sf).execute("SELECT doc_id, max(quality) FROM labels WHERE quality IS NOT NULL GROUP BY 1").fetchall())
    rows = [(truth[r.doc_id], r.predicted) for r in catalog.queries()["op11_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert len(rows) > 50 and sum(a == b for a, b in rows) / len(rows) >= 0.95


def test_quality_on_awkward_tables(spark):
    labels = quality_labels(spark, [(0, 1, 0), (0, 0, None), (4, 0, 1), (9, 1, 0), (None, 1, 1), (5, None, None), (3, 0, 1), (77, 0, 1)])
    model = learn_neighbours(docs(spark), labels)
    got = score_quality(docs(spark), model).collect()
    assert len(got) == len(doc_rows()) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2, 6)} == {model.prior}
    none = learn_neighbours(docs(spark, []), quality_labels(spark, []))
    assert {r.score for r in score_quality(docs(spark), none).collect()} == {0.5} and score_quality(docs(spark, []), model).count() == 0


def test_copies_of_a_document_are_one_voter(spark):
    rows = [(k, "copied text in many places") for k in range(200)] + [(1000 + k, f"plain word{k} text of many other kinds") for k in range(60)]
    model = learn_neighbours(plain_docs(spark, rows), quality_labels(spark, [(i, int(i >= 1000), 0) for i, _ in rows]))
    assert (model.labels == 0).sum() == 1


def test_terms_of_long_texts_do_not_depend_on_chunks(spark, monkeypatch):
    from streetloom.llm import neighbours
    text = long_text(3000)
    whole = term_counts(text)
    monkeypatch.setattr(neighbours, "CHUNK", 50)
    assert term_counts(text) == whole


# ---- collocations --------------------------------------------------------------------------------------------------

def plain_collocations(rows, least=10, top=2000, words=3):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything in memory."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            found = re.findall(r"[^ \t]+", piece)
            n[lang] += len(found)
            for k in range(1, words + 1):
                for i in range(len(found) - k + 1):
                    f.setdefault(lang, Counter())[tuple(found[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            s, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_collocations_against_plain_counting(spark):
    rng = random.Random(8)
    words = ["New", "york", "city", "of", "the", "É", "x y", "a", "zz", "\x1c"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ",", "\r", "\n", " "]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [("of the city. of the city. of the city", "hot")] * 40 + [(None, "en"), ("", "en"), ("alone", "one"), (" ".join(["New York"] * 400), "en")]
    df = spark.createDataFrame([(k, t, x, 1, "p", "q") for k, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, phrase int, prefix string, size string")
    assert sorted(map(tuple, collocations(df).collect())) == plain_collocations(rows)
    assert sorted(map(tuple, collocations(df, top=3).collect())) == plain_collocations(rows, top=3)
    assert sorted(map(tuple, collocations(df.repartition(3), words=2).collect())) == [r for r in plain_collocations(rows, words=2)]


def test_collocations_on_awkward_tables(spark):
    assert collocations(docs(spark, [])).count() == 0
    assert sorted(map(tuple, collocations(docs(spark)).collect())) == plain_collocations([(r[1], r[2]) for r in doc_rows()])
    with pytest.raises(ValueError):
        collocations(docs(spark), words=1)


def test_stripes_do_not_depend_on_chunks(monkeypatch):
    """Texts cut anywhere, counts given away and words forgotten at any time: the same sums."""
    from streetloom.llm import phrases
    texts = [long_text(300).encode(), b"", b"one", b"a b a b. a b"]

    def sums(size):
        held, out = Stripes(size, [b"\xff" * (1 << phrases.MAP_BITS - 3)] * size, frozenset([("x", b"alpha"), ("x", b"b"), ("x", b"a b")])), Counter()
        for batch in [x for t in texts for x in held.add("x", t)] + list(held.give()):
            for r in batch.to_pylist():
                split = size == 0 or r["prefix"] in (b"alpha", b"b", b"a b")
                assert {zlib.crc32(w) % phrases.SHARDS if split else 0 for w in r["nexts"]} == {r["shard"]} or r["size"] < 0
                for w, n in zip(r["nexts"], r["counts"], strict=True):
                    out[r["size"], r["prefix"], w] += n
        return out

    for size in (0, 1, 2):
        for name, small in (("CHUNK", 1 << 20), ("CHUNK", 20), ("HELD", 3), ("ID_BITS", 6)):
            with monkeypatch.context() as m:
                whole = sums(size)
                m.setattr(phrases, name, small)
                assert sums(size) == whole and whole


def test_single_words_leave_a_task_once(monkeypatch):
    from streetloom.llm import phrases
    monkeypatch.setattr(phrases, "HELD", 3)
    held, texts = Stripes(0, []), [("x", b"a b, a"), ("y", b"a"), ("x", b"b b c"), ("x", b""), ("y", b"d a")]
    rows = [r for x in texts for b in held.add(*x) for r in b.to_pylist()] + [r for b in held.give() for r in b.to_pylist()]
    assert sorted((r["lang"], w, n) for r in rows if r["size"] == 0 for w, n in zip(r["nexts"], r["counts"], strict=True)) == [
        ("x", b"a", 2), ("x", b"b", 3), ("x", b"c", 1), ("y", b"a", 2), ("y", b"d", 1)]
    assert sorted((r["lang"], r["counts"]) for r in rows if r["size"] < 0) == [("x", [6]), ("y", [3])]


def test_phrases_lie_in_one_text_while_texts_wait_together(monkeypatch):
    from streetloom.llm import phrases
    every = [b"\xff" * (1 << phrases.MAP_BITS - 3)] * 2
    for waiting in (1, 4, 1 << 16):
        monkeypatch.setattr(phrases, "WAITING", waiting)
        for size, want in ((1, {("x", b"a", b"b"): 2, ("x", b"b", b"c"): 1, ("y", b"c", b"a"): 1}), (2, {("x", b"a b", b"c"): 1})):
            held, out = Stripes(size, every[:size]), {}
            for b in [b for x in (("x", b"a b c"), ("x", b"c"), ("y", b"c a"), ("x", b"a b"), ("x", b"d. e")) for b in held.add(*x)] + list(held.give()):
                for r in b.to_pylist():
                    for w, n in zip(r["nexts"], r["counts"], strict=True):
                        out[r["lang"], r["prefix"], w] = out.get((r["lang"], r["prefix"], w), 0) + n
            assert out == want


def test_single_words_have_the_bit_of_arrays_of_one():
    from streetloom.llm.phrases import place, places
    codes = np.random.default_rng(3).integers(0, 1 << 32, 500, dtype=np.uint64)
    assert [place(c) for c in codes.tolist()] == places([codes]).tolist()


def test_scores_past_64_bits_are_exact(spark):
    rows = [(10**12 + 7, 10**13 + 1, 3 * 10**12 + 11), (99_999_999_999_999, 99_999_999_999_999, 99_999_999_999_999), (10, 10, 11)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrase_score("a", "l", "r").alias("s")).collect()
    assert all(r.s == 1000000 * r.a * r.a // (r.l * r.r) for r in got)


# ---- clusters --------------------------------------------------------------------------------------------------------

def plain_clusters(rows, k=16, rounds=3, width=64):
    """(vec_id, cluster, distance, centroid) with Python integers."""
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in good)
    centroids = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in good:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j], strict=True)] if j in members else c for j, c in enumerate(centroids)]
    return sorted((i, nearest(v)[1], nearest(v)[0], hashlib.sha256(",".join(map(str, centroids[nearest(v)[1]])).encode()).hexdigest()) for i, v in good)


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", 1, 2) for i, v in rows], VECTORS)


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_clusters_against_plain_integers(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 64))
    rows = [(k, (centres[k % 9] + spread * rng.normal(size=64)).astype(np.float32).tolist()) for k in range(400)]
    rows += [(400 + k, rows[7][1]) for k in range(150)] + [(900, [0.0] * 64), (901, [-0.0] * 64), (902, [1.0] * 63), (903, None), (904, [float("nan")] * 64), (905, [None] + [1.0] * 63), (906, [])]
    got = cluster_vectors(vector_table(spark, rows).repartition(4)).collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == plain_clusters(rows)
    total = sum(r.distance for r in got)
    assert all(r.inertia == total for r in got)
    assert all(r.cluster_inertia == sum(x.distance for x in got if x.cluster == r.cluster) for r in got)


def test_clusters_on_awkward_tables(spark):
    few = [(3, [0.5] * 64), (3, [0.5] * 64), (5, [1e30] * 64), (6, [-1e30] * 64)]
    got = cluster_vectors(vector_table(spark, few)).collect()
    assert sorted(r.vec_id for r in got) == [3, 3, 5, 6] and all(r.distance == 0 for r in got) and len({r.cluster for r in got if r.vec_id == 3}) == 1
    assert [tuple(r)[:5] for r in cluster_vectors(vector_table(spark, few[:1])).collect()] == [(3, 0, 0, 0, 0)]
    assert cluster_vectors(vector_table(spark, [])).count() == 0 and cluster_vectors(vector_table(spark, [(1, None), (2, [1.0])])).count() == 0
    none = cluster_vectors(vector_table(spark, [(None, [0.25] * 64), *few[:1]])).collect()
    assert sorted((str(r.vec_id), r.distance) for r in none) == [("3", 0), ("None", 0)]


def test_bounded_search_meets_every_nearest_centroid():
    """Bounds from any earlier centroids, ties among equal centroids included."""
    rng = np.random.default_rng(5)
    for trial in range(40):
        k, n = int(rng.integers(2, 12)), 200
        old, new = (rng.integers(-3, 4, size=(k, 3)) for _ in range(2))
        if trial % 2:
            new = old + rng.integers(-1, 2, size=(k, 3)) * (rng.random((k, 1)) < 0.3)
        rows = rng.integers(-4, 5, size=(n, 3))

        def full(at):
            d = ((rows[:, None, :] - at[None]) ** 2).sum(axis=2)
            order = np.lexsort((np.broadcast_to(np.arange(k), d.shape), d), axis=1)
            return order[:, 0], order[:, 1], d
        a, b, d = full(old)
        near, second, d1, d2 = search(rows, (start := rng.integers(0, k, n)), (start + 1) % k, Centroids(old))
        assert (near == a).all() and (second == b).all() and (d1 == d[np.arange(n), a]).all() and (d2 == d[np.arange(n), b]).all()
        moved = np.sqrt(squared(new, old).astype(float))
        got = reassign(rows, a, b, np.sqrt(d1.astype(float)), np.sqrt(d2.astype(float)), Centroids(new), moved)
        a2, _, e = full(new)
        rest = np.where(np.arange(k)[None] == a2[:, None], np.iinfo(np.int64).max, e)
        assert (got[0] == a2).all()
        assert (got[2] ** 2 >= e[np.arange(n), a2] - 1e-6).all() and (got[3] ** 2 <= rest.min(axis=1) + 1e-6).all()
