"""Every operator and stage on awkward tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import random

import public_tokenizers
import pytest

import corpus_pipeline
from streetloom.llm.embeddings import embedding_links
from streetloom.llm.language import learn_languages, predict_languages
from streetloom.llm.lines import drop_repeated_lines
from streetloom.llm.mixing import mix, mix_plan
from streetloom.llm.pieces import decode_pieces, encode_pieces
from streetloom.llm.quality import judge_quality, learn_lines
from streetloom.llm.simhash import drop_near_duplicates, simhash_groups
from streetloom.llm.token_files import read_token_files, token_index, write_token_files
from streetloom.llm.toxicity import drop_toxic, learn_toxicity, score_toxicity
from streetloom.llm.urls import filter_urls
from tests.llm.fixtures import DOCS, PAGES, VECTORS, doc_rows, docs, plain_docs

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def labels(spark, rows=((0, 1, 0), (0, 1, None), (4, 0, 1), (9, 1, 0), (None, 1, 1), (5, None, None), (77, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_embeddings(spark):
    near = [1.0, 0.01, 0.0]
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, near), (3, near), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, [1.0, float("nan"), 0.0]),
            (9, [1.0, float("inf"), 0.0]), (None, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (11, [-1.0, 0.0, 0.0]), (12, [1.0, 0.0, 0.0]), (13, [1e-30, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "c", 1, 2) for i, v in rows], VECTORS)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_links(df).collect()), key=str)
    linked = [(i, 5, 1, i == 1) for i in (1, 2, 3, 3, 12, 13)]
    assert got == sorted([*linked, *((i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)), (None, 0, None, False)], key=str)
    assert embedding_links(df.limit(0)).count() == 0
    assert [tuple(r) for r in embedding_links(df.where("vec_id = 4")).collect()] == [(4, 0, 4, True)]
    with pytest.raises(ValueError):
        embedding_links(df, threshold=0.0)


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.ORG"), (5, "x://Sub.Example.ORG/es/1?q=/en/"), (6, "http://example.org/en/12#f"), (6, "http://example.org/en/12#f"), (None, "http://b.com/de/x/y/z/w/v"),
            (7, "http://badexample.org/es/"), (8, "http://c.net/" + "a/" * 5000), (9, "http://É.com/fr/"), (10, "a://b://c.com/de/"), (11, "http://h.com?x://y")]
    df = spark.createDataFrame([(i, u, None, 1, 2, 3, 4, "n") for i, u in rows], PAGES)
    got = {(r.page_id, r.host): (r.path[:12], r.rule, r.verdict) for r in filter_urls(df).collect()}
    assert filter_urls(df).count() == len(rows) and filter_urls(df.limit(0)).count() == 0
    assert got[1, ""] == got[2, ""] == got[3, ""] == ("", None, "allow") and got[4, "a.org"] == ("", None, "allow")
    assert got[5, "sub.example.org"] == ("/es/1", "example.org/es/", "block") and got[6, "example.org"] == ("/en/12", "example.org/en/1", "block")
    assert got[None, "b.com"][1:] == ("com/de/", "block") and got[7, "badexample.org"][1:] == ("org/", "allow")
    assert got[9, "É.com"][1:] == ("com/fr/", "allow") and got[10, "b:"][1:] == (None, "allow") and got[11, "h.com"][0] == ""


def test_templates_are_rejected_by_the_labels_of_their_branch(spark):
    rows = [(k, f"http://a.com/de/{k}") for k in range(200)] + [(1000 + k, f"http://a.com/xx/{k}") for k in range(20)] + [(2000 + k, f"http://b.com/fr/{k}") for k in range(200)] + [
        (3000 + k, f"http://b.com/xx/{k}") for k in range(20)]
    df = spark.createDataFrame([(i, u, None, 1, 2, 3, 4, "n") for i, u in rows], PAGES)
    verdicts = {(r.host, r.template): r.verdict for r in filter_urls(df).collect()}
    assert verdicts == {("a.com", "/{de|xx}/{number}"): "block", ("b.com", "/{fr|xx}/{number}"): "allow"}


def test_a_branch_built_like_a_blocked_one_is_blocked(spark):
    """Same shapes below: judged alike, with or without labels. Other shapes: not."""
    rows = [(k, f"http://a.com/de/item/{k}.html") for k in range(200)] + [(300 + k, f"http://a.com/xx/item/{k}.html") for k in range(60)] + [(500 + k, f"http://a.com/about/{'abcdefgh'[k % 8]}{k}") for k in range(60)]
    rows += [(1000 + k, f"http://b.com/de/{k}") for k in range(100)] + [(1200 + k, f"http://b.com/fr/{k}") for k in range(100)] + [(1400 + k, f"http://b.com/xx/{k}") for k in range(50)]
    df = spark.createDataFrame([(i, u, None, 1, 2, 3, 4, "n") for i, u in rows], PAGES)
    got = {}
    for r in filter_urls(df).collect():
        got.setdefault((r.host, r.path.split("/")[1]), set()).add((r.verdict, r.template))
    assert got["a.com", "de"] == got["a.com", "xx"] == {("block", "/{de|xx}/item/{number.ext}")}
    assert {v for v, _ in got["a.com", "about"]} == {"allow"}
    assert {v for v, _ in got["b.com", "de"]} == {"block"} and {v for v, _ in got["b.com", "fr"]} == {"allow"} and {v for v, _ in got["b.com", "xx"]} == {"allow"}


def test_templates_are_as_deep_as_paths(spark):
    rows = [(k, f"http://c.net/a/b/c/d/e/f/g/h/i/{'x' if k % 2 else 'y'}/{k}") for k in range(40)] + [(100, "http://c.net/" + "q/" * 3000)]
    df = spark.createDataFrame([(i, u, None, 1, 2, 3, 4, "n") for i, u in rows], PAGES)
    assert {r.template for r in filter_urls(df).collect()} == {"/a/b/c/d/e/f/g/h/i/{x|y}/{number}", "/{any}/{...}"}


def test_simhash(spark):
    got = simhash_groups(docs(spark)).collect()
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    assert len(got) == len(doc_rows()) and by[1, 0] == by[2, 0] == by[6, 0] == 1
    same = [r.fp for r in got if r.doc_id == 0]
    assert by[0, same[0]] == by[3, same[0]] == 0
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash_groups(docs(spark, [])).count() == 0
    kept = drop_near_duplicates(docs(spark))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs(spark).columns and ids.count(0) == 1 and ids.count(1) == 1 and 2 not in ids and ids.count(3) == 0 + (len({r.component_id for r in got if r.doc_id == 3}) > 1) and None in ids
    assert drop_near_duplicates(docs(spark, [])).count() == 0


def test_simhash_on_one_large_group(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([*words[: k % 7], *words, f"x{k}"])) for k in range(600)] + [(1000 + k, " ".join(words)) for k in range(600)]
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash_groups(plain_docs(spark, rows)).collect()}
    root = {i: i for i in got}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    prints = {}
    for i, (fp, _) in sorted(got.items()):
        prints.setdefault(fp & (1 << 64) - 1, i)
        root[i] = prints[fp & (1 << 64) - 1]
    items = list(prints.items())
    for a, (fa, ia) in enumerate(items):
        for fb, ib in items[:a]:
            if bin(fa ^ fb).count("1") <= 2:
                x, y = find(ia), find(ib)
                root[max(x, y)] = min(x, y)
    assert all(c == find(i) for i, (_, c) in got.items())


def test_toxicity(spark):
    model = learn_toxicity(docs(spark), labels(spark))
    got = score_toxicity(docs(spark), model).collect()
    assert len(got) == len(doc_rows()) and all(0 <= r.score <= 1 for r in got) and {r.doc_id for r in got} == {r[0] for r in doc_rows()}
    none = learn_toxicity(docs(spark, []), labels(spark, []))
    assert all(r.score < 0.7 and not r.passages for r in score_toxicity(docs(spark), none).collect())
    assert score_toxicity(docs(spark, []), none).count() == 0
    assert drop_toxic(docs(spark), labels(spark)).columns == docs(spark).columns


def test_toxic_passages_are_found_where_they_stand(spark):
    rng = random.Random(5)
    calm = lambda n: " ".join(f"word{rng.choice('abcdefghijklmnop')}{rng.choice('abcdefghijklmnop')}" for _ in range(n))
    rows = [(k, f"{calm(9)} {'you nasty vile creep' if k % 5 == 0 else calm(4)} {calm(20)}") for k in range(300)]
    model = learn_toxicity(plain_docs(spark, rows), labels(spark, [(k, 1, int(k % 5 == 0)) for k in range(300)]))
    got = {r.doc_id: r for r in score_toxicity(plain_docs(spark, rows), model).collect()}
    assert all((got[k].score >= 0.7) == (k % 5 == 0) for k in range(300))
    assert [(p.first, p.end) for p in got[0].passages] == [(9, 13)] and not got[1].passages


def test_copies_do_not_make_words_toxic(spark):
    """A toxic text in many copies and near copies counts once, so its harmless words stay harmless."""
    rng = random.Random(6)
    calm = lambda n: " ".join(f"word{rng.choice('abcdefghijklmnop')}{rng.choice('abcdefghijklmnop')}" for _ in range(n))
    copied = "rare harmless words that one copied toxic text has and no other one does anywhere at all in these tables"
    rows = [(k, f"{calm(9)} {'vile creep' if k % 5 == 0 else calm(2)} {calm(20)}") for k in range(300)] + [(1000 + k, f"{copied} vile creep {copied}") for k in range(60)]
    model = learn_toxicity(plain_docs(spark, rows), labels(spark, [(k, 1, int(k % 5 == 0)) for k in range(300)] + [(1000 + k, 1, 1) for k in range(60)]))
    assert set(model.units) & {"vile", "creep"} == {"vile", "creep"} and not set(model.units) & set(copied.split())


def test_mixing(spark):
    got = mix_plan(docs(spark)).collect()
    assert len(got) == len(doc_rows()) and all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in got)
    total = sum(r.size for r in got)
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total) and all(t <= 2 * s + 1e-9 for t, s in targets.values())
    again = mix_plan(docs(spark).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix_plan(docs(spark, [])).count() == 0 and mix(docs(spark, [])).count() == 0
    mixed = mix(docs(spark))
    assert mixed.columns == docs(spark).columns
    assert sum(len((r.text or "").encode().split()) for r in mixed.collect()) == sum(r.taken for r in got)
    empty = mix_plan(plain_docs(spark, [(1, None, "en", "a"), (2, " ", "en", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2


def test_mix_keeps_documents_without_words(spark):
    rows = [(k if k % 3 else None, ["one two", "", None][k % 3 if k % 2 else 0], "en", "ab"[k % 2]) for k in range(60)]
    got = [r.text for r in mix(plain_docs(spark, rows)).collect()]
    plan = mix_plan(plain_docs(spark, rows)).collect()
    for words in (0, 2):
        assert sum(len((t or "").split()) == words for t in got) == sum(r.copies for r in plan if r.size == words) > 0


def test_words_taken_come_near_the_targets(spark):
    rows = [(k, "w " * (1 + k * 7919 % 400), "en", "abc"[min(2, k % 5)]) for k in range(2000)]
    got = mix_plan(plain_docs(spark, rows)).collect()
    for source in "abc":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2 * 400


def test_quality(spark):
    got = {(r.doc_id, r.n_words): r for r in judge_quality(docs(spark), learn_lines(docs(spark), labels(spark))).collect()}
    assert judge_quality(docs(spark), learn_lines(docs(spark, []), labels(spark, []))).count() == len(doc_rows())
    assert got[1, 0].base_failed and not got[1, 0].kept and got[2, 0].line_labels == "-" and got[6, 0].n_dup_lines == 0
    assert got[0, 25].n_dup_lines == 1 and judge_quality(docs(spark, []), learn_lines(docs(spark, []), labels(spark, []))).count() == 0


def naive_lines(rows):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    ident = lambda i: 2**63 - 1 if i is None else i
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(ident(i))
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (len(held.get(key(x), ())) >= 2 and ident(i) > min(held[key(x)]))]
        out.append((i, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines(spark):
    from pyspark.sql import functions as F
    got = drop_repeated_lines(docs(spark)).select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got), key=str) == naive_lines([r[:2] for r in doc_rows()])
    assert drop_repeated_lines(docs(spark, [])).count() == 0
    three = drop_repeated_lines(plain_docs(spark, [(k, f"a line that all have\nline of two {k // 2}") for k in range(4)]), min_docs=3).collect()
    assert sorted(r.kept_text for r in three) == ["a line that all have\nline of two 0", "line of two 0", "line of two 1", "line of two 1"]


def test_language(spark):
    model = learn_languages(docs(spark))
    got = predict_languages(docs(spark), model).collect()
    by = {(r.doc_id, r.lang_pred == "und") for r in got}
    assert len(got) == len(doc_rows()) and {(1, True), (2, True), (6, True), (7, True), (4, False)} <= by and all(0 <= r.score <= 1 for r in got)
    none = learn_languages(docs(spark, []))
    assert {r.lang_pred for r in predict_languages(docs(spark), none).collect()} == {"und"} and predict_languages(docs(spark, []), model).count() == 0


def test_switches_of_language_are_seen(spark):
    one, two = "der die und nicht eine haus schön wasser", "the and with from house water would there"
    rows = [(k, " ".join(((one, two)[k % 2].split() * 30)[k % 8 :]), ("de", "en")[k % 2]) for k in range(120)]
    model = learn_languages(plain_docs(spark, rows))
    mixed = predict_languages(plain_docs(spark, [(1, f"{one} {one} {one} {two} {two}")]), model).first()
    assert mixed.lang_pred == "de" and mixed.words["de"] == pytest.approx(24, abs=2) and mixed.words["en"] == pytest.approx(16, abs=2)


def test_pieces(spark):
    got = {r.doc_id: r for r in encode_pieces(docs(spark), PIECES).collect()}
    assert len(got) == len({r[0] for r in doc_rows()}) and all(r.round_trip for r in got.values())
    assert bytes(got[1].ids) == bytes(got[2].ids) == b"" and [x.score for x in got[1].nbest] == [0.0]
    back = {r.doc_id: r.text for r in decode_pieces(encode_pieces(docs(spark), PIECES), PIECES).collect()}
    want = {r[0]: (r[1] or "").replace("▁", " ") for r in doc_rows()}
    assert all(back[i] == want[i] for i in (0, 1, 2, 4, 5, 6, 7, 8, 9)) and encode_pieces(docs(spark, []), PIECES).count() == 0


def test_token_files(spark, tmp_path):
    got = token_index(docs(spark), BPE, file_ids=1000).orderBy("start").collect()
    assert [r.doc_id for r in got] == [0, 1, 2, 3, 3, 3, 4, 5, 6, 7, 8, 9, None]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))] and got[1].n_tokens == got[2].n_tokens == 1
    files = write_token_files(docs(spark), str(tmp_path / "ids"), BPE, file_ids=50)
    assert sorted(p.name for p in (tmp_path / "ids").iterdir() if not p.name.startswith(".")) == sorted(r.file for r in files.collect())
    assert read_token_files(spark, str(tmp_path / "ids")).count() == len(doc_rows()) and token_index(docs(spark, []), BPE).count() == 0


def test_pipeline_stages(spark, tmp_path):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "source_mix", "sentencepiece"]
    for rows in (doc_rows(), []):
        now = spark.createDataFrame(rows, DOCS)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{len(rows)}")
            stage(spark, now, str(tmp_path)).write.parquet(path)
            now = spark.read.parquet(path)
            assert now.columns == plain or k == len(corpus_pipeline.STAGES) - 1
        assert (now.count() > 0) == bool(rows)


def test_every_class_of_near_duplicates_keeps_one_of_its_own_rows(spark):
    """Ids that several texts share do not stand for a class."""
    x, y, z = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyz")
    rows = [(5, x), (5, y), (5, z), (3, z), (None, y), (None, "no other has these words"), (None, "no other has these words")]
    got = sorted(((r.doc_id, r.text) for r in drop_near_duplicates(plain_docs(spark, rows)).collect()), key=str)
    assert got == sorted([(5, x), (5, y), (3, z), (None, "no other has these words")], key=str)


def test_texts_with_one_hash_keep_their_own_lines(spark):
    """Two texts without id whose 32-bit hashes agree; one has a line that another document had first."""
    from pyspark.sql import functions as F
    line = "a line that two documents have"
    one = spark.range(150_000).select(F.concat(F.lit(f"{line}\nmore "), F.col("id").cast("string")).alias("a")).withColumn("h", F.hash("a"))
    two = spark.range(150_000).select(F.concat(F.lit("wholly other text "), F.col("id").cast("string")).alias("b")).withColumn("h", F.hash("b"))
    pair = one.join(two, "h").orderBy("a", "b").first()
    got = drop_repeated_lines(plain_docs(spark, [(1, line), (None, pair.a), (None, pair.b)])).collect()
    assert sorted(r.kept_text for r in got) == sorted([line, pair.a.split("\n")[1], pair.b])


def test_numbers_that_look_like_letters_are_none(spark):
    model = learn_languages(docs(spark))
    rows = [(1, "½ ½ ②"), (2, "Ⅷ ² ①"), (3, "½and½ ²the"), (4, "x²")]
    got = {r.doc_id: r.lang_pred for r in predict_languages(plain_docs(spark, rows), model).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und" and got[4] != "und"


def test_an_id_with_many_rows_is_one_of_the_sample(spark):
    rows = [(1, f"bad word{k} vile") for k in range(300)] + [(k, f"good text number {k}") for k in range(2, 40)]
    known = [(1, 0, 1), *((k, 1, 0) for k in range(2, 40))]
    model = learn_lines(plain_docs(spark, rows), labels(spark, known))
    assert judge_quality(plain_docs(spark, rows), model).count() == len(rows)
    assert score_toxicity(plain_docs(spark, rows), learn_toxicity(plain_docs(spark, rows), labels(spark, known))).count() == len(rows)


@pytest.mark.parametrize("held", [1 << 10, 1 << 14, 80 << 20])
def test_kept_stretches_do_not_change_segmentations(monkeypatch, held):
    from streetloom.llm import pieces
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]
    whole = [pieces.Encoder(PIECES).encode_both([t])[0] for t in texts[:4]]
    monkeypatch.setattr(pieces, "HELD", held)
    monkeypatch.setattr(pieces, "RUN", 60)
    e = pieces.Encoder(PIECES)
    got = [x for k in range(0, 30, 3) for x in e.encode_both(texts[k : k + 3])]
    assert got[:4] == whole and (held > 1 << 20 or len(e.known) < 260)
