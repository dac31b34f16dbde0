"""Small awkward tables: nulls everywhere, empty and long texts, ties, repeated rows, extra columns with the operators' own names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, component_id string, ident int, row string, h int, copies int, score string, ids string"
PAGES = "page_id long, url string, html string, host int, path int, n int, rule int, node0 string"
VECTORS = "vec_id long, embedding array<float>, label int, cid string, v int, links int"


def long_text(words: int = 60_000) -> str:
    rng = random.Random(3)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + rng.choice(["", ".", ",\n"]) for _ in range(words))


def doc_rows() -> list[tuple]:
    base = "The quick brown fox jumps over the lazy dog.\nA second line of this text.\nshort\nThe quick brown fox jumps over the lazy dog."
    texts = [
        (0, base, "en", "a"), (1, None, None, None), (2, "", "de", "b"), (None, "no id here but words of its own\nA second line of this text.", "en", "a"), (3, base, "en", None),
        (3, base, "en", None), (3, "Another text with the same id as others.\nA second line of this text.", "en", "a"), (4, long_text(), "en", "c"), (5, "ÀÉ ß \x1c x\x85y\x0b z   ١٢ 中文字", None, "a"),
        (6, "   \n\t\n ", "fr", "b"), (7, "12 345 !!", "en", "b"), (8, "<|endoftext|> don't ▁ \U0001F600 'll", "en", "d"), (9, base.replace("quick", "quiet"), "en", "a")]
    return [(i, t, lang, s, None if t is None else len(t), 1, "x", "y", 2, "r", 3, 4, "s", "i") for i, t, lang, s in texts]


def docs(spark, rows=None):
    return spark.createDataFrame(doc_rows() if rows is None else rows, DOCS)


def plain_docs(spark, rows):
    """(doc_id, text[, lang[, source]]) rows as documents."""
    return spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], "doc_id long, text string, lang string, source string")
