"""The operators as queries over the given tables, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.llm.clusters import cluster_vectors
from streetloom.llm.common import id_crc, table
from streetloom.llm.embeddings import embedding_links
from streetloom.llm.language import learn_languages, predict_languages
from streetloom.llm.lines import drop_repeated_lines
from streetloom.llm.mixing import mix_plan
from streetloom.llm.neighbours import THRESHOLD as GOOD
from streetloom.llm.neighbours import learn_neighbours, score_quality
from streetloom.llm.phrases import collocations
from streetloom.llm.pieces import encode_pieces
from streetloom.llm.quality import judge_quality, learn_lines
from streetloom.llm.simhash import simhash_groups
from streetloom.llm.token_files import token_index
from streetloom.llm.toxicity import THRESHOLD as TOXIC
from streetloom.llm.toxicity import learn_toxicity, score_toxicity
from streetloom.llm.urls import filter_urls
from streetloom.llm.urls import oracle as url_oracle
from streetloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", F.coalesce(id_crc(F.col("doc_id")) % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, learn_lines(docs, table(spark, sf_dir, "labels"))).drop("content_share", "line_labels")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, learn_languages(docs)).select(
        "doc_id", F.coalesce(id_crc(F.col("doc_id")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return best.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.transform("nbest", lambda x: x["score"]).alias("scores"),
        F.col("nbest")[F.size("nbest") - 1]["changes"].alias("last_changes"), "round_trip")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, learn_neighbours(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", F.coalesce(id_crc(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_embedding_near_dedup, op2_url_filter, op3_simhash_near_dedup, op4_toxicity, op5_source_mixing, op6_quality_rules, op7_line_dedup, op8_language_id, op9_sentencepiece, op10_token_files,
    op11_quality_classifier, op12_collocations, op13_centroid_clusters)}

def cluster_oracle(rounds: int = 3) -> str:
    """The rounds of k-means one after the other; a vector's nearest centroid is the least of 16 * distance + number."""
    assign = """a{r} AS (SELECT vec_id, any_value(v.v) AS v, min((list_dot_product(v.v, v.v) - 2 * list_dot_product(v.v, c.v) + list_dot_product(c.v, c.v))::BIGINT * 16 + c.c) AS m
  FROM v CROSS JOIN c{r} c GROUP BY vec_id)"""
    update = """s{r} AS (SELECT m % 16 AS c, i, sum(v[i]::BIGINT)::BIGINT AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, 65) t(i) GROUP BY ALL),
c{n} AS (SELECT c.c, coalesce(x.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS v FROM s{r} GROUP BY c) x ON x.c = c.c)"""
    steps = [f"{assign},\n{update}".format(r=r, n=r + 1) for r in range(rounds)] + [assign.format(r=rounds)]
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM v QUALIFY c < 16),
{",\n".join(steps)},
e AS (SELECT vec_id, (m % 16)::INTEGER AS cluster, (m // 16)::BIGINT AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM e JOIN c{rounds} c ON c.c = e.cluster"""


ORACLES = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = v.vec_id""",
    "op2_url_filter": url_oracle(),
    "op5_source_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((src - 1) % 3 + 1)::INTEGER] AS weight, (2 * source_size)::DOUBLE AS stop FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM w) * 1.5::DOUBLE - coalesce(sum(stop) OVER (ORDER BY stop / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY stop / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT src, source, source_size, least(stop, weight * (SELECT max(level) FROM l WHERE level * weight <= stop)) AS target,
  ('0x' || md5('7:' || src)[1:8])::BIGINT / 4294967296.0::DOUBLE AS shift FROM l),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS r,
  row_number() OVER (PARTITION BY t.src ORDER BY d.size, ('0x' || md5(coalesce(d.doc_id::VARCHAR, ''))[1:4])::BIGINT % 256, d.doc_id NULLS LAST) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor(r * k + shift) - floor(r * (k - 1) + shift), ceil(r)) * size)::BIGINT AS taken FROM k""",
    "op7_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.line, k.pos, c.first_id IS NOT NULL AND c.first_id < k.doc_id AS dropped FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p CROSS JOIN range(1, 4) t(k)),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
a AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE k > 1 AND f >= 10),
c AS (SELECT *, array_to_string(s[1 : j], ' ') AS lp, array_to_string(s[j + 1 :], ' ') AS rp FROM a CROSS JOIN range(1, 3) t(j) WHERE j < k),
x AS (SELECT c.lang, c.k, c.phrase, c.a, l.f AS l, r.f AS r, (c.a::HUGEINT * c.a * 1000000) // (l.f::HUGEINT * r.f) AS score FROM c
  JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1),
o AS (SELECT DISTINCT lang, array_to_string(s[i : i + 1], ' ') AS phrase, a FROM a CROSS JOIN range(1, 3) t(i) WHERE k = 3),
m AS (SELECT lang, phrase, max(a) AS over FROM o GROUP BY ALL),
b AS (SELECT x.* FROM x LEFT JOIN m ON m.lang = x.lang AND m.phrase = x.phrase AND x.k = 2 WHERE m.over IS NULL OR 100 * m.over < 50 * x.a)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score::BIGINT AS score
FROM b JOIN n ON n.lang = b.lang QUALIFY rank <= 2000""",
    "op13_centroid_clusters": cluster_oracle(),
}


def queries() -> dict[str, Query]:
    def shipped(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)
        return run
    return {name: shipped(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
