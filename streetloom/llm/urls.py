"""URL filters: explicit rules first, then a tree of path templates per host. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from streetloom.llm.common import ascii_lower, stored

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SHAPES = ("{}", "{number}", "{number.ext}", "{any}")
#: What is below a node on a path: nothing, or one, two, or three and more segments, the last one of some shape.
REST = 3
KINDS = 1 + REST * len(SHAPES)
#: Levels that the SQL spells out; the tree itself has as many as its paths need.
ORACLE_LEVELS = 8
SUPPORT = 5
SHARE = 0.05
PRIOR = 10.0
SIMILAR = 1.96
IMPURE = 0.8

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits (ties: the first by code point), both null if none does."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    pick = lambda values: F.coalesce(*[F.when(c, F.lit(v)) for c, v in zip(fits, values, strict=True)])
    return pick([h + p for h, p, _ in ordered]), pick([v for _, _, v in ordered])


def shape(segment: Column) -> Column:
    return F.when(segment == "", "{}").when(segment.rlike("^[0-9]+$"), "{number}").when(segment.rlike("^[0-9]+\\.[A-Za-z]+$"), "{number.ext}").otherwise("{any}")


def differ(p: Column, q: Column, n: Column, m: Column, similar: float) -> Column:
    """Whether shares p of n and q of m differ by a two-sample test."""
    both = (p * n + q * m) / (n + m)
    return (p != q) & ((p - q) * (p - q) >= F.lit(similar) * F.lit(similar) * (both * (1 - both)) * (1 / n + 1 / m))


def merged_siblings(nodes: DataFrame, whole: float, prior: float = PRIOR, similar: float = SIMILAR) -> DataFrame:
    """(host, at, label, piece, impure) of sibling nodes: ``piece`` names the merged branch, ``impure`` is its smoothed share of blocked urls. ``nodes``: host, at, label, n, m (labelled urls), b (blocked
    ones), above (the parent's share), and n0, n1 ..., how many have each of KINDS below them.

    Siblings stand in order of what comes below them, and one whose shares of ends and shapes do not differ from those of the one before by a two-sample test is of its
    like, labelled or not. Among those of one like, labelled ones are told apart by their blocked shares in the same way. Ones without labels join their like if that is one group; else they
    stay a branch with the share of all their like. So a branch that is built like a blocked one is judged as it. Branches unlike any labelled one have no evidence and take ``whole``."""
    share = [f"p{k}" for k in range(KINDS)]
    of = nodes.withColumns({p: F.col(f"n{k}") / F.col("n") for k, p in enumerate(share)})
    order = Window.partitionBy("host", "at").orderBy(*share, "label")
    before = {f"_{c}": F.lag(c).over(order) for c in ("n", *share)}
    new = reduce(lambda x, y: x | y, [differ(F.col(p), F.col(f"_{p}"), F.col("n"), F.col("_n"), similar) for p in share])
    of = of.withColumns(before).withColumn("apart", F.when(F.col("_n").isNull() | new, 1).otherwise(0)).withColumn("branch", F.sum("apart").over(order))
    like = Window.partitionBy("host", "at", "branch")
    rate = F.col("b") / F.greatest("m", F.lit(1.0))
    by_rate = like.orderBy(F.col("m") == 0, rate, "label")
    of = of.withColumn("rate", rate).withColumns({"_m": F.lag("m").over(by_rate), "_rate": F.lag("rate").over(by_rate)})
    fresh = F.when(F.col("m") == 0, 0).when(F.col("_m").isNull() | differ(F.col("rate"), F.col("_rate"), F.col("m"), F.col("_m"), similar), 1).otherwise(0)
    of = of.withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(by_rate)).withColumn("parts", F.sum("fresh").over(like))
    of = of.withColumn("part", F.when(F.col("m") > 0, F.col("part")).when(F.col("parts") == 1, 1).otherwise(0))
    branch = Window.partitionBy("host", "at", "branch", "part")
    own = F.col("part") > 0
    m, b = (F.when(own, F.sum(c).over(branch)).otherwise(F.sum(c).over(like)) for c in ("m", "b"))
    members = F.array_sort(F.collect_list("label").over(branch))
    piece = F.when(F.size("members") == 1, F.col("label")).otherwise(F.concat(F.lit("{"), F.array_join("members", "|"), F.lit("}")))
    return of.withColumn("members", members).select("host", "at", "label", piece.alias("piece"), F.when(m > 0, (b + prior * F.col("above")) / (m + prior)).otherwise(F.lit(whole)).alias("impure"))


def template_tree(paths: DataFrame, support: int = SUPPORT, share: float = SHARE, prior: float = PRIOR, similar: float = SIMILAR) -> DataFrame:
    """(host, path, at, impure) of ``paths`` (host, path, n, labelled, blocked): the template each path ends in and that template's share.

    The tree grows level by level. A segment stays as it is if at least ``support`` urls and ``share`` of those at its parent have it; any other is
    variable and becomes the wildcard of its shape, so a parent has at most 1 / share + 4 children. They are merged (``merged_siblings``) before the next level, which grows below the merged branches. The
    share of a branch is smoothed towards that above it with the weight of ``prior`` urls, a host's towards that of all urls, which a branch unlike any labelled one has as well. A node with fewer
    than ``support`` urls, or one path, is not split: what is left of its paths is ``{...}``. So there are as many levels as the longest path has before that."""
    whole = paths.agg((F.coalesce(F.sum("blocked"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).first()[0]
    hosts = paths.groupBy("host").agg(((F.sum("blocked") + F.lit(prior * whole)) / (F.sum("labelled") + prior)).alias("impure"))
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.slice(F.split("path", "/", -1), 2, F.size(F.split("path", "/", -1))))
    tree = stored(paths.join(hosts, "host").select("host", "path", "n", "labelled", "blocked", segments.alias("segments"), F.lit("").alias("at"), "impure", F.lit(True).alias("live")), "url-tree")
    closed = []
    for d in count(1):
        on = F.col("live") & (F.size("segments") >= d)
        closed.append(tree.where(~on))
        tree = tree.where(on)
        if tree.isEmpty():
            break
        nodes = tree.groupBy("host", "at").agg(F.sum("n").alias("total"), (F.count("*") > 1).alias("several"))
        split = stored(tree.join(nodes, ["host", "at"]).withColumn("segment", F.get("segments", F.lit(d - 1))).withColumn("splits", F.col("several") & (F.col("total") >= support)), "url-nodes")
        closed.append(split.where("not splits").withColumn("at", F.concat("at", F.lit("/{...}"))).select(tree.columns))
        split = split.where("splits")
        firm = split.groupBy("host", "at", "segment").agg(F.sum("n").alias("n"), F.first("total").alias("total")).where((F.col("n") >= support) & (F.col("n") >= F.col("total") * share)).select(
            "host", "at", "segment", F.lit(True).alias("firm"))
        rest = F.size("segments") - d
        below = F.when(rest <= 0, 0).otherwise((F.least(rest, F.lit(REST)) - 1) * len(SHAPES) + F.array_position(F.array(*map(F.lit, SHAPES)), shape(F.element_at("segments", -1))).cast("int"))
        split = stored(split.join(firm, ["host", "at", "segment"], "left").withColumns({"label": F.when(F.col("firm"), F.col("segment")).otherwise(shape(F.col("segment"))), "below": below}).drop("firm", "segment"), "url-labels")
        siblings = split.groupBy("host", "at", "label").agg(
            *[F.sum(c).cast("double").alias(k) for k, c in (("n", "n"), ("m", "labelled"), ("b", "blocked"))], F.first("impure").alias("above"),
            *[F.coalesce(F.sum(F.when(F.col("below") == k, F.col("n"))), F.lit(0)).cast("double").alias(f"n{k}") for k in range(KINDS)])
        merged = stored(merged_siblings(siblings, whole, prior, similar).withColumnRenamed("impure", "judged"), "url-level")
        tree = stored(split.join(merged, ["host", "at", "label"]).select("host", "path", "n", "labelled", "blocked", "segments", F.concat("at", F.lit("/"), "piece").alias("at"), F.col("judged").alias("impure"), "live"), "url-tree")
    return reduce(DataFrame.unionByName, closed).select("host", "path", "at", "impure")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", impure: float = IMPURE) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (null if none fits), verdict (allow or block), template.

    The rule's verdict holds where one fits, and those urls are the labels; the others are blocked if the share of their template, as
    ``template_tree`` has it, is ``impure`` or more. The tree is built over the different (host, path) with their counts, so copies cost nothing. Null urls and those without :// have
    empty host and path. Rows without id and repeated rows are judged like any other."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    paths = stored(urls.groupBy("host", "path").agg(F.count("*").alias("n")).withColumns({"rule": rule, "ruled": verdict}).withColumns({
        "labelled": F.when(F.col("ruled").isNotNull(), F.col("n")).otherwise(0), "blocked": F.when(F.col("ruled") == "block", F.col("n")).otherwise(0)}), "url-paths")
    judged = template_tree(paths.select("host", "path", "n", "labelled", "blocked")).withColumn("judged", F.when(F.col("impure") >= impure, "block").otherwise("allow"))
    verdicts = stored(paths.join(judged, ["host", "path"]).select("host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"), F.col("at").alias("template")), "url-verdicts")
    return urls.join(verdicts, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "template")


def oracle() -> str:
    """The same in DuckDB's SQL, for the rules and parameters above, down to ORACLE_LEVELS levels."""
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in ordered]
    case = lambda values: "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in zip(fits, values, strict=True)) + " END"
    sql = [f"""WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
p AS (SELECT host, path, count(*) AS n, {case([h + p for h, p, _ in ordered])} AS rule, {case([v for _, _, v in ordered])} AS ruled FROM u GROUP BY host, path),
c AS (SELECT *, CASE WHEN ruled IS NULL THEN 0 ELSE n END AS labelled, CASE WHEN ruled = 'block' THEN n ELSE 0 END AS blocked,
  CASE WHEN path = '' THEN []::VARCHAR[] ELSE string_split(path, '/')[2:] END AS segments FROM p),
l AS (SELECT host, (sum(blocked) + {PRIOR}::DOUBLE * (SELECT (sum(blocked) + 1)::DOUBLE / (sum(labelled) + 2) FROM c)) / (sum(labelled) + {PRIOR}::DOUBLE) AS impure FROM c GROUP BY host),
t0 AS (SELECT c.*, '' AS node, l.impure, true AS live FROM c JOIN l ON l.host = c.host)"""]
    kind = lambda x: f"CASE WHEN {x} = '' THEN '{{}}' WHEN regexp_full_match({x}, '[0-9]+') THEN '{{number}}' WHEN regexp_full_match({x}, '[0-9]+\\.[A-Za-z]+') THEN '{{number.ext}}' ELSE '{{any}}' END"
    far = lambda p, q, n, m: f"({p} <> {q} AND ({p} - {q}) * ({p} - {q}) >= {SIMILAR}::DOUBLE * {SIMILAR}::DOUBLE * ((({p} * {n} + {q} * {m}) / ({n} + {m})) * (1 - ({p} * {n} + {q} * {m}) / ({n} + {m}))) * (1 / {n} + 1 / {m}))"
    shares = [f"p{k}" for k in range(KINDS)]
    for d in range(1, ORACLE_LEVELS + 1):
        t = f"t{d - 1}"
        below = f"CASE WHEN len(segments) <= {d} THEN 0 ELSE (least(len(segments) - {d}, {REST}) - 1) * {len(SHAPES)} + list_position([{', '.join(repr(x) for x in SHAPES)}], {kind('segments[-1]')}) END"
        sql.append(f"""k{d} AS (SELECT host, node, sum(n) AS total, count(*) > 1 AS several FROM {t} WHERE live AND len(segments) >= {d} GROUP BY host, node),
x{d} AS (SELECT t.*, coalesce(k.several AND k.total >= {SUPPORT}, false) AND live AND len(segments) >= {d} AS splits, k.total FROM {t} t LEFT JOIN k{d} k ON k.host = t.host AND k.node = t.node),
f{d} AS (SELECT host, node, segments[{d}] AS segment FROM x{d} WHERE splits GROUP BY host, node, segments[{d}], total HAVING sum(n) >= {SUPPORT} AND sum(n) >= total * {SHARE}::DOUBLE),
g{d} AS (SELECT x.*, CASE WHEN splits THEN CASE WHEN f.segment IS NOT NULL THEN f.segment ELSE {kind(f'segments[{d}]')} END END AS label, {below} AS below FROM x{d} x LEFT JOIN f{d} f ON f.host = x.host AND f.node = x.node AND f.segment = segments[{d}]),
b{d} AS (SELECT host, node, label, sum(n)::DOUBLE AS n, sum(labelled)::DOUBLE AS m, sum(blocked)::DOUBLE AS b, any_value(impure) AS above, {', '.join(f"coalesce(sum(n) FILTER (below = {k}), 0)::DOUBLE / sum(n)::DOUBLE AS p{k}" for k in range(KINDS))}
  FROM g{d} WHERE label IS NOT NULL GROUP BY host, node, label),
o{d} AS (SELECT *, lag(n) OVER w AS n_, {', '.join(f'lag({p}) OVER w AS {p}_' for p in shares)} FROM b{d} WINDOW w AS (PARTITION BY host, node ORDER BY {', '.join(shares)}, label)),
q{d} AS (SELECT *, b / greatest(m, 1.0) AS rate, sum(CASE WHEN n_ IS NULL OR {' OR '.join(far(p, p + '_', 'n', 'n_') for p in shares)} THEN 1 ELSE 0 END) OVER (PARTITION BY host, node ORDER BY {', '.join(shares)}, label) AS branch FROM o{d}),
r{d} AS (SELECT *, lag(m) OVER w AS m_, lag(rate) OVER w AS rate_ FROM q{d} WINDOW w AS (PARTITION BY host, node, branch ORDER BY m = 0, rate, label)),
h{d} AS (SELECT *, CASE WHEN m = 0 THEN 0 WHEN m_ IS NULL OR {far('rate', 'rate_', 'm', 'm_')} THEN 1 ELSE 0 END AS fresh FROM r{d}),
i{d} AS (SELECT * EXCLUDE (part0), CASE WHEN m > 0 THEN part0 WHEN parts = 1 THEN 1 ELSE 0 END AS part FROM (SELECT *, sum(fresh) OVER (PARTITION BY host, node, branch ORDER BY m = 0, rate, label) AS part0, sum(fresh) OVER (PARTITION BY host, node, branch) AS parts FROM h{d}) z),
v{d} AS (SELECT host, node, branch, part, sum(m) AS gm, sum(b) AS gb, list_sort(list(label)) AS members FROM i{d} GROUP BY host, node, branch, part),
y{d} AS (SELECT host, node, branch, sum(gm) AS bm, sum(gb) AS bb FROM v{d} GROUP BY host, node, branch),
z{d} AS (SELECT i.host, i.node, i.label, CASE WHEN len(members) = 1 THEN i.label ELSE '{{' || array_to_string(members, '|') || '}}' END AS piece,
  CASE WHEN CASE WHEN i.part > 0 THEN gm ELSE bm END > 0 THEN (CASE WHEN i.part > 0 THEN gb ELSE bb END + {PRIOR}::DOUBLE * above) / (CASE WHEN i.part > 0 THEN gm ELSE bm END + {PRIOR}::DOUBLE)
   ELSE (SELECT (sum(blocked) + 1)::DOUBLE / (sum(labelled) + 2) FROM c) END AS judged
  FROM i{d} i JOIN v{d} v ON v.host = i.host AND v.node = i.node AND v.branch = i.branch AND v.part = i.part JOIN y{d} y ON y.host = i.host AND y.node = i.node AND y.branch = i.branch),
t{d} AS (SELECT g.host, g.path, n, rule, ruled, labelled, blocked, segments, CASE WHEN z.piece IS NOT NULL THEN g.node || '/' || z.piece WHEN live AND len(segments) >= {d} THEN g.node || '/{{...}}' ELSE g.node END AS node, coalesce(z.judged, impure) AS impure,
  live AND splits AS live FROM g{d} g LEFT JOIN z{d} z ON z.host = g.host AND z.node = g.node AND z.label = g.label)""")
    return ",\n".join(sql) + f"""
SELECT u.page_id, u.host, u.path, j.rule, coalesce(j.ruled, CASE WHEN j.impure >= {IMPURE}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, j.node AS template FROM u JOIN t{ORACLE_LEVELS} j ON j.host = u.host AND j.path = u.path"""
