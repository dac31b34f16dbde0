"""Rule tables applied to features: style rules and ranked keyword search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_rules(features: DataFrame, rules: DataFrame, geometry: str) -> DataFrame:
    """The rule that draws each feature: all its conditions hold and it allows the geometry; highest ``layer`` wins,
    then lowest ``ord``.

    ``rules``: (ord INT, layer INT, geo ARRAY<STRING>, conditions MAP<STRING,ARRAY<STRING>>), '*' accepts any value.
    A feature's tags are exploded and joined on the tag key, so a rule is only tried where one of its keys occurs.
    """
    usable = rules.where(F.array_contains("geo", geometry)).where(F.size("conditions") > 0)
    wanted = usable.select("ord", "layer", F.size("conditions").alias("need"), F.explode("conditions").alias("key", "allowed"))
    pairs = features.where(F.col("tags").isNotNull()).select("id", F.explode("tags").alias("key", "value"))
    hits = pairs.where(F.coalesce("value", F.lit("")) != "").join(wanted, "key").where(
        F.array_contains("allowed", "*") | F.array_contains(F.col("allowed"), F.col("value")))
    # Count per (feature, rule) first: partial aggregation combines before the shuffle, then the best rule by min.
    whole = hits.groupBy("id", "ord", "layer", "need").agg(F.count("*").alias("n")).where("n = need")
    best = F.min_by(F.struct("ord", "layer"), F.struct(-F.col("layer"), F.col("ord")))
    return whole.groupBy("id").agg(best.alias("r")).select("id", F.col("r.ord").alias("ord"), F.col("r.layer").alias("layer"))


def ranked_search(items: DataFrame, keywords: list[str]) -> DataFrame:
    """Every (keyword, item) hit with its score: 0 same name, 1 prefix, 2 within name, 3 id, 4 category or alias, 5 tags.

    ``items``: (item_id, name, category, aliases ARRAY, tags MAP). The keywords are what somebody typed: a short list of
    literals, tried on each item in one pass without a join.
    """
    clean = sorted({k.strip().lower() for k in keywords if k and k.strip()})
    name = F.lower("name")

    def score(kw: str):
        def within(c):
            return F.coalesce(F.lower(c).contains(kw), F.lit(False))
        in_alias = F.coalesce(F.exists("aliases", lambda a: within(a)), F.lit(False))
        in_tags = F.coalesce(F.exists(F.map_entries("tags"), lambda e: within(e["key"]) | within(e["value"])), F.lit(False))
        return (F.when(name == kw, 0).when(name.startswith(kw), 1).when(name.contains(kw), 2)
                .when(within(F.col("item_id").cast("string")), 3).when(within(F.col("category")) | in_alias, 4)
                .when(in_tags, 5))

    scored = F.array_compact(F.array(*[
        F.when(score(k).isNotNull(), F.struct(F.lit(k).alias("kw"), score(k).alias("score"))) for k in clean]))
    return items.withColumn("_hit", F.explode(scored)).select(
        F.col("_hit.kw").alias("kw"), F.col("_hit.score").alias("score"), "item_id", "name")
