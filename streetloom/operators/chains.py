"""Ways joined end to end, without bringing a group of ways together in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetloom.session import cut_lineage


def chain_positions(ways: DataFrame, keys: list[str]) -> DataFrame:
    """Place of every way in its chain: (keys, way_id, chain, behind, forward). ``ways``: keys, way_id, head, tail (its end nodes).

    Two ways of a group are joined at a node where exactly their two ends meet; where one end or three and more come
    together, chains end. A chain starts at the end way with the lower id (a ring: at its lowest way, forward), and ``chain`` is that id; ``behind``
    counts the ways still to come, ``forward`` says whether the way is run through from head to tail. Nothing depends on the order of rows.

    A way that is left at one of its sides leads to at most one next way, so this is list ranking by pointer doubling: each round
    doubles the stretch that a pointer spans, and a chain of n ways takes about log2(n) rounds of one join on the pointer, which is as
    good as unique. Rings have no end; they are told by pointers that never run out, cut at their lowest way, and ranked again."""
    ends = ways.select(*keys, "way_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("head").alias("node")), F.struct(F.lit(1).alias("side"), F.col("tail").alias("node")))).alias("e"))
    end = F.struct("way_id", F.col("e.side").alias("side"))
    met = ends.groupBy(*keys, F.col("e.node").alias("node")).agg(F.count("*").alias("n"), F.min(end).alias("a"), F.max(end).alias("b")).where("n = 2 AND a.way_id <> b.way_id")
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    links = cut_lineage(met.select(*keys, both.alias("x")).select(
        *keys, F.col("x.a.way_id").alias("way_id"), F.col("x.a.side").alias("side"), F.col("x.b.way_id").alias("to_way"), F.col("x.b.side").alias("at_side")))
    linked = links.select(*keys, "way_id").distinct()
    alone = ways.join(linked, [*keys, "way_id"], "left_anti").select(*keys, "way_id", F.col("way_id").alias("chain"), F.lit(0).cast("long").alias("behind"), F.lit(True).alias("forward"))
    states = linked.select(*keys, "way_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    ranked, rings = _ranked(states, links, keys)
    if rings is not None:
        # The link at the head of the lowest way goes, seen from both of its ways.
        cut = rings.select(*keys, F.col("low").alias("way_id")).distinct()
        left = links.join(cut.withColumn("side", F.lit(0)), [*keys, "way_id", "side"], "left_anti")
        left = left.join(cut.select(*keys, F.col("way_id").alias("to_way"), F.lit(0).alias("at_side")), [*keys, "to_way", "at_side"], "left_anti")
        ring_states = rings.select(*keys, "way_id", "side")
        again, none = _ranked(ring_states, left.join(ring_states, [*keys, "way_id", "side"], "left_semi"), keys)
        assert none is None, "a ring without a cut"
        ranked = ranked.unionByName(again)
    # Of the two directions, the one that ends at the higher way; a way on its own goes forward.
    run = F.struct("last_way", "side", "behind")
    two = ranked.groupBy(*keys, "way_id").agg(F.max(run).alias("on"), F.min(run).alias("back"))
    return two.select(*keys, "way_id", F.col("back.last_way").alias("chain"), F.col("on.behind").alias("behind"), (F.col("on.side") == 1).alias("forward")).unionByName(alone)


def _ranked(states: DataFrame, links: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """For every (way, side it is left at) on a chain: last way and number of ways to it. Second: the ones on rings with the lowest way of
    their ring, None if there are none. Pointers that have reached an end are set aside, written once; each round writes the open ones alone."""
    columns = [*keys, "way_id", "side", "next_way", "next_side", "last_way", "behind", "low"]
    s = cut_lineage(states.join(links, [*keys, "way_id", "side"], "left").select(
        *keys, "way_id", "side", F.col("to_way").alias("next_way"), (1 - F.col("at_side")).alias("next_side"), F.coalesce("to_way", "way_id").alias("last_way"),
        F.when(F.col("to_way").isNull(), 0).otherwise(1).cast("long").alias("behind"), F.least("way_id", "to_way").alias("low")))
    open_, done = s.where("next_way IS NOT NULL"), s.where("next_way IS NULL")
    before = None
    while True:
        now = tuple(open_.agg(F.count("*"), F.sum(F.col("low").cast("decimal(38,0)"))).first())
        if not now[0] or now == before:
            break
        before = now
        ahead = open_.unionByName(done).select(*keys, F.col("way_id").alias("next_way"), F.col("side").alias("next_side"), F.col("next_way").alias("_way"), F.col("next_side").alias("_side"), F.col("last_way").alias("_last"),
                                               F.col("behind").alias("_behind"), F.col("low").alias("_low"))
        j = open_.join(ahead, [*keys, "next_way", "next_side"])
        s = cut_lineage(j.select(*keys, "way_id", "side", F.col("_way").alias("next_way"), F.col("_side").alias("next_side"), F.col("_last").alias("last_way"), (F.col("behind") + F.col("_behind")).alias("behind"),
                                 F.least("low", "_low").alias("low")).select(*columns))
        open_, done = s.where("next_way IS NOT NULL"), done.unionByName(s.where("next_way IS NULL"))
    rings = open_.select(*keys, "way_id", "side", "low") if now[0] else None
    return done.select(*keys, "way_id", "side", "last_way", "behind"), rings


def chained_arrays(ways: DataFrame, keys: list[str], columns: list[str], *aggs: Column) -> DataFrame:
    """One row per chain: keys, chain, the arrays ``columns`` of its ways laid one after the other (each element once where two ways meet), and
    ``aggs`` over its ways. ``ways``: keys, way_id, node_ids and the columns."""
    place = chain_positions(ways.select(*keys, "way_id", F.get("node_ids", F.lit(0)).alias("head"), F.element_at("node_ids", -1).alias("tail")), keys)
    along = ways.join(place, [*keys, "way_id"])
    run = lambda c: F.when(F.col("forward"), F.col(c)).otherwise(F.reverse(c))
    g = along.groupBy(*keys, "chain").agg(F.array_sort(F.collect_list(F.struct((-F.col("behind")).alias("_at"), *[run(c).alias(c) for c in columns]))).alias("_parts"), *aggs)
    for c in columns:
        whole = F.flatten(F.col(f"_parts.{c}"))
        g = g.withColumn(c, F.transform(F.array(whole), lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1))))[0])
    return g.drop("_parts")
