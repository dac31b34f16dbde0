"""Road and rail networks: edges, crossings, congestion, components and path costs."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetloom.functions import roads as R, tags as TG
from streetloom.functions.geo import M_PER_DEG_LAT, M_PER_DEG_LON_EQUATOR, RAD, boxes_touch, js_round, meters_between
from streetloom.model import OsmDataset
from streetloom.operators.geometry import way_segments
from streetloom.operators.spatial import nearest_rank, neighbour_pairs, row_lon_step, segment_cells
from streetloom.session import cut_lineage, drop_table, write_table

# ---- Fixed values --------------------------------------------------------------------------------------
CELL_M, MERGE_M, END_T, EPS_T = 150.0, 1.5, 1e-3, 1e-6
LINK_WAY, LINK_SPEED, LINK_LEAST_M = -1, 10, 0.5
WALK_LEAST_M, WALK_MOST_M, WALK_SPREAD = 2300.0, 4000.0, 1.5
# -----------------------------------------------------------------------------------------------------------


def network_ways(ways: DataFrame, mode: str) -> DataFrame:
    """Ways that belong to the road or rail network with kind, limit, base congestion, dedicated lane and layer."""
    t = F.col("tags")
    ways = ways.select("id", TG.read_once(t).alias("tags"))
    if mode == "road":
        return ways.where(R.drivable(t)).select(
            F.col("id").alias("way_id"), F.trim(t["highway"]).alias("kind"), R.road_limit(t).alias("limit_kmh"),
            R.base_congestion(t).alias("base"), R.dedicated_lane(t).alias("dedicated"), R.effective_layer(t).alias("layer"))
    speed = R.rail_speed(t)
    return ways.where(speed.isNotNull()).select(
        F.col("id").alias("way_id"), t["railway"].alias("kind"), speed.alias("limit_kmh"), F.lit(1.0).alias("base"),
        F.lit(True).alias("dedicated"), F.lit(0).alias("layer"))


def build_edges(ds: OsmDataset, mode: str = "road") -> DataFrame:
    """Undirected edges between consecutive located references: way_id, seq, a, b, their places, length_m, speed_kmh,
    congestion, layer. The few network ways are picked before references meet nodes."""
    info = network_ways(ds.ways, mode)
    refs = ds.way_nodes.join(info.select("way_id"), "way_id", "left_semi")
    seg = way_segments(refs, ds.nodes).where("gap = 1").drop("gap")
    seg = seg.withColumn("length_m", meters_between(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))).where("length_m > 0.01")
    congestion = F.when(F.col("dedicated"), 1.0).otherwise(F.col("base"))
    e = seg.join(info, "way_id").withColumn("congestion", congestion)
    speed = R.service_speed(F.col("limit_kmh"), F.col("congestion")) if mode == "road" else F.col("limit_kmh")
    return e.withColumn("speed_kmh", speed.cast("int"))


def segment_crossings(segs: DataFrame, cell_m: float = CELL_M) -> DataFrame:
    """Pairs of segments of the same layer that cross without sharing a node, each pair once: both segments' keys and
    ends, positions t and u on them, and the point. Segments meet only inside grid cells, and a pair counts only in the
    cell that holds the crossing."""
    cols = ["way_id", "seq", "a", "a_lat", "a_lon", "b", "b_lat", "b_lon", "layer"]
    filed = segment_cells(segs.select(*cols), cell_m, pad_m=1.0)
    meet = ["cell_row", "cell_col", "_layer"]
    left = filed.select(*[F.col(c).alias(f"i_{c}") for c in cols], "cell_row", "cell_col", F.col("layer").alias("_layer"))
    right = filed.select(*[F.col(c).alias(f"j_{c}") for c in cols], "cell_row", "cell_col", F.col("layer").alias("_layer"))
    c = {n: F.col(n) for n in left.columns + right.columns}
    after = (c["i_way_id"] < c["j_way_id"]) | ((c["i_way_id"] == c["j_way_id"]) & (c["i_seq"] < c["j_seq"]))
    apart = ((c["i_a"] != c["j_a"]) & (c["i_a"] != c["j_b"]) & (c["i_b"] != c["j_a"]) & (c["i_b"] != c["j_b"]))

    def overlap(k: str) -> Column:
        return ((F.greatest(f"i_a_{k}", f"i_b_{k}") >= F.least(f"j_a_{k}", f"j_b_{k}"))
                & (F.greatest(f"j_a_{k}", f"j_b_{k}") >= F.least(f"i_a_{k}", f"i_b_{k}")))

    pairs = left.join(right, meet).where(after & apart & overlap("lat") & overlap("lon"))
    rx, ry = c["i_b_lon"] - c["i_a_lon"], c["i_b_lat"] - c["i_a_lat"]
    sx, sy = c["j_b_lon"] - c["j_a_lon"], c["j_b_lat"] - c["j_a_lat"]
    qx, qy = c["j_a_lon"] - c["i_a_lon"], c["j_a_lat"] - c["i_a_lat"]
    den = F.nullif(rx * sy - ry * sx, F.lit(0.0))
    # Spark puts filters above a join before its own conditions. The positions come out of an explode, which no filter passes, so they are worked out once, and for pairs whose extents overlap alone.
    solved = pairs.withColumn("_at", F.explode(F.array(F.struct(((qx * sy - qy * sx) / den).alias("t"), ((qx * ry - qy * rx) / den).alias("u"))))).select("*", "_at.t", "_at.u").drop("_at")
    solved = solved.where(F.col("t").between(-EPS_T, 1 + EPS_T) & F.col("u").between(-EPS_T, 1 + EPS_T))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(x)))
    solved = solved.withColumn("t", clamp("t")).withColumn("u", clamp("u"))
    solved = solved.withColumn("lat", c["i_a_lat"] + ry * F.col("t")).withColumn("lon", c["i_a_lon"] + rx * F.col("t"))
    step = cell_m / M_PER_DEG_LAT
    home = (F.floor(F.col("lat") / step) == F.col("cell_row")) & (F.floor(F.col("lon") / row_lon_step(F.col("cell_row"), cell_m)) == F.col("cell_col"))
    return solved.where(home).drop(*meet)


def junction_id(lat: Column, lon: Column) -> Column:
    """One negative id per 1.5 m square, so that crossings at the same spot become the same node."""
    k_lon = F.lit(M_PER_DEG_LON_EQUATOR) * F.cos(F.floor(lat) * RAD)
    row = F.floor(lat * M_PER_DEG_LAT / MERGE_M + 0.5) + 10_000_000
    col = F.floor(lon * k_lon / MERGE_M + 0.5) + 20_000_000
    return -(row * 40_000_000 + col) - 1


def crossing_nodes(crossings: DataFrame) -> DataFrame:
    """Which node each crossing becomes: an end of the first segment, else an end of the second, else a new one."""
    def end(p: str, t: str) -> Column:
        return F.when(F.col(t) <= END_T, F.col(f"{p}_a")).when(F.col(t) >= 1 - END_T, F.col(f"{p}_b"))
    e = crossings.withColumn("i_end", end("i", "t")).withColumn("j_end", end("j", "u"))
    return e.withColumn("node_id", F.coalesce("i_end", "j_end", junction_id(F.col("lat"), F.col("lon"))))


def node_network(edges: DataFrame) -> DataFrame:
    """Edges cut at every crossing, so that roads that cross are joined; ends that lie on the same spot without being the
    same node get a short link edge. All crossings are found before anything is cut. Edges and crossings enter several
    joins below, so each is written once to the shared checkpoint folder."""
    edges = cut_lineage(edges)
    x = cut_lineage(crossing_nodes(segment_crossings(edges)))
    cuts = x.select(F.col("i_way_id").alias("way_id"), F.col("i_seq").alias("seq"), "t", "node_id", "lat", "lon").unionByName(
        x.select(F.col("j_way_id").alias("way_id"), F.col("j_seq").alias("seq"), F.col("u").alias("t"), "node_id", "lat", "lon"))
    # The place of a new node is the same for all segments that meet there; existing nodes keep theirs.
    spot = cuts.where("node_id < 0").groupBy("node_id").agg(F.min(F.struct("lat", "lon")).alias("p"))
    real = edges.select(F.col("a").alias("node_id"), F.struct(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")).alias("p")).unionByName(
        edges.select(F.col("b").alias("node_id"), F.struct(F.col("b_lat").alias("lat"), F.col("b_lon").alias("lon")).alias("p")))
    used = cuts.where("node_id >= 0").select("node_id").distinct()
    spot = spot.unionByName(real.join(used, "node_id", "left_semi").groupBy("node_id").agg(F.min("p").alias("p")))
    per = (cuts.select("way_id", "seq", "t", "node_id").join(spot, "node_id").groupBy("way_id", "seq")
           .agg(F.array_sort(F.collect_list(F.struct("t", "node_id", "p"))).alias("cuts")))
    e = edges.join(per, ["way_id", "seq"], "left")
    point = "struct<t:double,node_id:bigint,p:struct<lat:double,lon:double>>"
    inside = F.filter(F.coalesce("cuts", F.array().cast(f"array<{point}>")), lambda k: (k["node_id"] != F.col("a")) & (k["node_id"] != F.col("b")))
    e = e.withColumn("_in", inside)
    # Drop a cut that repeats the node before it or lies on the same place.
    inner = F.filter("_in", lambda k, i: (i == 0) | ((F.get("_in", i - 1)["node_id"] != k["node_id"]) & (k["t"] - F.get("_in", i - 1)["t"] >= EPS_T)))
    chain = F.concat(F.array(F.struct(F.lit(0.0).alias("t"), F.col("a").alias("node_id"), F.struct(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")).alias("p"))), inner,
                     F.array(F.struct(F.lit(1.0).alias("t"), F.col("b").alias("node_id"), F.struct(F.col("b_lat").alias("lat"), F.col("b_lon").alias("lon")).alias("p"))))
    e = e.withColumn("_chain", chain)
    steps = F.sequence(F.lit(0), F.size("_chain") - 2)
    e = e.withColumn("part", F.explode(steps)).withColumn("_p", F.get("_chain", F.col("part"))).withColumn("_q", F.get("_chain", F.col("part") + 1))
    parts = e.select("way_id", "seq", "part", F.col("_p.node_id").alias("a"), F.col("_q.node_id").alias("b"), F.col("_p.p.lat").alias("a_lat"), F.col("_p.p.lon").alias("a_lon"),
                     F.col("_q.p.lat").alias("b_lat"), F.col("_q.p.lon").alias("b_lon"), "speed_kmh", "congestion")
    parts = parts.withColumn("length_m", meters_between(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))).where("length_m > 0.01")
    # Both at an end, on different nodes: their own places are needed, which the crossing rows carry.
    def pick(p: str, t: str, k: str) -> Column:
        return F.when(F.col(t) <= END_T, F.col(f"{p}_a_{k}")).otherwise(F.col(f"{p}_b_{k}"))
    links = x.where("i_end IS NOT NULL AND j_end IS NOT NULL AND i_end <> j_end").select(
        F.lit(LINK_WAY).cast("long").alias("way_id"), F.lit(0).alias("seq"), F.lit(0).alias("part"), F.least("i_end", "j_end").alias("a"), F.greatest("i_end", "j_end").alias("b"),
        *[F.when(F.col("i_end") < F.col("j_end"), pick("i", "t", k)).otherwise(pick("j", "u", k)).alias(f"a_{k}") for k in ("lat", "lon")],
        *[F.when(F.col("i_end") < F.col("j_end"), pick("j", "u", k)).otherwise(pick("i", "t", k)).alias(f"b_{k}") for k in ("lat", "lon")],
        F.lit(LINK_SPEED).alias("speed_kmh"), F.lit(R.CONGESTION_MIN).alias("congestion")).dropDuplicates(["a", "b"])
    links = links.withColumn("length_m", F.greatest(F.lit(LINK_LEAST_M), meters_between(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))))
    return parts.unionByName(links)


# ---- congestion ------------------------------------------------------------------------------------------------

def way_congestion(edges: DataFrame, ways: DataFrame) -> DataFrame:
    """Junctions, their density, congestion and service speed of each way. ``ways``: from ``network_ways``."""
    ends = edges.select("way_id", F.explode(F.array("a", "b")).alias("node_id"))
    degree = ends.groupBy("node_id").agg(F.count("*").alias("degree"))
    per = (ends.distinct().join(degree, "node_id").groupBy("way_id")
           .agg(F.count_if(F.col("degree") >= 3).alias("junctions"), js_round(F.avg("degree"), 2).alias("degree_avg")))
    length = edges.groupBy("way_id").agg(F.sum("length_m").alias("length_m"))
    j = ways.join(per, "way_id").join(length, "way_id")
    density = F.col("junctions") / (F.col("length_m") / 1000 + R.JUNCTION_PRIOR_KM)
    cong = F.when(F.col("dedicated"), 1.0).otherwise(R.junction_congestion(F.col("base"), F.col("_d")))
    j = j.withColumn("_d", density).withColumn("_c", cong)
    return j.select("way_id", "kind", "limit_kmh", "junctions", js_round(F.col("_d"), 2).alias("density"), js_round(F.col("_c"), 3).alias("congestion"),
                    R.service_speed(F.greatest("limit_kmh", F.lit(1)), F.col("_c")).alias("speed_kmh"), "degree_avg", js_round(F.col("length_m")).alias("length_m"))


def congestion_in_box(stats: DataFrame, box: dict, limit: int | None = None, worst: float | None = None) -> DataFrame:
    """Ways of a box, most congested first, with their level. ``stats``: way_congestion plus extent columns."""
    hit = stats.where(boxes_touch(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"), box))
    if worst is not None:
        hit = hit.where(F.col("congestion") <= worst)
    ranked = hit.withColumn("level", R.congestion_level(F.col("congestion"))).orderBy("congestion", "way_id")
    return ranked if limit is None else ranked.limit(limit)


def network_statistics(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("ways"), js_round(F.avg("congestion"), 3).alias("avg_congestion"), F.min("congestion").alias("min_congestion"),
                     F.max("congestion").alias("max_congestion"), F.min_by("way_id", F.struct("speed_kmh", "way_id")).alias("slowest_way"), F.min("speed_kmh").alias("slowest_kmh"))


# ---- neighbours ----------------------------------------------------------------------------------------------------

def transfer_radius(a: Column, b: Column) -> Column:
    """How far apart two stations may be to walk between them: where their catchments meet, within fixed limits."""
    spread = F.greatest(F.lit(WALK_LEAST_M), F.greatest(a, b) * WALK_SPREAD)
    return F.greatest(F.lit(WALK_LEAST_M), F.least(F.lit(WALK_MOST_M), spread, (a + b).cast("double")))


def mutual_neighbours(stations: DataFrame, keep: int | None = None) -> DataFrame:
    """Walk links (a, b, meters): each station proposes its ``keep`` nearest (all by default) within the pair's radius; a link exists when
    both propose each other. Ties go to the lower id."""
    pairs = neighbour_pairs(stations, WALK_MOST_M, ["catchment_m"])
    near = pairs.where(F.col("meters") <= transfer_radius(F.col("a_catchment_m"), F.col("b_catchment_m"))).select(
        F.col("a_id").alias("a"), F.col("b_id").alias("b"), "meters")
    top = nearest_rank(near, ["a"], ["meters", "b"], keep).drop("rank") if keep else near
    back = top.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return top.join(back, ["a", "b"], "left_semi")


# ---- iterative jobs ---------------------------------------------------------------------------------------------------

def scattered(c: Column, turn: int) -> Column:
    """A permutation of the 64-bit numbers that looks random, another one each ``turn``: three rounds of a Feistel network."""
    half = F.lit(0xFFFFFFFF)
    high, low = F.shiftrightunsigned(c, 32), c.bitwiseAND(half)
    for k in range(3):
        high, low = low, high.bitwiseXOR(F.xxhash64(low, F.lit(3 * turn + k)).bitwiseAND(half))
    return F.shiftleft(high, 32).bitwiseOR(low)


def components(edges: DataFrame) -> DataFrame:
    """Connected components as (node_id, component = lowest node id), by alternating large-star and small-star steps
    (Kiveris et al., 2014): the number of rounds grows with the logarithm of the size. Each round is written to the shared
    checkpoint folder. The work per node is a join with its minimum, so a hub is spread by adaptive skew join. Few rounds for groups like stars;
    every round keeps an edge per node, so large networks are better contracted (``network_components``)."""
    e = cut_lineage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node_id")).distinct()

    def fingerprint(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut_lineage(small)
        now = fingerprint(e)
        if now == last:
            break
        last = now
    root = e.groupBy(F.col("u").alias("node_id")).agg(F.min("v").alias("component"))
    return nodes.join(root, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def network_components(edges: DataFrame) -> DataFrame:
    """``components`` of a large network, by randomised contraction (Boegeholz, Brand, Todor, 2020): in each round nodes are numbered anew at
    random, and each becomes one with the lowest of itself and its neighbours. What is left shrinks by a constant factor a round in the mean, so all rounds
    together move about as many rows as the first two, and their number grows with the logarithm of the size. A round's step (u, to, low: the lowest
    node id in u) stays in the shared checkpoint folder, its edges only until the next ones are written. A hub is spread by adaptive skew join."""
    spark = edges.sparkSession
    whole = write_table(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())[0]
    live, path, steps, lows = whole.where("u <> v"), None, [], None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = both.groupBy("u").agg(F.min(scattered(F.col("v"), len(steps))).alias("_v")).select("u", F.least("_v", scattered(F.col("u"), len(steps))).alias("to"))
        step = write_table(to.withColumn("low", F.col("u")) if lows is None else to.join(lows, "u"))[0]
        first, second = step.select("u", F.col("to").alias("_a")), step.select(F.col("u").alias("v"), F.col("to").alias("_b"))
        left, at = write_table(live.join(first, "u").join(second, "v").where("_a <> _b").select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v")).distinct())
        if path:
            drop_table(spark, path)
        live, path, lows = left, at, step.groupBy(F.col("to").alias("u")).agg(F.min("low").alias("low"))
        steps.append(step)
    alone = whole.where("u = v").select(F.col("u").alias("node_id"))
    if not steps:
        return alone.withColumn("component", F.col("node_id"))
    # Back from the last round to the first: a node has the component of what it became, which has its own lowest node unless it became another.
    found = None
    for step in reversed(steps):
        own = step.groupBy("to").agg(F.min("low").alias("component"))
        if found is not None:
            own = own.join(found.withColumnRenamed("u", "to"), "to", "left").select("to", F.coalesce("_found", "component").alias("component"))
        found = write_table(step.select("u", "to").join(own, "to").select("u", F.col("component").alias("_found")))[0] if step is not steps[0] else step.select("u", "to").join(
            own, "to").select("u", F.col("component").alias("_found"))
    known = found.select(F.col("u").alias("node_id"), F.col("_found").alias("component"))
    return known.unionByName(alone.join(steps[0].select(F.col("u").alias("node_id")), "node_id", "left_anti").withColumn("component", F.col("node_id")))


def edge_cost(length: Column, speed: Column) -> Column:
    return length * (F.lit(1.0) + 0.6 * 45.0 / F.greatest(F.lit(15), speed))


LABEL = ["cost", "hops", "prev", "length_m", "seconds"]


def shortest_costs(edges: DataFrame, origins: DataFrame, max_cost: float, width: float | None = None) -> DataFrame:
    """Least cost from many origins to every node within ``max_cost``: (origin, node_id, cost, length_m, seconds, prev). ``origins``: origin, node_id, and
    ``most`` where an origin has a limit of its own; no label beyond it is made.

    Labels are settled in buckets of cost, ``width`` wide (by default the dearest edge). Within a bucket, rounds of relaxation go on from the labels that the last round
    improved, until none does; what lies beyond waits, as its own table, for its bucket. A label that leads back to a settled node cannot come from farther than
    one edge, so it is compared with the last buckets only: labels settled earlier are written and not read again. Each round shuffles the rows
    it changed, and the rounds of a bucket are deleted when it is settled. Ties: fewer hops, then the lower previous node."""
    one = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "length_m", "speed_kmh")
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length_m", "speed_kmh"))
    c = edge_cost(F.col("length_m"), F.col("speed_kmh"))
    hop = write_table(both.where(c <= max_cost))[0].select("src", "dst", c.alias("c"), (F.col("length_m") / (F.col("speed_kmh") / 3.6)).alias("s"), F.col("length_m").alias("l"))
    most = hop.agg(F.max("c")).first()[0] or 1.0
    width = width or most
    back = ceil(most / width) + 1  # buckets in which a settled neighbour can lie
    zero = F.lit(0.0)
    keys, label = ["origin", "node_id"], F.struct(*LABEL)
    own = ["most"] if "most" in origins.columns else []
    limit_of = F.least(F.lit(float(max_cost)), *[F.col(c) for c in own]) if own else F.lit(float(max_cost))

    def best(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys, *own).agg(F.min(label).alias("b")).select(*keys, *own, "b.*")

    waiting, path = write_table(best(origins.select(*keys, *own, zero.alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("prev"), zero.alias("length_m"), zero.alias("seconds"))))
    settled: list[tuple[int, DataFrame]] = []
    while (least := waiting.agg(F.min("cost")).first()[0]) is not None:
        bucket = int(least // width)
        limit = width * (bucket + 1)
        near = [old.select(*keys) for b, old in settled if b >= bucket - back]
        # Tables of this bucket, one per round; a node improved again stands in several of them.
        front, spent = waiting.where(F.col("cost") < limit), [path]
        rounds, later = [front], [waiting.where(F.col("cost") >= limit)]
        while not front.isEmpty():
            step = best(front.join(hop, F.col("node_id") == F.col("src")).select(
                "origin", *own, F.col("dst").alias("node_id"), (F.col("cost") + F.col("c")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("node_id").alias("prev"),
                (F.col("length_m") + F.col("l")).alias("length_m"), (F.col("seconds") + F.col("s")).alias("seconds")).where(F.col("cost") <= limit_of))
            for old in near:
                step = step.join(old, keys, "left_anti")
            step, path = write_table(step)
            spent.append(path)
            later.append(step.where(F.col("cost") >= limit))
            known = best(reduce(DataFrame.unionByName, rounds)).select(*keys, label.alias("_old"))
            front = step.where(F.col("cost") < limit).join(known, keys, "left").where(F.col("_old").isNull() | (label < F.col("_old"))).drop("_old")
            front, path = write_table(front)
            spent.append(path)
            rounds.append(front)
        done = write_table(best(reduce(DataFrame.unionByName, rounds)))[0]
        settled.append((bucket, done))
        waiting, path = write_table(best(reduce(DataFrame.unionByName, later)).join(done.select(*keys), keys, "left_anti"))
        for old in spent:
            drop_table(edges.sparkSession, old)
    if not settled:
        return waiting.select("origin", "node_id", "cost", "length_m", "seconds", "prev")
    return reduce(DataFrame.unionByName, [t for _, t in settled]).select("origin", "node_id", "cost", "length_m", "seconds", "prev")


def route_lines(line_stops: DataFrame, edges: DataFrame, max_cost: float) -> tuple[DataFrame, DataFrame]:
    """Cost of each line along its stops: (segments, lines). ``line_stops``: line_id, idx, node_id. A line's totals count only if no
    segment is broken, and its first broken segment is named.

    Two stops that an edge joins need no search where that edge is no dearer than the cheapest one at the one stop and the cheapest at the other together, since
    any other way leaves by one and arrives by another. The rest is searched, distinct stop pairs once, and no farther than the dearest pair of its origin can be: an edge
    that joins two stops is a way between them, so it bounds that pair."""
    spark, top = edges.sparkSession, F.lit(float(max_cost))
    roads, roads_at = write_table(edges.select("a", "b", "length_m", "speed_kmh"))
    c = edge_cost(F.col("length_m"), F.col("speed_kmh"))
    nxt = line_stops.select("line_id", (F.col("idx") - 1).alias("idx"), F.col("node_id").alias("to_node"))
    seg = line_stops.join(nxt, ["line_id", "idx"]).select("line_id", "idx", F.col("node_id").alias("from_node"), "to_node")
    seg = seg.withColumn("_u", F.least("from_node", "to_node")).withColumn("_v", F.greatest("from_node", "to_node"))
    label = F.struct(c.alias("cost"), "length_m", (F.col("length_m") / (F.col("speed_kmh") / 3.6)).alias("seconds"))
    least = roads.select(F.explode(F.array("a", "b")).alias("_n"), c.alias("_c")).groupBy("_n").agg(F.min("_c").alias("_c"))
    direct = roads.where(c <= top).groupBy(F.least("a", "b").alias("_u"), F.greatest("a", "b").alias("_v")).agg(F.min(label).alias("_e"))
    for end in ("_u", "_v"):
        direct = direct.join(least.select(F.col("_n").alias(end), F.col("_c").alias(f"{end}_least")), end)
    direct, direct_at = write_table(direct.select("_u", "_v", "_e.*", (F.col("_u_least") + F.col("_v_least") >= F.col("_e.cost")).alias("_sure")))
    # A stop pair of one node costs nothing.
    same = F.coalesce(F.col("from_node") == F.col("to_node"), F.lit(False))
    sure = same | F.coalesce("_sure", F.lit(False))
    seg = write_table(seg.join(direct, ["_u", "_v"], "left").select("line_id", "idx", "from_node", "to_node", F.col("cost").alias("_bound"), sure.alias("_sure"),
                                                                    *[F.when(same, 0.0).when(sure, F.col(k)).alias(k) for k in ("cost", "length_m", "seconds")]))[0]
    drop_table(spark, direct_at)
    starts = seg.where(~F.col("_sure")).groupBy("from_node").agg(F.max(F.coalesce("_bound", top)).alias("most")).select(
        F.col("from_node").alias("origin"), F.col("from_node").alias("node_id"), "most")
    costs = shortest_costs(roads, starts, max_cost)
    drop_table(spark, roads_at)
    found = seg.where(~F.col("_sure")).select("from_node", "to_node").distinct().join(
        costs.select(F.col("origin").alias("from_node"), F.col("node_id").alias("to_node"), *[F.col(k).alias(f"_{k}") for k in ("cost", "length_m", "seconds")]), ["from_node", "to_node"])
    s = seg.join(write_table(found)[0], ["from_node", "to_node"], "left").select(
        "from_node", "to_node", "line_id", "idx", *[F.when(F.col("_sure"), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in ("cost", "length_m", "seconds")])
    broken = F.col("cost").isNull()
    lines = s.groupBy("line_id").agg(
        F.min(F.when(broken, F.col("idx"))).alias("first_broken"), F.count("*").alias("segments"),
        js_round(F.sum("length_m")).alias("length_m"), js_round(F.sum("seconds")).alias("seconds"))
    whole = F.col("first_broken").isNull()
    return s, lines.select("line_id", "segments", "first_broken", F.when(whole, F.col("length_m")).otherwise(0).alias("length_m"),
                           F.when(whole, F.col("seconds")).otherwise(0).alias("seconds"))


def path_geometry(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """Running distance along paths (path_id, idx, node_id, speed): unknown nodes are skipped. A path is one line's
    vertices, so one window per path is small."""
    w = Window.partitionBy("path_id").orderBy("idx")
    p = path.join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id")
    step = meters_between(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    p = p.withColumn("_m", F.coalesce(step, F.lit(0.0)))
    return p.withColumn("distance_m", F.sum("_m").over(w)).drop("_m")


def keep_apart(items: DataFrame, near: DataFrame) -> DataFrame:
    """Greedy thinning in order of ``key``: an item stays unless a staying item with a lower key is its neighbour.

    ``items``: key; ``near``: key, other (both directions). The one-by-one rule is reached by rounds: items whose key is
    below all undecided neighbours stay, their neighbours go, until nothing is undecided. Same result, no order of rows.
    """
    undecided = cut_lineage(items.select("key"))
    pairs = cut_lineage(near.select("key", "other"))
    kept = None
    while True:
        lower = pairs.where("other < key").select("key").distinct()
        now = undecided.join(lower, "key", "left_anti")
        gone = pairs.join(now, "key", "left_semi").select(F.col("other").alias("key")).distinct()
        kept = now if kept is None else kept.unionByName(now)
        undecided = cut_lineage(undecided.join(now, "key", "left_anti").join(gone, "key", "left_anti"))
        if undecided.isEmpty():
            break
        pairs = cut_lineage(pairs.join(undecided, "key", "left_semi").join(undecided.withColumnRenamed("key", "other"), "other", "left_semi"))
    return kept


