"""Operators without an SQL twin, against brute force; and helpers on hot groups."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetloom.functions import shapes as S
from streetloom.operators import history as H, network as N, ordered as O, population as P, transit as TR
from streetloom.operators.chains import chained_arrays
from streetloom.streaming import live as L


def test_ordered_helpers_on_one_hot_key(spark):
    rows = [(0 if i % 3 else i, i, (i * 37) % 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    chunk = F.floor(F.col("i") / 100)
    got = {(r.k, r.i): (r.rn, r.total, r.prev.v if r.prev else None) for r in O.with_previous(
        O.running_sum(O.numbered(df, ["k"], chunk, [F.col("i")]), ["k"], chunk, [F.col("i")], "v", "total"), ["k"], chunk, ["i"], ["v"]).collect()}
    seen: dict = {}
    for k, i, v in rows:
        rn, total, last = seen.get(k, (0, 0, None))
        assert got[k, i] == (rn + 1, total + v, last)
        seen[k] = (rn + 1, total + v, v)


def test_last_known_passes_empty_buckets(spark):
    rows = [("a", 5, True, 1), ("a", 950, False, None), ("a", 951, True, 2), ("a", 951, False, None), ("b", 3, False, None)]
    df = spark.createDataFrame(rows, "k string, t long, is_plan boolean, p int")
    got = {(r.k, r.t): r.known.p if r.known else None for r in O.last_known(df, ["k"], "t", F.floor(F.col("t") / 100), "is_plan", ["p"]).where("NOT is_plan").collect()}
    assert got == {("a", 950): 1, ("a", 951): 2, ("b", 3): None}


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(m), s) for a, b, m, s in rows], "a long, b long, length_m double, speed_kmh int")


def random_graph(n, m, seed):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), r.randrange(50, 900), r.choice([10, 30, 60])) for _ in range(m)]


def test_shortest_costs_match_dijkstra(spark):
    g = [e for e in random_graph(60, 110, 4) if e[0] != e[1]]
    adj: dict = {}
    for a, b, m, s in g:
        c = m * (1 + 0.6 * 45 / max(15, s))
        adj.setdefault(a, []).append((b, c))
        adj.setdefault(b, []).append((a, c))
    limit = 4000.0
    want = {}
    for o in (0, 7, 33):
        best, heap = {o: 0.0}, [(0.0, o)]
        while heap:
            d, u = heapq.heappop(heap)
            for v, c in adj.get(u, ()) if d <= best[u] else ():
                if d + c <= limit and d + c < best.get(v, 1e18):
                    best[v] = d + c
                    heapq.heappush(heap, (d + c, v))
        want.update({(o, v): d for v, d in best.items()})
    origins = spark.createDataFrame([(0, 0), (7, 7), (33, 33)], "origin long, node_id long")
    got = {(r.origin, r.node_id): r.cost for r in N.shortest_costs(edges(spark, g), origins, limit).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_components_match_union_find(spark):
    g = [e for e in random_graph(200, 130, 9) if e[0] != e[1]]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b, *_ in g:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node_id: r.component for r in N.components(edges(spark, g)).collect()}
    assert got == {x: root(x) for e in g for x in e[:2]}


def test_keep_apart_is_the_greedy_choice(spark):
    r = random.Random(2)
    pairs = {(a, b) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(150)) if a != b}
    pairs |= {(b, a) for a, b in pairs}
    kept: set = set()
    for k in range(80):
        if not any((k, o) in pairs for o in kept):
            kept.add(k)
    got = N.keep_apart(spark.range(80).withColumnRenamed("id", "key"), spark.createDataFrame(sorted(pairs), "key long, other long"))
    assert {x.key for x in got.collect()} == kept


def test_node_network_joins_crossing_roads(spark):
    e = spark.createDataFrame([(1, 1, 1, 2, 39.8, 116.2, 39.8, 116.204), (2, 1, 3, 4, 39.799, 116.202, 39.801, 116.202), (3, 1, 5, 6, 39.8, 116.2, 39.803, 116.2)],
                              "way_id long, seq int, a long, b long, a_lat double, a_lon double, b_lat double, b_lon double")
    e = e.withColumn("length_m", F.lit(1.0)).withColumn("speed_kmh", F.lit(30)).withColumn("congestion", F.lit(0.8)).withColumn("layer", F.lit(0))
    rows = N.node_network(e).collect()
    by = {}
    for r in rows:
        by.setdefault(r.way_id, []).append((r.a, r.b))
    assert len(by[1]) == 2 and len(by[2]) == 2 and by[-1] == [(1, 5)]
    middle = {x for p in by[1] for x in p} & {x for p in by[2] for x in p}
    assert len(middle) == 1 and middle.pop() < 0
    assert sum(r.length_m for r in rows if r.way_id == 1) == pytest.approx(342, abs=2)


def joined(ways):
    """Chains of {way: node ids} by hand: ends are joined where exactly two ends of different ways meet."""
    at = {}
    for w, ids in ways.items():
        at.setdefault(ids[0], []).append((w, 0))
        at.setdefault(ids[-1], []).append((w, 1))
    link = {}
    for met in at.values():
        if len(met) == 2 and met[0][0] != met[1][0]:
            link[met[0]], link[met[1]] = met[1], met[0]

    def run(way, side):
        """Node ids from the way that is entered at ``side``, until no link or the start again."""
        out, now, seen = [], (way, side), []
        while now and now[0] not in seen:
            seen.append(now[0])
            ids = ways[now[0]] if now[1] == 0 else ways[now[0]][::-1]
            out += ids
            now = link.get((now[0], 1 - now[1]))
        return [n for k, n in enumerate(out) if not k or n != out[k - 1]], seen

    chains, done = [], set()
    for w in sorted(ways):
        for side in (0, 1):
            if w not in done and (w, side) not in link:
                ids, seen = run(w, side)
                done |= set(seen)
                chains.append((w, ids))
    for w in sorted(ways):
        if w not in done:
            ids, seen = run(w, 0)
            done |= set(seen)
            chains.append((w, ids))
    return sorted(chains)


def test_chains_against_walking_by_hand(spark):
    r = random.Random(5)
    groups = {}
    for g in range(12):
        ways = {}
        for w in range(r.randrange(1, 40)):
            ids = [r.randrange(30)]
            for _ in range(r.randrange(1, 4)):
                ids.append(r.choice([x for x in range(30) if x != ids[-1]]))
            ways[w] = ids
        groups[f"g{g}"] = ways
    order = list(range(200))
    r.shuffle(order)
    groups["long"] = {w: ([k, k + 1] if w % 2 else [k + 1, k]) for k, w in enumerate(order)}
    groups["ring"] = {w: ([k, (k + 1) % 50] if w % 3 else [(k + 1) % 50, k]) for k, w in enumerate(order[:50])}
    groups["pair"] = {4: [1, 2, 3], 9: [1, 7, 3]}
    groups["loop"] = {1: [5, 6, 7, 5]}
    df = spark.createDataFrame([(g, w, ids) for g, ways in groups.items() for w, ids in ways.items()], "cls string, way_id long, node_ids array<long>")
    got = {}
    for x in chained_arrays(df, ["cls"], ["node_ids"]).collect():
        got.setdefault(x.cls, []).append((x.chain, x.node_ids))
    assert {g: sorted(c) for g, c in got.items()} == {g: joined(w) for g, w in groups.items()}


def test_thin_stays_within_tolerance():
    rng = np.random.default_rng(1)
    xy = np.cumsum(rng.normal(size=(200, 2)), axis=0)
    kept = xy[S.thin(xy, 1.5)]
    for p in xy:
        a, b = kept[:-1], kept[1:]
        d = b - a
        t = np.clip(((p - a) * d).sum(1) / (d * d).sum(1), 0, 1)
        assert np.hypot(*(p - (a + t[:, None] * d)).T).min() <= 1.5 + 1e-9


def test_clip_stays_in_box(spark):
    def cut(kind, points):
        df = spark.createDataFrame([(kind, [[(float(a), float(b)) for a, b in points]])], "kind string, paths array<array<struct<lat:double,lon:double>>>")
        box = [F.lit(x) for x in (0.0, 1.0, 0.0, 1.0)]
        return [[tuple(p) for p in part] for part in df.select(S.clipped(F.col("kind"), F.col("paths"), *box).alias("c")).first().c]

    assert cut("line", [[-1, 0.5], [0.5, 0.5], [2, 0.5], [2, 0.8], [0.5, 0.8]]) == [[(0, 0.5), (0.5, 0.5), (1, 0.5)], [(1, 0.8), (0.5, 0.8)]]
    assert cut("line", [[2, 2], [3, 3]]) == cut("line", [[0.5, 0.5]]) == cut("line", []) == []
    ring = cut("area", [[-1, -1], [-1, 2], [2, 2], [2, -1], [-1, -1]])[0]
    assert ring[0] == ring[-1] and set(ring) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert cut("area", [[5, 5], [5, 6], [6, 6], [5, 5]]) == []
    rng = np.random.default_rng(2)
    for _ in range(5):
        line = rng.normal(0.5, 0.8, size=(30, 2))
        parts = cut("line", line)
        assert all(-1e-12 <= x <= 1 + 1e-12 for part in parts for p in part for x in p)
        fine = np.concatenate([a + np.linspace(0, 1, 2001)[:, None] * (b - a) for a, b in zip(line, line[1:])])
        inside = ((fine >= 0) & (fine <= 1)).all(axis=1).mean() * sum(np.hypot(*(b - a)) for a, b in zip(line, line[1:]))
        assert sum(np.hypot(*(np.array(q) - p)) for part in parts for p, q in zip(part, part[1:])) > 0 or inside == 0


def test_apply_changes_equals_a_fold(spark):
    r = random.Random(3)
    ops = [(i, r.randrange(3), r.choice(["create", "modify", "modify", "delete"]), r.choice([None, 1, 2, 3]), f"v{i}") for i in range(300)]
    base = spark.createDataFrame([(0, 1, "b"), (1, 2, "b")], "id long, version int, value string")
    ch = spark.createDataFrame(ops, "id long, elem_id long, action string, expected int, value string")
    got = {x.change_id: (x.accepted, x.reason, x.version) for x in H.apply_changes(base, ch)[1].collect()}
    version, want = {0: 1, 1: 2, 2: None}, {}
    for i, e, action, expected, _ in ops:
        v = version[e]
        reason = ("exists" if v is not None else None) if action == "create" else "missing" if v is None else "version" if expected not in (None, v) else None
        if reason is None:
            version[e] = 1 if action == "create" else None if action == "delete" else v + 1
        want[i] = (reason is None, reason, version[e])
    assert got == want


def test_building_spread_and_conserve(spark):
    m = 1 / 110574.0
    ring = [(39.9, 116.4), (39.9, 116.4 + 1100 / 85000), (39.9 + 100 * m, 116.4 + 1100 / 85000), (39.9 + 100 * m, 116.4), (39.9, 116.4)]
    geo = spark.createDataFrame([(1, ring)], "way_id long, coords array<struct<lat:double,lon:double>>")
    ways = spark.createDataFrame([(1, {"building": "apartments", "building:levels": "2"})], "id long, tags map<string,string>")
    lost, whole = (sum(r.pop for r in P.building_contribution(ways, geo, conserve=c).collect()) for c in (False, True))
    assert whole == pytest.approx(1100 * 100 * 2 * 0.03, rel=0.02) and lost < whole


def test_od_is_conserved(spark):
    st = spark.createDataFrame([(i, 39.8 + i * 0.01, 116.2, 500 + i, 100 * i) for i in range(6)], "id long, lat double, lon double, coverage long, daily_trips long")
    stops = spark.createDataFrame([(1, i, i) for i in range(4)] + [(2, 0, 3), (2, 1, 4), (2, 2, 5)], "line_id long, idx int, station_id long")
    walks = spark.createDataFrame([], "src long, dst long, meters long, ms long")
    plans = TR.itineraries(st, TR.ride_edges(TR.cumulative_stops(stops, st)), walks)
    assert plans.where("origin = 0 AND dest = 5").first().rides == 2
    od = TR.od_matrix(st, stops, plans, walks)
    got = {r.origin: r.s for r in od.groupBy("origin").agg(F.sum("people").alias("s")).collect()}
    assert got == {i: pytest.approx(100 * i) for i in range(1, 6)}


def replay(spark, tmp_path, rows, schema, build, name):
    src = str(tmp_path / name)
    df = spark.createDataFrame(rows, schema)
    for i, part in enumerate(np.array_split(np.arange(len(rows)), 3)):
        df.where(F.col("event_id").between(int(part[0]), int(part[-1]))).coalesce(1).write.parquet(f"{src}/b{i}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    return L.run_once(build(s), "append", name).collect()


def test_rate_limit_equals_replay(spark, tmp_path):
    r = random.Random(8)
    t, rows = 0, []
    for i in range(300):
        t += r.randrange(0, 2500)
        rows.append((r.randrange(3), r.choice(["op", "chat"]), i, t))
    want, kept = {}, {}
    for u, k, i, ms in rows:
        recent = [x for x in kept.get((u, k), []) if ms - x <= 10000]
        want[i] = len(recent) < 3
        kept[u, k] = recent + [ms] * want[i]
    got = replay(spark, tmp_path, rows, "user_id long, kind string, event_id long, ms long", lambda s: L.rate_limit(s, 3, 10), "rate")
    assert {x.event_id: x.accepted for x in got} == want and not all(want.values())


def test_locks_equal_replay(spark, tmp_path):
    rows = [("way", 1, 0, 1, "acquire", 1), ("way", 1, 1, 2, "acquire", 1000), ("way", 1, 2, 1, "ping", 100000), ("way", 1, 3, 2, "acquire", 150000),
            ("way", 1, 4, 1, "release", 160000), ("way", 1, 5, 2, "acquire", 161000), ("way", 1, 6, 1, "acquire", 400000), ("way", 1, 7, 2, "ping", 400001)]
    got = replay(spark, tmp_path, rows, "elem_type string, elem_id long, event_id long, user_id long, action string, ms long", L.locks, "locks")
    assert [x.result for x in sorted(got, key=lambda x: x.event_id)] == ["granted", "refused", "refreshed", "refused", "released", "granted", "granted", "ignored"]


def test_queues_lose_nobody_unseen(spark, tmp_path):
    r = random.Random(6)
    rows = [(1, 2, i, r.choice(["arrive", "arrive", "board"]), float(r.randrange(1, 9)), 1 + i * 120000) for i in range(90)]
    got = sorted(replay(spark, tmp_path, rows, "station_id long, line_id long, event_id long, kind string, people double, ms long", L.queues, "queue"), key=lambda x: (x.event_id is None, x.event_id))
    arrived = sum(x[4] for x in rows if x[3] == "arrive")
    assert arrived == pytest.approx(sum(x.boarded + x.lost for x in got) + got[-1].waiting) and sum(x.lost for x in got) > 0


def test_lines_run_along_every_road(spark):
    from streetloom import catalog
    from streetloom.functions import roads
    from streetloom.plans.demo import World
    from tests.conftest import SMALL
    w = World(spark, SMALL)
    road = {r.id for r in w.ways.where(roads.drivable(F.col("tags"))).collect()}
    stops = [r for r in w.way_nodes.collect() if r.way_id in road]
    want = {i: sum(r.way_id == i for r in stops) - 1 for i in road}
    got = {r.line_id: r for r in catalog.queries()["line_routes"](spark, SMALL).collect()}
    assert {i: r.segments for i, r in got.items()} == {i: n for i, n in want.items() if n > 0}
