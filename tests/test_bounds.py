"""What keeps work in bounds on large tables: each test would fail on the form that did not."""

import math
import os
import random

import numpy as np
from pyspark.sql import functions as F

from streetloom.functions import shapes as S2, tags as TG
from streetloom.model import OsmDataset
from streetloom.operators import datasets as DS, drawing as DR, network as N, selection as S, spatial as SP, transit as TR
from streetloom.plans.demo import FEATURE_TAGS, World
from streetloom.session import cut_lineage, drop_cut, drop_table, write_table
from streetloom.streaming import live as L
from tests.conftest import SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_users_share_groups_of_state(spark, tmp_path):
    rows = [(u, "op", u * 3 + k, 1000 * k + 1000) for u in range(3000) for k in range(3)]
    schema = "user_id long, kind string, event_id long, ms long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/e")
    s = L.rate_limit(spark.readStream.schema(schema).parquet(f"{tmp_path}/e"), 2, 10)
    q = s.writeStream.format("memory").queryName("many_users").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(op["numRowsUpdated"] for p in q.recentProgress for op in p["stateOperators"]) <= L.BUCKETS
    assert all(r.accepted == (r.event_id % 3 < 2) for r in spark.table("many_users").collect())


def test_users_without_an_id_keep_their_own_state(spark, tmp_path):
    rows = [(None if i % 2 else 7, "op", i, 1000 * i + 1000) for i in range(8)]
    schema = "user_id long, kind string, event_id long, ms long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/e")
    got = L.run_once(L.rate_limit(spark.readStream.schema(schema).parquet(f"{tmp_path}/e"), 2, 60), "append", "nulls").collect()
    assert {r.event_id: (r.user_id, r.accepted) for r in got} == {i: (None if i % 2 else 7, i < 4) for i in range(8)}


def test_vehicles_of_a_cell_are_counted_exactly(spark, tmp_path):
    rows = [(1000 + i % 50, i % 20011, 1, 0.005, 0.005) for i in range(40000)] + [(90000, 1, 1, 0.005, 0.005)]
    e = spark.createDataFrame(rows, "sec long, vehicle_id long, line_id long, lat double, lon double").select(F.timestamp_seconds("sec").alias("ts"), "vehicle_id", "line_id", "lat", "lon")
    e.write.parquet(f"{tmp_path}/v")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/v")
    got = L.run_once(L.vehicle_cells(s, "1 hour", "1 hour"), "append", "exact").collect()
    assert [(r.reports, r.vehicles) for r in got] == [(40000, 20011)]


def test_cropped_members_are_not_shuffled_after_they_meet_views(spark):
    w = World(spark, SMALL)
    plan = plan_of(DS.crop_members(w.dataset, w.views, min_members=4))
    first = next(line for line in plan.split("\n") if "Join" in line)
    assert "relation_id" in first and "view_id" not in first, first


def shuffle_files(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.startswith("shuffle_") for d in folder for _, _, files in os.walk(d.toString()) for f in files)


def test_a_cut_leaves_no_shuffle_behind(spark):
    before = shuffle_files(spark)
    cut = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert shuffle_files(spark) <= before
    assert sorted(r.n for r in cut.collect()) == [142] * 1 + [143] * 6
    path = cut._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(path)
    drop_cut(cut)
    assert not os.path.exists(path)


def test_pairs_of_relations_and_views_are_not_written(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(DS, "cut_lineage", lambda df: cuts.append(df.columns) or cut_lineage(df))
    w = World(spark, SMALL)
    DS.crop_members(w.dataset, w.views, min_members=4)
    assert cuts and not any("view_id" in c for c in cuts)


def test_members_that_views_keep(spark):
    r = random.Random(8)
    nodes = [(i, r.random() * 3, r.random() * 3, 1, None) for i in range(90)]
    way_nodes = [(w, s, r.randrange(100)) for w in range(40) for s in range(2)] + [(90, 0, 500)]  # some nodes, and way 90 as a whole, are not there
    tags = [None, {"type": "multipolygon"}, {"type": "route"}, {"type": "boundary", "boundary": "x", "landuse": "y"}]
    relations = [(k, 1, 6, tags[k % 4]) for k in range(24)]
    kinds = [("way", lambda: r.choice([*range(40), 90])), ("node", lambda: r.randrange(100)), ("relation", lambda: r.randrange(24))]
    members = []
    for k in range(24):
        for q in range(6):
            kind, pick = kinds[r.choice([0, 0, 0, 1, 2]) if k % 5 else 0]
            members.append((k, q, kind, pick(), r.choice(["inner", "outer", "", None])))
    views = [(v, y, y + 0.5, x, x + 0.4) for v, (y, x) in enumerate((r.random() * 3, r.random() * 3) for _ in range(9))]
    ds = OsmDataset(spark.createDataFrame(nodes, "id long, lat double, lon double, version int, tags map<string,string>"), None, spark.createDataFrame(way_nodes, "way_id long, seq int, node_id long"),
                    spark.createDataFrame(relations, "id long, version int, member_count int, tags map<string,string>"),
                    spark.createDataFrame(members, "relation_id long, seq long, member_type string, member_ref long, role string"))
    v = spark.createDataFrame(views, "view_id long, min_lat double, max_lat double, min_lon double, max_lon double")
    at = {i: (y, y, x, x) for i, y, x, _, _ in nodes}

    def around(boxes):
        return (min(b[0] for b in boxes), max(b[1] for b in boxes), min(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else None

    def touch(a, b):
        return a[1] >= b[0] and a[0] <= b[1] and a[3] >= b[2] and a[2] <= b[3]
    ways = {w: around([at[n] for x, _, n in way_nodes if x == w and n in at]) for w in [*range(40), 90]}
    place = lambda kind, ref: ways[ref] if kind == "way" else at.get(ref) if kind == "node" else None
    want = {}
    for k, _, count, t in relations:
        mine = [m for m in members if m[0] == k]
        box = around([b for b in (place(m[2], m[3]) for m in mine) if b])
        for i, y1, y2, x1, x2 in views:
            if not box or not touch(box, (y1, y2, x1, x2)):
                continue
            py, px = (y2 - y1) * 0.25, (x2 - x1) * 0.25
            c = (y1 - py, y2 + py, x1 - px, x2 + px)
            crop = k % 4 not in (1, 3) and count > 4 and not (box[0] >= c[0] and box[1] <= c[1] and box[2] >= c[2] and box[3] <= c[3])
            met = {}
            for _, q, kind, ref, role in mine:
                b = place(kind, ref)
                met[q] = not crop or kind == "relation" or (touch(b, c) if b else kind == "way")
            any_inner = any(met[m[1]] and m[4] == "inner" for m in mine)
            want.update({(i, k, m[1]): (crop, met[m[1]] or (m[4] == "inner" and any_inner)) for m in mine})
    got = DS.crop_members(ds, v, min_members=4).collect()
    assert len(got) == len(want) and {(x.view_id, x.relation_id, x.seq): (x.crop, x.kept or False) for x in got} == want
    assert any(c for c, _ in want.values()) and any(not kept for _, kept in want.values())


def test_visibility_is_taken_where_it_is_known(spark):
    row = spark.sql("SELECT 1L AS view_id, 14 AS zoom, 1L AS id, map('highway', 'primary') AS tags, false AS closed, 0D AS min_lat, 1D AS max_lat, 0D AS min_lon, 1D AS max_lon, _least FROM VALUES (14), (15) AS v(_least)")
    assert {r._least: r.status for r in S.stage(row, 4).collect()} == {14: "returned", 15: "invisible"}


def test_views_meet_what_tags_say_and_not_the_tags(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(S, "cut_lineage", lambda df: cuts.append(df.columns) or cut_lineage(df))
    w = World(spark, SMALL)
    S.viewport(w.dataset, w.views)
    assert any("_traits" in c for c in cuts) and not any("length_m" in c or {"tags", "min_lat"} <= set(c) for c in cuts)
    # Told from traits, a way has the status that its tags give it.
    rows = [(z, t, z % 2 == 0, 0.00001 * 3 ** (z % 7)) for t in [None, *FEATURE_TAGS] for z in range(4, 20)]
    df = spark.createDataFrame(rows, "zoom int, tags map<string,string>, closed boolean, max_lat double").withColumns({"min_lat": F.lit(0.0), "min_lon": F.lit(0.0), "max_lon": F.lit(0.001)})
    said = df.withColumn("_least", TG.min_zoom_line(F.col("tags"))).withColumn("_traits", F.struct(*[c.alias(k) for k, c in TG.lod_traits(F.col("tags"), 4).items()])).drop("tags")
    columns = ["zoom", "max_lat", "status"]
    assert sorted(S.stage(said, 4).select(columns).collect()) == sorted(S.stage(df, 4).select(columns).collect())


def test_ledger_works_no_tags_out(spark):
    w = World(spark, SMALL)
    plan = plan_of(S.viewport(w.dataset, w.views)["ledger"].where("kind = 'way'"))
    assert "highway" not in plan


def test_punctuality_does_not_sort_the_stops(spark):
    rows = [(k % 2, k % 5, (k * 37) % 200 - 80, k % 3 == 0) for k in range(100)]
    d = spark.createDataFrame(rows, "line_id long, vehicle_id long, delay long, recovered boolean")
    out = TR.punctuality(d)
    deepest = [line for line in plan_of(out).split("\n") if "Aggregate" in line][-1]
    assert "HashAggregate" in deepest, deepest
    for r in out.collect():
        mine = [x for x in rows if r.line_id in (None, x[0])]
        most = max(x[2] for x in mine)
        assert (r.tracked, r.max_delay, r.worst_vehicle) == (len(mine), most, min(x[1] for x in mine if x[2] == most))
        assert r.avg_delay == math.floor(sum(x[2] for x in mine) / len(mine) + 0.5)


def test_own_vehicles_are_the_nearest_without_all_pairs(spark):
    r = random.Random(3)
    fleet = [(i, i % 3, 39.7 + r.random() * 0.1, 116.1 + r.random() * 0.1) for i in range(6000)] + [(7000 + i, 1, None, 116.0) for i in range(3)]
    views = [(v, v % 3, y, y + 0.01, x, x + 0.02) for v, (y, x) in enumerate([(39.74, 116.13), (39.69, 116.2), (-40.0, -63.0), (10.0, 179.9), (39.75, 116.15), (60.0, 10.0)])]
    f = spark.createDataFrame(fleet, "id long, owner long, lat double, lon double")
    v = spark.createDataFrame(views, "view_id long, owner long, min_lat double, max_lat double, min_lon double, max_lon double")
    box = v.select("view_id", F.col("owner").alias("viewer"), *[F.col(c).alias(f"box_{c}") for c in ("min_lat", "max_lat", "min_lon", "max_lon")])
    assert TR.own_vehicles(f, box, 20, 16).count() < 6 * 2000 / 2

    def meters(y, x, b, a):
        h = math.sin(math.radians(b - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(b)) * math.sin(math.radians(a - x) / 2) ** 2
        return 2 * 6378137.0 * math.asin(min(1.0, math.sqrt(h)))
    got = {}
    for x in TR.pick_visible(f, v, 20).collect():
        got.setdefault(x.view_id, []).append((x.rank, x.id))
    for view, owner, y1, y2, x1, x2 in views:
        lost = [i for i, o, y, x in fleet if o == owner and y is None]
        near = sorted((round(meters(y, x, (y1 + y2) / 2, (x1 + x2) / 2), 3), i) for i, o, y, x in fleet if o == owner and y is not None)
        assert [i for _, i in sorted(got[view])] == (lost + [i for _, i in near])[:20]


def test_rounds_of_a_network_shrink_and_go(spark, monkeypatch):
    r = random.Random(5)
    side = 60
    g = [(x * side + y, x * side + y + 1) for x in range(side) for y in range(side - 1)] + [(x * side + y, x * side + side + y) for x in range(side - 1) for y in range(side)]
    g = [(a - 1000, b - 1000) if r.random() < 0.5 else (b - 1000, a - 1000) for a, b in g if r.random() < 0.5] + [(9000, 9000), (-1000, -1000)] + [(2 ** 62 + 7, k) for k in (-(2 ** 61), 10 ** 15)]
    parent = {n: n for e in g for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in g:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    written, gone = [], []
    monkeypatch.setattr(N, "write_table", lambda df: written.append(write_table(df)) or written[-1])
    monkeypatch.setattr(N, "drop_table", lambda spark, path: gone.append(path) or drop_table(spark, path))
    got = N.network_components(spark.createDataFrame(g, "a long, b long"))
    assert {x.node_id: x.component for x in got.collect()} == {n: root(n) for n in parent} and got.count() == len(parent)
    kept = [df.count() for df, path in written if path not in gone]
    assert len(gone) >= 3 and not any(os.path.exists(p.removeprefix("file:")) for p in gone)
    assert sum(kept) < 5 * len(parent)
    assert N.network_components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == [(3, 3)]


def test_searches_stop_at_the_limit_of_their_origin(spark):
    edges = spark.createDataFrame([(i, i + 1, 100.0, 45) for i in range(40)] + [(0, 3, 200.0, 45)], "a long, b long, length_m double, speed_kmh int")
    one = 100 * 1.6
    origins = spark.createDataFrame([(0, 0, one * 2.5), (20, 20, one)], "origin long, node_id long, most double")
    got = {(r.origin, r.node_id): r.cost for r in N.shortest_costs(edges, origins, 5000.0).collect()}
    assert set(got) == {(0, 0), (0, 1), (0, 2), (0, 3), (20, 19), (20, 20), (20, 21)}
    assert math.isclose(got[0, 3], 2 * one)
    # Stops that no edge joins are searched as far as before; a detour that is cheaper than the edge is found.
    stops = spark.createDataFrame([(1, 0, 0), (1, 1, 3), (2, 0, 10), (2, 1, 15), (3, 0, 5), (3, 1, 39)], "line_id long, idx int, node_id long")
    segments, lines = N.route_lines(stops, edges, one * 10)
    assert {r.line_id: (r.cost and round(r.cost)) for r in segments.collect()} == {1: 320, 2: 800, 3: None}
    assert {r.line_id: r.first_broken for r in lines.collect()} == {1: None, 2: None, 3: 0}


def test_stops_that_an_edge_settles_are_not_searched(spark, monkeypatch):
    r = random.Random(11)
    g = [(r.randrange(30), r.randrange(30), float(r.randrange(50, 400)), r.choice([13, 24, 39, 80])) for _ in range(90)]
    g = [(a, b, m, v) for a, b, m, v in g if a != b]
    cost = lambda m, v: m * (1.0 + 0.6 * 45.0 / max(15, v))
    hops, top = {}, 500.0
    for a, b, m, v in g:
        for x, y in ((a, b), (b, a)):
            hops.setdefault(x, []).append((y, cost(m, v), m))
    pairs = [(a, b) for a, b, _, _ in g] + [(r.randrange(30), r.randrange(30)) for _ in range(20)] + [(4, 4), (77, 77), (77, 3)]

    def search(a):
        best, todo = {}, [(0.0, 0, a, 0.0)]
        while todo:
            todo.sort()
            c, n, x, m = todo.pop(0)
            if x not in best:
                best[x] = (c, m)
                todo += [(c + d, n + 1, y, m + q) for y, d, q in hops.get(x, []) if c + d <= top]
        return best
    starts = []
    real = N.shortest_costs
    monkeypatch.setattr(N, "shortest_costs", lambda edges, origins, most: starts.append({x.origin for x in origins.collect()}) or real(edges, origins, most))
    stops = spark.createDataFrame([(k, i, n) for k, p in enumerate(pairs) for i, n in enumerate(p)], "line_id long, idx int, node_id long")
    segments, _ = N.route_lines(stops, spark.createDataFrame(g, "a long, b long, length_m double, speed_kmh int"), top)
    got = {x.line_id: x for x in segments.collect()}
    assert len(got) == len(pairs)
    for k, (a, b) in enumerate(pairs):
        want = search(a).get(b)
        assert (got[k].cost is None) == (want is None) and (want is None or (math.isclose(got[k].cost, want[0], abs_tol=1e-9) and math.isclose(got[k].length_m, want[1], abs_tol=1e-9))), (a, b)
    cheapest = {x: min(c for _, c, _ in e) for x, e in hops.items()}
    direct = {(x, y): min(c for z, c, _ in e if z == y) for x, e in hops.items() for y, _, _ in e}
    assert starts == [{a for a, b in pairs if a != b and not (direct.get((a, b), 1e9) <= min(top, cheapest.get(a, 0) + cheapest.get(b, 0)))}]
    assert len(starts[0]) < len({a for a, _ in pairs})


def test_sides_exploded_to_cells_do_not_go_through_the_driver(spark):
    st = spark.createDataFrame([(i, 39.7 + i * 0.001, 116.1, 600) for i in range(9)], "id long, lat double, lon double, catchment_m int")
    cells = spark.createDataFrame([(x, y, 1.0) for x in range(3) for y in range(3)], "cell_x long, cell_y long, pop double")
    for df in (SP.radius_join(st, cells, "catchment_m", 250.0, 110574.0, 85395.6), SP.neighbour_pairs(st, 4000.0, ["catchment_m"]), SP.snap_to_node(st, st.select("id", "lat", "lon"), 400)):
        assert "SortMergeJoin" in plan_of(df) and "BroadcastHashJoin" not in plan_of(df)


def test_pairs_of_stations_are_worked_out_once(spark):
    rows = [(o, d, float((o * 7 + d * 5) % 11) / 100) for o in range(4) for d in range(20) if o != d]
    pairs = spark.createDataFrame(rows, "origin long, dest long, people double").withColumn("kept", F.col("people") >= 0.02)
    out = TR.od_station(pairs.withColumn("people", F.col("people") + F.rand() * 0), spark.createDataFrame([(o, 5) for o in range(6)], "id long, daily_trips int"), top=3)
    assert plan_of(out).count("rand(") == 1
    for r in out.collect():
        mine = sorted((-p, d) for o, d, p in rows if o == r.origin and p >= 0.02)
        assert (r.destinations, r.served) == (len(mine), math.floor(-sum(p for p, _ in mine) + 0.5))
        assert [(x.rank, x.dest) for x in r.top or []] == [(k + 1, d) for k, (_, d) in enumerate(mine[:3])]


def test_journeys_are_searched_in_the_part_of_their_origin(spark):
    st = spark.createDataFrame([(i, 39.8 + i % 7 * 0.001, 116.2 + i % 11 * 0.001) for i in range(150)], "id long, lat double, lon double")
    stops = spark.createDataFrame([(i // 6 - k, i % 6 + 6 * k, i) for i in range(150) for k in (0, 1) if k == 0 or (i % 6 < 4 and i >= 6)], "line_id long, idx int, station_id long")
    rides, walks = TR.ride_edges(TR.cumulative_stops(stops, st)), spark.createDataFrame([(0, 149, 80, 90000), (149, 0, 80, 90000)], "src long, dst long, meters long, ms long")
    # No label is shuffled: nothing stands above the search but columns and filters.
    plan = plan_of(TR.itineraries(st, rides, walks))
    above = plan[:plan.index("FlatMapGroupsInPandas")]
    assert "Exchange" not in above and "Join" not in above, above
    parts = TR.journey_parts(st, rides, walks)
    n = parts.where("own").groupBy("part").agg(F.countDistinct("src").alias("n")).toPandas().n
    assert n.max() <= TR.PART_ORIGINS and n.sum() == 150
    # The same labels whatever parts there are, alone too.
    legs = TR.itinerary_legs(st, rides, walks)
    whole = {(r.origin, r.dest): (r.legs, r.ms) for r in legs.groupBy("origin", "dest").agg(F.count("*").alias("legs"), F.sum("ms").alias("ms")).collect()}
    alone = spark.createDataFrame([(149,)], "id long")
    one = {(r.origin, r.dest): (r.rides + r.walks, r.ms) for r in TR.itineraries(st, rides, walks, alone).collect()}
    assert one and one == {k: v for k, v in whole.items() if k[0] == 149}


def test_crossings_are_worked_out_for_overlapping_segments_alone(spark):
    schema = "way_id long, seq int, a long, a_lat double, a_lon double, b long, b_lat double, b_lon double, layer int"
    segs = spark.createDataFrame([(1, 1, 1, 39.8, 116.2, 2, 39.801, 116.201, 0), (2, 1, 3, 39.801, 116.2, 4, 39.8, 116.201, 0), (3, 1, 5, 39.8003, 116.2, 6, 39.8004, 116.2, 0)], schema)
    x = N.segment_crossings(segs)
    assert [(r.i_way_id, r.j_way_id, round(r.t, 6), round(r.u, 6)) for r in x.collect()] == [(1, 2, 0.5, 0.5)]
    met = [line for line in plan_of(x).split("\n") if "Join" in line]
    assert met and all(" / " not in line for line in met), met


def test_many_lines_are_thinned_together():
    r = np.random.default_rng(5)
    lines = [np.round(r.normal(40, 0.002, (k, 2)), 4) for k in r.integers(0, 25, 60)]
    lines = [np.concatenate([p, p[:1]]) if i % 3 == 0 else p for i, p in enumerate(lines)]
    size, tol, lat0 = np.array([len(p) for p in lines]), np.array([30.0, 150.0, 0.0] * 20), np.linspace(30, 50, 60)
    for ring in (False, True):
        got, left = S2.generalise_all(np.concatenate(lines), size, tol, lat0, 5, ring)
        want = [S2.generalise(p, t, y, 5, ring) for p, t, y in zip(lines, tol, lat0)]
        want = [np.zeros((0, 2)) if w is None or len(w) < 2 else w for w in want]
        assert [len(w) for w in want] == list(left) and (np.concatenate(want) == got).all()
    got, left = S2.simplify_all(np.concatenate(lines), size, tol)
    want = [p[S2.thin(p * [110574.0, 111320.0 * np.cos(np.radians(p[:, 0].mean()))], t)] if len(p) else p for p, t in zip(lines, tol)]
    assert [len(w) for w in want] == list(left) and (np.concatenate(want) == got).all()


def test_tags_of_a_network_are_read_once_per_way(spark):
    ways = spark.createDataFrame([(i, t) for i, t in enumerate(['{"highway":"primary"}', '{"railway":"rail","maxspeed":"80"}', '{"highway":"steps"}', '{"railway":"rail","service":"yard"}', None, "x"])], "id long, tags string")
    ways = ways.withColumn("tags", TG.parse_tags(F.col("tags")))
    for mode, want in (("road", [0]), ("rail", [1])):
        w = N.network_ways(ways, mode)
        assert "from_json" not in " ".join(line for line in plan_of(w).split("\n") if "Filter" in line)
        assert [r.way_id for r in w.collect()] == want


def test_distances_to_segments_are_worked_out_beside_them_alone(spark):
    r = random.Random(11)
    segs = [(i, 1, 2 * i, y, x, 2 * i + 1, y + r.uniform(-1, 1) * s, x + r.uniform(-1, 1) * s) for i, (y, x, s) in enumerate((r.uniform(60, 60.02), r.uniform(20, 20.04), r.choice([0.0, 0.001, 0.02])) for _ in range(120))]
    points = [(i, r.uniform(60, 60.02), r.uniform(20, 20.04)) for i in range(200)]
    s = spark.createDataFrame(segs, "way_id long, seq int, a long, a_lat double, a_lon double, b long, b_lat double, b_lon double")
    near = SP.near_segments(spark.createDataFrame(points, "id long, lat double, lon double"), s, 80)
    met = [line for line in plan_of(near).split("\n") if "Join" in line]
    assert met and all("SQRT" not in line and " / " not in line for line in met), met
    got = [(x.id, x.way_id) for x in near.collect()]
    want = set()
    for i, y, x in points:
        k = math.radians(1) * 6378137.0
        for w, _, _, ay, ax, _, by, bx in segs:
            x1, y1, x2, y2 = (ax - x) * k * math.cos(math.radians(y)), (ay - y) * k, (bx - x) * k * math.cos(math.radians(y)), (by - y) * k
            d2 = (x2 - x1) ** 2 + (y2 - y1) ** 2
            t = max(0.0, min(1.0, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / d2)) if d2 else 0.0
            if math.hypot(x1 + t * (x2 - x1), y1 + t * (y2 - y1)) <= 80:
                want.add((i, w))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_areas_meet_the_points_in_their_extent_alone(spark):
    rings = [(k, 0, [(40 + k * 1e-4, 100.0), (40 + k * 1e-4, 100.00005), (40 + (k + 0.5) * 1e-4, 100.00005), (40 + (k + 0.5) * 1e-4, 100.0)]) for k in range(150)]
    points = [(k, 40 + (k + 0.25) * 1e-4, 100.00002) for k in range(150)] + [(1000 + k, 40 + (k + 0.75) * 1e-4, 100.00002) for k in range(150)]
    df = spark.createDataFrame(rings, "area_id long, ring_no int, coords array<struct<lat:double,lon:double>>")
    got = SP.points_in_areas(spark.createDataFrame(points, "id long, lat double, lon double"), df)
    met = [line for line in plan_of(got).split("\n") if "Join [_y" in line]
    assert any("_s#" in line and "_e#" in line for line in met), met
    assert sorted(map(tuple, got.collect())) == [(k, k) for k in range(150)]


def test_coverage_reads_tags_once_per_way(spark, monkeypatch):
    written = []
    monkeypatch.setattr(DR, "cut_lineage", lambda df: written.append(df) or cut_lineage(df))
    w = World(spark, SMALL)
    out = DR.coverage(w.dataset, [10, 12, 14])
    ways = w.ways.count()
    assert [df.count() for df in written] == [ways] and out.count() == 3 * ways
    assert "[highway]" not in plan_of(out)
