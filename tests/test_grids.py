"""Spatial joins, covers, journeys and tiles against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from streetloom.functions.geo import M_PER_DEG_LAT
from streetloom.model import NODES, RELATION_MEMBERS, RELATIONS, WAY_NODES, WAYS, OsmDataset
from streetloom.operators import drawing as DR
from streetloom.operators import spatial as SP
from streetloom.operators import transit as TR
from streetloom.streaming import live as L

BOX = "min_lat double, max_lat double, min_lon double, max_lon double"


def random_boxes(r, n):
    out = []
    for i in range(n):
        size = 10 ** r.uniform(-4, 2.2)
        lat, lon = r.uniform(-80, 80), r.uniform(-170, 170)
        if i % 3 == 0:
            lat, lon = r.choice([39.9, 40.0, 40.1]), r.choice([116.3, 116.4])  # on cell borders
        out.append((i, lat, min(90.0, lat + size * r.random()), lon, min(180.0, lon + size * r.random())))
    return [*out, (n, -90.0, 90.0, -180.0, 180.0), (n + 1, 40.0, 40.0, 116.4, 116.4)]


def test_box_join_against_all_pairs(spark):
    r = random.Random(12)
    a, b = random_boxes(r, 150), random_boxes(r, 60)
    features = spark.createDataFrame([*a, (9999, None, None, None, None)], f"id long, {BOX}")
    got = SP.box_join(features, spark.createDataFrame(b, f"view_id long, {BOX}")).select("id", "view_id").collect()
    want = {(x[0], y[0]) for x in a for y in b if x[2] >= y[1] and x[1] <= y[2] and x[4] >= y[3] and x[3] <= y[4]}
    assert sorted(map(tuple, got)) == sorted(want)
    assert SP.box_join(features, spark.createDataFrame([], f"view_id long, {BOX}")).count() == 0


SEGS = "way_id long, seq int, a long, a_lat double, a_lon double, b long, b_lat double, b_lon double"


def test_a_diagonal_is_filed_in_the_cells_it_runs_through(spark):
    step = 150 / M_PER_DEG_LAT
    diagonal = (1, 1, 1, 40.0, 116.0, 2, 40.0 + 35000 / M_PER_DEG_LAT, 116.0 + 35000 / (111320 * math.cos(math.radians(40.16))))
    cells = SP.segment_cells(spark.createDataFrame([diagonal], SEGS), 150.0, 1.0).select("cell_row", "cell_col").collect()
    assert 450 <= len(cells) <= 760 and len(set(cells)) == len(cells)
    r = random.Random(3)
    rows = []
    for k in range(60):
        y, x = r.uniform(-70, 70), r.uniform(-170, 170)
        flat, steep = r.choice([(0, 1), (1, 0), (1, 1)])
        rows.append((k, 1, 1, y, x, 2, y + steep * r.uniform(-0.02, 0.02), x + flat * r.uniform(-0.02, 0.02)))
    filed: dict = {}
    for c in SP.segment_cells(spark.createDataFrame(rows, SEGS), 150.0, 1.0).collect():
        filed.setdefault(c.way_id, set()).add((c.cell_row, c.cell_col))
    for k, _, _, y1, x1, _, y2, x2 in rows:
        for t in (i / 500 for i in range(501)):
            y, x = y1 + t * (y2 - y1), x1 + t * (x2 - x1)
            row = math.floor(y / step)
            mid = min(89.0, abs((row + 0.5) * step))
            assert (row, math.floor(x / (150.0 / (111320.0 * math.cos(math.radians(mid)))))) in filed[k]


def inside(y, x, rings):
    """The eastward ray, edge by edge."""
    n = 0
    for ring in rings:
        for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]]):
            if y1 != y2 and (y1 > y) != (y2 > y) and x < (x1 - x2) * (y - y2) / (y1 - y2) + x2:
                n += 1
    return n % 2 == 1


def test_points_in_areas_against_every_edge(spark):
    r = random.Random(5)
    areas = {}
    for k in range(12):
        y, x, size = r.uniform(10, 11), r.uniform(20, 21), r.choice([0.003, 0.05, 0.6])
        corners = sorted(r.uniform(0, 2 * math.pi) for _ in range(r.randrange(3, 40)))
        far = [size * r.uniform(0.3, 1) for _ in corners]
        outer = [(y + f * math.sin(a), x + f * math.cos(a)) for f, a in zip(far, corners, strict=True)]
        hole = [(y + 0.2 * f * math.sin(a), x + 0.2 * f * math.cos(a)) for f, a in zip(far, corners, strict=True)]
        areas[k] = [outer, hole] if k % 2 else [outer]
    # Corners on round places, a ring that comes back to its start, edges along the axes.
    areas[90] = [[(10.0, 20.0), (10.0, 20.4), (10.4, 20.4), (10.4, 20.0), (10.0, 20.0)], [(10.1, 20.1), (10.1, 20.2), (10.2, 20.2), (10.2, 20.1)]]
    rings = [(k, n, ring) for k, rs in areas.items() for n, ring in enumerate(rs)]
    df = spark.createDataFrame(rings, "area_id long, ring_no int, coords array<struct<lat:double,lon:double>>")
    points = [(i, r.uniform(9.5, 11.5), r.uniform(19.5, 21.5)) for i in range(1500)]
    points += [(2000 + i, y, x) for i, (y, x) in enumerate(itertools.product((10.0, 10.02, 10.1, 10.15, 10.2, 10.4), (20.0, 20.05, 20.1, 20.2, 20.4)))]
    got = SP.points_in_areas(spark.createDataFrame(points, "id long, lat double, lon double"), df).collect()
    want = {(i, k) for i, y, x in points for k, rs in areas.items() if inside(y, x, rs)}
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_large_area_has_rows_for_its_border_alone(spark):
    corners = [(40 + 5 * math.sin(a * math.pi / 30), 100 + 5 * math.cos(a * math.pi / 30)) for a in range(60)]
    df = spark.createDataFrame([(1, 0, corners)], "area_id long, ring_no int, coords array<struct<lat:double,lon:double>>")
    border, inner = SP.area_cover(df, 0.02)
    rows = 2 * 5 / 0.02
    assert border.count() < 8 * rows and inner.count() < 24 * rows  # some 196,000 whole cells lie inside


@pytest.mark.parametrize("first,last", [(0, 0), (1, 1), (3, 17), (8, 15), (5, 1000), (1023, 1024)])
def test_blocks_of_a_run(spark, first, last):
    row = spark.range(1).select(SP.run_blocks(F.lit(first).cast("long"), F.lit(last).cast("long")).alias("b")).first()
    cells = [x for b in row.b for x in range(b.block << b.level, b.block + 1 << b.level)]
    assert sorted(cells) == list(range(first, last + 1)) and len(row.b) <= 2 * max(1, (last - first + 1).bit_length())


# ---- journeys -------------------------------------------------------------------------------------------------------

def plain_journeys(stations, rides, walks):
    """Every label by legs, nothing left out: (origin, dest) -> (ms, rides, walks)."""
    served = {s for _, s, _, _, _ in rides}
    best = {}
    for o in stations:
        layer = {(o, 0, 0): 0}
        for legs in range(1, 7):
            step = {}
            for (s, r, w), ms in layer.items():
                hops = [(d, r + 1, w, t) for _, a, d, _, t in rides if a == s and r < 4]
                if not (legs == 1 and o in served):
                    hops += [(d, r, w + 1, t) for a, d, _, t in walks if a == s and w < 2]
                for d, r2, w2, t in hops:
                    if ms + t <= 8 * 3600 * 1000 and ms + t < step.get((d, r2, w2), 1e18):
                        step[d, r2, w2] = ms + t
            layer = step
            for (s, r, w), ms in layer.items():
                if s != o:
                    best[o, s] = min(best.get((o, s), (1e18,)), (ms, r, w))
    return {k: v for k, v in best.items() if v[1] > 0}


def test_journeys_and_their_legs(spark):
    r = random.Random(9)
    stations = list(range(14))
    rides = [(line, a, b, 100, r.randrange(1, 9) * 60000) for line in range(5) for a, b in itertools.permutations(r.sample(range(12), 4), 2)]
    walks = [(a, b, 50, r.randrange(1, 5) * 50000) for a, b in [(0, 12), (12, 0), (12, 13), (13, 12), (3, 13), (13, 3), (5, 6), (6, 5)]]
    st = spark.createDataFrame([(s,) for s in stations], "id long")
    rd = spark.createDataFrame(rides, "line_id long, src long, dst long, meters long, ms long")
    wk = spark.createDataFrame(walks, "src long, dst long, meters long, ms long")
    labels = TR.journey_labels(st, rd, wk)
    best = TR.best_journeys(labels)
    got = {(x.origin, x.dest): x for x in best.collect()}
    want = plain_journeys(stations, rides, walks)
    assert {k: (x.ms, x.rides, x.walks) for k, x in got.items()} == want
    legs: dict = {}
    for x in TR.journey_legs(labels, best).orderBy("leg").collect():
        legs.setdefault((x.origin, x.dest), []).append(x)
    known = {("ride", *x[:3], x[4]) for x in rides} | {("walk", None, a, b, t) for a, b, _, t in walks}
    for (o, d), x in got.items():
        way = legs[o, d]
        assert [y.leg for y in way] == list(range(1, x.rides + x.walks + 1)) and sum(y.ms for y in way) == x.ms
        assert way[0].src == o and way[-1].dst == d and all(a.dst == b.src for a, b in itertools.pairwise(way))
        assert all((y.kind, y.line_id, y.src, y.dst, y.ms) in known for y in way)
        ride = next(y for y in way if y.kind == "ride")
        assert (x.first_line, x.first_stop, x.walk_first) == (ride.line_id, ride.src, int(way[0].kind == "walk"))
    some = spark.createDataFrame([(3,), (12,)], "id long")
    assert {(x.origin, x.dest, x.ms) for x in TR.itineraries(st, rd, wk, some).collect()} == {(o, d, v[0]) for (o, d), v in want.items() if o in (3, 12)}


# ---- tiles ----------------------------------------------------------------------------------------------------------

def small_map(spark):
    r = random.Random(6)
    nodes, refs, ways = [], [], []
    for k in range(12):
        nodes += [(100 * k + i, 40.0 + 0.02 * k + 0.0001 * r.randrange(5), 116.0 + 0.02 * i) for i in range(12)]
        for i in range(0, 11, 2):
            way = 1000 * k + i
            refs += [(way, s, 100 * k + i + s) for s in range(3 if i < 9 else 2)]
            kind = ["primary", "tertiary", "residential"][k % 3]
            ways.append((way, 1, {"highway": kind, "name": "x"} if k % 4 else {"railway": "rail", "usage": "main"}, None, None, None, 3, False))
    node = spark.createDataFrame([(i, a, o, 1, None, None, None, None) for i, a, o in nodes], NODES)
    return OsmDataset(node, spark.createDataFrame(ways, WAYS), spark.createDataFrame(refs, WAY_NODES), spark.createDataFrame([], RELATIONS), spark.createDataFrame([], RELATION_MEMBERS))


def test_rebake_of_dirty_tiles_equals_a_full_bake(spark, tmp_path):
    ds = small_map(spark)
    grid = DR.TileGrid.over(ds.nodes, 3)
    zooms = [10, 12, 13, 14]
    full = DR.bake_tiles(ds, grid, zooms)
    rows = lambda df: sorted((r.zoom, r.tile, r.id, r.kind, r.cls, r.ways, str(r.geom)) for r in df.collect())
    whole = rows(full)
    assert len(whole) > 50
    dirty = spark.createDataFrame([(13, 2), (14, 5), (10, 1)], "zoom int, tile int")
    path, index = str(tmp_path / "tiles"), str(tmp_path / "index")
    DR.write_tiles(full, path)
    DR.write_tile_index(DR.tile_index(ds, grid, zooms), index)
    # A way leaves tile 5; only the dirty tiles change.
    gone = ds.way_nodes.where("way_id <> 4004")
    DR.rebake(ds.with_(way_nodes=gone), dirty, grid, path, zooms, index_path=index)
    after = rows(spark.read.parquet(path))
    fresh = rows(DR.bake_tiles(ds.with_(way_nodes=gone), grid, zooms))
    named = {(13, 2), (14, 5), (10, 1)}
    assert [x for x in after if x[:2] in named] == [x for x in fresh if x[:2] in named]
    assert [x for x in after if x[:2] not in named] == [x for x in whole if x[:2] not in named]


def test_zooms_with_the_same_ways_share_one_chain(spark):
    rows = [("a", [9, 10, 11, 12]), ("a", [9, 10, 11, 12]), ("a", [11, 12]), ("b", [10, 12])]
    got = DR.zoom_classes(spark.createDataFrame(rows, "k string, zooms array<int>"), ["k"]).collect()
    assert {(r.k, r.zoom): r.rep for r in got} == {("a", 9): 9, ("a", 10): 9, ("a", 11): 11, ("a", 12): 11, ("b", 10): 10, ("b", 12): 10}


# ---- stations and vehicles --------------------------------------------------------------------------------------------

def test_candidates_join_the_network_of_their_kind(spark):
    m = 1 / M_PER_DEG_LAT
    rail = spark.createDataFrame([(1, 40.0, 116.0), (2, 40.0 + 1000 * m, 116.0)], "id long, lat double, lon double")
    roads = spark.createDataFrame([(7, 1, 50, 40.0, 116.0, 51, 40.0 + 1000 * m, 116.0)], SEGS)
    rows = [(10, "node", 10, "rail", 40.0 + 150 * m, 116.0), (11, "node", 11, "rail", 40.0 + 500 * m, 116.0), (12, "node", 1, "rail", 40.0, 116.0), (13, "node", 50, "rail", 40.0 + 300 * m, 116.0),
            (14, "node", 14, "bus", 40.0 + 400 * m, 116.0), (15, "way", 50, "bus", 40.0 + 900 * m, 116.0), (16, "node", 51, "bus", 41.0, 116.0), (17, "node", 17, "bus", 40.0 - 100 * m, 116.0)]
    got = TR.import_links(spark.createDataFrame(rows, "id long, osm_type string, osm_id long, kind string, lat double, lon double"), rail, roads).collect()
    assert {r.id: (r.node_id, r.direct) for r in got} == {10: (1, False), 12: (1, True), 14: (50, False), 15: (51, False), 16: (51, True)}


def test_vehicle_speeds_equal_replay(spark, tmp_path):
    r = random.Random(4)
    t, rows = 0, []
    for i in range(240):
        t += r.randrange(0, 60_000)
        rows.append((i, i % 7 if i % 11 else 8, t, 40 + 0.001 * r.randrange(30), 116 + 0.001 * r.randrange(30)))
    schema = "event_id long, vehicle_id long, ms long, lat double, lon double"
    src = str(tmp_path / "v")
    for k in range(3):
        spark.createDataFrame(rows[80 * k : 80 * k + 80], schema).coalesce(1).write.parquet(f"{src}/{k}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    got = {x.event_id: x for x in L.run_once(L.vehicle_speeds(s, 300, "2 hours"), "append", "speeds").collect()}
    last: dict = {}
    for i, v, ms, y, x in rows:
        want = None
        if v in last and 0 < ms - last[v][0] <= 300_000:
            before, y0, x0 = last[v]
            h = math.sin(math.radians(y - y0) / 2) ** 2 + math.cos(math.radians(y0)) * math.cos(math.radians(y)) * math.sin(math.radians(x - x0) / 2) ** 2
            want = 2 * 6378137.0 * math.asin(math.sqrt(h)) / (ms - before) * 3600
        last[v] = (ms, y, x)
        speed = got[i].speed_kmh
        assert (speed is None or math.isnan(speed)) if want is None else speed == pytest.approx(want)
        assert (got[i].cell_y, got[i].cell_x) == (math.floor(y / 0.01), math.floor(x / 0.01))
