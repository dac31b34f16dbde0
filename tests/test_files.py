"""The tiny map as XML and as PBF: what is kept, what is skipped, next ids."""

import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from streetloom.model import NODES, RELATION_MEMBERS, RELATIONS, WAY_NODES, WAYS, OsmDataset
from streetloom.operators import geometry as G, history as H
from streetloom.sources import layout, osm_files as X, osm_pbf as P

XML = """<?xml version="1.0" encoding="UTF-8"?>
<osm version="0.6"><bounds minlat="1" minlon="2" maxlat="3" maxlon="4"/>
<node id="1" lat="39.9" lon="116.4" version="2" timestamp="2020-01-02T03:04:05Z" user="ann" uid="11"><tag k="name" v="A &amp; B"/><tag k="name" v="last"/></node>
<node id="2" lat="39.901" lon="116.401"/><node id="3" lat="39.902" lon="116.402" version="1"/>
<node id="5" lat="39.91" lon="116.41"/><node id="6" lat="39.91" lon="116.411"/><node id="7" lat="39.9105" lon="116.411"/>
<node id="8" lat="39.9105" lon="116.41"/><node id="9" lat="39.95" lon="116.45" visible="false"/><node id="10" lat="x" lon="1"/>
<way id="100" version="4" user="bob"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="residential"/></way>
<way id="200" version="1"><nd ref="5"/><nd ref="6"/><nd ref="7"/><nd ref="8"/><nd ref="5"/><tag k="building" v="yes"/><tag k="building:levels" v="6"/></way>
<way id="300" version="1" visible="false"><nd ref="2"/><nd ref="2"/></way>
<relation id="400" version="2"><member type="way" ref="200" role="outer"/><tag k="type" v="multipolygon"/></relation></osm>
"""


@pytest.fixture(scope="module")
def xml_path(tmp_path_factory):
    p = tmp_path_factory.mktemp("xml") / "tiny.osm"
    p.write_text(XML, encoding="utf-8")
    return str(p)


def test_xml(spark, xml_path):
    ds = X.read_osm_xml(spark, xml_path)
    assert {k: v.count() for k, v in ds.tables().items()} == {"nodes": 7, "ways": 2, "way_nodes": 8, "relations": 1, "relation_members": 1}
    one = ds.nodes.where("id = 1").first()
    assert one.tags == {"name": "last"} and one.editor == "11" and one.editor_name == "ann" and one.version == 2 and one.ts.year == 2020
    ways = {r.id: r for r in ds.ways.collect()}
    assert ways[200].closed and not ways[100].closed and ways[100].node_count == 3 and ways[100].editor == "bob"
    assert {r.kind: r.next_id for r in X.next_ids(X.read_raw(spark, xml_path)).collect()} == {"node": 11, "way": 301, "relation": 401}
    assert [r.seq for r in ds.way_nodes.where("way_id = 200").orderBy("seq").collect()] == [0, 1, 2, 3, 4]


def test_kinds(spark, tmp_path):
    (tmp_path / "a.dat").write_text(XML, encoding="utf-8")
    (tmp_path / "b.dat").write_bytes(gzip.compress(XML.encode()))
    (tmp_path / "c.osm").write_bytes(b"")
    (tmp_path / "d.osm").write_bytes(b"hello there")
    (tmp_path / "e.osm").write_bytes(make_pbf())
    kinds = {r.path[-5:]: r.kind for r in X.sniff_osm_format(spark, str(tmp_path)).collect()}
    assert kinds == {"a.dat": "xml", "b.dat": "gzip-xml", "d.osm": "unknown", "e.osm": "pbf"}  # Spark lists no empty files


def test_export_round_trip(spark, xml_path, tmp_path):
    ds = X.read_osm_xml(spark, xml_path)
    X.export_osm(ds, str(tmp_path / "out"))
    again = X.read_osm_xml(spark, str(tmp_path / "out"))
    for name, df in ds.tables().items():
        cols = [c for c in df.columns if c not in ("ts", "editor", "editor_name", "tags")]
        assert sorted(df.select(*cols).collect()) == sorted(again.tables()[name].select(*cols).collect())
    assert again.nodes.where("id = 1").first().tags == {"name": "last"}


def test_layout_and_snapshot(spark, xml_path, tmp_path):
    ds = X.read_osm_xml(spark, xml_path)
    layout.write_dataset(ds, str(tmp_path / "d"), cell_deg=0.05)
    box = {"min_lat": 39.905, "max_lat": 39.92, "min_lon": 116.4, "max_lon": 116.42}
    assert sorted(r.id for r in layout.read_nodes_in_box(spark, str(tmp_path / "d"), box, 0.05).collect()) == [5, 6, 7, 8]
    assert layout.read_dataset(spark, str(tmp_path / "d")).ways.where("id = 200").first().length_m == pytest.approx(282.5, abs=1)
    assert all(r.ok for r in layout.snapshot_dataset(ds, str(tmp_path / "s")).collect())


def test_osmchange(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, "create", "node", 5, None, '{"id":5,"lat":1.5,"lon":2.5,"version":1,"tags":{"a":"<b>"}}', False),
                                  (2, 7, "delete", "way", 6, '{"id":6,"version":3,"nodes":[1,2]}', None, False), (3, 7, "modify", "node", 8, None, "{}", True)],
                                 "id long, changeset_id long, action string, elem_type string, elem_id long, before string, after string, undone boolean")
    X.export_osmchange(H.osmchange_rows(rows, 7), str(tmp_path / "c"))
    text = spark.read.text(str(tmp_path / "c"), wholetext=True).first().value
    assert text.index("<create>") < text.index('node id="5"') < text.index("&lt;b&gt;") < text.index("<delete>") < text.index('<nd ref="1"/>')
    assert "<modify>" not in text


# ---- a PBF writer for the test only --------------------------------------------------------------------------------

def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def zz(n):
    return (n << 1) ^ (n >> 63)


def field(no, value):
    if isinstance(value, int):
        return varint(no << 3) + varint(value)
    return varint(no << 3 | 2) + varint(len(value)) + value


def packed(values, signed=False):
    if signed:
        values = [zz(b - a) for a, b in zip([0, *values[:-1]], values)]
    return b"".join(varint(v) for v in values)


def blob(kind, content, compress=True):
    body = field(3, zlib.compress(content)) + field(2, len(content)) if compress else field(1, content)
    head = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def make_pbf():
    text = [b"", b"name", b"Stop", b"highway", b"primary", b"ann", b"outer", b"type", b"multipolygon"]
    table = field(1, b"".join(field(1, t) for t in text))
    info = field(1, packed([2, 1, 1])) + field(2, packed([1577934245, 1577934245, 1577934245], True)) + field(4, packed([11, 0, 0], True)) + field(5, packed([5, 0, 0], True)) + field(6, packed([1, 1, 0]))
    dense = field(1, packed([1, 14000000000, 3], True)) + field(5, info) + field(8, packed([399000000, 399010000, -100], True)) + field(9, packed([1164000000, 1164010000, -5], True)) + field(10, packed([1, 2, 0, 0, 0]))
    way = field(1, 100) + field(2, packed([3])) + field(3, packed([4])) + field(4, field(1, 7)) + field(8, packed([1, 14000000000, 1], True))
    rel = field(1, 400) + field(2, packed([7])) + field(3, packed([8])) + field(8, packed([6])) + field(9, packed([100], True)) + field(10, packed([1]))
    one = table + field(2, field(2, dense))
    two = table + field(2, field(3, way)) + field(2, field(4, rel))
    return blob(b"OSMHeader", b"") + blob(b"OSMData", one) + blob(b"OSMData", two, compress=False)


def test_pbf(spark, tmp_path):
    f = tmp_path / "tiny.bin"
    f.write_bytes(make_pbf())
    ds = P.read_osm_pbf(spark, str(f))
    nodes = {r.id: r for r in ds.nodes.collect()}
    assert set(nodes) == {1, 14000000000} and nodes[1].tags == {"name": "Stop"} and nodes[1].editor == "11" and nodes[1].editor_name == "ann"
    assert nodes[14000000000].lat == pytest.approx(39.901) and nodes[1].lon == pytest.approx(116.4) and nodes[1].ts.year == 2020
    w = ds.ways.first()
    assert w.closed and w.version == 7 and w.tags == {"highway": "primary"} and [r.node_id for r in ds.way_nodes.orderBy("seq").collect()] == [1, 14000000000, 1]
    assert tuple(ds.relation_members.first()) == (400, 0, "way", 100, "outer")


def test_pbf_partitions(tmp_path):
    f = tmp_path / "t.bin"
    f.write_bytes(make_pbf())
    assert len(P.OsmPbfReader([str(f)], 1).partitions()) == 2
    assert len(P.OsmPbfReader([str(f)], 1 << 20).partitions()) == 1


def test_archive(spark, tmp_path):
    kept, archived = layout.archive_and_delete(spark.range(10), F.col("id") > 6, str(tmp_path / "a"))
    assert kept.count() == 7 and sorted(r.id for r in archived.collect()) == [7, 8, 9]


def test_lengths_skip_missing_nodes(spark, xml_path):
    ds = X.read_osm_xml(spark, xml_path)
    cut = ds.nodes.where("id <> 2")
    assert G.way_length(ds.way_nodes, cut).where("way_id = 100").first().length_m == pytest.approx(280.3, abs=1.5)


def scanned_files(df):
    """How many files the scan of ``df`` opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().get("numFiles").get().value()


def test_box_reads_open_few_files(spark, tmp_path):
    """A lattice of small ways, and some that span many cells; each box read against all rows."""
    nodes, refs = [], []
    for k in range(400):
        lat, lon = 10 + k // 20, 20 + k % 20
        reach = 0.01 if k % 50 else 0.3 * (1 + k // 50)
        nodes += [(2 * k, lat + 0.5, lon + 0.5), (2 * k + 1, lat + 0.5 + reach, lon + 0.5 + reach)]
        refs += [(k, 0, 2 * k), (k, 1, 2 * k + 1)]
    nodes += [(9000, -90.0, -180.0), (9001, 90.0, 180.0)]
    refs += [(900, 0, 9000), (900, 1, 9001), (901, 0, 777777)]
    node = spark.createDataFrame([(i, a, o, 1, None, None, None, None) for i, a, o in nodes], NODES)
    way = spark.createDataFrame([(i, 1, None, None, None, None, 2, False) for i in sorted({r[0] for r in refs})], WAYS)
    ds = OsmDataset(node, way, spark.createDataFrame(refs, WAY_NODES), spark.createDataFrame([], RELATIONS), spark.createDataFrame([], RELATION_MEMBERS))
    path = str(tmp_path / "d")
    layout.write_dataset(ds, path, cell_deg=0.05)
    places = {i: (a, o) for i, a, o in nodes}
    total = scanned_files(spark.read.parquet(f"{path}/ways"))
    for box in ((14.2, 15.8, 25.1, 26.9), (10.505, 10.505, 20.505, 20.505), (-90, 90, -180, 180), (-5, 0, 0, 5), (29.4, 31, 30, 41)):
        b = dict(zip(("min_lat", "max_lat", "min_lon", "max_lon"), box, strict=True))
        ways = layout.read_ways_in_box(spark, path, b)
        touch = lambda p, q: q[1] >= box[2] and p[1] <= box[3] and q[0] >= box[0] and p[0] <= box[1]
        want = {w: [places[2 * w], places[2 * w + 1]] for w in range(400) if touch(places[2 * w], places[2 * w + 1])} | {900: [places[9000], places[9001]]}
        assert {r.id: [tuple(c) for c in r.coords] for r in ways.collect()} == want
        assert sorted(r.id for r in layout.read_nodes_in_box(spark, path, b).collect()) == sorted(i for i, (a, o) in places.items() if box[0] <= a <= box[1] and box[2] <= o <= box[3])
        if box[3] - box[2] < 10:
            assert scanned_files(ways) <= total // 4, box
    assert layout.read_dataset(spark, path).ways.count() == 402


@pytest.mark.parametrize("rect", [((0, 0), (15, 15)), ((3, 5), (3, 5)), ((1, 2), (9, 6)), ((0, 7), (15, 8)), ((5, 5), (10, 10))])
def test_runs_hold_every_cell(rect):
    weave = lambda r, c: sum((r >> k & 1) << 2 * k + 1 | (c >> k & 1) << 2 * k for k in range(4))
    inside = {weave(r, c) for r in range(rect[0][0], rect[1][0] + 1) for c in range(rect[0][1], rect[1][1] + 1)}
    for most in (1, 3, 100):
        runs = layout.runs_of(*rect, 4, most)
        assert len(runs) <= most and all(any(a <= x <= b for a, b in runs) for x in inside)
    assert {x for a, b in layout.runs_of(*rect, 4, 100) for x in range(a, b + 1)} == inside
