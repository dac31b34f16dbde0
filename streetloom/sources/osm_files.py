"""OSM XML in and out, kind of file by content, and normalised element tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.functions.geo import in_box, valid_coord
from streetloom.functions.tags import tags_from_pairs
from streetloom.model import OsmDataset
from streetloom.operators import geometry as G
from streetloom.operators.ordered import even_chunk, numbered

_TAG = "tag array<struct<_k:string,_v:string>>"
_COMMON = "_id string, _version string, _timestamp string, _user string, _uid string, _visible string"
XML_SCHEMAS = {
    "node": f"{_COMMON}, _lat string, _lon string, {_TAG}",
    "way": f"{_COMMON}, nd array<struct<_ref:string>>, {_TAG}",
    "relation": f"{_COMMON}, member array<struct<_type:string,_ref:string,_role:string>>, {_TAG}",
}


def read_osm_xml(spark: SparkSession, path: str | list[str], limit: int | None = None) -> OsmDataset:
    """Read .osm and .osm.gz files with Spark's XML source: one pass per kind of element, columns of the other kinds are
    never parsed. Plain files are split; gzip files are read whole by one task each, so large ones should be cut before."""
    return normalise_elements(read_raw(spark, path), limit)


def read_raw(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """Elements as written, visible or not: (id, version, ts, user, uid, visible, tags as pairs, ...) per kind."""
    def table(kind: str) -> DataFrame:
        df = spark.read.format("xml").option("rowTag", kind).option("nullValue", None).schema(XML_SCHEMAS[kind]).load(path)
        cols = [F.col("_id").try_cast("long").alias("id"), F.col("_version").try_cast("int").alias("version"), F.try_to_timestamp("_timestamp").alias("ts"),
                F.col("_user").alias("user"), F.col("_uid").alias("uid"), F.coalesce(F.col("_visible") != "false", F.lit(True)).alias("visible"),
                F.transform("tag", lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value"))).alias("pairs")]
        if kind == "node":
            cols += [F.col("_lat").try_cast("double").alias("lat"), F.col("_lon").try_cast("double").alias("lon")]
        elif kind == "way":
            cols.append(F.filter(F.transform("nd", lambda n: n["_ref"].try_cast("long")), lambda x: x.isNotNull()).alias("refs"))
        else:
            member = F.transform("member", lambda m: F.struct(F.coalesce(m["_type"], F.lit("")).alias("type"), m["_ref"].try_cast("long").alias("ref"),
                                                              F.coalesce(m["_role"], F.lit("")).alias("role")))
            cols.append(F.filter(member, lambda m: m["ref"].isNotNull()).alias("members"))
        return df.select(*cols)
    return {k: table(k) for k in XML_SCHEMAS}


def limit_rows(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first ``n`` rows by a numeric column, without bringing them to one task."""
    one = df.withColumn("_all", F.lit(0))
    return numbered(one, ["_all"], even_chunk(df, order), [F.col(order)], "_rn").where(F.col("_rn") <= n).drop("_all", "_rn")


def limit_elements(ds: OsmDataset, n: int) -> OsmDataset:
    """At most ``n`` nodes, ways and relations each, in id order (files list elements by id), with their references."""
    ways, rels = limit_rows(ds.ways, n), limit_rows(ds.relations, n)
    return ds.with_(nodes=limit_rows(ds.nodes, n), ways=ways, relations=rels,
                    way_nodes=ds.way_nodes.join(ways.select(F.col("id").alias("way_id")), "way_id", "left_semi"),
                    relation_members=ds.relation_members.join(rels.select(F.col("id").alias("relation_id")), "relation_id", "left_semi"))


def next_ids(raw: dict[str, DataFrame]) -> DataFrame:
    """Next free id per kind; skipped elements count too."""
    out = None
    for kind, df in raw.items():
        row = df.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id")).withColumn("kind", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


def normalise_elements(raw: dict[str, DataFrame], limit: int | None = None, max_tags: int | None = None) -> OsmDataset:
    """Version 1 when absent, editor = uid or else user, positions from 0, no invisible elements, no elements without id or
    (nodes) coordinates; the last value of a key counts, and ``max_tags`` keeps that many tags of an element (all by default)."""
    def base(df: DataFrame) -> DataFrame:
        ok = df.where(F.col("id").isNotNull())
        if limit is not None:
            ok = limit_rows(ok, limit)  # the limit counts every element met, kept or not
        ok = ok.where("visible")
        pairs = F.filter(F.coalesce("pairs", F.array().cast("array<struct<key:string,value:string>>")), lambda t: t["key"].isNotNull() & t["value"].isNotNull())
        return ok.withColumn("tags", tags_from_pairs(pairs, max_tags)).withColumn("version", F.coalesce("version", F.lit(1))).withColumn(
            "editor", F.coalesce("uid", "user")).withColumnRenamed("user", "editor_name")

    common = ["id", "version", "tags", "editor", "editor_name", "ts"]
    nodes = base(raw["node"]).where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")).select(*common, "lat", "lon")
    w, r = base(raw["way"]), base(raw["relation"])
    refs = F.coalesce("refs", F.array().cast("array<bigint>"))
    n = F.size(refs)
    closed = F.coalesce((n >= 2) & (F.get(refs, 0) == F.element_at(refs, -1)), F.lit(False))
    ways = w.select(*common, n.alias("node_count"), closed.alias("closed"))
    way_nodes = w.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("seq", "node_id"))
    rels = r.select(*common, F.greatest(F.lit(0), F.size(F.coalesce("members", F.array().cast("array<struct<type:string,ref:bigint,role:string>>")))).alias("member_count"))
    members = r.select(F.col("id").alias("relation_id"), F.posexplode("members").alias("seq", "m")).select(
        "relation_id", "seq", F.col("m.type").alias("member_type"), F.col("m.ref").alias("member_ref"), F.col("m.role").alias("role"))
    return OsmDataset(nodes, ways, way_nodes, rels, members)


def invalid_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(~valid_coord(F.col("lat"), F.col("lon")))


def _kind(head: bytes) -> str:
    if not head:
        return "empty"
    if head[:2] == b"\x1f\x8b":
        try:
            inner = _kind(zlib.decompressobj(31).decompress(head, 4096))
        except zlib.error:
            return "unknown"
        return f"gzip-{inner}" if inner in ("pbf", "xml") else "unknown"
    if 0 < int.from_bytes(head[:4], "big") <= 65536 and (b"OSMHeader" in head[4:80] or b"OSMData" in head[4:80]):
        return "pbf"
    return "xml" if head.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n").startswith(b"<") else "unknown"


def sniff_osm_format(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, kind) for many files by their first bytes, whatever their names: pbf, xml, gzip-pbf, gzip-xml or
    unknown (Spark lists no empty files). Listing reads nothing; tasks open each file and read its first 64 KB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path")

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        for pdf in batches:
            kinds = []
            for path in pdf.path:
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_file(inner) as f:
                    kinds.append(_kind(f.read(65536)))
            yield pdf.assign(kind=kinds)

    return files.mapInPandas(heads, "path string, kind string")


# ---- export --------------------------------------------------------------------------------------------------------

def escape(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _tag_lines(tags: Column, pad: str) -> Column:
    pairs = F.transform(F.map_entries(tags), lambda e: F.concat(F.lit(f'{pad}<tag k="'), escape(e["key"]), F.lit('" v="'), escape(e["value"]), F.lit('"/>')))
    return F.coalesce(pairs, F.array().cast("array<string>"))


def _number(c: str) -> Column:
    """Shortest plain text of a coordinate, without an exponent."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.7f", F.col(c)), "0+$", ""), r"\.$", "")


def export_rows(ds: OsmDataset, box: dict | None = None, limit: int | None = None) -> DataFrame:
    """Body of an OSM XML document, one row per element: (section, id, xml). With a box: nodes in it, ways that touch it with
    all their references, and all relations. ``limit``: at most so many elements of each kind, in id order."""
    nodes, ways = ds.nodes, ds.ways
    if box is not None:
        nodes = nodes.where(in_box(F.col("lat"), F.col("lon"), box))
        ext = G.way_bbox(ds.way_nodes, ds.nodes)
        hit = ext.where((F.col("max_lon") >= box["min_lon"]) & (F.col("min_lon") <= box["max_lon"]) & (F.col("max_lat") >= box["min_lat"]) & (F.col("min_lat") <= box["max_lat"]))
        ways = ways.join(hit.select(F.col("way_id").alias("id")), "id", "left_semi")
    rels = ds.relations
    if limit is not None:
        nodes, ways, rels = limit_rows(nodes, limit), limit_rows(ways, limit), limit_rows(rels, limit)

    def body(open_tag: Column, name: str, inner: Column) -> Column:
        closed = F.concat(open_tag, F.lit("/>"))
        full = F.concat(open_tag, F.lit(">\n"), F.array_join(inner, "\n"), F.lit(f"\n  </{name}>"))
        return F.when(F.size(inner) == 0, closed).otherwise(full)

    n_open = F.concat(F.lit('  <node id="'), F.col("id").cast("string"), F.lit('" lat="'), _number("lat"), F.lit('" lon="'), _number("lon"), F.lit('" version="'), F.col("version").cast("string"), F.lit('"'))
    n = nodes.select(F.lit(1).alias("section"), "id", body(n_open, "node", _tag_lines(F.col("tags"), "    ")).alias("xml"))
    refs = ds.way_nodes.groupBy(F.col("way_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "node_id"))).alias("p"))
    w_open = F.concat(F.lit('  <way id="'), F.col("id").cast("string"), F.lit('" version="'), F.col("version").cast("string"), F.lit('"'))
    nd = F.transform("p", lambda x: F.concat(F.lit('    <nd ref="'), x["node_id"].cast("string"), F.lit('"/>')))
    w = ways.join(refs, "id").select(F.lit(2).alias("section"), "id", body(w_open, "way", F.concat(nd, _tag_lines(F.col("tags"), "    "))).alias("xml"))
    mem = ds.relation_members.groupBy(F.col("relation_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "member_type", "member_ref", "role"))).alias("p"))
    r_open = F.concat(F.lit('  <relation id="'), F.col("id").cast("string"), F.lit('" version="'), F.col("version").cast("string"), F.lit('"'))
    mm = F.transform("p", lambda x: F.concat(F.lit('    <member type="'), x["member_type"], F.lit('" ref="'), x["member_ref"].cast("string"), F.lit('" role="'), escape(x["role"]), F.lit('"/>')))
    mm = F.coalesce(mm, F.array().cast("array<string>"))
    r = rels.join(mem, "id", "left").select(F.lit(3).alias("section"), "id", body(r_open, "relation", F.concat(mm, _tag_lines(F.col("tags"), "    "))).alias("xml"))
    return n.unionByName(w).unionByName(r)


def _write_document(rows: DataFrame, head: str, foot: str, path: str) -> None:
    """Write ordered rows of text; every part file is a complete document of its own."""
    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"xml": [head]})
        yield from batches
        yield pd.DataFrame({"xml": [foot]})

    rows.select("xml").mapInPandas(wrap, "xml string").write.mode("errorifexists").text(path)


def export_osm(ds: OsmDataset, path: str, box: dict | None = None, limit: int | None = None) -> None:
    """Write OSM XML: a folder of documents, each with nodes before ways before relations and ids in order."""
    b = box or {"min_lat": -85, "max_lat": 85, "min_lon": -180, "max_lon": 180}
    head = ('<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6" generator="streetloom">\n'
            f'  <bounds minlat="{b["min_lat"]}" minlon="{b["min_lon"]}" maxlat="{b["max_lat"]}" maxlon="{b["max_lon"]}"/>')
    _write_document(export_rows(ds, box, limit).orderBy("section", "id"), head, "</osm>", path)


def export_osmchange(rows: DataFrame, path: str) -> None:
    """Write an osmChange document from ``history.osmchange_rows`` of one changeset, whose snapshots are JSON texts with id,
    version, lat, lon, nodes and tags."""
    snap = F.from_json("snapshot", "id bigint, version int, lat double, lon double, nodes array<bigint>, tags map<string,string>")
    s = rows.where("elem_type IN ('node', 'way')").withColumn("s", snap).where("s.id IS NOT NULL")
    where = F.when(F.col("elem_type") == "node", F.concat(F.lit('" lat="'), F.col("s.lat").cast("string"), F.lit('" lon="'), F.col("s.lon").cast("string"))).otherwise("")
    head = F.concat(F.lit("    <"), F.col("elem_type"), F.lit(' id="'), F.col("s.id").cast("string"), where, F.lit('" version="'), F.coalesce("s.version", F.lit(1)).cast("string"), F.lit('">'))
    nd = F.transform(F.coalesce("s.nodes", F.array().cast("array<bigint>")), lambda x: F.concat(F.lit('      <nd ref="'), x.cast("string"), F.lit('"/>')))
    xml = F.array_join(F.concat(F.array(head), nd, _tag_lines(F.col("s.tags"), "      "), F.array(F.concat(F.lit("    </"), F.col("elem_type"), F.lit(">")))), "\n")
    body = s.select((F.col("section") + 1).alias("section"), F.lit(1).alias("part"), F.col("id").alias("k"), xml.alias("xml"))
    names = F.element_at(F.array(F.lit("create"), F.lit("modify"), F.lit("delete")), F.col("section"))
    used = body.select("section").distinct()
    marks = used.select("section", F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), F.concat(F.lit("  <"), names, F.lit(">")).alias("xml")).unionByName(
        used.select("section", F.lit(2).alias("part"), F.lit(0).cast("long").alias("k"), F.concat(F.lit("  </"), names, F.lit(">")).alias("xml")))
    # A document lists its sections in order, so it is one file; documents of several changesets are written one by one.
    if rows.select("changeset_id").distinct().limit(2).count() > 1:
        raise ValueError("an osmChange document holds one changeset")
    rows = body.unionByName(marks).repartition(1).sortWithinPartitions("section", "part", "k")
    _write_document(rows, '<?xml version="1.0" encoding="UTF-8"?>\n<osmChange version="0.6" generator="streetloom">', "</osmChange>", path)
