"""Way and relation geometry: joins of the bridge tables with nodes, extents and lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetloom.functions.geo import js_round, meters_between
from streetloom.model import OsmDataset


def located_refs(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, seq, node_id, lat, lon); references to missing nodes are skipped."""
    return way_nodes.join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id").select(
        "way_id", "seq", "node_id", "lat", "lon")


def way_geometry(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per way with its points in order. The array is the way's own value and OSM limits a way to 2,000
    references, so it stays small; statistics below never build it."""
    return points_in_order(located_refs(way_nodes, nodes))


def points_in_order(located: DataFrame) -> DataFrame:
    """``way_geometry`` of located references."""
    point = F.struct("seq", "lat", "lon", "node_id")
    return (located.groupBy("way_id")
            .agg(F.array_sort(F.collect_list(point)).alias("_p"))
            .select("way_id",
                    F.transform("_p", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("coords"),
                    F.transform("_p", lambda p: p["node_id"]).alias("node_ids")))


def way_bbox(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    return located_refs(way_nodes, nodes).groupBy("way_id").agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))


def way_segments(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Consecutive located points of each way: (way_id, seq, a, a_lat, a_lon, b, b_lat, b_lon). ``gap`` is 1 unless
    missing nodes were skipped in between."""
    w = Window.partitionBy("way_id").orderBy("seq")
    return (located_refs(way_nodes, nodes)
            .select("way_id", "seq", F.col("node_id").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"),
                    F.lag(F.struct("seq", "node_id", "lat", "lon")).over(w).alias("_prev"))
            .where(F.col("_prev").isNotNull())
            .select("way_id", "seq", F.col("_prev.node_id").alias("a"), F.col("_prev.lat").alias("a_lat"),
                    F.col("_prev.lon").alias("a_lon"), "b", "b_lat", "b_lon", (F.col("seq") - F.col("_prev.seq")).alias("gap")))


def way_length(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Length in metres rounded to 0.1; a way with fewer than two located points has no row of length."""
    seg = way_segments(way_nodes, nodes).withColumn(
        "m", meters_between(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    return seg.groupBy("way_id").agg(js_round(F.sum("m"), 1).alias("length_m"))


def relation_members_resolved(ds: OsmDataset, bbox: DataFrame | None = None) -> DataFrame:
    """Members with the extent of the way or node they name. Nested relations are left out."""
    bbox = way_bbox(ds.way_nodes, ds.nodes) if bbox is None else bbox
    m = ds.relation_members
    ways = m.where("member_type = 'way'").join(bbox.withColumnRenamed("way_id", "member_ref"), "member_ref")
    nodes = m.where("member_type = 'node'").join(
        ds.nodes.select(F.col("id").alias("member_ref"), F.col("lat").alias("min_lat"), F.col("lat").alias("max_lat"),
                        F.col("lon").alias("min_lon"), F.col("lon").alias("max_lon")), "member_ref")
    return ways.unionByName(nodes)


def relation_bbox(ds: OsmDataset, bbox: DataFrame | None = None) -> DataFrame:
    return relation_members_resolved(ds, bbox).groupBy("relation_id").agg(
        F.min("min_lat").alias("min_lat"), F.max("max_lat").alias("max_lat"),
        F.min("min_lon").alias("min_lon"), F.max("max_lon").alias("max_lon"))


def with_extents(ds: OsmDataset) -> DataFrame:
    """Ways with extent and length: one join of references with nodes, one pass per way."""
    w = Window.partitionBy("way_id").orderBy("seq")
    prev_lat, prev_lon = F.lag("lat").over(w), F.lag("lon").over(w)
    step = located_refs(ds.way_nodes, ds.nodes).select(
        "way_id", "lat", "lon", meters_between(prev_lat, prev_lon, F.col("lat"), F.col("lon")).alias("m"))
    stats = step.groupBy("way_id").agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"), js_round(F.sum("m"), 1).alias("length_m"))
    return ds.ways.join(stats.withColumnRenamed("way_id", "id"), "id", "left")
