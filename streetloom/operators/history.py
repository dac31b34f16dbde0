"""The change log, and edits applied to whole tables as batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streetloom.functions.geo import RAD, meters_between
from streetloom.functions.tags import clean_tags, val
from streetloom.model import OsmDataset
from streetloom.operators.datasets import allocate_ids, orphan_nodes
from streetloom.session import cut_lineage


# ---- reading the log --------------------------------------------------------------------------------------

def recent_changes(changes: DataFrame, n: int = 100) -> DataFrame:
    return changes.orderBy(F.col("id").desc()).limit(n)


def element_history(changes: DataFrame, elements: DataFrame, n: int = 50) -> DataFrame:
    """Latest ``n`` changes of each given (elem_type, elem_id)."""
    w = Window.partitionBy("elem_type", "elem_id").orderBy(F.col("id").desc())
    return (changes.join(elements, ["elem_type", "elem_id"], "left_semi")
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))


def changes_of_changeset(changes: DataFrame, changeset_id: int) -> DataFrame:
    return changes.where(F.col("changeset_id") == changeset_id).orderBy(F.col("id").desc())


def changesets(changes: DataFrame) -> DataFrame:
    """One row per changeset: author, time, number of operations, whether all of it was undone."""
    return changes.groupBy("changeset_id").agg(
        F.min_by("author", "id").alias("author"), F.min("ts").alias("ts"), F.count("*").alias("op_count"), F.bool_and("undone").alias("reverted"))


def osmchange_rows(changes: DataFrame, changeset_id: int | None = None) -> DataFrame:
    """Rows of an osmChange document: section create/modify/delete, in log order; undone rows are skipped; the snapshot
    is ``after``, or ``before`` where there is none."""
    c = changes if changeset_id is None else changes.where(F.col("changeset_id") == changeset_id)
    section = F.when(F.col("action") == "create", 0).when(F.col("action") == "modify", 1).otherwise(2)
    return c.where(~F.coalesce("undone", F.lit(False))).select(
        "changeset_id", section.alias("section"), "id", "action", "elem_type", "elem_id", F.coalesce("after", "before").alias("snapshot"))


# ---- applying a batch -----------------------------------------------------------------------------------------

_FOLDED = "elem_id bigint, change_id bigint, action string, value string, accepted boolean, reason string, version int"


def apply_changes(elements: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply create/modify/delete in order of change id and return (elements after, outcome of every change).

    ``elements``: id, version, value. ``changes``: id, elem_id, action, expected (version or NULL), value. A change is
    refused when its element is missing (or, for create, present), or when it expects another version than the element
    has at that point; a refused change does not move the version. This is a fold per element: changes are sorted by element and
    change id and streamed through tasks that only remember the current version, so an element may have any number of them. All
    changes of one element are folded in one task, as each depends on the one before. The outcome is written once; both results read it.
    """
    base = elements.select(F.col("id").alias("elem_id"), F.col("version").alias("v0"), F.col("value").alias("value0"))
    ops = (changes.join(base.select("elem_id", "v0"), "elem_id", "left").select("elem_id", F.col("id").alias("change_id"), "action", "expected", "value", "v0")
           .repartition("elem_id").sortWithinPartitions("elem_id", "change_id"))
    outcome = cut_lineage(ops.mapInPandas(_fold_sorted, _FOLDED))
    last = outcome.where("accepted").groupBy("elem_id").agg(F.max_by(F.struct("action", "version", "value"), "change_id").alias("s"))
    after = base.join(last, "elem_id", "full_outer").select(
        F.col("elem_id").alias("id"), F.coalesce("s.version", F.when(F.col("s").isNull(), F.col("v0"))).alias("version"),
        F.when(F.col("s").isNull(), F.col("value0")).otherwise(F.col("s.value")).alias("value"), F.col("s.action").alias("_a"))
    return after.where("_a IS NULL OR _a <> 'delete'").drop("_a"), outcome


def _fold_sorted(batches: Iterator) -> Iterator:
    """The fold over rows sorted by element and change; only (element, version) is carried between batches."""
    import pandas as pd
    current, version = None, None
    for pdf in batches:
        out = []
        for elem, change, action, expected, value, v0 in zip(
                pdf.elem_id, pdf.change_id, pdf.action, pdf.expected, pdf.value, pdf.v0):
            if elem != current:
                current, version = elem, None if pd.isna(v0) else int(v0)
            reason = None
            if action == "create":
                reason = "exists" if version is not None else None
            elif version is None:
                reason = "missing"
            elif not pd.isna(expected) and int(expected) != version:
                reason = "version"
            if reason is None:
                version = 1 if action == "create" else None if action == "delete" else version + 1
            out.append((elem, change, action, value, reason is None, reason, version))
        res = pd.DataFrame(out, columns=["elem_id", "change_id", "action", "value", "accepted", "reason", "version"])
        res["version"] = res["version"].astype("Int32")
        yield res


def state_at(current: DataFrame, changes: DataFrame, change_id: int) -> DataFrame:
    """Elements as they were just after ``change_id``: the ``before`` of each element's first later change, else the
    current state. ``current``: id, value; ``changes``: id, elem_id, before."""
    later = changes.where(F.col("id") > change_id).groupBy(F.col("elem_id").alias("id")).agg(
        F.min_by(F.struct("before"), "id").alias("b"))
    joined = current.join(later, "id", "full_outer")
    return joined.select("id", F.when(F.col("b").isNotNull(), F.col("b.before")).otherwise(F.col("value")).alias("value")).where("value IS NOT NULL")


def revert_changesets(current: DataFrame, changes: DataFrame, ids: list[int] | None = None) -> dict[str, DataFrame]:
    """Roll changesets back, newest change first. Each touched element ends with the ``before`` of its oldest change that
    was not undone yet; without one it is deleted. Also gives the inverse log rows and the changesets now reverted."""
    c = changes if ids is None else changes.where(F.col("changeset_id").isin(ids))
    open_ = c.where(~F.coalesce("undone", F.lit(False)))
    oldest = open_.groupBy(F.col("elem_id").alias("id")).agg(F.min_by(F.struct("before"), "id").alias("b"))
    restored = oldest.select("id", F.col("b.before").alias("value"))
    kept = current.join(oldest, "id", "left_anti").select("id", "value")
    inverse = open_.select("changeset_id", F.col("id").alias("of_change"), "elem_id",
                           F.when(F.col("before").isNotNull(), "modify").otherwise("delete").alias("action"),
                           F.col("after").alias("before"), F.col("before").alias("after"))
    return {"elements": kept.unionByName(restored.where("value IS NOT NULL")), "deleted": restored.where("value IS NULL").select("id"),
            "inverse": inverse, "reverted": open_.select("changeset_id").distinct()}


# ---- edits of geometry ---------------------------------------------------------------------------------------------

def _without(ds: OsmDataset, ways: DataFrame) -> OsmDataset:
    w = ways.select(F.col("id").alias("way_id"))
    return ds.with_(ways=ds.ways.join(ways.select("id"), "id", "left_anti"), way_nodes=ds.way_nodes.join(w, "way_id", "left_anti"))


def delete_ways(ds: OsmDataset, ids: DataFrame) -> tuple[OsmDataset, DataFrame]:
    """Delete ways and the nodes that nothing names afterwards. Returns (dataset, deleted (type, id))."""
    gone = ds.ways.join(ids.select("id"), "id", "left_semi").select("id")
    left = _without(ds, gone)
    touched = ds.way_nodes.join(gone.select(F.col("id").alias("way_id")), "way_id", "left_semi").select(F.col("node_id").alias("id")).distinct()
    orphans = orphan_nodes(left, touched)
    deleted = gone.select(F.lit("way").alias("type"), "id").unionByName(orphans.select(F.lit("node").alias("type"), "id"))
    return left.with_(nodes=ds.nodes.join(orphans, "id", "left_anti")), deleted


def delete_nodes(ds: OsmDataset, ids: DataFrame, cascade: bool = False) -> tuple[DataFrame, DataFrame]:
    """Delete nodes: (deleted (type, id), refused ids). Without ``cascade``, nodes that something names are refused; with
    it, ways and relations that name them go too, and the nodes those ways leave behind."""
    known = ds.nodes.join(ids.select("id"), "id", "left_semi").select("id")
    by_way = ds.way_nodes.join(known.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    by_rel = ds.relation_members.where("member_type = 'node'").join(known.select(F.col("id").alias("member_ref")), "member_ref", "left_semi")
    if not cascade:
        used = by_way.select(F.col("node_id").alias("id")).unionByName(by_rel.select(F.col("member_ref").alias("id"))).distinct()
        return known.join(used, "id", "left_anti").select(F.lit("node").alias("type"), "id"), known.join(used, "id", "left_semi")
    ways = by_way.select(F.col("way_id").alias("id")).distinct()
    rels = by_rel.select(F.col("relation_id").alias("id")).distinct()
    _, from_ways = delete_ways(ds, ways)
    out = (from_ways.unionByName(rels.select(F.lit("relation").alias("type"), "id"))
           .unionByName(known.select(F.lit("node").alias("type"), "id")).distinct())
    return out, known.limit(0)


def split_ways(ds: OsmDataset, cuts: DataFrame, first_new_id: int) -> DataFrame:
    """Cut ways at interior nodes: (way_id, part, new_id, seq, node_id). The first part keeps the id; the others get new
    ids in order of way and part. A cut at an end, or at a node that is not in the way, has no effect."""
    at = ds.way_nodes.join(cuts.select("way_id", "node_id").distinct(), ["way_id", "node_id"]).groupBy("way_id", "node_id").agg(F.min("seq").alias("pos"))
    size = ds.ways.select(F.col("id").alias("way_id"), "node_count")
    inner = at.join(size, "way_id").where("pos > 0 AND pos < node_count - 1")
    per_way = inner.groupBy("way_id").agg(F.array_sort(F.collect_set("pos")).alias("cuts"))
    rows = ds.way_nodes.join(per_way, "way_id")
    before = F.size(F.filter("cuts", lambda c: c < F.col("seq")))
    parts = F.when(F.array_contains("cuts", F.col("seq")), F.array(before, before + 1)).otherwise(F.array(before))
    rows = rows.select("way_id", "node_id", "seq", "cuts", F.explode(parts).alias("part"))
    rows = rows.withColumn("seq", F.when(F.col("part") > 0, F.col("seq") - F.get("cuts", F.col("part") - 1)).otherwise(F.col("seq")))
    new = per_way.select("way_id", F.explode(F.sequence(F.lit(1), F.size("cuts"))).alias("part"))
    ids = allocate_ids(new, first_new_id, "way_id", then=["part"]).select("way_id", "part", "new_id")
    return rows.join(ids, ["way_id", "part"], "left").select(
        "way_id", "part", F.coalesce("new_id", "way_id").alias("new_id"), F.col("seq").cast("int").alias("seq"), "node_id")


def merge_ways(ds: OsmDataset, pairs: DataFrame, snap_m: float = 25.0) -> dict[str, DataFrame]:
    """Join way pairs (a, b) at their nearest ends. Ends at most ``snap_m`` apart become one node half way between them,
    farther ends are bridged; b is turned round if needed and appended to a. Pairs that share a way with another pair
    are refused, because their results would depend on the order. The pair list enters many joins, so it is written once.
    """
    pairs = cut_lineage(pairs)
    both = pairs.select(F.explode(F.array("a", "b")).alias("way_id")).groupBy("way_id").agg(F.count("*").alias("n")).where("n > 1").select("way_id")
    clash = pairs.join(both, F.col("a") == F.col("way_id"), "left_semi").unionByName(pairs.join(both, F.col("b") == F.col("way_id"), "left_semi")).distinct()
    clean = pairs.join(clash, ["a", "b"], "left_anti")
    wanted = clean.select(F.explode(F.array("a", "b")).alias("way_id"))
    arrays = (ds.way_nodes.join(wanted, "way_id", "left_semi").groupBy("way_id")
              .agg(F.array_sort(F.collect_list(F.struct("seq", "node_id"))).alias("p"))
              .select("way_id", F.transform("p", lambda x: x["node_id"]).alias("ids")).where(F.size("ids") >= 2))
    ab = clean.join(arrays.select(F.col("way_id").alias("a"), F.col("ids").alias("a_ids")), "a").join(
        arrays.select(F.col("way_id").alias("b"), F.col("ids").alias("b_ids")), "b")
    ends = ab.select("a", "b", F.posexplode(F.array(*[F.struct(F.lit(i).alias("ea"), F.lit(j).alias("eb"),
                                                                F.element_at("a_ids", 1 if i == 0 else -1).alias("na"),
                                                                F.element_at("b_ids", 1 if j == 0 else -1).alias("nb"))
                                                      for i in (0, 1) for j in (0, 1)])).alias("o", "e")).select("a", "b", "o", "e.*")
    n = ds.nodes.select("id", "lat", "lon")
    ends = ends.join(n.toDF("na", "a_lat", "a_lon"), "na").join(n.toDF("nb", "b_lat", "b_lon"), "nb")
    d = F.when(F.col("na") == F.col("nb"), 0.0).otherwise(meters_between(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    best = ends.withColumn("d", d).groupBy("a", "b").agg(F.min(F.struct("d", "o", "ea", "eb", "na", "nb", "a_lat", "a_lon", "b_lat", "b_lon")).alias("m")).select("a", "b", "m.*")
    snapped = (F.col("na") != F.col("nb")) & (F.col("d") <= snap_m)
    best = best.withColumn("snapped", snapped).withColumn("bridged_m", F.when((F.col("na") != F.col("nb")) & ~snapped, F.floor(F.col("d") * 10 + 0.5) / 10).otherwise(0.0))
    j = ab.join(best, ["a", "b"])
    # A snapped victim becomes the keeper before the parts are joined; repeats of a node in a row collapse.
    fixed = F.transform("b_ids", lambda x: F.when(F.col("snapped") & (x == F.col("nb")), F.col("na")).otherwise(x))
    a_part = F.when(F.col("ea") == 1, F.col("a_ids")).otherwise(F.reverse("a_ids"))
    b_part = F.when(F.col("eb") == 0, fixed).otherwise(F.reverse(fixed))
    rest = F.when(F.get(b_part, 0) == F.element_at(a_part, -1), F.slice(b_part, 2, F.greatest(F.size(b_part) - 1, F.lit(0)))).otherwise(b_part)
    merged = j.select(F.col("a").alias("way_id"), F.col("b").alias("removed_way"), F.concat(a_part, rest).alias("node_ids"), "bridged_m", "snapped",
                      F.when(F.col("snapped"), F.col("nb")).alias("removed_node"), F.when(F.col("snapped"), F.col("na")).alias("moved_node"),
                      F.when(F.col("snapped"), (F.col("a_lat") + F.col("b_lat")) / 2).alias("lat"), F.when(F.col("snapped"), (F.col("a_lon") + F.col("b_lon")) / 2).alias("lon"))
    moves = merged.where("snapped").select(F.col("removed_node").alias("from_id"), F.col("moved_node").alias("to_id"))
    others = ds.with_(way_nodes=ds.way_nodes.join(wanted, "way_id", "left_anti"))
    return {"merged": merged, "refused": clash, "remapped": join_nodes(others, moves)["way_nodes"]}


def join_nodes(ds: OsmDataset, pairs: DataFrame) -> dict[str, DataFrame]:
    """Replace node ``from_id`` by ``to_id`` in the ways that use it; repeats in a row collapse, ways left with fewer than
    two nodes are deleted. Returns the new references of touched ways, the deleted ways and the removed nodes."""
    known = pairs.where("from_id <> to_id").join(ds.nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(
        ds.nodes.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    touched = ds.way_nodes.join(known.select(F.col("from_id").alias("node_id")), "node_id", "left_semi").select("way_id").distinct()
    w = Window.partitionBy("way_id").orderBy("seq")
    mapped = (ds.way_nodes.join(touched, "way_id", "left_semi").join(known.select(F.col("from_id").alias("node_id"), "to_id"), "node_id", "left")
              .select("way_id", "seq", F.coalesce("to_id", "node_id").alias("node_id"))
              .withColumn("_p", F.lag("node_id").over(w)).where("_p IS NULL OR _p <> node_id").drop("_p"))
    mapped = mapped.withColumn("seq", (F.row_number().over(w) - 1).cast("int"))
    short = mapped.groupBy("way_id").agg(F.count("*").alias("n")).where("n < 2").select("way_id")
    return {"way_nodes": mapped.join(short, "way_id", "left_anti"), "deleted_ways": short, "removed_nodes": known.select(F.col("from_id").alias("id"))}


def reverse_ways(ds: OsmDataset, ids: DataFrame) -> DataFrame:
    """References of the given ways in opposite order."""
    size = ds.ways.join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("way_id"), "node_count")
    return ds.way_nodes.join(size, "way_id").select("way_id", (F.col("node_count") - 1 - F.col("seq")).cast("int").alias("seq"), "node_id")


def retag(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """Set and remove tags in bulk. ``edits``: id, set_tags MAP, drop_keys ARRAY. The version grows where an edit applies."""
    j = elements.join(edits, "id", "left")
    empty = F.create_map().cast("map<string,string>")
    keep = F.map_filter(F.coalesce("tags", empty), lambda k, v: ~F.coalesce(F.array_contains("drop_keys", k), F.lit(False))
                        & ~F.map_contains_key(F.coalesce("set_tags", empty), k))
    changed = F.col("set_tags").isNotNull() | F.col("drop_keys").isNotNull()
    return j.select("id", (F.col("version") + changed.cast("int")).alias("version"),
                    F.when(changed, clean_tags(F.map_concat(keep, F.coalesce("set_tags", empty)))).otherwise(F.col("tags")).alias("tags"))


def upsert_relations(ds: OsmDataset, relations: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Create or update relations. Refused: those without a ``type`` tag when new, and those with a member that does not
    exist. ``relations``: id, tags; ``members``: relation_id, seq, member_type, member_ref, role."""
    missing = None
    for kind, table in (("node", ds.nodes), ("way", ds.ways), ("relation", ds.relations)):
        part = members.where(F.col("member_type") == kind).join(table.select(F.col("id").alias("member_ref")), "member_ref", "left_anti")
        missing = part if missing is None else missing.unionByName(part)
    odd = members.where(~F.col("member_type").isin("node", "way", "relation"))
    bad = missing.unionByName(odd.select(*missing.columns)).select(F.col("relation_id").alias("id")).distinct().withColumn("reason", F.lit("member_missing"))
    old = ds.relations.select("id", F.col("version").alias("old_version"))
    j = relations.join(old, "id", "left").join(bad, "id", "left")
    reason = F.coalesce("reason", F.when(F.col("old_version").isNull() & val(F.col("tags"), "type").isNull(), F.lit("type_missing")))
    j = j.withColumn("reason", reason)
    count = members.groupBy(F.col("relation_id").alias("id")).agg(F.count("*").cast("int").alias("member_count"))
    done = j.where("reason IS NULL").join(count, "id", "left").select(
        "id", "tags", F.coalesce(F.col("old_version") + 1, F.lit(1)).alias("version"), F.coalesce("member_count", F.lit(0)).alias("member_count"))
    return {"written": done, "refused": j.where("reason IS NOT NULL").select("id", "reason")}


def duplicate(ds: OsmDataset, ids: DataFrame, first_node_id: int, first_way_id: int, offset_m: float = 8.0) -> dict[str, DataFrame]:
    """Copy ways, moved ``offset_m`` north and east, with new ids for the ways and for each of their nodes."""
    ways = ds.ways.join(ids.select("id"), "id", "left_semi")
    new_ways = allocate_ids(ways, first_way_id, "id")
    refs = ds.way_nodes.join(ways.select(F.col("id").alias("way_id")), "way_id", "left_semi")
    nodes = ds.nodes.join(refs.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi")
    d_lat = offset_m / 111320.0
    moved = allocate_ids(nodes, first_node_id, "id").select(
        F.col("id").alias("old_id"), "new_id", (F.col("lat") + d_lat).alias("lat"), (F.col("lon") + F.lit(d_lat) / F.cos(F.col("lat") * RAD)).alias("lon"), "tags")
    new_refs = refs.join(moved.select(F.col("old_id").alias("node_id"), F.col("new_id").alias("new_node")), "node_id").join(
        new_ways.select(F.col("id").alias("way_id"), F.col("new_id").alias("new_way")), "way_id").select(
        F.col("new_way").alias("way_id"), "seq", F.col("new_node").alias("node_id"))
    return {"ways": new_ways, "nodes": moved, "way_nodes": new_refs}


def orthogonalise(ways: DataFrame) -> DataFrame:
    """Closed ways to rectangles along their longest edge. ``ways``: way_id, coords with the first point repeated last.
    Gives the four corners and the first again."""
    pts = F.slice("coords", 1, F.size("coords") - 1)
    turned = F.concat(F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 1, 1))
    pairs = F.zip_with(pts, turned, lambda p, q: F.struct(
        meters_between(p["lat"], p["lon"], q["lat"], q["lon"]).alias("d"),
        F.atan2(q["lat"] - p["lat"], (q["lon"] - p["lon"]) * F.cos(p["lat"] * RAD)).alias("angle")))
    # The first longest edge: strictly longer ones replace it.
    longest = F.aggregate(pairs, F.struct(F.lit(-1.0).alias("d"), F.lit(0.0).alias("angle")),
                          lambda best, e: F.when(e["d"] > best["d"], e).otherwise(best))["angle"]
    base = ways.where(F.size("coords") >= 4).where(F.col("coords")[0] == F.element_at("coords", -1)).select(
        "way_id", pts.alias("pts"), longest.alias("g"), F.cos(F.col("coords")[0]["lat"] * RAD).alias("k"))
    x = F.transform("pts", lambda p: p["lon"] * F.col("k") * F.cos(-F.col("g")) - p["lat"] * F.sin(-F.col("g")))
    y = F.transform("pts", lambda p: p["lon"] * F.col("k") * F.sin(-F.col("g")) + p["lat"] * F.cos(-F.col("g")))
    box = base.select("way_id", "g", "k", F.array_min(x).alias("x1"), F.array_max(x).alias("x2"), F.array_min(y).alias("y1"), F.array_max(y).alias("y2"))

    def corner(cx: str, cy: str):
        return F.struct((F.col(cx) * F.sin("g") + F.col(cy) * F.cos("g")).alias("lat"),
                        ((F.col(cx) * F.cos("g") - F.col(cy) * F.sin("g")) / F.col("k")).alias("lon"))
    ring = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"), corner("x1", "y1"))
    return box.select("way_id", ring.alias("coords"))
