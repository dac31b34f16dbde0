"""OSM PBF as a Spark data source.

The file is a chain of blobs with a small header each. Planning reads only the headers (a few bytes per blob, seeking over
the rest) and groups blobs into ranges; tasks open the file themselves, decompress and decode their own blobs and hand
Arrow batches to Spark. Every block carries its own string table, so tasks share nothing.

    spark.dataSource.register(OsmPbfSource)
    spark.read.format("osm_pbf").load(path)
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from streetloom.model import OsmDataset
from streetloom.session import cut_lineage
from streetloom.sources.osm_files import normalise_elements

DDL = ("kind string, id bigint, version int, ts_ms bigint, user string, uid string, visible boolean, lat double, lon double, refs array<bigint>, "
       "pairs array<struct<key:string,value:string>>, members array<struct<type:string,ref:bigint,role:string>>")
ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("version", pa.int32()), ("ts_ms", pa.int64()), ("user", pa.string()), ("uid", pa.string()),
                   ("visible", pa.bool_()), ("lat", pa.float64()), ("lon", pa.float64()), ("refs", pa.list_(pa.int64())),
                   ("pairs", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))),
                   ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])))])
MEMBER_TYPES = ["node", "way", "relation"]
MAX_HEADER, TARGET_BYTES = 64 * 1024, 32 * 1024 * 1024


# ---- wire format -----------------------------------------------------------------------------------------------------

def fields(buf: memoryview) -> Iterator[tuple[int, object]]:
    """(number, value) of a message: integers, or a view for length-delimited fields."""
    i, n = 0, len(buf)

    def varint() -> int:
        nonlocal i
        shift = value = 0
        while True:
            b = buf[i]
            i += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, buf[i:i + size]
            i += size
        else:
            size = 8 if kind == 1 else 4
            yield key >> 3, buf[i:i + size]
            i += size


def varints(buf) -> np.ndarray:
    """All varints of a packed field at once, as uint64."""
    raw = np.frombuffer(buf, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 0x7F).astype(np.uint64) << (place * 7).astype(np.uint64)
    return np.add.reduceat(parts, starts)


def zigzag(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def deltas(buf) -> np.ndarray:
    return np.cumsum(zigzag(varints(buf)))


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


# ---- one block ---------------------------------------------------------------------------------------------------------

def blob_content(blob: memoryview) -> bytes:
    data = dict(fields(blob))
    if 1 in data:
        return bytes(data[1])
    if 3 in data:
        return zlib.decompress(data[3])
    raise ValueError("only raw and zlib blobs are supported")


def _pairs(keys, vals, text: list[str]) -> list[dict]:
    return [{"key": text[int(k)], "value": text[int(v)]} for k, v in zip(varints(keys), varints(vals))]


def _info(buf, text: list[str], date_ms: int) -> dict:
    d = dict(fields(buf)) if buf is not None else {}
    user = text[d[5]] if 5 in d else ""
    return {"version": signed(d[1]) if 1 in d else None, "ts_ms": signed(d[2]) * date_ms if 2 in d else None, "user": user or None,
            "uid": str(d[4]) if d.get(4) else None, "visible": bool(d.get(6, 1))}


def _dense(buf, text: list[str], block: dict) -> list[dict]:
    d = dict(fields(buf))
    ids, lat, lon = deltas(d[1]), deltas(d[8]), deltas(d[9])
    n = len(ids)
    y = 1e-9 * (block["lat"] + block["gran"] * lat)
    x = 1e-9 * (block["lon"] + block["gran"] * lon)
    tags: list[list[dict]] = [[] for _ in range(n)]
    flat = varints(d[10]).astype(np.int64) if 10 in d and len(d[10]) else np.zeros(0, np.int64)
    i = at = 0
    while i < len(flat):
        if flat[i] == 0:
            at, i = at + 1, i + 1
        else:
            tags[at].append({"key": text[flat[i]], "value": text[flat[i + 1]]})
            i += 2
    meta = dict(fields(d[5])) if 5 in d else {}
    version = varints(meta[1]).astype(np.int64) if 1 in meta else None
    ts = deltas(meta[2]) * block["date"] if 2 in meta else None
    uid = deltas(meta[4]) if 4 in meta else None
    user = deltas(meta[5]) if 5 in meta else None
    seen = varints(meta[6]) if 6 in meta and len(meta[6]) else None
    return [{"kind": "node", "id": int(ids[k]), "version": int(version[k]) if version is not None else None, "ts_ms": int(ts[k]) if ts is not None else None,
             "user": (text[int(user[k])] or None) if user is not None else None, "uid": str(int(uid[k])) if uid is not None and uid[k] else None,
             "visible": bool(seen[k]) if seen is not None else True, "lat": float(y[k]), "lon": float(x[k]), "pairs": tags[k]} for k in range(n)]


def decode_block(content: bytes) -> list[dict]:
    """Elements of one data block as rows of the source's schema."""
    text: list[str] = []
    groups = []
    block = {"gran": 100, "lat": 0, "lon": 0, "date": 1000}
    for no, value in fields(memoryview(content)):
        if no == 1:
            text = [bytes(s).decode("utf-8", "replace") for f, s in fields(value) if f == 1]
        elif no == 2:
            groups.append(value)
        elif no in (17, 18):
            block["gran" if no == 17 else "date"] = value
        elif no in (19, 20):
            block["lat" if no == 19 else "lon"] = signed(value)
    rows: list[dict] = []
    for group in groups:
        for no, value in fields(group):
            if no == 2:
                rows += _dense(value, text, block)
            elif no in (1, 3, 4):
                d = dict(fields(value))
                row = {"id": int(zigzag(np.array([d[1]], np.uint64))[0]) if no == 1 else signed(d[1]), "pairs": _pairs(d.get(2, b""), d.get(3, b""), text),
                       **_info(d.get(4), text, block["date"])}
                if no == 1:
                    la, lo = zigzag(np.array([d[8], d[9]], np.uint64))
                    row.update(kind="node", lat=1e-9 * float(block["lat"] + block["gran"] * la), lon=1e-9 * float(block["lon"] + block["gran"] * lo))
                elif no == 3:
                    row.update(kind="way", refs=deltas(d.get(8, b"")).tolist())
                else:
                    roles, refs, types = varints(d.get(8, b"")), deltas(d.get(9, b"")), varints(d.get(10, b""))
                    row.update(kind="relation", members=[{"type": MEMBER_TYPES[int(t)], "ref": int(r), "role": text[int(s)]} for s, r, t in zip(roles, refs, types)])
                rows.append(row)
    return rows


# ---- the source ----------------------------------------------------------------------------------------------------------

@dataclass
class BlobRange(InputPartition):
    path: str
    spans: list


def _open(path: str):
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    return system.open_input_file(inner)


def data_blobs(path: str) -> Iterator[tuple[int, int]]:
    """(offset, size) of each data blob, reading the headers only."""
    with _open(path) as f:
        at, end = 0, f.size()
        while at + 4 <= end:
            f.seek(at)
            size = struct.unpack(">I", f.read(4))[0]
            if not 0 < size <= MAX_HEADER:
                raise ValueError(f"{path} is not a PBF file (blob header of {size} bytes at {at})")
            head = dict(fields(memoryview(f.read(size))))
            start, length = at + 4 + size, int(head[3])
            if bytes(head[1]) == b"OSMData":
                yield start, length
            at = start + length


class OsmPbfReader(DataSourceReader):
    def __init__(self, paths: list[str], target: int):
        self.paths, self.target = paths, target

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            spans, size = [], 0
            for start, length in data_blobs(path):
                spans.append((start, length))
                size += length
                if size >= self.target:
                    out.append(BlobRange(path, spans))
                    spans, size = [], 0
            if spans:
                out.append(BlobRange(path, spans))
        return out or [BlobRange("", [])]

    def read(self, partition: BlobRange) -> Iterator[pa.RecordBatch]:
        if not partition.spans:
            return
        with _open(partition.path) as f:
            for start, length in partition.spans:
                f.seek(start)
                rows = decode_block(blob_content(memoryview(f.read(length))))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class OsmPbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> OsmPbfReader:
        paths = [p for p in self.options.get("path", "").split(",") if p]
        return OsmPbfReader(paths, int(self.options.get("targetbytes", TARGET_BYTES)))


def read_pbf_rows(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    spark.dataSource.register(OsmPbfSource)
    # Five tables come out of one pass over the file: decoded rows are written once instead of decoded again for each.
    rows = cut_lineage(spark.read.format("osm_pbf").load(path).withColumn("ts", F.timestamp_millis("ts_ms")).drop("ts_ms"))
    common = ["id", "version", "ts", "user", "uid", "visible", "pairs"]
    extra = {"node": ["lat", "lon"], "way": ["refs"], "relation": ["members"]}
    return {k: rows.where(F.col("kind") == k).select(*common, *extra[k]) for k in extra}


def read_osm_pbf(spark: SparkSession, path: str, limit: int | None = None) -> OsmDataset:
    return normalise_elements(read_pbf_rows(spark, path), limit)
