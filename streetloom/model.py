"""Schemas of the element tables and the bundle that operators pass around."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.StringType())
ELEMENT = [
    T.StructField("id", T.LongType(), False),
    T.StructField("version", T.IntegerType()),
    T.StructField("tags", TAGS),
    T.StructField("editor", T.StringType()),
    T.StructField("editor_name", T.StringType()),
    T.StructField("ts", T.TimestampType()),
]
NODES = T.StructType([ELEMENT[0], T.StructField("lat", T.DoubleType(), False),
                      T.StructField("lon", T.DoubleType(), False), *ELEMENT[1:]])
WAYS = T.StructType([*ELEMENT, T.StructField("node_count", T.IntegerType()), T.StructField("closed", T.BooleanType())])
WAY_NODES = T.StructType([T.StructField("way_id", T.LongType(), False), T.StructField("seq", T.IntegerType(), False),
                          T.StructField("node_id", T.LongType(), False)])
RELATIONS = T.StructType([*ELEMENT, T.StructField("member_count", T.IntegerType())])
RELATION_MEMBERS = T.StructType([
    T.StructField("relation_id", T.LongType(), False), T.StructField("seq", T.IntegerType(), False),
    T.StructField("member_type", T.StringType()), T.StructField("member_ref", T.LongType()),
    T.StructField("role", T.StringType())])


@dataclass(frozen=True)
class OsmDataset:
    """The five element tables. Each is a lazy DataFrame; ``with_`` swaps some of them."""

    nodes: DataFrame
    ways: DataFrame
    way_nodes: DataFrame
    relations: DataFrame
    relation_members: DataFrame

    def with_(self, **tables: DataFrame) -> "OsmDataset":
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in ("nodes", "ways", "way_nodes", "relations", "relation_members")}
