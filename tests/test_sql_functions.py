import math

import pytest
from pyspark.sql import functions as F

from streetloom.functions import sql
from streetloom.operators.drawing import TileGrid
from tests.conftest import SMALL
from tests.oracle import check, connect


def test_every_function_equals_its_column(spark):
    ok, note = check(spark, connect(SMALL), "sql_functions", SMALL)
    assert ok, note
    assert len(sql.RULES) >= 30


def test_tiles_of_box_table(spark):
    sql.register(spark)
    grid = TileGrid(39.7, 39.9, 116.1, 116.4, 6)
    got = sorted(r.tile for r in spark.sql("SELECT tile FROM tiles_of_box(39.7D, 39.9D, 116.1D, 116.4D, 6, 39.74D, 39.8D, 116.12D, 116.21D)").collect())
    want = spark.range(1).select(grid.tiles_of_box(*[F.lit(x) for x in (39.74, 39.8, 116.12, 116.21)]).alias("t")).first().t
    assert got == sorted(want) and len(got) > 3


def test_cells_of_radius_table(spark):
    sql.register(spark)
    lat, lon, radius, cell = 39.9, 116.4, 900.0, 250.0
    y, x = lat * 110574.0 / cell, lon * 111320.0 * math.cos(math.radians(lat)) / cell
    want = {}
    for r in range(math.floor(y) - 9, math.floor(y) + 10):
        for c in range(math.floor(x) - 9, math.floor(x) + 10):
            d = math.hypot((r + 0.5 - y) * cell, (c + 0.5 - x) * cell)
            if d <= radius:
                want[r, c] = max(0.25, 1 - d / radius * 0.75)
    got = {(r.cell_y, r.cell_x): r.w for r in spark.sql(f"SELECT * FROM cells_of_radius({lat}D, {lon}D, {radius}D, {cell}D)").collect()}
    assert got == pytest.approx(want) and len(got) > 20
