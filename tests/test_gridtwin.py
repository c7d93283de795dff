"""Layered grids, trees and ways on small cases that can be drawn by hand."""

from pyspark.sql import functions as F

from terrane.operators import graph as gr
from terrane.operators import gridtwin as gt

RING = "array<struct<x: double, y: double>>"


def square(x, y, h):
    return [{"x": x + a * h, "y": y + b * h} for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]


def scene(spark):
    """A scene of 100 by 50 cells of one unit: a road along row 25, one down column 50, a building and a closure beside the first."""
    f = gt.framed(spark.createDataFrame([(1, 0.0, 0.0, 100.0, 50.0)], "scene_id int, min_x double, min_y double, max_x double, max_y double"))
    streets = spark.createDataFrame([(1, 1, "Main", 0.5, 24.5, 99.5, 24.5), (1, 2, "Side", 50.5, 49.5, 50.5, 0.5)], "scene_id int, street_id long, name string, x double, y double, bx double, by double")
    buildings = spark.createDataFrame([(1, 7, 20.5, 29.5, square(20.5, 29.5, 2.0)), (1, 8, 90.5, 5.5, square(90.5, 5.5, 0.1))], f"scene_id int, id long, x double, y double, footprint {RING}")
    devices = spark.createDataFrame([(1, 1, "closure", 10.5, 25.5), (1, 2, "co", 0.5, 49.5), (1, 3, "closure", 99.5, 0.5)], "scene_id int, id long, kind string, x double, y double")
    cables = spark.createDataFrame([(1, 10.5, 25.5, 20.5, 25.5)], "scene_id int, x double, y double, bx double, by double")
    return f, streets, buildings, devices, cables


def test_layers_of_a_drawn_scene(spark):
    f, streets, buildings, devices, cables = scene(spark)
    base, work = gt.base(f, streets, buildings), gt.work(f, devices, cables)
    rows = {r.row: r.line for r in gt.text(f, base).collect()}
    assert rows[25][:10] == "═" * 10 and rows[25][50] == "╬" and rows[0][50] == rows[49][50] == "║"
    assert rows[20][16:26] == "░░▓▓▓▓░░  " and rows[18][18:22] == "▓▓▓▓" and rows[22][18:22] == "░░░░" and rows[24][18] == " "
    assert rows[44][88:93] == "░░▓░░" and len(rows) == 50 and {len(x) for x in rows.values()} == {100}
    both = gt.composite(base, work)
    shown = {r.row: r.line for r in gt.text(f, both).collect()}
    assert shown[24][10:21] == "●" + "─" * 10 and shown[0][0] == "★" and shown[25] == rows[25]
    assert {(r.glyph, r.hidden) for r in both.filter("hidden IS NOT NULL").collect()} == set()
    over = gt.composite(base, gt.route(f, streets))
    assert over.filter(F.col("hidden") == "╬").count() == 1 and over.filter("glyph = '+'").count() == 4


def test_neighbourhoods_are_read_from_text(spark):
    f, streets, buildings, devices, cables = scene(spark)
    lines = gt.text(f, gt.composite(gt.base(f, streets, buildings), gt.work(f, devices, cables)))
    got = {r.id: r for r in gt.neighbourhoods(lines, devices.filter("kind = 'closure'"), f).collect()}
    assert (got[1].north, got[1].south, got[1].east, got[1].west) == ("empty", "road", "other", "empty")
    assert (got[3].south, got[3].east, got[3].north) == ("zone_edge", "zone_edge", "empty") and got[1].nearest == "3"
    assert got[1].on_sidewalk and not got[1].near_building and not got[1].move and got[3].move
    north = gt.geo.haversine(gt.P(F.lit(0.0), F.lit(0.0)), gt.P(F.lit(0.0), F.lit(50.0)))
    metres = f.select((north / 50).alias("m")).head().m
    assert abs(got[1].road_m - (metres**2 + f.select((gt.geo.haversine(gt.P(F.lit(0.0), F.lit(0.0)), gt.P(F.lit(100.0), F.lit(0.0))) / 100).alias("m")).head().m ** 2) ** 0.5) < 1e-6  # the corner comes first in the scan


def test_registry_and_corridors(spark):
    f, streets, buildings, _, _ = scene(spark)
    got = {r.id: r for r in gt.registry(f, streets, buildings).collect()}
    assert (got[7].cells, got[7].col, got[7].row, got[7].facing, got[7].frontage) == (16, 20, 25, "south", "Main") and got[8].frontage is None
    wall = spark.createDataFrame([(1, 30, 25), (1, 31, 25)], "scene_id int, col int, row int")
    runs = sorted((r.id, r.run, r.first, r.last, r.cells) for r in gt.corridors(f, streets, wall).collect())
    assert runs == [(1, 1, 0, 29, 30), (1, 2, 32, 99, 68), (2, 1, 0, 49, 50)]


def test_trees_and_ways_with_a_cycle(spark):
    nodes = spark.createDataFrame([(x, x.upper()) for x in "abcdexy"], "id string, label string")
    cables = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("c", "d", 1), ("d", "a", 1), ("d", "e", 2), ("x", "y", 1), ("y", "nowhere", 1)], "source string, target string, ord long")
    lines = sorted((r.root, r.place, r.line) for r in gr.tree_lines(nodes, cables, nodes.filter("id IN ('a', 'x')")).collect())
    assert [x[2] for x in lines] == ["A", "├── C", "│   └── D", "│       └── E", "└── B", "X", "└── Y"]
    ways = {r.id: r.path for r in gr.ways_to(cables, nodes.filter("id IN ('a', 'x')")).collect()}
    assert ways == {"a": ["a"], "x": ["x"], "b": ["b", "a"], "c": ["c", "a"], "d": ["d", "a"], "e": ["e", "d", "a"], "y": ["y", "x"], "nowhere": ["nowhere", "y", "x"]}
