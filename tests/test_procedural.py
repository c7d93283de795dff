"""Sequential operators against plain versions, answers of loose JSON, and spatial joins far from the equator."""

import math
import random

from pyspark.sql import functions as F

from terrane.functions import grading as gd
from terrane.functions import text as tx
from terrane.operators import graph
from terrane.operators import procedural as pr
from terrane.operators import spatial as sp


def _points(spark, rows):
    return spark.createDataFrame(rows, "scene_id int, id long, x double, y double")


def _metres(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))


def test_pairs_within_metres_at_any_latitude(spark):
    rng = random.Random(1)
    for lat in (0.0, 40.0, 58.0, 75.0, -84.0):
        rows = [(1, i, 10 + rng.uniform(-1, 1) * 0.004 / math.cos(math.radians(lat)), lat + rng.uniform(-1, 1) * 0.004) for i in range(120)]
        at = {r[1]: r[2:] for r in rows}
        want = {(i, j) for i in at for j in at if _metres(at[i], at[j]) <= 150}
        p = _points(spark, rows)
        assert {(r.id, r.other) for r in sp.within_metres(p, p, 150.0).collect()} == want
        want = {i: min((_metres(at[i], at[j]), j) for j in at if j != i)[1] for i in at}
        for rings in (False, True, None):
            assert {r.id: r.other for r in sp.nearest(p, p, 1, 40.0, rings).collect()} == want


def test_merge_keeps_the_first(spark):
    rng = random.Random(2)
    rows = [(k % 3, k, rng.uniform(0, 0.004), 40 + rng.uniform(0, 0.004)) for k in range(150)]
    want = {}
    for scene in range(3):
        kept = []
        for s, i, x, y in rows:
            if s == scene:
                hit = next((j for j, kx, ky in kept if math.hypot((x - kx) * 111320.0 * math.cos(math.radians(y)), (y - ky) * 110540.0) <= 40), None)
                if hit is None:
                    kept.append((i, x, y))
                want[i] = i if hit is None else hit
    assert {r.id: r.into for r in pr.merge_nearby(_points(spark, rows), 40.0).collect()} == want


def test_text_map(spark):
    cells = [(1, 0, 0, 1, "-"), (1, 0, 1, 1, "-"), (1, 0, 1, 3, "C"), (1, 2, 3, 2, "#"), (2, 5, 5, 1, "x")]
    got = {(r.scene_id, r.row): r.line for r in pr.text_map(spark.createDataFrame(cells, "scene_id int, row int, col int, prio int, glyph string")).collect()}
    assert got == {(1, 0): "-C..", (1, 1): "....", (1, 2): "...#", (2, 5): "x"}


def test_lines_on_a_grid():
    for c, r in ((5, 0), (0, 5), (5, 5), (7, 3), (-4, 6), (0, 0)):
        cells = list(pr.cells_on_line(0, 0, c, r))
        assert cells[0] == (0, 0) and cells[-1] == (c, r) and len(cells) == max(abs(c), abs(r)) + 1
        assert all(abs(a * r - b * c) * 2 <= max(abs(c), abs(r)) * 1 for a, b in cells if max(abs(c), abs(r)))


def test_nearest_pairs_between_components(spark):
    rows = [(1, 1, 0.0, 40.0), (1, 2, 0.0, 40.0003), (1, 3, 0.001, 40.0), (1, 4, 0.5, 40.0)]
    member = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "id long, component long")
    got = [(r.ca, r.cb, r.a, r.b) for r in graph.closest_between(_points(spark, rows), member, 200.0).collect()]
    assert got == [(1, 3, 1, 3)]


def test_route_goes_around():
    way = pr.route(10, 10, {(4, r) for r in range(9)}, (0, 0), (9, 0))
    assert way[0] == (0, 0) and way[-1] == (9, 0) and (4, 9) in way
    assert pr.route(5, 5, {(2, r) for r in range(5)}, (0, 0), (4, 4)) == []


def test_answers_of_loose_json(spark):
    rows = [('{"a": ["x", 1], "n": "2.5", "f": true}',), ('{"a": "x", "n": "two", "f": "true"}',), ('{"a": {"k": 1}, "n": true}',), ("{",), (None,)]
    d = spark.createDataFrame(rows, "raw string")
    raw = F.col("raw")
    got = d.select(gd.ids(raw, "a").alias("a"), gd.number(raw, "n").alias("n"), gd.flag(raw, "f").alias("f"), gd.same_number(F.lit(2.0), gd.number(raw, "n"), True).alias("ok"), gd.same_ids(F.array(F.lit("1"), F.lit("x")), gd.ids(raw, "a")).alias("same")).collect()
    assert [r.a for r in got] == [["x", "1"], ["x"], None, None, None] and [r.f for r in got] == [True, None, None, None, None]
    assert got[0].n == 2.5 and math.isnan(got[1].n) and got[3].n is None and [r.ok for r in got] == [True] + [False] * 4 or got[0].ok is True
    assert [r.same for r in got] == [True, False, False, False, False]


def test_names(spark):
    n = spark.createDataFrame([(k,) for k in (1, 26, 27, 52, 53, 702, 703)], "n long")
    assert [r[0] for r in n.select(tx.letters(F.col("n"))).collect()] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]
    d = spark.createDataFrame([("רחוב הרצל",), ("שדרות רוטשילד",), ("Long Winding Boulevard Road",), ("Main street",)], "s string")
    assert [r[0] for r in d.select(tx.street_label(F.col("s"))).collect()] == ["[הרצל]", "[רוטשילד]", "[LONG WINDING BO]", "[MAIN ST]"]
    assert d.select(tx.last_triple(F.lit("(a, b, c) x (d, e, f)"))).first()[0] == "(d, e, f)"


def test_ways_to_the_top(spark):
    """Chains of any length up to the bound, cycles cut at their first turn, and ids without a cable."""
    c = [(f"a{i}", f"a{i + 1}", i) for i in range(30)] + [("x", "y", 1), ("y", "z", 2), ("z", "x", 3), ("x", "t", 4), ("w", "t2", 1), ("v", "t2", 9)]
    up = {}
    for source, target, order in sorted(c, key=lambda e: e[2]):
        up[target] = source
    want = {}
    for start in ("a30", "a12", "a1", "a0", "t", "y", "t2", "alone"):
        path = [start]
        while len(path) <= 20 and path[-1] in up and up[path[-1]] not in path:
            path.append(up[path[-1]])
        want[start] = path
    cables = spark.createDataFrame(c, "source string, target string, ord int")
    got = {r.id: r.path for r in graph.trace_up(spark.createDataFrame([(k,) for k in want], "id string"), cables).collect()}
    assert got == want
