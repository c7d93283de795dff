"""Labelled grids against a painter that sets one cell after the other, and scene texts on a small scene."""

import json
import math
import random

import pytest
from test_gridtwin import RING, square

from terrane.operators import gridtwin as gt
from terrane.operators import sceneforms as form
from terrane.operators import zonegrid as zg

STREET = "scene_id int, street_id long, name string, x double, y double, bx double, by double"
CABLE = "scene_id int, cable_id string, kind string, number long, ord long, source long, target long, x double, y double, bx double, by double"
POINT = "scene_id int, id long, kind string, x double, y double"
BOX = "scene_id int, min_x double, min_y double, max_x double, max_y double"
BUILDING = f"scene_id int, id long, type string, floors int, x double, y double, footprint {RING}, address struct<number: string, street: string>"
SIDE = 0.0018  # degrees, less than 200 m: one zone


def metres(ax, ay, bx, by):
    a = math.sin(math.radians(by - ay) / 2) ** 2 + math.cos(math.radians(ay)) * math.cos(math.radians(by)) * math.sin(math.radians(bx - ax) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(a))


def line(c0, r0, c1, r1):
    """Cells of a line, by an error that is carried along."""
    dc, dr, err = abs(c1 - c0), abs(r1 - r0), abs(c1 - c0) - abs(r1 - r0)
    while True:
        yield c0, r0
        if (c0, r0) == (c1, r1):
            return
        two = 2 * err
        if two > -dr:
            err, c0 = err - dr, c0 + (1 if c1 > c0 else -1)
        if two < dc:
            err, r0 = err + dc, r0 + (1 if r1 > r0 else -1)


def inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[-1:] + ring[:-1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def painted(streets, buildings, devices, cables, w, h):
    """The rows of one grid over the square from (0, 0), painted in sequence."""
    g = [[" "] * w for _ in range(h)]
    at = lambda x, y: (max(0, min(w - 1, math.floor(x / (SIDE / w)))), max(0, min(h - 1, h - 1 - math.floor(y / (SIDE / h)))))
    for _, _, name, x, y, bx, by in streets:
        sign = "═" if abs(bx - x) >= abs(by - y) else "║"
        for c, r in line(*at(x, y), *at(bx, by)):
            g[r][c] = sign if g[r][c] == " " else "╬" if g[r][c] != sign else sign
    cells = {}
    for b in buildings:
        ring = [at(v["x"], v["y"]) for v in b[6]]
        cells[b[1]] = [(c, r) for r in range(h) for c in range(w) if inside(c, r, ring)]
    solid = {k for v in cells.values() for k in v}
    for c, r in solid:
        for nr in range(max(0, r - 2), min(h, r + 3)):
            for nc in range(max(0, c - 2), min(w, c + 3)):
                if (nc, nr) not in solid and g[nr][nc] == " ":
                    g[nr][nc] = "░"
    for c, r in solid:
        if g[r][c] != "╬":
            g[r][c] = "▓"
    for k, i in enumerate(sorted(cells, key=str), 1):
        own = cells[i]
        if not own:
            continue
        cc, cr = (math.floor(sum(p[j] for p in own) / len(own) + 0.5) for j in (0, 1))
        row = [c for c, r in own if r == cr]
        label = f"B{k:02d}"
        start = (min(row) + max(row) - len(label) + 1) // 2 if len(row) >= 3 else cc
        for j, x in enumerate(label if len(row) >= 3 else str(k)[-1]):
            if 0 <= start + j < w and g[cr][start + j] == "▓":
                g[cr][start + j] = x
    over = {"═": "╪", "║": "╫", "╬": "╪", "▓": "▒"}
    for _, _, kind, n, _, _, _, x, y, bx, by in sorted(cables, key=lambda c: c[4]):
        for c, r in line(*at(x, y), *at(bx, by)):
            g[r][c] = ("─" if kind == "drop" else "━") if g[r][c] in " ░" else over.get(g[r][c], g[r][c])
    for _, _, kind, n, _, _, _, x, y, bx, by in sorted(cables, key=lambda c: c[4]):
        if kind != "drop":
            c, r = at((x + bx) / 2, (y + by) / 2)
            for j, s in enumerate(f"[{'T' if kind == 'distribution' else 'F'}{n:02d}]"):
                if c + j < w and g[r][c + j] in " ░─━":
                    g[r][c + j] = s
    for _, i, kind, x, y in sorted(devices, key=lambda e: ({"cabinet": 2, "co": 3, "closure": 4}[e[2]], e[1])):
        c, r = at(x, y)
        for j, s in enumerate(f"[{ {'cabinet': '◆', 'co': '★', 'closure': '●'}[kind]}{i:02d}]"):
            if c + j < w:
                g[r][c + j] = s
    named = {}
    for _, i, name, x, y, bx, by in streets:
        (c0, r0), (c1, r1) = at(x, y), at(bx, by)
        named.setdefault(name, []).append((metres(x, y, bx, by), -i, abs(c1 - c0) >= abs(r1 - r0), (c0 + c1) // 2, (r0 + r1) // 2))
    used, put = {True: set(), False: set()}, {True: [], False: []}
    for name, ways in sorted(named.items(), key=lambda p: (-round(sum(x[0] for x in p[1]), 3), p[0])):
        flat = sum(x[0] for x in ways if x[2]) >= sum(x[0] for x in ways if not x[2])
        _, _, _, mx, my = max(x for x in ways if x[2] == flat)
        label = f"[{name.upper().replace(' STREET', ' ST')[:15]}]"
        start = max(2, (mx if flat else my) - len(label) // 2)
        if start + len(label) <= (w if flat else h) - 2 and (my if flat else mx) not in used[flat]:
            used[flat].add(my if flat else mx)
            put[flat].append((label, start, my if flat else mx))
    for flat in (True, False):
        for label, start, at_ in put[flat][:3]:
            for j, s in enumerate(label):
                c, r = (start + j, at_) if flat else (at_, start + j)
                if c < w and r < h and g[r][c] in " ░═║╬":
                    g[r][c] = s
    return ["".join(r) for r in g]


@pytest.mark.parametrize("houses, w, h", [(4, 100, 50), (12, 150, 75), (30, 200, 100), (45, 200, 200)])
def test_grid_equals_one_painted_in_sequence(spark, houses, w, h):
    r = random.Random(houses)
    p = lambda: r.uniform(0.00002, SIDE - 0.00002)
    ways = [(p(), p()) for _ in range(16)]
    streets = [(1, k, ("Long Name Street", "Elm Street", "Oak", "A B C", "River", "Hill")[k % 6], *ways[k], *(ways[k + 1] if k % 2 else (ways[k + 1][0], ways[k][1]))) for k in range(15)]
    buildings = []
    for k in range(houses):
        x, y, half = p(), p(), r.choice((0.00001, 0.00003, 0.00008))
        buildings.append((1, 7 * k + 5, "residential", 2, x, y, square(x, y, half), None))
    devices = [(1, 100 * k + 3, ("closure", "co", "cabinet")[k % 3], p(), p()) for k in range(9)] + [(1, 8, "closure", SIDE - 0.00001, p())]
    cables = [(1, f"c{k}", ("drop", "distribution", "feeder")[k % 3], k, 20 - k, 1, 2, p(), p(), p(), p()) for k in range(14)]
    frame = spark.createDataFrame([(1, 0.0, 0.0, SIDE, SIDE), (2, 0.0, 0.0, SIDE, SIDE)], BOX)  # the second has nothing and gives no grid
    tables = [spark.createDataFrame(x, s) for x, s in ((streets, STREET), (buildings, BUILDING), (devices, POINT), (cables, CABLE))]
    (got,) = zg.zone_grids(frame, *tables, size=250.0).collect()
    assert (got.scene_id, got.zone, got.buildings, got.w, got.h) == (1, "A1", houses, w, h)
    text = got.text.split("\n")
    assert text[0] == "ZONE A1 (250m × 250m)" and text[1].startswith("    0         1") and text[2] == "    " + "0123456789" * (w // 10)
    assert [x[4:-1] for x in text[4:-1]] == painted(streets, buildings, devices, cables, w, h)
    assert [x[1] for x in text[4:6]] == ["A", "B"] and text[3] == "   ┌" + "─" * w + "┐" and text[-1] == "   └" + "─" * w + "┘"


def test_zones_include_their_edges_and_skip_empty_ones(spark):
    div = zg.division(spark.createDataFrame([(1, 0.0, 0.0, 0.004, 0.004)], BOX), 230.0)
    assert div.select("zx", "zy").first() == (2, 2)
    points = spark.createDataFrame([(1, 1, "co", 0.001, 0.003), (1, 2, "co", 0.002, 0.002), (1, 3, "co", 0.004, 0.0), (1, 4, "co", None, 0.0), (1, 5, "co", 0.005, 0.0)], POINT)
    got = sorted((r.id, r.zc, r.zr) for r in zg.zoned(points, div).collect())
    assert got == [(1, 0, 0), (2, 0, 0), (2, 0, 1), (2, 1, 0), (2, 1, 1), (3, 1, 1)]


def small(spark):
    b = spark.createDataFrame([(1, 11, "mixed", 3, 0.0005, 0.0005, square(0.0005, 0.0005, 0.0001)[:4], ("4", 'Quo"te')), (1, 9, "residential", 1, 0.0015, 0.0015, square(0.0015, 0.0015, 0.0001), None)], BUILDING)
    s = spark.createDataFrame([(1, 2, "Street 5", 0.0, 0.00055, 0.001, 0.00055)], STREET).selectExpr("*", "array(struct(x, y), struct(bx AS x, by AS y)) AS line")
    e = spark.createDataFrame([(1, 20, "closure", 0.00052, 0.0005), (1, 30, "co", 0.0, 0.002), (2, 40, "closure", 0.0, 0.0)], POINT)
    serves = spark.createDataFrame([(1, 20, 11), (1, 20, 9)], "scene_id int, id long, building long")
    c = spark.createDataFrame([(1, "d-9", "drop", 9, 9, 20, 9, 0.00052, 0.0005, 0.0015, 0.0015), (1, "m-1", "distribution", 1, 1, 30, 20, 0.0, 0.002, 0.0, 0.0019)], CABLE)
    return b, s, e, serves, c


def test_scene_as_json(spark):
    got = {r.scene_id: r.text.split("\n") for r in form.as_json(*small(spark)).collect()}
    assert got[1][::2] == ["=== buildings.json ===", "=== streets.json ===", "=== layers/equipment.geojson ===", "=== layers/cables.geojson ==="]
    b, s, e, c = (json.loads(x) for x in got[1][1::2])
    assert [x["id"] for x in b] == ["9", "11"] and "address" not in b[0] and b[1]["address"] == {"number": "4", "street": 'Quo"te'}
    assert b[0]["position"] == [0.0015, 0.0015] and len(b[0]["coordinates"][0]) == 5 and s[0]["coordinates"] == [[0, 0.00055], [0.001, 0.00055]]
    assert e["features"][0]["properties"] == {"kind": "closure", "serves": ["9", "11"]} and e["features"][1]["properties"]["serves"] == []
    assert [x["id"] for x in c["features"]] == ["m-1", "d-9"] and c["features"][1]["properties"] == {"kind": "drop", "source": "20", "target": "9"}
    assert json.loads(got[2][1]) == [] and json.loads(got[2][7]) == {"type": "FeatureCollection", "features": []}


def test_scene_as_table(spark):
    got = {r.scene_id: [x.split("\t") for x in r.text.split("\n")] for r in form.as_wkt(*small(spark)).collect()}
    assert got[1][0] == ["id", "type", "attrs", "wkt"] and len(got[1]) == 8 and len(got[2]) == 2
    assert got[1][2][2] == 'use=mixed;floors=3;addr=4 Quo"te' and got[1][2][3].count(",") == 4  # an open ring is closed
    assert got[1][4] == ["20", "equipment", "kind=closure;serves=[9,11]", "POINT(0.0005200 0.0005000)"]


def test_scene_as_ledger(spark):
    got = {r.scene_id: r.text.split("\n") for r in form.as_verdict(*small(spark)).collect()}
    assert got[1][1] == '20 (closure) on_street=true dist_to_street=5.5m nearest_street="2" inside_building=true serves=[9,11]'
    assert got[1][2].startswith('30 (co) on_street=false dist_to_street=160.') and got[1][2].endswith("inside_building=false serves=[]")
    assert got[1][4:6] == ["m-1 (distribution) 30->20 crosses_foreign_building=false", "d-9 (drop) 20->9 crosses_foreign_building=true"]
    assert got[1][7] == '9 type=residential nearest_closure=20 nearest_street="2" coverage_gap=true' and got[1][8].endswith('nearest_closure=20 nearest_street="2" coverage_gap=false')
    assert got[2] == ["=== EQUIPMENT (computed spatial predicates) ===", '40 (closure) on_street=false dist_to_street=Infinitym nearest_street="none" inside_building=false serves=[]', "=== CABLES ===", "=== BUILDINGS ==="]


def test_empty_tables(spark):
    b, s, e, serves, c = (x.limit(0) for x in small(spark))
    for f in (form.as_json, form.as_wkt, form.as_verdict):
        assert f(b, s, e, serves, c).count() == 0
    assert zg.zone_grids(spark.createDataFrame([], BOX), s, b, e, c).count() == 0


def test_ground_is_made_of_runs_and_covers_what_single_cells_did(spark):
    """Buildings and pavement were a row for each cell, and each of 25 neighbours of a cell."""
    rng = random.Random(12)
    f = gt.framed(spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], BOX)).cache()
    rings = [[(rng.random(), rng.random()) for _ in range(rng.randint(1, 7))] for _ in range(40)]
    b = spark.createDataFrame([(1, k, *r[0], [{"x": x, "y": y} for x, y in r]) for k, r in enumerate(rings)], f"scene_id int, id long, x double, y double, footprint {RING}")
    runs = gt.building_runs(f, b).collect()
    want, pavement = set(), set()
    for k, ring in enumerate(rings):
        cells = [(min(99, max(0, int(x * 100))), min(49, max(0, 49 - int(y * 50)))) for x, y in ring]
        want |= {(k, c, r) for c in range(100) for r in range(50) if inside(c, r, cells)}
    for _, c, r in want:
        pavement |= {(c + i, r + j) for i in range(-2, 3) for j in range(-2, 3) if 0 <= c + i < 100 and 0 <= r + j < 50}
    assert {(r.id, c, r.row) for r in runs for c in range(r.lo, r.hi + 1)} == want
    assert {tuple(r) for r in gt.building_cells(f, b, False).select("id", "col", "row").collect()} == want
    ground = zg.built_ground(f, gt.building_runs(f, b)).collect()
    assert {(c, r.row) for r in ground if not r.own for c in range(r.col, r.col + r.n)} == pavement
    assert len(ground) <= 6 * len(runs) < len(want)
