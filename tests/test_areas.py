"""Scenes of windows over a city, against one built in sequence."""

import math
import random

import pytest
from test_gridtwin import RING, square
from test_representations import metres

from terrane.operators import areas as ar

NAMES = ("min_x", "min_y", "max_x", "max_y")


def snap(p, lines):
    best = None
    k = 111320.0 * math.cos(math.radians(p[1]))
    for line in lines:
        for a, b in zip(line, line[1:]):
            dx, dy, ex, ey = (b[0] - a[0]) * k, (b[1] - a[1]) * 110540.0, (p[0] - a[0]) * k, (p[1] - a[1]) * 110540.0
            t = max(0.0, min(1.0, (ex * dx + ey * dy) / (dx * dx + dy * dy) if dx or dy else 0.0))
            d = math.hypot(ex - t * dx, ey - t * dy)
            if best is None or d < best[0]:
                best = d, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
    return best[1] if best else p


def built(box, buildings, streets, most, plants):
    """Entities of one window: buildings (id, x, y, half, address), streets (id, name, highway, points)."""
    inside = lambda x, y, m=0.0, b=box: b[0] - m <= x <= b[2] + m and b[1] - m <= y <= b[3] + m
    own = [b for b in buildings if inside(b[1], b[2])]
    if not own:
        return []
    middle = [sum(b[k] for b in own) / len(own) for k in (1, 2)]
    took = []
    for b in sorted(own, key=lambda b: (round(metres(b[1], b[2], *middle), 6), b[0])):
        if len(took) < most and all(metres(b[1], b[2], o[1], o[2]) >= 8 for o in took):
            took.append(b)
    bounds = min(b[1] - b[3] for b in took), min(b[2] - b[3] for b in took), max(b[1] + b[3] for b in took), max(b[2] + b[3] for b in took)
    lines = [s for s in sorted(streets) if s[2] not in ("service", "unclassified") and any(inside(*v) for v in s[3]) and any(inside(*v, 0.002, bounds) for v in s[3])][:60]
    out = []
    for i, b in enumerate(took):
        head = (b[4] or "").split(" ", 1)
        numbered = len(head) == 2 and head[0][:1].isdigit()
        out.append(("building", f"B-{i}", "|".join(["commercial" if i % 4 == 0 else "residential", str(3 + i % 8), *(head if numbered else [])]), b[1], b[2], None, None))
    out += [("street", f"st-{i}", s[1] or f"street {i}", *s[3][0], *s[3][-1]) for i, s in enumerate(lines)]
    paths = [s[3] for s in lines]
    devices, cables = [["CO-1", "co|", snap(bounds[:2], paths)]], []
    gap = -1
    if "gap" in plants and len(took) > 1:
        apart = [round(min(metres(b[1], b[2], o[1], o[2]) for o in took if o is not b), 6) for b in took]
        gap = apart.index(max(apart))
    for i, b in enumerate(took):
        if i != gap:
            at = snap((b[1], b[2]), paths)
            d = metres(*at, b[1], b[2])
            t = 0.0 if d < 1 else min(4 / d, 0.35)
            at = at[0] + (b[1] - at[0]) * t, at[1] + (b[2] - at[1]) * t
            k = len(devices) - 1
            name = f"CL-{ar.LETTERS[k] if k < 26 else k}"
            devices.append([name, f"closure|B-{i}", at, (b[1], b[2])])
            cables.append((f"drop-{name}", f"drop|{name}|B-{i}", *at, b[1], b[2]))
    if "inside" in plants and len(devices) > 1:
        devices[1][2] = devices[1][3]
    if "cross" in plants and len(devices) > 2:
        cables.append(("dist-cross", f"distribution|{devices[1][0]}|{devices[-1][0]}", *devices[1][2], *devices[-1][2]))
    if "street" in plants and len(devices) > 1 and paths:
        devices[-1][2] = snap(devices[-1][2], paths)
    return out + [("equipment", d[0], d[1], *d[2], None, None) for d in devices] + [("cable", *c) for c in cables]


@pytest.fixture(scope="module")
def city(spark):
    r = random.Random(5)
    x0, y0, _ = ar.CITIES["nyc"]
    spread = lambda: (x0 + r.uniform(-0.012, 0.012), y0 + r.uniform(-0.012, 0.012))
    buildings = [(i, *spread(), r.choice((0.00002, 0.00005)), (f"{i}a Elm St", "Old Mill", None, f"{i} Oak")[i % 4]) for i in range(2500)]
    buildings += [(5000 + i, b[1] + 0.00003, b[2], 0.00002, None) for i, b in enumerate(buildings[:300])]  # near others
    streets = []
    for i in range(250):
        a = spread()
        streets.append((i, None if i % 9 == 0 else f"S{i % 40}", ("primary", "service", None, "residential", "unclassified")[i % 5], [a, (a[0] + 0.002, a[1] + r.uniform(-0.001, 0.001)), (a[0] + 0.003, a[1])]))
    point = lambda v: {"x": v[0], "y": v[1]}
    b = spark.createDataFrame([(i, x, y, square(x, y, h), a) for i, x, y, h, a in buildings] + [(9999, x0, y0, square(x0, y0, 0.1)[:2], None)], f"id long, x double, y double, footprint {RING}, address string")
    s = spark.createDataFrame([(i, n, h, [point(v) for v in p]) for i, n, h, p in streets], f"street_id long, name string, highway string, line {RING}")
    return buildings, streets, b, s


def requests(spark, rows):
    return spark.createDataFrame(rows, "scene_id long, city string, seed long, size_m double, gap boolean, inside boolean, cross boolean, street boolean")


def test_windows_share_a_centre_by_seed(spark):
    w = {r.scene_id: r for r in ar.windows(requests(spark, [(1, "nyc", 1007, None, *[None] * 4), (2, "nyc", 7, 1400.0, *[None] * 4), (3, "nowhere", 7, 350.0, *[None] * 4), (4, "london", 7, 350.0, *[None] * 4)])).collect()}
    middle = lambda k: (w[k].min_x + w[k].max_x, w[k].min_y + w[k].max_y)
    assert middle(1) == pytest.approx(middle(2)) and middle(1) == pytest.approx(middle(3)) and middle(4) == pytest.approx((2 * (-0.1276 - 0.39 * 0.04), 2 * (51.5074 - 0.13 * 0.04)))
    assert metres(w[2].min_x, w[2].min_y, w[2].min_x, w[2].max_y) == pytest.approx(1400, rel=0.01)


@pytest.mark.parametrize("most", [12, 40])
def test_scenes_equal_those_built_in_sequence(spark, city, most):
    buildings, streets, b, s = city
    flags = [(), ("gap",), ("inside",), ("cross",), ("street",), ar.PLANTS]
    rows = [(k, "nyc", 1000 + k, (350.0, 700.0)[k % 2], *[p in f for p in ar.PLANTS]) for k, f in enumerate(flags * 2)] + [(90, "phoenix", 1, 350.0, None, None, None, None)]
    w = ar.windows(requests(spark, rows))
    boxes = {r.scene_id: [r[n] for n in NAMES] for r in w.collect()}
    got, want = {}, {}
    for r in ar.entities(ar.scenes(w, b, s, most)).collect():
        got[r.scene_id, r.part, r.id, r.info] = tuple(r[4:])
    for k, box in boxes.items():
        want |= {(k, *e[:3]): e[3:] for e in built(box, buildings, streets, most, flags[k % 6] if k < 90 else ())}
    assert set(got) ^ set(want) == set() and 90 not in {k[0] for k in got}
    far = {k: (v, want[k]) for k, v in got.items() if any((x is None) != (y is None) or (x is not None and abs(x - y) > 2e-7) for x, y in zip(v, want[k]))}
    assert far == {}
    assert sum(k[2] == "dist-cross" for k in got) == 4


def test_without_rows_or_streets(spark, city):
    _, _, b, s = city
    w = ar.windows(requests(spark, [(1, "nyc", 50, 350.0, True, True, True, True)]))
    assert ar.entities(ar.scenes(w, b.limit(0), s)).count() == 0
    alone = ar.entities(ar.scenes(w, b, s.limit(0)))
    assert alone.filter("part = 'street'").count() == 0 and alone.filter("id = 'CO-1'").count() == 1


def test_buildings_spread_over_the_window(spark, city):
    buildings, _, b, _ = city
    w = ar.windows(requests(spark, [(k, "nyc", k, 700.0 + 300 * k, *[None] * 4) for k in range(3)]))
    got = {}
    for r in ar.chosen_buildings(w, b, 12, spread=True).collect():
        got.setdefault(r.scene_id, []).append((r.n, r.source))
    for r in w.collect():
        own = [x for x in buildings if r.min_x <= x[1] <= r.max_x and r.min_y <= x[2] <= r.max_y]
        low, high = [min(x[k] for x in own) for k in (1, 2)], [max(x[k] for x in own) for k in (1, 2)]
        size, took = [(b - a) / 4 for a, b in zip(low, high)], []
        apart = lambda x: all(metres(x[1], x[2], o[1], o[2]) >= 8 for o in took)
        for cy in range(4):
            for cx in range(4):
                west, south = low[0] + cx * size[0], low[1] + cy * size[1]
                here = [x for x in own if west - 1e-12 <= x[1] <= west + size[0] + 1e-12 and south - 1e-12 <= x[2] <= south + size[1] + 1e-12 and x not in took]
                if here and len(took) < 12:
                    best = min(here, key=lambda x: (round(metres(x[1], x[2], west + size[0] / 2, south + size[1] / 2), 6), x[0]))
                    took += [best] if apart(best) else []
        middle = [sum(x[k] for x in own) / len(own) for k in (1, 2)]
        for x in sorted(own, key=lambda x: (round(metres(x[1], x[2], *middle), 6), x[0])):
            took += [x] if len(took) < 12 and apart(x) else []
        assert sorted(got[r.scene_id]) == [(k, x[0]) for k, x in enumerate(took)]
