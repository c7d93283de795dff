"""Routing around buildings against a plain search over all cells."""

import heapq
import math
import random

from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.operators import gridroute as gro

RING = "array<struct<x: double, y: double>>"


def plain(gw, gh, closed, weight, start, goal):
    """Least cost by relaxing all cells until nothing changes."""
    cost = {start: 0.0}
    changed = True
    while changed:
        changed = False
        for c in list(cost):
            for dc in (-1, 0, 1):
                for dr in (-1, 0, 1):
                    to = c[0] + dc, c[1] + dr
                    if to == c or not (0 <= to[0] < gw and 0 <= to[1] < gh) or (to in closed and to != goal):
                        continue
                    if dc and dr and ((to[0], c[1]) in closed or (c[0], to[1]) in closed):
                        continue
                    new = cost[c] + (1.4142 if dc and dr else 1.0) * weight(to)
                    if new < cost.get(to, math.inf) - 1e-12:
                        cost[to], changed = new, True
    return cost.get(goal, math.inf)


def test_search_costs_what_the_plain_search_costs():
    rng = random.Random(3)
    for _ in range(40):
        gw, gh = rng.randint(2, 14), rng.randint(2, 14)
        cells = [(c, r) for c in range(gw) for r in range(gh)]
        closed, slow = set(rng.sample(cells, len(cells) // 3)), set(rng.sample(cells, len(cells) // 3))
        start, goal = rng.choice(cells), rng.choice(cells)
        weight = lambda c: 6.0 if c in slow else 1.0  # noqa: E731, B023
        way, cost = gro.search(gw, gh, closed, weight, start, goal)
        assert abs(cost - plain(gw, gh, closed, weight, start, goal)) < 1e-9 or (cost == math.inf and not way)
        assert not way or (way[0], way[-1]) == (start, goal)
    assert gro.nearest_open((1, 1), {(1, 1), (0, 0)}, 3, 3) == (1, 0)
    assert gro.turns([(0, 0), (1, 0), (2, 0), (3, 1)]) == [(0, 0), (2, 0), (3, 1)]


def test_ways_keep_clear_of_buildings_and_streets(spark):
    east, north = geo.LNG_M * math.cos(math.radians(40.0)), geo.LAT_M
    at = lambda e, n: (10 + e / east, 40 + n / north)
    (x0, y0), (x1, y1) = at(0, 0), at(200, 120)
    f = gro.framed(spark.createDataFrame([(1, x0, y0, x1, y1)], "scene_id int, min_x double, min_y double, max_x double, max_y double"))
    assert (f.head().gw, f.head().gh) == (80, 48)
    wall = [at(*p) for p in ((96, 20), (104, 20), (104, 120), (96, 120), (96, 20))]
    b = spark.createDataFrame([(1, 7, [{"x": x, "y": y} for x, y in wall])], f"scene_id int, id long, footprint {RING}")
    s = spark.createDataFrame([(1, *at(100, 0), *at(100, 16))], "scene_id int, x double, y double, bx double, by double")
    closed, slow = gro.closed_cells(f, b), gro.street_cells(f, s)
    assert {(r.col, r.row) for r in closed.collect()} == {(c, r) for c in range(38, 42) for r in range(7, 48)}
    assert closed.count() < gro.closed_cells(f, b, 5.0).count()
    q = spark.createDataFrame([(1, "through", *at(50, 60), *at(150, 60)), (1, "in", *at(50, 60), *at(100, 60)), (2, "lost", 0.0, 0.0, 1.0, 1.0)], "scene_id int, request string, x double, y double, bx double, by double")
    got = {r.request: r for r in gro.routed(q, f, closed, slow).collect()}
    assert set(got) == {"through", "in"} and got["through"].cost > 60
    line = got["through"].line
    assert (line[0].x, line[0].y) == at(50, 60) and (line[-1].x, line[-1].y) == at(150, 60) and min(p.y for p in line) < at(0, 20)[1]
    hit = spark.createDataFrame([(line,)], f"line {RING}").crossJoin(b).select(geo.line_meets_ring(F.col("line"), F.col("footprint")).alias("h")).head().h
    assert not hit


def slow_search(gw, gh, closed, weight, start, goal):
    """The search cell by cell, with sets and pairs."""
    far = lambda c: (lambda a, b: max(a, b) - min(a, b) + gro.DIAGONAL * min(a, b))(abs(c[0] - goal[0]), abs(c[1] - goal[1]))
    cost, came, heap, done = {start: 0.0}, {}, [(far(start), start)], set()
    while heap:
        _, at = heapq.heappop(heap)
        if at == goal:
            way = [at]
            while way[-1] in came:
                way.append(came[way[-1]])
            return way[::-1], cost[at]
        if at in done:
            continue
        done.add(at)
        for dc in (-1, 0, 1):
            for dr in (-1, 0, 1):
                to = at[0] + dc, at[1] + dr
                if to == at or not (0 <= to[0] < gw and 0 <= to[1] < gh) or (to in closed and to != goal):
                    continue
                if dc and dr and ((to[0], at[1]) in closed or (at[0], to[1]) in closed):
                    continue
                new = cost[at] + (gro.DIAGONAL if dc and dr else 1.0) * weight(to)
                if new < cost.get(to, math.inf):
                    cost[to], came[to] = new, at
                    heapq.heappush(heap, (new + far(to), to))
    return [], math.inf


def test_of_equal_ways_the_same_one_is_taken():
    rng = random.Random(9)
    for _ in range(150):
        gw, gh = rng.randint(1, 25), rng.randint(1, 25)
        cells = [(c, r) for c in range(gw) for r in range(gh)]
        closed, slow = set(rng.sample(cells, len(cells) // rng.choice([3, 6]))), set(rng.sample(cells, len(cells) // 4))
        start, goal = rng.choice(cells), rng.choice(cells)
        weight = lambda c: gro.STREET_COST if c in slow - closed else 1.0  # noqa: E731, B023
        assert gro.cheapest(gw, gh, gro.walled(gw, gh, closed, slow), start, goal) == slow_search(gw, gh, closed, weight, start, goal)


def test_scenes_of_few_bytes_are_dealt_to_the_tasks(spark):
    """The requests of all scenes of a small table went to one task."""
    scenes = spark.range(40).select(F.col("id").cast("int").alias("scene_id"))
    f = gro.framed(scenes.select("scene_id", F.lit(10.0).alias("min_x"), F.lit(40.0).alias("min_y"), F.lit(10.001).alias("max_x"), F.lit(40.001).alias("max_y")))
    asked = scenes.select("scene_id", F.lit("a").alias("request"), F.lit(10.0001).alias("x"), F.lit(40.0001).alias("y"), F.lit(10.0009).alias("bx"), F.lit(40.0009).alias("by"))
    none = spark.createDataFrame([], "scene_id int, col int, row int")
    got = gro.routed(asked, f, none, none)
    assert got.count() == 40 and got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
