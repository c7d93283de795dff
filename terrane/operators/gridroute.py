"""Ways around buildings on a weighted grid: cells near a footprint are closed, cells on streets cost more, and the cheapest way of
each request is found inside its scene.

Closing and weighting cells is done for all scenes at once: every footprint and street meets only the cells around it, by exact
distances in metres. A scene's grid has at most MOST_CELLS cells a side, so the search of a request is bounded.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions.geo import P
from terrane.functions.stats import half_up
from terrane.operators.graph import settled
from terrane.operators.spatial import spread
from terrane.operators.textmap import line_cells

#: Metres of a cell and of clearance, cost of a cell on a street, cells of a side, reach of a street in cells, diagonal.
CELL_M, CLEARANCE_M, STREET_COST, LEAST_CELLS, MOST_CELLS, STREET_CELLS, DIAGONAL = 2.5, 1.8, 6.0, 8, 140, 1.6, 1.4142


def framed(frames: DataFrame) -> DataFrame:
    """Frames (scene_id, min_x, min_y, max_x, max_y) with their grid: gw, gh and the degrees cw and ch of a cell."""
    low = P(F.col("min_x"), F.col("min_y"))
    side = lambda to: F.greatest(F.lit(LEAST_CELLS), F.least(F.lit(MOST_CELLS), half_up(F.greatest(F.lit(1.0), geo.haversine(low, to)) / CELL_M))).cast("int")
    f = frames.select("scene_id", "min_x", "min_y", "max_x", "max_y", side(P(F.col("max_x"), F.col("min_y"))).alias("gw"), side(P(F.col("min_x"), F.col("max_y"))).alias("gh"))
    return f.withColumns({"cw": (F.col("max_x") - F.col("min_x")) / F.col("gw"), "ch": (F.col("max_y") - F.col("min_y")) / F.col("gh")})


def _cell(x: Column, y: Column) -> tuple[Column, Column]:
    held = lambda v, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, F.floor(v))).cast("int")
    return held((x - F.col("min_x")) / F.col("cw"), "gw"), held((y - F.col("min_y")) / F.col("ch"), "gh")


def _centre() -> P:
    return P(F.col("min_x") + (F.col("col") + 0.5) * F.col("cw"), F.col("min_y") + (F.col("row") + 0.5) * F.col("ch"))


def closed_cells(f: DataFrame, buildings: DataFrame, clearance: float = CLEARANCE_M) -> DataFrame:
    """(scene_id, col, row): cells whose centre is inside a footprint or nearer than clearance to its outline."""
    b = spread(buildings.join(f, "scene_id"), "scene_id", "id").withColumn("b", geo.bounds(F.col("footprint")))
    wide, high = clearance / (geo.LNG_M * F.cos(F.radians(F.greatest(F.abs("b.min_y"), F.abs("b.max_y"))))), clearance / geo.LAT_M
    (c0, r0), (c1, r1) = _cell(F.col("b.min_x") - 2 * wide, F.col("b.min_y") - 2 * high), _cell(F.col("b.max_x") + 2 * wide, F.col("b.max_y") + 2 * high)
    cells = b.withColumn("col", F.explode(F.sequence(c0, c1))).withColumn("row", F.explode(F.sequence(r0, r1)))
    near = geo.in_ring(_centre(), F.col("footprint")) | (geo.polyline_metres(_centre(), F.col("footprint")) < clearance)
    return cells.filter(near).select("scene_id", "col", "row").distinct()


def street_cells(f: DataFrame, streets: DataFrame) -> DataFrame:
    """(scene_id, col, row): cells whose centre is within STREET_CELLS cells (of CELL_M) of a street (scene_id, x, y, bx, by)."""
    reach = STREET_CELLS * CELL_M
    (c0, r0), (c1, r1) = _cell(F.col("x"), F.col("y")), _cell(F.col("bx"), F.col("by"))
    on = line_cells(spread(streets.select("scene_id", "x", "y", "bx", "by").join(f, "scene_id"), "scene_id", "x", "y").withColumns({"c0": c0, "r0": r0, "c1": c1, "r1": r1}))
    around = lambda c, degrees, metres: F.explode(F.sequence(F.col(c) - 2 - F.floor(reach / (F.col(degrees) * metres)).cast("int"), F.col(c) + 2 + F.floor(reach / (F.col(degrees) * metres)).cast("int")))
    east = geo.LNG_M * F.cos(F.radians("y"))
    near = on.withColumn("nc", around("col", "cw", east)).withColumn("nr", around("row", "ch", F.lit(geo.LAT_M))).drop("col", "row").withColumnsRenamed({"nc": "col", "nr": "row"})
    near = near.filter(F.col("col").between(0, F.col("gw") - 1) & F.col("row").between(0, F.col("gh") - 1))
    near = near.select("scene_id", "min_x", "min_y", "cw", "ch", "col", "row", "x", "y", "bx", "by").distinct()
    metres = geo.segment_metres(_centre(), P(F.col("x"), F.col("y")), P(F.col("bx"), F.col("by")))
    return near.filter(metres < reach).select("scene_id", "col", "row").distinct()


def nearest_open(at: tuple[int, int], closed: set, gw: int, gh: int) -> tuple[int, int]:
    """The cell itself, or the first open one of widening squares around it, row by row."""
    if at not in closed:
        return at
    for n in range(1, max(gw, gh)):
        for row in range(at[1] - n, at[1] + n + 1):
            for col in range(at[0] - n, at[0] + n + 1):
                if 0 <= col < gw and 0 <= row < gh and (col, row) not in closed:
                    return col, row
    return at


def walled(gw: int, gh: int, closed: set, slow: set) -> list[float]:
    """Weights of the cells of a grid by their place (col + 1) * (gh + 2) + row + 1: 0 where closed and on the frame around, STREET_COST
    where slow, else 1."""
    high = gh + 2
    weight = [0.0] * high + ([0.0, *[1.0] * gh, 0.0] * gw) + [0.0] * high
    for cells, w in ((slow, STREET_COST), (closed, 0.0)):
        for c, r in cells:
            weight[(c + 1) * high + r + 1] = w
    return weight


def search(gw: int, gh: int, closed: set, weight: Callable[[tuple[int, int]], float], start: tuple[int, int], goal: tuple[int, int]) -> tuple[list[tuple[int, int]], float]:
    """cheapest() with closed cells and weights that are given cell by cell."""
    table = walled(gw, gh, closed, set())
    for at in ((c, r) for c in range(gw) for r in range(gh) if (c, r) not in closed):
        table[(at[0] + 1) * (gh + 2) + at[1] + 1] = weight(at)
    return cheapest(gw, gh, table, start, goal, weight(goal))


def cheapest(gw: int, gh: int, weight: list[float], start: tuple[int, int], goal: tuple[int, int], entry: float = 1.0) -> tuple[list[tuple[int, int]], float]:
    """The cheapest way over eight neighbours and its cost ([], infinity: none). weight: walled(). Entering a cell costs its weight, of 1 at
    least, so the straight distance (in DIAGONAL's measure) is never too much. Closed cells are not entered, but for the goal (at
    the weight `entry`), and a diagonal step does not cut a closed corner. Places sort as their (column, row) do."""
    high = gh + 2
    first, last = (start[0] + 1) * high + start[1] + 1, (goal[0] + 1) * high + goal[1] + 1
    gc, gr = goal[0] + 1, goal[1] + 1
    away = [abs(i - gr) for i in range(high)]
    far: list[float | None] = [None] * len(weight)
    cost, came = [math.inf] * len(weight), [-1] * len(weight)
    done = bytearray(len(weight))
    slant = DIAGONAL
    steps = tuple((dc * high + dr, dc * high, dr, bool(dc and dr)) for dc in (-1, 0, 1) for dr in (-1, 0, 1) if dc or dr)
    a, b = abs(first // high - gc), away[first % high]
    cost[first] = 0.0
    heap = [(max(a, b) - min(a, b) + slant * min(a, b), first)]
    push, pop, inf = heapq.heappush, heapq.heappop, math.inf
    while heap:
        _, at = pop(heap)
        if at == last:
            way = [at]
            while came[way[-1]] >= 0:
                way.append(came[way[-1]])
            return [(p // high - 1, p % high - 1) for p in way[::-1]], cost[at]
        if done[at]:
            continue
        done[at] = 1
        own = cost[at]
        for by, across, down, both in steps:
            to = at + by
            w = weight[to]
            if w == 0.0:
                if to != last:
                    continue
                w = entry
            if both:
                if weight[at + across] == 0.0 or weight[at + down] == 0.0:
                    continue
                new = own + slant * w
            else:
                new = own + w
            if new < cost[to]:
                cost[to], came[to] = new, at
                f = far[to]
                if f is None:
                    a, b = abs(to // high - gc), away[to % high]
                    f = far[to] = a - b + slant * b if a > b else b - a + slant * a
                push(heap, (new + f, to))
    return [], inf


def turns(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Points without those that lie on the line between the ones before and after."""
    kept = [
        b for a, b, d in zip(points, points[1:], points[2:])
        if abs((b[0] - a[0]) * (d[1] - b[1]) - (b[1] - a[1]) * (d[0] - b[0])) > 1e-12
    ]
    return [points[0], *kept, points[-1]] if len(points) > 1 else points


WAY = "scene_id int, request string, cost double, line array<struct<x: double, y: double>>"


def routed(requests: DataFrame, f: DataFrame, closed: DataFrame, streets: DataFrame) -> DataFrame:
    """(scene_id, request, cost, line) of requests (scene_id, request, x, y, bx, by): the cheapest way between the open cells nearest to
    both ends, as the turns of a line from the exact beginning to the exact end; cost and line are null where there is none.
    f: framed(); closed and streets: closed_cells() and street_cells()."""
    cells = closed.withColumn("closed", F.lit(True)).unionByName(streets.withColumn("closed", F.lit(False)))

    def one(asked: pd.DataFrame, marked: pd.DataFrame) -> pd.DataFrame:
        shut = set(zip(marked["col"][marked["closed"]], marked["row"][marked["closed"]]))
        slow = set(zip(marked["col"][~marked["closed"]], marked["row"][~marked["closed"]]))
        rows, weight = [], None
        for q in asked.sort_values("request").itertuples(index=False):
            gw, gh = int(q.gw), int(q.gh)
            at = lambda x, y: (min(gw - 1, max(0, math.floor((x - q.min_x) / q.cw))), min(gh - 1, max(0, math.floor((y - q.min_y) / q.ch))))  # noqa: E731, B023
            start, goal = (nearest_open(at(x, y), shut, gw, gh) for x, y in ((q.x, q.y), (q.bx, q.by)))
            weight = walled(gw, gh, shut, slow) if weight is None else weight
            way, cost = cheapest(gw, gh, weight, start, goal)
            line = turns([(q.min_x + (c + 0.5) * q.cw, q.min_y + (r + 0.5) * q.ch) for c, r in way])
            line = [(q.x, q.y), *line[1:-1], (q.bx, q.by)]
            rows.append((q.scene_id, q.request, cost if way else None, [{"x": x, "y": y} for x, y in line] if way else None))
        return pd.DataFrame(rows, columns=["scene_id", "request", "cost", "line"])

    asked = settled(requests.select("scene_id", "request", "x", "y", "bx", "by").join(f.drop("max_x", "max_y"), "scene_id"))  # so that spread() deals it anew
    return spread(asked, "scene_id").groupBy("scene_id").cogroup(spread(cells, "scene_id").groupBy("scene_id")).applyInPandas(one, WAY)


def laid(cables: DataFrame, ways: DataFrame) -> DataFrame:
    """cables (scene_id, cable_id, kind, source, target, ...) with the line of the way that was asked for by their id, and its metres;
    a cable without a way keeps none."""
    line = ways.select("scene_id", F.col("request").alias("cable_id"), "cost", "line", geo.line_metres(F.col("line")).alias("metres"))
    return cables.join(line, ["scene_id", "cable_id"], "left")
