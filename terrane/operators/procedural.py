"""Operators that are sequential within a scene or a request: hulls, greedy merges, grid lines, routes, generators.

Each runs as a grouped function over Arrow batches with the scene as the group; a scene is a small document by definition, and
rows of a group are ordered by `ord` before anything else.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hull_order(xy: list[tuple[float, float]]) -> list[int]:
    """Places of the hull's corners, counter-clockwise from the leftmost; collinear points are left out."""
    order = sorted(range(len(xy)), key=lambda i: xy[i])
    if len(order) < 3:
        return order

    def half(places: list[int]) -> list[int]:
        kept: list[int] = []
        for p in places:
            while len(kept) > 1:
                (ax, ay), (bx, by), (cx, cy) = xy[kept[-2]], xy[kept[-1]], xy[p]
                if (bx - ax) * (cy - ay) > (by - ay) * (cx - ax):
                    break
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return half(order) + half(order[::-1])


def convex_hull(points: DataFrame) -> DataFrame:
    """(scene_id, id, place): corners of each scene's hull in order."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        at = hull_order(list(zip(g["x"], g["y"])))
        return pd.DataFrame({"scene_id": g["scene_id"].iloc[at].astype("int32"), "id": g["id"].iloc[at], "place": range(len(at))})

    return points.select("scene_id", "id", "x", "y").groupBy("scene_id").applyInPandas(one, "scene_id int, id long, place int")


def cells_on_line(c0: int, r0: int, c1: int, r1: int) -> Iterator[tuple[int, int]]:
    """Grid cells from one cell to another, error-driven, ends included."""
    dc, dr, sc, sr = abs(c1 - c0), -abs(r1 - r0), 1 if c0 < c1 else -1, 1 if r0 < r1 else -1
    error = dc + dr
    while True:
        yield c0, r0
        if (c0, r0) == (c1, r1):
            return
        twice = 2 * error
        if twice >= dr:
            error, c0 = error + dr, c0 + sc
        if twice <= dc:
            error, r0 = error + dc, r0 + sr


def grid_lines(segments: DataFrame) -> DataFrame:
    """(scene_id, key, col, row) of the cells under each segment (scene_id, key, c0, r0, c1, r1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, k, c, r) for s, k, *ends in b[["scene_id", "key", "c0", "r0", "c1", "r1"]].itertuples(index=False) for c, r in cells_on_line(*map(int, ends))]
            yield pd.DataFrame(rows, columns=["scene_id", "key", "col", "row"])

    return segments.mapInPandas(run, "scene_id int, key string, col int, row int")


def text_map(cells: DataFrame) -> DataFrame:
    """(scene_id, row, line) from painted cells (scene_id, row, col, prio, glyph): the highest priority shows, the first column
    is the least one of the scene; cells without paint are dots."""
    top = cells.groupBy("scene_id", "row", "col").agg(F.max_by("glyph", F.struct("prio", "glyph")).alias("glyph"))
    frame = top.groupBy("scene_id").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"))
    every = frame.select("scene_id", "c0", "c1", F.explode(F.sequence("r0", "r1")).alias("row")).select("scene_id", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    painted = every.join(top, ["scene_id", "row", "col"], "left")
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("glyph", F.lit(".")).alias("g")))), lambda s: s["g"]), "")
    return painted.groupBy("scene_id", "row").agg(line.alias("line"))


def merge_nearby(points: DataFrame, metres: float) -> DataFrame:
    """(scene_id, id, into): in order of id, a point joins the first kept point within metres, else it is kept."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        g = g.sort_values("id")
        kept: list[tuple[float, float, int]] = []
        into = []
        for i, x, y in zip(g["id"], g["x"], g["y"]):
            k = 111_320.0 * np.cos(np.radians(y))
            hit = next((j for kx, ky, j in kept if np.hypot((x - kx) * k, (y - ky) * 110_540.0) <= metres), None)
            if hit is None:
                kept.append((x, y, i))
            into.append(i if hit is None else hit)
        return pd.DataFrame({"scene_id": g["scene_id"].astype("int32"), "id": g["id"], "into": into})

    return points.select("scene_id", "id", "x", "y").groupBy("scene_id").applyInPandas(one, "scene_id int, id long, into long")


def route(width: int, height: int, blocked: set[tuple[int, int]], start: tuple[int, int], goal: tuple[int, int], extra: dict[tuple[int, int], float] | None = None) -> list[tuple[int, int]]:
    """Cheapest way on a grid with eight neighbours around blocked cells; extra: cost of entering cells, 1 unless given. []: none."""
    extra = extra or {}
    cost, came, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        _, at = heapq.heappop(heap)
        if at == goal:
            way = [at]
            while way[-1] in came:
                way.append(came[way[-1]])
            return way[::-1]
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                to = (at[0] + dx, at[1] + dy)
                if to == at or to in blocked or not (0 <= to[0] < width and 0 <= to[1] < height):
                    continue
                new = cost[at] + (dx * dx + dy * dy) ** 0.5 * extra.get(to, 1.0)
                if new < cost.get(to, float("inf")):
                    cost[to], came[to] = new, at
                    heapq.heappush(heap, (new + max(abs(goal[0] - to[0]), abs(goal[1] - to[1])) * min(1.0, *extra.values(), 1.0), to))
    return []


def route_requests(requests: DataFrame, blocked: DataFrame, width: int = 140, height: int = 140) -> DataFrame:
    """(request, step, col, row): one way per request (scene_id, request, c0, r0, c1, r1) around the scene's blocked cells
    (scene_id, col, row). The ends of a request are never blocked; a request without a way gives no rows."""

    def one(r: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        walls = set(zip(b["col"], b["row"]))
        rows = []
        for q in r.itertuples(index=False):
            way = route(width, height, walls - {(q.c0, q.r0), (q.c1, q.r1)}, (q.c0, q.r0), (q.c1, q.r1))
            rows += [(q.request, i, c, w) for i, (c, w) in enumerate(way)]
        return pd.DataFrame(rows, columns=["request", "step", "col", "row"])

    return requests.groupBy("scene_id").cogroup(blocked.groupBy("scene_id")).applyInPandas(one, "request string, step int, col int, row int")


def mulberry32(seed: int) -> Iterator[float]:
    """The 32-bit generator of the scene sources: numbers in [0, 1)."""
    state, mask = seed & 0xFFFFFFFF, 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & mask
        t = ((state ^ state >> 15) * (state | 1)) & mask
        t ^= (t + ((t ^ t >> 7) * (t | 61) & mask)) & mask
        yield ((t ^ t >> 14) & mask) / 2**32


def synthetic_scenes(specs: DataFrame) -> DataFrame:
    """Buildings (scene_id, ord, id, col, row, type, floors) of grid towns (scene_id, seed, cols, rows): drawn in order, type
    before floors, one generator a scene."""
    kinds = ("residential", "commercial", "mixed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s in b.itertuples(index=False):
                draw = mulberry32(int(s.seed))
                for k in range(int(s.cols) * int(s.rows)):
                    rows.append((s.scene_id, k, f"B{k + 1}", k % int(s.cols), k // int(s.cols), kinds[int(next(draw) * 3)], 1 + int(next(draw) * 6)))
            yield pd.DataFrame(rows, columns=["scene_id", "ord", "id", "col", "row", "type", "floors"])

    return specs.mapInPandas(run, "scene_id int, ord int, id string, col int, row int, type string, floors int")
