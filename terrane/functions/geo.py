"""Geometry on WGS84 coordinates as Column expressions.

A point is a pair of columns (x = longitude, y = latitude); a ring or line is ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>. Distances on
the sphere use haversine with R = 6 371 000 m; distances to segments use a local projection at a reference latitude.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

EARTH_M = 6_371_000.0
LNG_M, LAT_M = 111_320.0, 110_540.0


class P(NamedTuple):
    x: Column
    y: Column


def pt(name: str) -> P:
    """The point in a struct column."""
    return P(F.col(f"{name}.x"), F.col(f"{name}.y"))


def haversine(a: P, b: P) -> Column:
    h = F.pow(F.sin(F.radians(b.y - a.y) / 2), 2) + F.cos(F.radians(a.y)) * F.cos(F.radians(b.y)) * F.pow(F.sin(F.radians(b.x - a.x) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def project(p: P, ref_lat: Column) -> P:
    """Metres east and north in the local frame of a latitude."""
    return P(p.x * LNG_M * F.cos(F.radians(ref_lat)), p.y * LAT_M)


def closest_on_segment(p: P, a: P, b: P, ref_lat: Column) -> Column:
    """Share of the way from a to b (0..1) at which the segment is nearest to p; a segment of no length: 0."""
    q, v, w = (project(k, ref_lat) for k in (p, a, b))
    l2 = F.pow(w.x - v.x, 2) + F.pow(w.y - v.y, 2)
    t = F.try_divide((q.x - v.x) * (w.x - v.x) + (q.y - v.y) * (w.y - v.y), l2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))


def segment_metres(p: P, a: P, b: P, ref_lat: Column | None = None) -> Column:
    """Distance of a point from a segment; the frame is the point's own latitude unless one is given."""
    lat = p.y if ref_lat is None else ref_lat
    t = closest_on_segment(p, a, b, lat)
    q, v, w = (project(k, lat) for k in (p, a, b))
    return F.hypot(q.x - (v.x + t * (w.x - v.x)), q.y - (v.y + t * (w.y - v.y)))


def _at(line: Column, i: Column) -> P:
    k = F.get(line, i)
    return P(k["x"], k["y"])


def polyline_metres(p: P, line: Column) -> Column:
    """Least distance of a point from a line; a line without segments: infinity."""
    each = F.transform(F.sequence(F.lit(0), F.size(line) - 2), lambda i: segment_metres(p, _at(line, i), _at(line, i + 1)))
    return F.when(F.size(line) < 2, F.lit(float("inf"))).otherwise(F.array_min(each))


def snap(p: P, line: Column) -> Column:
    """Struct (d, x, y): the nearest point of a line, interpolated in degrees; the first segment wins ties."""

    def one(i: Column) -> Column:
        a, b = _at(line, i), _at(line, i + 1)
        t = closest_on_segment(p, a, b, p.y)
        return F.struct(segment_metres(p, a, b).alias("d"), i.alias("i"), (a.x + t * (b.x - a.x)).alias("x"), (a.y + t * (b.y - a.y)).alias("y"))

    return F.when(F.size(line) >= 2, F.array_min(F.transform(F.sequence(F.lit(0), F.size(line) - 2), one)))


def _crosses_edge(p: P, a: P, b: P) -> Column:
    """Does the ray from p towards the east pass the edge a-b? Even-odd rule, half open in latitude."""
    spans = (a.y > p.y) != (b.y > p.y)
    return spans & (p.x < F.coalesce(F.try_divide((b.x - a.x) * (p.y - a.y), b.y - a.y), F.lit(0.0)) + a.x)


def in_ring(p: P, ring: Column) -> Column:
    """Point in polygon by the even-odd rule; the ring closes itself. Fewer than one vertex: false."""
    n = F.size(ring)
    hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: _crosses_edge(p, _at(ring, i), _at(ring, F.pmod(i + 1, n))))
    return F.when(n < 1, F.lit(False)).otherwise(F.size(hits) % 2 == 1)


def turn(a: P, b: P, c: P) -> Column:
    """Twice the signed area of a-b-c: above 0 for a left turn."""
    return (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)


def crosses(p1: P, p2: P, p3: P, p4: P, ref_lat: Column | None = None) -> Column:
    """Proper crossing of two segments: touching or collinear ones do not count."""
    a, b, c, d = (k if ref_lat is None else project(k, ref_lat) for k in (p1, p2, p3, p4))
    return (turn(c, d, a) * turn(c, d, b) < 0) & (turn(a, b, c) * turn(a, b, d) < 0)


def touches(p1: P, p2: P, p3: P, p4: P) -> Column:
    """Crossing of two segments where a shared or collinear point counts, in degrees."""

    def on(a: P, b: P, c: P) -> Column:
        return (turn(a, b, c) == 0) & c.x.between(F.least(a.x, b.x), F.greatest(a.x, b.x)) & c.y.between(F.least(a.y, b.y), F.greatest(a.y, b.y))

    return crosses(p1, p2, p3, p4) | on(p3, p4, p1) | on(p3, p4, p2) | on(p1, p2, p3) | on(p1, p2, p4)


def line_meets_ring(line: Column, ring: Column) -> Column:
    """Has a line a vertex inside a ring, or does it properly cross one of the ring's written edges?"""
    lat = F.get(ring, F.lit(0))["y"]
    inside = F.exists(line, lambda v: in_ring(P(v["x"], v["y"]), ring))
    edges = F.sequence(F.lit(0), F.size(ring) - 2)
    cut = F.exists(
        F.sequence(F.lit(0), F.size(line) - 2),
        lambda i: F.exists(edges, lambda j: crosses(_at(line, i), _at(line, i + 1), _at(ring, j), _at(ring, j + 1), lat)),
    )
    return inside | F.when((F.size(line) > 1) & (F.size(ring) > 1), cut).otherwise(False)


def segment_meets_ring(a: P, b: P, ring: Column, mode: str = "closed") -> Column:
    """Segment against polygon. Modes: closed (proper crossing with an implicit closing edge, or an end inside), inclusive
    (touching counts, or an end inside), sampled (one of nine inner points inside), both_ends (proper crossing or both ends)."""
    n = F.size(ring)
    if mode == "sampled":
        return F.exists(F.sequence(F.lit(1), F.lit(9)), lambda k: in_ring(P(a.x + (b.x - a.x) * k / 10, a.y + (b.y - a.y) * k / 10), ring))
    test = touches if mode == "inclusive" else crosses
    edge = F.exists(F.sequence(F.lit(0), n - 1), lambda j: test(a, b, _at(ring, j), _at(ring, F.pmod(j + 1, n))))
    ends = (in_ring(a, ring) & in_ring(b, ring)) if mode == "both_ends" else (in_ring(a, ring) | in_ring(b, ring))
    return F.when(n < 1, F.lit(False)).otherwise(edge | ends)


def _cuts(ax, ay, bx, by, vx, vy, wx, wy) -> np.ndarray:
    """Proper crossings of segments a-b with edges v-w."""
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    return (side(vx, vy, wx, wy, ax, ay) * side(vx, vy, wx, wy, bx, by) < 0) & (side(ax, ay, bx, by, vx, vy) * side(ax, ay, bx, by, wx, wy) < 0)


def _ray_hits(px, py, vx, vy, wx, wy) -> np.ndarray:
    """Edges v-w that a ray to the east of p crosses."""
    level = np.where(wy == vy, 1.0, wy - vy)
    return ((vy > py) != (wy > py)) & (px < (wx - vx) * (py - vy) / level + vx)


@F.arrow_udf(BooleanType())
def meets_ring_both_ends(x: pa.Array, y: pa.Array, bx: pa.Array, by: pa.Array, ring: pa.Array) -> pa.Array:
    """segment_meets_ring() in the mode both_ends for rings of one vertex or more, by batches: the same arithmetic over all edges of all
    pairs at once."""
    n = ring.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
    if not len(n):
        return pa.array([], pa.bool_())
    vx, vy = (c.to_numpy(zero_copy_only=False) for c in ring.flatten().flatten())
    start = np.cumsum(n) - n
    after = np.arange(1, len(vx) + 1)
    after[start + n - 1] = start
    wx, wy = vx[after], vy[after]
    ax, ay, cx, cy = (np.repeat(c.to_numpy(zero_copy_only=False), n) for c in (x, y, bx, by))
    inside = lambda px, py: np.add.reduceat(_ray_hits(px, py, vx, vy, wx, wy).astype("int64"), start) % 2 == 1
    return pa.array(np.logical_or.reduceat(_cuts(ax, ay, cx, cy, vx, vy, wx, wy), start) | (inside(ax, ay) & inside(cx, cy)))


def blocked_inside(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, rings: pa.Array) -> np.ndarray:
    """Which segments a ring of one vertex or more blocks, by the arithmetic of meets_ring_both_ends(): ring by ring, those still free whose box meets
    the ring's."""
    n = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    x, y = (c.to_numpy(zero_copy_only=False) for c in rings.flatten().flatten())
    lx, hx, ly, hy = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
    free = np.arange(len(ax))
    for end, size in zip(np.cumsum(n), n):
        if not size:
            continue
        vx, vy = x[end - size : end], y[end - size : end]
        near = (hx[free] >= np.fmin.reduce(vx)) & (lx[free] <= np.fmax.reduce(vx)) & (hy[free] >= np.fmin.reduce(vy)) & (ly[free] <= np.fmax.reduce(vy))
        if near.any():
            ring = vx, vy, np.roll(vx, -1), np.roll(vy, -1)
            one, two = ((px[free[near], None], py[free[near], None]) for px, py in ((ax, ay), (bx, by)))
            inside = lambda p: _ray_hits(*p, *ring).sum(axis=1) % 2 == 1
            near[near] = _cuts(*one, *two, *ring).any(axis=1) | (inside(one) & inside(two))
            free = free[~near]
    blocked = np.ones(len(ax), dtype=bool)
    blocked[free] = False
    return blocked


def centroid(ring: Column) -> Column:
    """Struct (x, y): mean of the vertices; the last one is left out where it repeats the first."""
    n = F.size(ring)
    closed = (n > 1) & (F.get(ring, F.lit(0)) == F.get(ring, n - 1))
    own = F.slice(ring, 1, F.when(closed, n - 1).otherwise(n))
    mean = lambda k: F.aggregate(own, F.lit(0.0), lambda s, v: s + v[k]) / F.size(own)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def bounds(ring: Column) -> Column:
    side = lambda f, k: f(F.transform(ring, lambda v: v[k]))
    return F.struct(side(F.array_min, "x").alias("min_x"), side(F.array_min, "y").alias("min_y"), side(F.array_max, "x").alias("max_x"), side(F.array_max, "y").alias("max_y"))


def line_metres(line: Column) -> Column:
    """Sum of the great-circle lengths of a line's segments."""
    each = F.transform(F.sequence(F.lit(0), F.size(line) - 2), lambda i: haversine(_at(line, i), _at(line, i + 1)))
    return F.when(F.size(line) < 2, F.lit(0.0)).otherwise(F.aggregate(each, F.lit(0.0), lambda s, d: s + d))


def north_south(p: P, centre: P) -> Column:
    return F.when(p.y > centre.y, "north").otherwise("south")


def compass8(a: P, b: P, margin_deg: float = 6.0, least_m: float = 20.0) -> Column:
    """One of eight directions from a to b; null within margin_deg of a border between two, or nearer than least_m."""
    q, w = project(a, a.y), project(b, a.y)
    deg = F.pmod(F.degrees(F.atan2(w.x - q.x, w.y - q.y)), F.lit(360.0))
    at = F.pmod(F.floor(deg / 45 + 0.5), F.lit(8))
    off = F.abs(deg / 45 - F.floor(deg / 45 + 0.5)) * 45
    name = F.element_at(F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW"))), (at + 1).cast("int"))
    return F.when((F.hypot(w.x - q.x, w.y - q.y) >= least_m) & (off <= 22.5 - margin_deg), name)


def quadrant(p: P, centre: P, margin_m: float = 0.0) -> Column:
    """NE, NW, SE or SW of a centre; null within margin_m of an axis."""
    q, c = project(p, centre.y), project(centre, centre.y)
    name = F.concat(F.when(p.y > centre.y, "N").otherwise("S"), F.when(p.x > centre.x, "E").otherwise("W"))
    return F.when((F.abs(q.x - c.x) >= margin_m) & (F.abs(q.y - c.y) >= margin_m), name)


def direction(a: P, b: P) -> Column:
    """north, south, east or west by the larger difference in degrees."""
    dx, dy = b.x - a.x, b.y - a.y
    return F.when(F.abs(dy) > F.abs(dx), F.when(dy > 0, "north").otherwise("south")).otherwise(F.when(dx > 0, "east").otherwise("west"))


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def clip(a: P, b: P, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Struct (x1, y1, x2, y2): the part of a segment inside a rectangle; null where none is. Parametric clipping."""
    dx, dy = b.x - a.x, b.y - a.y
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    outside = F.lit(False)
    for d, q in ((-dx, a.x - min_x), (dx, max_x - a.x), (-dy, a.y - min_y), (dy, max_y - a.y)):
        r = F.try_divide(q, d)
        enter.append(F.when(d < 0, r).otherwise(F.lit(0.0)))
        leave.append(F.when(d > 0, r).otherwise(F.lit(1.0)))
        outside = outside | ((d == 0) & (q < 0))
    t0, t1 = F.greatest(*enter), F.least(*leave)
    got = F.struct((a.x + t0 * dx).alias("x1"), (a.y + t0 * dy).alias("y1"), (a.x + t1 * dx).alias("x2"), (a.y + t1 * dy).alias("y2"))
    return F.when(~outside & (t0 <= t1), got)


def segment_degrees(p: P, a: P, b: P) -> Column:
    """Distance of a point from a segment in degrees, without projection."""
    l2 = F.pow(b.x - a.x, 2) + F.pow(b.y - a.y, 2)
    t = F.coalesce(F.try_divide((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y), l2), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(p.x - (a.x + t * (b.x - a.x)), p.y - (a.y + t * (b.y - a.y)))


def bearing(a: P, b: P) -> Column:
    """Initial great-circle bearing from a to b in degrees, 0 to 360 from north."""
    dx = F.radians(b.x - a.x)
    north = F.cos(F.radians(a.y)) * F.sin(F.radians(b.y)) - F.sin(F.radians(a.y)) * F.cos(F.radians(b.y)) * F.cos(dx)
    return F.pmod(F.degrees(F.atan2(F.sin(dx) * F.cos(F.radians(b.y)), north)), F.lit(360.0))


def destination(a: P, metres: Column, degrees: Column) -> P:
    """The point so many metres from a in a direction."""
    d, t, y = metres / EARTH_M, F.radians(degrees), F.radians(a.y)
    lat = F.asin(F.sin(y) * F.cos(d) + F.cos(y) * F.sin(d) * F.cos(t))
    lng = F.radians(a.x) + F.atan2(F.sin(t) * F.sin(d) * F.cos(y), F.cos(d) - F.sin(y) * F.sin(lat))
    return P(F.degrees(lng), F.degrees(lat))


def line_glyph(dc: Column, dr: Column) -> Column:
    """Character of a line on a grid: flat or steep beyond 2 to 1, else one of the diagonals (rows run southwards)."""
    flat, steep = F.abs(dc) >= 2 * F.abs(dr), F.abs(dr) >= 2 * F.abs(dc)
    return F.when(flat, "-").when(steep, "|").when((dc > 0) == (dr > 0), "\\").otherwise("/")


def in_service_area(p: P, ring: Column) -> Column:
    """Inside a ring; an area of fewer than four vertices takes everything in."""
    return F.coalesce(F.size(ring) < 4, F.lit(True)) | F.coalesce(in_ring(p, ring), F.lit(False))
