"""Spatial joins without nested loops: both sides are dealt to grid cells and joined on them, then tested exactly.

All joins take DataFrames with columns scene_id, id, x, y. A cell join shuffles by (scene, cell), so a dense scene is spread
over its cells; what a cell holds is bounded by the density, not by the size of the scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions.geo import P
from terrane.operators.graph import settled

CELL = 0.001
FEW = 2_048  # rows of a scene that each row may be compared with


def _around(metres: float, size: float) -> Column:
    """The cells that a circle around a point may touch, exploded as (cx, cy). Its width in degrees grows towards the poles."""
    high = metres / 110_000.0
    wide = metres / (110_000.0 * F.cos(F.radians(F.least(F.lit(89.5), F.abs("y") + high))))
    xs = F.sequence(geo.cell(F.col("x") - wide, size), geo.cell(F.col("x") + wide, size))
    ys = F.sequence(geo.cell(F.col("y") - high, size), geo.cell(F.col("y") + high, size))
    return F.explode(F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("cx"), j.alias("cy"))))))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as the session names: rows that are few in bytes may still be long work."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def _by_cell(left: DataFrame, right: DataFrame, dealt: bool) -> DataFrame:
    """left and right joined by scene and cell; `dealt`: by as many tasks as the session names, and nothing by way of the driver."""
    key = ("scene_id", "cx", "cy")
    return spread(left, *key).join(spread(right, *key).hint("merge"), list(key)) if dealt else left.join(right, list(key))


def cells_of_box(df: DataFrame, min_x: str, min_y: str, max_x: str, max_y: str, size: float = CELL) -> DataFrame:
    """df once for every cell that its box touches, with columns cx and cy."""
    xs = F.sequence(geo.cell(F.col(min_x), size), geo.cell(F.col(max_x), size))
    ys = F.sequence(geo.cell(F.col(min_y), size), geo.cell(F.col(max_y), size))
    return df.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


def points_in_footprints(points: DataFrame, areas: DataFrame, size: float = CELL) -> DataFrame:
    """(scene_id, id, area) of points inside footprints, by cells and the even-odd test."""
    box = areas.select("scene_id", F.col("id").alias("area"), "footprint", geo.bounds(F.col("footprint")).alias("b")).select("*", "b.*").drop("b")
    right = cells_of_box(box, "min_x", "min_y", "max_x", "max_y", size)
    left = points.withColumns({"cx": geo.cell(F.col("x"), size), "cy": geo.cell(F.col("y"), size)})
    near = left.join(right, ["scene_id", "cx", "cy"]).filter("x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y")
    return near.filter(geo.in_ring(P(F.col("x"), F.col("y")), F.col("footprint"))).select("scene_id", "id", "area")


def _near_footprints(segments: DataFrame, areas: DataFrame, size: float, dealt: bool = False) -> DataFrame:
    """segments (with x, y, bx, by) with the footprints whose box theirs meets, once for each cell that both touch."""
    box = areas.select("scene_id", F.col("id").alias("area"), "footprint", geo.bounds(F.col("footprint")).alias("b")).select("*", "b.*").drop("b")
    right = cells_of_box(box, "min_x", "min_y", "max_x", "max_y", size)
    seg = segments.withColumns({"lx": F.least("x", "bx"), "ly": F.least("y", "by"), "hx": F.greatest("x", "bx"), "hy": F.greatest("y", "by")})
    seg = segment_cells(seg, size)
    return _by_cell(seg, right, dealt).filter("hx >= min_x AND lx <= max_x AND hy >= min_y AND ly <= max_y")


def segments_through_footprints(segments: DataFrame, areas: DataFrame, size: float = CELL, mode: str | None = None) -> DataFrame:
    """segments (with x, y, bx, by) joined with the footprints they pass through, as column `area`; with a mode by the test of that
    name (geo.segment_meets_ring)."""
    near = _near_footprints(segments, areas, size)
    line = F.array(F.struct("x", "y"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    test = geo.segment_meets_ring(P(F.col("x"), F.col("y")), P(F.col("bx"), F.col("by")), F.col("footprint"), mode) if mode else geo.line_meets_ring(line, F.col("footprint"))
    return near.filter(test).select(*segments.columns, "area").distinct()


def segments_blocked(segments: DataFrame, areas: DataFrame, size: float = CELL) -> DataFrame:
    """Those of segments (with x, y, bx, by) that properly cross a footprint's outline or have both ends in one: the test both_ends, by
    batches of pairs. A segment may come more than once."""
    near = _near_footprints(segments, areas, size, dealt=True)
    return near.filter(geo.meets_ring_both_ends("x", "y", "bx", "by", "footprint")).select(*segments.columns)


def met_within(left: DataFrame, right: DataFrame, metres: float, dealt: bool = True) -> DataFrame:
    """Rows of left (scene_id, x, y, ...) with those of right (scene_id, bx, by, ...) no farther away than `metres` (haversine), and the
    column of that name, by cells of about that size; other columns go along. Up to 89 degrees of latitude; a circle that
    passes the date line is cut there."""
    size = metres / 80_000.0
    own = left.select("*", _around(metres, size).alias("c")).select(*left.columns, "c.cx", "c.cy")
    others = right.withColumns({"cx": geo.cell(F.col("bx"), size), "cy": geo.cell(F.col("by"), size)})
    d = geo.haversine(P(F.col("x"), F.col("y")), P(F.col("bx"), F.col("by")))
    return _by_cell(own, others, dealt).withColumn("metres", d).filter(F.col("metres") <= metres).drop("cx", "cy")


def within_metres(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """(scene_id, id, other, d) of pairs of left and right (scene_id, id, x, y) no farther apart than metres, as of met_within()."""
    others = right.select("scene_id", F.col("id").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return met_within(left.select("scene_id", "id", "x", "y"), others, metres, dealt=False).select("scene_id", "id", "other", F.col("metres").alias("d"))


def crowded(df: DataFrame) -> bool:
    """Has a scene more than FEW rows?"""
    return not df.groupBy("scene_id").agg(F.count("*").alias("n")).filter(F.col("n") > FEW).isEmpty()


def span(*tables: DataFrame) -> float:
    """Metres from corner to corner of the widest scene of tables (scene_id, x, y)."""
    both = tables[0].select("scene_id", "x", "y")
    for t in tables[1:]:
        both = both.unionByName(t.select("scene_id", "x", "y"))
    low, high = P(F.min("x"), F.min("y")), P(F.max("x"), F.max("y"))
    width = F.greatest(geo.haversine(low, high), geo.haversine(P(low.x, high.y), P(high.x, low.y)))
    return both.groupBy("scene_id").agg(width.alias("m")).agg(F.max("m")).head()[0] or 0.0


def _by_rings(todo: DataFrame, found_within, k: int, start_m: float, most_m: float) -> DataFrame:
    """Rows (scene_id, id, ..., rank) of the k best that found_within(todo, metres) gives with their rank, for growing circles: rows with k
    hits inside a circle are done, as anything outside it is farther; a circle as wide as the scene holds all."""
    done, metres = None, start_m
    while True:
        best = settled(found_within(todo, metres).filter(F.col("rank") <= k))
        if metres >= 1.01 * most_m + 1:
            return best if done is None else done.unionByName(best)
        full = best.filter(F.col("rank") == k).select("scene_id", "id")
        part = best.join(full, ["scene_id", "id"], "left_semi")
        done = part if done is None else done.unionByName(part)
        todo = settled(todo.join(full, ["scene_id", "id"], "left_anti"))
        if todo.isEmpty():
            return done
        metres *= 4


def nearest(left: DataFrame, right: DataFrame, k: int = 1, start_m: float = 200.0, rings: bool | None = None) -> DataFrame:
    """(scene_id, id, other, d, rank) of the k nearest of right for every row of left, distances equal to a micrometre tie, to the smaller
    id; itself excluded.

    Where no scene of right has more than FEW rows, rows are compared with their scene: one join, linear in left. Else
    (or with rings) they look in growing circles, by cells: within start_m first, then four times as far, until k are found.
    """
    rank = F.row_number().over(Window.partitionBy("scene_id", "id").orderBy(F.round("d", 6), "other"))
    ranked = lambda pairs: pairs.filter("id <> other").withColumn("rank", rank)
    if not (crowded(right) if rings is None else rings):
        others = right.select("scene_id", F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        d = geo.haversine(P(F.col("x"), F.col("y")), P(F.col("ox"), F.col("oy")))
        return ranked(left.join(others, "scene_id").select("scene_id", "id", "other", d.alias("d"))).filter(F.col("rank") <= k)
    left, right = settled(left.select("scene_id", "id", "x", "y")), settled(right.select("scene_id", "id", "x", "y"))
    return _by_rings(left, lambda todo, metres: ranked(within_metres(todo, right, metres)), k, start_m, span(left, right))


def segment_cells(segments: DataFrame, size: float) -> DataFrame:
    """segments (with x, y, bx, by) once for every cell (cx, cy) that they run through: per column of cells, the rows between where a
    segment enters and leaves it."""
    low, high = F.least("x", "bx"), F.greatest("x", "bx")
    seg = segments.withColumn("cx", F.explode(F.sequence(geo.cell(low, size), geo.cell(high, size))))
    slope = F.try_divide(F.col("by") - F.col("y"), F.col("bx") - F.col("x"))
    at = lambda x: F.col("y") + slope * (x - F.col("x"))
    enter, leave = at(F.greatest(low, F.col("cx") * size)), at(F.least(high, (F.col("cx") + 1) * size))
    lo = F.when(slope.isNull(), F.least("y", "by")).otherwise(F.least(enter, leave))
    hi = F.when(slope.isNull(), F.greatest("y", "by")).otherwise(F.greatest(enter, leave))
    return seg.withColumn("cy", F.explode(F.sequence(geo.cell(lo - size * 1e-6, size), geo.cell(hi + size * 1e-6, size))))


def segments_within(points: DataFrame, streets: DataFrame, metres: float) -> DataFrame:
    """(scene_id, id, street_id, name, d) of streets (scene_id, street_id, name, x, y, bx, by) no farther than metres from points, by the
    cells that a street runs through and those that a circle touches."""
    size = metres / 80_000.0
    own = points.select("scene_id", "id", "x", "y", _around(metres, size).alias("c")).select("scene_id", "id", "x", "y", "c.cx", "c.cy")
    side = segment_cells(streets.select("scene_id", "street_id", "name", "x", "y", "bx", "by"), size).withColumnsRenamed({"x": "sx", "y": "sy"})
    d = geo.segment_metres(P(F.col("x"), F.col("y")), P(F.col("sx"), F.col("sy")), P(F.col("bx"), F.col("by")))
    near = own.join(side, ["scene_id", "cx", "cy"]).withColumn("d", d).filter(F.col("d") <= metres)
    return near.groupBy("scene_id", "id", "street_id").agg(F.first("name").alias("name"), F.first("d").alias("d"))  # once for all cells


def nearest_street(points: DataFrame, streets: DataFrame, start_m: float = 100.0, rings: bool | None = None) -> DataFrame:
    """(scene_id, id, street_id, name, d): the nearest street of the scene; distances equal to a micrometre tie, to the smaller id.

    Where no scene has more than FEW streets, points are compared with their scene's; else (or with rings) they look in growing
    circles among the streets indexed by the cells that they run through.
    """
    if not (crowded(streets) if rings is None else rings):
        d = geo.segment_metres(P(F.col("x"), F.col("y")), P(F.col("sx"), F.col("sy")), P(F.col("bx"), F.col("by")))
        side = streets.select("scene_id", "street_id", "name", F.col("x").alias("sx"), F.col("y").alias("sy"), "bx", "by")
        pairs = points.select("scene_id", "id", "x", "y").join(side, "scene_id").withColumn("d", d)
        best = pairs.groupBy("scene_id", "id").agg(F.min_by(F.struct("street_id", "name", "d"), F.struct(F.round("d", 6), "street_id")).alias("s"))
        return best.select("scene_id", "id", "s.*")
    points = settled(points.select("scene_id", "id", "x", "y"))
    streets = settled(streets.select("scene_id", "street_id", "name", "x", "y", "bx", "by"))
    ends = streets.select("scene_id", F.col("bx").alias("x"), F.col("by").alias("y"))
    rank = F.row_number().over(Window.partitionBy("scene_id", "id").orderBy(F.round("d", 6), "street_id"))
    found = lambda todo, metres: segments_within(todo, streets, metres).withColumn("rank", rank)
    return _by_rings(points, found, 1, start_m, span(points, streets, ends)).drop("rank")


def coverage_gaps(buildings: DataFrame, closures: DataFrame, metres: float = 35.0) -> DataFrame:
    """Buildings with no closure within metres."""
    covered = within_metres(buildings, closures, metres).select("scene_id", "id").distinct()
    return buildings.join(covered, ["scene_id", "id"], "left_anti")


def rank_of_midpoint(pairs: DataFrame, buildings: DataFrame, k: int = 2) -> DataFrame:
    """Nearest buildings to the midpoints of pairs (scene_id, id, x, y, bx, by)."""
    mids = pairs.select("scene_id", "id", ((F.col("x") + F.col("bx")) / 2).alias("x"), ((F.col("y") + F.col("by")) / 2).alias("y"))
    return nearest(mids, buildings, k)
