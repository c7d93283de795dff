"""Layered text grids of scenes: a base of roads, pavements and buildings, routes over it, work (equipment and cables), and the
composite of work over base, with what each cell hides; and what can be read back from the text of a grid.

Every layer is a table of painted cells (scene_id, col, row, glyph); row 0 is in the north. A scene is bounded by its grid, so
everything about a cell is a join on (scene_id, col, row), shifted where a neighbour is meant.

Inputs: streets (scene_id, street_id, name, x, y, bx, by), buildings (scene_id, id, x, y, footprint), equipment (scene_id, id, kind, x, y),
cables (scene_id, x, y, bx, by); frames (scene_id, min_x, min_y, max_x, max_y).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from terrane.functions import geo
from terrane.functions.geo import P
from terrane.operators.textmap import line_cells

#: Size of a grid, symbols, cells of pavement around buildings, and how far neighbourhoods and frontages are searched.
WIDTH, HEIGHT = 100, 50
BUILDING, PAVEMENT, ROAD_H, ROAD_V, ROAD_X = "▓", "░", "═", "║", "╬"
DEVICES = {"co": "★", "cabinet": "◆", "closure": "●", "den": "●", "house": "○"}
CABLE_H, CABLE_V, CORRIDOR, JUNCTION = "─", "│", "·", "+"
PAVEMENT_CELLS, SEARCH_CELLS, FRONTAGE_CELLS = 2, 10, 5
ACCESS_M, CLOSE_M = 15.0, 5.0
KINDS = {BUILDING: "building", ROAD_H: "road", ROAD_V: "road", ROAD_X: "intersection", PAVEMENT: "sidewalk", " ": "empty", "◆": "cabinet", "★": "co", "○": "house"}


def framed(frames: DataFrame, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Frames with the cells w and h of their grids, and the degrees cw and ch of a cell."""
    w, h = F.lit(WIDTH) if width is None else width, F.lit(HEIGHT) if height is None else height
    cells = lambda a, b, n: (F.col(b) - F.col(a)) / n
    return frames.select("scene_id", "min_x", "min_y", "max_x", "max_y", w.alias("w"), h.alias("h"), cells("min_x", "max_x", w).alias("cw"), cells("min_y", "max_y", h).alias("ch"))


def cell_of(x: Column, y: Column) -> tuple[Column, Column]:
    """Column and row of a point in the row's frame; points outside are put on the edge."""
    held = lambda v, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, v)).cast("int")
    return held(F.floor((x - F.col("min_x")) / F.col("cw")), "w"), held(F.col("h") - 1 - F.floor((y - F.col("min_y")) / F.col("ch")), "h")


def _lines(f: DataFrame, lines: DataFrame) -> DataFrame:
    """Cells of straight lines (x, y, bx, by), with `flat`: wider than high in degrees."""
    (c0, r0), (c1, r1) = cell_of(F.col("x"), F.col("y")), cell_of(F.col("bx"), F.col("by"))
    flat = F.abs(F.col("bx") - F.col("x")) >= F.abs(F.col("by") - F.col("y"))
    return line_cells(lines.join(f, "scene_id").withColumns({"c0": c0, "r0": r0, "c1": c1, "r1": r1, "flat": flat}))


@F.arrow_udf(ArrayType(StructType([StructField(c, IntegerType()) for c in ("row", "lo", "hi")])))
def _ring_runs(ring: pa.Array) -> pa.Array:
    """Runs of cells in the rows inside rings of cells by the rule of geo.in_ring, a ring at a time over its box; null for a ring without
    vertices."""
    sizes = ring.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    x, y = (c.to_numpy(zero_copy_only=False) for c in ring.flatten().flatten())
    runs, n, first = [], [], 0
    for size in sizes:
        vx, vy = x[first : first + size], y[first : first + size]
        first += size
        if not size:
            n.append(0)
            continue
        wx, wy = np.roll(vx, -1), np.roll(vy, -1)
        c, r = np.arange(vx.min(), vx.max() + 1), np.arange(vy.min(), vy.max() + 1)[:, None]
        level = np.where(wy == vy, 1.0, wy - vy)
        at = (wx - vx) * (r - vy) / level + vx  # where a row meets an edge
        spans = (vy > r) != (wy > r)
        hits = (spans[:, :, None] & (c < at[:, :, None])).sum(axis=1) % 2 == 1
        edge = np.diff(np.pad(hits.astype("int8"), ((0, 0), (1, 1))), axis=1)
        (at_row, lo), (_, hi) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        runs.append(np.stack([r[at_row, 0], c[0] + lo, c[0] + hi - 1]).astype("int32"))
        n.append(len(lo))
    flat = np.concatenate([np.empty((3, 0), "int32"), *runs], axis=1)
    ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype("int32"), mask=np.concatenate([sizes == 0, [False]]))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(k) for k in flat], ["row", "lo", "hi"]))


def _rings(f: DataFrame, buildings: DataFrame) -> DataFrame:
    """(scene_id, id, c, r, runs): the own cell of buildings, and the runs of cells inside their footprints drawn on the grid."""
    on = lambda v, i: cell_of(v["x"], v["y"])[i].cast("double")
    b = buildings.join(f, "scene_id").withColumn("ring", F.transform("footprint", lambda v: F.struct(on(v, 0).alias("x"), on(v, 1).alias("y"))))
    at = cell_of(F.col("x"), F.col("y"))
    return b.select("scene_id", "id", at[0].alias("c"), at[1].alias("r"), _ring_runs("ring").alias("runs"))


def building_runs(f: DataFrame, buildings: DataFrame) -> DataFrame:
    """(scene_id, id, row, lo, hi): runs of cells whose place is inside a footprint drawn on the grid."""
    return _rings(f, buildings).select("scene_id", "id", F.explode("runs").alias("k")).select("scene_id", "id", "k.row", "k.lo", "k.hi")


def building_cells(f: DataFrame, buildings: DataFrame, own_cell: bool = True) -> DataFrame:
    """(scene_id, id, col, row): cells whose place is inside a footprint drawn on the grid; the building's own cell where none is, unless
    own_cell is false."""
    b = _rings(f, buildings)
    inside = F.flatten(F.transform("runs", lambda k: F.transform(F.sequence(k["lo"], k["hi"]), lambda c: F.struct(c.alias("col"), k["row"].alias("row")))))
    own = F.when(F.size(inside) > 0, inside).otherwise(F.array(F.struct(F.col("c").alias("col"), F.col("r").alias("row"))))
    return b.select("scene_id", "id", F.explode(own if own_cell else inside).alias("k")).select("scene_id", "id", "k.col", "k.row")


def _around(cells: DataFrame, n: int) -> DataFrame:
    """cells (with col and row) once for every cell at most n away in both directions, as (dc, dr) and (ncol, nrow), on the grid or not."""
    steps = F.sequence(F.lit(-n), F.lit(n))
    each = cells.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    return each.withColumns({"ncol": F.col("col") + F.col("dc"), "nrow": F.col("row") + F.col("dr")})


def road_cells(f: DataFrame, streets: DataFrame) -> DataFrame:
    """(scene_id, col, row, glyph): roads, with a crossing where one that lies meets one that stands."""
    g = _lines(f, streets).groupBy("scene_id", "col", "row").agg(F.bool_or("flat").alias("h"), F.bool_or(~F.col("flat")).alias("v"))
    return g.select("scene_id", "col", "row", F.when(F.col("h") & F.col("v"), ROAD_X).when(F.col("h"), ROAD_H).otherwise(ROAD_V).alias("glyph"))


def pavement(f: DataFrame, cells: DataFrame) -> DataFrame:
    """(scene_id, col, row): cells of the grid near the given ones."""
    near = _around(cells.join(f.select("scene_id", "w", "h"), "scene_id"), PAVEMENT_CELLS).filter("ncol BETWEEN 0 AND w - 1 AND nrow BETWEEN 0 AND h - 1")
    return near.select("scene_id", F.col("ncol").alias("col"), F.col("nrow").alias("row")).distinct()


def base(f: DataFrame, streets: DataFrame, buildings: DataFrame) -> DataFrame:
    """Buildings over roads over the pavement around buildings."""
    b = building_cells(f, buildings).select("scene_id", "col", "row").distinct()
    near = pavement(f, b)
    layers = b.withColumns({"p": F.lit(3), "glyph": F.lit(BUILDING)}).unionByName(road_cells(f, streets).withColumn("p", F.lit(2))).unionByName(near.withColumns({"p": F.lit(1), "glyph": F.lit(PAVEMENT)}))
    return layers.groupBy("scene_id", "col", "row").agg(F.max_by("glyph", "p").alias("glyph"))


def route(f: DataFrame, streets: DataFrame) -> DataFrame:
    """Corridors along streets, with a junction at both ends of each."""
    cells = _lines(f, streets).withColumn("end", ((F.col("col") == F.col("c0")) & (F.col("row") == F.col("r0"))) | ((F.col("col") == F.col("c1")) & (F.col("row") == F.col("r1"))))
    g = cells.groupBy("scene_id", "col", "row").agg(F.bool_or("end").alias("end"))
    return g.select("scene_id", "col", "row", F.when(F.col("end"), JUNCTION).otherwise(CORRIDOR).alias("glyph"))


def work(f: DataFrame, equipment: DataFrame, cables: DataFrame) -> DataFrame:
    """Equipment over cables; of several devices in a cell the one with the smallest id."""
    c, r = cell_of(F.col("x"), F.col("y"))
    glyph = F.element_at(F.create_map(*[F.lit(x) for p in DEVICES.items() for x in p]), F.col("kind"))
    e = equipment.join(f, "scene_id").select("scene_id", c.alias("col"), r.alias("row"), "id", glyph.alias("glyph")).groupBy("scene_id", "col", "row").agg(F.min_by("glyph", "id").alias("glyph"))
    lines = _lines(f, cables).groupBy("scene_id", "col", "row").agg(F.bool_or("flat").alias("h"))
    lines = lines.select("scene_id", "col", "row", F.when(F.col("h"), CABLE_H).otherwise(CABLE_V).alias("glyph"))
    both = e.withColumn("p", F.lit(2)).unionByName(lines.withColumn("p", F.lit(1)))
    return both.groupBy("scene_id", "col", "row").agg(F.max_by("glyph", "p").alias("glyph"))


def composite(under: DataFrame, over: DataFrame) -> DataFrame:
    """(scene_id, col, row, glyph, hidden): the upper layer where it is painted, else the lower one; hidden: what is covered."""
    both = under.withColumnRenamed("glyph", "low").join(over.withColumnRenamed("glyph", "high"), ["scene_id", "col", "row"], "full_outer")
    return both.select("scene_id", "col", "row", F.coalesce("high", "low").alias("glyph"), F.when(F.col("high").isNotNull(), F.col("low")).alias("hidden"))


def text(f: DataFrame, cells: DataFrame) -> DataFrame:
    """(scene_id, row, line): all rows of the grids, blanks where nothing is painted."""
    rows = cells.groupBy("scene_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "glyph"))).alias("at"))
    every = f.select("scene_id", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("row")).join(rows, ["scene_id", "row"], "left")
    every = every.withColumn("at", F.filter("at", lambda k: k["col"].between(0, F.col("w") - 1)))
    gap = lambda k, i: k["col"] - F.when(i == 0, 0).otherwise(F.get("at", i - 1)["col"] + 1)
    drawn = F.array_join(F.transform("at", lambda k, i: F.concat(F.repeat(F.lit(" "), gap(k, i)), k["glyph"])), "")
    return every.select("scene_id", "row", F.rpad(F.coalesce(drawn, F.lit("")), F.col("w"), F.lit(" ")).alias("line"))


def parsed(lines: DataFrame) -> DataFrame:
    """(scene_id, col, row, glyph) of every character of a grid's text."""
    chars = F.filter(F.split("line", ""), lambda c: c != "")
    return lines.select("scene_id", "row", F.posexplode(chars).alias("col", "glyph"))


def neighbourhoods(lines: DataFrame, closures: DataFrame, f: DataFrame) -> DataFrame:
    """What stands around closures (scene_id, id, x, y) by the text of their scene's grid: the kind of the four cells beside them, the
    distance of the first road and building that a scan of widening squares meets (row by row, up to ten cells), the three
    nearest other closures on the grid, and whether they have access to a road, stand on a pavement, or should move."""
    c, r = cell_of(F.col("x"), F.col("y"))
    east = geo.haversine(P(F.col("min_x"), F.col("min_y")), P(F.col("max_x"), F.col("min_y"))) / F.col("w")
    north = geo.haversine(P(F.col("min_x"), F.col("min_y")), P(F.col("min_x"), F.col("max_y"))) / F.col("h")
    own = closures.join(f, "scene_id").select("scene_id", "id", c.alias("col"), r.alias("row"), east.alias("mx"), north.alias("my"))
    cells = parsed(lines).select("scene_id", F.col("col").alias("ncol"), F.col("row").alias("nrow"), "glyph")
    seen = _around(own, SEARCH_CELLS).filter((F.col("dc") != 0) | (F.col("dr") != 0)).join(cells, ["scene_id", "ncol", "nrow"], "left")
    order = F.struct(F.greatest(F.abs("dc"), F.abs("dr")), "dr", "dc")
    metres = F.sqrt(F.pow(F.col("dr") * F.col("my"), 2) + F.pow(F.col("dc") * F.col("mx"), 2))
    first = lambda *glyphs: F.min_by(F.when(F.col("glyph").isin(*glyphs), metres), F.when(F.col("glyph").isin(*glyphs), order))
    kind = F.when(F.col("glyph").isNull(), "zone_edge").otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("glyph")), F.lit("other")))
    beside = lambda dc, dr: F.max(F.when((F.col("dc") == dc) & (F.col("dr") == dr), kind))
    g = seen.groupBy("scene_id", "id", "col", "row", "mx", "my").agg(
        beside(0, -1).alias("north"), beside(0, 1).alias("south"), beside(1, 0).alias("east"), beside(-1, 0).alias("west"),
        first(ROAD_H, ROAD_V, ROAD_X).alias("road_m"), first(BUILDING).alias("building_m"),
    )
    other = own.select("scene_id", F.col("id").alias("other"), F.col("col").alias("ocol"), F.col("row").alias("orow"))
    apart = F.sqrt(F.pow((F.col("ocol") - F.col("col")) * F.col("mx"), 2) + F.pow((F.col("orow") - F.col("row")) * F.col("my"), 2))
    rank = F.row_number().over(Window.partitionBy("scene_id", "id").orderBy(F.round("d", 6), "other"))
    near = own.join(other, "scene_id").filter("id <> other").withColumn("d", apart).withColumn("k", rank).filter("k <= 3")
    near = near.groupBy("scene_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("other").cast("string").alias("o")))), lambda s: s["o"]), ",").alias("nearest"))
    sides = F.array("north", "south", "east", "west")
    walk = F.array_contains(sides, "sidewalk") | F.array_contains(sides, "road")
    close = F.coalesce(F.col("building_m") <= CLOSE_M, F.lit(False))
    return g.join(near, ["scene_id", "id"], "left").select(
        "scene_id", "id", "col", "row", "north", "south", "east", "west", "road_m", "building_m", "nearest",
        F.coalesce(F.col("road_m") <= ACCESS_M, F.lit(False)).alias("road_access"), walk.alias("on_sidewalk"), close.alias("near_building"), (~walk | close).alias("move"),
    )


def registry(f: DataFrame, streets: DataFrame, buildings: DataFrame) -> DataFrame:
    """(scene_id, id, cells, col, row, facing, frontage) of buildings: how many cells they take, the road cell nearest to their own
    cell (by steps along rows and columns, up to five each way, first in scan order), the way it lies, and its street."""
    size = building_cells(f, buildings).groupBy("scene_id", "id").agg(F.count("*").alias("cells"))
    c, r = cell_of(F.col("x"), F.col("y"))
    own = buildings.join(f, "scene_id").select("scene_id", "id", c.alias("col"), r.alias("row"))
    roads = _lines(f, streets).groupBy("scene_id", F.col("col").alias("ncol"), F.col("row").alias("nrow")).agg(F.min_by("name", "street_id").alias("street"))
    near = _around(own, FRONTAGE_CELLS).join(roads, ["scene_id", "ncol", "nrow"])
    best = near.groupBy("scene_id", "id").agg(F.min_by(F.struct("ncol", "nrow", "dc", "dr", "street"), F.struct(F.abs("dc") + F.abs("dr"), "dr", "dc")).alias("s"))
    wide = F.abs("s.dc") >= F.abs("s.dr")
    facing = F.when(wide, F.when(F.col("s.dc") >= 0, "east").otherwise("west")).otherwise(F.when(F.col("s.dr") >= 0, "south").otherwise("north"))
    return size.join(best, ["scene_id", "id"], "left").select("scene_id", "id", "cells", F.col("s.ncol").alias("col"), F.col("s.nrow").alias("row"), F.when(F.col("s").isNotNull(), facing).alias("facing"), F.col("s.street").alias("frontage"))


def corridors(f: DataFrame, streets: DataFrame, blocked: DataFrame) -> DataFrame:
    """(scene_id, id, name, run, first, last, cells): a street's cells that no building covers (blocked: scene_id, col, row), as runs without
    a gap in the order along the street."""
    along = F.greatest(F.abs(F.col("col") - F.col("c0")), F.abs(F.col("row") - F.col("r0")))
    free = _lines(f, streets).withColumn("k", along).join(blocked.select("scene_id", "col", "row").distinct(), ["scene_id", "col", "row"], "left_anti")
    w = Window.partitionBy("scene_id", "street_id").orderBy("k")
    run = free.withColumn("run", F.col("k") - F.row_number().over(w))
    g = run.groupBy("scene_id", "street_id", "name", "run").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("cells"))
    return g.select("scene_id", F.col("street_id").alias("id"), "name", F.row_number().over(Window.partitionBy("scene_id", "street_id").orderBy("first")).alias("run"), "first", "last", "cells")
