"""Text maps of scenes: two grids over one frame, geography and network, with a legend of exact measurements.

Everything is a table of painted cells: shapes are exploded to cells, every cell takes the paint of the highest priority, and
lines of a grid are put together from the painted cells of a row. A scene is bounded, so is its map. Inputs:

frames     (scene_id, min_x, min_y, max_x, max_y): one row a scene
streets    (scene_id, ord, name, line)
buildings  (scene_id, ord, id, x, y, footprint, type, floors, address)
equipment  (scene_id, ord, id, kind, x, y, serves: array of building ids)
cables     (scene_id, ord, id, kind, source, target, line)

`ord` counts from 0 in the scene's order. Shapes outside a frame are clipped or put on its edge, as points are; scenes without a
frame have no map, and a frame without shapes is a map of dots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions.geo import P
from terrane.functions.stats import half_up
from terrane.operators import spatial as sp

#: Columns of a map, least and most rows, and the markers of buildings and of equipment.
WIDTH, LEAST_ROWS, MOST_ROWS = 48, 6, 28
BUILDING_MARKS, EQUIPMENT_MARKS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNNAMED = r"(?i)^street [0-9]+$"


def framed(frames: DataFrame, width: Column | None = None, zoom: float = 1.0) -> DataFrame:
    """Frames with their grid: columns gw and rows gh, and the degrees cw and ch of a cell."""
    zoom = max(1.0, min(zoom, 2.0))
    low = P(F.col("min_x"), F.col("min_y"))
    wide = F.greatest(F.lit(1.0), geo.haversine(low, P(F.col("max_x"), F.col("min_y"))))
    high = F.greatest(F.lit(1.0), geo.haversine(low, P(F.col("min_x"), F.col("max_y"))))
    gw = F.lit(round(WIDTH * zoom)) if width is None else width
    f = frames.select("scene_id", "min_x", "min_y", "max_x", "max_y", gw.cast("int").alias("gw"), (high / wide).alias("shape"))
    f = f.withColumn("gh", F.greatest(F.lit(LEAST_ROWS), F.least(F.lit(round(MOST_ROWS * zoom)), half_up(F.col("gw") * F.col("shape")))).cast("int")).drop("shape")
    size = lambda a, b, n: F.when(F.col(a) > F.col(b), (F.col(a) - F.col(b)) / F.col(n)).otherwise(1.0)
    return f.withColumns({"cw": size("max_x", "min_x", "gw"), "ch": size("max_y", "min_y", "gh")})


def _cell(p: P) -> tuple[Column, Column]:
    """(column, row) of a point, row 0 in the north; points outside are put on the edge."""
    col = F.floor((p.x - F.col("min_x")) / F.col("cw"))
    row = F.floor(F.col("gh") - (p.y - F.col("min_y")) / F.col("ch"))
    return tuple(F.greatest(F.lit(0), F.least(F.col(n) - 1, v)).cast("int") for v, n in ((col, "gw"), (row, "gh")))


def _metres(p: P) -> tuple[Column, Column]:
    """Whole metres east and north of the frame's south-western corner."""
    return half_up(geo.haversine(P(F.col("min_x"), p.y), p)), half_up(geo.haversine(P(p.x, F.col("min_y")), p))


def _mark(n: Column, marks: str) -> Column:
    return F.when(n < len(marks), F.substring(F.lit(marks), n + 1, F.lit(1))).otherwise("?")


def line_cells(ends: DataFrame) -> DataFrame:
    """ends (c0, r0, c1, r1, ...) once for each cell from one to the other, as (col, row): along the longer side one cell a
    step, across it the nearest cell, halves to the one before."""
    dc, dr = F.col("c1") - F.col("c0"), F.col("r1") - F.col("r0")
    e = ends.withColumns({"_long": F.greatest(F.abs(dc), F.abs(dr)), "_short": F.least(F.abs(dc), F.abs(dr)), "_flat": F.abs(dc) >= F.abs(dr)})
    e = e.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_long"))))
    side = F.coalesce(F.floor(F.try_divide(2 * F.col("_i") * F.col("_short") + F.col("_long") - 1, 2 * F.col("_long"))), F.lit(0))
    step = lambda flat: F.when(F.col("_flat") == flat, F.col("_i")).otherwise(side)
    col, row = F.col("c0") + F.sign(dc) * step(True), F.col("r0") + F.sign(dr) * step(False)
    return e.withColumns({"col": col.cast("int"), "row": row.cast("int")}).drop("_long", "_short", "_flat", "_i")


def _clipped(shapes: DataFrame) -> DataFrame:
    """Segments of lines inside their frame as grid ends, with the number `seg` of each."""
    s = shapes.filter(F.size("line") > 1).withColumn("seg", F.explode(F.sequence(F.lit(0), F.size("line") - 2)))
    at = lambda k: F.get("line", F.col("seg") + k)
    ends = (P(at(k)["x"], at(k)["y"]) for k in (0, 1))
    s = s.withColumn("k", geo.clip(*ends, *(F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")))).filter("k IS NOT NULL")
    (c0, r0), (c1, r1) = _cell(P(F.col("k.x1"), F.col("k.y1"))), _cell(P(F.col("k.x2"), F.col("k.y2")))
    return s.withColumns({"c0": c0, "r0": r0, "c1": c1, "r1": r1})


def _paint(df: DataFrame, prio: int, over: Column, then: Column, glyph: Column) -> DataFrame:
    """Cells with their paint; of one priority the greater (over, then) shows."""
    return df.select("scene_id", "row", "col", F.struct(F.lit(prio).alias("p"), over.cast("long").alias("o"), then.cast("long").alias("t")).alias("rank"), glyph.alias("glyph"))


def _top(cells: DataFrame) -> DataFrame:
    return cells.groupBy("scene_id", "row", "col").agg(F.max_by("glyph", F.struct("rank", "glyph")).alias("glyph"))


def named(streets: DataFrame) -> DataFrame:
    """(scene_id, name, street, orientation, line): streets with a real name, all ways of a name together, as S0, S1, ... in the
    order in which they come; the line is the way with most vertices."""
    real = streets.filter((F.trim("name") != "") & ~F.trim("name").rlike(UNNAMED) & (F.size("line") > 1)).withColumn("name", F.trim("name"))
    side = lambda f, k: f(f(F.transform("line", lambda v: v[k])))
    low = lambda k: F.min(F.array_min(F.transform("line", lambda v: v[k])))
    high = lambda k: F.max(F.array_max(F.transform("line", lambda v: v[k])))
    one = real.groupBy("scene_id", "name").agg(F.min("ord").alias("ord"), F.max_by("line", F.struct(F.size("line"), -F.col("ord"))).alias("line"), low("x").alias("x0"), high("x").alias("x1"), low("y").alias("y0"), high("y").alias("y1"))
    middle = (F.col("y0") + F.col("y1")) / 2
    wide = geo.haversine(P(F.col("x0"), middle), P(F.col("x1"), middle)) >= geo.haversine(P(F.col("x0"), F.col("y0")), P(F.col("x0"), F.col("y1")))
    names = one.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name", F.when(wide, "E-W").otherwise("N-S").alias("orientation"), "line"))).alias("all"))
    each = names.select("scene_id", F.posexplode("all").alias("n", "s"))
    return each.select("scene_id", "s.name", F.concat(F.lit("S"), F.col("n").cast("string")).alias("street"), "s.orientation", "s.line", F.col("n").alias("ord"))


def _stamps(streets: DataFrame, f: DataFrame) -> DataFrame:
    """Cells of the ids of named streets, from the middle vertex eastwards; an id that leaves the grid or meets one before it is
    left out."""
    middle = F.get("line", F.floor(F.size("line") / 2).cast("int"))
    col, row = _cell(P(middle["x"], middle["y"]))
    s = named(streets).join(f, "scene_id").select("scene_id", "gw", F.struct("ord", row.alias("row"), col.alias("col"), F.length("street").alias("n"), "street").alias("s"))
    own = s.groupBy("scene_id").agg(F.max("gw").alias("gw"), F.array_sort(F.collect_list("s")).alias("all"))
    meets = lambda a, b: (a["row"] == b["row"]) & (a["col"] < b["col"] + b["n"]) & (b["col"] < a["col"] + a["n"])
    fits = lambda kept, x: (x["col"] + x["n"] <= F.col("gw")) & ~F.exists(kept, lambda k: meets(k, x))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(fits(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    each = own.select("scene_id", F.explode(kept).alias("s")).select("scene_id", "s.*", F.explode(F.sequence(F.lit(0), F.col("s.n") - 1)).alias("i"))
    return each.select("scene_id", "row", (F.col("col") + F.col("i")).alias("col"), F.substring("street", F.col("i") + 1, F.lit(1)).alias("glyph"))


def geography(f: DataFrame, streets: DataFrame, buildings: DataFrame) -> DataFrame:
    """(scene_id, row, col, glyph): streets (the first to come shows), their ids, footprints with markers, margins beside them."""
    s = _clipped(streets.join(f, "scene_id"))
    flat = F.abs(F.col("k.x2") - F.col("k.x1")) >= F.abs(F.col("k.y2") - F.col("k.y1"))
    ways = _paint(line_cells(s.withColumn("glyph", F.when(flat, "=").otherwise("|"))), 1, -F.col("ord"), -F.col("seg"), F.col("glyph"))
    ids = _paint(_stamps(streets, f), 2, F.lit(0), F.lit(0), F.col("glyph"))
    b = buildings.join(f, "scene_id")
    col, row = _cell(P(F.col("x"), F.col("y")))
    marks = _paint(b.withColumns({"col": col, "row": row}), 3, F.col("ord"), F.lit(1), _mark(F.col("ord"), BUILDING_MARKS))
    at = lambda v: F.struct(((v["x"] - F.col("min_x")) / F.col("cw")).alias("x"), (F.col("gh") - (v["y"] - F.col("min_y")) / F.col("ch")).alias("y"))
    box = b.filter(F.size("footprint") > 0).withColumn("ring", F.transform("footprint", at)).withColumn("b", geo.bounds(F.col("ring")))
    span = lambda k, n: F.sequence(F.greatest(F.lit(0), F.floor(F.col(f"b.min_{k}")).cast("int")), F.least(F.col(n) - 1, F.ceil(F.col(f"b.max_{k}")).cast("int")))
    seen = box.filter("b.max_x >= 0 AND b.max_y >= 0 AND floor(b.min_x) < gw AND floor(b.min_y) < gh")
    cells = seen.withColumn("col", F.explode(span("x", "gw"))).withColumn("row", F.explode(span("y", "gh")))
    fill = _paint(cells.filter(geo.in_ring(P(F.col("col") + 0.5, F.col("row") + 0.5), F.col("ring"))), 3, F.col("ord"), F.lit(0), F.lit("#"))
    solid = ways.unionByName(ids).unionByName(fill).unionByName(marks)
    step = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    near = _top(solid).filter("glyph = '#'").withColumn("s", F.explode(step)).select("scene_id", (F.col("row") + F.col("s.y")).alias("row"), (F.col("col") + F.col("s.x")).alias("col")).distinct()
    inside = near.join(f.select("scene_id", "gw", "gh"), "scene_id").filter("row BETWEEN 0 AND gh - 1 AND col BETWEEN 0 AND gw - 1")
    return _top(solid.unionByName(_paint(inside, 0, F.lit(0), F.lit(0), F.lit(":"))))


def _device_marks(equipment: DataFrame) -> DataFrame:
    """Equipment with its marker: * for an office, @ for a cabinet, letters for the others in order."""
    lettered = ~F.col("kind").isin("co", "cabinet")
    order = equipment.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.when(lettered, F.col("ord")))).alias("others"))
    mark = F.when(F.col("kind") == "co", "*").when(F.col("kind") == "cabinet", "@").otherwise(_mark((F.array_position("others", F.col("ord")) - 1).cast("int"), EQUIPMENT_MARKS))
    return equipment.join(order, "scene_id").withColumn("mark", mark).drop("others")


def network(f: DataFrame, equipment: DataFrame, cables: DataFrame) -> DataFrame:
    """(scene_id, row, col, glyph): cables by their slope, later ones over earlier ones, and equipment over all."""
    c = _clipped(cables.join(f, "scene_id"))
    lines = _paint(line_cells(c.withColumn("glyph", geo.line_glyph(F.col("c1") - F.col("c0"), F.col("r1") - F.col("r0")))), 1, F.col("ord"), F.col("seg"), F.col("glyph"))
    col, row = _cell(P(F.col("x"), F.col("y")))
    return _top(lines.unionByName(_paint(_device_marks(equipment).join(f, "scene_id").withColumns({"col": col, "row": row}), 2, F.col("ord"), F.lit(0), F.col("mark"))))


def grid(f: DataFrame, cells: DataFrame) -> DataFrame:
    """(scene_id, row, line): rows of a grid with their numbers at both ends, a blank between cells, dots for bare cells."""
    rows = cells.groupBy("scene_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "glyph"))).alias("at"))
    every = f.select("scene_id", "gw", F.explode(F.sequence(F.lit(0), F.col("gh") - 1)).alias("row")).join(rows, ["scene_id", "row"], "left")
    drawn = F.array_join(F.transform(F.sequence(F.lit(0), F.col("gw") - 1), lambda c: F.coalesce(F.try_element_at("at", c), F.lit("."))), " ")
    n = F.lpad(F.col("row").cast("string"), 2, "0")
    return every.select("scene_id", "row", F.concat(n, F.lit(" | "), drawn, F.lit(" | "), n).alias("line"))


def _padded(c: str, n: int) -> Column:
    return F.rpad(c, F.greatest(F.lit(n), F.length(c)), F.lit(" "))


def _spot(p: P) -> Column:
    (col, row), (x, y) = _cell(p), _metres(p)
    return F.format_string("(%d,%d)  x=%d y=%d", col, row, x, y)


def legend(f: DataFrame, streets: DataFrame, buildings: DataFrame, equipment: DataFrame, cables: DataFrame) -> DataFrame:
    """(scene_id, section, n, line): what stands where, measured exactly: equipment with the building that holds it, its distance
    from the nearest street and what feeds it; buildings with their distance from the nearest closure, their extent and what
    serves them; outlines; streets; cables. Ties go to the smaller street in order, and to the first in order elsewhere."""
    at = P(F.col("x"), F.col("y"))
    ids = streets.select("scene_id", F.col("ord").alias("street_id"), F.trim("name").alias("name"), "line").filter(F.size("line") > 1)
    ways = ids.withColumn("seg", F.explode(F.sequence(F.lit(0), F.size("line") - 2)))
    side = lambda k, c: F.get("line", F.col("seg") + k)[c]
    ways = ways.select("scene_id", "street_id", "name", side(0, "x").alias("x"), side(0, "y").alias("y"), side(1, "x").alias("bx"), side(1, "y").alias("by"))
    real = ways.filter((F.col("name") != "") & ~F.col("name").rlike(UNNAMED))
    labels = named(streets).select("scene_id", "name", "street")
    near = lambda points, lines: sp.nearest_street(points.select("scene_id", "id", "x", "y"), lines)

    own = buildings.select("scene_id", F.col("id").alias("area"), "footprint", F.col("ord").alias("bord"))
    held = sp.points_in_footprints(equipment, own.withColumnRenamed("area", "id")).join(own.select("scene_id", "area", "bord"), ["scene_id", "area"])
    held = held.groupBy("scene_id", "id").agg(F.min_by("area", "bord").alias("inside"))
    serves = equipment.select("scene_id", "ord", F.col("id").alias("device"), F.posexplode("serves").alias("pos", "area"))
    street = near(equipment, ways).select("scene_id", "id", F.col("d").alias("d_street"))
    known = near(equipment, real).join(labels, ["scene_id", "name"]).select("scene_id", "id", "name", "street")
    by = serves.join(buildings.select("scene_id", F.col("id").alias("area"), "address"), ["scene_id", "area"]).filter("address IS NOT NULL")
    by = by.groupBy("scene_id", F.col("device").alias("id")).agg(F.min_by("address", "pos").alias("address"))
    homes = equipment.groupBy("scene_id").agg(F.min_by("id", F.when(F.col("kind") == "co", F.col("ord"))).alias("up"), F.array_sort(F.collect_list(F.when(F.col("kind") != "co", F.struct("ord", "id")))).alias("fed"))
    e = _device_marks(equipment).join(f, "scene_id").join(homes, "scene_id").join(held, ["scene_id", "id"], "left").join(street, ["scene_id", "id"], "left").join(known, ["scene_id", "id"], "left").join(by, ["scene_id", "id"], "left")
    list_of = F.array_join(F.transform("fed", lambda s: s["id"]), ",")
    when = lambda test, *parts: F.when(test, F.concat(*parts)).otherwise("")
    detail = F.when(F.col("kind") == "co", F.concat(F.lit("source feeds="), list_of)).otherwise(
        F.concat("kind", when(F.size("serves") > 0, F.lit(" serves="), F.array_join("serves", ",")), when(F.col("street").isNotNull(), F.format_string(' on=%s "%s"', "street", "name")), when(F.col("address").isNotNull(), F.format_string(' near "%s"', "address")))
    )
    text = F.concat(
        F.lit("  "), _padded("id", 8), F.lit(" "), "mark", F.lit("  "), _spot(at), F.lit("  "), detail, F.lit(" inside="), F.coalesce("inside", F.lit("none")),
        when(F.col("d_street").isNotNull(), F.format_string(" d_street=%.1fm", "d_street")), F.lit(" street="), F.coalesce("name", F.lit("none")), when(F.col("kind") != "co", F.lit(" up="), F.coalesce("up", F.lit("none"))),
    )
    devices = e.select("scene_id", F.lit("equipment").alias("section"), F.col("ord").cast("long").alias("n"), text.alias("line"))

    closures = equipment.filter("kind = 'closure'").select("scene_id", "id", "x", "y")
    metres = sp.nearest(buildings.select("scene_id", "id", "x", "y"), closures, 1).select("scene_id", "id", F.col("d").alias("d_closure"))
    served = serves.groupBy("scene_id", F.col("area").alias("id")).agg(F.min_by("device", "ord").alias("by"))
    way = near(buildings, real).select("scene_id", "id", "name")
    b = buildings.join(f, "scene_id").join(metres, ["scene_id", "id"], "left").join(served, ["scene_id", "id"], "left").join(way, ["scene_id", "id"], "left")
    spots = F.transform("footprint", lambda v: F.struct(*[m.alias(k) for m, k in zip(_metres(P(v["x"], v["y"])), "xy")]))
    b = b.withColumn("spots", spots)
    span = lambda f_, k: f_(F.transform("spots", lambda v: v[k]))
    extent = F.format_string(" ext=x%d..%d y%d..%d", span(F.array_min, "x"), span(F.array_max, "x"), span(F.array_min, "y"), span(F.array_max, "y"))
    text = F.concat(
        F.lit("  "), _padded("id", 8), F.lit(" "), _mark(F.col("ord"), BUILDING_MARKS), F.lit("  "), _spot(at), F.lit("  "), F.format_string("%s floors=%d", "type", "floors"),
        when(F.col("address").isNotNull(), F.format_string(' addr "%s"', "address")), when(F.col("d_closure").isNotNull(), F.format_string(" d_closure=%.1fm", "d_closure")),
        F.when(F.size("footprint") > 2, extent).otherwise(""), F.lit(" street="), F.coalesce("name", F.lit("none")), F.lit(" served_by="), F.coalesce("by", F.lit("none")),
    )
    houses = b.select("scene_id", F.lit("building").alias("section"), F.col("ord").cast("long").alias("n"), text.alias("line"))
    n = F.size("footprint")
    open_ring = F.slice("spots", 1, F.when((n > 1) & (F.get("footprint", F.lit(0)) == F.get("footprint", n - 1)), n - 1).otherwise(n))
    corners = F.array_join(F.transform(open_ring, lambda v: F.format_string("[%d,%d]", v["x"], v["y"])), " ")
    outlines = b.select("scene_id", F.lit("footprint").alias("section"), F.col("ord").cast("long").alias("n"), F.concat(F.lit("  "), _padded("id", 8), F.lit(" "), corners).alias("line"))
    roads = named(streets).join(f.select("scene_id"), "scene_id")
    roads = roads.select("scene_id", F.lit("street").alias("section"), F.col("ord").cast("long").alias("n"), F.concat(F.lit("  "), _padded("street", 4), F.lit(" "), _padded("orientation", 4), F.lit(" "), "name").alias("line"))
    ends = [F.get("line", F.lit(0)), F.get("line", F.size("line") - 1)]
    (c0, r0), (c1, r1) = (_cell(P(p["x"], p["y"])) for p in ends)
    (x0, y0), (x1, y1) = (_metres(P(p["x"], p["y"])) for p in ends)
    targets = buildings.select("scene_id", F.col("id").alias("target"), F.lit(True).alias("house"))
    c = cables.filter(F.size("line") > 0).join(f, "scene_id").join(targets, ["scene_id", "target"], "left")
    text = F.concat(
        F.lit("  "), _padded("id", 14), F.lit(" "), _padded("kind", 13), F.lit(" "), F.format_string("%s -> %s  (%d,%d)->(%d,%d)  m[%d,%d]->[%d,%d]", "source", "target", c0, r0, c1, r1, x0, y0, x1, y1),
        when(F.col("house").isNotNull(), F.lit("  terminates_in="), "target"),
    )
    wires = c.select("scene_id", F.lit("cable").alias("section"), F.col("ord").cast("long").alias("n"), text.alias("line"))
    return devices.unionByName(houses).unionByName(outlines).unionByName(roads).unionByName(wires)
