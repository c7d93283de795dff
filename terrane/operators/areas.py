"""Scenes of areas: windows over a city chosen by seed, the buildings and streets in them, and a small network laid on them.

A window holds a bounded part of the city and its scene at most MOST buildings and streets of a bounded number, so what depends
on an order within a scene is a fold over one array value, and scenes run in parallel. Windows find their content by grid cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions.geo import P
from terrane.operators import spatial as sp

#: Centres of cities and how far windows stray from them (degrees), sizes in metres, and what a scene is made of.
CITIES = {"tel-aviv": (34.7806, 32.0809, 0.02), "nyc": (-73.984, 40.7549, 0.02), "london": (-0.1276, 51.5074, 0.04), "phoenix": (-112.05, 33.585, 0.03)}
OTHERWISE = "nyc"
SIZE_M, APART_M, MARGIN, MOST, STREETS = 350.0, 8.0, 0.002, 40, 60
PAVEMENT_M, PAVEMENT_SHARE = 4.0, 0.35
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEFT_OUT = ("service", "unclassified")
PLANTS = ("gap", "inside", "cross", "street")


def windows(requests: DataFrame) -> DataFrame:
    """requests (scene_id, city, seed, size_m, ...) with min_x, min_y, max_x, max_y: a square around a place that depends on city and seed
    alone, so sizes of one seed have one centre. Unknown cities: nyc. Size null: 350 m."""
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for c, v in CITIES.items() for x in (c, v[k])]), F.when(F.col("city").isin(*CITIES), F.col("city")).otherwise(OTHERWISE))
    stray = lambda m: ((F.col("seed") * m % 100) / 100 - 0.5) * of(2)
    size = F.coalesce("size_m", F.lit(SIZE_M))
    w = requests.withColumns({"_x": of(0) + stray(73), "_y": of(1) + stray(91), "_s": size / 2})
    high, wide = F.col("_s") / geo.LAT_M, F.col("_s") / (geo.LNG_M * F.cos(F.radians("_y")))
    return w.withColumns({"min_x": F.col("_x") - wide, "max_x": F.col("_x") + wide, "min_y": F.col("_y") - high, "max_y": F.col("_y") + high}).drop("_x", "_y", "_s")


def split_address(text: Column) -> tuple[Column, Column]:
    """House number and street of `number street`; without a number in front: null and the whole text."""
    number = F.nullif(F.regexp_extract(text, r"^([0-9]\S*)\s+(.+)$", 1), F.lit(""))
    return number, F.when(number.isNotNull(), F.regexp_extract(text, r"^([0-9]\S*)\s+(.+)$", 2)).otherwise(F.nullif(text, F.lit("")))


def _in_windows(rows: DataFrame, w: DataFrame) -> DataFrame:
    """(scene_id and the columns of rows) for every window that holds the row's place (x, y), edges included."""
    cells = sp.cells_of_box(w.select("scene_id", "min_x", "min_y", "max_x", "max_y"), "min_x", "min_y", "max_x", "max_y")
    at = rows.withColumns({"cx": geo.cell(F.col("x"), sp.CELL), "cy": geo.cell(F.col("y"), sp.CELL)})
    return at.join(cells, ["cx", "cy"]).filter("x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y").select("scene_id", *rows.columns)


def _middle(ring: Column, k: str) -> Column:
    """Mean of a ring's vertices, a repeated last one left out."""
    open_ = F.when((F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    return F.aggregate(F.transform(open_, lambda v: v[k]), F.lit(0.0), lambda a, x: a + x) / F.size(open_)


def _one_a_cell(b: DataFrame, most: int) -> DataFrame:
    """(scene_id, first): for each cell of a grid over the places (mx, my) of a scene, of at least `most` cells, the building nearest to its
    middle, row by row from the south-west. A place between two cells is in the one that comes first."""
    k = math.ceil(math.sqrt(most))
    box = b.groupBy("scene_id").agg(F.min("mx").alias("x0"), F.max("mx").alias("x1"), F.min("my").alias("y0"), F.max("my").alias("y1"))
    width = lambda a, z: F.when(F.col(z) > F.col(a), (F.col(z) - F.col(a)) / k).otherwise(1e-9)
    c = b.join(box, "scene_id").withColumns({"cw": width("x0", "x1"), "ch": width("y0", "y1")})
    cell = lambda v, a, w: F.greatest(F.lit(0), F.least(F.lit(k - 1), F.ceil((F.col(v) - F.col(a)) / F.col(w)) - 1))
    c = c.withColumns({"cx": cell("mx", "x0", "cw"), "cy": cell("my", "y0", "ch")})
    d = F.round(geo.haversine(P(F.col("mx"), F.col("my")), P(F.col("x0") + (F.col("cx") + 0.5) * F.col("cw"), F.col("y0") + (F.col("cy") + 0.5) * F.col("ch"))), 6)
    best = c.groupBy("scene_id", "cx", "cy").agg(F.min_by(F.struct("id", "mx", "my"), F.struct(d, F.col("id"))).alias("s"))
    row = F.struct((F.col("cy") * k + F.col("cx")).cast("double").alias("d"), F.col("s.id").alias("id"), F.col("s.mx").alias("x"), F.col("s.my").alias("y"))
    return best.groupBy("scene_id").agg(F.array_sort(F.collect_list(row)).alias("first"))


def chosen_buildings(w: DataFrame, buildings: DataFrame, most: int = 12, spread: bool = False) -> DataFrame:
    """(scene_id, n, source, x, y, footprint, number, street, type, floors) of the buildings (id, x, y: centre, footprint, address: text) of a
    scene: from the middle of all in the window outwards, each that is at least 8 m from those taken before it, up to `most` (1 to 40). With spread, one for each cell of a grid over all
    comes first, so that the choice grows with the window."""
    most = max(1, min(most, MOST))
    b = _in_windows(buildings.filter(F.size("footprint") >= 3), w).withColumns({"mx": _middle(F.col("footprint"), "x"), "my": _middle(F.col("footprint"), "y")})
    middle = b.groupBy("scene_id").agg(F.avg("mx").alias("ox"), F.avg("my").alias("oy"))
    d = F.round(geo.haversine(P(F.col("mx"), F.col("my")), P(F.col("ox"), F.col("oy"))), 6)
    sorted_ = b.join(middle, "scene_id").groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct(d.alias("d"), "id", F.col("mx").alias("x"), F.col("my").alias("y")))).alias("all"))
    if spread:
        sorted_ = sorted_.join(_one_a_cell(b, most), "scene_id").select("scene_id", F.concat("first", "all").alias("all"))
    near = lambda k, x: geo.haversine(P(k["x"], k["y"]), P(x["x"], x["y"])) < APART_M
    free = lambda kept, x: (F.size(kept) < most) & ~F.exists(kept, lambda k: near(k, x))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    each = sorted_.select("scene_id", F.posexplode(kept).alias("n", "s")).select("scene_id", "n", F.col("s.id").alias("id"))
    number, street = split_address(F.col("address"))
    kind = F.when(F.col("n") % 4 == 0, "commercial").otherwise("residential")
    return each.join(b, ["scene_id", "id"]).select("scene_id", "n", F.col("id").alias("source"), F.col("mx").alias("x"), F.col("my").alias("y"), "footprint", number.alias("number"), F.when(number.isNotNull(), F.coalesce(street, F.lit(""))).alias("street"), kind.alias("type"), (3 + F.col("n") % 8).alias("floors"))


def chosen_streets(w: DataFrame, streets: DataFrame, bounds: DataFrame) -> DataFrame:
    """(scene_id, n, name, line): streets (street_id, name, highway, line) other than service and unclassified ones with a vertex in the window
    and one within 0.002 degrees of the scene's buildings (bounds), the first 60 by id."""
    s = streets.filter(~F.coalesce("highway", F.lit("")).isin(*LEFT_OUT) & (F.size("line") > 1)).withColumn("v", F.explode("line")).select("*", "v.*").drop("v")
    s = _in_windows(s, w).select("scene_id", "street_id", "name", "line").dropDuplicates(["scene_id", "street_id"]).join(bounds, "scene_id")
    near = lambda v: v["x"].between(F.col("x0") - MARGIN, F.col("x1") + MARGIN) & v["y"].between(F.col("y0") - MARGIN, F.col("y1") + MARGIN)
    n = F.row_number().over(Window.partitionBy("scene_id").orderBy("street_id")) - 1
    s = s.filter(F.exists("line", near)).withColumn("n", n).filter(F.col("n") < STREETS)
    return s.select("scene_id", "n", F.coalesce("name", F.concat(F.lit("street "), F.col("n").cast("string"))).alias("name"), "line")


def _snapped(points: DataFrame, streets: DataFrame) -> DataFrame:
    """points (scene_id, k, x, y) with sx, sy: the nearest place on a street of the scene, or the point itself where there is none."""
    s = geo.snap(P(F.col("x"), F.col("y")), F.col("line"))
    own = points.join(streets.select("scene_id", F.col("n").alias("way"), "line"), "scene_id").withColumn("s", s)
    best = own.groupBy("scene_id", "k").agg(F.min_by("s", F.struct(F.round("s.d", 6), "way")).alias("s"))
    return points.join(best, ["scene_id", "k"], "left").select(*points.columns, F.coalesce("s.x", "x").alias("sx"), F.coalesce("s.y", "y").alias("sy"))


def scenes(w: DataFrame, buildings: DataFrame, streets: DataFrame, most: int = 12, spread: bool = False) -> dict[str, DataFrame]:
    """buildings, streets, equipment (scene_id, id, kind, serves, x, y) and cables (scene_id, id, kind, source, target, x, y, bx, by) of windows
    that have, beside their box, a boolean for each of PLANTS: a building left without a closure (the most isolated), the
    first closure inside its building, a cable from the first to the last closure, the last closure on its street.

    Every building has a closure on the pavement before it, and an office stands on the street nearest to the south-western
    corner. Windows without buildings give nothing; null plants count as false."""
    b = chosen_buildings(w, buildings, most, spread)
    side = lambda f, g, k: f(g(F.transform("footprint", lambda v: v[k])))
    bounds = b.groupBy("scene_id").agg(side(F.min, F.array_min, "x").alias("x0"), side(F.max, F.array_max, "x").alias("x1"), side(F.min, F.array_min, "y").alias("y0"), side(F.max, F.array_max, "y").alias("y1"))
    s = chosen_streets(w, streets, bounds)
    plants = w.select("scene_id", *[F.coalesce(p, F.lit(False)).alias(p) for p in PLANTS])
    other = b.select("scene_id", F.col("n").alias("m"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    alone = b.join(other, "scene_id").filter("n <> m").groupBy("scene_id", "n").agg(F.min(geo.haversine(P(F.col("x"), F.col("y")), P(F.col("ox"), F.col("oy")))).alias("d"))
    gap = alone.groupBy("scene_id").agg(F.max_by("n", F.struct(F.round("d", 6), -F.col("n"))).alias("gap_n"))
    served = b.select("scene_id", "n", "x", "y").join(plants, "scene_id").join(gap, "scene_id", "left").filter(~F.col("gap") | F.col("gap_n").isNull() | (F.col("n") != F.col("gap_n")))
    order = Window.partitionBy("scene_id").orderBy("n")
    served = served.withColumns({"k": F.row_number().over(order) - 1, "last": F.count("*").over(Window.partitionBy("scene_id")) - 1})
    snapped = _snapped(served.select("scene_id", "k", "n", "x", "y", "last", *PLANTS[1:]), s)
    away = geo.haversine(P(F.col("sx"), F.col("sy")), P(F.col("x"), F.col("y")))
    t = F.when(away < 1, 0.0).otherwise(F.least(PAVEMENT_M / away, F.lit(PAVEMENT_SHARE)))
    closure = snapped.withColumns({"px": F.col("sx") + (F.col("x") - F.col("sx")) * t, "py": F.col("sy") + (F.col("y") - F.col("sy")) * t})
    inside = F.col("inside") & (F.col("k") == 0)
    closure = closure.withColumns({"qx": F.when(inside, F.col("x")).otherwise(F.col("px")), "qy": F.when(inside, F.col("y")).otherwise(F.col("py"))})
    letter = F.when(F.col("k") < len(LETTERS), F.substring(F.lit(LETTERS), F.col("k") + 1, F.lit(1))).otherwise(F.col("k").cast("string"))
    closure = closure.withColumns({"id": F.concat(F.lit("CL-"), letter), "house": F.concat(F.lit("B-"), F.col("n").cast("string"))})
    on = _snapped(closure.filter(F.col("street") & (F.col("k") == F.col("last"))).select("scene_id", "k", F.col("qx").alias("x"), F.col("qy").alias("y")), s).select("scene_id", "k", F.col("sx").alias("rx"), F.col("sy").alias("ry"))
    placed = closure.join(on, ["scene_id", "k"], "left")
    office = _snapped(bounds.select("scene_id", F.lit(0).alias("k"), F.col("x0").alias("x"), F.col("y0").alias("y")), s)
    equipment = office.select("scene_id", F.lit("CO-1").alias("id"), F.lit("co").alias("kind"), F.lit("").alias("serves"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    equipment = equipment.unionByName(placed.select("scene_id", "id", F.lit("closure").alias("kind"), F.col("house").alias("serves"), F.coalesce("rx", "qx").alias("x"), F.coalesce("ry", "qy").alias("y")))
    drops = closure.select("scene_id", F.concat(F.lit("drop-"), "id").alias("id"), F.lit("drop").alias("kind"), F.col("id").alias("source"), F.col("house").alias("target"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("x").alias("bx"), F.col("y").alias("by"))
    end = lambda k, *cs: closure.filter(F.col("cross") & (F.col("last") > 0) & (F.col("k") == k)).select("scene_id", F.col("id").alias(cs[0]), F.col("qx").alias(cs[1]), F.col("qy").alias(cs[2]))
    cross = end(F.lit(0), "source", "x", "y").join(end(F.col("last"), "target", "bx", "by"), "scene_id")
    cross = cross.select("scene_id", F.lit("dist-cross").alias("id"), F.lit("distribution").alias("kind"), "source", "target", "x", "y", "bx", "by")
    return {"buildings": b, "streets": s, "equipment": equipment, "cables": drops.unionByName(cross)}


def entities(parts: dict[str, DataFrame]) -> DataFrame:
    """(scene_id, part, id, info, x, y, bx, by): everything in scenes as one table, coordinates with seven decimals."""
    seven = lambda c: F.round(c, 7)
    row = lambda df, part, i, info, x, y, bx, by: df.select("scene_id", F.lit(part).alias("part"), i.alias("id"), info.alias("info"), seven(x).alias("x"), seven(y).alias("y"), seven(bx).alias("bx"), seven(by).alias("by"))
    n = F.col("n").cast("string")
    vertex = lambda i, k: F.element_at("line", i)[k]
    b = row(parts["buildings"], "building", F.concat(F.lit("B-"), n), F.concat_ws("|", "type", F.col("floors").cast("string"), "number", "street"), F.col("x"), F.col("y"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    s = row(parts["streets"], "street", F.concat(F.lit("st-"), n), F.col("name"), vertex(1, "x"), vertex(1, "y"), vertex(-1, "x"), vertex(-1, "y"))
    e = row(parts["equipment"], "equipment", F.col("id"), F.concat_ws("|", "kind", "serves"), F.col("x"), F.col("y"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    c = row(parts["cables"], "cable", F.col("id"), F.concat_ws("|", "kind", "source", "target"), F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    return b.unionByName(s).unionByName(e).unionByName(c)
