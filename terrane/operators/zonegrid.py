"""Scenes drawn as labelled text grids, one for each zone of about 200 m that holds something.

A zone's grid shows roads, pavement, buildings with labels, cables with marks where they meet these, cable and device annotations
and street labels. What a later step may overwrite depends only on what a cell shows by then, so every step is a table of marks
(key, row, mark), a mark being (step, ord, glyph, col, n) for n cells from col, and the marks of a row decide what is seen.

Inputs as for gridtwin; cables also have cable_id, kind, number and ord (their order), equipment has ids that are numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from terrane.functions import geo
from terrane.functions.geo import P
from terrane.functions.text import padded, street_label
from terrane.operators import gridtwin as gt
from terrane.operators.graph import settled
from terrane.operators.spatial import spread

#: Side of a zone, sizes of grids up to so many buildings, marks of cables, and how many street labels of each direction.
ZONE_M = 200.0
SIZES = ((5, 100, 50), (15, 150, 75), (40, 200, 100), (None, 200, 200))
DROP, CABLE = "─", "━"
OVER = {gt.ROAD_H: "╪", gt.ROAD_V: "╫", gt.ROAD_X: "╪", gt.BUILDING: "▒"}
LETTERS = {"drop": "D", "feeder": "F", "distribution": "T"}
DRAWN_LAST = {"cabinet": 2, "co": 3, "closure": 4}
STREET_LABELS, MARGIN = 3, 2


def division(bounds: DataFrame, size: float = ZONE_M) -> DataFrame:
    """bounds (scene_id, min_x, min_y, max_x, max_y) with the number of zones across and down (zx, zy) and the degrees of a zone (zw, zh)."""
    at = lambda x, y: P(F.col(x), F.col(y))
    n = lambda far: F.greatest(F.ceil(geo.haversine(at("min_x", "min_y"), at(*far)) / size), F.lit(1)).cast("int")
    d = bounds.withColumns({"zx": n(("max_x", "min_y")), "zy": n(("min_x", "max_y"))})
    return d.withColumns({"zw": (F.col("max_x") - F.col("min_x")) / F.col("zx"), "zh": (F.col("max_y") - F.col("min_y")) / F.col("zy")})


def _box(c: Column, r: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east and north of a zone."""
    return F.col("min_x") + c * F.col("zw"), F.col("max_y") - (r + 1) * F.col("zh"), F.col("min_x") + (c + 1) * F.col("zw"), F.col("max_y") - r * F.col("zh")


def zoned(rows: DataFrame, div: DataFrame, vertices: Sequence[tuple[str, str]] = (("x", "y"),)) -> DataFrame:
    """rows once for every zone (zc from the west, zr from the north) that holds one of their vertices, edges included."""

    def holding(x: Column, y: Column) -> Column:
        near = lambda t, n: F.filter(F.sequence(F.floor(t) - 1, F.floor(t) + 1), lambda k: (k >= 0) & (k < n))
        across, down = near((x - F.col("min_x")) / F.col("zw"), F.col("zx")), near((F.col("max_y") - y) / F.col("zh"), F.col("zy"))
        every = F.flatten(F.transform(across, lambda c: F.transform(down, lambda r: F.struct(c.cast("int").alias("zc"), r.cast("int").alias("zr")))))

        def held(z: Column) -> Column:
            west, south, east, north = _box(z["zc"], z["zr"])
            return (x >= west) & (x <= east) & (y >= south) & (y <= north)

        return F.filter(every, held)

    cells = F.array_distinct(F.concat(*[holding(F.col(x), F.col(y)) for x, y in vertices]))
    out = rows.join(div, "scene_id").select(*[rows[c] for c in rows.columns], F.explode(cells).alias("z"))
    return out.select(*rows.columns, "z.zc", "z.zr")


def zone_name(c: Column, r: Column) -> Column:
    """A1 in the north-west; letters go down, beyond Z by the order of characters."""
    return F.concat(F.char(F.lit(65) + r), (c + 1).cast("string"))


def _chars(df: DataFrame, text: Column, col: Column, row: Column, down: Column | None = None) -> DataFrame:
    """df once for each character of text, from (col, row) to the right, or downwards where `down`; what is off the grid is left out."""
    down = F.lit(False) if down is None else down
    c = F.filter(F.split(text, ""), lambda x: x != "")
    each = df.withColumns({"_c": col, "_r": row, "_d": down}).select("*", F.posexplode(c).alias("_i", "glyph"))
    each = each.withColumns({"col": F.col("_c") + F.when(F.col("_d"), 0).otherwise(F.col("_i")), "row": F.col("_r") + F.when(F.col("_d"), F.col("_i")).otherwise(0)})
    return each.filter("col BETWEEN 0 AND w - 1 AND row BETWEEN 0 AND h - 1")


def _marks(df: DataFrame, step: str, ord_: Column) -> DataFrame:
    n = F.col("n") if step == "ground" and "n" in df.columns else F.lit(1)
    return df.select("scene_id", F.col("row").cast("int").alias("row"), F.struct(F.lit(step).alias("step"), ord_.cast("long").alias("ord"), F.col("glyph"), F.col("col").cast("int").alias("col"), n.cast("int").alias("n")).alias("mark"))


def building_labels(f: DataFrame, runs: DataFrame) -> DataFrame:
    """B01 in the middle row of a building of three cells there or more, else its last figure; numbered by the text of ids in a zone."""
    middle = lambda total: F.floor(F.sum(total) / F.sum("n") + 0.5).cast("int")
    runs = runs.withColumn("n", F.col("hi") - F.col("lo") + 1)
    own = runs.groupBy("scene_id", "id").agg(middle((F.col("lo") + F.col("hi")) * F.col("n") / 2).alias("cc"), middle(F.col("row") * F.col("n")).alias("cr"))
    here = lambda c: F.when(F.col("row") == F.col("cr"), F.col(c))
    wide = runs.join(own, ["scene_id", "id"]).groupBy("scene_id", "id", "cc", "cr").agg(F.coalesce(F.sum(here("n")), F.lit(0)).alias("n"), F.min(here("lo")).alias("lo"), F.max(here("hi")).alias("hi"))
    return wide.join(f, "scene_id")


def street_labels(f: DataFrame, streets: DataFrame) -> DataFrame:
    """(scene_id, w, h, k, label, col, row, down): the labels of a zone in the order in which they are written. A name's direction is the one
    in which most of its metres run on the grid; it stands at the middle of its longest way of that direction. Longer names
    come first; one that does not fit is left out, as is one whose row or column has one; up to three of each direction."""
    (c0, r0), (c1, r1) = gt.cell_of(F.col("x"), F.col("y")), gt.cell_of(F.col("bx"), F.col("by"))
    metres = F.round(geo.haversine(P(F.col("x"), F.col("y")), P(F.col("bx"), F.col("by"))), 6)
    s = streets.join(f, "scene_id").withColumns({"name": F.trim("name"), "m": metres, "c0": c0, "r0": r0, "c1": c1, "r1": r1}).filter("name <> ''")
    s = s.withColumn("flat", F.abs(F.col("c1") - F.col("c0")) >= F.abs(F.col("r1") - F.col("r0")))
    total = lambda flat: F.coalesce(F.round(F.sum(F.when(F.col("flat") == flat, F.col("m"))), 4), F.lit(0.0))
    best = lambda flat: F.max_by(F.struct("c0", "r0", "c1", "r1"), F.when(F.col("flat") == flat, F.struct("m", -F.col("street_id"))))
    g = s.groupBy("scene_id", "w", "h", "name").agg(total(True).alias("a"), total(False).alias("b"), best(True).alias("fa"), best(False).alias("fb"))
    g = g.withColumn("down", F.col("a") < F.col("b")).withColumn("s", F.when(F.col("down"), F.col("fb")).otherwise(F.col("fa"))).withColumn("label", street_label(F.col("name")))
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2).cast("int")
    g = g.withColumns({"mx": mid("s.c0", "s.c1"), "my": mid("s.r0", "s.r1"), "n": F.length("label"), "total": F.round(F.col("a") + F.col("b"), 3)})
    lead = lambda c: F.greatest(F.lit(MARGIN), F.col(c) - F.floor(F.col("n") / 2)).cast("int")
    g = g.withColumns({"col": F.when(F.col("down"), F.col("mx")).otherwise(lead("mx")), "row": F.when(F.col("down"), lead("my")).otherwise(F.col("my"))})
    g = g.filter(F.when(F.col("down"), F.col("row") + F.col("n") <= F.col("h") - MARGIN).otherwise(F.col("col") + F.col("n") <= F.col("w") - MARGIN))
    order = (F.col("total").desc(), F.col("name"))
    line = F.when(F.col("down"), F.col("mx")).otherwise(F.col("my"))
    g = g.withColumn("line", line).withColumn("k", F.row_number().over(Window.partitionBy("scene_id", "down", "line").orderBy(*order))).filter("k = 1")
    g = g.withColumn("k", F.row_number().over(Window.partitionBy("scene_id", "down").orderBy(*order))).filter(F.col("k") <= STREET_LABELS)
    return g.select("scene_id", "w", "h", (F.col("k") + F.when(F.col("down"), STREET_LABELS).otherwise(0)).alias("k"), "label", "col", "row", "down")


def built_ground(f: DataFrame, runs: DataFrame) -> DataFrame:
    """(scene_id, row, col, n, own): runs of n cells of buildings (own), and of the pavement around these."""
    near = gt.PAVEMENT_CELLS
    b = runs.select("scene_id", "row", F.col("lo").alias("col"), (F.col("hi") - F.col("lo") + 1).alias("n"), F.lit(True).alias("own"))
    p = runs.join(f.select("scene_id", "w", "h"), "scene_id").withColumn("d", F.explode(F.sequence(F.lit(-near), F.lit(near)))).withColumn("row", F.col("row") + F.col("d"))
    lo, hi = F.greatest(F.lit(0), F.col("lo") - near), F.least(F.col("w") - 1, F.col("hi") + near)
    p = p.filter("row BETWEEN 0 AND h - 1").select("scene_id", "row", lo.alias("col"), (hi - lo + 1).alias("n"), F.lit(False).alias("own")).distinct()
    return b.unionByName(p)


def _painted(w: int, marks: Iterable[tuple[str, int, str, int, int]]) -> str:
    """A row of w cells: of the marks (step, ord, glyph, col, n) of a step in a cell the first by ord; what it may overwrite follows from
    what the cell shows by then."""
    ground, layer = [" "] * w, {step: {} for step in ("building", "cable", "tag", "device", "street")}
    for step, _, glyph, col, n in sorted(marks, key=lambda m: (m[1], m[2]), reverse=True):
        if step == "ground":
            ground[col : col + n] = [glyph] * n
        else:
            layer[step][col] = glyph
    may = {"building": gt.BUILDING, "tag": (" ", gt.PAVEMENT, DROP, CABLE), "street": (" ", gt.PAVEMENT, gt.ROAD_H, gt.ROAD_V, gt.ROAD_X)}
    for step, cells in layer.items():
        for col, glyph in cells.items():
            under = ground[col]
            if step == "cable":
                ground[col] = OVER.get(under) or (glyph if under in (" ", gt.PAVEMENT) else under)
            elif step == "device" or under in may[step]:
                ground[col] = glyph
    return "".join(ground)


@F.arrow_udf(StringType())
def _line(w: pa.Array, marks: pa.Array) -> pa.Array:
    """Rows of grids, by _painted()."""
    flat = list(zip(*(c.to_pylist() for c in marks.flatten().flatten())))
    out, at = [], 0
    for wide, n in zip(w.to_pylist(), marks.value_lengths().fill_null(0).to_pylist()):
        out.append(_painted(wide, [m for m in flat[at : at + n] if m[4]]))
        at += n
    return pa.array(out, pa.string())


def drawn(f: DataFrame, streets: DataFrame, buildings: DataFrame, equipment: DataFrame, cables: DataFrame) -> DataFrame:
    """(scene_id, row, line) of all rows of the grids framed by f; scene_id is a zone's key in all inputs."""
    runs = settled(gt.building_runs(f, spread(buildings, "scene_id", "id")))
    roads = gt.road_cells(f, streets)
    marks = _marks(roads, "ground", F.when(F.col("glyph") == gt.ROAD_X, 0).otherwise(2))
    solid = built_ground(f, runs)
    marks = marks.unionByName(_marks(solid.withColumn("glyph", F.when(F.col("own"), gt.BUILDING).otherwise(gt.PAVEMENT)), "ground", F.when(F.col("own"), 1).otherwise(3)))
    number = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.col("id").cast("string"), "id"))
    named = buildings.select("scene_id", "id").distinct().withColumn("k", number)
    b = building_labels(f, runs).join(named, ["scene_id", "id"])
    label = F.concat(F.lit("B"), padded(F.col("k"), 2))
    whole = F.col("n") >= 3
    b = b.withColumn("label", F.when(whole, label).otherwise(F.right(F.col("k").cast("string"), F.lit(1))))
    start = F.when(whole, F.floor((F.col("lo") + F.col("hi") - F.length("label") + 1) / 2)).otherwise(F.col("cc"))
    marks = marks.unionByName(_marks(_chars(b, F.col("label"), start, F.col("cr")), "building", F.col("k")))
    line = gt._lines(f, cables).withColumn("glyph", F.when(F.col("kind") == "drop", DROP).otherwise(CABLE))
    marks = marks.unionByName(_marks(line, "cable", F.col("ord")))
    letter = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LETTERS.items() for x in p]), F.col("kind")), F.lit("?"))
    mc, mr = gt.cell_of((F.col("x") + F.col("bx")) / 2, (F.col("y") + F.col("by")) / 2)
    tag = F.concat(F.lit("["), letter, F.coalesce(padded(F.col("number"), 2), F.lit("??")), F.lit("]"))
    marks = marks.unionByName(_marks(_chars(cables.filter("kind <> 'drop'").join(f, "scene_id"), tag, mc, mr), "tag", F.col("ord")))
    ec, er = gt.cell_of(F.col("x"), F.col("y"))
    seen = lambda names: F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("kind"))
    e = equipment.join(f, "scene_id").withColumn("p", F.row_number().over(Window.partitionBy("scene_id").orderBy(seen(DRAWN_LAST), "id")))
    device = F.concat(F.lit("["), seen(gt.DEVICES), padded(F.col("id"), 2), F.lit("]"))
    marks = marks.unionByName(_marks(_chars(e, device, ec, er), "device", -F.col("p")))
    street = _chars(street_labels(f, streets), F.col("label"), F.col("col"), F.col("row"), F.col("down"))
    marks = marks.unionByName(_marks(street, "street", F.col("k") + F.when(F.col("glyph") == " ", 100).otherwise(0)))  # a blank may be written over
    none = F.struct(F.lit("ground").alias("step"), F.lit(0).cast("long").alias("ord"), F.lit(" ").alias("glyph"), F.lit(0).alias("col"), F.lit(0).alias("n"))
    every = f.select("scene_id", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("row"), none.alias("mark"), "w")  # a row without marks, and its width
    rows = spread(marks.withColumn("w", F.lit(None).cast("int")).unionByName(every), "scene_id").groupBy("scene_id", "row").agg(F.max("w").alias("w"), F.collect_list("mark").alias("marks"))
    return rows.filter("w IS NOT NULL").select("scene_id", "row", _line("w", "marks").alias("line"))


def zone_grids(bounds: DataFrame, streets: DataFrame, buildings: DataFrame, equipment: DataFrame, cables: DataFrame, size: float = ZONE_M) -> DataFrame:
    """(scene_id, zone, buildings, w, h, text): the grid of every zone with a building or a device, with rulers and a border.

    Buildings and devices are in the zones that hold their place, streets and cables in those that hold one of their ends. A null
    place is in no zone; an empty table gives an empty one."""
    div = settled(division(bounds, size))
    ends = (("x", "y"), ("bx", "by"))
    b, e = settled(zoned(buildings, div)), settled(zoned(equipment, div))
    has = b.select("scene_id", "zc", "zr", F.lit(1).alias("n")).unionByName(e.select("scene_id", "zc", "zr", F.lit(0).alias("n"))).groupBy("scene_id", "zc", "zr").agg(F.sum("n").alias("buildings"))
    west, south, east, north = _box(F.col("zc"), F.col("zr"))
    has = has.join(div, "scene_id").select("scene_id", "zc", "zr", "buildings", west.alias("x0"), south.alias("y0"), east.alias("x1"), north.alias("y1"))
    key = F.concat_ws("/", "scene_id", "zc", "zr")
    pick = lambda i: F.coalesce(*[F.when(F.col("buildings") <= n, F.lit(s[i])) for s in SIZES[:-1] for n in s[:1]], F.lit(SIZES[-1][i]))
    zones = settled(has.select(key.alias("scene_id"), F.col("scene_id").alias("scene"), "buildings", zone_name(F.col("zc"), F.col("zr")).alias("zone"), pick(1).alias("w"), pick(2).alias("h"), F.col("x0").alias("min_x"), F.col("y0").alias("min_y"), F.col("x1").alias("max_x"), F.col("y1").alias("max_y")))
    f = gt.framed(zones, F.col("w"), F.col("h"))
    keyed = lambda df: df.withColumn("scene_id", key).drop("zc", "zr")
    s, c = (settled(keyed(zoned(x, div, ends)).join(f.select("scene_id"), "scene_id", "left_semi")) for x in (streets, cables))
    lines = drawn(f, s, keyed(b), keyed(e), c)
    row = F.concat(F.lit(" "), F.char(F.lit(65) + F.col("row") % 26), F.lit(" │"), "line", F.lit("│"))
    body = lines.groupBy("scene_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", row.alias("t")))), lambda s: s["t"]), "\n").alias("body"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    tens = F.array_join(F.transform(upto(F.ceil(F.col("w") / 10)), lambda i: F.rpad(i.cast("string"), 10, " ")), "")
    ones = F.array_join(F.transform(upto(F.col("w")), lambda i: (i % 10).cast("string")), "")
    edge = lambda a, z: F.concat(F.lit("   " + a), F.array_join(F.array_repeat(F.lit("─"), F.col("w")), ""), F.lit(z))
    blank = F.lit("    ")
    side = f"{size:g}m"
    text = F.concat_ws("\n", F.concat(F.lit("ZONE "), "zone", F.lit(f" ({side} × {side})")), F.concat(blank, tens), F.concat(blank, ones), edge("┌", "┐"), "body", edge("└", "┘"))
    return zones.join(body, "scene_id").select(F.col("scene").alias("scene_id"), "zone", "buildings", "w", "h", text.alias("text"))
