"""Grid towns made from specifications: blocks between streets, a closure for each block, and errors planted on purpose.

A specification is a row (scene_id, seed, nx, ny, in_building, crossing, gap, on_street): blocks from west to east and from south
to north, and four flags. Everything but a building's type and floors follows from it by arithmetic, so the tables are column
expressions on exploded rows. Random draws are sequential within a town and come from one generator a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions import text as tx
from terrane.functions.geo import P
from terrane.operators.procedural import synthetic_scenes

#: Cells of a block and of the street beside it, metres of a cell, the south-western corner, a closure's nudge.
BLOCK, STREET, CELL_M, ORIGIN, NUDGE = 4, 1, 10.0, P(34.78, 32.085), 0.12
PITCH = BLOCK + STREET


def _cell(col: Column, row: Column) -> P:
    """Middle of a grid cell; row 0 is the southern edge."""
    d_lng = CELL_M / (geo.LNG_M * F.cos(F.radians(F.lit(ORIGIN.y))))
    return P(ORIGIN.x + (col + 0.5) * d_lng, ORIGIN.y + (row + 0.5) * (CELL_M / geo.LAT_M))


def _struct(p: P) -> Column:
    return F.struct(p.x.alias("x"), p.y.alias("y"))


def specifications(spark, towns: int) -> DataFrame:
    """Towns in turn without errors, with each kind, and with all; three to five blocks a side."""
    i = F.col("id")
    kind = i % 6
    flag = lambda k: (kind == k) | (kind == 5)
    n = (3 + F.floor(i / 6) % 3).cast("int")
    return spark.range(towns).select(i.cast("int").alias("scene_id"), (1000 + i).alias("seed"), n.alias("nx"), n.alias("ny"), flag(1).alias("in_building"), flag(2).alias("crossing"), flag(3).alias("gap"), flag(4).alias("on_street"))


def streets(specs: DataFrame) -> DataFrame:
    """Centre lines along and across the town, in the cells between its blocks."""
    width, height = STREET + F.col("nx") * PITCH, STREET + F.col("ny") * PITCH
    at = F.when(F.col("k") == 0, 0).otherwise(STREET + F.col("k") * PITCH - 1)

    def lines(n: str, mark: str, ends) -> DataFrame:
        each = specs.select("scene_id", "nx", "ny", F.explode(F.sequence(F.lit(0), F.col(n))).alias("k"))
        a, b = ends
        line = F.array(_struct(a), _struct(b))
        k = F.col("k").cast("string")
        return each.select("scene_id", F.concat(F.lit(f"st-{mark.lower()}-"), k).alias("street_id"), F.concat(F.lit(f"{mark} Street "), k).alias("name"), a.x.alias("x"), a.y.alias("y"), b.x.alias("bx"), b.y.alias("by"), line.alias("line"))

    return lines("ny", "H", (_cell(F.lit(0), at), _cell(width - 1, at))).unionByName(lines("nx", "V", (_cell(at, F.lit(0)), _cell(at, height - 1))))


def _blocks(specs: DataFrame) -> DataFrame:
    """A row for each block: its place, its south-western cell and its middle."""
    each = specs.select("*", F.explode(F.sequence(F.lit(0), F.col("nx") * F.col("ny") - 1)).alias("k"))
    each = each.withColumns({"bx_": F.col("k") % F.col("nx"), "by_": F.floor(F.col("k") / F.col("nx")).cast("int")})
    each = each.withColumns({"c0": STREET + F.col("bx_") * PITCH, "r0": STREET + F.col("by_") * PITCH})
    middle = _cell(F.col("c0") + (BLOCK - 1) / 2, F.col("r0") + (BLOCK - 1) / 2)
    return each.withColumns({"x": middle.x, "y": middle.y, "id": F.concat(F.lit("B-"), F.col("bx_").cast("string"), F.lit("-"), F.col("by_").cast("string"))})


def buildings(specs: DataFrame) -> DataFrame:
    """One building a block, with its address on the street to its south."""
    b = _blocks(specs)
    corner = lambda w, h: _struct(_cell(F.col("c0") + w - 0.5, F.col("r0") + h - 0.5))
    ring = F.array(corner(0, 0), corner(BLOCK, 0), corner(BLOCK, BLOCK), corner(0, BLOCK), corner(0, 0))
    drawn = synthetic_scenes(specs.select("scene_id", "seed", F.col("nx").alias("cols"), F.col("ny").alias("rows"))).select("scene_id", F.col("ord").alias("k"), "type", "floors")
    address = F.concat(((F.col("k") + 1) * 2).cast("string"), F.lit(" H Street "), F.col("by_").cast("string"))
    return b.join(drawn, ["scene_id", "k"]).select("scene_id", "id", "x", "y", ring.alias("footprint"), "type", "floors", address.alias("address"))


def equipment(specs: DataFrame) -> DataFrame:
    """A central office in the south-western corner and a closure south of each block, with the errors that the flags ask for."""
    b = _blocks(specs).withColumn("last", F.col("nx") * F.col("ny") - 1 - F.col("gap").cast("int")).filter("k <= last")
    south = _cell(F.col("c0") + BLOCK // 2, F.col("r0") - 1)
    x, y = south.x + (F.col("x") - south.x) * NUDGE, south.y + (F.col("y") - south.y) * NUDGE
    moved, road = F.col("in_building") & (F.col("k") == 0), F.col("on_street") & (F.col("k") == F.col("last"))
    way = F.filter("lines", lambda s: s.isNotNull())
    at = b.withColumns({"px": F.when(moved, F.col("x")).otherwise(x), "py": F.when(moved, F.col("y")).otherwise(y), "road": road})
    lines = streets(specs).groupBy("scene_id").agg(F.collect_list("line").alias("lines"))
    snapped = F.array_min(F.transform(way, lambda s: geo.snap(P(F.col("px"), F.col("py")), s)))
    at = at.join(lines, "scene_id").withColumn("snap", F.when(F.col("road"), snapped))
    name = F.concat(F.lit("CL-"), tx.letters(F.col("k") + 1))
    closures = at.select("scene_id", name.alias("id"), F.lit("closure").alias("kind"), F.coalesce("snap.x", "px").alias("x"), F.coalesce("snap.y", "py").alias("y"), F.col("id").alias("serves"), (F.col("k") + 1).alias("ord"))
    corner = _cell(F.lit(0), F.lit(0))
    offices = specs.select("scene_id", F.lit("CO-1").alias("id"), F.lit("co").alias("kind"), corner.x.alias("x"), corner.y.alias("y"), F.lit(None).cast("string").alias("serves"), F.lit(0).alias("ord"))
    return offices.unionByName(closures)


def cables(specs: DataFrame) -> DataFrame:
    """A drop from each closure to its building as planned, and the planted cable from the first closure to the last."""
    e = equipment(specs).filter("kind = 'closure'")
    b = _blocks(specs).select("scene_id", F.col("id").alias("serves"), F.col("x").alias("bx"), F.col("y").alias("by"))
    drops = e.join(b, ["scene_id", "serves"]).select("scene_id", F.concat(F.lit("drop-"), "id").alias("cable_id"), F.lit("drop").alias("kind"), F.col("id").alias("source"), F.col("serves").alias("target"), "x", "y", "bx", "by")
    ends = e.join(specs.filter("crossing").select("scene_id"), "scene_id").groupBy("scene_id").agg(F.min(F.struct("ord", "id", "x", "y")).alias("a"), F.max(F.struct("ord", "id", "x", "y")).alias("b")).filter("a.ord < b.ord")
    far = ends.select("scene_id", F.lit("dist-cross").alias("cable_id"), F.lit("distribution").alias("kind"), F.col("a.id").alias("source"), F.col("b.id").alias("target"), F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
    return drops.unionByName(far)


def foreign(specs: DataFrame) -> DataFrame:
    """(scene_id, cable_id, building) that a cable may pass: the ones that its ends serve or are."""
    served = equipment(specs).filter("serves IS NOT NULL").select("scene_id", F.col("id").alias("end"), F.col("serves").alias("building"))
    ends = cables(specs).select("scene_id", "cable_id", F.explode(F.array("source", "target")).alias("end"))
    return ends.join(served, ["scene_id", "end"]).select("scene_id", "cable_id", "building").union(ends.select("scene_id", "cable_id", F.col("end").alias("building"))).distinct()

