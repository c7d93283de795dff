"""A scene as one text: JSON files, a WKT table, or a ledger of what holds for each of its entities.

Inputs: buildings (scene_id, id, type, floors, x, y, footprint, address: struct of number and street, or null), streets (scene_id, street_id,
name, line, x, y, bx, by), equipment (scene_id, id, kind, x, y), serves (scene_id, id, building), cables (scene_id, cable_id, kind, ord, source,
target, x, y, bx, by). A scene is bounded, so its text is a value; scenes are grouped in parallel. Entities stand in the order of
their ids (cables: of ord). Coordinates have seven decimals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import spatial as sp

#: Metres within which a device is on a street and a building is covered.
ON_STREET_M, COVERED_M = 8.0, 35.0


def _seven(v: Column) -> Column:
    return F.round(v, 7).cast("decimal(12,7)")


def _place(x: Column, y: Column) -> Column:
    return F.array(_seven(x), _seven(y))


def _line(points: Column) -> Column:
    return F.transform(points, lambda v: _place(v["x"], v["y"]))


def _ends() -> Column:
    return F.array(F.struct("x", "y"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))


def served(equipment: DataFrame, serves: DataFrame) -> DataFrame:
    """equipment with `serves`: the buildings of each, in order; none: an empty list."""
    s = serves.groupBy("scene_id", "id").agg(F.array_sort(F.collect_set("building")).alias("serves"))
    return equipment.join(s, ["scene_id", "id"], "left").withColumn("serves", F.coalesce("serves", F.array().cast("array<bigint>")))


def _joined(parts: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """(scene_id, s0, s1, ...): for each part (scene_id, ord, line) its lines in order, joined by its glue; null where a scene has none."""
    out = None
    for k, (rows, glue) in enumerate(parts):
        lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda s: s["line"])
        one = rows.groupBy("scene_id").agg(F.array_join(lines, glue).alias(f"s{k}"))
        out = one if out is None else out.join(one, "scene_id", "full_outer")
    return out


def _part(df: DataFrame, ord_: str, line: Column) -> DataFrame:
    return df.select("scene_id", F.col(ord_).alias("ord"), line.alias("line"))


def as_json(buildings: DataFrame, streets: DataFrame, equipment: DataFrame, serves: DataFrame, cables: DataFrame) -> DataFrame:
    """(scene_id, text): buildings and streets as arrays of objects, equipment and cables as feature collections, under headings. A
    building without an address has no such field; a part without entities is an empty list."""
    number = lambda c: F.col(c).cast("string")
    b = F.to_json(F.struct(number("id").alias("id"), "type", "floors", _place(F.col("x"), F.col("y")).alias("position"), F.array(_line(F.col("footprint"))).alias("coordinates"), "address"))
    s = F.to_json(F.struct(number("street_id").alias("id"), "name", _line(F.col("line")).alias("coordinates")))
    feature = lambda i, shape, at, props: F.to_json(F.struct(F.lit("Feature").alias("type"), i.alias("id"), F.struct(F.lit(shape).alias("type"), at.alias("coordinates")).alias("geometry"), props.alias("properties")))
    e = feature(number("id"), "Point", _place(F.col("x"), F.col("y")), F.struct("kind", F.transform("serves", lambda v: v.cast("string")).alias("serves")))
    c = feature(F.col("cable_id"), "LineString", _line(_ends()), F.struct("kind", number("source").alias("source"), number("target").alias("target")))
    g = _joined([(_part(buildings, "id", b), ","), (_part(streets, "street_id", s), ","), (_part(served(equipment, serves), "id", e), ","), (_part(cables, "ord", c), ",")])
    part = lambda k: F.coalesce(f"s{k}", F.lit(""))
    features = lambda k: F.concat(F.lit('{"type":"FeatureCollection","features":['), part(k), F.lit("]}"))
    array = lambda k: F.concat(F.lit("["), part(k), F.lit("]"))
    head = lambda t: F.lit(f"=== {t} ===")
    return g.select("scene_id", F.concat_ws("\n", head("buildings.json"), array(0), head("streets.json"), array(1), head("layers/equipment.geojson"), features(2), head("layers/cables.geojson"), features(3)).alias("text"))


def as_wkt(buildings: DataFrame, streets: DataFrame, equipment: DataFrame, serves: DataFrame, cables: DataFrame) -> DataFrame:
    """(scene_id, text): a table of id, type, attributes and geometry with tabs. Rings are closed."""
    pair = lambda x, y: F.concat_ws(" ", _seven(x).cast("string"), _seven(y).cast("string"))
    line = lambda points: F.array_join(F.transform(points, lambda v: pair(v["x"], v["y"])), ", ")
    ring = F.when(F.get("footprint", F.lit(0)) == F.element_at("footprint", -1), F.col("footprint")).otherwise(F.concat("footprint", F.slice("footprint", 1, 1)))
    row = lambda i, kind, attrs, shape: F.concat_ws("\t", F.col(i).cast("string"), F.lit(kind), attrs, shape)
    address = F.when(F.col("address").isNotNull(), F.concat(F.lit(";addr="), F.col("address.number").cast("string"), F.lit(" "), F.col("address.street"))).otherwise("")
    b = row("id", "building", F.concat(F.lit("use="), "type", F.lit(";floors="), F.col("floors").cast("string"), address), F.concat(F.lit("POLYGON(("), line(ring), F.lit("))")))
    s = row("street_id", "street", F.concat(F.lit("name="), "name"), F.concat(F.lit("LINESTRING("), line(F.col("line")), F.lit(")")))
    e = row("id", "equipment", F.concat(F.lit("kind="), "kind", F.lit(";serves=["), F.array_join("serves", ","), F.lit("]")), F.concat(F.lit("POINT("), pair(F.col("x"), F.col("y")), F.lit(")")))
    c = row("cable_id", "cable", F.concat(F.lit("kind="), "kind", F.lit(";source="), F.col("source").cast("string"), F.lit(";target="), F.col("target").cast("string")), F.concat(F.lit("LINESTRING("), line(_ends()), F.lit(")")))
    g = _joined([(_part(buildings, "id", b), "\n"), (_part(streets, "street_id", s), "\n"), (_part(served(equipment, serves), "id", e), "\n"), (_part(cables, "ord", c), "\n")])
    return g.select("scene_id", F.concat_ws("\n", F.lit("id\ttype\tattrs\twkt"), "s0", "s1", "s2", "s3").alias("text"))


def street_at(points: DataFrame, streets: DataFrame) -> DataFrame:
    """(scene_id, id, street, d): the nearest street's name, or its id where the name is only a number, and its distance."""
    real = (F.trim("name") != "") & ~F.col("name").rlike("(?i)^street [0-9]+$")
    return sp.nearest_street(points, streets).select("scene_id", "id", F.when(real, F.trim("name")).otherwise(F.col("street_id").cast("string")).alias("street"), "d")


def as_verdict(buildings: DataFrame, streets: DataFrame, equipment: DataFrame, serves: DataFrame, cables: DataFrame) -> DataFrame:
    """(scene_id, text): for each device whether it is on a street, how far the nearest one is and its name, whether it is inside a building
    and what it serves; for each cable whether it crosses a building (a drop: another one than its own); for each building the nearest
    closure, the nearest street and whether no closure is within 35 m. Where a scene has no street: Infinity and none."""
    key = ["scene_id", "id"]
    text = lambda c: F.col(c).cast("string")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("string")
    closures = equipment.filter("kind = 'closure'")
    inside = sp.points_in_footprints(equipment, buildings).select(*key).distinct().withColumn("inside", F.lit(True))
    e = served(equipment, serves).join(street_at(equipment, streets), key, "left").join(inside, key, "left")
    metres = F.coalesce(F.concat(F.round("d", 1).cast("decimal(18,1)").cast("string"), F.lit("m")), F.lit("Infinitym"))
    street = F.coalesce("street", F.lit("none"))
    device = F.concat(text("id"), F.lit(" ("), "kind", F.lit(") on_street="), yes(F.col("d") <= ON_STREET_M), F.lit(" dist_to_street="), metres, F.lit(' nearest_street="'), street, F.lit('" inside_building='), yes(F.col("inside")), F.lit(" serves=["), F.array_join("serves", ","), F.lit("]"))
    hits = sp.segments_through_footprints(cables, buildings).filter("kind <> 'drop' OR area <> target").select("scene_id", "cable_id").distinct().withColumn("hit", F.lit(True))
    c = cables.join(hits, ["scene_id", "cable_id"], "left")
    cable = F.concat("cable_id", F.lit(" ("), "kind", F.lit(") "), text("source"), F.lit("->"), text("target"), F.lit(" crosses_foreign_building="), yes(F.col("hit")))
    near = sp.nearest(buildings, closures, 1).select(*key, text("other").alias("closure"), F.col("d").alias("far"))
    b = buildings.join(near, key, "left").join(street_at(buildings, streets), key, "left")
    gap = ~F.coalesce(F.col("far") <= COVERED_M, F.lit(False))
    house = F.concat(text("id"), F.lit(" type="), "type", F.lit(" nearest_closure="), F.coalesce("closure", F.lit("none")), F.lit(' nearest_street="'), street, F.lit('" coverage_gap='), gap.cast("string"))
    g = _joined([(_part(e, "id", device), "\n"), (_part(c, "ord", cable), "\n"), (_part(b, "id", house), "\n")])
    head = lambda t: F.lit(f"=== {t} ===")
    return g.select("scene_id", F.concat_ws("\n", head("EQUIPMENT (computed spatial predicates)"), "s0", head("CABLES"), "s1", head("BUILDINGS"), "s2").alias("text"))
