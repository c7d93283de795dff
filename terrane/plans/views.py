"""Scenes as text and as rows of predicates, zones and grids, and choices within a scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions import text as tx
from terrane.functions.geo import P
from terrane.functions.stats import half_up
from terrane.operators import spatial as sp
from terrane.plans.spatial import NN, NS, SQL_IN, _sql_meets
from terrane.sources import scenes as sc
from terrane.sources.scenes import SCENE_SQL, sql_haversine, sql_segment

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
S = f"WITH {SCENE_SQL}"
TILE = 0.002


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _p(x: str, y: str) -> P:
    return P(F.col(x), F.col(y))


def _seven(c) -> Column:
    return F.format_string("%.7f", F.round(c, 7))


def _seven_sql(*names: str) -> str:
    return " || ' ' || ".join(f"printf('%.7f', round({n}, 7))" for n in names)


def wkt(line: Column) -> Column:
    """Coordinates with seven decimals, joined by commas."""
    return F.array_join(F.transform(line, lambda v: F.concat_ws(" ", _seven(v["x"]), _seven(v["y"]))), ", ")


@query(f"""{S} SELECT scene_id, CAST(id AS VARCHAR) AS id, 'building' AS type, 'use=' || type || ';floors=' || floors AS attrs, 'POLYGON((' || {_seven_sql('x0', 'y0')} || ', ' || {_seven_sql('x1', 'y0')} || ', ' || {_seven_sql('x1', 'y1')} || ', ' || {_seven_sql('x0', 'y1')} || ', ' || {_seven_sql('x0', 'y0')} || '))' AS wkt FROM bld
UNION ALL SELECT scene_id, CAST(street_id AS VARCHAR), 'street', 'name=' || name, 'LINESTRING(' || {_seven_sql('x', 'y')} || ', ' || {_seven_sql('bx', 'ey')} || ')' FROM st
UNION ALL SELECT scene_id, CAST(id AS VARCHAR), 'equipment', 'kind=' || kind, 'POINT(' || {_seven_sql('x', 'y')} || ')' FROM eq
UNION ALL SELECT scene_id, cable_id, 'cable', 'kind=' || kind || ';source=' || source || ';target=' || target, 'LINESTRING(' || {_seven_sql('x', 'y')} || ', ' || {_seven_sql('bx', 'ey')} || ')' FROM dist""")
def scene_wkt(spark, sf_dir):
    """Geometry as text beside its attributes: a row for each building, street, piece of equipment and cable."""
    ends = F.array(F.struct("x", "y"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    row = lambda df, ident, kind, attrs, shape: df.select("scene_id", F.col(ident).cast("string").alias("id"), F.lit(kind).alias("type"), attrs.alias("attrs"), shape.alias("wkt"))
    b = row(sc.buildings(spark, sf_dir), "id", "building", F.concat(F.lit("use="), "type", F.lit(";floors="), F.col("floors").cast("string")), F.concat(F.lit("POLYGON(("), wkt(F.col("footprint")), F.lit("))")))
    s = row(sc.streets(spark, sf_dir), "street_id", "street", F.concat(F.lit("name="), "name"), F.concat(F.lit("LINESTRING("), wkt(F.col("line")), F.lit(")")))
    e = row(sc.equipment(spark, sf_dir), "id", "equipment", F.concat(F.lit("kind="), "kind"), F.concat(F.lit("POINT("), _seven(F.col("x")), F.lit(" "), _seven(F.col("y")), F.lit(")")))
    c = row(sc.distribution(spark, sf_dir), "cable_id", "cable", F.concat(F.lit("kind="), "kind", F.lit(";source="), F.col("source").cast("string"), F.lit(";target="), F.col("target").cast("string")), F.concat(F.lit("LINESTRING("), wkt(ends), F.lit(")")))
    return b.unionByName(s).unionByName(e).unionByName(c)


CORNER = "o AS (SELECT scene_id, min(x) AS x, min(y) AS y FROM pts GROUP BY 1)"


@query(f"""{S}, {CORNER} SELECT b.scene_id, b.id, '{{"id":' || b.id || ',"type":"' || b.type || '","floors":' || b.floors || ',"x":' || CAST(floor({sql_haversine('o.x', 'o.y', 'b.x', 'o.y')} + 0.5) AS BIGINT) || ',"y":' || CAST(floor({sql_haversine('o.x', 'o.y', 'o.x', 'b.y')} + 0.5) AS BIGINT) || '}}' AS json FROM bld b JOIN o ON o.scene_id = b.scene_id""")
def scene_json(spark, sf_dir):
    """Buildings as JSON, in metres from the scene's south-western corner."""
    o = sc.points(spark, sf_dir).groupBy("scene_id").agg(F.min("x").alias("ox"), F.min("y").alias("oy"))
    x, y = half_up(geo.haversine(_p("ox", "oy"), P(F.col("x"), F.col("oy")))), half_up(geo.haversine(_p("ox", "oy"), P(F.col("ox"), F.col("y"))))
    b = sc.buildings(spark, sf_dir).join(o, "scene_id")
    return b.select("scene_id", "id", F.to_json(F.struct("id", "type", "floors", x.alias("x"), y.alias("y"))).alias("json"))


NAMED = f"""sn AS (SELECT e.scene_id, e.id, s.name, min({sql_segment('e.x', 'e.y', 's.x', 's.y', 's.bx', 's.ey')}) AS d, min(s.street_id) AS f FROM pts e JOIN st s ON s.scene_id = e.scene_id WHERE NOT regexp_matches(s.name, '^Street [0-9]+$') GROUP BY ALL),
label AS (SELECT scene_id, id, arg_min(name, (round(d, 6), name)) AS street FROM sn GROUP BY ALL)"""


def named_streets(points: DataFrame, streets: DataFrame) -> DataFrame:
    """(scene_id, id, street): the street with a real name that is nearest, all its ways together; ties to the first name."""
    real = streets.filter(~F.col("name").rlike("(?i)^street [0-9]+$")).select("scene_id", "name", F.col("x").alias("sx"), F.col("y").alias("sy"), "bx", "by")
    d = geo.segment_metres(_p("x", "y"), _p("sx", "sy"), _p("bx", "by"))
    each = points.select("scene_id", "id", "x", "y").join(real, "scene_id").groupBy("scene_id", "id", "name").agg(F.min(d).alias("d"))
    return each.groupBy("scene_id", "id").agg(F.min_by("name", F.struct(F.round("d", 6), "name")).alias("street"))


@query(f"{S}, {NAMED} SELECT * FROM label")
def named_street_label(spark, sf_dir):
    return named_streets(sc.points(spark, sf_dir), sc.streets(spark, sf_dir))


@query(f"""{S}, {NAMED}, {NN}, {NS},
ins AS (SELECT DISTINCT eq.scene_id, eq.id FROM eq JOIN bld b ON b.scene_id = eq.scene_id WHERE {SQL_IN.format(p='eq')}),
cr AS (SELECT DISTINCT a.scene_id, a.cable_id FROM dist a JOIN bld b ON a.scene_id = b.scene_id WHERE {_sql_meets('a', 'b')}),
gap AS (SELECT scene_id, id FROM nn WHERE rank = 1 AND d > 35)
SELECT e.scene_id, CAST(e.id AS VARCHAR) AS id, e.id || ' (' || e.kind || ') on_street=' || coalesce(ns.d <= 8, false) || ' nearest_street="' || coalesce(label.street, 'none') || '" inside_building=' || (ins.id IS NOT NULL) AS verdict
 FROM eq e LEFT JOIN ns ON ns.scene_id = e.scene_id AND ns.id = e.id LEFT JOIN label ON label.scene_id = e.scene_id AND label.id = e.id LEFT JOIN ins ON ins.scene_id = e.scene_id AND ins.id = e.id
UNION ALL SELECT d.scene_id, d.cable_id, d.cable_id || ' (' || d.kind || ') ' || d.source || '->' || d.target || ' crosses_foreign_building=' || (cr.cable_id IS NOT NULL) FROM dist d LEFT JOIN cr ON cr.cable_id = d.cable_id AND cr.scene_id = d.scene_id
UNION ALL SELECT b.scene_id, CAST(b.id AS VARCHAR), b.id || ' type=' || b.type || ' nearest_closure=' || coalesce(CAST(nn.other AS VARCHAR), 'none') || ' nearest_street="' || coalesce(label.street, 'none') || '" coverage_gap=' || (gap.id IS NOT NULL)
 FROM bld b LEFT JOIN nn ON nn.scene_id = b.scene_id AND nn.id = b.id AND nn.rank = 1 LEFT JOIN label ON label.scene_id = b.scene_id AND label.id = b.id LEFT JOIN gap ON gap.scene_id = b.scene_id AND gap.id = b.id
 WHERE EXISTS (SELECT 1 FROM eq x WHERE x.scene_id = b.scene_id)""")
def verdict_ledger(spark, sf_dir):
    """Every predicate of every entity as a line of text: equipment, cables and buildings (of scenes that have equipment)."""
    key = ["scene_id", "id"]
    b, e, d, s = sc.buildings(spark, sf_dir), sc.equipment(spark, sf_dir), sc.distribution(spark, sf_dir), sc.streets(spark, sf_dir)
    label = named_streets(sc.points(spark, sf_dir), s)
    street = F.coalesce("street", F.lit("none"))
    text = lambda c: F.col(c).cast("string")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("string")
    inside = sp.points_in_footprints(e, b).select(*key).distinct().withColumn("inside", F.lit(True))
    at = e.join(sp.nearest_street(e, s).select(*key, "d"), key, "left").join(label, key, "left").join(inside, key, "left")
    at = at.select("scene_id", text("id").alias("id"), F.concat(text("id"), F.lit(" ("), "kind", F.lit(") on_street="), yes(F.col("d") <= 8), F.lit(' nearest_street="'), street, F.lit('" inside_building='), yes(F.col("inside"))).alias("verdict"))
    hit = sp.segments_through_footprints(d, b).select("scene_id", "cable_id").distinct().withColumn("hit", F.lit(True))
    cables = d.join(hit, ["scene_id", "cable_id"], "left")
    cables = cables.select("scene_id", F.col("cable_id").alias("id"), F.concat("cable_id", F.lit(" ("), "kind", F.lit(") "), text("source"), F.lit("->"), text("target"), F.lit(" crosses_foreign_building="), yes(F.col("hit"))).alias("verdict"))
    near = sp.nearest(b, e, 1).select(*key, text("other").alias("closure"), (F.col("d") > 35).alias("gap"))
    houses = b.join(e.select("scene_id").distinct(), "scene_id", "left_semi").join(near, key, "left").join(label, key, "left")
    houses = houses.select("scene_id", text("id").alias("id"), F.concat(text("id"), F.lit(" type="), "type", F.lit(" nearest_closure="), F.coalesce("closure", F.lit("none")), F.lit(' nearest_street="'), street, F.lit('" coverage_gap='), yes(F.col("gap"))).alias("verdict"))
    return at.unionByName(cables).unionByName(houses)


@query(f"""{S}, t AS (SELECT scene_id, CAST(floor(min(x) / {TILE}) AS BIGINT) AS c0, CAST(floor(max(x) / {TILE}) AS BIGINT) AS c1, CAST(floor(min(y) / {TILE}) AS BIGINT) AS r0, CAST(floor(max(y) / {TILE}) AS BIGINT) AS r1 FROM pts GROUP BY 1)
SELECT scene_id, c - c0 + 1 AS col, r1 - r AS row FROM (SELECT scene_id, c0, r1, unnest(range(c0, c1 + 1)) AS c, r0 FROM t) a, LATERAL (SELECT unnest(range(a.r0, a.r1 + 1)) AS r) b""")
def zone_division(spark, sf_dir):
    """Tiles of about 200 m over a scene's box: columns from the west from 1, rows from the north from 0."""
    at = lambda f, c: f(geo.cell(F.col(c), TILE))
    t = sc.points(spark, sf_dir).groupBy("scene_id").agg(at(F.min, "x").alias("c0"), at(F.max, "x").alias("c1"), at(F.min, "y").alias("r0"), at(F.max, "y").alias("r1"))
    t = t.select("*", F.explode(F.sequence("c0", "c1")).alias("c")).select("*", F.explode(F.sequence("r0", "r1")).alias("r"))
    return t.select("scene_id", (F.col("c") - F.col("c0") + 1).alias("col"), (F.col("r1") - F.col("r")).alias("row"))


ZONED = f"zn AS (SELECT p.*, CAST(floor(x / {TILE}) AS BIGINT) AS zc, CAST(floor(y / {TILE}) AS BIGINT) AS zr FROM pts p)"


def zoned(points: DataFrame) -> DataFrame:
    return points.withColumns({"zc": geo.cell(F.col("x"), TILE), "zr": geo.cell(F.col("y"), TILE)})


@query(f"""{S}, {ZONED}, c AS (SELECT scene_id, id FROM bld b WHERE EXISTS (SELECT 1 FROM eq e WHERE e.scene_id = b.scene_id AND {sql_haversine('b.x', 'b.y', 'e.x', 'e.y')} <= 150))
SELECT zn.scene_id, zc, zr, count(*) FILTER (zn.id % 5 <> 0) AS houses, count(*) FILTER (zn.id % 5 = 0) AS closures, count(c.id) AS covered, round(CASE WHEN count(*) FILTER (zn.id % 5 <> 0) = 0 THEN 0 ELSE 100.0 * count(c.id) / count(*) FILTER (zn.id % 5 <> 0) END, 3) AS coverage
 FROM zn LEFT JOIN c ON c.scene_id = zn.scene_id AND c.id = zn.id GROUP BY ALL""")
def zone_stats(spark, sf_dir):
    """Houses, closures and the share of houses with a closure within 150 m, by zone."""
    b, e = sc.buildings(spark, sf_dir), sc.equipment(spark, sf_dir)
    covered = sp.within_metres(b, e, 150).select("scene_id", "id").distinct().withColumn("covered", F.lit(1))
    z = zoned(sc.points(spark, sf_dir)).join(covered, ["scene_id", "id"], "left")
    own = z.groupBy("scene_id", "zc", "zr").agg(F.count_if(F.col("id") % 5 != 0).alias("houses"), F.count_if(F.col("id") % 5 == 0).alias("closures"), F.count("covered").alias("covered"))
    return own.withColumn("coverage", F.round(F.when(F.col("houses") == 0, 0.0).otherwise(100.0 * F.col("covered") / F.col("houses")), 3))


@query(f"""{S}, {ZONED}, z AS (SELECT scene_id, zc, zr, count(*) AS n FROM zn GROUP BY ALL)
SELECT scene_id, count(*) AS zones, CAST(sum(n) AS BIGINT) AS points, max(n) AS most, round(avg(n), 6) AS mean FROM z GROUP BY 1""")
def area_stats(spark, sf_dir):
    z = zoned(sc.points(spark, sf_dir)).groupBy("scene_id", "zc", "zr").agg(F.count("*").alias("n"))
    return z.groupBy("scene_id").agg(F.count("*").alias("zones"), F.sum("n").alias("points"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query(f"""{S}, z AS (SELECT scene_id, CAST(floor(x / {TILE}) AS BIGINT) AS zc, CAST(floor(y / {TILE}) AS BIGINT) AS zr FROM pts GROUP BY ALL)
SELECT z.scene_id, zc, zr, count(*) AS n FROM z JOIN pts p ON p.scene_id = z.scene_id AND p.x BETWEEN zc * {TILE} AND (zc + 1) * {TILE} AND p.y BETWEEN zr * {TILE} AND (zr + 1) * {TILE} GROUP BY ALL""")
def zone_members(spark, sf_dir):
    """Points of each zone with its border on all sides, so a point on a border lands in both; empty zones are left out."""
    p = zoned(sc.points(spark, sf_dir))
    z = p.select("scene_id", "zc", "zr").distinct()
    near = F.explode(F.array(*[F.struct((F.col("zc") + i).alias("c"), (F.col("zr") + j).alias("r")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("k")
    tried = p.select("scene_id", "x", "y", near).select("scene_id", "x", "y", F.col("k.c").alias("zc"), F.col("k.r").alias("zr"))
    inside = F.col("x").between(F.col("zc") * TILE, (F.col("zc") + 1) * TILE) & F.col("y").between(F.col("zr") * TILE, (F.col("zr") + 1) * TILE)
    return tried.filter(inside).join(z, ["scene_id", "zc", "zr"], "left_semi").groupBy("scene_id", "zc", "zr").agg(F.count("*").alias("n"))


FILL = 0.0001


@query(f"""{S}, g AS (SELECT scene_id, id, x0, x1, y0, y1, unnest(range(CAST(floor(x0 / {FILL}) AS BIGINT), CAST(floor(x1 / {FILL}) AS BIGINT) + 1)) AS c FROM bld),
h AS (SELECT *, unnest(range(CAST(floor(y0 / {FILL}) AS BIGINT), CAST(floor(y1 / {FILL}) AS BIGINT) + 1)) AS r FROM g)
SELECT scene_id, id, count(*) AS cells FROM h WHERE (c + 0.5) * {FILL} >= x0 AND (c + 0.5) * {FILL} < x1 AND (r + 0.5) * {FILL} >= y0 AND (r + 0.5) * {FILL} < y1 GROUP BY ALL""")
def polygon_fill(spark, sf_dir):
    """Cells of a fine grid whose middle lies in a footprint."""
    b = sc.buildings(spark, sf_dir).select("scene_id", "id", "footprint", geo.bounds(F.col("footprint")).alias("b")).select("*", "b.*")
    g = sp.cells_of_box(b, "min_x", "min_y", "max_x", "max_y", FILL)
    return g.filter(geo.in_ring(P((F.col("cx") + 0.5) * FILL, (F.col("cy") + 0.5) * FILL), F.col("footprint"))).groupBy("scene_id", "id").agg(F.count("*").alias("cells"))


@query(f"""{S}, d AS (SELECT scene_id, cable_id, floor(bx / 0.00025) - floor(x / 0.00025) AS dc, floor(y / 0.00025) - floor(ey / 0.00025) AS dr FROM dist)
SELECT scene_id, cable_id, CASE WHEN abs(dc) >= 2 * abs(dr) THEN '-' WHEN abs(dr) >= 2 * abs(dc) THEN '|' WHEN (dc > 0) = (dr > 0) THEN chr(92) ELSE '/' END AS glyph FROM d""")
def cable_glyphs(spark, sf_dir):
    """Character of each cable on the grid, by its slope."""
    at = lambda c: geo.cell(F.col(c), 0.00025)
    return sc.distribution(spark, sf_dir).select("scene_id", "cable_id", geo.line_glyph(at("bx") - at("x"), at("y") - at("by")).alias("glyph"))


DIAMOND = [(-73.988, 40.7549), (-73.984, 40.7519), (-73.980, 40.7549), (-73.984, 40.7579)]


def _diamond() -> Column:
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in DIAMOND])


def _sql_diamond(x: str, y: str) -> str:
    edges = list(zip(DIAMOND, DIAMOND[1:] + DIAMOND[:1]))
    hits = " + ".join(f"CAST((({a[1]} > {y}) <> ({b[1]} > {y}) AND {x} < ({b[0]} - {a[0]}) * ({y} - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]}) AS INT)" if a[1] != b[1] else "0" for a, b in edges)
    return f"(({hits}) % 2 = 1)"


#: Types of streets by their number, as the supplied table has none.
HIGHWAYS = ("residential", "service", "primary", "unclassified", "tertiary")


@query(f"{S} SELECT scene_id, street_id, name FROM st WHERE street_id // 10 % 5 NOT IN (1, 3) AND ({_sql_diamond('x', 'y')} OR {_sql_diamond('bx', 'ey')})")
def streets_in_polygon(spark, sf_dir):
    """Streets other than service and unclassified ones with a vertex in a polygon: by its box first, then exactly."""
    kind = F.element_at(F.array(*map(F.lit, HIGHWAYS)), (F.floor(F.col("street_id") / 10) % len(HIGHWAYS) + 1).cast("int"))
    s = sc.streets(spark, sf_dir).withColumn("highway", kind).filter(~F.col("highway").isin("service", "unclassified"))
    box = F.exists("line", lambda v: v["x"].between(min(p[0] for p in DIAMOND), max(p[0] for p in DIAMOND)) & v["y"].between(min(p[1] for p in DIAMOND), max(p[1] for p in DIAMOND)))
    return s.filter(box).filter(F.exists("line", lambda v: geo.in_ring(P(v["x"], v["y"]), _diamond()))).select("scene_id", "street_id", "name")


@query(f"{S} SELECT scene_id, id, {_sql_diamond('x', 'y')} AS in_area, true AS in_open_area FROM pts")
def service_area(spark, sf_dir):
    """In a service area, and in one of too few vertices, which takes all in."""
    few = F.slice(_diamond(), 1, 3)
    return sc.points(spark, sf_dir).select("scene_id", "id", geo.in_service_area(_p("x", "y"), _diamond()).alias("in_area"), geo.in_service_area(_p("x", "y"), few).alias("in_open_area"))


CITIES = [("west", -73.989, 40.750, -73.984, 40.760), ("north", -73.986, 40.7549, -73.980, 40.761), ("all", -74.0, 40.74, -73.982, 40.77)]


@query(f"{S} SELECT scene_id, id, CASE " + " ".join(f"WHEN x BETWEEN {a} AND {c} AND y BETWEEN {b} AND {d} THEN '{n}'" for n, a, b, c, d in CITIES) + " END AS city FROM pts")
def containing_city(spark, sf_dir):
    """The first of a list of boxes that holds a point."""
    out = F.lit(None).cast("string")
    for name, x0, y0, x1, y1 in reversed(CITIES):
        out = F.when(F.col("x").between(x0, x1) & F.col("y").between(y0, y1), name).otherwise(out)
    return sc.points(spark, sf_dir).select("scene_id", "id", out.alias("city"))


@query(f"""{S} SELECT p.scene_id, coalesce(CAST(min(p.id) FILTER (p.id % 5 = 0 AND p.id % 50 <> 0) AS VARCHAR), 'CL-A') AS closure, coalesce(CAST(min(p.id) FILTER (p.id % 50 = 0) AS VARCHAR), 'CO') AS co,
 coalesce(CAST(min(p.id) FILTER (p.id % 5 <> 0) AS VARCHAR), 'B1') AS building, max(p.y) - min(p.y) AS span FROM pts p GROUP BY 1""")
def target_pickers(spark, sf_dir):
    """First closure, central office and first building of each scene, with names that stand in where there is none."""
    p = sc.points(spark, sf_dir)
    first = lambda cond, other: F.coalesce(F.min(F.when(cond, F.col("id"))).cast("string"), F.lit(other))
    five, fifty = F.col("id") % 5 == 0, F.col("id") % 50 == 0
    return p.groupBy("scene_id").agg(first(five & ~fifty, "CL-A").alias("closure"), first(fifty, "CO").alias("co"), first(~five, "B1").alias("building"), (F.max("y") - F.min("y")).alias("span"))


@query(f"""{S}, o AS (SELECT scene_id, id, x, y, 1 AS k FROM eq UNION ALL SELECT scene_id, id // 2, x, y, 2 FROM bld) SELECT scene_id, id, arg_min(round(x, 9), (k, round(x, 9))) AS x FROM o GROUP BY ALL""")
def entity_position(spark, sf_dir):
    """Where an id is: equipment comes before buildings."""
    e = sc.equipment(spark, sf_dir).select("scene_id", "id", "x", F.lit(1).alias("k"))
    b = sc.buildings(spark, sf_dir).select("scene_id", F.floor(F.col("id") / 2).alias("id"), "x", F.lit(2).alias("k"))
    return e.unionByName(b).groupBy("scene_id", "id").agg(F.min_by(F.round("x", 9), F.struct("k", F.round("x", 9))).alias("x"))


@query(f"{S}, b AS (SELECT scene_id, CAST(id AS VARCHAR) AS id, CAST(lead(id) OVER (PARTITION BY scene_id ORDER BY y, id) AS VARCHAR) AS o FROM bld) SELECT scene_id, least(id, o) || '|' || greatest(id, o) AS pair FROM b WHERE o IS NOT NULL")
def lexical_pairs(spark, sf_dir):
    """Neighbours from south to north as pairs in lexical order, which hides who comes first."""
    w = Window.partitionBy("scene_id").orderBy("y", "id")
    b = sc.buildings(spark, sf_dir).withColumn("o", F.lead("id").over(w).cast("string")).filter("o IS NOT NULL")
    return b.select("scene_id", F.array_join(F.sort_array(F.array(F.col("id").cast("string"), F.col("o"))), "|").alias("pair"))


_LETTERS = "CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) ELSE chr(CAST(65 + (n - 27) // 26 AS INT)) || chr(CAST(65 + (n - 27) % 26 AS INT)) END"


@query(f"{S}, e AS (SELECT scene_id, id, kind, row_number() OVER (PARTITION BY scene_id, kind ORDER BY id) AS n FROM eq), b AS (SELECT scene_id, id, row_number() OVER (PARTITION BY scene_id ORDER BY id) AS n FROM bld) SELECT scene_id, id, CASE WHEN kind = 'co' THEN 'CO-' ELSE 'CL-' END || {_LETTERS} AS name FROM e UNION ALL SELECT scene_id, id, 'B' || lpad(CAST(n AS VARCHAR), 3, '0') FROM b")
def letter_names(spark, sf_dir):
    """Names in order of creation: letters for equipment of a kind, numbers for buildings."""
    e = sc.equipment(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("scene_id", "kind").orderBy("id")))
    b = sc.buildings(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("scene_id").orderBy("id")))
    e = e.select("scene_id", "id", F.concat(F.when(F.col("kind") == "co", "CO-").otherwise("CL-"), tx.letters(F.col("n"))).alias("name"))
    return e.unionByName(b.select("scene_id", "id", F.concat(F.lit("B"), tx.padded(F.col("n"), 3)).alias("name")))


@query(f"""{S}, g AS (SELECT a.scene_id, b.id, abs(a.y - b.y) AS d FROM (SELECT scene_id, arg_min(y, id) AS y FROM eq GROUP BY 1) a JOIN bld b ON a.scene_id = b.scene_id) SELECT scene_id, arg_max(id, (round(d, 9), -id)) AS id, round(max(d), 9) AS gap FROM g GROUP BY 1""")
def largest_latitude_gap(spark, sf_dir):
    """The building farthest north or south of a scene's first piece of equipment."""
    first = sc.equipment(spark, sf_dir).groupBy("scene_id").agg(F.min_by("y", "id").alias("oy"))
    d = F.abs(F.col("y") - F.col("oy"))
    return sc.buildings(spark, sf_dir).join(first, "scene_id").groupBy("scene_id").agg(F.max_by("id", F.struct(F.round(d, 9), -F.col("id"))).alias("id"), F.round(F.max(d), 9).alias("gap"))


def _node(x: Column, y: Column) -> Column:
    return geo.cell(x, 0.001) * 1_000_000 + geo.cell(y, 0.001)


INTER = "n AS (SELECT scene_id, CAST(floor(x / 0.001) AS BIGINT) * 1000000 + CAST(floor(y / 0.001) AS BIGINT) AS node, street_id FROM st UNION ALL SELECT scene_id, CAST(floor(bx / 0.001) AS BIGINT) * 1000000 + CAST(floor(ey / 0.001) AS BIGINT), street_id FROM st)"


@query(f"{S}, {INTER} SELECT scene_id, node, count(DISTINCT street_id) > 1 AS intersection, array_to_string(list_sort(list_distinct(list(street_id))), ',') AS streets FROM n GROUP BY ALL")
def intersections(spark, sf_dir):
    """Ends of streets merged by cells, with the union of their streets; several make an intersection."""
    n = sc.streets(spark, sf_dir).select("scene_id", "street_id", F.explode("line").alias("v")).select("scene_id", "street_id", _node(F.col("v.x"), F.col("v.y")).alias("node"))
    own = n.groupBy("scene_id", "node").agg(F.array_sort(F.collect_set("street_id")).alias("s"))
    return own.select("scene_id", "node", (F.size("s") > 1).alias("intersection"), F.array_join(F.transform("s", lambda k: k.cast("string")), ",").alias("streets"))


@query(f"{S}, d AS (SELECT b.scene_id, b.id, e.id AS other, {sql_haversine('b.x', 'b.y', 'e.x', 'e.y')} AS d FROM bld b JOIN eq e ON e.scene_id = b.scene_id) SELECT scene_id, id, arg_min(other, (round(d, 6), other)) AS node, round(min(d), 3) AS metres FROM d WHERE d <= 300 GROUP BY ALL")
def nearest_node_in_radius(spark, sf_dir):
    near = sp.within_metres(sc.buildings(spark, sf_dir), sc.equipment(spark, sf_dir), 300)
    return near.groupBy("scene_id", "id").agg(F.min_by("other", F.struct(F.round("d", 6), "other")).alias("node"), F.round(F.min("d"), 3).alias("metres"))


@query(f"{S} SELECT scene_id, CASE WHEN abs(ey - y) > abs(bx - x) THEN CASE WHEN ey - y > 0 THEN 'north' ELSE 'south' END ELSE CASE WHEN bx - x > 0 THEN 'east' ELSE 'west' END END AS direction, count(*) AS n, string_agg(cable_id, ',' ORDER BY cable_id) AS cables FROM dist GROUP BY ALL")
def links_by_direction(spark, sf_dir):
    d = sc.distribution(spark, sf_dir).withColumn("direction", geo.direction(_p("x", "y"), _p("bx", "by")))
    return d.groupBy("scene_id", "direction").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("cable_id")), ",").alias("cables"))


@query(f"""{S}, z AS (SELECT scene_id, street_id, lower(trim(name)) AS name, x, y, bx, ey, {sql_haversine('x', 'y', 'bx', 'ey')} AS m, unnest(list_distinct([{{'zc': CAST(floor(x / {TILE}) AS BIGINT), 'zr': CAST(floor(y / {TILE}) AS BIGINT)}}, {{'zc': CAST(floor(bx / {TILE}) AS BIGINT), 'zr': CAST(floor(ey / {TILE}) AS BIGINT)}}])) AS k FROM st),
g AS (SELECT scene_id, street_id, name, m, k.zc AS zc, k.zr AS zr, greatest(0, least(19, floor((x - k.zc * {TILE}) / ({TILE} / 20)))) AS ax, greatest(0, least(19, 19 - floor((y - k.zr * {TILE}) / ({TILE} / 20)))) AS ay,
 greatest(0, least(19, floor((bx - k.zc * {TILE}) / ({TILE} / 20)))) AS cx, greatest(0, least(19, 19 - floor((ey - k.zr * {TILE}) / ({TILE} / 20)))) AS cy FROM z)
SELECT scene_id, zc, zr, name, street_id AS longest, CAST(floor((ax + cx) / 2) AS INT) AS col, CAST(floor((ay + cy) / 2) AS INT) AS row, CASE WHEN abs(cx - ax) >= abs(cy - ay) THEN 'horizontal' ELSE 'vertical' END AS orientation
FROM g QUALIFY row_number() OVER (PARTITION BY scene_id, zc, zr, name ORDER BY round(m, 6) DESC, street_id) = 1""")
def street_annotation(spark, sf_dir):
    """Where a zone writes a street's name: the longest segment of that name with an end in the zone, the middle of its ends on the
    zone's grid of 20 by 20 cells, and the way it runs there."""
    s = sc.streets(spark, sf_dir).withColumns({"m": F.round(geo.line_metres(F.col("line")), 6), "name": F.lower(F.trim("name"))})
    zone = lambda x, y: F.struct(geo.cell(F.col(x), TILE).alias("zc"), geo.cell(F.col(y), TILE).alias("zr"))
    z = s.withColumn("z", F.explode(F.array_distinct(F.array(zone("x", "y"), zone("bx", "by"))))).select("*", "z.*")
    inner = lambda c, k: F.floor((F.col(c) - F.col(k) * TILE) / (TILE / 20))
    held = lambda c: F.greatest(F.lit(0), F.least(F.lit(19), c))
    ends = {"ax": held(inner("x", "zc")), "ay": held(19 - inner("y", "zr")), "cx": held(inner("bx", "zc")), "cy": held(19 - inner("by", "zr"))}
    best = z.withColumns(ends).groupBy("scene_id", "zc", "zr", "name").agg(F.max_by(F.struct("street_id", "ax", "ay", "cx", "cy"), F.struct("m", -F.col("street_id"))).alias("s")).select("scene_id", "zc", "zr", "name", "s.*")
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2).cast("int")
    flat = F.abs(F.col("cx") - F.col("ax")) >= F.abs(F.col("cy") - F.col("ay"))
    return best.select("scene_id", "zc", "zr", "name", F.col("street_id").alias("longest"), middle("ax", "cx").alias("col"), middle("ay", "cy").alias("row"), F.when(flat, "horizontal").otherwise("vertical").alias("orientation"))


@query(f"""{S} SELECT scene_id, street_id, round(b, 6) AS bearing, round(asin(sin(radians(my)) * cos(5 / 6371000.0) + cos(radians(my)) * sin(5 / 6371000.0) * cos(radians(b + 90))) * 180 / pi(), 8) AS right_lat
FROM (SELECT *, (x + bx) / 2 AS mx, (y + ey) / 2 AS my, (degrees(atan2(sin(radians(bx - x)) * cos(radians(ey)), cos(radians(y)) * sin(radians(ey)) - sin(radians(y)) * cos(radians(ey)) * cos(radians(bx - x)))) + 360) % 360 AS b FROM st)""")
def sidewalk_nodes(spark, sf_dir):
    """Bearing of a street and the latitude of a point five metres to the right of its middle."""
    b = geo.bearing(_p("x", "y"), _p("bx", "by"))
    middle = P((F.col("x") + F.col("bx")) / 2, (F.col("y") + F.col("by")) / 2)
    return sc.streets(spark, sf_dir).select("scene_id", "street_id", F.round(b, 6).alias("bearing"), F.round(geo.destination(middle, F.lit(5.0), b + 90).y, 8).alias("right_lat"))


_T = "greatest(0.0, least(1.0, coalesce(((e.x - s.x) * (s.bx - s.x) + (e.y - s.y) * (s.ey - s.y)) / nullif((s.bx - s.x) * (s.bx - s.x) + (s.ey - s.y) * (s.ey - s.y), 0), 0)))"


@query(f"{S}, d AS (SELECT e.scene_id, e.id, sqrt(pow(e.x - (s.x + {_T} * (s.bx - s.x)), 2) + pow(e.y - (s.y + {_T} * (s.ey - s.y)), 2)) AS d FROM eq e JOIN st s ON s.scene_id = e.scene_id) SELECT scene_id, id, round(min(d), 9) AS degrees, min(d) <= 0.0001 AS on_road FROM d GROUP BY ALL")
def on_road_degrees(spark, sf_dir):
    """Distance from the nearest street in degrees, as the check of cables takes it."""
    s = sc.streets(spark, sf_dir).select("scene_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "bx", "by")
    d = F.min(geo.segment_degrees(_p("x", "y"), _p("sx", "sy"), _p("bx", "by")))
    return sc.equipment(spark, sf_dir).join(s, "scene_id").groupBy("scene_id", "id").agg(F.round(d, 9).alias("degrees"), (d <= 0.0001).alias("on_road"))


_INNER = " OR ".join(f"(d.x + (d.bx - d.x) * {k} / 10 >= b.x0 AND d.x + (d.bx - d.x) * {k} / 10 < b.x1 AND d.y + (d.ey - d.y) * {k} / 10 >= b.y0 AND d.y + (d.ey - d.y) * {k} / 10 < b.y1)" for k in range(1, 10))


@query(f"{S} SELECT d.scene_id, d.cable_id, count(*) AS n FROM dist d JOIN bld b ON b.scene_id = d.scene_id WHERE {_INNER} GROUP BY ALL")
def sampled_crossings(spark, sf_dir):
    """Buildings in which one of nine inner points of a cable lies."""
    d, b = sc.distribution(spark, sf_dir), sc.buildings(spark, sf_dir).select("scene_id", F.col("id").alias("area"), "footprint")
    hit = geo.segment_meets_ring(_p("x", "y"), _p("bx", "by"), F.col("footprint"), "sampled")
    return d.join(b, "scene_id").filter(hit).groupBy("scene_id", "cable_id").agg(F.count("*").alias("n"))


#: Where the customers of one cell are drawn, in order; further ones are drawn on the cell itself.
SPIRAL = [(0, 0), (1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (-1, 1), (-1, -1), (1, -1), (2, 0), (0, 2), (-2, 0), (0, -2)]
OVERLAY = 0.002  # degrees of a cell, so that some hold more customers than there are places


@query(f"{S}, c AS (SELECT scene_id, id, CAST(floor(x / {OVERLAY}) AS BIGINT) AS c, CAST(floor(y / {OVERLAY}) AS BIGINT) AS r FROM bld), n AS (SELECT *, row_number() OVER (PARTITION BY scene_id, c, r ORDER BY id) - 1 AS k FROM c) SELECT scene_id, id, c + coalesce(({[p[0] for p in SPIRAL]})[CAST(k + 1 AS INT)], 0) AS col, r + coalesce(({[p[1] for p in SPIRAL]})[CAST(k + 1 AS INT)], 0) AS row FROM n")
def customer_overlay(spark, sf_dir):
    """Customers of one cell spread over it and its neighbours, in order of their ids; those beyond the places stay on the cell."""
    b = sc.buildings(spark, sf_dir).select("scene_id", "id", geo.cell(F.col("x"), OVERLAY).alias("c"), geo.cell(F.col("y"), OVERLAY).alias("r"))
    k = F.row_number().over(Window.partitionBy("scene_id", "c", "r").orderBy("id")) - 1
    step = lambda i: F.coalesce(F.get(F.array(*[F.lit(p[i]) for p in SPIRAL]), F.col("k")), F.lit(0))
    return b.withColumn("k", k).select("scene_id", "id", (F.col("c") + step(0)).alias("col"), (F.col("r") + step(1)).alias("row"))


@query(f"{S}, {NN.replace('FROM bld a JOIN eq e', 'FROM eq a JOIN bld e')} SELECT scene_id, id AS closure, other AS building, round(d, 3) AS metres FROM nn WHERE rank = 1")
def nearest_building_to_closure(spark, sf_dir):
    near = sp.nearest(sc.equipment(spark, sf_dir), sc.buildings(spark, sf_dir), 1)
    return near.select("scene_id", F.col("id").alias("closure"), F.col("other").alias("building"), F.round("d", 3).alias("metres"))


@query(f"{S} SELECT a.scene_id, a.cable_id, count(b.id) > 0 AS crosses FROM dist a LEFT JOIN bld b ON a.scene_id = b.scene_id AND {_sql_meets('a', 'b')} GROUP BY ALL")
def crossing_boolean(spark, sf_dir):
    """Does a cable run through any building?"""
    d = sc.distribution(spark, sf_dir)
    hit = sp.segments_through_footprints(d, sc.buildings(spark, sf_dir)).select("scene_id", "cable_id").distinct().withColumn("hit", F.lit(True))
    return d.select("scene_id", "cable_id").join(hit, ["scene_id", "cable_id"], "left").select("scene_id", "cable_id", F.coalesce("hit", F.lit(False)).alias("crosses"))


@query(f"{S} SELECT d.scene_id, d.cable_id, a.kind || ' ' || a.id AS source, b.kind || ' ' || b.id AS target FROM dist d JOIN eq a ON a.scene_id = d.scene_id AND a.id = d.source JOIN eq b ON b.scene_id = d.scene_id AND b.id = d.target")
def cable_endpoints(spark, sf_dir):
    """Ids and kinds of a cable's ends."""
    e = sc.equipment(spark, sf_dir).select("scene_id", "id", F.concat_ws(" ", "kind", F.col("id").cast("string")).alias("named"))
    side = lambda x: e.select("scene_id", F.col("id").alias(x), F.col("named").alias("n_" + x))
    d = sc.distribution(spark, sf_dir).select("scene_id", "cable_id", "source", "target").join(side("source"), ["scene_id", "source"]).join(side("target"), ["scene_id", "target"])
    return d.select("scene_id", "cable_id", F.col("n_source").alias("source"), F.col("n_target").alias("target"))
