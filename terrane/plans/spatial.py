"""Spatial queries on the derived scenes; the question truths among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions.geo import P
from terrane.functions.stats import half_up
from terrane.operators import spatial as sp
from terrane.sources import scenes as sc
from terrane.sources.scenes import SCENE_SQL, sql_haversine, sql_segment

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
W = f"WITH {SCENE_SQL}"

#: Inside a square footprint by the even-odd rule: half open towards east and north.
SQL_IN = "({p}.x >= b.x0 AND {p}.x < b.x1 AND {p}.y >= b.y0 AND {p}.y < b.y1)"


def _sql_meets(a: str, b: str) -> str:
    """Segment (ax, ay)-(bx, by) against the square of b: an end inside or a proper crossing of an edge."""
    edges = [("b.x0", "b.y0", "b.x1", "b.y0"), ("b.x1", "b.y0", "b.x1", "b.y1"), ("b.x1", "b.y1", "b.x0", "b.y1"), ("b.x0", "b.y1", "b.x0", "b.y0")]
    turn = lambda p, q, r: f"(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
    s, t = (f"{a}.x", f"{a}.y"), (f"{a}.bx", f"{a}.ey")
    inside = lambda p: f"({p[0]} >= b.x0 AND {p[0]} < b.x1 AND {p[1]} >= b.y0 AND {p[1]} < b.y1)"
    cross = " OR ".join(f"({turn(e[:2], e[2:], s)} * {turn(e[:2], e[2:], t)} < 0 AND {turn(s, t, e[:2])} * {turn(s, t, e[2:])} < 0)" for e in edges)
    return f"({inside(s)} OR {inside(t)} OR {cross})"


def _p(x: str, y: str) -> P:
    return P(F.col(x), F.col(y))


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _join_scene(left: DataFrame, right: DataFrame) -> DataFrame:
    others = right.select("scene_id", F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return left.join(others, "scene_id")


@query(f"{W} SELECT DISTINCT eq.scene_id, eq.id FROM eq JOIN bld b ON b.scene_id = eq.scene_id WHERE {SQL_IN.format(p='eq')}")
def containment(spark, sf_dir):
    """Equipment inside a building."""
    found = sp.points_in_footprints(sc.equipment(spark, sf_dir), sc.buildings(spark, sf_dir))
    return found.select("scene_id", "id").distinct()


@query(f"{W} SELECT eq.scene_id, count(DISTINCT eq.id) AS n FROM eq JOIN bld b ON b.scene_id = eq.scene_id WHERE {SQL_IN.format(p='eq')} GROUP BY 1")
def ho_count_inside(spark, sf_dir):
    return containment(spark, sf_dir).groupBy("scene_id").agg(F.count("*").alias("n"))


NN = f"""nn AS (SELECT * FROM (SELECT a.scene_id, a.id, e.id AS other, {sql_haversine('a.x', 'a.y', 'e.x', 'e.y')} AS d,
 row_number() OVER (PARTITION BY a.scene_id, a.id ORDER BY {sql_haversine('a.x', 'a.y', 'e.x', 'e.y')}, e.id) AS rank FROM bld a JOIN eq e ON a.scene_id = e.scene_id) WHERE rank <= 4)"""


@query(f"{W}, {NN} SELECT scene_id, id, other AS closure, round(d, 3) AS metres FROM nn WHERE rank = 1")
def nearest_closure(spark, sf_dir):
    near = sp.nearest(sc.buildings(spark, sf_dir), sc.equipment(spark, sf_dir), 1)
    return near.select("scene_id", "id", F.col("other").alias("closure"), F.round("d", 3).alias("metres"))


@query(f"{W}, {NN} SELECT scene_id, id, other AS closure, rank FROM nn WHERE rank <= 3")
def nearest_k(spark, sf_dir):
    near = sp.nearest(sc.buildings(spark, sf_dir), sc.equipment(spark, sf_dir), 3)
    return near.select("scene_id", "id", F.col("other").alias("closure"), F.col("rank").cast("long").alias("rank"))


@query(f"{W}, {NN}, p AS (SELECT scene_id, id, max(other) FILTER (rank = 1) AS first, max(d) FILTER (rank = 2) - max(d) FILTER (rank = 1) AS m1, max(d) FILTER (rank = 3) - max(d) FILTER (rank = 2) AS m2, max(d) FILTER (rank = 4) - max(d) FILTER (rank = 3) AS m3 FROM nn GROUP BY ALL) SELECT scene_id, id, first, m1 >= 1 AND m2 >= 1 AND coalesce(m3 >= 2, true) AS separated FROM p WHERE m2 IS NOT NULL")
def rank3_with_margins(spark, sf_dir):
    near = sp.nearest(sc.buildings(spark, sf_dir), sc.equipment(spark, sf_dir), 4)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    p = near.groupBy("scene_id", "id").agg(at(1, "other").alias("first"), (at(2, "d") - at(1, "d")).alias("m1"), (at(3, "d") - at(2, "d")).alias("m2"), (at(4, "d") - at(3, "d")).alias("m3"))
    return p.filter("m2 IS NOT NULL").select("scene_id", "id", "first", F.expr("m1 >= 1 AND m2 >= 1 AND coalesce(m3 >= 2, true)").alias("separated"))


@query(f"{W} SELECT b.scene_id, b.id FROM bld b WHERE NOT EXISTS (SELECT 1 FROM eq e WHERE e.scene_id = b.scene_id AND {sql_haversine('b.x', 'b.y', 'e.x', 'e.y')} <= 35)")
def coverage_gap(spark, sf_dir):
    return sp.coverage_gaps(sc.buildings(spark, sf_dir), sc.equipment(spark, sf_dir)).select("scene_id", "id")


@query(f"{W} SELECT a.scene_id, a.id, count(b.id) AS n FROM eq a LEFT JOIN bld b ON a.scene_id = b.scene_id AND {sql_haversine('a.x', 'a.y', 'b.x', 'b.y')} <= 150 GROUP BY ALL")
def within_radius_count(spark, sf_dir):
    eq = sc.equipment(spark, sf_dir)
    pairs = sp.within_metres(eq, sc.buildings(spark, sf_dir), 150).groupBy("scene_id", "id").agg(F.count("*").alias("n"))
    return eq.select("scene_id", "id").join(pairs, ["scene_id", "id"], "left").fillna(0, ["n"])


@query(f"{W} SELECT DISTINCT a.scene_id, a.cable_id FROM dist a JOIN bld b ON a.scene_id = b.scene_id WHERE {_sql_meets('a', 'b')}")
def crossing(spark, sf_dir):
    """Distribution cables that run through a building."""
    return sp.segments_through_footprints(sc.distribution(spark, sf_dir), sc.buildings(spark, sf_dir)).select("scene_id", "cable_id").distinct()


DROPS = f"drops AS (SELECT nn.scene_id, 'drop-' || nn.id AS cable_id, nn.other AS source, nn.id AS target, e.x, e.y, b.x AS bx, b.y AS ey FROM nn JOIN eq e ON e.id = nn.other AND e.scene_id = nn.scene_id JOIN bld b ON b.id = nn.id AND b.scene_id = nn.scene_id WHERE rank = 1)"


def drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, e = sc.buildings(spark, sf_dir), sc.equipment(spark, sf_dir)
    near = sp.nearest(b, e, 1).select("scene_id", F.col("id").alias("target"), F.col("other").alias("source"))
    at = e.select("scene_id", F.col("id").alias("source"), "x", "y")
    to = b.select("scene_id", F.col("id").alias("target"), F.col("x").alias("bx"), F.col("y").alias("by"))
    cables = near.join(at, ["scene_id", "source"]).join(to, ["scene_id", "target"])
    return cables.select("scene_id", F.concat(F.lit("drop-"), F.col("target").cast("string")).alias("cable_id"), "source", "target", "x", "y", "bx", "by")


@query(f"{W}, {NN}, {DROPS} SELECT DISTINCT a.scene_id, a.cable_id FROM drops a JOIN bld b ON a.scene_id = b.scene_id AND b.id <> a.target WHERE {_sql_meets('a', 'b')}")
def drop_crossing(spark, sf_dir):
    """Drops that run through a building other than the one they serve."""
    hits = sp.segments_through_footprints(drops(spark, sf_dir), sc.buildings(spark, sf_dir))
    return hits.filter("area <> target").select("scene_id", "cable_id").distinct()


@query(f"""{W}, k AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY source) AS k FROM dist), h AS (SELECT a.scene_id, b.id, min(k) AS k FROM k a JOIN bld b ON b.scene_id = a.scene_id AND {_sql_meets('a', 'b')} GROUP BY ALL)
SELECT scene_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k, id) AS crossed FROM h GROUP BY 1""")
def crossed_buildings(spark, sf_dir):
    """The buildings that the line through all closures of a scene passes through, each once, by the stretch that meets it first."""
    trunk = sc.distribution(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("scene_id").orderBy("source")))
    hits = sp.segments_through_footprints(trunk, sc.buildings(spark, sf_dir)).groupBy("scene_id", "area").agg(F.min("k").alias("k"))
    order = F.array_sort(F.collect_list(F.struct("k", "area")))
    return hits.groupBy("scene_id").agg(F.array_join(F.transform(order, lambda s: s["area"].cast("string")), ",").alias("crossed"))


NS = f"""ns AS (SELECT * FROM (SELECT e.scene_id, e.id, s.street_id, s.name, {sql_segment('e.x', 'e.y', 's.x', 's.y', 's.bx', 's.ey')} AS d,
 row_number() OVER (PARTITION BY e.scene_id, e.id ORDER BY round({sql_segment('e.x', 'e.y', 's.x', 's.y', 's.bx', 's.ey')}, 6), s.street_id) AS r FROM pts e JOIN st s ON s.scene_id = e.scene_id) WHERE r = 1)"""


@query(f"{W}, {NS} SELECT scene_id, id, street_id, name, round(d, 3) AS metres FROM ns")
def nearest_street(spark, sf_dir):
    near = sp.nearest_street(sc.points(spark, sf_dir), sc.streets(spark, sf_dir))
    return near.select("scene_id", "id", "street_id", "name", F.round("d", 3).alias("metres"))


@query(f"{W}, {NS} SELECT ns.scene_id, ns.id, d <= 8 AS on_street, d <= 2 AND kind <> 'co' AS in_road FROM ns JOIN eq ON eq.id = ns.id AND eq.scene_id = ns.scene_id")
def on_street(spark, sf_dir):
    e = sc.equipment(spark, sf_dir)
    near = sp.nearest_street(e, sc.streets(spark, sf_dir)).join(e.select("scene_id", "id", "kind"), ["scene_id", "id"])
    return near.select("scene_id", "id", (F.col("d") <= 8).alias("on_street"), ((F.col("d") <= 2) & (F.col("kind") != "co")).alias("in_road"))


@query(f"{W}, {NS} SELECT ns.scene_id, ns.id FROM ns JOIN eq ON eq.id = ns.id AND eq.scene_id = ns.scene_id WHERE d <= 2 AND kind <> 'co'")
def road_misplacement(spark, sf_dir):
    return on_street(spark, sf_dir).filter("in_road").select("scene_id", "id")


@query(f"""{W}, {NS}, o AS (SELECT b.scene_id, b.id, e.id AS other, row_number() OVER (PARTITION BY b.scene_id, b.id ORDER BY {sql_haversine('b.x', 'b.y', 'e.x', 'e.y')}, e.id) AS r
 FROM bld b JOIN eq e ON e.scene_id = b.scene_id JOIN ns h ON h.scene_id = b.scene_id AND h.id = b.id JOIN ns s ON s.scene_id = e.scene_id AND s.id = e.id WHERE h.name IS DISTINCT FROM s.name)
SELECT b.scene_id, b.id, coalesce(CAST(o.other AS VARCHAR), 'none') AS closure FROM bld b LEFT JOIN o ON o.scene_id = b.scene_id AND o.id = b.id AND o.r = 1""")
def nearest_offstreet(spark, sf_dir):
    """Nearest closure on another street than the building's, or 'none'. Closures are few per scene."""
    near = sp.nearest_street(sc.points(spark, sf_dir), sc.streets(spark, sf_dir)).select("scene_id", "id", "name")
    b = sc.buildings(spark, sf_dir).select("scene_id", "id", "x", "y").join(near.withColumnRenamed("name", "home"), ["scene_id", "id"], "left")
    e = sc.equipment(spark, sf_dir).join(near, ["scene_id", "id"]).select("scene_id", F.col("id").alias("other"), "name", F.col("x").alias("ox"), F.col("y").alias("oy"))
    pairs = b.join(e, "scene_id").filter("NOT (home <=> name)").withColumn("d", geo.haversine(_p("x", "y"), _p("ox", "oy")))
    best = pairs.groupBy("scene_id", "id").agg(F.min_by("other", F.struct("d", "other")).alias("other"))
    return b.select("scene_id", "id").join(best, ["scene_id", "id"], "left").select("scene_id", "id", F.coalesce(F.col("other").cast("string"), F.lit("none")).alias("closure"))


@query(f"{W}, c AS (SELECT scene_id, avg(x) AS cx, avg(y) AS cy FROM bld GROUP BY 1), q AS (SELECT b.scene_id, CASE WHEN b.y > cy THEN 'N' ELSE 'S' END || CASE WHEN b.x > cx THEN 'E' ELSE 'W' END AS q, count(*) AS n FROM bld b JOIN c ON c.scene_id = b.scene_id GROUP BY ALL) SELECT scene_id, q AS quadrant, n FROM (SELECT *, rank() OVER (PARTITION BY scene_id ORDER BY n DESC) AS r FROM q) WHERE r = 1")
def densest_quadrant(spark, sf_dir):
    b = sc.buildings(spark, sf_dir)
    c = b.groupBy("scene_id").agg(F.avg("x").alias("ox"), F.avg("y").alias("oy"))
    q = b.join(c, "scene_id").groupBy("scene_id", geo.quadrant(_p("x", "y"), _p("ox", "oy")).alias("quadrant")).agg(F.count("*").alias("n"))
    return q.withColumn("r", F.rank().over(Window.partitionBy("scene_id").orderBy(F.desc("n")))).filter("r = 1").drop("r")


@query(f"{W}, {NN} SELECT b.scene_id, b.id, CASE WHEN e.y > b.y THEN 'north' ELSE 'south' END AS bearing, CASE WHEN abs(e.y - b.y) > abs(e.x - b.x) THEN CASE WHEN e.y > b.y THEN 'north' ELSE 'south' END ELSE CASE WHEN e.x > b.x THEN 'east' ELSE 'west' END END AS direction FROM bld b JOIN nn ON nn.id = b.id AND nn.scene_id = b.scene_id AND nn.rank = 1 JOIN eq e ON e.id = nn.other AND e.scene_id = b.scene_id")
def bearing_to_closure(spark, sf_dir):
    d = drops(spark, sf_dir)  # from the closure (x, y) to the building (bx, by)
    return d.select("scene_id", F.col("target").alias("id"), geo.north_south(_p("x", "y"), _p("bx", "by")).alias("bearing"), geo.direction(_p("bx", "by"), _p("x", "y")).alias("direction"))


_E8 = "((d.bx - d.x) * 111320.0 * cos(radians(d.y)))", "((d.ey - d.y) * 110540.0)"


@query(f"""{W}, a AS (SELECT scene_id, cable_id, {_E8[0]} AS dx, {_E8[1]} AS dy FROM dist d),
g AS (SELECT *, CASE WHEN degrees(atan2(dx, dy)) < 0 THEN degrees(atan2(dx, dy)) + 360 ELSE degrees(atan2(dx, dy)) END / 45 AS k FROM a)
SELECT scene_id, cable_id, CASE WHEN sqrt(dx * dx + dy * dy) >= 20 AND abs(k - floor(k + 0.5)) * 45 <= 16.5 THEN ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(k + 0.5) AS INT) % 8 + 1] END AS compass FROM g""")
def bearing8(spark, sf_dir):
    return sc.distribution(spark, sf_dir).select("scene_id", "cable_id", geo.compass8(_p("x", "y"), _p("bx", "by")).alias("compass"))


@query(f"{W} SELECT scene_id, cable_id, round({sql_haversine('d.x', 'd.y', 'd.bx', 'd.ey')}, 3) AS metres, round((x + bx) / 2, 9) AS mid_x, round((y + ey) / 2, 9) AS mid_y FROM dist d")
def haversine_pairs(spark, sf_dir):
    return sc.distribution(spark, sf_dir).select("scene_id", "cable_id", F.round(geo.haversine(_p("x", "y"), _p("bx", "by")), 3).alias("metres"), F.round((F.col("x") + F.col("bx")) / 2, 9).alias("mid_x"), F.round((F.col("y") + F.col("by")) / 2, 9).alias("mid_y"))


@query(f"{W}, m AS (SELECT scene_id, source AS id, (x + bx) / 2 AS x, (y + ey) / 2 AS y FROM dist), r AS (SELECT m.scene_id, m.id, b.id AS other, row_number() OVER (PARTITION BY m.scene_id, m.id ORDER BY {sql_haversine('m.x', 'm.y', 'b.x', 'b.y')}, b.id) AS r FROM m JOIN bld b ON b.scene_id = m.scene_id) SELECT scene_id, id, other AS building FROM r WHERE r = 1")
def midpoint_nearest(spark, sf_dir):
    pairs = sc.distribution(spark, sf_dir).withColumnRenamed("source", "id")
    return sp.rank_of_midpoint(pairs, sc.buildings(spark, sf_dir), 1).select("scene_id", "id", F.col("other").alias("building"))


@query(f"{W}, n AS (SELECT a.scene_id, a.id, min({sql_haversine('a.x', 'a.y', 'b.x', 'b.y')}) AS d FROM bld a JOIN bld b ON a.scene_id = b.scene_id AND a.id <> b.id GROUP BY ALL) SELECT scene_id, id, round(d, 3) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY d DESC, id) AS r FROM n) WHERE r = 1")
def most_isolated(spark, sf_dir):
    b = sc.buildings(spark, sf_dir)
    near = sp.nearest(b, b, 1)
    best = near.groupBy("scene_id").agg(F.max_by(F.struct("id", "d"), F.struct("d", -F.col("id"))).alias("s"))
    return best.select("scene_id", "s.id", F.round("s.d", 3).alias("metres"))


@query(f"{W}, co AS (SELECT scene_id, arg_min(x, id) AS x, arg_min(y, id) AS y FROM eq GROUP BY 1) SELECT scene_id, id FROM (SELECT b.scene_id, b.id, row_number() OVER (PARTITION BY b.scene_id ORDER BY {sql_haversine('b.x', 'b.y', 'co.x', 'co.y')} DESC, b.id) AS r FROM bld b JOIN co ON co.scene_id = b.scene_id) WHERE r = 1")
def farthest_from_source(spark, sf_dir):
    co = sc.equipment(spark, sf_dir).groupBy("scene_id").agg(F.min_by("x", "id").alias("ox"), F.min_by("y", "id").alias("oy"))
    d = sc.buildings(spark, sf_dir).join(co, "scene_id").withColumn("d", geo.haversine(_p("x", "y"), _p("ox", "oy")))
    return d.groupBy("scene_id").agg(F.max_by("id", F.struct("d", -F.col("id"))).alias("id"))


@query(f"{W}, co AS (SELECT scene_id, arg_min(x, id) AS x, arg_min(y, id) AS y FROM eq GROUP BY 1), far AS (SELECT scene_id, x, y, bx, ey, id FROM (SELECT b.scene_id, co.x, co.y, b.x AS bx, b.y AS ey, b.id, row_number() OVER (PARTITION BY b.scene_id ORDER BY {sql_haversine('b.x', 'b.y', 'co.x', 'co.y')} DESC, b.id) AS r FROM bld b JOIN co ON co.scene_id = b.scene_id) WHERE r = 1) SELECT a.scene_id, b.id FROM far a JOIN bld b ON b.scene_id = a.scene_id AND b.id <> a.id WHERE {_sql_meets('a', 'b')}")
def blockage(spark, sf_dir):
    """Buildings on the straight line from the source to the farthest building."""
    b = sc.buildings(spark, sf_dir)
    co = sc.equipment(spark, sf_dir).groupBy("scene_id").agg(F.min_by("x", "id").alias("ox"), F.min_by("y", "id").alias("oy"))
    far = b.join(co, "scene_id").withColumn("d", geo.haversine(_p("x", "y"), _p("ox", "oy"))).groupBy("scene_id").agg(F.max_by(F.struct("id", "x", "y", "ox", "oy"), F.struct("d", -F.col("id"))).alias("f"))
    line = far.select("scene_id", F.col("f.id").alias("far"), F.col("f.ox").alias("x"), F.col("f.oy").alias("y"), F.col("f.x").alias("bx"), F.col("f.y").alias("by"))
    return sp.segments_through_footprints(line, b).filter("area <> far").select("scene_id", F.col("area").alias("id"))


@query(f"{W} SELECT scene_id, type, count(*) AS n, CAST(sum(floors) AS BIGINT) AS floors FROM bld GROUP BY ALL")
def count_by_kind(spark, sf_dir):
    return sc.buildings(spark, sf_dir).groupBy("scene_id", "type").agg(F.count("*").alias("n"), F.sum("floors").alias("floors"))


@query(f"{W}, {NS} SELECT ns.scene_id, ns.name, count(*) AS n FROM ns JOIN bld b ON b.id = ns.id AND b.scene_id = ns.scene_id WHERE NOT regexp_matches(ns.name, '(?i)^street \\d+$') GROUP BY ALL")
def count_on_street(spark, sf_dir):
    """Buildings by real street name: not of the form 'street <number>'."""
    near = sp.nearest_street(sc.buildings(spark, sf_dir), sc.streets(spark, sf_dir))
    return near.filter(~F.col("name").rlike(r"(?i)^street \d+$")).groupBy("scene_id", "name").agg(F.count("*").alias("n"))


@query(f"{W} SELECT scene_id, id FROM pts WHERE x BETWEEN -73.986 AND -73.982 AND y BETWEEN 40.753 AND 40.757")
def bbox_filter(spark, sf_dir):
    return sc.points(spark, sf_dir).filter("x BETWEEN -73.986 AND -73.982 AND y BETWEEN 40.753 AND 40.757").select("scene_id", "id")


_TRI = [(-73.987, 40.752), (-73.981, 40.7535), (-73.984, 40.758)]
_SIDE = lambda i, j: f"(({_TRI[j][0]} - {_TRI[i][0]}) * (y - {_TRI[i][1]}) - ({_TRI[j][1]} - {_TRI[i][1]}) * (x - {_TRI[i][0]}))"


@query(f"{W} SELECT scene_id, id FROM pts WHERE {_SIDE(0, 1)} > 0 AND {_SIDE(1, 2)} > 0 AND {_SIDE(2, 0)} > 0")
def polygon_filter(spark, sf_dir):
    """Points in a triangle: bounding box first (it reaches the scan), then the exact test."""
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _TRI])
    xs, ys = zip(*_TRI)
    box = F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys))
    return sc.points(spark, sf_dir).filter(box & geo.in_ring(_p("x", "y"), ring)).select("scene_id", "id")


@query(f"{W} SELECT scene_id, id, round(x, 9) AS cx, round(y, 9) AS cy, round(x0, 9) AS min_x, round(y1, 9) AS max_y FROM bld")
def centroid_and_bounds(spark, sf_dir):
    b = sc.buildings(spark, sf_dir)
    c, k = geo.centroid(F.col("footprint")), geo.bounds(F.col("footprint"))
    return b.select("scene_id", "id", F.round(c["x"], 9).alias("cx"), F.round(c["y"], 9).alias("cy"), F.round(k["min_x"], 9).alias("min_x"), F.round(k["max_y"], 9).alias("max_y"))


@query(f"{W} SELECT street_id, round({sql_haversine('x', 'y', 'bx', 'ey')}, 3) AS metres, abs(bx - x) > abs(ey - y) AS east_west FROM st")
def street_lengths(spark, sf_dir):
    return sc.streets(spark, sf_dir).select("street_id", F.round(geo.line_metres(F.col("line")), 3).alias("metres"), (F.abs(F.col("bx") - F.col("x")) > F.abs(F.col("by") - F.col("y"))).alias("east_west"))


@query(f"{W}, g AS (SELECT scene_id, name, sum({sql_haversine('x', 'y', 'bx', 'ey')}) AS m, max(greatest(x, bx)) - min(least(x, bx)) AS w, max(greatest(y, ey)) - min(least(y, ey)) AS h, count(*) AS n FROM st GROUP BY ALL) SELECT scene_id, name, n, round(m, 3) AS metres, CASE WHEN w > h THEN 'EW' ELSE 'NS' END AS orientation FROM g")
def street_groups(spark, sf_dir):
    """Ways of one name together, with the orientation of their common box."""
    s = sc.streets(spark, sf_dir)
    g = s.groupBy("scene_id", "name").agg(F.count("*").alias("n"), F.round(F.sum(geo.line_metres(F.col("line"))), 3).alias("metres"), (F.max(F.greatest("x", "bx")) - F.min(F.least("x", "bx"))).alias("w"), (F.max(F.greatest("y", "by")) - F.min(F.least("y", "by"))).alias("h"))
    return g.select("scene_id", "name", "n", "metres", F.when(F.expr("w > h"), "EW").otherwise("NS").alias("orientation"))


@query(f"{W}, o AS (SELECT scene_id, min(x) AS x, min(y) AS y FROM pts GROUP BY 1) SELECT p.scene_id, p.id, CAST(floor({sql_haversine('o.x', 'o.y', 'p.x', 'o.y')} + 0.5) AS BIGINT) AS x_m, CAST(floor({sql_haversine('o.x', 'o.y', 'o.x', 'p.y')} + 0.5) AS BIGINT) AS y_m FROM pts p JOIN o ON o.scene_id = p.scene_id")
def metres_from_corner(spark, sf_dir):
    p = sc.points(spark, sf_dir)
    o = p.groupBy("scene_id").agg(F.min("x").alias("ox"), F.min("y").alias("oy"))
    x = half_up(geo.haversine(_p("ox", "oy"), P(F.col("x"), F.col("oy"))))
    y = half_up(geo.haversine(_p("ox", "oy"), P(F.col("ox"), F.col("y"))))
    return p.join(o, "scene_id").select("scene_id", "id", x.alias("x_m"), y.alias("y_m"))


def _sql_touch() -> str:
    t = "((s.bx - s.x) * ({y} - s.y) - (s.ey - s.y) * ({x} - s.x))"
    u = "((d.bx - d.x) * ({y} - d.y) - (d.ey - d.y) * ({x} - d.x))"
    return f"({t.format(x='d.x', y='d.y')} * {t.format(x='d.bx', y='d.ey')} < 0 AND {u.format(x='s.x', y='s.y')} * {u.format(x='s.bx', y='s.ey')} < 0)"


@query(f"{W} SELECT d.scene_id, d.cable_id, s.street_id FROM dist d JOIN st s ON s.scene_id = d.scene_id WHERE {_sql_touch()}")
def cable_street_crossings(spark, sf_dir):
    """Proper crossings of cables and streets. Both are few per scene."""
    d, s = sc.distribution(spark, sf_dir), sc.streets(spark, sf_dir)
    s = s.select("scene_id", "street_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("bx").alias("tx"), F.col("by").alias("ty"))
    return d.join(s, "scene_id").filter(geo.crosses(_p("x", "y"), _p("bx", "by"), P(F.col("sx"), F.col("sy")), P(F.col("tx"), F.col("ty")))).select("scene_id", "cable_id", "street_id")


@query(f"{W}, {NN} SELECT scene_id, other AS closure, count(*) AS buildings, round(max(d), 3) AS farthest FROM nn WHERE rank = 1 GROUP BY ALL")
def closure_load(spark, sf_dir):
    """Buildings that each closure is nearest to, and how far the farthest is."""
    near = sp.nearest(sc.buildings(spark, sf_dir), sc.equipment(spark, sf_dir), 1)
    return near.groupBy("scene_id", F.col("other").alias("closure")).agg(F.count("*").alias("buildings"), F.round(F.max("d"), 3).alias("farthest"))
