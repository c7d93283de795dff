"""Queries of sequential operators, and windows over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.operators import procedural as pr
from terrane.operators import spatial as sp
from terrane.operators import streetgraph as sg
from terrane.sources import scenes as sc
from terrane.sources.scenes import SCENE_SQL, sql_blocked, sql_haversine, sql_segment
from terrane.streaming.accuracy import windowed_accuracy

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
GRID = 0.00025


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _cell(name: str, zero: float):
    return F.floor((F.col(name) - zero) / GRID).cast("int")


def _grid(df, *names: str):
    return [_cell(n, sc.LNG0 - 0.02 if n.endswith("x") else sc.LAT0 - 0.02).alias(a) for n, a in zip(names[::2], names[1::2])]


@query()
def convex_hull(spark, sf_dir):
    return pr.convex_hull(sc.buildings(spark, sf_dir))


#: Edges of the hull of each scene's buildings: all others on one side, and of edges on one line the longest.
HULL_SQL = f"""WITH {SCENE_SQL}, e AS (SELECT a.scene_id, a.id AS a, b.id AS b, a.x, a.y, b.x AS bx, b.y AS ey FROM bld a JOIN bld b ON b.scene_id = a.scene_id AND b.id <> a.id
 WHERE NOT EXISTS (SELECT 1 FROM bld c WHERE c.scene_id = a.scene_id AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0))"""


@query(f"""{HULL_SQL}, n AS (SELECT scene_id FROM bld GROUP BY 1 HAVING count(*) >= 4)
SELECT b.scene_id, b.id FROM bld b JOIN n ON n.scene_id = b.scene_id JOIN e ON e.scene_id = b.scene_id GROUP BY ALL HAVING min({sql_segment('b.x', 'b.y', 'e.x', 'e.y', 'e.bx', 'e.ey')}) > 1""")
def interior_buildings(spark, sf_dir):
    """Buildings more than a metre inside the boundary of their scene's hull; none in a scene of fewer than four."""
    b = sc.buildings(spark, sf_dir).select("scene_id", "id", "x", "y")
    corners = pr.convex_hull(b).join(b, ["scene_id", "id"]).groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("place", "x", "y"))).alias("c"))
    ring = F.transform("c", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    hulls = corners.select("scene_id", F.concat(ring, F.slice(ring, 1, 1)).alias("ring"))
    large = b.groupBy("scene_id").agg(F.count("*").alias("n")).filter("n >= 4").select("scene_id")
    own = b.join(large, "scene_id").join(hulls, "scene_id").filter(F.size("ring") > 3)
    return own.filter(geo.polyline_metres(geo.P(F.col("x"), F.col("y")), F.col("ring")) > 1).select("scene_id", "id")


@query(f"""WITH RECURSIVE {SCENE_SQL}, num AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY id) AS n FROM pts),
g AS (SELECT scene_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS into_, CAST([] AS STRUCT(o BIGINT, x DOUBLE, y DOUBLE)[]) AS seeds FROM (SELECT DISTINCT scene_id FROM num)
      UNION ALL SELECT scene_id, n, id, coalesce(hit, id), CASE WHEN hit IS NULL THEN list_append(seeds, {{'o': id, 'x': x, 'y': y}}) ELSE seeds END
      FROM (SELECT num.*, g.seeds, list_filter(g.seeds, lambda s: {sql_haversine('s.x', 's.y', 'num.x', 'num.y')} <= 40)[1].o AS hit FROM g JOIN num ON num.scene_id = g.scene_id AND num.n = g.n + 1))
SELECT scene_id, id, into_ AS "into" FROM g WHERE n > 0""")
def merge_nodes(spark, sf_dir):
    """Points merged in order of their ids with the first kept one within 40 m."""
    p = sc.points(spark, sf_dir).select("scene_id", F.col("id").alias("ord"), "x", "y", F.lit(None).cast("string").alias("side"))
    return sg.absorbed(p, 40.0).withColumnRenamed("ord", "id")


@query()
def grid_cells(spark, sf_dir):
    d = sc.distribution(spark, sf_dir).select("scene_id", F.col("cable_id").alias("key"), *_grid(None, "x", "c0", "y", "r0", "bx", "c1", "by", "r1"))
    return pr.grid_lines(d)


@query()
def text_map_layer(spark, sf_dir):
    """Character map of each scene: cables under buildings under equipment."""
    cables = grid_cells(spark, sf_dir).select("scene_id", "row", "col", F.lit(1).alias("prio"), F.lit("-").alias("glyph"))
    at = lambda df, prio, glyph: df.select("scene_id", *_grid(None, "y", "row", "x", "col"), F.lit(prio).alias("prio"), glyph.alias("glyph"))
    b = at(sc.buildings(spark, sf_dir), 2, F.lit("#"))
    e = at(sc.equipment(spark, sf_dir), 3, F.when(F.col("kind") == "co", "O").otherwise("C"))
    return pr.text_map(cables.unionByName(b).unionByName(e))


@query()
def route_astar(spark, sf_dir):
    """Ways of the distribution cables around buildings."""
    d = sc.distribution(spark, sf_dir).select("scene_id", F.col("cable_id").alias("request"), *_grid(None, "x", "c0", "y", "r0", "bx", "c1", "by", "r1"))
    b = sc.buildings(spark, sf_dir).select("scene_id", *_grid(None, "x", "col", "y", "row"))
    return pr.route_requests(d, b, 180, 180)


@query("""WITH g AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type AS arm, count(*) AS n, CAST(sum(CASE WHEN value >= 40 THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM events GROUP BY ALL)
SELECT *, round(correct / n, 6) AS acc,
 round((correct / n + 3.8416 / (2 * n) - 1.96 * sqrt(correct / n * (1 - correct / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS lo,
 round((correct / n + 3.8416 / (2 * n) + 1.96 * sqrt(correct / n * (1 - correct / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS hi FROM g""")
def windowed_accuracy_by_hour(spark, sf_dir):
    e = sc.table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("arm"), (F.col("value") >= 40).alias("correct"))
    return windowed_accuracy(e)


_NEAR = f"""WITH RECURSIVE {SCENE_SQL}, link AS (SELECT a.scene_id, a.id AS a, b.id AS b FROM pts a JOIN pts b ON b.scene_id = a.scene_id AND a.id <> b.id WHERE {sql_haversine('a.x', 'a.y', 'b.x', 'b.y')} <= 60),
r AS (SELECT scene_id, id AS a, id AS b FROM pts UNION SELECT r.scene_id, r.a, l.b FROM r JOIN link l ON l.a = r.b), c AS (SELECT pts.*, m.c FROM pts JOIN (SELECT scene_id, a AS id, min(b) AS c FROM r GROUP BY ALL) m USING (scene_id, id)),
p AS (SELECT x.scene_id, x.c AS ca, y.c AS cb, x.id AS source, y.id AS target, x.x, x.y, y.x AS bx, y.y AS ey, {sql_haversine('x.x', 'x.y', 'y.x', 'y.y')} AS metres FROM c x JOIN c y ON y.scene_id = x.scene_id AND x.c < y.c)"""


@query(f"""{_NEAR} SELECT scene_id, source, target, 'road_crossing' AS kind, round(metres, 4) AS metres FROM p l WHERE metres <= 100 AND NOT EXISTS (SELECT 1 FROM bld b WHERE b.scene_id = l.scene_id AND {sql_blocked('l.x', 'l.y', 'l.bx', 'l.ey')})
QUALIFY row_number() OVER (PARTITION BY scene_id, ca, cb ORDER BY round(metres, 6), source, target) = 1""")
def bridge_gaps(spark, sf_dir):
    """The nearest pair, up to 100 m and past no building, between groups of points that are farther than 60 m from each other."""
    p = sc.points(spark, sf_dir)
    near = sp.within_metres(p, p, 60.0).filter("id < other").select("scene_id", F.col("id").alias("source"), F.col("other").alias("target"))
    nodes = p.withColumnRenamed("id", "ord")
    return sg.bridges(nodes, sg.component_of(nodes, near), sc.buildings(spark, sf_dir)).withColumn("metres", F.round("metres", 4))
