"""Further queries: addresses, street and building lookups, question truths by id, answers and tables of rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions.geo import P
from terrane.operators import spatial as sp
from terrane.plans.network import NET, cables
from terrane.sources import scenes as sc
from terrane.sources.scenes import SCENE_SQL, sql_haversine, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
W, S = f"WITH {NET}", f"WITH {SCENE_SQL}"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _p(x: str, y: str) -> P:
    return P(F.col(x), F.col(y))


@query("""SELECT count(*) AS total, count(*) FILTER (c_acctbal > 5000) AS with_survey, count(*) FILTER (c_acctbal > 0) AS connected, count(*) FILTER (c_acctbal <= 0) AS orphaned,
CAST(sum(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE c_custkey % 3 END) AS BIGINT) AS demand, round(avg(c_acctbal) FILTER (c_acctbal > 0), 6) AS avg_loss, max(c_acctbal) AS max_loss FROM customer""")
def address_summary(spark, sf_dir):
    """One pass over addresses; a demand of 0 counts as 1, averages leave missing losses out."""
    c = table(spark, sf_dir, "customer")
    loss = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return c.agg(
        F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 5000).alias("with_survey"), F.count(loss).alias("connected"), F.count_if(loss.isNull()).alias("orphaned"),
        F.sum(F.coalesce(F.nullif(F.col("c_custkey") % 3, F.lit(0)), F.lit(1))).alias("demand"), F.round(F.avg(loss), 6).alias("avg_loss"), F.max("c_acctbal").alias("max_loss"),
    )


@query(f"{W}, e AS (SELECT target AS id, source AS other, length, ord FROM cables UNION ALL SELECT source, target, length, ord FROM cables) SELECT h.id, arg_min(e.other, (e.ord, e.other)) AS closure, arg_min(e.length, (e.ord, e.other)) AS metres FROM (SELECT id FROM nodes WHERE type = 'house') h JOIN e ON e.id = h.id GROUP BY 1")
def serving_closure(spark, sf_dir):
    """Closure of a house over its drop, written in either direction; the first one counts."""
    c = cables(spark, sf_dir)
    e = c.select(F.col("target").alias("id"), F.col("source").alias("other"), "length", "ord").union(c.select("source", "target", "length", "ord")).filter(F.col("id").startswith("h-"))
    first = F.struct("ord", "other")
    return e.groupBy("id").agg(F.min_by("other", first).alias("closure"), F.min_by("length", first).alias("metres"))


@query(f"""{S}, v AS (SELECT scene_id, street_id, name, x, y FROM st UNION ALL SELECT scene_id, street_id, name, bx, ey FROM st),
d AS (SELECT e.scene_id, e.id, v.name, v.street_id, {sql_haversine('e.x', 'e.y', 'v.x', 'v.y')} AS d FROM eq e JOIN v ON v.scene_id = e.scene_id)
SELECT scene_id, id, arg_min(name, (round(d, 6), street_id)) AS street FROM d WHERE d < 50 GROUP BY ALL""")
def street_lookup(spark, sf_dir):
    """Street of the nearest road vertex, if one is near enough."""
    s = sc.streets(spark, sf_dir)
    v = s.select("scene_id", F.col("street_id").alias("id"), "name", F.explode("line").alias("v")).select("scene_id", "id", "name", "v.x", "v.y")
    near = sp.within_metres(sc.equipment(spark, sf_dir), v, 50.0).filter("d < 50")
    named = near.join(s.select(F.col("street_id").alias("other"), "name"), "other")
    return named.groupBy("scene_id", "id").agg(F.min_by("name", F.struct(F.round("d", 6), "other")).alias("street"))


@query(f"""{S}, i AS (SELECT e.scene_id, e.id, b.id AS building, 1 AS how FROM eq e JOIN bld b ON b.scene_id = e.scene_id WHERE e.x >= b.x0 AND e.x < b.x1 AND e.y >= b.y0 AND e.y < b.y1
UNION ALL SELECT e.scene_id, e.id, b.id, 2 FROM eq e JOIN bld b ON b.scene_id = e.scene_id WHERE {sql_haversine('e.x', 'e.y', 'b.x', 'b.y')} < 15)
SELECT scene_id, building, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY scene_id, id ORDER BY how) AS r FROM i) WHERE r = 1 GROUP BY ALL""")
def building_contents(spark, sf_dir):
    """Points in a building's ring; a point that is in none counts for buildings whose centre is nearer than 15 m."""
    e, b = sc.equipment(spark, sf_dir), sc.buildings(spark, sf_dir)
    inside = sp.points_in_footprints(e, b).select("scene_id", "id", F.col("area").alias("building"))
    outside = e.join(inside.select("scene_id", "id").distinct(), ["scene_id", "id"], "left_anti")
    near = sp.within_metres(outside, b, 15.0).filter("d < 15").select("scene_id", "id", F.col("other").alias("building"))
    return inside.unionByName(near).groupBy("scene_id", "building").agg(F.count("*").alias("n"))


@query(f"""{S}, a AS (SELECT s AS seed, -73.984 + 0.004 * ((s % 100) / 100.0 - 0.5) AS cx, 40.7549 + 0.004 * (((s % 100) * 7 % 100) / 100.0 - 0.5) AS cy FROM (SELECT unnest(range(12)) AS s))
SELECT a.seed, count(*) AS n, min(p.id) AS first FROM a JOIN pts p ON p.x BETWEEN a.cx - 0.002 AND a.cx + 0.002 AND p.y BETWEEN a.cy - 0.0016 AND a.cy + 0.0016 GROUP BY 1""")
def aoi_windows(spark, sf_dir):
    """Points of twelve windows whose place depends on the seed: windows are dealt to cells and joined on them."""
    k = F.col("id") % 100
    a = spark.range(12).select(F.col("id").alias("seed"), (-73.984 + 0.004 * (k / 100 - 0.5)).alias("cx"), (40.7549 + 0.004 * ((k * 7 % 100) / 100 - 0.5)).alias("cy"))
    a = a.select("seed", (F.col("cx") - 0.002).alias("x0"), (F.col("cx") + 0.002).alias("x1"), (F.col("cy") - 0.0016).alias("y0"), (F.col("cy") + 0.0016).alias("y1"))
    cells = sp.cells_of_box(a.withColumnsRenamed({"cx": "mx", "cy": "my"}), "x0", "y0", "x1", "y1")
    p = sc.points(spark, sf_dir).withColumns({"cx": geo.cell(F.col("x"), sp.CELL), "cy": geo.cell(F.col("y"), sp.CELL)})
    hit = p.join(cells, ["cx", "cy"]).filter("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    return hit.groupBy("seed").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(f"{S}, c AS (SELECT scene_id, avg(x) AS cx, avg(y) AS cy FROM pts GROUP BY 1) SELECT e.scene_id, e.id, CASE WHEN abs(e.x - cx) * 111320.0 * cos(radians(cy)) >= 20 AND abs(e.y - cy) * 110540.0 >= 20 THEN CASE WHEN e.y > cy THEN 'N' ELSE 'S' END || CASE WHEN e.x > cx THEN 'E' ELSE 'W' END ELSE '-' END AS quadrant FROM eq e JOIN c ON c.scene_id = e.scene_id")
def equipment_in_quadrant(spark, sf_dir):
    """Quadrant of each piece of equipment, with a dead band of 20 m along the axes."""
    c = sc.points(spark, sf_dir).groupBy("scene_id").agg(F.avg("x").alias("ox"), F.avg("y").alias("oy"))
    q = geo.quadrant(_p("x", "y"), _p("ox", "oy"), 20.0)
    return sc.equipment(spark, sf_dir).join(c, "scene_id").select("scene_id", "id", F.coalesce(q, F.lit("-")).alias("quadrant"))


@query(f"{S}, t AS (SELECT scene_id, id, x, y, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS ey FROM eq WINDOW w AS (PARTITION BY scene_id ORDER BY id)) SELECT scene_id, id, (x - ax) * (ey - y) - (y - ay) * (bx - x) > 0 AS left_turn FROM t WHERE ax IS NOT NULL AND bx IS NOT NULL AND (x - ax) * (ey - y) - (y - ay) * (bx - x) <> 0")
def turns(spark, sf_dir):
    """Inner points of a route with the side they turn to; points on a straight line are left out."""
    w = Window.partitionBy("scene_id").orderBy("id")
    t = sc.equipment(spark, sf_dir).withColumns({"ax": F.lag("x").over(w), "ay": F.lag("y").over(w), "bx": F.lead("x").over(w), "by": F.lead("y").over(w)})
    side = geo.turn(_p("ax", "ay"), _p("x", "y"), _p("bx", "by"))
    return t.filter("ax IS NOT NULL AND bx IS NOT NULL").withColumn("side", side).filter("side <> 0").select("scene_id", "id", (F.col("side") > 0).alias("left_turn"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_totalprice < 100000 THEN 'pass' ELSE 'fail' END AS verdict FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def threshold_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "P"))
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") < 100000, "pass").otherwise("fail").alias("verdict"))


@query("SELECT c_nationkey AS zone, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_acctbal DESC, c_custkey) AS top FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3 GROUP BY 1")
def top_three(spark, sf_dir):
    """Top three per group, kept as three rows a group before they are put in one."""
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    t = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal").withColumn("r", F.row_number().over(w)).filter("r <= 3")
    order = F.array_sort(F.collect_list(F.struct("r", F.col("c_custkey").cast("string").alias("k"))))
    return t.groupBy(F.col("c_nationkey").alias("zone")).agg(F.array_join(F.transform(order, lambda s: s["k"]), ",").alias("top"))


@query(f"""WITH {SCENE_SQL}, w AS (SELECT scene_id, CAST(round(greatest({sql_haversine('min(x)', 'min(y)', 'max(x)', 'min(y)')}, {sql_haversine('min(x)', 'min(y)', 'min(x)', 'max(y)')})) AS BIGINT) AS size FROM pts GROUP BY 1)
SELECT scene_id, size, least(40, CAST(floor(12 * sqrt(size / 350.0) + 0.5) AS BIGINT)) AS budget FROM w""")
def building_budget(spark, sf_dir):
    """How many buildings a scene may keep by its longer side in metres."""
    low = P(F.min("x"), F.min("y"))
    size = F.greatest(geo.haversine(low, P(F.max("x"), low.y)), geo.haversine(low, P(low.x, F.max("y"))))
    s = sc.points(spark, sf_dir).groupBy("scene_id").agg(F.round(size).cast("long").alias("size"))
    return s.select("scene_id", "size", F.least(F.lit(40), F.floor(12 * F.sqrt(F.col("size") / 350) + 0.5)).alias("budget"))


@query("WITH r AS (SELECT DISTINCT p_brand AS subject, p_type AS object FROM part), t AS (SELECT p_brand AS subject, p_type AS object, count(*) AS n FROM part WHERE p_size > 25 GROUP BY ALL) SELECT r.subject, r.object, t.n FROM r JOIN t ON r.subject = t.subject AND r.object = t.object")
def relation_join(spark, sf_dir):
    """Relations without repeats joined with their results."""
    p = table(spark, sf_dir, "part").withColumnsRenamed({"p_brand": "subject", "p_type": "object"})
    t = p.filter("p_size > 25").groupBy("subject", "object").agg(F.count("*").alias("n"))
    return p.select("subject", "object").dropDuplicates().join(t, ["subject", "object"])


@query(f"{S} SELECT a.scene_id, a.id, CASE WHEN {sql_haversine('a.x', 'a.y', 'n.x', 'n.y')} <= {sql_haversine('a.x', 'a.y', 'm.x', 'm.y')} THEN n.id ELSE m.id END AS nearer FROM eq a JOIN (SELECT scene_id, arg_min(x, id) AS x, arg_min(y, id) AS y, min(id) AS id FROM bld GROUP BY 1) n ON n.scene_id = a.scene_id JOIN (SELECT scene_id, arg_max(x, id) AS x, arg_max(y, id) AS y, max(id) AS id FROM bld GROUP BY 1) m ON m.scene_id = a.scene_id")
def nearer_of_pair(spark, sf_dir):
    """Which of two buildings is nearer; on a tie the first."""
    pair = sc.buildings(spark, sf_dir).groupBy("scene_id").agg(F.min(F.struct("id", "x", "y")).alias("n"), F.max(F.struct("id", "x", "y")).alias("m"))
    d = lambda k: geo.haversine(_p("x", "y"), _p(f"{k}.x", f"{k}.y"))
    return sc.equipment(spark, sf_dir).join(pair, "scene_id").select("scene_id", "id", F.when(d("n") <= d("m"), F.col("n.id")).otherwise(F.col("m.id")).alias("nearer"))
