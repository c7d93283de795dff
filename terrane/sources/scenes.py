"""Scenes derived from the supplied tables: points, buildings, equipment, streets and cables by scene.

`embeddings` gives points (id = vec_id); those of one label within SCENE_IDS consecutive ids are a scene, so a scene has a bounded
size and their number grows with the table. Every fifth point is equipment (a closure), the others are buildings with a
square footprint. Streets run from every tenth point to the next point of its scene; drops join buildings to their nearest
closure, distribution cables join a closure to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LNG0, LAT0, SPREAD = -73.984, 40.7549, 0.02
SCENE_IDS = 1000
LABELS = 16  # scene = LABELS * range of ids + label
HALF = 0.0004  # of a footprint's side, in degrees


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _xy(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda i, zero: F.lit(zero) + SPREAD * F.get("embedding", F.lit(i)).cast("double")
    scene = (F.col("label") + LABELS * F.floor(F.col("vec_id") / SCENE_IDS)).cast("int")
    return e.select(scene.alias("scene_id"), F.col("vec_id").alias("id"), at(0, LNG0).alias("x"), at(1, LAT0).alias("y"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).filter("id % 5 <> 0")
    corner = lambda sx, sy: _xy(F.col("x") + sx * HALF, F.col("y") + sy * HALF)
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    kinds = F.element_at(F.array(*map(F.lit, ("residential", "commercial", "mixed"))), (F.col("id") % 3 + 1).cast("int"))
    return p.withColumns({"footprint": ring, "type": kinds, "floors": (F.col("id") % 6 + 1).cast("int")})


def equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).filter("id % 5 = 0").withColumn("kind", F.when(F.col("id") % 50 == 0, "co").otherwise("closure"))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("scene_id").orderBy("id")
    line = points(spark, sf_dir).withColumns({"bx": F.lead("x").over(w), "by": F.lead("y").over(w)}).filter("id % 10 = 1 AND bx IS NOT NULL")
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Street "), (F.col("id") % 9).cast("string"))).otherwise(F.concat(F.lit("Name "), (F.col("id") % 11).cast("string")))
    return line.select("scene_id", F.col("id").alias("street_id"), name.alias("name"), "x", "y", "bx", "by", F.array(_xy(F.col("x"), F.col("y")), _xy(F.col("bx"), F.col("by"))).alias("line"))


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cables from each closure to the next of its scene."""
    w = Window.partitionBy("scene_id").orderBy("id")
    e = equipment(spark, sf_dir).withColumns({"target": F.lead("id").over(w), "bx": F.lead("x").over(w), "by": F.lead("y").over(w)}).filter("target IS NOT NULL")
    return e.select("scene_id", F.concat(F.lit("dist-"), F.col("id").cast("string")).alias("cable_id"), F.lit("distribution").alias("kind"), F.col("id").alias("source"), "target", "x", "y", "bx", "by")


#: The same derivations for the checking engine.
SCENE_SQL = f"""
pts AS (SELECT CAST(label + {LABELS} * (vec_id // {SCENE_IDS}) AS INT) AS scene_id, vec_id AS id, {LNG0} + {SPREAD} * CAST(embedding[1] AS DOUBLE) AS x, {LAT0} + {SPREAD} * CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
bld AS (SELECT *, ['residential', 'commercial', 'mixed'][CAST(id % 3 + 1 AS INT)] AS type, CAST(id % 6 + 1 AS INT) AS floors,
        x - {HALF} AS x0, x + {HALF} AS x1, y - {HALF} AS y0, y + {HALF} AS y1 FROM pts WHERE id % 5 <> 0),
eq AS (SELECT *, CASE WHEN id % 50 = 0 THEN 'co' ELSE 'closure' END AS kind FROM pts WHERE id % 5 = 0),
st AS (SELECT * FROM (SELECT scene_id, id AS street_id, CASE WHEN id % 3 = 0 THEN 'Street ' || (id % 9) ELSE 'Name ' || (id % 11) END AS name, x, y,
       lead(x) OVER (PARTITION BY scene_id ORDER BY id) AS bx, lead(y) OVER (PARTITION BY scene_id ORDER BY id) AS ey FROM pts) WHERE street_id % 10 = 1 AND bx IS NOT NULL),
dist AS (SELECT * FROM (SELECT scene_id, 'dist-' || id AS cable_id, 'distribution' AS kind, id AS source, lead(id) OVER w AS target, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS ey
         FROM eq WINDOW w AS (PARTITION BY scene_id ORDER BY id)) WHERE target IS NOT NULL)
"""


def sql_haversine(ax: str, ay: str, bx: str, by: str) -> str:
    return f"(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({by} - {ay}) / 2), 2) + cos(radians({ay})) * cos(radians({by})) * pow(sin(radians({bx} - {ax}) / 2), 2)))))"


def sql_segment(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Distance of a point from a segment at the point's latitude."""
    k = f"(111320.0 * cos(radians({py})))"
    dx, dy = f"(({bx} - {ax}) * {k})", f"(({by} - {ay}) * 110540.0)"
    ex, ey = f"(({px} - {ax}) * {k})", f"(({py} - {ay}) * 110540.0)"
    t = f"greatest(0.0, least(1.0, coalesce(({ex} * {dx} + {ey} * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0), 0)))"
    return f"sqrt(pow({ex} - {t} * {dx}, 2) + pow({ey} - {t} * {dy}, 2))"


def _sql_turn(a: str, b: str, c: str) -> str:
    """Points are written `x|y`."""
    (ax, ay), (bx, by), (cx, cy) = (p.split("|") for p in (a, b, c))
    return f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


def sql_blocked(ax: str, ay: str, bx: str, by: str, box: str = "b") -> str:
    """A segment properly crosses the square of a building, or both its ends are inside."""
    p, q = f"{ax}|{ay}", f"{bx}|{by}"
    ring = [f"{box}.x0|{box}.y0", f"{box}.x1|{box}.y0", f"{box}.x1|{box}.y1", f"{box}.x0|{box}.y1"]
    cross = [f"({_sql_turn(c, d, p)} * {_sql_turn(c, d, q)} < 0 AND {_sql_turn(p, q, c)} * {_sql_turn(p, q, d)} < 0)" for c, d in zip(ring, ring[1:] + ring[:1])]
    inside = lambda x, y: f"({x} > {box}.x0 AND {x} < {box}.x1 AND {y} > {box}.y0 AND {y} < {box}.y1)"
    return f"({' OR '.join(cross)} OR ({inside(ax, ay)} AND {inside(bx, by)}))"
