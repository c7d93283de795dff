"""Scenes of windows over the supplied city: every nation asks for one, its seed, size and planted faults follow from its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import areas as ar
from terrane.plans.views import HIGHWAYS
from terrane.sources import scenes as sc
from terrane.sources.scenes import SCENE_SQL, sql_haversine

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SIZES = (350.0, 700.0, 1400.0)
X, Y, STRAY = ar.CITIES["nyc"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _windows(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    size = F.element_at(F.array(*map(F.lit, SIZES)), (k % len(SIZES) + 1).cast("int"))
    plants = [(k % (len(ar.PLANTS) + 1) == i).alias(p) for i, p in enumerate(ar.PLANTS)]
    return ar.windows(sc.table(spark, sf_dir, "nation").select(k.alias("scene_id"), F.lit("nyc").alias("city"), (1000 + k).alias("seed"), size.alias("size_m"), *plants))


def _city(spark, sf_dir):
    """Buildings with an address of number and street, of a name alone, or none; streets with their type."""
    b, i = sc.buildings(spark, sf_dir), F.col("id")
    address = F.when(i % 3 == 0, F.concat(i.cast("string"), F.lit(" Oak Street"))).when(i % 3 == 1, F.lit("Old Mill"))
    kind = F.element_at(F.array(*map(F.lit, HIGHWAYS)), (F.floor(F.col("street_id") / 10) % len(HIGHWAYS) + 1).cast("int"))
    return b.select("id", "x", "y", "footprint", address.alias("address")), sc.streets(spark, sf_dir).select("street_id", "name", kind.alias("highway"), "line")


AREAS = f"""WITH RECURSIVE {SCENE_SQL},
rq AS (SELECT CAST(n_nationkey AS BIGINT) AS scene_id, CAST(1000 + n_nationkey AS BIGINT) AS seed, {list(SIZES)}[CAST(n_nationkey % {len(SIZES)} + 1 AS INT)]::DOUBLE AS size_m FROM nation),
ce AS (SELECT *, {X} + ((seed * 73 % 100) / 100.0::DOUBLE - 0.5) * {STRAY} AS cx, {Y} + ((seed * 91 % 100) / 100.0::DOUBLE - 0.5) * {STRAY} AS cy FROM rq),
wi AS (SELECT scene_id, seed, size_m, cx - size_m / 2 / (111320.0 * cos(radians(cy))) AS min_x, cx + size_m / 2 / (111320.0 * cos(radians(cy))) AS max_x, cy - size_m / 2 / 110540.0 AS min_y, cy + size_m / 2 / 110540.0 AS max_y FROM ce),
wb AS (SELECT wi.scene_id, b.id, b.x, b.y FROM wi JOIN bld b ON b.x BETWEEN min_x AND max_x AND b.y BETWEEN min_y AND max_y)"""


@query(f"""{AREAS}, nb AS (SELECT scene_id, count(*) AS n FROM wb GROUP BY 1)
SELECT scene_id, seed, size_m, round(min_x, 9) AS min_x, round(max_x, 9) AS max_x, round(min_y, 9) AS min_y, round(max_y, 9) AS max_y, coalesce(n, 0) AS buildings FROM wi LEFT JOIN nb USING (scene_id)""")
def area_boxes(spark, sf_dir):
    """The windows, and how many buildings of the city each holds."""
    w = _windows(spark, sf_dir)
    n = ar._in_windows(_city(spark, sf_dir)[0], w).groupBy("scene_id").agg(F.count("*").alias("buildings"))
    return w.join(n, "scene_id", "left").select("scene_id", "seed", "size_m", *[F.round(c, 9).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")], F.coalesce("buildings", F.lit(0)).cast("long").alias("buildings"))


_NEAREST = f"SELECT wb.*, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY round({sql_haversine('x', 'y', 'ox', 'oy')}, 6), id) AS BIGINT) AS k FROM wb JOIN mi USING (scene_id)"
_CELL = "greatest(0, least(3, ceil(({v} - {a}) / {w}) - 1))"
_MIDDLE = sql_haversine("x", "y", "x0 + (cx + 0.5) * cw", "y0 + (cy + 0.5) * ch")
_SPREAD = f"""SELECT scene_id, id, x, y, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY part, o) AS BIGINT) AS k FROM
 (SELECT scene_id, id, x, y, 1 AS part, k AS o FROM ({_NEAREST}) UNION ALL SELECT scene_id, id, x, y, 0, cy * 4 + cx FROM
  (SELECT *, {_CELL.format(v='x', a='x0', w='cw')} AS cx, {_CELL.format(v='y', a='y0', w='ch')} AS cy FROM (SELECT *, CASE WHEN x1 > x0 THEN (x1 - x0) / 4 ELSE 1e-9 END AS cw, CASE WHEN y1 > y0 THEN (y1 - y0) / 4 ELSE 1e-9 END AS ch FROM
   (SELECT *, min(x) OVER s AS x0, max(x) OVER s AS x1, min(y) OVER s AS y0, max(y) OVER s AS y1 FROM wb WINDOW s AS (PARTITION BY scene_id))))
  QUALIFY row_number() OVER (PARTITION BY scene_id, cx, cy ORDER BY round({_MIDDLE}, 6), id) = 1)"""


def _chosen(order: str) -> str:
    """SQL: those of the candidates, in order k, that are apart from all taken before them."""
    return f"""{AREAS}, mi AS (SELECT scene_id, avg(x) AS ox, avg(y) AS oy FROM wb GROUP BY 1), ca AS ({order}),
g AS (SELECT scene_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST([] AS STRUCT(x DOUBLE, y DOUBLE)[]) AS kept FROM mi
 UNION ALL SELECT scene_id, k, CASE WHEN free THEN id END, CASE WHEN free THEN list_append(kept, {{'x': x, 'y': y}}) ELSE kept END FROM
 (SELECT g.scene_id, ca.k, ca.id, ca.x, ca.y, kept, len(kept) < 12 AND len(list_filter(kept, lambda o: {sql_haversine('o.x', 'o.y', 'ca.x', 'ca.y')} < {ar.APART_M})) = 0 AS free FROM g JOIN ca ON ca.scene_id = g.scene_id AND ca.k = g.k + 1)),
t AS (SELECT g.scene_id, g.id, CAST(row_number() OVER (PARTITION BY g.scene_id ORDER BY k) - 1 AS INT) AS n FROM g WHERE id IS NOT NULL)
SELECT t.scene_id, n, t.id AS source, round(b.x, 7) AS x, round(b.y, 7) AS y, CASE WHEN t.id % 3 = 0 THEN CAST(t.id AS VARCHAR) END AS number, CASE WHEN t.id % 3 = 0 THEN 'Oak Street' END AS street, CASE WHEN n % 4 = 0 THEN 'commercial' ELSE 'residential' END AS type, 3 + n % 8 AS floors FROM t JOIN bld b ON b.id = t.id"""


@query(_chosen(_NEAREST))
def area_buildings(spark, sf_dir):
    """The buildings of each window's scene."""
    b = ar.chosen_buildings(_windows(spark, sf_dir), _city(spark, sf_dir)[0])
    return b.drop("footprint").withColumns({"x": F.round("x", 7), "y": F.round("y", 7)})


@query(_chosen(_SPREAD))
def area_buildings_spread(spark, sf_dir):
    """The buildings of each window's scene where they are spread over the window."""
    b = ar.chosen_buildings(_windows(spark, sf_dir), _city(spark, sf_dir)[0], spread=True)
    return b.drop("footprint").withColumns({"x": F.round("x", 7), "y": F.round("y", 7)})


@query()
def area_scenes(spark, sf_dir):
    """Everything in each window's scene: buildings, streets, devices and cables, with the planted fault of its seed."""
    return ar.entities(ar.scenes(_windows(spark, sf_dir), *_city(spark, sf_dir)))
