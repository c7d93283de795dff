"""Layered grids of the supplied scenes, and what is read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import gridtwin as gt
from terrane.sources import scenes as sc
from terrane.sources.scenes import SCENE_SQL, sql_haversine

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _frames(spark, sf_dir):
    p = sc.points(spark, sf_dir).groupBy("scene_id").agg(*[(f(c) + s * sc.HALF).alias(f"{k}_{c}") for k, f, s in (("min", F.min, -1), ("max", F.max, 1)) for c in ("x", "y")])
    return gt.framed(p)


def _layers(spark, sf_dir):
    """The frames, and the cells of base, route, work and composite."""
    f, s = _frames(spark, sf_dir), sc.streets(spark, sf_dir)
    base, over = gt.base(f, s, sc.buildings(spark, sf_dir)), gt.work(f, sc.equipment(spark, sf_dir), sc.distribution(spark, sf_dir))
    return f, {"base": base, "route": gt.route(f, s), "work": over, "composite": gt.composite(base, over)}


def _col(x: str) -> str:
    return f"CAST(greatest(0, least({gt.WIDTH - 1}, floor(({x} - mx) / cw))) AS INT)"


def _row(y: str) -> str:
    return f"CAST(greatest(0, least({gt.HEIGHT - 1}, {gt.HEIGHT - 1} - floor(({y} - my) / ch))) AS INT)"


def _sql_lines(table: str, name: str, key: str) -> str:
    """CTEs: cells of straight lines as `name` (scene_id, key, k, col, row, c0, r0, c1, r1, flat)."""
    return f"""{name}_e AS (SELECT t.*, {_col('x')} AS c0, {_row('y')} AS r0, {_col('bx')} AS c1, {_row('ey')} AS r1, abs(bx - x) >= abs(ey - y) AS flat FROM {table} t JOIN fr USING (scene_id)),
{name}_l AS (SELECT *, greatest(abs(c1 - c0), abs(r1 - r0)) AS long_, least(abs(c1 - c0), abs(r1 - r0)) AS short_ FROM {name}_e),
{name} AS (SELECT scene_id, {key}, i AS k, c0, r0, c1, r1, flat, CAST(c0 + sign(c1 - c0) * CASE WHEN abs(c1 - c0) >= abs(r1 - r0) THEN i ELSE side END AS INT) AS col, CAST(r0 + sign(r1 - r0) * CASE WHEN abs(c1 - c0) >= abs(r1 - r0) THEN side ELSE i END AS INT) AS row
 FROM (SELECT *, CASE WHEN long_ = 0 THEN 0 ELSE floor((2 * i * short_ + long_ - 1) / (2 * long_)) END AS side FROM (SELECT *, unnest(range(0, long_ + 1)) AS i FROM {name}_l)))"""


#: Footprints are squares, so that the cells inside are those from one corner to before the other.
GRID_SQL = f"""WITH {SCENE_SQL},
fr AS (SELECT scene_id, min(x) - {sc.HALF} AS mx, min(y) - {sc.HALF} AS my, max(x) + {sc.HALF} AS hx, max(y) + {sc.HALF} AS hy, (max(x) + {sc.HALF} - (min(x) - {sc.HALF})) / {gt.WIDTH} AS cw, (max(y) + {sc.HALF} - (min(y) - {sc.HALF})) / {gt.HEIGHT} AS ch FROM pts GROUP BY 1),
{_sql_lines('st', 'rc', 'street_id, name')}, {_sql_lines('dist', 'dc', 'source')},
road AS (SELECT scene_id, col, row, CASE WHEN bool_or(flat) AND bool_or(NOT flat) THEN '{gt.ROAD_X}' WHEN bool_or(flat) THEN '{gt.ROAD_H}' ELSE '{gt.ROAD_V}' END AS glyph FROM rc GROUP BY ALL),
bo AS (SELECT scene_id, id, type, floors, {_col('x')} AS c, {_row('y')} AS r, {_col('x0')} AS ca, {_col('x1')} AS cb, {_row('y1')} AS ra, {_row('y0')} AS rb FROM bld JOIN fr USING (scene_id)),
bf AS (SELECT scene_id, id, col, unnest(range(ra, rb)) AS row FROM (SELECT scene_id, id, unnest(range(ca, cb)) AS col, ra, rb FROM bo)),
bc AS (SELECT scene_id, id, CAST(col AS INT) AS col, CAST(row AS INT) AS row FROM bf UNION ALL SELECT scene_id, id, c, r FROM bo WHERE NOT EXISTS (SELECT 1 FROM bf WHERE bf.scene_id = bo.scene_id AND bf.id = bo.id)),
bs AS (SELECT DISTINCT scene_id, col, row FROM bc),
d2 AS (SELECT unnest(range(-2, 3)) AS d), pv AS (SELECT DISTINCT scene_id, CAST(col + a.d AS INT) AS col, CAST(row + b.d AS INT) AS row FROM bs, d2 a, d2 b WHERE col + a.d BETWEEN 0 AND {gt.WIDTH - 1} AND row + b.d BETWEEN 0 AND {gt.HEIGHT - 1}),
base AS (SELECT scene_id, col, row, arg_max(glyph, p) AS glyph FROM (SELECT *, '{gt.BUILDING}' AS glyph, 3 AS p FROM bs UNION ALL SELECT *, 2 FROM road UNION ALL SELECT *, '{gt.PAVEMENT}', 1 FROM pv) GROUP BY ALL),
ee AS (SELECT scene_id, id, kind, {_col('x')} AS col, {_row('y')} AS row FROM eq JOIN fr USING (scene_id)),
wk AS (SELECT scene_id, col, row, arg_max(glyph, p) AS glyph FROM (SELECT scene_id, col, row, CASE WHEN arg_min(kind, id) = 'co' THEN '★' ELSE '●' END AS glyph, 2 AS p FROM ee GROUP BY ALL
 UNION ALL SELECT scene_id, col, row, CASE WHEN bool_or(flat) THEN '{gt.CABLE_H}' ELSE '{gt.CABLE_V}' END, 1 FROM dc GROUP BY ALL) GROUP BY ALL),
rt AS (SELECT scene_id, col, row, CASE WHEN bool_or((col = c0 AND row = r0) OR (col = c1 AND row = r1)) THEN '{gt.JUNCTION}' ELSE '{gt.CORRIDOR}' END AS glyph FROM rc GROUP BY ALL),
co AS (SELECT scene_id, col, row, coalesce(wk.glyph, base.glyph) AS glyph, CASE WHEN wk.glyph IS NOT NULL THEN base.glyph END AS hidden FROM base FULL JOIN wk USING (scene_id, col, row))"""


@query(f"""{GRID_SQL}, every AS (SELECT scene_id, r AS row, c AS col FROM (SELECT scene_id, unnest(range({gt.HEIGHT})) AS r FROM fr), (SELECT unnest(range({gt.WIDTH})) AS c)),
a AS (SELECT 'base' AS layer, * FROM base UNION ALL SELECT 'route', * FROM rt UNION ALL SELECT 'work', * FROM wk UNION ALL SELECT 'composite', scene_id, col, row, glyph FROM co), l AS (SELECT unnest(['base', 'route', 'work', 'composite']) AS layer)
SELECT scene_id, layer, CAST(row AS INT) AS row, string_agg(coalesce(glyph, ' '), '' ORDER BY col) AS line FROM every CROSS JOIN l LEFT JOIN a USING (scene_id, layer, row, col) GROUP BY ALL""")
def twin_layers(spark, sf_dir):
    """The four grids of each scene."""
    f, layers = _layers(spark, sf_dir)
    out = None
    for name, cells in layers.items():
        one = gt.text(f, cells).withColumn("layer", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{GRID_SQL} SELECT scene_id, glyph, hidden, count(*) AS cells FROM co WHERE hidden IS NOT NULL GROUP BY ALL")
def twin_hidden(spark, sf_dir):
    """What the composite of a scene shows over what, by number of cells."""
    return _layers(spark, sf_dir)[1]["composite"].filter("hidden IS NOT NULL").groupBy("scene_id", "glyph", "hidden").agg(F.count("*").alias("cells"))


_KIND = "CASE WHEN max(o.inside) IS NULL THEN 'zone_edge' ELSE CASE coalesce(max(o.glyph), ' ') " + " ".join(f"WHEN '{g}' THEN '{k}'" for g, k in gt.KINDS.items()) + " ELSE 'other' END END"
_BESIDE = ", ".join(f"({_KIND.replace('max(o.inside)', f'max(CASE WHEN dc = {dc} AND dr = {dr} THEN inside END)').replace('max(o.glyph)', f'max(CASE WHEN dc = {dc} AND dr = {dr} THEN glyph END)')}) AS {name}" for name, dc, dr in (("north", 0, -1), ("south", 0, 1), ("east", 1, 0), ("west", -1, 0)))


@query(f"""{GRID_SQL}, d10 AS (SELECT unnest(range(-10, 11)) AS d), w AS (SELECT ee.*, {sql_haversine('mx', 'my', 'hx', 'my')} / {gt.WIDTH} AS ex, {sql_haversine('mx', 'my', 'mx', 'hy')} / {gt.HEIGHT} AS ny FROM ee JOIN fr USING (scene_id) WHERE kind = 'closure'),
o AS (SELECT w.*, a.d AS dc, b.d AS dr, CASE WHEN w.col + a.d BETWEEN 0 AND {gt.WIDTH - 1} AND w.row + b.d BETWEEN 0 AND {gt.HEIGHT - 1} THEN 1 END AS inside, co.glyph, greatest(abs(a.d), abs(b.d)) AS ring, sqrt(pow(b.d * ny, 2) + pow(a.d * ex, 2)) AS m
      FROM w CROSS JOIN d10 a CROSS JOIN d10 b LEFT JOIN co ON co.scene_id = w.scene_id AND co.col = w.col + a.d AND co.row = w.row + b.d WHERE a.d <> 0 OR b.d <> 0),
g AS (SELECT scene_id, id, col, row, {_BESIDE}, arg_min(m, (ring, dr, dc)) FILTER (glyph IN ('{gt.ROAD_H}', '{gt.ROAD_V}', '{gt.ROAD_X}')) AS road_m, arg_min(m, (ring, dr, dc)) FILTER (glyph = '{gt.BUILDING}') AS building_m FROM o GROUP BY ALL),
n AS (SELECT a.scene_id, a.id, b.id AS other, row_number() OVER (PARTITION BY a.scene_id, a.id ORDER BY round(sqrt(pow((b.col - a.col) * a.ex, 2) + pow((b.row - a.row) * a.ny, 2)), 6), b.id) AS k FROM w a JOIN w b ON b.scene_id = a.scene_id AND b.id <> a.id),
t AS (SELECT scene_id, id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY k) AS nearest FROM n WHERE k <= 3 GROUP BY ALL)
SELECT scene_id, id, col, row, north, south, east, west, round(road_m, 4) AS road_m, round(building_m, 4) AS building_m, nearest, coalesce(road_m <= 15, false) AS road_access,
 'sidewalk' IN (north, south, east, west) OR 'road' IN (north, south, east, west) AS on_sidewalk, coalesce(building_m <= 5, false) AS near_building,
 NOT ('sidewalk' IN (north, south, east, west) OR 'road' IN (north, south, east, west)) OR coalesce(building_m <= 5, false) AS move FROM g LEFT JOIN t USING (scene_id, id)""")
def closure_neighbourhoods(spark, sf_dir):
    """What stands around each closure, read from the text of the composite grid."""
    f, layers = _layers(spark, sf_dir)
    found = gt.neighbourhoods(gt.text(f, layers["composite"]), sc.equipment(spark, sf_dir).filter("kind = 'closure'"), f)
    return found.withColumns({"road_m": F.round("road_m", 4), "building_m": F.round("building_m", 4)})


@query(f"""{GRID_SQL}, d5 AS (SELECT unnest(range(-5, 6)) AS d), rs AS (SELECT scene_id, col, row, arg_min(name, street_id) AS street FROM rc GROUP BY ALL), z AS (SELECT scene_id, id, count(*) AS cells FROM bc GROUP BY ALL),
n AS (SELECT bo.scene_id, bo.id, rs.col, rs.row, a.d AS dc, b.d AS dr, street FROM bo CROSS JOIN d5 a CROSS JOIN d5 b JOIN rs ON rs.scene_id = bo.scene_id AND rs.col = bo.c + a.d AND rs.row = bo.r + b.d QUALIFY row_number() OVER (PARTITION BY bo.scene_id, bo.id ORDER BY abs(a.d) + abs(b.d), b.d, a.d) = 1)
SELECT scene_id, id, cells, col, row, CASE WHEN dc IS NULL THEN NULL WHEN abs(dc) >= abs(dr) THEN CASE WHEN dc >= 0 THEN 'east' ELSE 'west' END ELSE CASE WHEN dr >= 0 THEN 'south' ELSE 'north' END END AS facing, street AS frontage FROM z LEFT JOIN n USING (scene_id, id)""")
def building_registry(spark, sf_dir):
    """Cells, nearest road cell, facing and street of each building on the grid."""
    return gt.registry(_frames(spark, sf_dir), sc.streets(spark, sf_dir), sc.buildings(spark, sf_dir))


@query(f"""{GRID_SQL}, fx AS (SELECT rc.*, k - row_number() OVER (PARTITION BY rc.scene_id, street_id ORDER BY k) AS g FROM rc ANTI JOIN bs ON bs.scene_id = rc.scene_id AND bs.col = rc.col AND bs.row = rc.row)
SELECT scene_id, street_id AS id, name, CAST(row_number() OVER (PARTITION BY scene_id, street_id ORDER BY min(k)) AS INT) AS run, CAST(min(k) AS INT) AS first, CAST(max(k) AS INT) AS last, count(*) AS cells FROM fx GROUP BY scene_id, street_id, name, g""")
def corridor_graph(spark, sf_dir):
    """The stretches of each street that no building covers, as runs of cells along it."""
    f = _frames(spark, sf_dir)
    return gt.corridors(f, sc.streets(spark, sf_dir), gt.building_cells(f, sc.buildings(spark, sf_dir)))
