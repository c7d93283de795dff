"""Text maps and legends of towns, cable states, reach along lattices, fibres and ports of devices, addresses, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions import network as nw
from terrane.functions import random as rd
from terrane.functions import skins as sk
from terrane.functions import text as tx
from terrane.functions.geo import P
from terrane.operators import fibres as fb
from terrane.operators import graph as gr
from terrane.operators import routing as rt
from terrane.operators import spatial as sp
from terrane.operators import textmap as tm
from terrane.plans.network import NET, _db, _db_sql, cables, nodes, paths
from terrane.plans.spatial import _sql_meets
from terrane.plans.towns import SPEC, TOWNS
from terrane.sources import scenes as sc
from terrane.sources import towns as tw
from terrane.sources.scenes import SCENE_SQL, sql_haversine, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
W = f"WITH {NET}"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


#: Questions on generated towns, for tests: they read no table, so they are not in the catalogue.
TOWN_QUERIES: dict = {}
TOWN_ORACLE: dict[str, str] = {}


def town_query(oracle: str | None = None):
    def add(f):
        TOWN_QUERIES[f.__name__] = f
        if oracle:
            TOWN_ORACLE[f.__name__] = oracle
        return f

    return add


# Towns as text. A town's frame begins a quarter of a cell outside its corner, so nothing lies on a border between cells.
EDGE, MAPS = 0.25, 18


def _frames(specs: DataFrame) -> DataFrame:
    d_lng, d_lat = tw.CELL_M / (geo.LNG_M * F.cos(F.radians(F.lit(tw.ORIGIN.y)))), tw.CELL_M / geo.LAT_M
    side = tw.STREET + F.col("nx") * tw.PITCH + 1 - EDGE
    f = specs.select("scene_id", "nx", (tw.ORIGIN.x - EDGE * d_lng).alias("min_x"), F.lit(tw.ORIGIN.y - EDGE * d_lat).alias("min_y"), (tw.ORIGIN.x + side * d_lng).alias("max_x"), (tw.ORIGIN.y + side * d_lat).alias("max_y"))
    return tm.framed(f, F.col("nx") * tw.PITCH + 2)


def _line(df: DataFrame) -> DataFrame:
    return df.withColumn("line", F.array(F.struct("x", "y"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))))


def _town(specs: DataFrame) -> dict[str, DataFrame]:
    """The tables of towns in the order of their numbers, with all buildings of one type."""
    n = specs.select("scene_id", "nx")
    k = F.regexp_extract("street_id", "([0-9]+)$", 1).cast("int")
    streets = tw.streets(specs).join(n, "scene_id").withColumn("ord", k + F.when(F.col("street_id").startswith("st-v"), F.col("nx") + 1).otherwise(0))
    part = lambda i: F.get(F.split("id", "-"), F.lit(i)).cast("int")
    buildings = tw.buildings(specs).join(n, "scene_id").withColumns({"ord": part(2) * F.col("nx") + part(1), "type": F.lit("house"), "floors": F.lit(2)})
    equipment = tw.equipment(specs).withColumn("serves", F.when(F.col("serves").isNull(), F.array().cast("array<string>")).otherwise(F.array("serves")))
    order = tw.equipment(specs).select("scene_id", F.col("id").alias("source"), F.col("ord"))
    lines = _line(tw.cables(specs)).join(order, ["scene_id", "source"])
    lines = lines.withColumnRenamed("cable_id", "id").withColumn("ord", F.when(F.col("kind") == "drop", F.col("ord") - 1).otherwise(1000))
    return {"streets": streets, "buildings": buildings, "equipment": equipment, "cables": lines}


_DL, _DA = "(10.0 / (111320.0 * cos(radians(32.085))))", "(10.0 / 110540.0)"
#: Towns by arithmetic: g cells a side, blocks with their south-western cell, closures with their place (in cells) and cell.
_TOWN = f"""{SPEC}, fr AS (SELECT *, 5 * n + 2 AS g FROM c WHERE scene_id < {{towns}}),
bb AS (SELECT *, k % n AS bi, k // n AS bj, 1 + 5 * (k % n) AS c0, 1 + 5 * (k // n) AS r0, 2 * (k + 1) || ' H Street ' || (k // n) AS addr FROM (SELECT *, unnest(range(n * n)) AS k FROM fr)),
cl AS (SELECT *, 'CL-' || chr(CAST(65 + k AS INT)) AS id, 'B-' || bi || '-' || bj AS home, c0 + CASE WHEN inb AND k = 0 THEN 2 ELSE 2.44 END AS cc,
 r0 + CASE WHEN inb AND k = 0 THEN 2 WHEN road AND k = closures - 1 THEN -0.5 ELSE -0.2 END AS rr, c0 + 2 AS tc, r0 + CASE WHEN inb AND k = 0 THEN 2 WHEN road AND k = closures - 1 THEN -1 ELSE 0 END AS tr FROM bb WHERE k < closures),
far AS (SELECT a.scene_id, a.g, a.tc AS c1, a.tr AS r1, b.tc AS c2, b.tr AS r2, a.cc AS ac, a.rr AS ar, b.cc AS bc, b.rr AS br, b.id AS target FROM cl a JOIN cl b ON a.scene_id = b.scene_id AND a.cross_ AND a.k = 0 AND b.k = b.closures - 1)"""
TOWN_SQL, MAP_SQL = _TOWN.format(towns=TOWNS), _TOWN.format(towns=MAPS)


@town_query(f"""WITH {MAP_SQL}, cells AS (SELECT *, unnest(range(g)) AS c FROM (SELECT *, unnest(range(g)) AS r FROM fr)),
st AS (SELECT scene_id, 5 * k AS r, 5 * n AS c, 'S' || k AS name FROM (SELECT *, unnest(range(n + 1)) AS k FROM fr) UNION ALL SELECT scene_id, 5 * n, 5 * k, 'S' || (n + 1 + k) FROM (SELECT *, unnest(range(n)) AS k FROM fr)),
stamp AS (SELECT scene_id, r, c + i AS c, substr(name, CAST(i + 1 AS INT), 1) AS ch FROM (SELECT *, unnest(range(length(name))) AS i FROM st)),
geo AS (SELECT q.scene_id, q.g, q.r, q.c, coalesce(s.ch, CASE WHEN q.r = q.g - 1 OR q.c = q.g - 1 THEN '.' WHEN q.r % 5 = 0 THEN '=' WHEN q.c % 5 = 0 THEN '|'
 WHEN q.r % 5 = 3 AND q.c % 5 = 3 THEN substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((q.r // 5) * q.n + q.c // 5 + 1 AS INT), 1) ELSE '#' END) AS ch FROM cells q LEFT JOIN stamp s ON s.scene_id = q.scene_id AND s.r = q.r AND s.c = q.c),
li AS (SELECT *, greatest(abs(c2 - c1), abs(r2 - r1)) AS long_, least(abs(c2 - c1), abs(r2 - r1)) AS short_ FROM far), ls AS (SELECT *, unnest(range(long_ + 1)) AS i FROM li),
paint AS (SELECT scene_id, tr + u AS r, tc AS c, 1 AS p, CASE WHEN d = 0 THEN '-' ELSE '|' END AS ch FROM (SELECT *, r0 + 2 - tr AS d, unnest(range(r0 + 3 - tr)) AS u FROM cl)
 UNION ALL SELECT scene_id, r1 + sign(r2 - r1) * CASE WHEN abs(c2 - c1) >= abs(r2 - r1) THEN (2 * i * short_ + long_ - 1) // (2 * long_) ELSE i END, c1 + sign(c2 - c1) * CASE WHEN abs(c2 - c1) >= abs(r2 - r1) THEN i ELSE (2 * i * short_ + long_ - 1) // (2 * long_) END, 2,
  CASE WHEN abs(c2 - c1) >= 2 * abs(r2 - r1) THEN '-' WHEN abs(r2 - r1) >= 2 * abs(c2 - c1) THEN '|' WHEN (c2 > c1) = (r2 < r1) THEN chr(92) ELSE '/' END FROM ls
 UNION ALL SELECT scene_id, tr, tc, 3, substr('abcdefghijklmnopqrstuvwxyz', CAST(k + 1 AS INT), 1) FROM cl UNION ALL SELECT scene_id, 0, 0, 3, '*' FROM fr),
net AS (SELECT q.scene_id, q.g, q.r, q.c, coalesce(arg_max(p.ch, p.p), '.') AS ch FROM cells q LEFT JOIN paint p ON p.scene_id = q.scene_id AND p.r = q.r AND p.c = q.c GROUP BY ALL),
both_ AS (SELECT 'geography' AS layer, * FROM geo UNION ALL SELECT 'network', * FROM net), rows_ AS (SELECT scene_id, layer, CAST(g - 1 - r AS INT) AS row, string_agg(ch, ' ' ORDER BY c) AS line FROM both_ GROUP BY scene_id, layer, g, r)
SELECT scene_id, layer, row, lpad(CAST(row AS VARCHAR), 2, '0') || ' | ' || line || ' | ' || lpad(CAST(row AS VARCHAR), 2, '0') AS line FROM rows_""")
def town_map(spark, sf_dir):
    """Both grids of each town, of a few towns of every size and kind."""
    specs = tw.specifications(spark, MAPS)
    f, t = _frames(specs), _town(specs)
    layers = {"geography": tm.geography(f, t["streets"], t["buildings"]), "network": tm.network(f, t["equipment"], t["cables"])}
    one, two = (tm.grid(f, cells).withColumn("layer", F.lit(name)) for name, cells in layers.items())
    return one.unionByName(two)


def _mx(cc: str, rr: str) -> str:
    y = f"(32.085 + ({rr}) * {_DA})"
    return f"CAST(floor({sql_haversine(f'(34.78 - 0.25 * {_DL})', y, f'(34.78 + ({cc}) * {_DL})', y)} + 0.5) AS BIGINT)"


def _my(cc: str, rr: str) -> str:
    x = f"(34.78 + ({cc}) * {_DL})"
    return f"CAST(floor({sql_haversine(x, f'(32.085 - 0.25 * {_DA})', x, f'(32.085 + ({rr}) * {_DA})')} + 0.5) AS BIGINT)"


def _spot(cc: str, rr: str) -> str:
    at = f"'(' || CAST(floor({cc} + 0.25) AS INT) || ',' || CAST(g - 1 - floor({rr} + 0.25) AS INT) || ')'"
    return f"{at} || '  x=' || {_mx(cc, rr)} || ' y=' || {_my(cc, rr)}"


def _wire(name: str, kind: str, ends: str, cc: str, rr: str, dc: str, dr: str) -> str:
    cell = lambda x, y: f"'(' || CAST(floor({x} + 0.25) AS INT) || ',' || CAST(g - 1 - floor({y} + 0.25) AS INT) || ')'"
    spot = lambda x, y: f"'[' || {_mx(x, y)} || ',' || {_my(x, y)} || ']'"
    return f"'  ' || rpad({name}, 14, ' ') || ' ' || rpad('{kind}', 13, ' ') || ' ' || {ends} || '  ' || {cell(cc, rr)} || '->' || {cell(dc, dr)} || '  m' || {spot(cc, rr)} || '->' || {spot(dc, dr)}"


_AREA = f"{sql_haversine(f'(34.78 + (b.c0 + 2) * {_DL})', f'(32.085 + (b.r0 + 2) * {_DA})', f'(34.78 + cl.cc * {_DL})', f'(32.085 + cl.rr * {_DA})')}"


@town_query(f"""WITH {MAP_SQL}, near AS (SELECT b.scene_id, b.k, min({_AREA}) AS d FROM bb b JOIN cl ON cl.scene_id = b.scene_id GROUP BY ALL),
hb AS (SELECT b.*, 'B-' || b.bi || '-' || b.bj AS id, d, coalesce(cl.id, 'none') AS by_ FROM bb b JOIN near USING (scene_id, k) LEFT JOIN cl ON cl.scene_id = b.scene_id AND cl.k = b.k)
SELECT scene_id, 'equipment' AS section, CAST(k + 1 AS BIGINT) AS n, '  ' || rpad(id, 8, ' ') || ' ' || substr('abcdefghijklmnopqrstuvwxyz', CAST(k + 1 AS INT), 1) || '  ' || {_spot('cc', 'rr')} || '  closure serves=' || home || ' on=' || CASE WHEN inb AND k = 0 THEN 'S' || (n + 1) || ' "V Street 0' ELSE 'S' || bj || ' "H Street ' || bj END || '" near "' || addr
 || '" inside=' || CASE WHEN inb AND k = 0 THEN home ELSE 'none' END || ' d_street=' || CASE WHEN inb AND k = 0 THEN '25.0' WHEN road AND k = closures - 1 THEN '0.0' ELSE '3.0' END || 'm street=' || CASE WHEN inb AND k = 0 THEN 'V' ELSE 'H' END || ' Street ' || bj || ' up=CO-1' AS line FROM cl
UNION ALL SELECT scene_id, 'equipment', 0, '  CO-1     *  ' || {_spot('0.5', '0.5')} || '  source feeds=' || (SELECT string_agg(id, ',' ORDER BY k) FROM cl WHERE cl.scene_id = fr.scene_id) || ' inside=none d_street=0.0m street=H Street 0' FROM fr
UNION ALL SELECT scene_id, 'building', k, '  ' || rpad(id, 8, ' ') || ' ' || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(k + 1 AS INT), 1) || '  ' || {_spot('(c0 + 2)', '(r0 + 2)')} || '  house floors=2 addr "' || addr || '" d_closure=' || printf('%.1f', d) || 'm ext=x' || least({_mx('c0', 'r0')}, {_mx('c0', 'r0 + 4')}) || '..' || greatest({_mx('c0 + 4', 'r0')}, {_mx('c0 + 4', 'r0 + 4')})
 || ' y' || {_my('c0', 'r0')} || '..' || {_my('c0', 'r0 + 4')} || ' street=V Street ' || bi || ' served_by=' || by_ FROM hb
UNION ALL SELECT scene_id, 'footprint', k, '  ' || rpad(id, 8, ' ') || ' ' || {" || ' ' || ".join(f"'[' || {_mx(x, y)} || ',' || {_my(x, y)} || ']'" for x, y in (('c0', 'r0'), ('c0 + 4', 'r0'), ('c0 + 4', 'r0 + 4'), ('c0', 'r0 + 4')))} FROM hb
UNION ALL SELECT scene_id, 'street', k, '  ' || rpad('S' || k, 4, ' ') || ' ' || CASE WHEN k <= n THEN 'E-W  H Street ' || k ELSE 'N-S  V Street ' || (k - n - 1) END FROM (SELECT *, unnest(range(2 * n + 2)) AS k FROM fr)
UNION ALL SELECT scene_id, 'cable', k, {_wire("'drop-' || id", 'drop', "id || ' -> ' || home", 'cc', 'rr', '(c0 + 2)', '(r0 + 2)')} || '  terminates_in=' || home FROM cl
UNION ALL SELECT scene_id, 'cable', 1000, {_wire("'dist-cross'", 'distribution', "'CL-A -> ' || target", 'ac', 'ar', 'bc', 'br')} FROM far""")
def town_legend(spark, sf_dir):
    """The measured legend of the towns that have a map."""
    specs = tw.specifications(spark, MAPS)
    return tm.legend(_frames(specs), **_town(specs))


@town_query(f"""WITH {TOWN_SQL} SELECT scene_id, 'drop-' || id AS cable_id, 'OK' AS status FROM cl UNION ALL SELECT scene_id, 'dist-cross', 'CROSSES_BUILDING' FROM far
UNION ALL SELECT scene_id, 'feed-1', CASE WHEN inb THEN 'OFF_ROAD' ELSE 'OK' END FROM fr UNION ALL SELECT scene_id, 'lead-1', 'TOO_LONG' FROM fr""")
def town_cable_status(spark, sf_dir):
    """State of each cable: the towns' own, one from the office to the first closure, and a drop along the whole southern street."""
    specs = tw.specifications(spark, TOWNS)
    e = tw.equipment(specs)
    first = e.filter("ord = 1").select("scene_id", F.col("id").alias("target"), F.col("x").alias("bx"), F.col("y").alias("by"))
    feed = e.filter("kind = 'co'").join(first, "scene_id").select("scene_id", F.lit("feed-1").alias("cable_id"), F.lit("distribution").alias("kind"), F.col("id").alias("source"), "target", "x", "y", "bx", "by")
    lead = tw.streets(specs).filter("street_id = 'st-h-0'").select("scene_id", F.lit("lead-1").alias("cable_id"), F.lit("drop").alias("kind"), F.lit("CO-1").alias("source"), F.lit("nobody").alias("target"), "x", "y", "bx", "by")
    c = tw.cables(specs).unionByName(feed).unionByName(lead)
    served = e.filter("serves IS NOT NULL").select("scene_id", F.col("id").alias("end"), F.col("serves").alias("area"))
    ends = c.select("scene_id", "cable_id", F.explode(F.array("source", "target")).alias("end"))
    own = ends.join(served, ["scene_id", "end"]).select("scene_id", "cable_id", "area").union(ends.select("scene_id", "cable_id", F.col("end").alias("area"))).distinct()
    return cable_states(c, own, tw.buildings(specs), tw.streets(specs))


def _scene(spark, sf_dir) -> tuple[DataFrame, dict]:
    """Frames and tables of the supplied scenes for their text maps."""
    nth = lambda key: (F.row_number().over(Window.partitionBy("scene_id").orderBy(key)) - 1).alias("ord")
    text = lambda c: F.col(c).cast("string")
    b, e, d = sc.buildings(spark, sf_dir), sc.equipment(spark, sf_dir), sc.distribution(spark, sf_dir)
    streets = sc.streets(spark, sf_dir).select("scene_id", "street_id", nth("street_id"), "name", "line")
    near = sp.nearest(b, e, 1).groupBy("scene_id", F.col("other").alias("id")).agg(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")).alias("serves"))
    equipment = e.join(near, ["scene_id", "id"], "left").select("scene_id", nth("id"), text("id").alias("id"), "kind", "x", "y", F.coalesce("serves", F.array().cast("array<string>")).alias("serves"))
    buildings = b.select("scene_id", nth("id"), text("id").alias("id"), "x", "y", "footprint", "type", "floors", F.concat(text("id"), F.lit(" Main Street")).alias("address"))
    cables = _line(d).select("scene_id", nth("source"), F.col("cable_id").alias("id"), "kind", text("source").alias("source"), text("target").alias("target"), "line")
    frames = sc.points(spark, sf_dir).groupBy("scene_id").agg(*[f(c).alias(f"{k}_{c}") for c in ("x", "y") for k, f in (("min", F.min), ("max", F.max))])
    frames = frames.select("scene_id", *[(F.col(c) + s * sc.HALF).alias(c) for c, s in (("min_x", -1), ("min_y", -1), ("max_x", 1), ("max_y", 1))])
    return tm.framed(frames), {"streets": streets, "buildings": buildings, "equipment": equipment, "cables": cables}


@query()
def scene_map(spark, sf_dir):
    """Both grids of each supplied scene."""
    f, t = _scene(spark, sf_dir)
    layers = {"geography": tm.geography(f, t["streets"], t["buildings"]), "network": tm.network(f, t["equipment"], t["cables"])}
    one, two = (tm.grid(f, cells).withColumn("layer", F.lit(name)) for name, cells in layers.items())
    return one.unionByName(two)


@query()
def scene_legend(spark, sf_dir):
    """The measured legend of each supplied scene."""
    f, t = _scene(spark, sf_dir)
    return tm.legend(f, **t)


_T = "greatest(0.0, least(1.0, coalesce((((a.x + a.bx) / 2 - s.x) * (s.bx - s.x) + ((a.y + a.ey) / 2 - s.y) * (s.ey - s.y)) / nullif((s.bx - s.x) * (s.bx - s.x) + (s.ey - s.y) * (s.ey - s.y), 0), 0)))"


@query(f"""WITH {sc.SCENE_SQL}, o AS (SELECT a.cable_id, min(sqrt(pow((a.x + a.bx) / 2 - (s.x + {_T} * (s.bx - s.x)), 2) + pow((a.y + a.ey) / 2 - (s.y + {_T} * (s.ey - s.y)), 2))) AS off FROM dist a JOIN st s ON s.scene_id = a.scene_id GROUP BY 1),
h AS (SELECT DISTINCT a.cable_id FROM dist a JOIN bld b ON b.scene_id = a.scene_id AND {_sql_meets('a', 'b')})
SELECT scene_id, cable_id, CASE WHEN cable_id IN (SELECT cable_id FROM h) THEN 'CROSSES_BUILDING' WHEN coalesce(off, 1e9) >= 0.0001 AND greatest(floor({sql_haversine('x', 'y', 'bx', 'y')} / 10), floor({sql_haversine('x', 'y', 'x', 'ey')} / 10)) >= 2 THEN 'OFF_ROAD'
 WHEN {sql_haversine('x', 'y', 'bx', 'ey')} > 500 THEN 'TOO_LONG' ELSE 'OK' END AS status FROM dist LEFT JOIN o USING (cable_id)""")
def scene_cable_status(spark, sf_dir):
    """State of each cable between closures of the supplied scenes."""
    d = sc.distribution(spark, sf_dir)
    own = d.select("scene_id", "cable_id", F.explode(F.array("source", "target")).alias("area"))
    return cable_states(d, own, sc.buildings(spark, sf_dir), sc.streets(spark, sf_dir))


#: Degrees within which the middle of a cable counts as on a road, and the grid cells that a stretch off it may have.
ON_ROAD, OFF_CELLS = 0.0001, 2


def cable_states(lines: DataFrame, own: DataFrame, buildings: DataFrame, streets: DataFrame, cell_m: float = tw.CELL_M) -> DataFrame:
    """(scene_id, cable_id, status) of straight cables: through a building that is not its own (scene_id, cable_id, area), off the
    roads (drops may be), longer than its kind may be, or fine; the first that holds."""
    hit = sp.segments_through_footprints(lines, buildings).join(own, ["scene_id", "cable_id", "area"], "left_anti").select("scene_id", "cable_id").distinct().withColumn("hit", F.lit(True))
    middle = P((F.col("x") + F.col("bx")) / 2, (F.col("y") + F.col("by")) / 2)
    roads = streets.select("scene_id", F.struct("x", "y").alias("a"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")).alias("b"))
    near = lines.select("scene_id", "cable_id", middle.x.alias("x"), middle.y.alias("y")).join(roads, "scene_id")
    near = near.groupBy("scene_id", "cable_id").agg(F.min(geo.segment_degrees(P(F.col("x"), F.col("y")), geo.pt("a"), geo.pt("b"))).alias("off"))
    a, b = P(F.col("x"), F.col("y")), P(F.col("bx"), F.col("by"))
    wide, high = (F.floor(geo.haversine(a, q) / cell_m) for q in (P(b.x, a.y), P(a.x, b.y)))
    off = (F.col("kind") != "drop") & (F.coalesce("off", F.lit(float("inf"))) >= ON_ROAD) & (F.greatest(wide, high) >= OFF_CELLS)
    c = lines.join(hit, ["scene_id", "cable_id"], "left").join(near, ["scene_id", "cable_id"], "left")
    return c.select("scene_id", "cable_id", nw.cable_status(F.coalesce("hit", F.lit(False)), off, F.col("kind"), geo.haversine(a, b)).alias("status"))


@town_query(f"""WITH {TOWN_SQL} SELECT scene_id, id, CASE WHEN bi = n - 1 THEN 'different_component' ELSE 'reachable' END AS reason, CAST(CASE WHEN bi < n - 1 THEN 50 * (bi + 1 + bj) END AS BIGINT) AS metres,
 CAST(CASE WHEN bi < n - 1 THEN bi + 1 + bj END AS INT) AS hops FROM cl WHERE NOT inb AND NOT road UNION ALL SELECT scene_id, 'FAR', 'too_far_from_graph', NULL, NULL FROM fr WHERE NOT inb AND NOT road""")
def town_reach(spark, sf_dir):
    """Which closures the office reaches along a lattice of crossings whose last column is cut off, how far and over how many edges."""
    specs = tw.specifications(spark, TOWNS).filter("NOT in_building AND NOT on_street")
    at = specs.select("scene_id", F.col("nx").alias("n"), F.explode(F.sequence(F.lit(0), F.col("nx"))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("j"))
    name = lambda i, j: F.concat_ws("/", F.col("scene_id").cast("string"), i.cast("string"), j.cast("string"))
    i, j = F.col("i"), F.col("j")
    cell = tw._cell(i * tw.PITCH, j * tw.PITCH)
    lattice = at.select("scene_id", name(i, j).alias("id"), cell.x.alias("x"), cell.y.alias("y"))
    east = at.filter("i < n - 1").select(name(i, j).alias("source"), name(i + 1, j).alias("target"), F.lit(50.0).alias("cost"))
    north = at.filter("j < n").select(name(i, j).alias("source"), name(i, j + 1).alias("target"), F.lit(50.0).alias("cost"))
    e = tw.equipment(specs)
    away = e.filter("kind = 'co'").select("scene_id", F.lit("FAR").alias("id"), (F.col("x") - 0.01).alias("x"), "y")
    points = e.filter("kind = 'closure'").select("scene_id", "id", "x", "y").unionByName(away)
    got = rt.reach(points, e.filter("kind = 'co'").select("scene_id", "x", "y"), lattice, rt.directed(east.unionByName(north), F.lit(False)), 50.0)
    return got.select("scene_id", "id", "reason", F.col("cost").cast("long").alias("metres"), (F.size("way") - 1).alias("hops"))


@query(f"{W} SELECT id, CAST(CASE type WHEN 'co' THEN 0 WHEN 'cabinet' THEN 1 WHEN 'closure' THEN 2 ELSE 3 END AS BIGINT) AS hops FROM nodes WHERE type = 'co' OR id IN (SELECT target FROM cables)")
def hops_to_office(spark, sf_dir):
    """Cables between a node and its office, walked in either direction."""
    return _ways(spark, sf_dir).select("id", (F.size("path") - 1).cast("long").alias("hops"))


def _ways(spark, sf_dir) -> DataFrame:
    return gr.ways_to(cables(spark, sf_dir), nodes(spark, sf_dir).filter("type = 'co'"))


@query(f"WITH RECURSIVE {NET}, t AS (SELECT id, id AS path FROM nodes WHERE type = 'co' UNION ALL SELECT c.target, c.target || ' <- ' || t.path FROM t JOIN cables c ON c.source = t.id) SELECT id, path FROM t")
def path_to_office(spark, sf_dir):
    """The way from every node to the nearest office, of any length."""
    return _ways(spark, sf_dir).select("id", F.array_join("path", " <- ").alias("path"))


_LABEL = "CASE type WHEN 'co' THEN '★' WHEN 'cabinet' THEN '◆' WHEN 'closure' THEN '●' ELSE '○' END || ' ' || upper(type) || coalesce(' (' || ratio || ')', '') || ' [' || id || ']'"


@query(f"""WITH RECURSIVE {NET}, x AS (SELECT id, type, {_LABEL} AS text FROM nodes), ch AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY ord, target) AS k, count(*) OVER (PARTITION BY source) AS n FROM cables),
t AS (SELECT id AS root, id, '' AS place, text AS line, '' AS prefix FROM x WHERE type = 'co'
 UNION ALL SELECT root, x.id, place || CASE WHEN place = '' THEN '' ELSE '.' END || k, prefix || CASE WHEN k = n THEN '└── ' ELSE '├── ' END || text, prefix || CASE WHEN k = n THEN '    ' ELSE '│   ' END FROM t JOIN ch ON ch.source = t.id JOIN x ON x.id = ch.target)
SELECT root, id, place, line FROM t""")
def hierarchy_lines(spark, sf_dir):
    """The network below each office as the lines of a tree, of any depth."""
    n = nodes(spark, sf_dir)
    symbol = F.when(F.col("type") == "co", "★").when(F.col("type") == "cabinet", "◆").when(F.col("type") == "closure", "●").otherwise("○")
    label = F.concat(symbol, F.lit(" "), F.upper("type"), F.coalesce(F.concat(F.lit(" ("), "ratio", F.lit(")")), F.lit("")), F.lit(" ["), "id", F.lit("]"))
    named = n.select("id", "type", label.alias("label"))
    t = gr.tree_lines(named.select("id", "label"), cables(spark, sf_dir), named.filter("type = 'co'"))
    return t.select("root", "id", F.array_join(F.transform("place", lambda k: k.cast("string")), ".").alias("place"), "line")


# Fibres, ports and hardware of cabinets and closures.
FIBRES = """dev AS (SELECT n.id, coalesce(n.ratio, '1:8') AS ratio, CAST(substr(coalesce(n.ratio, '1:8'), 3) AS INT) AS ways, c.fibres FROM nodes n JOIN cables c ON c.target = n.id WHERE n.type IN ('cabinet', 'closure')),
run AS (SELECT c.source AS id, c.target, 2 * row_number() OVER (PARTITION BY c.source ORDER BY c.ord) AS first FROM cables c JOIN nodes t ON t.id = c.target AND t.type = 'closure'),
colours AS (SELECT ['blue', 'orange', 'green', 'brown', 'slate', 'white', 'red', 'black', 'yellow', 'violet', 'rose', 'aqua'] AS name),
used AS (SELECT id, least(any_value(fibres), 1 + 2 * count(*)) AS u FROM run JOIN dev USING (id) GROUP BY 1),
alloc AS (SELECT id, 1 AS fibre, 'splitter_input' AS usage, 'splitter-' || ratio AS destination FROM dev UNION ALL SELECT id, f, 'pass_through', target FROM (SELECT run.id, target, unnest([first, first + 1]) AS f FROM run) r JOIN dev USING (id) WHERE f <= fibres
 UNION ALL SELECT id, unnest(range(coalesce(u, 1) + 1, fibres + 1)), 'reserve', NULL FROM dev LEFT JOIN used USING (id)),
port AS (SELECT d.id, p AS port, x.target AS address, x.id AS cable FROM (SELECT *, unnest(range(1, ways + 1)) AS p FROM dev) d LEFT JOIN (SELECT c.*, row_number() OVER (PARTITION BY source ORDER BY ord) AS r FROM cables c WHERE c.id LIKE 'x-%') x ON x.source = d.id AND x.r = d.p)"""
_COLOUR = "(SELECT name FROM colours)[CAST(({0} - 1) % 12 + 1 AS INT)]"


def devices(spark, sf_dir) -> DataFrame:
    c = cables(spark, sf_dir).select(F.col("target").alias("id"), "fibres")
    return nodes(spark, sf_dir).filter("type IN ('cabinet', 'closure')").select("id", F.coalesce("ratio", F.lit("1:8")).alias("ratio")).join(c, "id")


def _fibres(spark, sf_dir) -> DataFrame:
    below = cables(spark, sf_dir).filter(F.col("id").startswith("d-")).select(F.col("source").alias("id"), "target", "ord", "fibres")
    return fb.allocation(devices(spark, sf_dir), below)


def _ports(spark, sf_dir) -> DataFrame:
    drops = cables(spark, sf_dir).filter(F.col("id").startswith("x-")).select(F.col("source").alias("id"), "target", F.col("id").alias("cable"), "ord")
    return fb.ports(devices(spark, sf_dir), drops)


@query(f"{W}, {FIBRES} SELECT id, CAST(fibre AS BIGINT) AS fibre, usage, destination, {_COLOUR.format('fibre')} AS colour FROM alloc")
def device_fibres(spark, sf_dir):
    """What each fibre of a device's cable is for."""
    return _fibres(spark, sf_dir)


@query(f"{W}, {FIBRES} SELECT id, CAST(port AS INT) AS port, address, cable, CASE WHEN address IS NULL THEN 'available' ELSE 'allocated' END AS status, {_COLOUR.format('port')} AS colour FROM port")
def device_ports(spark, sf_dir):
    """Who is at each port of a splitter."""
    return _ports(spark, sf_dir)


@query(f"{W}, {FIBRES} SELECT id, CAST(min(port) FILTER (address IS NULL) AS INT) AS next_port, count(*) FILTER (address IS NOT NULL) AS allocated, count(*) FILTER (address IS NULL) AS available, count(*) FILTER (address IS NULL) > 0 AS can_connect FROM port GROUP BY 1")
def device_next_port(spark, sf_dir):
    """The first free port of a device, and how many are taken and free."""
    free = F.col("status") == "available"
    return _ports(spark, sf_dir).groupBy("id").agg(F.min(F.when(free, F.col("port"))).alias("next_port"), F.count_if(~free).alias("allocated"), F.count_if(free).alias("available"), (F.count_if(free) > 0).alias("can_connect"))


@query(f"""{W}, {FIBRES} SELECT id, CAST(port AS INT) AS output, address AS drop, CASE ways WHEN 2 THEN 3.6 WHEN 4 THEN 7.2 WHEN 8 THEN 10.8 WHEN 16 THEN 14.1 WHEN 32 THEN 17.5 ELSE 10.8 END::DOUBLE AS loss, 'blue' AS input_colour, {_COLOUR.format('port')} AS colour
FROM port JOIN dev USING (id) WHERE address IS NOT NULL""")
def splice_config(spark, sf_dir):
    """Splices of a device: output, house, loss of the port and colours at both ends."""
    d = devices(spark, sf_dir).select("id", nw.splitter_db(tx.splitter_ways(F.col("ratio")), "port").alias("loss"))
    p = _ports(spark, sf_dir).filter("status = 'allocated'").join(d, "id")
    return p.select("id", F.col("port").alias("output"), F.col("address").alias("drop"), "loss", tx.fibre_colour(F.lit(1)).alias("input_colour"), "colour")


@query(f"{W}, {FIBRES} SELECT id, CASE WHEN fibres <= 12 THEN 'wall-12f' WHEN fibres <= 24 THEN 'inline-24f' WHEN fibres <= 48 THEN 'dome-48f' WHEN fibres <= 96 THEN 'dome-96f' ELSE 'rack-144f' END AS enclosure, CAST(t AS INT) AS tray, (12 * t - 11) || '-' || least(12 * t, fibres) AS fibres FROM (SELECT *, unnest(range(1, CAST(ceil(fibres / 12) AS BIGINT) + 1)) AS t FROM dev)")
def device_trays(spark, sf_dir):
    """Enclosure and trays of a device."""
    return fb.trays(devices(spark, sf_dir))


@query(f"""{W}, {FIBRES} SELECT id, CAST(port AS INT) AS port, CASE WHEN port = 1 THEN NULL WHEN port = 2 AND address IS NULL THEN 'new-' || id ELSE address END AS address, CASE WHEN port = 1 OR address IS NULL AND port > 2 THEN 'available' WHEN port = 2 THEN 'allocated' ELSE 'allocated' END AS status FROM port""")
def device_port_changes(spark, sf_dir):
    """Ports after the first one is freed and a house asks for the second one; it gets it where it is free."""
    state = _ports(spark, sf_dir)
    ask = devices(spark, sf_dir).select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("port"))
    ask = ask.select("id", "port", F.when(F.col("port") == 2, F.concat(F.lit("new-"), "id")).alias("address"), F.lit(None).cast("string").alias("cable"))
    return fb.changed(state, ask).select("id", "port", "address", "status")


@query(f"""{W}, {FIBRES}, n AS (SELECT id, fibres, ways, CAST(substr(id, instr(id, '-') + 1) AS INT) % 5 AS k, id IN (SELECT id FROM port WHERE address IS NOT NULL) AS taken FROM dev)
SELECT id, unnest(CASE k WHEN 0 THEN ['duplicate fibre', 'fibre count'] WHEN 1 THEN ['no splitter input', 'fibre count'] WHEN 2 THEN ['port count'] WHEN 3 THEN CASE WHEN taken THEN ['port without address'] ELSE [] END ELSE [] END) AS problem FROM n""")
def device_problems(spark, sf_dir):
    """Checks of tables with faults put in: a fibre twice, no splitter's fibre, a port too few, addresses lost."""
    d, f, p = devices(spark, sf_dir), _fibres(spark, sf_dir), _ports(spark, sf_dir)
    k = F.regexp_extract("id", "-([0-9]+)$", 1).cast("int") % 5
    f = f.unionByName(f.filter((k == 0) & (F.col("fibre") == 2))).filter((k != 1) | (F.col("fibre") > 1))
    p = p.filter((k != 2) | (F.col("port") > 1)).withColumn("address", F.when(k != 3, F.col("address")))
    return fb.problems(d, f, p)


# Addresses.
@query(f"""WITH {SCENE_SQL}, a AS (SELECT *, CASE WHEN id % 3 = 1 THEN id || ' Main Street, Town' ELSE 'Building ' || id END AS address, CASE WHEN id % 7 = 0 THEN NULL ELSE floors END AS fl FROM bld)
SELECT id, address, lower(regexp_replace(address, ',', ' ', 'g')).regexp_replace('\\s+', ' ', 'g') AS normalized, CASE WHEN id % 3 = 1 THEN 'Main Street' END AS street, CAST(id AS VARCHAR) AS number,
 coalesce(fl, 1) * (id % 4 + 1) AS demand, CASE WHEN id % 11 = 0 THEN 'Point' ELSE 'Polygon' END AS shape, CAST(CASE WHEN id % 11 = 0 THEN 0 ELSE 5 END AS INT) AS vertices FROM a""")
def building_addresses(spark, sf_dir):
    """Address rows from buildings: a name of their own where there is none, demand from floors, rings that are closed."""
    b = sc.buildings(spark, sf_dir)
    ring = F.when(F.col("id") % 11 == 0, F.slice("footprint", 1, 2)).when(F.col("id") % 5 == 1, F.slice("footprint", 1, 4)).otherwise(F.col("footprint"))
    address = F.when(F.col("id") % 3 == 1, F.concat(F.col("id").cast("string"), F.lit(" Main Street, Town")))
    floors = F.when(F.col("id") % 7 != 0, F.col("floors"))
    return address_rows(b.select("id", address.alias("address"), F.lit(None).cast("long").alias("units"), floors.alias("floors"), (F.col("id") % 4 + 1).alias("per_floor"), ring.alias("footprint"), F.col("id").alias("place")))


def address_rows(buildings: DataFrame) -> DataFrame:
    """(id, address, normalized, street, number, demand, shape, vertices) of buildings (id, address, units, floors, per_floor, footprint,
    place): units where they are known, else floors times units a floor, each 1 where it is not known or 0; a footprint of three vertices
    or more is a polygon, closed where it is open."""
    known = lambda c: F.when(F.col(c) != 0, F.col(c))
    named = buildings.withColumn("address", F.coalesce(F.nullif("address", F.lit("")), F.concat(F.lit("Building "), F.col("place").cast("string"))))
    n = F.size("footprint")
    closed = F.get("footprint", F.lit(0)) == F.get("footprint", n - 1)
    vertices = F.when(F.coalesce(n, F.lit(0)) < 3, 0).when(closed, n).otherwise(n + 1)
    demand = F.coalesce(known("units"), F.coalesce(known("floors"), F.lit(1)) * F.coalesce(known("per_floor"), F.lit(1)))
    a = F.col("address")
    return named.select("id", "address", tx.address_plain(a).alias("normalized"), tx.street_of(a).alias("street"), tx.number_of(a).alias("number"), demand.cast("long").alias("demand"), F.when(vertices > 0, "Polygon").otherwise("Point").alias("shape"), vertices.alias("vertices"))


@query(f"""{W} SELECT n.id, p.closure, x.length AS drop_metres, {_db_sql('index')} AS loss, CASE WHEN p.house IS NULL THEN 'orphaned' ELSE 'connected' END AS status
FROM nodes n LEFT JOIN paths p ON p.house = n.id LEFT JOIN cables x ON x.target = n.id WHERE n.type = 'house'""")
def address_features(spark, sf_dir):
    """Houses with their closure, the length of their drop, the loss of their path and whether they are connected."""
    h = nodes(spark, sf_dir).filter("type = 'house'").select("id")
    p = paths(spark, sf_dir).select(F.col("house").alias("id"), "closure", _db("index").alias("loss"))
    x = cables(spark, sf_dir).select(F.col("target").alias("id"), F.col("length").alias("drop_metres"))
    return h.join(p, "id", "left").join(x, "id", "left").select("id", "closure", "drop_metres", "loss", F.when(F.col("closure").isNull(), "orphaned").otherwise("connected").alias("status"))


# Vocabularies, hashes and shuffles.
_SKINNED = {
    "ftth": "FTTH: Closure CL-{0} of the central office CO-1 (CO), kind=drop \"kind\":\"distribution\" drop-7, a drop. CABLES: cable",
    "water": "water utility: Valve VL-{0} of the pumping plant PL-1 (plant), kind=service \"kind\":\"main\" svc-7, a service pipe. PIPES: pipe",
    "electric": "electric-grid: Transformer TR-{0} of the substation SS-1 (substation), kind=drop \"kind\":\"distribution\" drop-7, a drop. CABLES: cable",
    "sensor": "sensor-network: Sensor SN-{0} of the gateway hub GW-1 (gateway), kind=drop \"kind\":\"distribution\" drop-7, a drop. CABLES: cable",
    "logistics": "logistics: Depot DP-{0} of the central hub HB-1 (hub), kind=leg \"kind\":\"distribution\" leg-7, a delivery leg. ROUTES: route",
    "generic": "generic network: Node ND-{0} of the root node RT-1 (root), kind=spur \"kind\":\"distribution\" spur-7, a spur. LINKS: link",
}


def _sql_text(t: str) -> str:
    return "'" + t.replace("{0}", "' || p_partkey || '") + "'"


@query(f"SELECT p_partkey AS id, CASE p_partkey % 6 {' '.join(f'WHEN {i} THEN {_sql_text(t)}' for i, t in enumerate(_SKINNED.values()))} END AS skinned, '{{\"closureId\": \"CL-' || p_partkey || '\", \"path\": [\"CO-1\", \"drop-7\"]}}' AS answer FROM part")
def skins(spark, sf_dir):
    """A text in the six vocabularies in turn, and an answer given in each, turned back."""
    name = F.element_at(F.array(*map(F.lit, sk.SKINS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    ident = F.col("p_partkey").cast("string")
    head, tail = _SKINNED["ftth"].split("{0}")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("skin"), F.concat(F.lit(head), ident, F.lit(tail)).alias("text"), F.concat(F.lit('{"closureId": "CL-'), ident, F.lit('", "path": ["CO-1", "drop-7"]}')).alias("answer"))
    there = sk.apply(F.col("answer"), F.col("skin"))
    return p.select("id", sk.apply(F.col("text"), F.col("skin")).alias("skinned"), sk.undo(there, F.col("skin")).alias("answer"))


@query("SELECT p_partkey AS id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS hash FROM part")
def text_hash(spark, sf_dir):
    """A hash of 32 bits of each name."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), rd.hash32(F.col("p_name")).alias("hash"))


SEED = 1234567


def _swapped(n: int) -> list[int]:
    """Places of n items after the shuffle, in plain Python."""
    s, a = SEED, list(range(n))
    for i in range(n - 1, 0, -1):
        s = (s * 1103515245 + 12345) % 2**32
        j = int(s / 2**32 * (i + 1))
        a[i], a[j] = a[j], a[i]
    return a


@query(f"""WITH o AS (SELECT l_orderkey AS id, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY 1)
SELECT id, array_to_string(CASE len(a) {' '.join(f"WHEN {n} THEN [{', '.join(f'a[{k + 1}]' for k in _swapped(n))}]" for n in range(1, 8))} ELSE a END, ',') AS shuffled FROM o WHERE len(a) <= 7""")
def shuffled_lines(spark, sf_dir):
    """The lines of each order in an order that a seed settles."""
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a")).filter(F.size("a") <= 7)
    lines = F.transform("a", lambda v: v["l_linenumber"].cast("string"))
    return o.select("id", F.array_join(rd.shuffled(lines, F.lit(SEED)), ",").alias("shuffled"))
