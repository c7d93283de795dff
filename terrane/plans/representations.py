"""The supplied scenes in the forms in which a model reads them, a text for each scene, or for each zone of a scene."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import gridtwin as gt
from terrane.operators import sceneforms as form
from terrane.operators import zonegrid as zg
from terrane.plans.spatial import SQL_IN, _sql_meets
from terrane.plans.spatial import drops as scene_drops
from terrane.sources import scenes as sc
from terrane.sources.scenes import SCENE_SQL, sql_haversine, sql_segment

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _cables(spark, sf_dir):
    """Distribution cables and the drops of closures, in the order of the device or house that they are named after."""
    own = lambda df, kind, n: df.select("scene_id", "cable_id", F.lit(kind).alias("kind"), F.col(n).alias("number"), F.col(n).alias("ord"), "source", "target", "x", "y", "bx", "by")
    return own(sc.distribution(spark, sf_dir), "distribution", "source").unionByName(own(scene_drops(spark, sf_dir), "drop", "target"))


def _scene(spark, sf_dir):
    """Buildings with addresses, streets, equipment, who serves whom, and cables. Every third building has an address."""
    address = F.when(F.col("id") % 3 == 1, F.struct(F.col("id").cast("string").alias("number"), F.concat(F.lit('"Old" Road '), (F.col("id") % 7).cast("string")).alias("street")))
    cables = _cables(spark, sf_dir)
    serves = cables.filter("kind = 'drop'").select("scene_id", F.col("source").alias("id"), F.col("target").alias("building"))
    return sc.buildings(spark, sf_dir).withColumn("address", address), sc.streets(spark, sf_dir), sc.equipment(spark, sf_dir), serves, cables


SCENE = f"""WITH {SCENE_SQL},
nr AS (SELECT b.scene_id, b.id AS target, e.id AS source, e.x, e.y, b.x AS bx, b.y AS ey FROM bld b JOIN eq e USING (scene_id) QUALIFY row_number() OVER (PARTITION BY b.scene_id, b.id ORDER BY round({sql_haversine('b.x', 'b.y', 'e.x', 'e.y')}, 6), e.id) = 1),
cb AS (SELECT scene_id, cable_id, kind, source AS n, source, target, x, y, bx, ey FROM dist UNION ALL SELECT scene_id, 'drop-' || target, 'drop', target, source, target, x, y, bx, ey FROM nr),
sv AS (SELECT scene_id, source AS id, list_sort(list(target)) AS serves FROM nr GROUP BY ALL),
ad AS (SELECT *, CASE WHEN id % 3 = 1 THEN '"Old" Road ' || (id % 7) END AS street FROM bld),
es AS (SELECT eq.*, coalesce(serves, []) AS serves FROM eq LEFT JOIN sv USING (scene_id, id)),
sid AS (SELECT DISTINCT scene_id FROM pts)"""


def _seven(x: str) -> str:
    return f"printf('%.7f', round({x}, 7))"


def _at(x: str, y: str) -> str:
    return f"'[' || {_seven(x)} || ',' || {_seven(y)} || ']'"


def _pair(x: str, y: str) -> str:
    return f"{_seven(x)} || ' ' || {_seven(y)}"


def _ring(of, glue: str) -> str:
    return f" || '{glue}' || ".join(of(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")))


def _agg(part: str, line: str, order: str, glue: str) -> str:
    return f"(SELECT scene_id, string_agg({line}, {glue} ORDER BY {order}) AS t FROM {part} GROUP BY 1)"


_PARTS = (("ad", "id"), ("st", "street_id"), ("es", "id"), ("cb", "n"))


def _whole(lines: tuple[str, ...], glue: str, text: str) -> str:
    joins = " ".join(f"LEFT JOIN {_agg(p, line, o, glue)} p{k} ON p{k}.scene_id = sid.scene_id" for k, ((p, o), line) in enumerate(zip(_PARTS, lines)))
    return f"{SCENE} SELECT sid.scene_id, {text} AS text FROM sid {joins}"


_JSON = (
    f"""'{{"id":"' || id || '","type":"' || type || '","floors":' || floors || ',"position":' || {_at('x', 'y')} || ',"coordinates":[[' || {_ring(_at, ',')} || ']]' || coalesce(',"address":{{"number":"' || id || '","street":' || to_json(street) || '}}', '') || '}}'""",
    f"""'{{"id":"' || street_id || '","name":"' || name || '","coordinates":[' || {_at('x', 'y')} || ',' || {_at('bx', 'ey')} || ']}}'""",
    f"""'{{"type":"Feature","id":"' || id || '","geometry":{{"type":"Point","coordinates":' || {_at('x', 'y')} || '}},"properties":{{"kind":"' || kind || '","serves":[' || array_to_string(list_transform(serves, lambda v: '"' || v || '"'), ',') || ']}}}}'""",
    f"""'{{"type":"Feature","id":"' || cable_id || '","geometry":{{"type":"LineString","coordinates":[' || {_at('x', 'y')} || ',' || {_at('bx', 'ey')} || ']}},"properties":{{"kind":"' || kind || '","source":"' || source || '","target":"' || target || '"}}}}'""",
)


def _collection(k: int) -> str:
    return f"""'{{"type":"FeatureCollection","features":[' || coalesce(p{k}.t, '') || ']}}'"""


@query(_whole(_JSON, "','", f"""concat_ws(chr(10), '=== buildings.json ===', '[' || coalesce(p0.t, '') || ']', '=== streets.json ===', '[' || coalesce(p1.t, '') || ']', '=== layers/equipment.geojson ===', {_collection(2)}, '=== layers/cables.geojson ===', {_collection(3)})"""))
def representation_json(spark, sf_dir):
    """The four JSON files of a scene."""
    return form.as_json(*_scene(spark, sf_dir))


_T = "' || chr(9) || '"
_WKT = (
    f"""id || '{_T}building{_T}use=' || type || ';floors=' || floors || coalesce(';addr=' || id || ' ' || street, '') || '{_T}POLYGON((' || {_ring(_pair, ', ')} || '))'""",
    f"""street_id || '{_T}street{_T}name=' || name || '{_T}LINESTRING(' || {_pair('x', 'y')} || ', ' || {_pair('bx', 'ey')} || ')'""",
    f"""id || '{_T}equipment{_T}kind=' || kind || ';serves=[' || array_to_string(serves, ',') || ']{_T}POINT(' || {_pair('x', 'y')} || ')'""",
    f"""cable_id || '{_T}cable{_T}kind=' || kind || ';source=' || source || ';target=' || target || '{_T}LINESTRING(' || {_pair('x', 'y')} || ', ' || {_pair('bx', 'ey')} || ')'""",
)


@query(_whole(_WKT, "chr(10)", f"concat_ws(chr(10), 'id{_T}type{_T}attrs{_T}wkt', p0.t, p1.t, p2.t, p3.t)"))
def representation_wkt(spark, sf_dir):
    """A scene as one table with geometry in well-known text."""
    return form.as_wkt(*_scene(spark, sf_dir))


def _street(table: str) -> str:
    d = sql_segment("e.x", "e.y", "s.x", "s.y", "s.bx", "s.ey")
    return f"SELECT e.scene_id, e.id, CASE WHEN regexp_matches(s.name, '^Street [0-9]+$') THEN CAST(s.street_id AS VARCHAR) ELSE s.name END AS street, {d} AS d FROM {table} e JOIN st s ON s.scene_id = e.scene_id QUALIFY row_number() OVER (PARTITION BY e.scene_id, e.id ORDER BY round({d}, 6), s.street_id) = 1"


@query(f"""{SCENE}, se AS ({_street('eq')}), sb AS ({_street('bld')}), ins AS (SELECT DISTINCT eq.scene_id, eq.id FROM eq JOIN bld b ON b.scene_id = eq.scene_id WHERE {SQL_IN.format(p='eq')}),
cr AS (SELECT DISTINCT a.scene_id, a.cable_id FROM cb a JOIN bld b ON a.scene_id = b.scene_id WHERE (a.kind <> 'drop' OR b.id <> a.target) AND {_sql_meets('a', 'b')}),
cl AS (SELECT b.scene_id, b.id, e.id AS closure, {sql_haversine('b.x', 'b.y', 'e.x', 'e.y')} AS d FROM bld b JOIN eq e ON e.scene_id = b.scene_id AND e.kind = 'closure' QUALIFY row_number() OVER (PARTITION BY b.scene_id, b.id ORDER BY round({sql_haversine('b.x', 'b.y', 'e.x', 'e.y')}, 6), e.id) = 1),
le AS (SELECT es.scene_id, es.id AS o, es.id || ' (' || kind || ') on_street=' || coalesce(d <= 8, false) || ' dist_to_street=' || coalesce(printf('%.1f', round(d, 1)), 'Infinity') || 'm nearest_street="' || coalesce(street, 'none') || '" inside_building=' || (ins.id IS NOT NULL) || ' serves=[' || array_to_string(serves, ',') || ']' AS line
 FROM es LEFT JOIN se ON se.scene_id = es.scene_id AND se.id = es.id LEFT JOIN ins ON ins.scene_id = es.scene_id AND ins.id = es.id),
lc AS (SELECT cb.scene_id, n AS o, cb.cable_id || ' (' || kind || ') ' || source || '->' || target || ' crosses_foreign_building=' || (cr.cable_id IS NOT NULL) AS line FROM cb LEFT JOIN cr ON cr.scene_id = cb.scene_id AND cr.cable_id = cb.cable_id),
lb AS (SELECT b.scene_id, b.id AS o, b.id || ' type=' || type || ' nearest_closure=' || coalesce(CAST(closure AS VARCHAR), 'none') || ' nearest_street="' || coalesce(street, 'none') || '" coverage_gap=' || (NOT coalesce(cl.d <= 35, false)) AS line FROM bld b LEFT JOIN cl ON cl.scene_id = b.scene_id AND cl.id = b.id LEFT JOIN sb ON sb.scene_id = b.scene_id AND sb.id = b.id)
SELECT sid.scene_id, concat_ws(chr(10), '=== EQUIPMENT (computed spatial predicates) ===', p0.t, '=== CABLES ===', p1.t, '=== BUILDINGS ===', p2.t) AS text FROM sid {' '.join(f"LEFT JOIN {_agg(p, 'line', 'o', 'chr(10)')} p{k} ON p{k}.scene_id = sid.scene_id" for k, p in enumerate(('le', 'lc', 'lb')))}""")
def representation_verdict(spark, sf_dir):
    """What holds for every entity of a scene."""
    return form.as_verdict(*_scene(spark, sf_dir))


def _bounds(spark, sf_dir):
    return sc.points(spark, sf_dir).groupBy("scene_id").agg(*[(f(c) + s * sc.HALF).alias(f"{k}_{c}") for k, f, s in (("min", F.min, -1), ("max", F.max, 1)) for c in ("x", "y")])


def _c(x: str) -> str:
    return f"CAST(greatest(0, least(w - 1, floor(({x} - wx) / ((ex - wx) / w)))) AS INT)"


def _r(y: str) -> str:
    return f"CAST(greatest(0, least(h - 1, h - 1 - floor(({y} - sy) / ((ny - sy) / h)))) AS INT)"


def _size(i: int) -> str:
    return f"CASE {' '.join(f'WHEN n <= {s[0]} THEN {s[i]}' for s in zg.SIZES[:-1])} ELSE {zg.SIZES[-1][i]} END"


def _inside(x: str, y: str) -> str:
    return f"({x} BETWEEN wx AND ex AND {y} BETWEEN sy AND ny)"


def _lines(table: str, name: str) -> str:
    """CTEs: cells of the straight lines of a table with a zone, as `name`."""
    return f"""{name}_e AS (SELECT *, {_c('x')} AS c0, {_r('y')} AS r0, {_c('bx')} AS c1, {_r('ey')} AS r1, abs(bx - x) >= abs(ey - y) AS flat FROM {table}),
{name}_l AS (SELECT *, greatest(abs(c1 - c0), abs(r1 - r0)) AS long_, least(abs(c1 - c0), abs(r1 - r0)) AS short_ FROM {name}_e),
{name} AS (SELECT * EXCLUDE (i, side), CAST(c0 + sign(c1 - c0) * CASE WHEN abs(c1 - c0) >= abs(r1 - r0) THEN i ELSE side END AS INT) AS col, CAST(r0 + sign(r1 - r0) * CASE WHEN abs(c1 - c0) >= abs(r1 - r0) THEN side ELSE i END AS INT) AS row
 FROM (SELECT *, CASE WHEN long_ = 0 THEN 0 ELSE floor((2 * i * short_ + long_ - 1) / (2 * long_)) END AS side FROM (SELECT *, unnest(range(0, long_ + 1)) AS i FROM {name}_l)))"""


def _letters(table: str, text: str, col: str, row: str, down: str, ord_: str) -> str:
    return f"(SELECT z, CAST(col + CASE WHEN down THEN 0 ELSE i END AS INT) AS col, CAST(row + CASE WHEN down THEN i ELSE 0 END AS INT) AS row, o, substr(t, CAST(i + 1 AS BIGINT), 1) AS g FROM (SELECT z, w, h, t, o, down, col, row, unnest(range(length(t))) AS i FROM (SELECT z, w, h, {text} AS t, {col} AS col, {row} AS row, {down} AS down, {ord_} AS o FROM {table})) WHERE col + CASE WHEN down THEN 0 ELSE i END BETWEEN 0 AND w - 1 AND row + CASE WHEN down THEN i ELSE 0 END BETWEEN 0 AND h - 1)"


def _two(n: str) -> str:
    return f"CASE WHEN {n} < 10 THEN '0' || {n} ELSE CAST({n} AS VARCHAR) END"


_RULERS = lambda f: f"CASE w {' '.join(f'WHEN {w} THEN ' + repr(f(w)) for w in sorted({s[1] for s in zg.SIZES}))} END"
_LABEL = "'[' || substr(upper(trim(name)), 1, 15) || ']'"
_FREE = f"(' ', '{gt.PAVEMENT}', '{gt.ROAD_H}', '{gt.ROAD_V}', '{gt.ROAD_X}')"


@query(f"""{SCENE},
bn AS (SELECT scene_id, min(x) - {sc.HALF} AS ax, min(y) - {sc.HALF} AS ay, max(x) + {sc.HALF} AS qx, max(y) + {sc.HALF} AS qy FROM pts GROUP BY 1),
dv AS (SELECT *, greatest(1, CAST(ceil({sql_haversine('ax', 'ay', 'qx', 'ay')} / {zg.ZONE_M}) AS INT)) AS zx, greatest(1, CAST(ceil({sql_haversine('ax', 'ay', 'ax', 'qy')} / {zg.ZONE_M}) AS INT)) AS zy FROM bn),
zs AS (SELECT scene_id, c AS zc, r AS zr, ax + c * ((qx - ax) / zx) AS wx, ax + (c + 1) * ((qx - ax) / zx) AS ex, qy - (r + 1) * ((qy - ay) / zy) AS sy, qy - r * ((qy - ay) / zy) AS ny FROM (SELECT *, unnest(range(zy)) AS r FROM (SELECT *, unnest(range(zx)) AS c FROM dv))),
nb AS (SELECT zs.scene_id, zc, zr, count(*) AS n FROM zs JOIN bld b ON b.scene_id = zs.scene_id AND {_inside('b.x', 'b.y')} GROUP BY ALL),
ne AS (SELECT DISTINCT zs.scene_id, zc, zr FROM zs JOIN eq b ON b.scene_id = zs.scene_id AND {_inside('b.x', 'b.y')}),
f AS (SELECT *, {_size(1)} AS w, {_size(2)} AS h FROM (SELECT zs.*, zs.scene_id || '/' || zc || '/' || zr AS z, coalesce(nb.n, 0) AS n FROM zs LEFT JOIN nb USING (scene_id, zc, zr) LEFT JOIN ne USING (scene_id, zc, zr) WHERE nb.n IS NOT NULL OR ne.zc IS NOT NULL)),
zb AS (SELECT b.*, f.* EXCLUDE (scene_id), CAST(row_number() OVER (PARTITION BY z ORDER BY CAST(b.id AS VARCHAR)) AS BIGINT) AS k FROM bld b JOIN f ON b.scene_id = f.scene_id AND {_inside('b.x', 'b.y')}),
ze AS (SELECT b.*, f.* EXCLUDE (scene_id) FROM eq b JOIN f ON b.scene_id = f.scene_id AND {_inside('b.x', 'b.y')}),
zt AS (SELECT b.*, f.* EXCLUDE (scene_id) FROM st b JOIN f ON b.scene_id = f.scene_id AND ({_inside('b.x', 'b.y')} OR {_inside('b.bx', 'b.ey')})),
zk AS (SELECT b.* RENAME (n AS num), f.* EXCLUDE (scene_id) FROM cb b JOIN f ON b.scene_id = f.scene_id AND ({_inside('b.x', 'b.y')} OR {_inside('b.bx', 'b.ey')})),
{_lines('zt', 'rc')}, {_lines('zk', 'kc')},
road AS (SELECT z, col, row, CASE WHEN bool_or(flat) AND bool_or(NOT flat) THEN '{gt.ROAD_X}' WHEN bool_or(flat) THEN '{gt.ROAD_H}' ELSE '{gt.ROAD_V}' END AS g FROM rc GROUP BY ALL),
bo AS (SELECT z, w, h, id, k, {_c('x0')} AS ca, {_c('x1')} AS cb, {_r('y1')} AS ra, {_r('y0')} AS rb FROM zb),
bc AS (SELECT z, w, h, id, k, CAST(col AS INT) AS col, CAST(unnest(range(ra, rb)) AS INT) AS row FROM (SELECT *, unnest(range(ca, cb)) AS col FROM bo)),
bs AS (SELECT DISTINCT z, w, h, col, row FROM bc),
d2 AS (SELECT unnest(range(-2, 3)) AS d), pv AS (SELECT DISTINCT z, CAST(col + a.d AS INT) AS col, CAST(row + b.d AS INT) AS row FROM bs, d2 a, d2 b WHERE col + a.d BETWEEN 0 AND w - 1 AND row + b.d BETWEEN 0 AND h - 1),
ground AS (SELECT z, col, row, arg_min(g, o) AS g FROM (SELECT z, col, row, g, CASE WHEN g = '{gt.ROAD_X}' THEN 0 ELSE 2 END AS o FROM road UNION ALL SELECT z, col, row, '{gt.BUILDING}', 1 FROM bs UNION ALL SELECT z, col, row, '{gt.PAVEMENT}', 3 FROM pv) GROUP BY ALL),
bm AS (SELECT z, id, CAST(floor(avg(col) + 0.5) AS INT) AS cc, CAST(floor(avg(row) + 0.5) AS INT) AS cr FROM bc GROUP BY ALL),
bl AS (SELECT bc.z, any_value(w) AS w, any_value(h) AS h, any_value(k) AS k, cc, cr, count(*) FILTER (row = cr) AS m, min(col) FILTER (row = cr) AS lo, max(col) FILTER (row = cr) AS hi FROM bc JOIN bm USING (z, id) GROUP BY z, id, cc, cr),
bt AS (SELECT *, CASE WHEN m >= 3 THEN 'B' || {_two('k')} ELSE right(CAST(k AS VARCHAR), 1) END AS t FROM bl),
building AS {_letters('bt', 't', "CASE WHEN m >= 3 THEN floor((lo + hi - length(t) + 1) / 2) ELSE cc END", 'cr', 'false', 'k')},
cable AS (SELECT z, col, row, arg_min(CASE WHEN kind = 'drop' THEN '{zg.DROP}' ELSE '{zg.CABLE}' END, num) AS g FROM kc GROUP BY ALL),
tag AS {_letters("(SELECT * FROM zk WHERE kind <> 'drop')", f"'[T' || {_two('num')} || ']'", _c('(x + bx) / 2'), _r('(y + ey) / 2'), 'false', 'num')},
device AS {_letters("(SELECT *, row_number() OVER (PARTITION BY z ORDER BY CASE kind WHEN 'cabinet' THEN 2 WHEN 'co' THEN 3 ELSE 4 END, id) AS p FROM ze)", f"'[' || CASE kind WHEN 'co' THEN '★' ELSE '●' END || {_two('id')} || ']'", _c('x'), _r('y'), 'false', '-p')},
sg AS (SELECT *, round({sql_haversine('x', 'y', 'bx', 'ey')}, 6) AS m, abs(c1 - c0) >= abs(r1 - r0) AS lies FROM rc_e),
sn AS (SELECT z, w, h, name, coalesce(round(sum(m) FILTER (lies), 4), 0) AS a, coalesce(round(sum(m) FILTER (NOT lies), 4), 0) AS b, arg_max({{'c0': c0, 'r0': r0, 'c1': c1, 'r1': r1}}, (m, -street_id)) FILTER (lies) AS fa, arg_max({{'c0': c0, 'r0': r0, 'c1': c1, 'r1': r1}}, (m, -street_id)) FILTER (NOT lies) AS fb FROM sg GROUP BY z, w, h, name),
sm AS (SELECT z, w, h, name, a < b AS down, round(a + b, 3) AS total, {_LABEL} AS t, CASE WHEN a < b THEN fb ELSE fa END AS s FROM sn),
sp AS (SELECT *, CAST(floor((s.c0 + s.c1) / 2) AS INT) AS mx, CAST(floor((s.r0 + s.r1) / 2) AS INT) AS my FROM sm),
sq AS (SELECT *, CASE WHEN down THEN mx ELSE greatest(2, mx - length(t) // 2) END AS col, CASE WHEN down THEN greatest(2, my - length(t) // 2) ELSE my END AS row FROM sp),
sr AS (SELECT * FROM sq WHERE CASE WHEN down THEN row + length(t) <= h - 2 ELSE col + length(t) <= w - 2 END QUALIFY row_number() OVER (PARTITION BY z, down, CASE WHEN down THEN mx ELSE my END ORDER BY total DESC, name) = 1),
su AS (SELECT *, row_number() OVER (PARTITION BY z, down ORDER BY total DESC, name) AS k FROM sr QUALIFY k <= 3),
street AS (SELECT z, col, row, g, o + CASE WHEN g = ' ' THEN 100 ELSE 0 END AS o FROM {_letters('su', 't', 'col', 'row', 'down', 'k + CASE WHEN down THEN 3 ELSE 0 END')}),
g0 AS (SELECT z, n, w, h, c AS col, r AS row FROM (SELECT *, unnest(range(h)) AS r FROM (SELECT z, n, w, h, unnest(range(w)) AS c FROM f))),
g1 AS (SELECT g0.z, g0.row, g0.col, coalesce(ground.g, ' ') AS g, b.g AS b, cable.g AS c, t.g AS t, d.g AS d, s.g AS s FROM g0 LEFT JOIN ground USING (z, col, row) LEFT JOIN (SELECT z, col, row, arg_min(g, o) AS g FROM building GROUP BY ALL) b USING (z, col, row) LEFT JOIN cable USING (z, col, row)
 LEFT JOIN (SELECT z, col, row, arg_min(g, o) AS g FROM tag GROUP BY ALL) t USING (z, col, row) LEFT JOIN (SELECT z, col, row, arg_min(g, o) AS g FROM device GROUP BY ALL) d USING (z, col, row) LEFT JOIN (SELECT z, col, row, arg_min(g, o) AS g FROM street GROUP BY ALL) s USING (z, col, row)),
g2 AS (SELECT * REPLACE (CASE WHEN g = '{gt.BUILDING}' THEN coalesce(b, g) ELSE g END AS g) FROM g1),
g3 AS (SELECT * REPLACE (CASE WHEN c IS NULL THEN g WHEN g IN (' ', '{gt.PAVEMENT}') THEN c {' '.join(f"WHEN g = '{a}' THEN '{b}'" for a, b in zg.OVER.items())} ELSE g END AS g) FROM g2),
g4 AS (SELECT * REPLACE (CASE WHEN t IS NOT NULL AND g IN (' ', '{gt.PAVEMENT}', '{zg.DROP}', '{zg.CABLE}') THEN t ELSE g END AS g) FROM g3),
g5 AS (SELECT * REPLACE (coalesce(d, g) AS g) FROM g4), g6 AS (SELECT * REPLACE (CASE WHEN s IS NOT NULL AND g IN {_FREE} THEN s ELSE g END AS g) FROM g5),
ln AS (SELECT z, row, ' ' || chr(CAST(65 + row % 26 AS INT)) || ' │' || string_agg(g, '' ORDER BY col) || '│' AS line FROM g6 GROUP BY z, row), bd AS (SELECT z, string_agg(line, chr(10) ORDER BY row) AS body FROM ln GROUP BY 1)
SELECT scene_id, chr(CAST(65 + zr AS INT)) || (zc + 1) AS zone, n AS buildings, CAST(w AS INT) AS w, CAST(h AS INT) AS h, concat_ws(chr(10), 'ZONE ' || chr(CAST(65 + zr AS INT)) || (zc + 1) || ' (200m × 200m)', '    ' || {_RULERS(lambda w: ''.join(str(i).ljust(10) for i in range(w // 10)))}, '    ' || {_RULERS(lambda w: ''.join(str(i % 10) for i in range(w)))}, '   ┌' || repeat('─', w) || '┐', body, '   └' || repeat('─', w) || '┘') AS text FROM f JOIN bd USING (z)""")
def representation_zone_grids(spark, sf_dir):
    """The labelled text grid of every zone of a scene that holds something."""
    cables = _cables(spark, sf_dir)
    return zg.zone_grids(_bounds(spark, sf_dir), sc.streets(spark, sf_dir), sc.buildings(spark, sf_dir), sc.equipment(spark, sf_dir), cables)
