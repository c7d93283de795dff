"""Zones and indexes of scenes kept up to date from changes, their figures and issues; seeded tiles clear of evaluation windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import tiles as ti
from terrane.operators import zones as zn
from terrane.operators.graph import settled
from terrane.plans.views import named_streets
from terrane.sources import scenes as sc
from terrane.sources.scenes import SCENE_SQL, sql_haversine, sql_segment

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NEW = 10_000_000  # ids of added houses start here


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def nodes(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("id") % 50 == 0, "co").when(F.col("id") % 5 == 0, "closure").otherwise("house")
    return sc.points(spark, sf_dir).select("scene_id", "id", kind.alias("kind"), "x", "y")


def drops(spark, sf_dir) -> DataFrame:
    """A drop to each house from the last closure or office before it in its scene."""
    w = Window.partitionBy("scene_id").orderBy("id")
    before = F.max(F.when(F.col("id") % 5 == 0, F.col("id"))).over(w)
    d = sc.points(spark, sf_dir).withColumn("source", before).filter("id % 5 <> 0 AND source IS NOT NULL")
    return d.select("scene_id", F.concat(F.lit("drop-"), F.col("id").cast("string")).alias("cable_id"), F.lit("drop").alias("kind"), "source", F.col("id").alias("target"))


def change(spark, sf_dir) -> zn.Change:
    """Scenes with changes: some nodes move, some houses and closures go, some houses are new, some drops go to another closure."""
    n, d = nodes(spark, sf_dir), drops(spark, sf_dir)
    cables = d.unionByName(sc.distribution(spark, sf_dir).select("scene_id", "cable_id", "kind", "source", "target"))
    moved = n.filter("id % 11 = 3").select("scene_id", "id", "kind", (F.col("x") + 0.0031).alias("x"), (F.col("y") - 0.0017).alias("y"), F.lit("put").alias("op"), F.lit(1).alias("seq"))
    gone = n.filter("id % 13 = 5 AND kind <> 'co'").select("scene_id", "id", "kind", "x", "y", F.lit("drop").alias("op"), F.lit(2).alias("seq"))
    fresh = n.filter("id % 19 = 4").select("scene_id", (F.col("id") + NEW).alias("id"), F.lit("house").alias("kind"), (F.col("x") - 0.0008).alias("x"), (F.col("y") + 0.0023).alias("y"), F.lit("put").alias("op"), F.lit(3).alias("seq"))
    put = lambda rows, seq: rows.select("scene_id", "cable_id", F.lit("drop").alias("kind"), "source", "target", F.lit("put").alias("op"), F.lit(seq).alias("seq"))
    added = d.filter("target % 19 = 4").select("scene_id", F.concat("cable_id", F.lit("-new")).alias("cable_id"), "source", (F.col("target") + NEW).alias("target"))
    lowest = n.filter("kind = 'closure'").groupBy("scene_id").agg(F.min("id").alias("least"))
    turned = d.filter("target % 17 = 2").join(lowest, "scene_id").select("scene_id", "cable_id", F.col("least").alias("source"), "target")
    return zn.Change(n, cables, moved.unionByName(gone).unionByName(fresh), put(added, 1).unionByName(put(turned, 2)))


def stored_zones(spark, sf_dir) -> tuple[zn.Change, DataFrame]:
    """The changes, and the zones before them as a written table."""
    c = change(spark, sf_dir)
    c = zn.Change(settled(c.nodes), settled(c.cables), settled(c.node_changes), settled(c.cable_changes))
    at = zn.placed(c.nodes)
    return c, settled(zn.summaries(at, zn.spans(c.cables, at, at)))


#: The tables after the changes, put together from the beginning.
AFTER = f"""WITH {SCENE_SQL}, n0 AS (SELECT scene_id, id, CASE WHEN id % 50 = 0 THEN 'co' WHEN id % 5 = 0 THEN 'closure' ELSE 'house' END AS kind, x, y FROM pts),
d0 AS (SELECT scene_id, 'drop-' || id AS cable_id, 'drop' AS kind, s AS source, id AS target FROM (SELECT *, max(CASE WHEN id % 5 = 0 THEN id END) OVER (PARTITION BY scene_id ORDER BY id) AS s FROM pts) WHERE id % 5 <> 0 AND s IS NOT NULL),
n1 AS (SELECT scene_id, id, kind, CASE WHEN id % 11 = 3 THEN x + 0.0031 ELSE x END AS x, CASE WHEN id % 11 = 3 THEN y - 0.0017 ELSE y END AS y FROM n0 WHERE id % 13 <> 5 OR kind = 'co'
 UNION ALL SELECT scene_id, id + {NEW}, 'house', x - 0.0008, y + 0.0023 FROM n0 WHERE id % 19 = 4),
low AS (SELECT scene_id, min(id) AS least FROM n0 WHERE kind = 'closure' GROUP BY 1),
c1 AS (SELECT d0.scene_id, cable_id, kind, CASE WHEN target % 17 = 2 AND least IS NOT NULL THEN least ELSE source END AS source, target FROM d0 LEFT JOIN low ON low.scene_id = d0.scene_id
 UNION ALL SELECT scene_id, cable_id || '-new', kind, source, target + {NEW} FROM d0 WHERE target % 19 = 4
 UNION ALL SELECT scene_id, cable_id, kind, source, target FROM dist),
p1 AS (SELECT *, CAST(floor(x / {zn.TILE}) AS BIGINT) AS zc, CAST(floor(y / {zn.TILE}) AS BIGINT) AS zr FROM n1),
s1 AS (SELECT c.*, a.zc, a.zr, b.zc AS tc, b.zr AS tr, {sql_haversine('a.x', 'a.y', 'b.x', 'b.y')} AS metres FROM c1 c JOIN p1 a ON a.scene_id = c.scene_id AND a.id = c.source JOIN p1 b ON b.scene_id = c.scene_id AND b.id = c.target),
s2 AS (SELECT *, CASE WHEN kind = 'drop' THEN floor((metres / 1000 * 0.35 + 10.8 + 0.5 + 0.1) * 100 + 0.5) / 100 END AS db FROM s1),
z1 AS (SELECT k.*, coalesce(cables, 0) AS cables, coalesce(metres, 0) AS metres, coalesce(links, 0) AS links, coalesce(errors, 0) AS errors, coalesce(max_db, 0) AS max_db
 FROM (SELECT scene_id, zc, zr, count(*) AS nodes, count(*) FILTER (kind = 'house') AS houses, count(*) FILTER (kind <> 'house') AS devices FROM p1 GROUP BY ALL) k
 LEFT JOIN (SELECT scene_id, zc, zr, count(*) AS cables, round(sum(metres), 3) AS metres, count(*) FILTER (zc <> tc OR zr <> tr) AS links, count(*) FILTER (metres > CASE kind WHEN 'drop' THEN 100 ELSE 500 END) AS errors, max(db) AS max_db FROM s2 GROUP BY ALL) USING (scene_id, zc, zr))"""


@query(f"{AFTER} SELECT * FROM z1")
def zone_update(spark, sf_dir):
    """Figures of all zones after changes: touched zones computed again, the others kept."""
    c, built = stored_zones(spark, sf_dir)
    return zn.update_zones(built, c)


@query(f"""{AFTER}, b AS (SELECT scene_id, (max(zc) - min(zc) + 1) * (max(zr) - min(zr) + 1) AS zones, count(*) AS n, CAST(sum(nodes) AS BIGINT) AS nodes, CAST(sum(cables) AS BIGINT) AS cables, CAST(sum(houses) AS BIGINT) AS houses,
round(sum(metres), 2) AS metres, max(max_db) AS max_db FROM z1 GROUP BY 1) SELECT scene_id, zones, nodes, cables, houses, metres, max_db, round(100.0 * n / zones, 6) AS coverage FROM b""")
def area_update(spark, sf_dir):
    """Figures of scenes after changes, from the updated zones."""
    c, built = stored_zones(spark, sf_dir)
    return zn.area(zn.update_zones(built, c))


@query(f"""{AFTER}, l AS (SELECT DISTINCT scene_id, zc, zr, tc, tr FROM s2 UNION SELECT scene_id, tc, tr, zc, zr FROM s2),
nb AS (SELECT a.scene_id, 'Z' || a.zc || '_' || a.zr AS one, 'Z' || b.zc || '_' || b.zr AS two, CASE WHEN b.zr > a.zr THEN 'north' WHEN b.zr < a.zr THEN 'south' WHEN b.zc > a.zc THEN 'east' ELSE 'west' END AS direction
 FROM z1 a JOIN z1 b ON a.scene_id = b.scene_id AND abs(a.zc - b.zc) + abs(a.zr - b.zr) = 1 WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.scene_id = a.scene_id AND l.zc = a.zc AND l.zr = a.zr AND l.tc = b.zc AND l.tr = b.zr))
SELECT scene_id, 'missing-link-' || least(one, two) || '-' || greatest(one, two) AS issue_id, 'warning' AS severity, 'missing_cross_zone_link' AS type, 'No fiber connection between zones ' || one || ' and ' || two || ' (' || direction || ')' AS description FROM nb
UNION ALL SELECT scene_id, 'zone-errors-Z' || zc || '_' || zr, 'error', 'zone_has_errors', 'Zone Z' || zc || '_' || zr || ' has ' || errors || ' validation error' || CASE WHEN errors <> 1 THEN 's' ELSE '' END FROM z1 WHERE errors > 0
UNION ALL SELECT scene_id, 'high-optical-loss-zones', 'warning', 'high_optical_loss', count(*) || ' zone' || CASE WHEN count(*) <> 1 THEN 's' ELSE '' END || ' with optical loss > 25dB (approaching 28dB limit)' FROM z1 WHERE max_db > 25 GROUP BY 1""")
def area_issues(spark, sf_dir):
    """Issues of scenes after changes: neighbouring zones without a cable, zones with errors, zones of high loss."""
    c, built = stored_zones(spark, sf_dir)
    at = zn.placed(c.nodes_after)
    return zn.area_issues(settled(zn.update_zones(built, c)), settled(zn.links(zn.spans(c.cables_after, at, at))))


LOOKUP = f"""{AFTER}, sn AS (SELECT e.scene_id, e.id, s.name, min({sql_segment('e.x', 'e.y', 's.x', 's.y', 's.bx', 's.ey')}) AS d FROM p1 e JOIN st s ON s.scene_id = e.scene_id WHERE NOT regexp_matches(s.name, '^Street [0-9]+$') GROUP BY ALL),
lb AS (SELECT scene_id, id, arg_min(name, (round(d, 6), name)) AS street FROM sn GROUP BY ALL), dr AS (SELECT scene_id, target AS id, arg_min(source, cable_id) AS closure, arg_min(db, cable_id) AS db FROM s2 WHERE kind = 'drop' GROUP BY ALL),
en AS (SELECT p.scene_id, p.id, p.kind, 'Z' || zc || '_' || zr AS zone, street, lower(coalesce(street, 'unnamed')) || ' ' || (p.id % 100) AS address, closure, db FROM p1 p LEFT JOIN lb ON lb.scene_id = p.scene_id AND lb.id = p.id LEFT JOIN dr ON dr.scene_id = p.scene_id AND dr.id = p.id),
hk AS (SELECT scene_id, unnest([address, CAST(id AS VARCHAR)]) AS key, id, zone, closure, db FROM en WHERE kind = 'house')"""


@query(f"""{LOOKUP} SELECT scene_id, 'by_address' AS index, key, max(id) AS id, arg_max(zone, id) AS zone, CAST(arg_max(CAST(coalesce(closure, -1) AS BIGINT), id) AS BIGINT) AS closure, arg_max(coalesce(db, -1), id) AS db, CAST(NULL AS BIGINT) AS houses, CAST(NULL AS BIGINT) AS closures, CAST(NULL AS BIGINT) AS offices FROM hk GROUP BY ALL
UNION ALL SELECT scene_id, 'by_element', CAST(id AS VARCHAR), id, zone, -1, -1, NULL, NULL, NULL FROM en
UNION ALL SELECT scene_id, 'by_street', lower(street), NULL, NULL, -1, -1, count(*) FILTER (kind = 'house'), count(*) FILTER (kind = 'closure'), count(*) FILTER (kind = 'co') FROM en WHERE street IS NOT NULL GROUP BY 1, 3""")
def index_update(spark, sf_dir):
    """The three indexes of scenes after changes: entries of changed nodes and what hangs on them, and the keys these stand under, are
    built again, the others kept. A closure or loss that is not known is -1."""
    c = change(spark, sf_dir)
    c = zn.Change(settled(c.nodes), settled(c.cables), settled(c.node_changes), settled(c.cable_changes))
    streets = settled(sc.streets(spark, sf_dir))
    at = zn.placed(c.nodes)
    before = settled(zn.entries(at, zn.spans(c.cables, at, at), named_streets(at, streets)))
    _, index = zn.update_index(before, settled(zn.lookup_rows(before)), c, lambda own: named_streets(own, streets))
    return index.fillna(-1, ["closure", "db"])


TILE_SQL = f"""WITH RECURSIVE j(i, m, a) AS (SELECT 0, 1::HUGEINT, 0::HUGEINT UNION ALL SELECT i + 1, (m * 1103515245) % 4294967296, (a * 1103515245 + 12345) % 4294967296 FROM j WHERE i < 1000),
sd AS (SELECT seed, CASE WHEN h = 0 THEN 1 ELSE h END AS s FROM (SELECT c_custkey AS seed, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split('tile|' || c_custkey, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM customer)),
ins AS (SELECT 350 / 2.0 / (111320 * cos(radians((40.732 + 40.778) / 2.0))) + 0.001 AS ix, 350 / 2.0 / 110540 + 0.001 AS iy),
u AS (SELECT seed, p.i // 2 AS attempt, -74.011 + ix + CAST((p.m * s + p.a) % 4294967296 AS DOUBLE) / 4294967296 * (-73.957 + 74.011 - 2 * ix) AS lng, 40.732 + iy + CAST((q.m * s + q.a) % 4294967296 AS DOUBLE) / 4294967296 * (40.778 - 40.732 - 2 * iy) AS lat
 FROM sd, ins, j p JOIN j q ON q.i = p.i + 1 WHERE p.i % 2 = 1 AND p.i < 1000),
t AS (SELECT seed, attempt, lng - 350 / 2.0 / (111320 * cos(radians(lat))) AS x0, lat - 350 / 2.0 / 110540 AS y0, lng + 350 / 2.0 / (111320 * cos(radians(lat))) AS x1, lat + 350 / 2.0 / 110540 AS y1 FROM u),
c AS (SELECT -73.984 + ((r * 73 % 100) / 100.0 - 0.5) * 0.02 AS lng, 40.7549 + ((r * 91 % 100) / 100.0 - 0.5) * 0.02 AS lat FROM (SELECT unnest(range(100)) AS r)),
b AS (SELECT lng - 550 / 2.0 / (111320 * cos(radians(lat))) AS x0, lat - 550 / 2.0 / 110540 AS y0, lng + 550 / 2.0 / (111320 * cos(radians(lat))) AS x1, lat + 550 / 2.0 / 110540 AS y1 FROM c),
f AS (SELECT seed, min(attempt) AS attempt FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE t.x0 < b.x1 AND t.x1 > b.x0 AND t.y0 < b.y1 AND t.y1 > b.y0) GROUP BY 1)
SELECT sd.seed, CAST(f.attempt AS INT) AS attempt, round(x0, 9) AS x0, round(y0, 9) AS y0, round(x1, 9) AS x1, round(y1, 9) AS y1 FROM sd LEFT JOIN f ON f.seed = sd.seed LEFT JOIN t ON t.seed = f.seed AND t.attempt = f.attempt"""


@query(TILE_SQL)
def train_tiles(spark, sf_dir):
    """A tile of each customer's number as a seed, clear of all evaluation windows."""
    seeds = sc.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seed"))
    t = ti.tiles(seeds, ti.evaluation_boxes(spark))
    return t.select("seed", "attempt", *[F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")])
