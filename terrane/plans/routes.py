"""Routing graphs of the supplied scenes: merged nodes, service areas, edges, corner arcs, bridges and forced bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import gridroute as gro
from terrane.operators import procedural as pr
from terrane.operators import routing as rt
from terrane.operators import spatial as sp
from terrane.operators import streetgraph as sg
from terrane.plans.procedural import HULL_SQL
from terrane.sources import scenes as sc
from terrane.sources.scenes import sql_blocked, sql_haversine, sql_segment

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
INFRA_ORD = 1 << 52  # after all samples of streets
REACH_M = 100.0  # of a building or an office from its node
CORNER_M = 60.0  # street ends of a scene that are taken for one corner


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def infrastructure(spark, sf_dir) -> DataFrame:
    """The equipment of scenes as handholes and poles."""
    kind = F.when(F.col("id") % 10 == 0, "handhole").otherwise("pole")
    return sc.equipment(spark, sf_dir).select("scene_id", (F.col("id") + INFRA_ORD).alias("ord"), kind.alias("kind"), "x", "y")


def service_areas(spark, sf_dir) -> DataFrame:
    """(scene_id, ring): the hull of the buildings of each scene, counter-clockwise, not closed."""
    b = sc.buildings(spark, sf_dir).select("scene_id", "id", "x", "y")
    corners = pr.convex_hull(sp.spread(b, "scene_id")).join(b.hint("merge"), ["scene_id", "id"]).groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("place", "x", "y"))).alias("c"))
    return corners.select("scene_id", F.transform("c", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("ring"))


class SceneGraph:
    """The steps of the graph of all supplied scenes; each is worked out when it is first asked for."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.streets, self.buildings = sc.streets(spark, sf_dir), sc.buildings(spark, sf_dir)
        self.samples = sg.gr.settled(sg.sampled(self.streets))
        none = lambda t: F.lit(None).cast(t)
        own = self.samples.select("scene_id", "ord", "x", "y", F.lit("street").alias("kind"), "side", "name", "street_id")
        self.raw = own.unionByName(infrastructure(spark, sf_dir).select("scene_id", "ord", "x", "y", "kind", none("string").alias("side"), none("string").alias("name"), none("long").alias("street_id")))
        self.into = sg.gr.settled(sg.absorbed(self.raw))
        self.nodes = sg.gr.settled(sg.clipped(sg.merged(self.raw, self.into), service_areas(spark, sf_dir)))

    def edges(self) -> DataFrame:
        return sg.street_edges(self.samples, self.into, self.nodes, self.buildings)

    def bridged(self) -> tuple[DataFrame, DataFrame]:
        """Edges along streets, and the bridges between their components."""
        edges = sg.gr.settled(self.edges())
        return edges, sg.gr.settled(sg.bridges(self.nodes, sg.component_of(self.nodes, edges), self.buildings))


def sql_bearing(ax: str, ay: str, bx: str, by: str) -> str:
    return f"degrees(atan2(sin(radians({bx} - {ax})) * cos(radians({by})), cos(radians({ay})) * sin(radians({by})) - sin(radians({ay})) * cos(radians({by})) * cos(radians({bx} - {ax}))))"


def sql_destination(x: str, y: str, metres: str, degrees: str) -> tuple[str, str]:
    d, t = f"({metres} / 6371000.0)", f"radians({degrees})"
    lat = f"asin(sin(radians({y})) * cos({d}) + cos(radians({y})) * sin({d}) * cos({t}))"
    return f"({x} + degrees(atan2(sin({t}) * sin({d}) * cos(radians({y})), cos({d}) - sin(radians({y})) * sin({lat}))))", f"degrees({lat})"


_MX, _MY = "(x + (bx - x) * share)", "(y + (ey - y) * share)"
_AT = sql_destination(_MX, _MY, str(sg.SIDE_M), "(dir + CASE WHEN lft = 1 THEN -90 ELSE 90 END)")
_INFRA = "('pole', 'handhole', 'conduit_access')"

#: Nodes by the sequential rule: one after the other, by order, taken by the first seed in reach.
NODES_SQL = f"""WITH RECURSIVE {HULL_SQL.removeprefix('WITH ')},
sl AS (SELECT *, {sql_haversine('x', 'y', 'bx', 'ey')} AS m, {sql_bearing('x', 'y', 'bx', 'ey')} AS dir FROM st),
sk AS (SELECT *, greatest(CAST(ceil(m / {sg.STEP_M}) AS BIGINT) - 1, 0) + 1 AS last FROM sl),
sm AS (SELECT *, CASE WHEN k = last THEN 1.0 ELSE k * {sg.STEP_M} / m END AS share FROM (SELECT *, unnest(range(0, last + 1)) AS k FROM sk), (SELECT unnest([0, 1]) AS lft)),
smp AS (SELECT scene_id, street_id * 2097152 + lft * 1048576 + k AS ord, street_id, name, CASE WHEN lft = 1 THEN 'left' ELSE 'right' END AS side, k, k = last AS last, {_AT[0]} AS x, {_AT[1]} AS y FROM sm),
raw AS (SELECT scene_id, ord, x, y, 'street' AS kind, side, name, street_id FROM smp
        UNION ALL SELECT scene_id, id + {INFRA_ORD}, x, y, CASE WHEN id % 10 = 0 THEN 'handhole' ELSE 'pole' END, NULL, NULL, NULL FROM eq),
num AS (SELECT *, coalesce(side, '-') AS sd, row_number() OVER (PARTITION BY scene_id, side ORDER BY ord) AS n FROM raw),
g AS (SELECT scene_id, sd, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS into_, CAST([] AS STRUCT(o BIGINT, x DOUBLE, y DOUBLE)[]) AS seeds FROM (SELECT DISTINCT scene_id, sd FROM num)
      UNION ALL SELECT scene_id, sd, n, ord, coalesce(hit, ord), CASE WHEN hit IS NULL THEN list_append(seeds, {{'o': ord, 'x': x, 'y': y}}) ELSE seeds END
      FROM (SELECT num.*, g.seeds, list_filter(g.seeds, lambda s: {sql_haversine('s.x', 's.y', 'num.x', 'num.y')} <= {sg.MERGE_M})[1].o AS hit FROM g JOIN num ON num.scene_id = g.scene_id AND num.sd = g.sd AND num.n = g.n + 1)),
into_ AS (SELECT scene_id, ord, into_ AS seed FROM g WHERE n > 0),
called AS (SELECT scene_id, seed, string_agg(name, ' / ' ORDER BY o) AS name FROM (SELECT scene_id, seed, name, min(ord) AS o FROM raw JOIN into_ USING (scene_id, ord) WHERE name IS NOT NULL GROUP BY ALL) GROUP BY ALL),
whole AS (SELECT scene_id, seed AS ord, coalesce(arg_min(x, ord) FILTER (kind IN {_INFRA}), avg(x)) AS x, coalesce(arg_min(y, ord) FILTER (kind IN {_INFRA}), avg(y)) AS y,
          CASE WHEN count(DISTINCT street_id) > 1 THEN 'intersection' ELSE coalesce(arg_max(kind, ord) FILTER (kind IN {_INFRA}), 'street') END AS kind,
          any_value(side) AS side, coalesce(any_value(called.name), '') AS name, count(DISTINCT street_id) AS n_streets, count(*) AS members
          FROM raw JOIN into_ USING (scene_id, ord) LEFT JOIN called USING (scene_id, seed) GROUP BY scene_id, seed),
node AS (SELECT w.* FROM whole w JOIN (SELECT w.scene_id, w.ord FROM whole w JOIN e ON e.scene_id = w.scene_id GROUP BY ALL
         HAVING bool_and((e.bx - e.x) * (w.y - e.y) - (e.ey - e.y) * (w.x - e.x) >= 0) OR min({sql_segment('w.x', 'w.y', 'e.x', 'e.y', 'e.bx', 'e.ey')}) <= {sg.BUFFER_M}) USING (scene_id, ord))"""

EDGES_SQL = f"""{NODES_SQL},
si AS (SELECT smp.*, seed FROM smp JOIN into_ USING (scene_id, ord)),
pair AS (SELECT DISTINCT scene_id, least(a, b) AS source, greatest(a, b) AS target, kind FROM (
         SELECT p.scene_id, p.seed AS a, q.seed AS b, 'sidewalk' AS kind FROM si p JOIN si q ON q.scene_id = p.scene_id AND q.street_id = p.street_id AND q.side = p.side AND q.k = p.k + 1
         UNION ALL SELECT p.scene_id, p.seed, q.seed, 'road_crossing' FROM si p JOIN si q ON q.scene_id = p.scene_id AND q.street_id = p.street_id AND p.side = 'left' AND q.side = 'right' AND q.k = p.k AND (p.k = 0 OR p.last)) WHERE a <> b),
laid AS (SELECT pair.*, p.x, p.y, q.x AS bx, q.y AS ey, {sql_haversine('p.x', 'p.y', 'q.x', 'q.y')} AS metres FROM pair
         JOIN node p ON p.scene_id = pair.scene_id AND p.ord = source JOIN node q ON q.scene_id = pair.scene_id AND q.ord = target),
edge AS (SELECT scene_id, source, target, kind, metres FROM laid l WHERE NOT EXISTS (SELECT 1 FROM bld b WHERE b.scene_id = l.scene_id AND {sql_blocked('l.x', 'l.y', 'l.bx', 'l.ey')}))"""


def _sql_components(edges: str, name: str) -> str:
    """CTEs that give `name` (scene_id, ord, comp, x, y) from edges."""
    return f"""{name}_b AS (SELECT scene_id, source AS a, target AS b FROM {edges} UNION SELECT scene_id, target, source FROM {edges}),
{name}_r AS (SELECT scene_id, ord AS a, ord AS b FROM node UNION SELECT r.scene_id, r.a, e.b FROM {name}_r r JOIN {name}_b e ON e.scene_id = r.scene_id AND e.a = r.b),
{name} AS (SELECT n.scene_id, n.ord, n.x, n.y, comp FROM node n JOIN (SELECT scene_id, a AS ord, min(b) AS comp FROM {name}_r GROUP BY ALL) USING (scene_id, ord))"""


BRIDGES_SQL = f"""{EDGES_SQL}, {_sql_components('edge', 'c1')},
near AS (SELECT p.scene_id, p.comp AS ca, q.comp AS cb, p.ord AS source, q.ord AS target, p.x, p.y, q.x AS bx, q.y AS ey, {sql_haversine('p.x', 'p.y', 'q.x', 'q.y')} AS metres
         FROM c1 p JOIN c1 q ON q.scene_id = p.scene_id AND p.comp < q.comp WHERE {sql_haversine('p.x', 'p.y', 'q.x', 'q.y')} <= {sg.BRIDGE_M}),
bridge AS (SELECT scene_id, source, target, 'road_crossing' AS kind, metres FROM near l WHERE NOT EXISTS (SELECT 1 FROM bld b WHERE b.scene_id = l.scene_id AND {sql_blocked('l.x', 'l.y', 'l.bx', 'l.ey')})
           QUALIFY row_number() OVER (PARTITION BY scene_id, ca, cb ORDER BY round(metres, 6), source, target) = 1)"""

FORCED_SQL = f"""{BRIDGES_SQL}, joined AS (SELECT * FROM edge UNION ALL SELECT * FROM bridge), {_sql_components('joined', 'c2')},
far AS (SELECT p.scene_id, q.comp AS cb, p.ord AS source, q.ord AS target, {sql_haversine('p.x', 'p.y', 'q.x', 'q.y')} AS metres,
        EXISTS (SELECT 1 FROM bld b WHERE b.scene_id = p.scene_id AND {sql_blocked('p.x', 'p.y', 'q.x', 'q.y')}) AS crosses
        FROM c2 p JOIN c2 q ON q.scene_id = p.scene_id AND q.comp <> p.comp WHERE p.comp = (SELECT min(o.ord) FROM node o WHERE o.scene_id = p.scene_id)),
forced AS (SELECT scene_id, source, target, 'road_crossing' AS kind, metres, crosses FROM far QUALIFY row_number() OVER (PARTITION BY scene_id, cb ORDER BY crosses, round(metres, 6), source, target) = 1)"""


@query(f"{NODES_SQL} SELECT scene_id, ord, round(x, 7) AS x, round(y, 7) AS y, kind, side, name, n_streets, members FROM node")
def graph_nodes(spark, sf_dir):
    """Nodes on both sides of all streets and at equipment, merged by side in order, within reach of the service area."""
    n = SceneGraph(spark, sf_dir).nodes
    return n.select("scene_id", "ord", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"), "kind", "side", "name", F.size("streets").cast("long").alias("n_streets"), "members")


@query(f"{EDGES_SQL} SELECT scene_id, source, target, kind, round(metres, 4) AS metres FROM edge")
def graph_edges(spark, sf_dir):
    """Edges along and across streets that no building blocks."""
    return SceneGraph(spark, sf_dir).edges().withColumn("metres", F.round("metres", 4))


@query(f"{BRIDGES_SQL} SELECT scene_id, source, target, kind, round(metres, 4) AS metres FROM bridge")
def graph_bridges(spark, sf_dir):
    """The nearest free pair of nodes of every two components of a scene, up to 100 m."""
    return SceneGraph(spark, sf_dir).bridged()[1].withColumn("metres", F.round("metres", 4))


@query(f"{FORCED_SQL} SELECT scene_id, source, target, kind, round(metres, 4) AS metres, crosses FROM forced")
def graph_forced_bridges(spark, sf_dir):
    """Edges that join what the bridges leave apart to the first component of a scene."""
    g = SceneGraph(spark, sf_dir)
    edges, more = g.bridged()
    both = sg.gr.settled(edges.unionByName(more))
    return sg.forced_bridges(g.nodes, sg.component_of(g.nodes, both), g.buildings).withColumn("metres", F.round("metres", 4))


@query(f"""{FORCED_SQL}, whole_ AS (SELECT * FROM joined UNION ALL SELECT scene_id, source, target, kind, metres FROM forced), {_sql_components('whole_', 'c3')}
SELECT scene_id, (SELECT count(DISTINCT comp) FROM c1 WHERE c1.scene_id = n.scene_id) AS apart, (SELECT count(DISTINCT comp) FROM c2 WHERE c2.scene_id = n.scene_id) AS bridged,
 (SELECT count(DISTINCT comp) FROM c3 WHERE c3.scene_id = n.scene_id) AS forced FROM (SELECT DISTINCT scene_id FROM node) n""")
def graph_connectivity(spark, sf_dir):
    """Components of each scene's graph: of streets alone, with bridges, with forced bridges (one)."""
    g = SceneGraph(spark, sf_dir)
    edges, more = g.bridged()
    joined = sg.gr.settled(edges.unionByName(more))
    member = sg.gr.settled(sg.component_of(g.nodes, joined))
    whole = joined.unionByName(sg.forced_bridges(g.nodes, member, g.buildings).drop("crosses"))
    count = lambda df, name: df.groupBy("scene_id").agg(F.count_distinct("component").alias(name))
    return count(sg.component_of(g.nodes, edges), "apart").join(count(member, "bridged"), "scene_id").join(count(sg.component_of(g.nodes, sg.gr.settled(whole)), "forced"), "scene_id")


_LAT0 = "(SELECT min_by_y FROM first_ f WHERE f.scene_id = i.scene_id)"


@query(f"""{HULL_SQL}, first_ AS (SELECT scene_id, arg_min(y, (x, y)) AS min_by_y FROM e GROUP BY 1),
i AS (SELECT p.scene_id, p.bx AS x, p.ey AS y, p.x AS ax, p.y AS ay, q.bx AS cx, q.ey AS cy FROM e p JOIN e q ON q.scene_id = p.scene_id AND q.a = p.b),
f AS (SELECT *, 111320.0 * cos(radians({_LAT0})) AS east FROM i),
a AS (SELECT *, atan2((y - ay) * 110540.0, (x - ax) * east) - pi() / 2 AS first, atan2((cy - y) * 110540.0, (cx - x) * east) - pi() / 2 AS last FROM f),
w AS (SELECT *, (last - first) - 2 * pi() * floor((last - first) / (2 * pi())) AS sweep FROM a),
s AS (SELECT *, greatest(1, CAST(ceil(sweep / (pi() / 8) - 1e-9) AS INT)) AS steps FROM w),
k AS (SELECT *, unnest(range(0, steps + 1)) AS k FROM s)
SELECT scene_id, count(*) AS points, round(sum(x + {sg.BUFFER_M} * cos(first + sweep * k / steps) / east), 5) AS sum_x, round(sum(y + {sg.BUFFER_M} * sin(first + sweep * k / steps) / 110540.0), 5) AS sum_y FROM k GROUP BY 1""")
def service_area_outline(spark, sf_dir):
    """The outline 50 m around each scene's buildings: its points, and the sums of their coordinates."""
    p = service_areas(spark, sf_dir).select("scene_id", F.explode(sg.offset_ring(F.col("ring"))).alias("p"))
    return p.groupBy("scene_id").agg(F.count("*").alias("points"), F.round(F.sum("p.x"), 5).alias("sum_x"), F.round(F.sum("p.y"), 5).alias("sum_y"))


_CORNER = sql_destination("x", "y", str(sg.SIDE_M + sg.ARC_M), "(dir + 90 + j / 3.0 * CASE WHEN ndir - 90 < dir + 90 THEN ndir - 90 + 360 - dir - 90 ELSE ndir - dir - 180 END)")


@query(f"""WITH RECURSIVE {HULL_SQL.removeprefix('WITH ')},
ends AS (SELECT scene_id, street_id * 2 AS ord, street_id, x, y FROM st UNION ALL SELECT scene_id, street_id * 2 + 1, street_id, bx, ey FROM st),
num AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY ord) AS n FROM ends),
g AS (SELECT scene_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS seed, CAST([] AS STRUCT(o BIGINT, x DOUBLE, y DOUBLE)[]) AS seeds FROM (SELECT DISTINCT scene_id FROM num)
      UNION ALL SELECT scene_id, n, ord, coalesce(hit, ord), CASE WHEN hit IS NULL THEN list_append(seeds, {{'o': ord, 'x': x, 'y': y}}) ELSE seeds END
      FROM (SELECT num.*, g.seeds, list_filter(g.seeds, lambda s: {sql_haversine('s.x', 's.y', 'num.x', 'num.y')} <= {CORNER_M})[1].o AS hit FROM g JOIN num ON num.scene_id = g.scene_id AND num.n = g.n + 1)),
c AS (SELECT scene_id, seed AS ord, avg(x) AS x, avg(y) AS y, list_distinct(list(street_id)) AS streets FROM ends JOIN g USING (scene_id, ord) GROUP BY ALL),
m AS (SELECT c.scene_id, ord, c.x, c.y, st.street_id, CASE WHEN {sql_haversine('c.x', 'c.y', 'st.x', 'st.y')} < {sql_haversine('c.x', 'c.y', 'st.bx', 'st.ey')} THEN {sql_bearing('st.x', 'st.y', 'st.bx', 'st.ey')} ELSE {sql_bearing('st.bx', 'st.ey', 'st.x', 'st.y')} END AS dir
      FROM (SELECT scene_id, ord, x, y, unnest(streets) AS street_id FROM c WHERE len(streets) > 1) c JOIN st ON st.scene_id = c.scene_id AND st.street_id = c.street_id),
t AS (SELECT *, coalesce(lead(street_id) OVER w, first_value(street_id) OVER w) AS next_id, coalesce(lead(dir) OVER w, first_value(dir) OVER w) AS ndir FROM m WINDOW w AS (PARTITION BY scene_id, ord ORDER BY dir, street_id)),
k AS (SELECT *, unnest([0, 1, 2, 3]) AS j FROM t WHERE CASE WHEN ndir < dir THEN ndir - dir + 360 ELSE ndir - dir END BETWEEN 30 AND 330)
SELECT scene_id, ord, street_id, next_id, CAST(j AS INT) AS j, round({_CORNER[0]}, 7) AS x, round({_CORNER[1]}, 7) AS y FROM k""")
def corner_arcs(spark, sf_dir):
    """Arcs around the corners where ends of streets meet (within 60 m, as the supplied streets share no end)."""
    s = sc.streets(spark, sf_dir)
    end = lambda x, y, k: s.select("scene_id", (F.col("street_id") * 2 + k).alias("ord"), "street_id", F.col(x).alias("x"), F.col(y).alias("y"), F.lit("street").alias("kind"), F.lit(None).cast("string").alias("side"), "name")
    ends = end("x", "y", 0).unionByName(end("bx", "by", 1))
    corners = sg.merged(ends, sg.absorbed(ends, CORNER_M))
    return sg.corner_arcs(corners, s).withColumns({"x": F.round("x", 7), "y": F.round("y", 7)})


@query(f"""{FORCED_SQL}, o AS (SELECT scene_id, arg_min(x, id) AS x, arg_min(y, id) AS y FROM eq WHERE kind = 'co' GROUP BY 1),
snap AS (SELECT b.scene_id, b.id, n.ord, n.comp, {sql_haversine('b.x', 'b.y', 'n.x', 'n.y')} AS d FROM (SELECT scene_id, id, x, y FROM bld UNION ALL SELECT scene_id, -1, x, y FROM o) b JOIN c2 n ON n.scene_id = b.scene_id
         QUALIFY row_number() OVER (PARTITION BY b.scene_id, b.id ORDER BY round({sql_haversine('b.x', 'b.y', 'n.x', 'n.y')}, 6), CAST(n.ord AS VARCHAR)) = 1)
SELECT b.scene_id, b.id, s.ord AS node, round(s.d, 4) AS distance, CASE WHEN s.ord IS NULL OR k.ord IS NULL THEN 'too_far_from_graph' WHEN s.comp = k.comp THEN 'reachable' ELSE 'different_component' END AS reason
FROM bld b LEFT JOIN snap s ON s.scene_id = b.scene_id AND s.id = b.id AND s.d <= {REACH_M} LEFT JOIN snap k ON k.scene_id = b.scene_id AND k.id = -1 AND k.d <= {REACH_M}""")
def scene_reach(spark, sf_dir):
    """Which buildings reach the office of their scene along streets and bridges, by the nearest node of each."""
    g = SceneGraph(spark, sf_dir)
    edges, more = g.bridged()
    member = sg.component_of(g.nodes, edges.unionByName(more))
    nodes = g.nodes.select("scene_id", "ord", "x", "y").join(member.hint("merge"), ["scene_id", "ord"])
    e = sc.equipment(spark, sf_dir).filter("kind = 'co'")
    office = e.groupBy("scene_id").agg(F.min_by("x", "id").alias("x"), F.min_by("y", "id").alias("y"))
    named = nodes.select("scene_id", F.col("ord").cast("string").alias("id"), "x", "y", "component")  # ties go to the smaller text
    found = rt.reach_by_component(g.buildings.select("scene_id", "id", "x", "y"), office, sg.gr.settled(named), REACH_M)
    return found.select("scene_id", "id", F.col("node").cast("long").alias("node"), F.round("distance", 4).alias("distance"), "reason")


def _frames(spark, sf_dir) -> DataFrame:
    p = sc.points(spark, sf_dir).groupBy("scene_id").agg(*[(f(c) + s * sc.HALF).alias(f"{k}_{c}") for k, f, s in (("min", F.min, -1), ("max", F.max, 1)) for c in ("x", "y")])
    return gro.framed(p)


def _sql_route_frames() -> str:
    side = lambda x, y: f"CAST(greatest({gro.LEAST_CELLS}, least({gro.MOST_CELLS}, floor(greatest(1.0, {sql_haversine('mx', 'my', x, y)}) / {gro.CELL_M} + 0.5))) AS INT)"
    return f"""fr0 AS (SELECT scene_id, min(x) - {sc.HALF} AS mx, min(y) - {sc.HALF} AS my, max(x) + {sc.HALF} AS hx, max(y) + {sc.HALF} AS hy FROM pts GROUP BY 1),
fr1 AS (SELECT *, {side('hx', 'my')} AS gw, {side('mx', 'hy')} AS gh FROM fr0), fr AS (SELECT *, (hx - mx) / gw AS cw, (hy - my) / gh AS ch FROM fr1),
ce AS (SELECT scene_id, col, row, mx + (col + 0.5) * cw AS px, my + (row + 0.5) * ch AS py FROM (SELECT *, unnest(range(gh)) AS row FROM (SELECT *, unnest(range(gw)) AS col FROM fr)))"""


_EDGE = lambda a, b: sql_segment("px", "py", *a, *b)
_RING = [("b.x0", "b.y0"), ("b.x1", "b.y0"), ("b.x1", "b.y1"), ("b.x0", "b.y1")]


@query(f"""WITH {sc.SCENE_SQL}, {_sql_route_frames()},
cl AS (SELECT DISTINCT ce.scene_id, col, row FROM ce JOIN bld b ON b.scene_id = ce.scene_id AND px BETWEEN b.x0 - 0.0001 AND b.x1 + 0.0001 AND py BETWEEN b.y0 - 0.0001 AND b.y1 + 0.0001
 WHERE (px > b.x0 AND px < b.x1 AND py > b.y0 AND py < b.y1) OR least({', '.join(_EDGE(a, b) for a, b in zip(_RING, _RING[1:] + _RING[:1]))}) < {gro.CLEARANCE_M}),
sl AS (SELECT DISTINCT ce.scene_id, col, row FROM ce JOIN st s ON s.scene_id = ce.scene_id WHERE {sql_segment('px', 'py', 's.x', 's.y', 's.bx', 's.ey')} < {gro.STREET_CELLS * gro.CELL_M})
SELECT scene_id, 'closed' AS kind, count(*) AS cells, CAST(sum(col * 1000 + row) AS BIGINT) AS places FROM cl GROUP BY 1 UNION ALL SELECT scene_id, 'street', count(*), CAST(sum(col * 1000 + row) AS BIGINT) FROM sl GROUP BY 1""")
def route_cells(spark, sf_dir):
    """Cells of each scene's routing grid that buildings close, and those on streets."""
    f = _frames(spark, sf_dir)
    both = gro.closed_cells(f, sc.buildings(spark, sf_dir)).withColumn("kind", F.lit("closed")).unionByName(gro.street_cells(f, sc.streets(spark, sf_dir)).withColumn("kind", F.lit("street")))
    return both.groupBy("scene_id", "kind").agg(F.count("*").alias("cells"), F.sum(F.col("col") * 1000 + F.col("row")).cast("long").alias("places"))


@query()
def laid_routes(spark, sf_dir):
    """The cables between closures of each scene on their cheapest ways around buildings, off the streets where that is cheaper."""
    f, d = _frames(spark, sf_dir), sc.distribution(spark, sf_dir)
    ways = gro.routed(d.withColumnRenamed("cable_id", "request"), f, gro.closed_cells(f, sc.buildings(spark, sf_dir)), gro.street_cells(f, sc.streets(spark, sf_dir)))
    out = gro.laid(d.select("scene_id", "cable_id", "kind", "source", "target"), ways)
    return out.select("scene_id", "cable_id", "source", "target", F.round("cost", 6).alias("cost"), F.size("line").alias("points"), F.round("metres", 4).alias("metres"))
