"""Questions on generated towns, for tests alone (no table is read): what the operators find must be what was planted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions.geo import P
from terrane.functions.stats import half_up
from terrane.operators import graph as gr
from terrane.operators import procedural as pr
from terrane.operators import routing as rt
from terrane.operators import spatial as sp
from terrane.sources import towns as tw

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TOWNS = 60


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


#: Specifications, and closures by their number (the last building has none where a gap is planted).
SPEC = f"""s AS (SELECT CAST(i AS INT) AS scene_id, CAST(3 + (i // 6) % 3 AS INT) AS n, i % 6 IN (1, 5) AS inb, i % 6 IN (2, 5) AS cross_, i % 6 IN (3, 5) AS gap, i % 6 IN (4, 5) AS road FROM (SELECT unnest(range({TOWNS})) AS i)),
c AS (SELECT *, n * n - CAST(gap AS INT) AS closures FROM s)"""


def _p(x: str, y: str) -> P:
    return P(F.col(x), F.col(y))


@query(f"WITH {SPEC} SELECT scene_id, CAST(n * n AS BIGINT) AS buildings, CAST(2 * n + 2 AS BIGINT) AS streets, CAST(closures + 1 AS BIGINT) AS equipment, CAST(closures + CAST(cross_ AS INT) AS BIGINT) AS cables FROM c")
def town_inventory(spark, sf_dir):
    """What each town holds."""
    specs = tw.specifications(spark, TOWNS)
    n = lambda df, name: df.groupBy("scene_id").agg(F.count("*").alias(name))
    return n(tw.buildings(specs), "buildings").join(n(tw.streets(specs), "streets"), "scene_id").join(n(tw.equipment(specs), "equipment"), "scene_id").join(n(tw.cables(specs), "cables"), "scene_id")


def errors(specs: DataFrame) -> DataFrame:
    """(scene_id, kind, id) of all errors that are found in towns: closures in buildings or in the road, cables through
    buildings of others, buildings without a closure near."""
    b, e, c = tw.buildings(specs), tw.equipment(specs), tw.cables(specs)
    closures = e.filter("kind = 'closure'")
    inside = sp.points_in_footprints(closures, b).select("scene_id", F.lit("closure_in_building").alias("kind"), "id").distinct()
    hits = sp.segments_through_footprints(c, b).select("scene_id", "cable_id", F.col("area").alias("building"))
    crossing = hits.join(tw.foreign(specs), ["scene_id", "cable_id", "building"], "left_anti").select("scene_id", F.lit("cable_crossing").alias("kind"), F.col("cable_id").alias("id")).distinct()
    gaps = sp.coverage_gaps(b, closures).select("scene_id", F.lit("coverage_gap").alias("kind"), "id")
    road = sp.nearest_street(closures, tw.streets(specs)).filter("d <= 2").select("scene_id", F.lit("closure_on_street").alias("kind"), "id")
    return inside.unionByName(crossing).unionByName(gaps).unionByName(road)


_NAME = "'CL-' || chr(CAST(64 + closures AS INT))"


@query(f"""WITH {SPEC} SELECT scene_id, 'closure_in_building' AS kind, 'CL-A' AS id FROM c WHERE inb UNION ALL SELECT scene_id, 'cable_crossing', 'dist-cross' FROM c WHERE cross_
UNION ALL SELECT scene_id, 'coverage_gap', 'B-' || (n - 1) || '-' || (n - 1) FROM c WHERE gap UNION ALL SELECT scene_id, 'closure_on_street', {_NAME} FROM c WHERE road""")
def town_errors(spark, sf_dir):
    """The errors found are those that were planted."""
    return errors(tw.specifications(spark, TOWNS))


@query(f"WITH {SPEC} SELECT scene_id, 'B-' || (k % n) || '-' || (k // n) AS building, 'CL-' || chr(CAST(65 + k AS INT)) AS closure FROM (SELECT *, unnest(range(closures)) AS k FROM c WHERE NOT inb)")
def town_nearest_closure(spark, sf_dir):
    """Every building is nearest to its own closure; towns with a moved closure and buildings without one are left out."""
    specs = tw.specifications(spark, TOWNS).filter("NOT in_building")
    e = tw.equipment(specs).filter("kind = 'closure'")
    near = sp.nearest(tw.buildings(specs), e.select("scene_id", "id", "x", "y"), 1)
    return near.join(e.select("scene_id", F.col("serves").alias("id")), ["scene_id", "id"], "left_semi").select("scene_id", F.col("id").alias("building"), F.col("other").alias("closure"))


@query(f"WITH {SPEC} SELECT scene_id, CAST(n AS BIGINT) AS nx, CAST(10 * (1 + 5 * n) AS BIGINT) AS width_m, CAST(10 * (1 + 5 * n) AS BIGINT) AS height_m FROM c")
def town_extent(spark, sf_dir):
    """Length of the streets and one cell, which is the width and the height of a town in metres."""
    s = tw.streets(tw.specifications(spark, TOWNS))
    d = half_up(geo.segment_metres(_p("bx", "by"), _p("x", "y"), _p("x", "y")) + tw.CELL_M)
    side = lambda mark: F.max(F.when(F.col("street_id").startswith(mark), F.col("d")))
    own = s.withColumn("d", d).groupBy("scene_id").agg((F.count("*") / 2 - 1).cast("long").alias("nx"), side("st-h").alias("width_m"), side("st-v").alias("height_m"))
    return own.select("scene_id", "nx", "width_m", "height_m")


@query(f"WITH {SPEC}, k AS (SELECT scene_id, n, CAST(floor((1 + 5 * n - 1) * 10 / 12.0) AS BIGINT) AS steps FROM s) SELECT scene_id, CAST((2 * n + 2) * 2 * (steps + 1) AS BIGINT) AS nodes, CAST((2 * n + 2) * 2 * steps AS BIGINT) AS along, CAST((2 * n + 2) * (steps + 1) AS BIGINT) AS across FROM k")
def town_routing(spark, sf_dir):
    """Size of the routing graph of each town."""
    nodes = rt.pavement_nodes(tw.streets(tw.specifications(spark, TOWNS)))
    n = nodes.groupBy("scene_id").agg(F.count("*").alias("nodes"))
    kinds = rt.edges(nodes).groupBy("scene_id").agg(F.count_if(F.col("kind") == "sidewalk").alias("along"), F.count_if(F.col("kind") == "road_crossing").alias("across"))
    return n.join(kinds, "scene_id")


@query(f"WITH {SPEC} SELECT scene_id, CAST(2 * n + 2 AS BIGINT) AS apart, CAST(1 AS BIGINT) AS joined FROM s WHERE scene_id < 6")
def town_bridges(spark, sf_dir):
    """Streets are apart until bridges join all of a town."""
    nodes = rt.pavement_nodes(tw.streets(tw.specifications(spark, 6)))
    found = rt.edges(nodes)
    parts = lambda e, name: nodes.select("scene_id", "id").join(gr.components(e.select("source", "target")), "id").groupBy("scene_id").agg(F.count_distinct("component").alias(name))
    whole = found.unionByName(rt.bridges(nodes, found))
    return parts(found, "apart").join(parts(whole, "joined"), "scene_id")


@query(f"""WITH {SPEC}, p AS (SELECT scene_id, n, unnest(range(n + 1)) AS i FROM s WHERE scene_id < 18), q AS (SELECT *, unnest(range(n + 1)) AS j FROM p) SELECT scene_id, i, j, 50 * (i + j) AS metres FROM q""")
def town_one_way(spark, sf_dir):
    """Shortest ways from the south-western corner over streets of which those across the town lead eastwards only."""
    n = tw.specifications(spark, 18).select("scene_id", F.col("nx").alias("n"))
    at = n.select("scene_id", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("j"))
    name = lambda i, j: F.concat_ws("/", F.col("scene_id").cast("string"), i.cast("string"), j.cast("string"))
    i, j = F.col("i"), F.col("j")
    east = at.filter("i < n").select(name(i, j).alias("source"), name(i + 1, j).alias("target"), F.lit(50.0).alias("cost"))
    north = at.filter("j < n").select(name(i, j).alias("source"), name(i, j + 1).alias("target"), F.lit(50.0).alias("cost"))
    edges = rt.directed(east, F.lit(True)).unionByName(rt.directed(north, F.lit(False)))
    best = gr.shortest(edges, n.select(name(F.lit(0), F.lit(0)).alias("start")))
    part = lambda k: F.get(F.split("id", "/"), F.lit(k))
    return best.select(part(0).cast("int").alias("scene_id"), part(1).cast("long").alias("i"), part(2).cast("long").alias("j"), F.col("cost").cast("long").alias("metres"))


@query()
def synthetic_scene(spark, sf_dir):
    specs = spark.range(40).select(F.col("id").cast("int").alias("scene_id"), (1000 + F.col("id")).alias("seed"), (2 + F.col("id") % 4).alias("cols"), (2 + F.col("id") % 3).alias("rows"))
    return pr.synthetic_scenes(specs)


@query("SELECT CAST(i AS INT) AS scene_id, 1000 + i AS seed, ['none', 'closureInBuilding', 'cableCrossing', 'coverageGap', 'all'][CAST(i % 5 + 1 AS INT)] AS plant, CAST(2 + (i // 5) % 4 AS INT) AS size FROM (SELECT unnest(range(60)) AS i)")
def balanced_specs(spark, sf_dir):
    plants = F.array(*map(F.lit, ("none", "closureInBuilding", "cableCrossing", "coverageGap", "all")))
    i = F.col("id")
    return spark.range(60).select(i.cast("int").alias("scene_id"), (1000 + i).alias("seed"), F.element_at(plants, (i % 5 + 1).cast("int")).alias("plant"), (2 + F.floor(i / 5) % 4).cast("int").alias("size"))
