"""Queries of the network store and of the geometry executor."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions import network as nw
from terrane.functions.geo import P
from terrane.operators import executor as ex
from terrane.operators import spatial as sp
from terrane.operators import store
from terrane.operators.ranking import global_row_number
from terrane.plans.network import NET, cables, net, nodes
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


@query(f"{W} SELECT n.id, n.type, c.id AS cable, c.source FROM nodes n LEFT JOIN (SELECT target, arg_max(id, ord) AS id, arg_max(source, ord) AS source FROM cables GROUP BY 1) c ON c.target = n.id")
def address_lookup(spark, sf_dir):
    return store.lookup(nodes(spark, sf_dir).select("id", "type"), cables(spark, sf_dir))


@query(f"{W} SELECT c.id, a.type AS source_type, b.type AS target_type, c.length FROM cables c JOIN nodes a ON a.id = c.source JOIN nodes b ON b.id = c.target")
def cable_inventory(spark, sf_dir):
    return net(spark, sf_dir).select("id", F.col("st").alias("source_type"), F.col("tt").alias("target_type"), "length")


@query("WITH h AS (SELECT 'h' || c_custkey AS id, lower(c_mktsegment) || ' ' || (c_custkey % 50) AS address, c_custkey AS ord FROM customer), k AS (SELECT unnest([address, id]) AS key, id, ord FROM h) SELECT key, arg_max(id, ord) AS id FROM k GROUP BY 1")
def index_by_address(spark, sf_dir):
    h = table(spark, sf_dir, "customer").select(F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("ord"), "c_mktsegment")
    return store.two_keys(h, F.concat(F.lower("c_mktsegment"), F.lit(" "), (F.col("ord") % 50).cast("string")))


@query("""WITH e AS (SELECT c_nationkey AS street, 'house' AS type FROM customer UNION ALL SELECT s_nationkey, 'closure' FROM supplier UNION ALL SELECT n_nationkey, 'cabinet' FROM nation)
SELECT street, count(*) FILTER (type = 'house') AS houses, count(*) FILTER (type = 'closure') AS closures, count(*) FILTER (type = 'cabinet') AS cabinets FROM e GROUP BY 1""")
def index_by_street(spark, sf_dir):
    part = lambda t, k, kind: table(spark, sf_dir, t).select(F.col(k).alias("street"), F.lit(kind).alias("type"))
    e = part("customer", "c_nationkey", "house").union(part("supplier", "s_nationkey", "closure")).union(part("nation", "n_nationkey", "cabinet"))
    count = lambda k: F.count_if(F.col("type") == k).alias(k + "s")
    return e.groupBy("street").agg(count("house"), count("closure"), count("cabinet"))


@query(f"{S}, z AS (SELECT id, CAST(floor(x / 0.002) AS BIGINT) * 100000 + CAST(floor(y / 0.002) AS BIGINT) AS zone FROM eq) SELECT d.cable_id, a.zone AS from_zone, b.zone AS to_zone FROM dist d JOIN z a ON a.id = d.source JOIN z b ON b.id = d.target WHERE a.zone <> b.zone")
def cross_zone_links(spark, sf_dir):
    zone = F.floor(F.col("x") / 0.002).cast("long") * 100000 + F.floor(F.col("y") / 0.002).cast("long")
    z = sc.equipment(spark, sf_dir).select("id", zone.alias("zone"))
    return store.cross_zone(sc.distribution(spark, sf_dir).select("cable_id", "source", "target"), z).select("cable_id", "from_zone", "to_zone")


@query(f"""{W} SELECT 'too_long' AS kind, id FROM net WHERE length > CASE tier WHEN 'drop' THEN 100 WHEN 'distribution' THEN 500 ELSE 2000 END
UNION ALL SELECT 'disconnected', id FROM nodes WHERE id NOT IN (SELECT source FROM cables UNION ALL SELECT target FROM cables)
UNION ALL SELECT 'overfull', id FROM (SELECT n.id, n.ratio, count(*) AS c FROM nodes n JOIN cables x ON x.source = n.id WHERE n.type = 'closure' GROUP BY ALL) WHERE c > CAST(substr(ratio, 3) AS INT)""")
def zone_validation(spark, sf_dir):
    """Checks put together: cables beyond their tier's length, nodes without a cable, closures with more cables than outputs."""
    n, c = nodes(spark, sf_dir), net(spark, sf_dir)
    ends = c.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    load = c.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("c")).join(n.filter("type = 'closure'"), "id")
    over = load.filter(F.col("c") > F.regexp_extract("ratio", "1:([0-9]+)", 1).cast("int"))
    long = c.filter(nw.cable_status(F.lit(False), F.lit(False), F.col("tier"), F.col("length")) == "TOO_LONG")
    return store.issues(("too_long", long, "id"), ("disconnected", n.join(ends, "id", "left_anti"), "id"), ("overfull", over, "id"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def fibre_validation(spark, sf_dir):
    """Numbers used twice within one parent."""
    return store.duplicated(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey AS closure, CAST(sum(l_quantity) AS BIGINT) AS fibres, CASE WHEN sum(l_quantity) <= 12 THEN 12 WHEN sum(l_quantity) <= 24 THEN 24 WHEN sum(l_quantity) <= 48 THEN 48 ELSE 96 END AS enclosure, CAST(ceil(sum(l_quantity) / 12) AS BIGINT) AS trays FROM lineitem GROUP BY 1")
def closure_hardware(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("closure")).agg(F.sum("l_quantity").cast("long").alias("fibres"))
    return f.select("closure", "fibres", nw.enclosure_size(F.col("fibres")).alias("enclosure"), F.ceil(F.col("fibres") / 12).alias("trays"))


@query("SELECT o_custkey, o_orderkey, CAST(sum(1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS port, CASE WHEN o_orderstatus = 'F' THEN 'available' ELSE 'allocated' END AS state, coalesce(min(o_orderkey) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey), -1) AS next_free FROM orders")
def next_free_port(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    port = F.row_number().over(w.orderBy("o_orderkey")).cast("long")
    free = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", port.alias("port"), F.when(free, "available").otherwise("allocated").alias("state"), F.coalesce(F.min(F.when(free, F.col("o_orderkey"))).over(w), F.lit(-1)).alias("next_free"))


@query(f"""{S}, j AS (SELECT CAST(floor(x / 0.002) AS BIGINT) AS c, CAST(floor(y / 0.002) AS BIGINT) AS r, id, id % 7 AS prio FROM pts), b AS (SELECT c, r, id, row_number() OVER (PARTITION BY c, r ORDER BY prio DESC, id) AS k FROM j)
SELECT id, 'J' || lpad(CAST(row_number() OVER (ORDER BY c, r) AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER (ORDER BY c, r) AS VARCHAR))) AS INT), '0') AS name FROM b WHERE k = 1""")
def junctions(spark, sf_dir):
    """One junction per cell, the highest priority wins; names in order of cells, numbered within ranges of cells."""
    j = sc.points(spark, sf_dir).select(F.floor(F.col("x") / 0.002).cast("long").alias("c"), F.floor(F.col("y") / 0.002).cast("long").alias("r"), "id")
    b = j.groupBy("c", "r").agg(F.max_by("id", F.struct(F.col("id") % 7, -F.col("id"))).alias("id"))
    numbered = global_row_number(b.withColumn("at", F.col("c") * 1_000_000 + F.col("r")), "at", "n").withColumn("n", F.col("n").cast("string"))
    return numbered.select("id", F.concat(F.lit("J"), F.lpad("n", F.greatest(F.lit(3), F.length("n")), F.lit("0"))).alias("name"))


@query(f"{S}, a AS (SELECT b.scene_id, b.id, {sql_haversine('b.x', 'b.y', 'e.x', 'e.y')} AS d, e.id AS other FROM bld b JOIN eq e ON b.scene_id = e.scene_id), n AS (SELECT scene_id, id, min(d) AS near, max(d) AS far FROM a GROUP BY ALL) SELECT scene_id, id, far >= greatest(1.25 * near, near + 10) AS clear FROM n")
def near_far_margin(spark, sf_dir):
    """Is the farthest closure clearly farther than the nearest? Closures are few per scene."""
    e = sc.equipment(spark, sf_dir).select("scene_id", F.col("x").alias("ox"), F.col("y").alias("oy"))
    d = sc.buildings(spark, sf_dir).join(e, "scene_id").select("scene_id", "id", geo.haversine(_p("x", "y"), _p("ox", "oy")).alias("d"))
    n = d.groupBy("scene_id", "id").agg(F.min("d").alias("near"), F.max("d").alias("far"))
    return n.select("scene_id", "id", (F.col("far") >= F.greatest(1.25 * F.col("near"), F.col("near") + 10)).alias("clear"))


@query(f"{S} SELECT id, printf('%.5f', round(x, 5)) || ',' || printf('%.5f', round(y, 5)) AS node FROM pts")
def node_ids(spark, sf_dir):
    """Node ids from coordinates with five decimals."""
    five = lambda c: F.format_string("%.5f", F.round(c, 5))
    return sc.points(spark, sf_dir).select("id", F.concat(five("x"), F.lit(","), five("y")).alias("node"))


@query(f"{S} SELECT a.scene_id, a.street_id AS a, b.street_id AS b FROM st a JOIN st b ON a.scene_id = b.scene_id AND a.name = b.name AND a.street_id < b.street_id")
def same_street_pairs(spark, sf_dir):
    """Pairs of ways of one name: a street has few ways."""
    s = sc.streets(spark, sf_dir).select("scene_id", "name", "street_id")
    b = s.withColumnRenamed("street_id", "b")
    return s.join(b, ["scene_id", "name"]).filter("street_id < b").select("scene_id", F.col("street_id").alias("a"), "b")


@query(f"{S} SELECT scene_id, type, CASE WHEN count(*) <= 5 THEN 'small' WHEN count(*) <= 15 THEN 'medium' WHEN count(*) <= 40 THEN 'large' ELSE 'xlarge' END AS preset FROM bld GROUP BY ALL")
def grid_presets(spark, sf_dir):
    return sc.buildings(spark, sf_dir).groupBy("scene_id", "type").agg(nw.grid_preset(F.count("*")).alias("preset"))


@query()
def executor_answers(spark, sf_dir):
    """A text of requests per point: distance, inside or not, thresholds, and lines that are wrong."""
    num = lambda c: F.col(c).cast("decimal(14,9)").cast("string")
    here = F.concat(F.lit("["), num("x"), F.lit(","), num("y"), F.lit("]"))
    text = F.concat_ws(
        "\n", F.lit("let me see"), F.concat(F.lit('{"op": "dist", "a": '), here, F.lit(', "b": [-73.984, 40.7549]}')),
        F.concat(F.lit('{"op": "point_in_polygon", "p": '), here, F.lit(', "ring": [[-73.986,40.753],[-73.982,40.753],[-73.982,40.757],[-73.986,40.757]]}')),
        F.lit('{"op": "filter_threshold", "ids": ["u", "v"], "values": [1, 5], "cmp": "ge", "threshold": 3}'), F.lit('{"op": "fly"}'), F.lit('{"op": "dist"}'), F.lit("{broken"),
    )
    r = ex.run(ex.parse(sc.points(spark, sf_dir).select("id", text.alias("text"))))
    return r.select("id", "n", F.round("number", 3).alias("number"), "answer")


@query(f"{S} SELECT p.scene_id, p.id, count(q.id) AS n FROM pts p JOIN pts q ON p.scene_id = q.scene_id AND p.id <> q.id AND {sql_haversine('p.x', 'p.y', 'q.x', 'q.y')} <= 80 GROUP BY ALL")
def crowding(spark, sf_dir):
    """Neighbours within 80 m."""
    p = sc.points(spark, sf_dir)
    return sp.within_metres(p, p, 80).filter("id <> other").groupBy("scene_id", "id").agg(F.count("*").alias("n"))


@query("SELECT conv_id, role, count(*) AS lines FROM (SELECT conv_id, role, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE regexp_matches(line, 'tion') GROUP BY ALL")
def grep_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.split("text", "\n")).alias("line"))
    return c.filter(F.col("line").rlike("tion")).groupBy("conv_id", "role").agg(F.count("*").alias("lines"))
