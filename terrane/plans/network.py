"""Network, text and graph queries. Regions are sources, nations cabinets, suppliers closures, customers houses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.functions import network as nw
from terrane.functions import text as tx
from terrane.operators import graph as gr
from terrane.sources import scenes as sc
from terrane.sources.scenes import SCENE_SQL, sql_haversine, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


NET = """
cl AS (SELECT n_nationkey AS nk, min(s_suppkey) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
nodes AS (SELECT 'co-' || r_regionkey AS id, 'co' AS type, NULL AS ratio FROM region UNION ALL SELECT 'cab-' || n_nationkey, 'cabinet', '1:4' FROM nation
 UNION ALL SELECT 'cl-' || s_suppkey, 'closure', '1:' || ([8, 16, 32])[CAST(s_suppkey % 3 + 1 AS INT)] FROM supplier UNION ALL SELECT 'h-' || c_custkey, 'house', NULL FROM customer),
cables AS (SELECT 'f-' || n_nationkey AS id, 'co-' || n_regionkey AS source, 'cab-' || n_nationkey AS target, CAST(2000 + n_nationkey * 370 % 9000 AS DOUBLE) AS length, 96 AS fibres, CAST(n_nationkey AS BIGINT) AS ord FROM nation
 UNION ALL SELECT 'd-' || s_suppkey, 'cab-' || s_nationkey, 'cl-' || s_suppkey, CAST(200 + s_suppkey * 53 % 700 AS DOUBLE), 24, s_suppkey FROM supplier
 UNION ALL SELECT 'x-' || c_custkey, 'cl-' || s, 'h-' || c_custkey, CAST(20 + c_custkey * 17 % 100 AS DOUBLE), 2, c_custkey FROM customer JOIN cl ON c_nationkey = nk),
net AS (SELECT c.*, a.type AS st, b.type AS tt, CASE WHEN a.type = 'co' AND b.type = 'cabinet' THEN 'feeder' WHEN b.type = 'house' THEN 'drop' ELSE 'distribution' END AS tier
 FROM cables c JOIN nodes a ON a.id = c.source JOIN nodes b ON b.id = c.target),
paths AS (SELECT x.target AS house, d.source AS cabinet, x.source AS closure, f.source AS co, x.length + d.length + f.length AS metres,
 CAST(substr(n.ratio, 3) AS INT) AS w1, CAST(substr(k.ratio, 3) AS INT) AS w2
 FROM cables x JOIN cables d ON d.target = x.source JOIN cables f ON f.target = d.source JOIN nodes n ON n.id = d.source JOIN nodes k ON k.id = x.source WHERE x.id LIKE 'x-%')
"""
W = f"WITH {NET}"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, key: str, mark: str, kind: str, ratio) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), ratio.cast("string").alias("ratio"))

    ways = F.element_at(F.array(*map(F.lit, ("1:8", "1:16", "1:32"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return (
        part("region", "r_regionkey", "co-", "co", F.lit(None))
        .unionByName(part("nation", "n_nationkey", "cab-", "cabinet", F.lit("1:4")))
        .unionByName(part("supplier", "s_suppkey", "cl-", "closure", ways))
        .unionByName(part("customer", "c_custkey", "h-", "house", F.lit(None)))
    )


def cables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    name = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"))

    def part(df: DataFrame, ident, source, target, length, fibres: int, key: str) -> DataFrame:
        return df.select(ident.alias("id"), source.alias("source"), target.alias("target"), length.cast("double").alias("length"), F.lit(fibres).alias("fibres"), F.col(key).cast("long").alias("ord"))

    first = s.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("s"))
    houses = c.join(F.broadcast(first), "c_nationkey")  # a row per nation
    feeders = part(n, name("f-", "n_nationkey"), name("co-", "n_regionkey"), name("cab-", "n_nationkey"), 2000 + F.col("n_nationkey") * 370 % 9000, 96, "n_nationkey")
    dist = part(s, name("d-", "s_suppkey"), name("cab-", "s_nationkey"), name("cl-", "s_suppkey"), 200 + F.col("s_suppkey") * 53 % 700, 24, "s_suppkey")
    drop = part(houses, name("x-", "c_custkey"), name("cl-", "s"), name("h-", "c_custkey"), 20 + F.col("c_custkey") * 17 % 100, 2, "c_custkey")
    return feeders.unionByName(dist).unionByName(drop)


def net(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).select("id", "type")
    a, b = n.withColumnsRenamed({"id": "source", "type": "st"}), n.withColumnsRenamed({"id": "target", "type": "tt"})
    return cables(spark, sf_dir).join(a, "source").join(b, "target").withColumn("tier", nw.tier(F.col("st"), F.col("tt")))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per house with the way to its source: two joins on keys along the tree."""
    c = cables(spark, sf_dir)
    up = c.select(F.col("target").alias("at"), F.col("source").alias("next"), F.col("length").alias("more"))
    ways = nodes(spark, sf_dir).select(F.col("id").alias("at"), tx.splitter_ways(F.col("ratio")).alias("ways"))
    x = c.filter(F.col("id").startswith("x-")).select(F.col("target").alias("house"), F.col("source").alias("closure"), "length")
    x = x.join(up.withColumnsRenamed({"at": "closure", "next": "cabinet", "more": "l2"}), "closure").join(up.withColumnsRenamed({"at": "cabinet", "next": "co", "more": "l3"}), "cabinet")
    x = x.join(ways.withColumnsRenamed({"at": "cabinet", "ways": "w1"}), "cabinet").join(ways.withColumnsRenamed({"at": "closure", "ways": "w2"}), "closure")
    return x.select("house", "cabinet", "closure", "co", (F.col("length") + F.col("l2") + F.col("l3")).alias("metres"), "w1", "w2")


@query(f"{W} SELECT id, tier FROM net")
def cable_tiers(spark, sf_dir):
    return net(spark, sf_dir).select("id", "tier")


@query(f"{W} SELECT tier, count(*) AS n, sum(length) AS metres, CAST(max(fibres) AS INT) AS fibres, count(*) FILTER (tier = 'drop') AS drops FROM net GROUP BY 1")
def cables_by_tier(spark, sf_dir):
    return net(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.sum("length").alias("metres"), F.max("fibres").alias("fibres"), F.count_if(F.col("tier") == "drop").alias("drops"))


def _db_sql(profile: str) -> str:
    def one(w: str) -> str:
        return "CASE " + " ".join(f"WHEN {w} = {n} THEN {db}" for n, db in nw.SPLITTERS[profile].items()) + f" ELSE {nw.MISSING[profile]} END"

    fixed = "0.5 * 3 + 0.1 * 1" if profile in ("index", "twin") else "1.8"
    loss = f"metres / 1000 * 0.35 + {one('w1')} + {one('w2')} + {fixed} + {nw.RESERVE[profile]}"
    d = nw.DECIMALS[profile]
    return f"round({loss}, 6)" if d is None else f"floor(({loss}) * {10**d} + 0.5) / {10**d}"


def _db(profile: str):
    both = nw.splitter_db(F.col("w1"), profile) + nw.splitter_db(F.col("w2"), profile)
    db = nw.path_db(F.col("metres"), F.lit(3), F.lit(1), both, profile)
    return F.round(db, 6) if profile == "zone" else db


@query(f"{W} SELECT house, co, metres, " + ", ".join(f"{_db_sql(p)} AS db_{p}" for p in nw.RESERVE) + " FROM paths")
def optical_paths(spark, sf_dir):
    return paths(spark, sf_dir).select("house", "co", "metres", *[_db(p).alias(f"db_{p}") for p in nw.RESERVE])


@query(f"{W}, p AS (SELECT co, {_db_sql('index')} AS db FROM paths) SELECT co, count(*) AS n, count(*) FILTER (db <= 28) AS compliant, count(*) FILTER (db >= 25 AND db < 27) AS warning, count(*) FILTER (db >= 27) AS critical, floor(avg(db) * 10 + 0.5) / 10 AS avg_db, max(db) AS max_db, min(db) AS min_db FROM p GROUP BY 1")
def optical_summary(spark, sf_dir):
    p = paths(spark, sf_dir).select("co", _db("index").alias("db"))
    status = nw.optical_status(F.col("db"))
    return p.groupBy("co").agg(
        F.count("*").alias("n"), F.count_if(F.col("db") <= nw.MAX_BUDGET).alias("compliant"), F.count_if(status == "warning").alias("warning"), F.count_if(status == "critical").alias("critical"),
        (F.floor(F.avg("db") * 10 + 0.5) / 10).alias("avg_db"), F.max("db").alias("max_db"), F.min("db").alias("min_db"),
    )


@query(f"{W}, p AS (SELECT co, house, {_db_sql('index')} AS db FROM paths) SELECT co, arg_min(house, (db, house)) AS best, arg_max(house, (db, house)) AS worst FROM p GROUP BY 1")
def best_worst_path(spark, sf_dir):
    p = paths(spark, sf_dir).select("co", "house", _db("index").alias("db"))
    return p.groupBy("co").agg(F.min_by("house", F.struct("db", "house")).alias("best"), F.max_by("house", F.struct("db", "house")).alias("worst"))


@query(f"""{W}, h AS (SELECT house, unnest([1, 2, 3]) AS hop, unnest([f.length, d.length, x.length]) AS length FROM paths p JOIN cables x ON x.target = p.house JOIN cables d ON d.target = p.closure JOIN cables f ON f.target = p.cabinet)
SELECT house, CAST(hop AS INT) AS hop, round(sum(length / 1000 * 0.35 + 0.5) OVER (PARTITION BY house ORDER BY hop ROWS UNBOUNDED PRECEDING), 6) AS db FROM h""")
def cumulative_loss(spark, sf_dir):
    c = cables(spark, sf_dir)
    at = lambda k, name: c.select(F.col("target").alias(k), F.col("length").alias(name))
    p = paths(spark, sf_dir).select("house", "closure", "cabinet").join(at("house", "l3"), "house").join(at("closure", "l2"), "closure").join(at("cabinet", "l1"), "cabinet")
    h = p.select("house", F.posexplode(F.array("l1", "l2", "l3")).alias("hop", "length"))
    w = Window.partitionBy("house").orderBy("hop").rowsBetween(Window.unboundedPreceding, 0)
    return h.select("house", (F.col("hop") + 1).alias("hop"), F.round(F.sum(F.col("length") / 1000 * nw.FIBRE_DB_KM + nw.CONNECTOR_DB).over(w), 6).alias("db"))


@query(f"{W}, d AS (SELECT unnest([source, target]) AS id FROM cables) SELECT id, count(*) AS degree FROM d GROUP BY 1")
def degree(spark, sf_dir):
    return gr.degrees(cables(spark, sf_dir))


@query(f"{W} SELECT house AS id, house || '>' || closure || '>' || cabinet || '>' || co AS path FROM paths UNION ALL SELECT 'h-' || c_custkey, 'h-' || c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nk FROM cl)")
def trace_to_source(spark, sf_dir):
    houses = nodes(spark, sf_dir).filter("type = 'house'").select("id")
    return gr.trace_up(houses, cables(spark, sf_dir)).select("id", F.array_join("path", ">").alias("path"))


@query(f"""{W}, r AS (SELECT n.id, coalesce(p.co, q.co, CASE WHEN n.type = 'co' THEN n.id END, k.co) AS co FROM nodes n LEFT JOIN paths p ON p.house = n.id
 LEFT JOIN (SELECT 'cl-' || s_suppkey AS id, 'co-' || n_regionkey AS co FROM supplier JOIN nation ON n_nationkey = s_nationkey) q ON q.id = n.id
 LEFT JOIN (SELECT 'cab-' || n_nationkey AS id, 'co-' || n_regionkey AS co FROM nation) k ON k.id = n.id)
SELECT id, min(id) OVER (PARTITION BY co) AS component FROM r WHERE co IS NOT NULL""")
def components(spark, sf_dir):
    """Connected components of the network; nodes without a cable are left out."""
    return gr.components(cables(spark, sf_dir))


@query(f"""{W}, s AS (SELECT co AS start, house AS id, metres AS cost, closure AS previous FROM paths),
t AS (SELECT f.source AS start, d.target AS id, f.length + d.length AS cost, d.source AS previous FROM cables d JOIN cables f ON f.target = d.source WHERE d.id LIKE 'd-%'),
u AS (SELECT source AS start, target AS id, length AS cost, source AS previous FROM cables WHERE id LIKE 'f-%')
SELECT * FROM s UNION ALL SELECT * FROM t UNION ALL SELECT * FROM u UNION ALL SELECT id, id, 0.0, NULL FROM nodes WHERE type = 'co'""")
def shortest_path(spark, sf_dir):
    edges = cables(spark, sf_dir).select("source", "target", F.col("length").alias("cost"))
    return gr.shortest(edges, nodes(spark, sf_dir).filter("type = 'co'").select(F.col("id").alias("start")))


@query(f"{W}, d AS (SELECT id, count(*) AS n FROM (SELECT unnest([source, target]) AS id FROM cables) GROUP BY 1) SELECT type, count(*) AS nodes, CAST(sum(coalesce(d.n, 0)) AS BIGINT) AS ends, count(*) FILTER (d.n IS NULL) AS isolated FROM nodes LEFT JOIN d ON d.id = nodes.id GROUP BY 1")
def graph_stats(spark, sf_dir):
    d = gr.degrees(cables(spark, sf_dir))
    return nodes(spark, sf_dir).join(d, "id", "left").groupBy("type").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("degree"), F.lit(0)).alias("ends"), F.count_if(F.col("degree").isNull()).alias("isolated"))


@query(f"{W} SELECT n.id AS closure, CAST(substr(n.ratio, 3) AS INT) AS capacity, count(x.id) AS connected, CAST(greatest(0, CAST(substr(n.ratio, 3) AS INT) - count(x.id)) AS BIGINT) AS free, round(coalesce(max(x.length), 0), 3) AS longest FROM nodes n LEFT JOIN cables x ON x.source = n.id WHERE n.type = 'closure' GROUP BY n.id, n.ratio")
def closure_topology(spark, sf_dir):
    n = nodes(spark, sf_dir).filter("type = 'closure'").select(F.col("id").alias("closure"), tx.splitter_ways(F.col("ratio")).alias("capacity"))
    x = cables(spark, sf_dir).groupBy(F.col("source").alias("closure")).agg(F.count("*").alias("connected"), F.max("length").alias("longest"))
    out = n.join(x, "closure", "left").fillna({"connected": 0, "longest": 0.0})
    return out.select("closure", "capacity", "connected", F.greatest(F.lit(0), F.col("capacity") - F.col("connected")).alias("free"), F.round("longest", 3).alias("longest"))


@query(f"{W} SELECT c_custkey AS id FROM customer WHERE 'h-' || c_custkey NOT IN (SELECT target FROM cables WHERE length <= 100)")
def unserved(spark, sf_dir):
    """Houses that no closure serves: a drop of more than 100 m does not count."""
    houses = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("h-"), F.col("c_custkey").cast("string")).alias("target"))
    return houses.join(cables(spark, sf_dir).filter("length <= 100"), "target", "left_anti").select("id")


@query(f"{W} SELECT f.source AS closure, CAST(k AS INT) AS fibre, ['blue', 'orange', 'green', 'brown', 'slate', 'white', 'red', 'black', 'yellow', 'violet', 'rose', 'aqua'][CAST((k - 1) % 12 + 1 AS INT)] AS colour, f.target AS cable FROM (SELECT source, target, unnest(generate_series(CAST(b AS BIGINT) + 1, CAST(b AS BIGINT) + fibres)) AS k FROM (SELECT source, target, fibres, coalesce(sum(fibres) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM cables WHERE id LIKE 'd-%')) f")
def fibre_allocation(spark, sf_dir):
    """Fibres of a cabinet dealt to its cables in order: a running sum gives where each begins."""
    w = Window.partitionBy("source").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    d = cables(spark, sf_dir).filter(F.col("id").startswith("d-")).withColumn("b", F.coalesce(F.sum("fibres").over(w), F.lit(0)))
    e = d.select(F.col("source").alias("closure"), F.col("target").alias("cable"), F.explode(F.sequence(F.col("b") + 1, F.col("b") + F.col("fibres"))).alias("fibre"))
    return e.select("closure", F.col("fibre").cast("int").alias("fibre"), tx.fibre_colour(F.col("fibre")).alias("colour"), "cable")


@query("SELECT o_orderstatus AS status, count(*) AS ports, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS BIGINT) AS allocated, round(100.0 * sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) / count(*), 3) AS utilization FROM orders GROUP BY 1")
def port_utilization(spark, sf_dir):
    used = F.count_if(F.col("o_orderpriority").startswith("1"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("ports"), used.alias("allocated"), F.round(100.0 * used / F.count("*"), 3).alias("utilization"))


@query("SELECT p_brand AS category, CAST(sum(l_quantity) AS BIGINT) AS quantity, round(sum(l_quantity * p_retailprice), 2) AS cost FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def bill_of_materials(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice"), "l_partkey")
    return li.groupBy(F.col("p_brand").alias("category")).agg(F.sum("l_quantity").cast("long").alias("quantity"), F.round(F.sum(F.col("l_quantity") * F.col("p_retailprice")), 2).alias("cost"))


BOX = (-73.99, 40.749, -73.978, 40.761)
_LX, _LY = (BOX[2] - BOX[0]) / 5, (BOX[3] - BOX[1]) / 4


@query(f"""WITH {SCENE_SQL}, i AS (SELECT *, x BETWEEN {BOX[0]} AND {BOX[2]} AND y BETWEEN {BOX[1]} AND {BOX[3]} AS inside FROM pts)
SELECT id, CASE WHEN inside THEN chr(CAST(65 + least(floor(({BOX[3]} - y) / {_LY!r}), 3) AS INT)) || CAST(least(floor((x - {BOX[0]}) / {_LX!r}), 4) + 1 AS INT) END AS north,
 chr(CAST(65 + least(4, greatest(0, floor((x - {BOX[0]}) / {BOX[2] - BOX[0]!r} * 5))) AS INT)) || CAST(least(3, greatest(0, floor((y - {BOX[1]}) / {BOX[3] - BOX[1]!r} * 4))) + 1 AS INT) AS south,
 CASE WHEN inside THEN chr(CAST(65 + least(floor((y - {BOX[1]}) / 0.0018), 25) AS INT)) || CAST(least(floor((x - {BOX[0]}) / 0.0024), 99) + 1 AS INT) ELSE 'default' END AS fixed FROM i""")
def zone_assign(spark, sf_dir):
    p = sc.points(spark, sf_dir)
    return p.select("id", *[nw.zone(F.col("x"), F.col("y"), BOX, 4, 5, s).alias(s) for s in ("north", "south", "fixed")])


@query(f"""WITH {SCENE_SQL}, z AS (SELECT DISTINCT CAST(floor(x / 0.002) AS BIGINT) AS c, CAST(floor(y / 0.002) AS BIGINT) AS r FROM pts), n AS (SELECT c, r, unnest([0, 0, 1, -1]) AS dc, unnest([1, -1, 0, 0]) AS dr FROM z)
SELECT n.c, n.r, count(z.c) AS neighbours FROM n LEFT JOIN z ON z.c = n.c + n.dc AND z.r = n.r + n.dr GROUP BY 1, 2""")
def zone_adjacency(spark, sf_dir):
    z = sc.points(spark, sf_dir).select(F.floor(F.col("x") / 0.002).cast("long").alias("c"), F.floor(F.col("y") / 0.002).cast("long").alias("r")).distinct()
    step = F.array(*[F.struct(F.lit(a).cast("long").alias("dc"), F.lit(b).cast("long").alias("dr")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    n = z.select("c", "r", F.explode(step).alias("s")).select("c", "r", (F.col("c") + F.col("s.dc")).alias("nc"), (F.col("r") + F.col("s.dr")).alias("nr"))
    there = z.select(F.col("c").alias("nc"), F.col("r").alias("nr"), F.lit(1).alias("there"))
    return n.join(there, ["nc", "nr"], "left").groupBy("c", "r").agg(F.count("there").alias("neighbours"))


@query(f"""WITH {SCENE_SQL}, d AS (SELECT *, {sql_haversine('x', 'y', 'bx', 'ey')} AS m FROM dist)
SELECT cable_id, CASE WHEN source % 10 = 0 AND target % 3 = 0 THEN 'OFF_ROAD' WHEN m > 500 THEN 'TOO_LONG' ELSE 'OK' END AS status FROM d""")
def cable_status(spark, sf_dir):
    from terrane.functions import geo
    from terrane.functions.geo import P

    m = geo.haversine(P(F.col("x"), F.col("y")), P(F.col("bx"), F.col("by")))
    return sc.distribution(spark, sf_dir).select("cable_id", nw.cable_status(F.lit(False), F.expr("source % 10 = 0 AND target % 3 = 0"), F.col("kind"), m).alias("status"))


ADDR = "a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey || ' ' || c_mktsegment || ' Street,  City' WHEN c_custkey % 3 = 1 THEN c_mktsegment || '  ' || c_custkey || 'B,Town' ELSE 'St. ' || c_name END AS a FROM customer)"


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    a = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(" "), "c_mktsegment", F.lit(" Street,  City"))).when(k % 3 == 1, F.concat("c_mktsegment", F.lit("  "), k.cast("string"), F.lit("B,Town"))).otherwise(F.concat(F.lit("St. "), "c_name"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), a.alias("a"))


@query(f"""WITH {ADDR} SELECT id, regexp_replace(regexp_replace(trim(lower(a)), '\\s+', ' ', 'g'), ',\\s*', ', ', 'g') AS key,
 trim(regexp_replace(regexp_replace(lower(a), '[,.\\-''"]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain,
 regexp_replace(regexp_replace(regexp_replace(trim(lower(a)), '\\s+', ' ', 'g'), '^(street|st\\.?|road|rd\\.?|avenue|ave\\.?)\\s+', ''), '\\s+(street|st\\.?|road|rd\\.?|avenue|ave\\.?)$', '') AS street FROM a""")
def normalize_address(spark, sf_dir):
    a = F.col("a")
    return addresses(spark, sf_dir).select("id", tx.address_key(a).alias("key"), tx.address_plain(a).alias("plain"), tx.street_key(a).alias("street"))


@query(f"""WITH {ADDR} SELECT id, CASE WHEN regexp_matches(a, '^[0-9]+[a-zA-Z]?\\s+(.+?)(?:,|$)') THEN trim(regexp_extract(a, '^[0-9]+[a-zA-Z]?\\s+(.+?)(?:,|$)', 1))
 WHEN contains(a, ',') AND trim(regexp_replace(string_split(a, ',')[1], '[0-9]+[a-zA-Zא-ת]?', '', 'g')) <> '' THEN trim(regexp_replace(string_split(a, ',')[1], '[0-9]+[a-zA-Zא-ת]?', '', 'g')) END AS street,
 CASE WHEN regexp_matches(a, '\\s([0-9]+[א-ת]?)(?:\\s|,|$)') THEN regexp_extract(a, '\\s([0-9]+[א-ת]?)(?:\\s|,|$)', 1) WHEN regexp_matches(a, '^([0-9]+[א-תa-zA-Z]?)\\s') THEN regexp_extract(a, '^([0-9]+[א-תa-zA-Z]?)\\s', 1) END AS number FROM a""")
def street_extract(spark, sf_dir):
    return addresses(spark, sf_dir).select("id", tx.street_of(F.col("a")).alias("street"), tx.number_of(F.col("a")).alias("number"))


@query("""SELECT c_custkey AS id, '[' || left(upper(trim(regexp_replace(regexp_replace(n, '\\s+Street$', ' ST', 'i'), '\\s+Avenue$', ' AVE', 'i'))), 15) || ']' AS label
FROM (SELECT c_custkey, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' Street' ELSE ' avenue' END AS n FROM customer)""")
def street_labels(spark, sf_dir):
    n = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, " Street").otherwise(" avenue"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tx.street_label(n).alias("label"))


@query("""WITH e AS (SELECT s_suppkey AS id, 'TLV-' || chr(CAST(65 + s_nationkey AS INT)) || (s_nationkey % 5) || '-CL-' || CASE WHEN s_suppkey < 1000 THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0') ELSE CAST(s_suppkey AS VARCHAR) END AS code FROM supplier)
SELECT id, code, regexp_extract(code, '^([A-Z]{2,3})-([A-Z][0-9]+)-', 2) AS zone, CAST(regexp_extract(code, '([0-9]{3,})$', 1) AS INT) AS number FROM e""")
def parse_equipment_id(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    zone = F.concat(F.char(65 + F.col("s_nationkey")), (F.col("s_nationkey") % 5).cast("string"))
    number = F.when(F.col("s_suppkey") < 1000, F.lpad(F.col("s_suppkey").cast("string"), 3, "0")).otherwise(F.col("s_suppkey").cast("string"))
    code = F.concat_ws("-", F.lit("TLV"), zone, F.lit("CL"), number)
    p = s.select(F.col("s_suppkey").alias("id"), code.alias("code")).withColumn("p", tx.equipment_parts(F.col("code")))
    return p.select("id", "code", "p.zone", "p.number")


@query("""SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_id % 10 < 5
UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 10 >= 5""")
def last_json(spark, sf_dir):
    """The last object in free text around it; for half of the rows the text has none."""
    text = F.when(F.col("event_id") % 10 < 5, F.concat(F.lit("thinking {not json} and {\"k\": -1} then "), "props", F.lit(" done"))).otherwise("no object here")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.coalesce(F.get_json_object(tx.last_json(text), "$.k").cast("int"), F.lit(-1)).alias("k"))


@query("""WITH p AS (SELECT p_partkey AS id, p_name FROM part) SELECT id, CASE WHEN p_name = 'red widget' THEN 1 WHEN contains(lower(p_name), 'widget') THEN 3 END AS tier FROM p WHERE contains(lower(p_name), 'widget')""")
def search_ranked(spark, sf_dir):
    tier = F.when(F.col("p_name") == "red widget", 1).when(tx.match_tier(F.col("p_name"), F.lit("widget")).isNotNull(), 3)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tier.alias("tier")).filter("tier IS NOT NULL")


@query(f"WITH {SCENE_SQL} SELECT street_id, CAST(2 AS INT) AS n, round(x, 6) AS x, round(ey, 6) AS y FROM st")
def wkt_parse(spark, sf_dir):
    """Streets to well-known text and back."""
    six = lambda c: F.col(c).cast("decimal(12,8)").cast("string")
    wkt = F.concat(F.lit("LINESTRING ("), six("x"), F.lit(" "), six("y"), F.lit(", "), six("bx"), F.lit(" "), six("by"), F.lit(")"))
    p = sc.streets(spark, sf_dir).select("street_id", tx.wkt_points(wkt).alias("p"))
    return p.select("street_id", F.size("p").alias("n"), F.round(F.col("p")[0]["x"], 6).alias("x"), F.round(F.col("p")[1]["y"], 6).alias("y"))


@query("SELECT p_partkey AS id, replace(replace(p_name, 'widget', 'closure'), 'ring', 'cabinet') AS skinned FROM part")
def skin_rewrite(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.rewrite(F.col("p_name"), {"widget": "closure", "ring": "cabinet"}).alias("skinned"))


@query("""WITH e AS (SELECT 'c' || c_custkey AS id, 'house' AS type FROM customer UNION ALL SELECT 's' || s_suppkey, 'closure' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'cabinet' FROM nation)
SELECT type, count(*) AS n, min(id) AS first FROM e GROUP BY 1""")
def index_by_element(spark, sf_dir):
    part = lambda t, k, m, kind: table(spark, sf_dir, t).select(F.concat(F.lit(m), F.col(k).cast("string")).alias("id"), F.lit(kind).alias("type"))
    e = part("customer", "c_custkey", "c", "house").union(part("supplier", "s_suppkey", "s", "closure")).union(part("nation", "n_nationkey", "n", "cabinet"))
    return e.groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("SELECT c_mktsegment AS street, count(*) AS n, CAST(sum(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE c_custkey % 4 END) AS BIGINT) AS demand, count(DISTINCT c_nationkey) AS zones FROM customer GROUP BY 1")
def address_rollup(spark, sf_dir):
    """Demand counts 1 where it is 0 or missing."""
    demand = F.coalesce(F.nullif(F.col("c_custkey") % 4, F.lit(0)), F.lit(1))
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("street")).agg(F.count("*").alias("n"), F.sum(demand).alias("demand"), F.count_distinct("c_nationkey").alias("zones"))


@query("WITH n AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation), h AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9950) SELECT a, b FROM n WHERE a IN (SELECT k FROM h) AND b NOT IN (SELECT k FROM h)")
def missing_links(spark, sf_dir):
    """Neighbours of zones with large accounts that have none themselves: a semi-join and an anti-join."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 1) % 25).alias("b"))
    h = table(spark, sf_dir, "customer").filter("c_acctbal > 9950").select("c_nationkey").distinct()
    return n.join(h, n.a == h.c_nationkey, "left_semi").join(h, n.b == h.c_nationkey, "left_anti")


@query("SELECT url, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path FROM pages")
def parse_urls(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("url", F.regexp_extract(u, r"^https?://([^/:?#]+)", 1).alias("host"), F.regexp_extract(u, r"^https?://[^/?#]+(/[^?#]*)", 1).alias("path"))
