"""Rules on rows: answers and their grades, names and codes, costs, fibres, the run's figures, and reach in networks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.functions import grading as gd
from terrane.functions import text as tx
from terrane.functions.stats import half_up
from terrane.operators.routing import EDGE_COSTS
from terrane.plans.evaluation import ITEMS, items
from terrane.plans.network import NET, cables, net, nodes, paths
from terrane.sources.scenes import table

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


RATED = "rated AS (SELECT *, CAST(event_id % 97 AS BIGINT) AS tokens_out, event_id % 11 = 0 AS unknown, CASE WHEN event_id % 13 = 0 THEN 'which zone?' WHEN event_id % 13 = 1 THEN '  ' END AS missing FROM (SELECT *, event_type AS arm FROM events))"


@query(f"""WITH {RATED} SELECT arm, count(*) AS n, CAST(floor(avg(tokens_out) + 0.5) AS BIGINT) AS mean_tokens_out, round(count(*) FILTER (unknown) / count(*), 6) AS hallucination_rate,
 round(count(*) FILTER (length(trim(coalesce(missing, ''))) > 0) / count(*), 6) AS missing_info_rate FROM rated GROUP BY 1""")
def per_arm_rates(spark, sf_dir):
    """The other half of the per-arm summary: tokens given, answers with unknown ids, answers that say that something is missing."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 13
    missing = F.when(k == 0, "which zone?").when(k == 1, "  ")
    asked = F.coalesce(F.length(F.trim(missing)) > 0, F.lit(False))
    return e.groupBy(F.col("event_type").alias("arm")).agg(
        F.count("*").alias("n"), half_up(F.avg(F.col("event_id") % 97)).alias("mean_tokens_out"),
        F.round(F.count_if(F.col("event_id") % 11 == 0) / F.count("*"), 6).alias("hallucination_rate"), F.round(F.count_if(asked) / F.count("*"), 6).alias("missing_info_rate"),
    )


@query(f"WITH {ITEMS} SELECT DISTINCT question, category FROM items WHERE question IN ('q3', 'q7') OR category IN ('c2')")
def question_selection(spark, sf_dir):
    """Questions named by id or by category."""
    return items(spark, sf_dir).filter(F.col("question").isin("q3", "q7") | F.col("category").isin("c2")).select("question", "category").distinct()


#: Loose answers as they come; what each should become is in the SQL.
LOOSE = [
    ('{"equipmentIds": ["CL-A", 7], "count": "12", "onStreet": true, "closureId": "CL-A"}', "CL-A|7", 12.0, True, "CL-A"),
    ('{"equipmentIds": "CL-B", "count": 3.5, "onStreet": "true", "closureId": 5}', "CL-B", 3.5, None, "5"),
    ('{"equipmentIds": 4, "count": null, "onStreet": false, "closureId": null}', None, None, False, None),
    ('{"equipmentIds": [], "count": "twelve"}', "", float("nan"), None, None),
    ("no json at all", None, None, None, None),
    ("[1, 2]", None, None, None, None),
]


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "CAST('NaN' AS DOUBLE)" if v != v else f"CAST({v} AS DOUBLE)"
    return "'" + v.replace("'", "''") + "'"


_LOOSE_SQL = "loose AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(map(_literal, r[1:]))})" for i, r in enumerate(LOOSE)) + ") t(k, ids, count, on_street, closure))"


@query(f"WITH {_LOOSE_SQL} SELECT o_orderkey AS id, ids, CASE WHEN isnan(count) THEN 'NaN' ELSE CAST(count AS VARCHAR) END AS count, CAST(on_street AS BOOLEAN) AS on_street, closure FROM orders JOIN loose ON k = o_orderkey % {len(LOOSE)}")
def answer_coercion(spark, sf_dir):
    """Ids, counts, flags and names of loose JSON answers."""
    raw = F.element_at(F.array(*[F.lit(r[0]) for r in LOOSE]), (F.col("o_orderkey") % len(LOOSE) + 1).cast("int"))
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"))
    r = F.col("raw")
    return a.select("id", F.array_join(gd.ids(r, "equipmentIds"), "|").alias("ids"), gd.number(r, "count").cast("string").alias("count"), gd.flag(r, "onStreet").alias("on_street"), gd.text(r, "closureId").alias("closure"))


@query("""SELECT l_orderkey AS item, l_linenumber AS n, abs((l_extendedprice + l_linenumber * 0.15) - l_extendedprice) <= 0.6 AS metres_match, l_linenumber * 0.15 = 0 AS exact_match FROM lineitem WHERE l_linenumber <> 4""")
def oracle_match(spark, sf_dir):
    """Numbers against the truth: lengths with a slack of 0.6, others exactly."""
    want, off = F.col("l_extendedprice").cast("double"), F.col("l_linenumber") * 0.15
    t = table(spark, sf_dir, "lineitem").filter("l_linenumber <> 4")
    return t.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("n"), gd.same_number(want, want + off, True).alias("metres_match"), gd.same_number(F.lit(0.0), off).alias("exact_match"))


MODELS = {"m0": "fast", "m1": "vision"}


@query(f"""WITH {ITEMS}, m AS (SELECT DISTINCT CASE WHEN user_id % 5 = 0 THEN 'lab/m' || (user_id % 7) ELSE 'm' || (user_id % 7) END AS model FROM events)
SELECT model, CASE WHEN model = 'm0' THEN 'fast' WHEN model = 'm1' THEN 'vision' WHEN contains(model, '/') THEN 'gateway' ELSE 'unknown' END AS provider FROM m""")
def model_registry(spark, sf_dir):
    """Provider of a model: by a table, else by the form of its id."""
    five = F.col("user_id") % 5 == 0
    model = F.concat(F.when(five, "lab/m").otherwise("m"), (F.col("user_id") % 7).cast("string"))
    known = F.create_map(*[F.lit(x) for pair in MODELS.items() for x in pair])
    m = table(spark, sf_dir, "events").select(model.alias("model")).distinct()
    return m.select("model", F.coalesce(F.try_element_at(known, F.col("model")), F.when(F.contains("model", F.lit("/")), "gateway").otherwise("unknown")).alias("provider"))


@query(f"""WITH {ITEMS} SELECT scene, count(DISTINCT question) * count(DISTINCT arm) * 3 AS calls, count(DISTINCT question) * count(DISTINCT arm) * 3 <= 200 AS admitted FROM items GROUP BY 1""")
def call_cap(spark, sf_dir):
    """Calls that a run would make by scene, and whether a cap lets it start."""
    n = F.count_distinct("question") * F.count_distinct("arm") * 3
    return items(spark, sf_dir).groupBy("scene").agg(n.alias("calls"), (n <= 200).alias("admitted"))


@query("SELECT n_name AS name, CASE WHEN contains(lower(t), 'united kingdom') THEN 'united kingdom' WHEN contains(lower(t), 'united states') THEN 'united states' WHEN contains(lower(t), 'indonesia') THEN 'indonesia' WHEN contains(lower(t), 'united') THEN 'united' WHEN contains(lower(t), 'india') THEN 'india' WHEN contains(lower(t), 'iran') THEN 'iran' WHEN contains(lower(t), 'ind') THEN 'ind' END AS city FROM (SELECT n_name, '12 main street, ' || n_name AS t FROM nation)")
def city_lookup(spark, sf_dir):
    """The longest known name that an address holds."""
    names = ["india", "united", "ind", "united kingdom", "iran", "united states", "indonesia"]
    t = F.concat(F.lit("12 main street, "), "n_name")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), tx.longest_first(t, names).alias("city"))


@query("SELECT s_suppkey AS id, CAST(regexp_extract('CL-' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || '-x9', '^CL-0*([0-9]+)', 1) AS INT) AS number FROM supplier WHERE s_suppkey < 1000")
def index_from_id(spark, sf_dir):
    code = F.concat(F.lit("CL-"), tx.padded(F.col("s_suppkey"), 3), F.lit("-x9"))
    return table(spark, sf_dir, "supplier").filter("s_suppkey < 1000").select(F.col("s_suppkey").alias("id"), F.regexp_extract(code, "^CL-0*([0-9]+)", 1).cast("int").alias("number"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN '(road, touches, river)' ELSE '(b, in, c)' END AS triple FROM part")
def last_triple(spark, sf_dir):
    """The last relation that a text names."""
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, "nothing (here)").when(k == 1, "(a, in, b) then (road, touches, river).").otherwise("x (b, in, c) and (d, e)")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.last_triple(text).alias("triple"))


@query("SELECT p_partkey AS id, CAST(regexp_extract(t, '=([0-9.]+)', 1) AS DOUBLE) AS dist, regexp_extract(t, 'nearest:([A-Za-z0-9-]+)', 1) AS nearest, regexp_extract_all(t, '([A-Z]+-[0-9]+)[(]', 1)[2] AS second FROM (SELECT p_partkey, 'nearest:CL-' || p_partkey || ' | ranked: CL-' || p_partkey || '(a)=' || (p_partkey % 50) || '.5, CL-' || (p_partkey + 1) || '(b)=99.0 | excluded:[]' AS t FROM part)")
def result_parsers(spark, sf_dir):
    """What a line of the geometry executor says, read back."""
    key = lambda k: (F.col("p_partkey") + k).cast("string")
    t = F.concat(F.lit("nearest:CL-"), key(0), F.lit(" | ranked: CL-"), key(0), F.lit("(a)="), (F.col("p_partkey") % 50).cast("string"), F.lit(".5, CL-"), key(1), F.lit("(b)=99.0 | excluded:[]"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), t.alias("t"))
    ids = F.regexp_extract_all("t", F.lit(r"([A-Z]+-[0-9]+)[(]"), F.lit(1))
    return p.select("id", F.regexp_extract("t", "=([0-9.]+)", 1).cast("double").alias("dist"), F.regexp_extract("t", "nearest:([A-Za-z0-9-]+)", 1).alias("nearest"), F.get(ids, F.lit(1)).alias("second"))




@query(f"""{W}, k AS (SELECT id, length, CASE CAST(ord % 4 AS INT) WHEN 0 THEN 'sidewalk' WHEN 1 THEN 'road_crossing' WHEN 2 THEN 'aerial_span' ELSE 'conduit' END AS kind FROM cables)
SELECT id, kind, round(length * CASE kind {' '.join(f"WHEN '{n}' THEN {c[0]}" for n, c in EDGE_COSTS.items())} END, 6) AS underground, round(length * CASE kind {' '.join(f"WHEN '{n}' THEN {c[1]}" for n, c in EDGE_COSTS.items())} END, 6) AS aerial FROM k""")
def edge_costs(spark, sf_dir):
    """Costs of an edge by its kind and the way it is built."""
    kind = F.element_at(F.array(*map(F.lit, EDGE_COSTS)), (F.col("ord") % 4 + 1).cast("int"))
    rate = lambda i: F.element_at(F.create_map(*[F.lit(x) for n, c in EDGE_COSTS.items() for x in (n, c[i])]), F.col("kind"))
    c = cables(spark, sf_dir).withColumn("kind", kind)
    return c.select("id", "kind", F.round(F.col("length") * rate(0), 6).alias("underground"), F.round(F.col("length") * rate(1), 6).alias("aerial"))


@query(f"""{W}, u AS (SELECT source, CAST(sum(ceil(fibres / 12.0)) AS BIGINT) AS tubes, CAST(sum(fibres) AS BIGINT) AS fibres, count(*) FILTER (id LIKE 'x-%') AS homes FROM cables GROUP BY 1)
SELECT n.id AS closure, tubes, u.fibres, CAST(substr(ratio, 3) AS BIGINT) > homes AS can_connect FROM u JOIN nodes n ON n.id = u.source WHERE n.ratio IS NOT NULL""")
def downstream_fibres(spark, sf_dir):
    """Tubes of twelve that the cables below a device with a splitter need, and whether a port is left for one more house."""
    c, homes = cables(spark, sf_dir), F.count_if(F.col("id").startswith("x-"))
    use = c.groupBy(F.col("source").alias("closure")).agg(F.sum(F.ceil(F.col("fibres") / 12)).alias("tubes"), F.sum("fibres").cast("long").alias("fibres"), homes.alias("homes"))
    ways = nodes(spark, sf_dir).filter("ratio IS NOT NULL").select(F.col("id").alias("closure"), tx.splitter_ways(F.col("ratio")).alias("ways"))
    return use.join(ways, "closure").select("closure", "tubes", "fibres", (F.col("ways") > F.col("homes")).alias("can_connect"))


@query(f"""{W}, f AS (SELECT id AS cable, unnest(range(1, fibres + 1)) AS fibre FROM cables) SELECT cable, count(*) FILTER (fibre % 12 IN (1, 2)) AS spliced, count(*) FILTER (fibre % 12 IN (3, 4, 5)) AS passing, count(*) FILTER (fibre % 12 NOT IN (1, 2, 3, 4, 5)) AS reserve FROM f GROUP BY 1""")
def fibre_usage(spark, sf_dir):
    """Fibres of a cable by use: a row per fibre, then counts by what it is for."""
    f = cables(spark, sf_dir).select(F.col("id").alias("cable"), F.explode(F.sequence(F.lit(1), F.col("fibres"))).alias("fibre")).withColumn("k", F.col("fibre") % 12)
    return f.groupBy("cable").agg(F.count_if(F.col("k").isin(1, 2)).alias("spliced"), F.count_if(F.col("k").isin(3, 4, 5)).alias("passing"), F.count_if(~F.col("k").isin(1, 2, 3, 4, 5)).alias("reserve"))


@query(f"{W} SELECT CASE WHEN id LIKE 'cl-%0' THEN 'house' WHEN id LIKE 'h-%7' THEN 'closure' ELSE type END AS element, count(*) AS n FROM nodes GROUP BY 1")
def element_types(spark, sf_dir):
    """Kinds of elements of nodes; dens are closures, poles and kinds that are not known count as houses."""
    kind = F.when(F.col("id").rlike("^cl-.*0$"), F.when(F.col("id").rlike("[02468]0$"), "pole").otherwise("splice box")).when(F.col("id").rlike("^h-.*7$"), "den").otherwise(F.col("type"))
    return nodes(spark, sf_dir).groupBy(tx.element_type(kind).alias("element")).agg(F.count("*").alias("n"))


ISSUES = f"""{W}, i AS (SELECT 'cable_too_long' AS type, id, source AS near_ FROM net WHERE length > CASE tier WHEN 'drop' THEN 100 WHEN 'distribution' THEN 500 ELSE 2000 END
 UNION ALL SELECT 'disconnected_node', id, id FROM nodes WHERE id NOT IN (SELECT source FROM cables UNION ALL SELECT target FROM cables)
 UNION ALL SELECT 'optical_budget_exceeded', house, cabinet FROM paths WHERE w1 * w2 > 64 UNION ALL SELECT 'cascade_exceeded', id, id FROM net WHERE tier = 'feeder' AND length > 9000),
z AS (SELECT *, 'Z' || regexp_extract(near_, '([0-9]+)$', 1) AS zone FROM i)"""


@query(f"""{ISSUES} SELECT zone, type, id, zone || '-' || substr(replace(upper(type), '_', '-'), 1, 10) || '-' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') AS issue,
CASE type WHEN 'optical_budget_exceeded' THEN 'change_splitter_ratio' WHEN 'disconnected_node' THEN 'reassign_house' WHEN 'cascade_exceeded' THEN 'add_node' END AS fix
FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY type, id) AS n FROM z)""")
def issue_ids(spark, sf_dir):
    """Issues of each zone with their ids (zone, kind cut to ten characters, number in the zone) and the tool that mends them, if any.
    A zone is named by the number of the node that an issue lies at."""
    most = F.when(F.col("tier") == "drop", 100).when(F.col("tier") == "distribution", 500).otherwise(2000)
    n, all_ = net(spark, sf_dir), nodes(spark, sf_dir)
    used = cables(spark, sf_dir).select(F.explode(F.array("source", "target")).alias("id")).distinct()
    kind = lambda df, name, ident, at: df.select(F.lit(name).alias("type"), F.col(ident).alias("id"), F.col(at).alias("near"))
    i = kind(n.filter(F.col("length") > most), "cable_too_long", "id", "source")
    i = i.unionByName(kind(all_.join(used, "id", "left_anti"), "disconnected_node", "id", "id"))
    i = i.unionByName(kind(paths(spark, sf_dir).filter("w1 * w2 > 64"), "optical_budget_exceeded", "house", "cabinet"))
    i = i.unionByName(kind(n.filter("tier = 'feeder' AND length > 9000"), "cascade_exceeded", "id", "id"))
    z = i.withColumn("zone", F.concat(F.lit("Z"), F.regexp_extract("near", "([0-9]+)$", 1)))
    number = F.row_number().over(Window.partitionBy("zone").orderBy("type", "id"))
    code = F.substring(F.replace(F.upper("type"), F.lit("_"), F.lit("-")), 1, 10)
    fix = F.when(F.col("type") == "optical_budget_exceeded", "change_splitter_ratio").when(F.col("type") == "disconnected_node", "reassign_house").when(F.col("type") == "cascade_exceeded", "add_node")
    return z.select("zone", "type", "id", F.concat_ws("-", "zone", code, tx.padded(number, 3)).alias("issue"), fix.alias("fix"))


@query(f"{W}, h AS (SELECT x.target AS house, 'house ' || x.target || ' <- ' || x.source || ' <- ' || d.source || ' <- ' || f.source AS path, 3 AS hops FROM cables x JOIN cables d ON d.target = x.source JOIN cables f ON f.target = d.source) SELECT house, path, hops FROM h")
def path_hops(spark, sf_dir):
    """The way from a house to its central office as text, with its number of cables."""
    up = cables(spark, sf_dir).select("source", "target")
    x = up.filter(F.col("target").startswith("h-")).select(F.col("target").alias("house"), F.col("source").alias("s1"))
    x = x.join(up.select(F.col("target").alias("s1"), F.col("source").alias("s2")), "s1").join(up.select(F.col("target").alias("s2"), F.col("source").alias("s3")), "s2")
    arrow = F.lit(" <- ")
    return x.select("house", F.concat(F.lit("house "), "house", arrow, "s1", arrow, "s2", arrow, "s3").alias("path"), F.lit(3).alias("hops"))


@query(f"""{W}, r AS (SELECT co AS root, house FROM paths) SELECT n.id, CASE WHEN n.type = 'co' THEN 'source' WHEN r.house IS NOT NULL THEN 'reached' WHEN EXISTS (SELECT 1 FROM cables c WHERE c.target = n.id) THEN 'on the way' ELSE 'no cable' END AS reason
FROM nodes n LEFT JOIN r ON r.house = n.id""")
def reachability(spark, sf_dir):
    """Whether a node is fed, and why not."""
    c = cables(spark, sf_dir).select(F.col("target").alias("id")).distinct().withColumn("fed", F.lit(True))
    n = nodes(spark, sf_dir).join(c, "id", "left")
    reason = F.when(F.col("type") == "co", "source").when((F.col("type") == "house") & F.col("fed"), "reached").when(F.col("fed"), "on the way").otherwise("no cable")
    return n.select("id", reason.alias("reason"))


@query(f"""{W}, s AS (SELECT n.id, coalesce(c.n, 0) AS n FROM nodes n LEFT JOIN (SELECT k, count(*) AS n FROM (SELECT source AS k FROM cables UNION ALL SELECT target FROM cables) GROUP BY 1) c ON c.k = n.id)
SELECT count(*) AS nodes, (SELECT count(*) FROM cables) AS edges, round(avg(n), 6) AS mean_degree, count(*) FILTER (n = 0) AS isolated, (SELECT min(length) FROM cables) AS shortest, (SELECT max(length) FROM cables) AS longest, (SELECT round(avg(length), 6) FROM cables) AS mean_length FROM s""")
def graph_figures(spark, sf_dir):
    """Size, degrees and edge lengths of the network."""
    c = cables(spark, sf_dir)
    ends = c.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    s = nodes(spark, sf_dir).select("id").join(ends, "id", "left").fillna(0, ["n"])
    own = s.agg(F.count("*").alias("nodes"), F.round(F.avg("n"), 6).alias("mean_degree"), F.count_if(F.col("n") == 0).alias("isolated"))
    edge = c.agg(F.count("*").alias("edges"), F.min("length").alias("shortest"), F.max("length").alias("longest"), F.round(F.avg("length"), 6).alias("mean_length"))
    return own.join(F.broadcast(edge))  # a row with a row


@query(f"{W} SELECT a.id, CASE WHEN a.n > 1 THEN 'add' ELSE 'keep' END AS change, a.n - 1 AS spare FROM (SELECT target AS id, count(*) AS n FROM (SELECT target FROM cables UNION ALL SELECT source FROM cables) GROUP BY 1) a")
def port_changes(spark, sf_dir):
    """What port updates a node needs from how many cables meet there."""
    ends = cables(spark, sf_dir).select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return ends.select("id", F.when(F.col("n") > 1, "add").otherwise("keep").alias("change"), (F.col("n") - 1).alias("spare"))
