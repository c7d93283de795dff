"""Text documents of networks and runs, a row per document or line: inventories, trees, splice charts, prompts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import text as tx
from terrane.plans.evaluation import ITEMS, items
from terrane.plans.network import NET, _db, _db_sql, cables, net, paths
from terrane.sources import scenes as sc
from terrane.sources.scenes import SCENE_SQL, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
W, S = f"WITH {NET}", f"WITH {SCENE_SQL}"
NL = "chr(10)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def lines_of(df: DataFrame, keys: list[str], line: Column, *order: str, between: str = "\n", name: str = "text") -> DataFrame:
    """One text by keys: the lines of a group in order. A group is a document and as long as one."""
    own = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(own, lambda s: s["line"]), between).alias(name))


def _int(c: str) -> Column:
    return F.col(c).cast("long").cast("string")


@query(f"{W} SELECT source, string_agg(upper(tier) || ' ' || id || ' -> ' || target || ' (' || CAST(length AS BIGINT) || 'm, ' || fibres || 'F)', {NL} ORDER BY id) AS text FROM net WHERE tier <> 'drop' GROUP BY 1")
def cable_inventory_text(spark, sf_dir):
    """Cables by the node that they leave, a line each."""
    n = net(spark, sf_dir).filter("tier <> 'drop'")
    line = F.concat(F.upper("tier"), F.lit(" "), "id", F.lit(" -> "), "target", F.lit(" ("), _int("length"), F.lit("m, "), F.col("fibres").cast("string"), F.lit("F)"))
    return lines_of(n, ["source"], line, "id")


@query(f"{W}, a AS (SELECT source AS closure, count(*) AS n, string_agg(target, ', ' ORDER BY ord) AS houses, CAST(sum(length) AS BIGINT) AS m FROM cables WHERE id LIKE 'x-%' GROUP BY 1) SELECT closure, closure || ' serves ' || n || ' houses (' || m || ' m of drops): ' || houses AS text FROM a")
def closure_assignment_text(spark, sf_dir):
    """Each closure with the houses that it serves."""
    c = cables(spark, sf_dir).filter(F.col("id").startswith("x-"))
    own = F.array_sort(F.collect_list(F.struct("ord", "target")))
    a = c.groupBy(F.col("source").alias("closure")).agg(F.count("*").cast("string").alias("n"), F.array_join(F.transform(own, lambda s: s["target"]), ", ").alias("houses"), F.sum("length").cast("long").cast("string").alias("m"))
    return a.select("closure", F.concat("closure", F.lit(" serves "), "n", F.lit(" houses ("), "m", F.lit(" m of drops): "), "houses").alias("text"))


@query(f"""{W}, t AS (SELECT f.source AS co, 1 AS d, f.target AS k, '+- ' || f.target AS line FROM cables f WHERE f.id LIKE 'f-%'
UNION ALL SELECT f.source, 2, f.target || '/' || c.target, '   +- ' || c.target FROM cables f JOIN cables c ON c.source = f.target WHERE f.id LIKE 'f-%')
SELECT co, co || {NL} || string_agg(line, {NL} ORDER BY k, d) AS text FROM t GROUP BY 1""")
def hierarchy_tree(spark, sf_dir):
    """Cabinets and closures under each central office as an indented tree."""
    c = cables(spark, sf_dir)
    f = c.filter(F.col("id").startswith("f-")).select(F.col("source").alias("co"), F.col("target").alias("cab"))
    top = f.select("co", F.col("cab").alias("k"), F.lit(1).alias("d"), F.concat(F.lit("+- "), "cab").alias("line"))
    under = f.join(c.select(F.col("source").alias("cab"), "target"), "cab").select("co", F.concat_ws("/", "cab", "target").alias("k"), F.lit(2).alias("d"), F.concat(F.lit("   +- "), "target").alias("line"))
    text = lines_of(top.unionByName(under), ["co"], F.col("line"), "k", "d")
    return text.select("co", F.concat("co", F.lit("\n"), "text").alias("text"))


COLOURS = "['blue', 'orange', 'green', 'brown', 'slate', 'white', 'red', 'black', 'yellow', 'violet', 'rose', 'aqua']"


@query(f"""{W}, f AS (SELECT source, id, target, unnest(range(1, fibres + 1)) AS k FROM cables WHERE id LIKE 'd-%')
SELECT id AS cable, string_agg('T' || ((k - 1) // 12 + 1) || ' F' || lpad(CAST(k AS VARCHAR), 2, '0') || ' ' || ({COLOURS})[CAST((k - 1) % 12 + 1 AS INT)] || CASE WHEN k <= 2 THEN ' => splitter' ELSE ' => through' END, {NL} ORDER BY k) AS text FROM f GROUP BY 1""")
def splice_chart(spark, sf_dir):
    """Splice chart of a distribution cable: tube, fibre, colour and where it goes."""
    f = cables(spark, sf_dir).filter(F.col("id").startswith("d-")).select(F.col("id").alias("cable"), F.explode(F.sequence(F.lit(1), F.col("fibres"))).alias("k"))
    tube = (F.floor((F.col("k") - 1) / 12) + 1).cast("string")
    line = F.concat(F.lit("T"), tube, F.lit(" F"), tx.padded(F.col("k"), 2), F.lit(" "), tx.fibre_colour(F.col("k")), F.when(F.col("k") <= 2, " => splitter").otherwise(" => through"))
    return lines_of(f, ["cable"], line, "k")


@query(f"""{W}, p AS (SELECT house, closure, cabinet, co, metres, {_db_sql('twin')} AS db FROM paths) SELECT house, co || ' -> ' || cabinet || ' -> ' || closure || ' -> ' || house || ': ' || CAST(metres AS BIGINT) || ' m ' || CASE WHEN db >= 27 THEN '[!!]' WHEN db >= 25 THEN '[!]' ELSE '[ok]' END AS text FROM p""")
def optical_path_text(spark, sf_dir):
    """The way of light to a house with a mark for its loss."""
    mark = F.when(F.col("db") >= 27, "[!!]").when(F.col("db") >= 25, "[!]").otherwise("[ok]")
    p = paths(spark, sf_dir).withColumn("db", _db("twin"))
    return p.select("house", F.concat(F.concat_ws(" -> ", "co", "cabinet", "closure", "house"), F.lit(": "), _int("metres"), F.lit(" m "), mark).alias("text"))


@query(f"{W}, p AS (SELECT closure, {_db_sql('closure')} AS db FROM paths) SELECT s.s_suppkey AS supplier, coalesce(max(p.db), 0) AS max_db FROM supplier s LEFT JOIN p ON p.closure = 'cl-' || s.s_suppkey GROUP BY 1")
def max_zone_loss(spark, sf_dir):
    """Largest loss below a closure; 0 where nothing is."""
    p = paths(spark, sf_dir).select("closure", _db("closure").alias("db"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), F.concat(F.lit("cl-"), F.col("s_suppkey").cast("string")).alias("closure"))
    return s.join(p, "closure", "left").groupBy("supplier").agg(F.coalesce(F.max("db"), F.lit(0)).alias("max_db"))


@query(f"""{W}, v AS (SELECT source AS closure, count(*) AS n, count(*) FILTER (length > 100) AS long_, min(target) AS first FROM cables WHERE id LIKE 'x-%' GROUP BY 1)
SELECT closure, '# Closure ' || closure || {NL} || '- houses: ' || n || {NL} || '- long drops: ' || long_ || {NL} || '- photo: ' || closure || '/front.jpg' AS markdown FROM v""")
def closure_markdown(spark, sf_dir):
    """A closure's sheet to be checked on site."""
    v = cables(spark, sf_dir).filter(F.col("id").startswith("x-")).groupBy(F.col("source").alias("closure")).agg(F.count("*").cast("string").alias("n"), F.count_if(F.col("length") > 100).cast("string").alias("long"))
    return v.select("closure", F.concat_ws("\n", F.concat(F.lit("# Closure "), "closure"), F.concat(F.lit("- houses: "), "n"), F.concat(F.lit("- long drops: "), "long"), F.concat(F.lit("- photo: "), "closure", F.lit("/front.jpg"))).alias("markdown"))


@query(f"""{S}, b AS (SELECT scene_id, CAST(floor(max(x) / 0.002) - floor(min(x) / 0.002) + 1 AS BIGINT) AS w, CAST(floor(max(y) / 0.002) - floor(min(y) / 0.002) + 1 AS BIGINT) AS h FROM pts GROUP BY 1)
SELECT scene_id, r AS row, lpad(CAST(r AS VARCHAR), 3, ' ') || ' |' || repeat('.', w) || '|' AS line FROM (SELECT scene_id, w, unnest(range(h)) AS r FROM b)""")
def empty_grid(spark, sf_dir):
    """Framed rows of an empty grid over a scene, numbered from the north."""
    span = lambda c: (F.floor(F.max(c) / 0.002) - F.floor(F.min(c) / 0.002) + 1).cast("int")
    b = sc.points(spark, sf_dir).groupBy("scene_id").agg(span("x").alias("w"), span("y").alias("h"))
    b = b.select("scene_id", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("row"))
    line = F.concat(F.lpad(F.col("row").cast("string"), 3, " "), F.lit(" |"), F.repeat(F.lit("."), F.col("w")), F.lit("|"))
    return b.select("scene_id", F.col("row").cast("long").alias("row"), line.alias("line"))


@query(f"{S} SELECT id, round(x, 5) AS lng, round(y, 5) AS lat FROM pts")
def parse_node_ids(spark, sf_dir):
    """Coordinates read back from the ids of nodes."""
    five = lambda c: F.format_string("%.5f", F.round(c, 5))
    node = sc.points(spark, sf_dir).select("id", F.concat(five("x"), F.lit(","), five("y")).alias("node"))
    part = lambda i: F.get(F.split("node", ","), F.lit(i)).cast("double")
    return node.select("id", part(0).alias("lng"), part(1).alias("lat"))


HINTS = {"json": "Read the JSON scene.", "wkt": "Read the WKT table.", "view": "Read the picture."}


@query(f"""WITH {ITEMS} SELECT DISTINCT arm, question, CASE arm WHEN 'view' THEN 'Read the picture.' ELSE 'Answer from the data.' END || ' Question ' || question || ' of ' || category || '. Cite ids.' || CASE WHEN category = 'c3' THEN ' Say what is missing.' ELSE '' END AS prompt FROM items""")
def prompts(spark, sf_dir):
    """Prompts by arm and question: a hint of the arm, the question, and what is asked of the answer."""
    known = F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair])
    hint = F.coalesce(F.try_element_at(known, F.col("arm")), F.lit("Answer from the data."))
    text = F.concat(hint, F.lit(" Question "), "question", F.lit(" of "), "category", F.lit(". Cite ids."), F.when(F.col("category") == "c3", " Say what is missing.").otherwise(""))
    return items(spark, sf_dir).select("arm", "question", text.alias("prompt")).distinct()


@query(f"""WITH {ITEMS}, s AS (SELECT arm, count(*) AS n, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS c FROM items GROUP BY 1)
SELECT '| ' || arm || ' | ' || n || ' | ' || c || ' | ' || CAST(floor(100.0 * c / n + 0.5) AS BIGINT) || ' % |' AS line, arm FROM s""")
def report_table(spark, sf_dir):
    """The lines of a run's report in Markdown, an arm each."""
    s = items(spark, sf_dir).groupBy("arm").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("c"))
    share = F.floor(100.0 * F.col("c") / F.col("n") + 0.5).cast("string")
    return s.select(F.concat(F.lit("| "), "arm", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.col("c").cast("string"), F.lit(" | "), share, F.lit(" % |")).alias("line"), "arm")


@query("""WITH n AS (SELECT c_nationkey AS zone, c_custkey AS ord, '- ' || CASE WHEN c_custkey % 3 = 0 THEN 'issue' ELSE 'note' END || ': ' || c_mktsegment AS entry, c_custkey % 3 = 0 AS issue FROM customer WHERE c_custkey % 10 = 0)
SELECT zone, '## Issues' || chr(10) || coalesce(string_agg(entry, chr(10) ORDER BY ord) FILTER (issue), '') || chr(10) || '## Notes' || chr(10) || coalesce(string_agg(entry, chr(10) ORDER BY ord) FILTER (NOT issue), '') AS memory FROM n GROUP BY 1""")
def project_memory(spark, sf_dir):
    """A project's memory as Markdown with its entries in their sections."""
    c = table(spark, sf_dir, "customer").filter("c_custkey % 10 = 0")
    issue = F.col("c_custkey") % 3 == 0
    n = c.select(F.col("c_nationkey").alias("zone"), F.col("c_custkey").alias("ord"), issue.alias("issue"), F.concat(F.lit("- "), F.when(issue, "issue").otherwise("note"), F.lit(": "), "c_mktsegment").alias("entry"))
    part = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "entry")))), lambda s: s["entry"]), "\n")
    return n.groupBy("zone").agg(F.concat(F.lit("## Issues\n"), part(F.col("issue")), F.lit("\n## Notes\n"), part(~F.col("issue"))).alias("memory"))


#: Fixed values of addresses of static maps: where they begin and end, the longest that is served, and the marks of closures.
MAP_BASE, MAP_TAIL, LONGEST_URL, PIN_LETTERS = "https://api.mapbox.com/styles/v1/mapbox/light-v11/static", "/auto/700x500@2x?access_token=TOKEN&padding=30", 8000, "abcdefghijklmnopqrstuvwxyz"


def _five(c) -> Column:
    """A coordinate as text, rounded half up to five decimals."""
    return F.regexp_replace((F.floor(c * 100000 + 0.5) / 100000).cast("string"), r"\.0$", "")


def _joined(c: str, order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda s: s[c]), ",")


_R5 = "regexp_replace(CAST(floor(({}) * 100000 + 0.5) / 100000 AS VARCHAR), '\\.0$', '')"
_PAIR = lambda x, y: f"'[' || {_R5.format(x)} || ',' || {_R5.format(y)} || ']'"
_FEATURE = lambda kind, parts: f"""'{{{{"type":"Feature","geometry":{{{{"type":"{kind}","coordinates":[' || {parts} || ']}}}},"properties":{{{{}}}}}}}}'""".replace("{{", "{").replace("}}", "}")


@query(f"""{S},
b AS (SELECT scene_id, {_FEATURE('MultiPolygon', f"string_agg('[[' || {_PAIR('x0', 'y0')} || ',' || {_PAIR('x1', 'y0')} || ',' || {_PAIR('x1', 'y1')} || ',' || {_PAIR('x0', 'y1')} || ',' || {_PAIR('x0', 'y0')} || ']]', ',' ORDER BY id)")} AS f,
      string_agg('pin-s' || CASE WHEN id <= 99 THEN '-' || id ELSE '' END || '+00f(' || {_R5.format('x')} || ',' || {_R5.format('y')} || ')', ',' ORDER BY id) AS pins FROM bld GROUP BY 1),
s AS (SELECT scene_id, {_FEATURE('MultiLineString', f"string_agg('[' || {_PAIR('x', 'y')} || ',' || {_PAIR('bx', 'ey')} || ']', ',' ORDER BY street_id)")} AS f FROM st GROUP BY 1),
c AS (SELECT scene_id, {_FEATURE('MultiLineString', f"string_agg('[' || {_PAIR('x', 'y')} || ',' || {_PAIR('bx', 'ey')} || ']', ',' ORDER BY source)")} AS f FROM dist GROUP BY 1),
q AS (SELECT *, count(*) FILTER (kind <> 'co') OVER (PARTITION BY scene_id ORDER BY id) AS n FROM eq),
e AS (SELECT scene_id, string_agg(CASE WHEN kind = 'co' THEN 'pin-s-star+f00(' WHEN n <= 26 THEN 'pin-s-' || substr('{PIN_LETTERS}', CAST(n AS INT), 1) || '+0a0(' ELSE 'pin-s+0a0(' END || {_R5.format('x')} || ',' || {_R5.format('y')} || ')', ',' ORDER BY id) AS pins FROM q GROUP BY 1),
g AS (SELECT DISTINCT scene_id FROM pts), a AS (SELECT scene_id, b.f AS b, s.f AS s, c.f AS c, concat_ws(',', e.pins, b.pins) AS pins FROM g LEFT JOIN b USING (scene_id) LEFT JOIN s USING (scene_id) LEFT JOIN c USING (scene_id) LEFT JOIN e USING (scene_id)),
t AS (SELECT scene_id, pins, unnest([{{'tier': 1, 'f': concat_ws(',', b, s, c)}}, {{'tier': 2, 'f': concat_ws(',', b, c)}}, {{'tier': 3, 'f': coalesce(c, '')}}, {{'tier': 5, 'f': ''}}]) AS k FROM a),
u AS (SELECT scene_id, k.tier AS tier, '{MAP_BASE}/' || CASE WHEN k.f = '' THEN pins ELSE 'geojson(' || url_encode('{{"type":"FeatureCollection","features":[' || k.f || ']}}') || '),' || pins END || '{MAP_TAIL}' AS url FROM t)
SELECT scene_id, CAST(arg_min(tier, tier) AS INT) AS tier, CAST(length(arg_min(url, tier)) AS INT) AS length, md5(arg_min(url, tier)) AS digest FROM u WHERE length(url) <= {LONGEST_URL} GROUP BY 1""")
def map_tier(spark, sf_dir):
    """The address of each scene's static map: all shapes, else without streets, else cables alone, else pins alone (tiers 1, 2, 3, 5; a
    straight cable cannot be thinned, so tier 4 is tier 3), the first that is no longer than LONGEST_URL; no row if none is."""
    pair = lambda x, y: F.concat(F.lit("["), _five(x), F.lit(","), _five(y), F.lit("]"))
    chain = lambda *p: F.concat_ws(",", *p)
    feature = lambda kind, c: F.concat(F.lit(f'{{"type":"Feature","geometry":{{"type":"{kind}","coordinates":['), c, F.lit(']},"properties":{}}'))
    x, y = F.col("x"), F.col("y")
    wrapped = lambda a, t, b: F.concat(F.lit(a), t, F.lit(b))
    b = sc.buildings(spark, sf_dir)
    ring = wrapped("[[", F.array_join(F.transform("footprint", lambda v: pair(v["x"], v["y"])), ","), "]]")
    at = F.concat(F.lit("("), _five(x), F.lit(","), _five(y), F.lit(")"))
    pin = F.concat(F.lit("pin-s"), F.when(F.col("id") <= 99, F.concat(F.lit("-"), F.col("id").cast("string"))).otherwise(""), F.lit("+00f"), at)
    b = b.withColumns({"shape": ring, "pin": pin}).groupBy("scene_id").agg(feature("MultiPolygon", _joined("shape", "id")).alias("b"), _joined("pin", "id").alias("b_pins"))
    line = wrapped("[", chain(pair(x, y), pair(F.col("bx"), F.col("by"))), "]")
    lines = lambda df, order, name: df.withColumn("shape", line).groupBy("scene_id").agg(feature("MultiLineString", _joined("shape", order)).alias(name))
    s, c = lines(sc.streets(spark, sf_dir), "street_id", "s"), lines(sc.distribution(spark, sf_dir), "source", "c")
    nth = F.count_if(F.col("kind") != "co").over(Window.partitionBy("scene_id").orderBy("id"))
    e = sc.equipment(spark, sf_dir).withColumn("n", nth)
    mark = F.when(F.col("kind") == "co", "-star+f00").when(F.col("n") <= len(PIN_LETTERS), F.concat(F.lit("-"), F.substr(F.lit(PIN_LETTERS), F.col("n").cast("int"), F.lit(1)), F.lit("+0a0"))).otherwise("+0a0")
    e = e.withColumn("pin", F.concat(F.lit("pin-s"), mark, at)).groupBy("scene_id").agg(_joined("pin", "id").alias("e_pins"))
    a = sc.points(spark, sf_dir).select("scene_id").distinct()
    for part in (b, s, c, e):
        a = a.join(part, "scene_id", "left")
    pins = chain("e_pins", "b_pins")
    url = lambda f: F.concat(F.lit(MAP_BASE + "/"), F.when(f == "", pins).otherwise(F.concat(F.lit("geojson("), F.url_encode(wrapped('{"type":"FeatureCollection","features":[', f, "]}")), F.lit("),"), pins)), F.lit(MAP_TAIL))
    tiers = F.array(*[F.struct(F.lit(k).alias("tier"), url(f).alias("url")) for k, f in ((1, chain("b", "s", "c")), (2, chain("b", "c")), (3, F.coalesce("c", F.lit(""))), (5, F.lit("")))])
    first = F.get(F.filter(tiers, lambda t: F.length(t["url"]) <= LONGEST_URL), F.lit(0))
    out = a.withColumn("t", first).filter("t IS NOT NULL")
    return out.select("scene_id", "t.tier", F.length("t.url").alias("length"), F.md5("t.url").alias("digest"))


#: Symbols of cables by tier, along and down, and of numbered houses.
CABLE_SYMBOLS = {"feeder": ("═", "║"), "distribution": ("─", "│"), "drop": ("·", ":")}
HOUSE_SYMBOLS = "⓪①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳㉑㉒㉓㉔㉕㉖㉗㉘㉙㉚㉛㉜㉝㉞㉟㊱㊲㊳㊴㊵㊶㊷㊸㊹㊺㊻㊼㊽㊾"


@query(f"""{S}, a AS (SELECT scene_id, cable_id, 'distribution' AS tier, abs(bx - x) >= abs(ey - y) AS flat FROM dist UNION ALL SELECT scene_id, 'feed-' || id, 'feeder', abs(x - {sc.LNG0}) >= abs(y - {sc.LAT0}) FROM eq WHERE kind = 'co'
 UNION ALL SELECT scene_id, 'drop-' || street_id, 'drop', abs(bx - x) >= abs(ey - y) FROM st) SELECT scene_id, cable_id, tier, CASE tier WHEN 'feeder' THEN CASE WHEN flat THEN '═' ELSE '║' END WHEN 'distribution' THEN CASE WHEN flat THEN '─' ELSE '│' END ELSE CASE WHEN flat THEN '·' ELSE ':' END END AS symbol FROM a""")
def cable_symbols(spark, sf_dir):
    """Symbol of a cable on the grid by its tier and the way it mostly runs: cables between closures, feeders from the middle of the
    map to an office, and drops along streets."""
    flat = lambda dx, dy: F.abs(dx) >= F.abs(dy)
    own = flat(F.col("bx") - F.col("x"), F.col("by") - F.col("y")).alias("flat")
    d = sc.distribution(spark, sf_dir).select("scene_id", "cable_id", F.lit("distribution").alias("tier"), own)
    f = sc.equipment(spark, sf_dir).filter("kind = 'co'").select("scene_id", F.concat(F.lit("feed-"), F.col("id").cast("string")).alias("cable_id"), F.lit("feeder").alias("tier"), flat(F.col("x") - sc.LNG0, F.col("y") - sc.LAT0).alias("flat"))
    s = sc.streets(spark, sf_dir).select("scene_id", F.concat(F.lit("drop-"), F.col("street_id").cast("string")).alias("cable_id"), F.lit("drop").alias("tier"), own)
    symbols = F.create_map(*[F.lit(x) for t, pair in CABLE_SYMBOLS.items() for i, g in zip((True, False), pair) for x in (f"{t}:{str(i).lower()}", g)])
    return d.unionByName(f).unionByName(s).select("scene_id", "cable_id", "tier", F.element_at(symbols, F.concat_ws(":", "tier", F.col("flat").cast("string"))).alias("symbol"))


@query(f"""{S}, h AS (SELECT scene_id, id, row_number() OVER (PARTITION BY scene_id ORDER BY id) AS n FROM bld)
SELECT scene_id, id, CASE WHEN n < 50 THEN substr('{HOUSE_SYMBOLS}', CAST(n + 1 AS INT), 1) ELSE '[H' || lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INT), '0') || ']' END AS symbol FROM h""")
def house_symbols(spark, sf_dir):
    """Symbol of a house by its number in the scene (from 1): a number in a circle, else the number in brackets."""
    n = F.row_number().over(Window.partitionBy("scene_id").orderBy("id"))
    h = sc.buildings(spark, sf_dir).select("scene_id", "id", n.alias("n"))
    circled = F.substr(F.lit(HOUSE_SYMBOLS), F.col("n") + 1, F.lit(1))
    return h.select("scene_id", "id", F.when(F.col("n") < len(HOUSE_SYMBOLS), circled).otherwise(F.concat(F.lit("[H"), tx.padded(F.col("n"), 2), F.lit("]"))).alias("symbol"))


@query(f"{W} SELECT count(*) AS addresses, count(*) FILTER (WHERE length <= 100) AS served, 'Served ' || count(*) FILTER (WHERE length <= 100) || ' of ' || count(*) || ' addresses' AS text FROM cables WHERE id LIKE 'x-%'")
def addresses_summary_text(spark, sf_dir):
    c = cables(spark, sf_dir).filter(F.col("id").startswith("x-"))
    a = c.agg(F.count("*").alias("addresses"), F.count_if(F.col("length") <= 100).alias("served"))
    return a.withColumn("text", F.concat(F.lit("Served "), F.col("served").cast("string"), F.lit(" of "), F.col("addresses").cast("string"), F.lit(" addresses")))
