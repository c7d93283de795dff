"""Ten families of questions on scenes: question and truth, and graded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions import random as rd
from terrane.functions.geo import P
from terrane.operators import questions as qu
from terrane.operators import spatial as sp
from terrane.operators.graph import settled
from terrane.plans.spatial import NN, SQL_IN, _sql_meets
from terrane.plans.views import NAMED, named_streets
from terrane.sources import scenes as sc
from terrane.sources.scenes import SCENE_SQL, sql_haversine

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
KINDS = ("closures", "cables", "buildings")
MARGIN_M = 15
#: Wording of each family, and the number of its sequence that chooses it: choices of rows come before.
TEMPLATES = {
    "containment": (1, ("Which devices stand inside a building?", "List every device whose place lies within a footprint.")),
    "nearest": (1, ("Which device is nearest to building {a}?", "Name the device at the least distance from building {a}.")),
    "coverage_gap": (1, ("Which buildings have no device within 35 m?", "List all buildings farther than 35 m from every device.")),
    "crossing": (1, ("Which cables run through a building?", "List every cable whose line crosses a footprint.")),
    "count_kind": (2, ("How many {a} are there?", "Count the {a} of this scene.")),
    "street_of": (2, ("On which named street is building {a}?", "Name the named street nearest to building {a}.")),
    "cable_endpoints": (2, ("Which two devices does cable {a} join?", "Give both ends of cable {a}.")),
    "degree": (2, ("How many cables end at closure {a}?", "Count the cables of closure {a}.")),
    "quadrant_of": (2, ("In which quadrant is device {a}?", "Say whether device {a} is in NE, NW, SE or SW.")),
    "dist_pair": (3, ("How far apart are devices {a} and {b}, in metres?", "Give the distance from device {a} to device {b} in metres.")),
}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _one(field: str, value: Column, quoted: bool = True) -> Column:
    mark = '"' if quoted else ""
    return F.concat(F.lit(f'{{"{field}":{mark}'), value.cast("string"), F.lit(mark + "}"))


def _list(field: str, ids: Column) -> Column:
    each = F.transform(ids, lambda i: F.concat(F.lit('"'), i.cast("string"), F.lit('"')))
    return F.concat(F.lit(f'{{"{field}":['), F.array_join(each, ","), F.lit("]}"))


def bank(spark, sf_dir) -> DataFrame:
    """(scene_id, family, question, truth). A scene without rows that a family chooses from has no question of it."""
    b, e, d = sc.buildings(spark, sf_dir), sc.equipment(spark, sf_dir), sc.distribution(spark, sf_dir)
    closures = e.filter("kind = 'closure'")
    none = F.lit(None).cast("string")

    def ask(family: str, rows: DataFrame, truth: Column, a: Column = none, b: Column = none) -> DataFrame:
        n, templates = TEMPLATES[family]
        return qu.asked(rows.select("scene_id", a.alias("a"), b.alias("b"), truth.alias("truth")), family, templates, n)

    def every(family: str, scenes: DataFrame, hits: DataFrame) -> DataFrame:
        """All hits (scene_id, id) of a scene, none included."""
        ids = hits.select("scene_id", "id").distinct().groupBy("scene_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        rows = scenes.select("scene_id").distinct().join(ids, "scene_id", "left")
        return ask(family, rows, F.coalesce(_list(qu.FAMILIES[family][0], F.col("ids")), F.lit(f'{{"{qu.FAMILIES[family][0]}":[]}}')))

    near = sp.nearest(b, e, 1).select("scene_id", "id", "other", "d")
    first = b.groupBy("scene_id").agg(F.min("id").alias("id"))
    out = every("containment", e, sp.points_in_footprints(e, b))
    out = out.unionByName(ask("nearest", near.join(first, ["scene_id", "id"]), _one("closureId", F.col("other")), _text("id")))
    out = out.unionByName(every("coverage_gap", near, near.filter("d > 35")))
    out = out.unionByName(every("crossing", d, sp.segments_through_footprints(d, b).select("scene_id", F.col("cable_id").alias("id"))))
    each = sc.points(spark, sf_dir).select("scene_id").distinct().withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), (F.floor(qu.draw("count_kind", F.col("scene_id"), 1) * len(KINDS)) + 1).cast("int")))
    counts = closures.select("scene_id", F.lit("closures").alias("kind")).union(d.select("scene_id", F.lit("cables"))).union(b.select("scene_id", F.lit("buildings"))).groupBy("scene_id", "kind").agg(F.count("*").alias("n"))
    out = out.unionByName(ask("count_kind", each.join(counts, ["scene_id", "kind"], "left"), _one("count", F.coalesce("n", F.lit(0)), False), F.col("kind")))
    out = out.unionByName(ask("street_of", qu.picked(named_streets(b, sc.streets(spark, sf_dir)), "street_of", "id"), _one("street", F.col("street")), _text("id")))
    out = out.unionByName(ask("cable_endpoints", qu.picked(d, "cable_endpoints", "source"), _list("endpoints", F.array("source", "target")), F.col("cable_id")))
    ends = d.select("scene_id", F.explode(F.array("source", "target")).alias("id")).groupBy("scene_id", "id").agg(F.count("*").alias("n"))
    chosen = qu.picked(closures, "degree", "id").join(d.select("scene_id").distinct(), "scene_id", "left_semi").join(ends, ["scene_id", "id"], "left")
    out = out.unionByName(ask("degree", chosen, _one("count", F.coalesce("n", F.lit(0)), False), _text("id")))
    middle = sc.points(spark, sf_dir).groupBy("scene_id").agg(F.avg("x").alias("ox"), F.avg("y").alias("oy"))
    placed = e.join(middle, "scene_id").withColumn("q", geo.quadrant(P(F.col("x"), F.col("y")), P(F.col("ox"), F.col("oy")), float(MARGIN_M))).filter("q IS NOT NULL")
    out = out.unionByName(ask("quadrant_of", qu.picked(placed, "quadrant_of", "id"), _one("quadrant", F.col("q")), _text("id")))
    side = lambda rows, s: rows.select("scene_id", *[F.col(c).alias(c + s) for c in ("id", "x", "y")])
    w = Window.partitionBy("scene_id")
    two = qu.picked(e, "dist_pair", "id").select("scene_id", F.col("id").alias("one"))
    other = side(qu.picked(e, "dist_pair", "id", 2), "2")
    low = e.join(two, "scene_id").filter("id <> one").withColumn("r", F.row_number().over(w.orderBy("id"))).filter("r = 1")
    pair = side(qu.picked(e, "dist_pair", "id"), "1").join(other, "scene_id").join(side(low, "3"), "scene_id")
    last = lambda c: F.when(F.col("id1") == F.col("id2"), F.col(c + "3")).otherwise(F.col(c + "2"))
    metres = F.format_string("%.1f", F.floor(geo.haversine(P(F.col("x1"), F.col("y1")), P(last("x"), last("y"))) * 10 + 0.5) / 10)
    return out.unionByName(ask("dist_pair", pair, _one("meters", metres, False), _text("id1"), last("id").cast("string")))


def _sql_draw(family: str, n: int) -> str:
    m, a = rd.jump(n)
    codes = f"list_transform(string_split('{family}|' || scene_id, ''), lambda c: CAST(ord(c) AS BIGINT))"
    state = f"greatest(1, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {codes}), lambda h, c: (xor(h, c) * 16777619) % 4294967296))"
    return f"(CAST(({m}::HUGEINT * {state} + {a}) % 4294967296 AS DOUBLE) / 4294967296)"


def _sql_pick(rows: str, family: str, order: str, n: int = 1) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {order}) - 1 AS rn, count(*) OVER (PARTITION BY scene_id) AS cnt FROM {rows}) WHERE rn = floor({_sql_draw(family, n)} * cnt))"


def _sql_every(family: str, scenes: str, hits: str) -> str:
    field = qu.FAMILIES[family][0]
    ids = "string_agg('\"' || id || '\"', ',' ORDER BY id)"
    return f"SELECT s.scene_id, NULL AS a, NULL AS b, '{{\"{field}\":[' || coalesce(l, '') || ']}}' AS truth FROM (SELECT DISTINCT scene_id FROM {scenes}) s LEFT JOIN (SELECT scene_id, {ids} AS l FROM (SELECT DISTINCT scene_id, id FROM {hits}) GROUP BY 1) h ON h.scene_id = s.scene_id"


def _sql_asked(family: str) -> str:
    n, templates = TEMPLATES[family]
    listed = ", ".join(f"'{t}'" for t in templates)
    return f"SELECT scene_id, '{family}' AS family, replace(replace(list_extract([{listed}], CAST(floor({_sql_draw(family, n)} * {len(templates)}) AS INT) + 1), '{{a}}', coalesce(a, '')), '{{b}}', coalesce(b, '')) AS question, truth FROM q_{family}"


ROWS = {
    "containment": _sql_every("containment", "eq", f"(SELECT eq.scene_id, eq.id FROM eq JOIN bld b ON b.scene_id = eq.scene_id WHERE {SQL_IN.format(p='eq')})"),
    "nearest": "SELECT scene_id, CAST(id AS VARCHAR) AS a, NULL AS b, '{\"closureId\":\"' || other || '\"}' AS truth FROM nn WHERE rank = 1 AND (scene_id, id) IN (SELECT scene_id, min(id) FROM bld GROUP BY 1)",
    "coverage_gap": _sql_every("coverage_gap", "nn", "(SELECT scene_id, id FROM nn WHERE rank = 1 AND d > 35)"),
    "crossing": _sql_every("crossing", "dist", f"(SELECT a.scene_id, a.cable_id AS id FROM dist a JOIN bld b ON a.scene_id = b.scene_id WHERE {_sql_meets('a', 'b')})"),
    "count_kind": f"""SELECT scene_id, k AS a, NULL AS b, '{{"count":' || CASE k WHEN 'closures' THEN (SELECT count(*) FROM eq WHERE eq.scene_id = s.scene_id AND kind = 'closure') WHEN 'cables' THEN (SELECT count(*) FROM dist WHERE dist.scene_id = s.scene_id) ELSE (SELECT count(*) FROM bld WHERE bld.scene_id = s.scene_id) END || '}}' AS truth
 FROM (SELECT scene_id, ['closures', 'cables', 'buildings'][CAST(floor({_sql_draw('count_kind', 1)} * 3) AS INT) + 1] AS k FROM (SELECT DISTINCT scene_id FROM pts)) s""",
    "street_of": f"SELECT scene_id, CAST(id AS VARCHAR) AS a, NULL AS b, '{{\"street\":\"' || street || '\"}}' AS truth FROM {_sql_pick('(SELECT * FROM label WHERE id % 5 <> 0)', 'street_of', 'id')}",
    "cable_endpoints": f"SELECT scene_id, cable_id AS a, NULL AS b, '{{\"endpoints\":[\"' || source || '\",\"' || target || '\"]}}' AS truth FROM {_sql_pick('dist', 'cable_endpoints', 'source')}",
    "degree": f"SELECT scene_id, CAST(id AS VARCHAR) AS a, NULL AS b, '{{\"count\":' || (SELECT count(*) FROM dist WHERE dist.scene_id = p.scene_id AND (source = p.id OR target = p.id)) || '}}' AS truth FROM {_sql_pick('''(SELECT * FROM eq WHERE kind = 'closure')''', 'degree', 'id')} p WHERE scene_id IN (SELECT scene_id FROM dist)",
    "quadrant_of": f"SELECT scene_id, CAST(id AS VARCHAR) AS a, NULL AS b, '{{\"quadrant\":\"' || q || '\"}}' AS truth FROM {_sql_pick('qd', 'quadrant_of', 'id')}",
    "dist_pair": f"""SELECT o.scene_id, CAST(o.id AS VARCHAR) AS a, CAST(t.id AS VARCHAR) AS b, '{{"meters":' || printf('%.1f', floor({sql_haversine('o.x', 'o.y', 't.x', 't.y')} * 10 + 0.5) / 10) || '}}' AS truth FROM {_sql_pick('eq', 'dist_pair', 'id')} o JOIN {_sql_pick('eq', 'dist_pair', 'id', 2)} p ON p.scene_id = o.scene_id
 JOIN eq t ON t.scene_id = o.scene_id AND t.id = CASE WHEN o.id = p.id THEN (SELECT min(id) FROM eq z WHERE z.scene_id = o.scene_id AND z.id <> o.id) ELSE p.id END""",
}
BANK = f"""WITH {SCENE_SQL}, {NN}, {NAMED}, mid AS (SELECT scene_id, avg(x) AS cx, avg(y) AS cy FROM pts GROUP BY 1),
qd AS (SELECT e.*, CASE WHEN e.y > cy THEN 'N' ELSE 'S' END || CASE WHEN e.x > cx THEN 'E' ELSE 'W' END AS q FROM eq e JOIN mid ON mid.scene_id = e.scene_id WHERE abs(e.x - cx) * 111320.0 * cos(radians(cy)) >= {MARGIN_M} AND abs(e.y - cy) * 110540.0 >= {MARGIN_M}),
{", ".join(f"q_{f} AS ({r})" for f, r in ROWS.items())}, bank AS ({" UNION ALL ".join(map(_sql_asked, ROWS))})"""


@query(f"{BANK} SELECT * FROM bank")
def bank_questions(spark, sf_dir):
    """Question and truth of ten families in every scene."""
    return bank(spark, sf_dir)


@query(f"""{BANK}, nx AS (SELECT q.*, n.truth AS other FROM bank q LEFT JOIN bank n ON n.family = q.family AND n.scene_id = q.scene_id + 1)
SELECT scene_id, family, 'truth' AS arm, true AS correct FROM bank UNION ALL SELECT scene_id, family, 'loose', family NOT IN ('street_of', 'quadrant_of') FROM bank
UNION ALL SELECT scene_id, family, 'neighbour', CASE WHEN other IS NULL THEN false WHEN family = 'dist_pair' THEN abs(CAST(json_extract(other, '$.meters') AS DOUBLE) - CAST(json_extract(truth, '$.meters') AS DOUBLE)) <= 0.6 ELSE other = truth END FROM nx""")
def bank_grades(spark, sf_dir):
    """Three answers to each question: the truth; the truth of the scene with the next number (none where that has no such question); a loose form of the truth, which is
    lists backwards, counts as text, lengths half a metre longer and texts in lower case."""
    q = settled(bank(spark, sf_dir))
    longer = F.concat(F.lit('{"meters":'), F.format_string("%.1f", F.regexp_extract("truth", r"([0-9.]+)\}", 1).try_cast("double") + 0.5), F.lit("}"))
    kind = F.create_map(*[F.lit(v) for f, (_, k) in qu.FAMILIES.items() for v in (f, k)])[F.col("family")]
    field = F.regexp_extract("truth", r'^\{"([A-Za-z]+)"', 1)
    inner = F.regexp_extract("truth", r"\[(.*)\]", 1)
    backwards = F.concat(F.lit('{"'), field, F.lit('":['), F.array_join(F.reverse(F.split(inner, ",")), ","), F.lit("]}"))
    number = F.concat(F.lit('{"count":"'), F.regexp_extract("truth", r":([0-9]+)\}", 1), F.lit('"}'))
    lower = F.concat(F.lit('{"'), field, F.lit('":'), F.lower(F.regexp_extract("truth", r':(".*")\}$', 1)), F.lit("}"))
    loose = F.when(kind == "ids", backwards).when(kind == "count", number).when(kind == "metres", longer).otherwise(lower)
    after = q.select("family", (F.col("scene_id") - 1).alias("scene_id"), F.col("truth").alias("after"))
    arm = lambda name, answer: F.struct(F.lit(name).alias("arm"), answer.alias("answer"))
    each = q.join(after, ["family", "scene_id"], "left").select("scene_id", "family", "truth", F.explode(F.array(arm("truth", F.col("truth")), arm("loose", loose), arm("neighbour", F.col("after")))).alias("g"))
    return each.select("scene_id", "family", "g.arm", qu.graded(F.col("family"), F.col("truth"), F.col("g.answer")).alias("correct"))
