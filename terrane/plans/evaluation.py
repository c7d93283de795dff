"""Queries on graded items. Items come from `events`: a user is a scene, an event type an arm, an hour a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import stats
from terrane.operators import evaluation as ev
from terrane.sources.scenes import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

ITEMS = """
items AS (SELECT user_id AS scene, 'm' || (user_id % 3) AS model, event_type AS arm, 'q' || extract('hour' FROM ts) AS question, 'c' || (extract('hour' FROM ts) // 6) AS category,
 CAST(event_id % 2 AS INT) AS repeat, event_id AS ord, value >= 40 AS correct, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, value AS latency,
 CASE WHEN user_id % 4 > 0 THEN 350 * CAST(user_id % 4 AS INT) END AS scale FROM events)"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hour = F.hour("ts")
    return e.select(
        F.col("user_id").alias("scene"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("event_type").alias("arm"),
        F.concat(F.lit("q"), hour.cast("string")).alias("question"), F.concat(F.lit("c"), F.floor(hour / 6).cast("string")).alias("category"),
        (F.col("event_id") % 2).cast("int").alias("repeat"), F.col("event_id").alias("ord"), (F.col("value") >= 40).alias("correct"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("latency"),
        F.when(F.col("user_id") % 4 > 0, 350 * (F.col("user_id") % 4).cast("int")).alias("scale"),
    )


def _summary_sql(*keys: str, where: str = "") -> str:
    k = ", ".join(keys)
    return f"""WITH {ITEMS},
g AS (SELECT {k}, count(*) AS n, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, CAST(floor(avg(tokens) + 0.5) AS BIGINT) AS mean_tokens, CAST(floor(avg(latency) + 0.5) AS BIGINT) AS mean_latency FROM items {where} GROUP BY {k})
SELECT *, round(correct / n, 6) AS acc,
 round((correct / n + 3.8416 / (2 * n) - 1.96 * sqrt(correct / n * (1 - correct / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS lo,
 round((correct / n + 3.8416 / (2 * n) + 1.96 * sqrt(correct / n * (1 - correct / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS hi FROM g"""


@query(_summary_sql("arm"))
def per_arm_summary(spark, sf_dir):
    return ev.summarize(items(spark, sf_dir), "arm")


@query(_summary_sql("arm", "category"))
def per_arm_category(spark, sf_dir):
    return ev.summarize(items(spark, sf_dir), "arm", "category")


@query(_summary_sql("model", "arm"))
def per_model_summary(spark, sf_dir):
    return ev.summarize(items(spark, sf_dir), "model", "arm")


@query(_summary_sql("scale", "arm", where="WHERE scale IS NOT NULL"))
def scale_curve(spark, sf_dir):
    return ev.summarize(items(spark, sf_dir).filter("scale IS NOT NULL"), "scale", "arm")


@query(_summary_sql("question"))
def by_question_tally(spark, sf_dir):
    return ev.summarize(items(spark, sf_dir), "question")


@query(f"""WITH {ITEMS} SELECT arm, category, count(*) AS n, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, CAST(grouping(arm) * 2 + grouping(category) AS BIGINT) AS level
FROM items GROUP BY GROUPING SETS ((arm), (category), (arm, category))""")
def grouping_sets_accuracy(spark, sf_dir):
    return ev.grouping_sets(items(spark, sf_dir))


def _erfc_sql(x: str) -> str:
    t = f"(1 / (1 + 0.5 * {x}))"
    poly = repr(stats.ERFC[-1])
    for c in reversed(stats.ERFC[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    return f"({t} * exp({poly} - {x} * {x}))"


@query(f"""WITH {ITEMS}, l AS (SELECT arm, scene, question, model, repeat, arg_max(correct, ord) AS correct FROM items GROUP BY ALL),
p AS (SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS n, count(*) FILTER (a.correct AND NOT b.correct) AS b, count(*) FILTER (b.correct AND NOT a.correct) AS c
 FROM l a JOIN l b ON a.scene = b.scene AND a.question = b.question AND a.model = b.model AND a.repeat = b.repeat AND a.arm < b.arm GROUP BY ALL),
s AS (SELECT *, CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1, 2) / (b + c) END AS st FROM p)
SELECT arm_a, arm_b, n, b, c, round(st, 6) AS statistic, round(CASE WHEN b + c = 0 THEN 1.0 ELSE {_erfc_sql('sqrt(st / 2)')} END, 6) AS p FROM s""")
def pairwise_mcnemar(spark, sf_dir):
    return ev.paired(items(spark, sf_dir))


@query("""WITH s AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels)
SELECT b, c, round(CASE WHEN b + c = 0 THEN 0.0 ELSE pow(abs(b - c) - 1, 2) / (b + c) END, 6) AS statistic FROM s""")
def label_pair_test(spark, sf_dir):
    s = table(spark, sf_dir, "labels").agg(F.count_if(F.expr("quality = 1 AND toxic = 0")).alias("b"), F.count_if(F.expr("quality = 0 AND toxic = 1")).alias("c"))
    return s.withColumn("statistic", F.round(stats.mcnemar(F.col("b"), F.col("c"))[0], 6))


@query(f"""WITH {ITEMS}, v AS (SELECT scene, arm, category AS answer, count(*) AS votes, min(ord) AS f FROM items GROUP BY ALL)
SELECT scene, arm, answer, votes FROM (SELECT *, row_number() OVER (PARTITION BY scene, arm ORDER BY votes DESC, f) AS r FROM v) WHERE r = 1""")
def majority_vote(spark, sf_dir):
    return ev.majority(items(spark, sf_dir).withColumn("answer", F.col("category")), "scene", "arm")


@query(f"""WITH {ITEMS} SELECT count(*) AS total, count(*) FILTER (arm = 'error') AS errors, count(DISTINCT scene) AS scenes, count(DISTINCT arm) AS arms FROM items""")
def run_totals(spark, sf_dir):
    return items(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("arm") == "error").alias("errors"), F.count_distinct("scene").alias("scenes"), F.count_distinct("arm").alias("arms"))


_ANSWERS = """a AS (SELECT l_orderkey AS item, list(CAST(l_suppkey AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN ' ' ELSE '' END ORDER BY l_linenumber, l_suppkey, l_partkey % 2) AS cited,
 list(CAST(CASE WHEN l_orderkey % 3 = 0 THEN l_suppkey ELSE l_suppkey + (l_partkey % 2) END AS VARCHAR) ORDER BY l_linenumber, l_suppkey, l_partkey % 2) AS truth FROM lineitem GROUP BY 1)"""


def _answers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cited = F.concat(F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(""))
    truth = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_suppkey")).otherwise(F.col("l_suppkey") + F.col("l_partkey") % 2).cast("string")
    own = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", (F.col("l_partkey") % 2).alias("o"), cited.alias("c"), truth.alias("t")))).alias("x"))
    return own.select(F.col("l_orderkey").alias("item"), F.transform("x", lambda s: s["c"]).alias("cited"), F.transform("x", lambda s: s["t"]).alias("truth"))


@query(f"""WITH {_ANSWERS}, t AS (SELECT item, list_transform(cited, lambda x: trim(x)) AS c, truth AS t FROM a)
SELECT item, list_sort(list_distinct(c)) = list_sort(list_distinct(t)) AS set_equal, c = t AS ordered_equal, list_sort(c) = list_sort(t) AS bag_equal FROM t""")
def grade_answers(spark, sf_dir):
    c, t = F.col("cited"), F.col("truth")
    return _answers(spark, sf_dir).select("item", ev.set_equal(c, t).alias("set_equal"), ev.ordered_equal(c, t).alias("ordered_equal"), ev.bag_equal(c, t).alias("bag_equal"))


@query(f"""WITH {_ANSWERS}, u AS (SELECT item, list_distinct(list_filter(cited, lambda x: NOT list_contains(truth, trim(x)))) AS u FROM a)
SELECT item, CAST(len(u) AS BIGINT) AS n_unknown, array_to_string(list_sort(u), '|') AS unknown FROM u""")
def hallucinated_ids(spark, sf_dir):
    u = ev.unknown_ids(F.col("cited"), F.col("truth"))
    return _answers(spark, sf_dir).select("item", F.size(u).cast("long").alias("n_unknown"), F.array_join(F.array_sort(u), "|").alias("unknown"))


@query("""WITH m AS (SELECT * FROM (VALUES ('m0', true), ('m1', false)) t(model, vision)), a AS (SELECT unnest(['json', 'wkt', 'image']) AS arm),
q AS (SELECT unnest(['nearest', 'crossing']) AS question), r AS (SELECT unnest([0, 1, 2]) AS repeat)
SELECT DISTINCT user_id AS scene, model, arm, question, repeat FROM events, m, a, q, r WHERE vision OR arm <> 'image'""")
def task_grid(spark, sf_dir):
    scenes = table(spark, sf_dir, "events").select(F.col("user_id").alias("scene")).distinct()
    return ev.task_grid(scenes, [("m0", True), ("m1", False)], ["json", "wkt", "image"], ["nearest", "crossing"], 3)


@query(f"""WITH {ITEMS}, f AS (SELECT arm AS family, count(*) AS n, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS passed FROM items GROUP BY 1)
SELECT family, n, passed, round(passed / n, 6) AS rate, passed / n < 0.4 AS weak FROM f""")
def family_pass_rate(spark, sf_dir):
    f = items(spark, sf_dir).groupBy(F.col("arm").alias("family")).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("passed"))
    rate = F.col("passed") / F.col("n")
    return f.withColumns({"rate": F.round(rate, 6), "weak": rate < 0.4})


@query(f"""WITH {ITEMS}, a AS (SELECT category, count(*) AS na, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS ca FROM items WHERE arm = 'view' GROUP BY 1),
b AS (SELECT category, count(*) AS nb, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS cb FROM items WHERE arm = 'click' GROUP BY 1)
SELECT coalesce(a.category, b.category) AS category, coalesce(na, 0) AS na, coalesce(ca, 0) AS ca, coalesce(nb, 0) AS nb, coalesce(cb, 0) AS cb FROM a FULL JOIN b ON a.category = b.category""")
def compare_runs(spark, sf_dir):
    side = lambda arm, x: items(spark, sf_dir).filter(F.col("arm") == arm).groupBy("category").agg(F.count("*").alias("n" + x), F.sum(F.col("correct").cast("long")).alias("c" + x))
    return side("view", "a").join(side("click", "b"), "category", "full").fillna(0)


@query(f"""WITH {ITEMS} SELECT scene, max(ord) FILTER (arm = 'view') AS last_view, min(ord) AS first_item, arg_max(arm, ord) AS last_arm FROM items GROUP BY 1""")
def last_message(spark, sf_dir):
    return items(spark, sf_dir).groupBy("scene").agg(F.max(F.when(F.col("arm") == "view", F.col("ord"))).alias("last_view"), F.min("ord").alias("first_item"), F.max_by("arm", "ord").alias("last_arm"))


@query("""SELECT conv_id, max(turn) FILTER (role = 'user') AS turn, arg_max(text, turn) FILTER (role = 'user') AS content FROM conversations GROUP BY 1""")
def last_user_text(spark, sf_dir):
    user = F.when(F.col("role") == "user", F.col("turn"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(user).alias("turn"), F.max_by("text", user).alias("content"))


@query("""WITH m AS (SELECT role AS family, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1)
SELECT family, n, chars, CAST(floor(chars / 4 + 0.5) AS BIGINT) AS approx_tokens FROM m""")
def dataset_manifest(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("family")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return m.withColumn("approx_tokens", stats.half_up(F.col("chars") / 4))


@query("""SELECT conv_id, CASE WHEN row_number() OVER (ORDER BY conv_id) % 50 = 1 THEN 'val' ELSE 'train' END AS split, n FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)""")
def train_val_split(spark, sf_dir):
    """Row number over conversations without a global sort in one task: ranks are offsets of range cells plus the rank within."""
    from terrane.operators.ranking import global_row_number

    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    numbered = global_row_number(c, "conv_id", "i")
    return numbered.select("conv_id", F.when(F.col("i") % 50 == 1, "val").otherwise("train").alias("split"), "n")
