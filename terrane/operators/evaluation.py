"""Aggregates of graded items: per arm, per category, paired tests, votes, grading, id checks.

Items have the columns scene, model, arm, question, category, repeat, ord, correct, tokens, latency, scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import stats


def _rates(correct: Column, n: Column) -> dict[str, Column]:
    acc, lo, hi = stats.wilson(correct, n)
    return {"acc": F.round(acc, 6), "lo": F.round(lo, 6), "hi": F.round(hi, 6)}


def summarize(items: DataFrame, *keys: str) -> DataFrame:
    """n, correct, share with its interval, and mean tokens and latency (halves up) by the given keys."""
    out = items.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.col("correct").cast("long")).alias("correct"),
        stats.half_up(F.avg("tokens")).alias("mean_tokens"),
        stats.half_up(F.avg("latency")).alias("mean_latency"),
    )
    return out.withColumns(_rates(F.col("correct"), F.col("n")))


def grouping_sets(items: DataFrame) -> DataFrame:
    """Counts by arm, by category and by both, in one pass."""
    out = items.groupingSets([["arm"], ["category"], ["arm", "category"]], "arm", "category").agg(
        F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("correct"), F.grouping_id().cast("long").alias("level")
    )
    return out


def paired(items: DataFrame) -> DataFrame:
    """Paired tests of arms over items with equal scene, question, model and repeat; of repeated keys the last counts."""
    key = ["scene", "question", "model", "repeat"]
    last = items.groupBy(*key, "arm").agg(F.max_by("correct", "ord").alias("correct"))
    arms = last.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("arm", "correct"))).alias("a"))  # a row per arm
    two = F.flatten(F.transform("a", lambda x, i: F.transform(F.slice(F.col("a"), i + 2, F.size("a")), lambda y: F.struct(x["arm"].alias("arm_a"), y["arm"].alias("arm_b"), x["correct"].alias("ca"), y["correct"].alias("cb")))))
    pairs = arms.select(F.explode(two).alias("p")).select("p.*")
    out = pairs.groupBy("arm_a", "arm_b").agg(
        F.count("*").alias("n"), F.count_if(F.expr("ca AND NOT cb")).alias("b"), F.count_if(F.expr("cb AND NOT ca")).alias("c")
    )
    stat, p = stats.mcnemar(F.col("b"), F.col("c"))
    return out.withColumns({"statistic": F.round(stat, 6), "p": F.round(p, 6)})


def majority(answers: DataFrame, *keys: str, answer: str = "answer", order: str = "ord") -> DataFrame:
    """The most frequent answer by keys; ties go to the one seen first."""
    votes = answers.groupBy(*keys, answer).agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "first"))
    return votes.withColumn("rank", rank).filter("rank = 1").select(*keys, answer, "votes")


def trimmed(ids: Column) -> Column:
    return F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.trim(x))


def set_equal(a: Column, b: Column) -> Column:
    """Equal as sets of trimmed strings; null counts as empty."""
    return F.array_sort(F.array_distinct(trimmed(a))) == F.array_sort(F.array_distinct(trimmed(b)))


def ordered_equal(a: Column, b: Column) -> Column:
    return trimmed(a) == trimmed(b)


def bag_equal(a: Column, b: Column) -> Column:
    """Equal with repeats, in any order."""
    return F.array_sort(trimmed(a)) == F.array_sort(trimmed(b))


def unknown_ids(cited: Column, known: Column) -> Column:
    """Cited ids that are not among the known ones, as cited, once each."""
    return F.array_distinct(F.filter(F.coalesce(cited, F.array().cast("array<string>")), lambda x: ~F.array_contains(known, F.trim(x))))


def asked(missing_info: Column) -> Column:
    return F.coalesce(F.length(F.trim(missing_info)) > 0, F.lit(False))


def task_grid(scenes: DataFrame, models: list[tuple[str, bool]], arms: list[str], questions: list[str], repeats: int) -> DataFrame:
    """scenes x models x arms x questions x repeats, without the image arm for models that see none. All but scenes are lists."""
    m = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(v).alias("vision")) for n, v in models])).alias("m")
    out = scenes.select("scene", m).select("scene", "m.*")
    out = out.withColumn("arm", F.explode(F.array(*map(F.lit, arms)))).filter("vision OR arm <> 'image'")
    out = out.withColumn("question", F.explode(F.array(*map(F.lit, questions))))
    return out.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).drop("vision")
