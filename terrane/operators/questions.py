"""Questions about scenes: seeded choices, wording by template, and grading by the comparator of a family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import grading as gr
from terrane.functions import random as rd

#: Field of the answer and comparator of each family.
FAMILIES = {
    "containment": ("equipmentIds", "ids"),
    "nearest": ("closureId", "text"),
    "coverage_gap": ("buildingIds", "ids"),
    "crossing": ("cableIds", "ids"),
    "count_kind": ("count", "count"),
    "street_of": ("street", "text"),
    "cable_endpoints": ("endpoints", "ids"),
    "degree": ("count", "count"),
    "quadrant_of": ("quadrant", "text"),
    "dist_pair": ("meters", "metres"),
}


def draw(family: str, scene: Column, n: int) -> Column:
    """The n-th number (from 1) in [0, 1) of a family's sequence in a scene."""
    start = rd.first_state(rd.hash32(F.concat(F.lit(f"{family}|"), scene.cast("string"))))
    m, a = rd.jump(n)
    return rd.leap(start, F.lit(m).cast("long"), F.lit(a).cast("long")) / rd.WORD


def picked(rows: DataFrame, family: str, order: str, n: int = 1) -> DataFrame:
    """One row of each scene, by the family's n-th number among the scene's rows in order. Scenes are of bounded size."""
    w = Window.partitionBy("scene_id")
    at = F.floor(draw(family, F.col("scene_id"), n) * F.count("*").over(w))
    return rows.withColumn("_hit", F.row_number().over(w.orderBy(order)) - 1 == at).filter("_hit").drop("_hit")


def asked(rows: DataFrame, family: str, templates: tuple[str, ...], n: int) -> DataFrame:
    """rows (scene_id, a, b, truth) as (scene_id, family, question, truth): the n-th number chooses the template; {a} and {b} are filled in."""
    chosen = F.element_at(F.array(*map(F.lit, templates)), (F.floor(draw(family, F.col("scene_id"), n) * len(templates)) + 1).cast("int"))
    text = F.replace(F.replace(chosen, F.lit("{a}"), F.coalesce("a", F.lit(""))), F.lit("{b}"), F.coalesce("b", F.lit("")))
    return rows.select("scene_id", F.lit(family).alias("family"), text.alias("question"), "truth")


def _given_ids(raw: Column, name: str) -> Column:
    """A list of ids; the texts "none" and "" are an empty one."""
    text = gr.text(raw, name)
    return F.when(text.isin("none", ""), F.array().cast("array<string>")).otherwise(gr.ids(raw, name))


def _same(field: str, kind: str, truth: Column, answer: Column) -> Column:
    if kind == "ids":
        return gr.same_ids(gr.ids(truth, field), _given_ids(answer, field))
    if kind == "text":
        return F.coalesce(gr.text(truth, field) == gr.text(answer, field), F.lit(False))
    same = gr.same_number(gr.number(truth, field), gr.number(answer, field), metres=kind == "metres")
    if kind == "metres":  # counts may come as text, lengths may not
        written = F.try_variant_get(F.try_parse_json(answer), f"$.{field}", "variant")
        same = same & F.coalesce(~F.to_json(written).startswith('"'), F.lit(False))
    return same


def graded(family: Column, truth: Column, answer: Column) -> Column:
    """Whether an answer (JSON) holds the truth (JSON) of its family: ids in any order and with repeats, lengths to 0.6 m, all else
    exactly. An answer that is null, no JSON or lacks the field is wrong; an unknown family is null; further fields are ignored."""
    out = F.lit(None).cast("boolean")
    for name, (field, kind) in FAMILIES.items():
        out = F.when(family == name, _same(field, kind, truth, answer)).otherwise(out)
    return out
