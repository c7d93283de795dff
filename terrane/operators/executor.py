"""Geometry requests as JSON lines, one operation each, answered in bulk.

A line is {"op": ..., ...}; lines that are no JSON object are prose and ignored, an unknown op or a missing argument gives an
ERROR text and never an exception. Points are [x, y]; units "m" take plane metres, "lnglat" (the default) degrees, projected at
the mean latitude of the line's points.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, StringType

from terrane.functions import geo
from terrane.functions.geo import P
from terrane.operators.procedural import hull_order

MOST_LINES = 60
LINE = "op string, units string, a array<double>, b array<double>, p array<double>, line array<array<double>>, ring array<array<double>>, values array<double>, ids array<string>, cmp string, threshold double"
LINE += ", rings map<string,array<array<double>>>, points map<string,array<double>>, segments map<string,struct<a:array<double>,b:array<double>,exclude:array<string>>>"
LINE += ", target array<double>, exclude_field string, exclude_value string, candidates map<string,map<string,string>>"


def fixed(value: float, digits: int) -> str:
    """Decimal text of the exact binary value, halves away from zero."""
    return str(Decimal(value).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def _p(c: Column) -> P:
    return P(F.get(c, F.lit(0)), F.get(c, F.lit(1)))


def _structs(c: Column) -> Column:
    return F.transform(c, lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y")))


def parse(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per request line: the other columns, `n` (place among the requests, from 1) and `r` (its fields)."""
    rest = [c for c in texts.columns if c != text]
    lines = texts.select(*rest, F.posexplode(F.split(text, "\n")).alias("at", "raw")).filter(F.ltrim("raw").startswith("{"))
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy(*rest).orderBy("at"))).filter(F.col("n") <= MOST_LINES)
    return lines.withColumn("r", F.from_json("raw", LINE)).drop("at")


def _pair(c: Column) -> Column:
    return F.coalesce(F.size(c) >= 2, F.lit(False))


def _listed(ids: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]"))


@F.pandas_udf(ArrayType(StringType()))
def _hull(ids: pd.Series, points: pd.Series) -> pd.Series:
    """Ids of the hull's corners, in its order."""
    return pd.Series([None if p is None else [k[i] for i in hull_order([(float(v[0]), float(v[1])) for v in p])] for k, p in zip(ids, points)], dtype=object)


def _hull_answer(r) -> Column:
    """Ids on the hull in its order, and the others in theirs. The projection scales axes only, which changes no hull."""
    ids, at = F.map_keys(r("points")), F.map_values(r("points"))
    fits = F.forall(at, _pair) & (F.size(at) > 0)
    hull = _hull(ids, F.when(fits & (r("op") == "convex_hull"), at))
    text = F.concat(F.lit("hull: "), _listed(hull), F.lit("  interior: "), _listed(F.array_except(ids, hull)))
    return F.when(F.coalesce(fits, F.lit(False)), text).otherwise("ERROR: every point must be [x,y]")


def _crossings_answer(r) -> Column:
    """For every segment the rings that it meets, but for those it excludes."""
    segments, rings = F.map_entries(r("segments")), F.map_entries(r("rings"))
    good = F.forall(segments, lambda s: _pair(s["value"]["a"]) & _pair(s["value"]["b"])) & F.forall(rings, lambda g: (F.size(g["value"]) >= 3) & F.forall(g["value"], _pair))

    def one(s: Column) -> Column:
        out = F.coalesce(s["value"]["exclude"], F.array().cast("array<string>"))
        hit = F.filter(rings, lambda g: ~F.array_contains(out, g["key"]) & geo.segment_meets_ring(_p(s["value"]["a"]), _p(s["value"]["b"]), _structs(g["value"])))
        return F.concat(s["key"], F.lit(" -> crosses: "), _listed(F.transform(hit, lambda g: g["key"])))

    fits = F.coalesce((F.size(segments) > 0) & (F.size(rings) > 0) & good, F.lit(False))
    return F.when(fits, F.array_join(F.transform(segments, one), " | ")).otherwise("ERROR: segments and rings of valid points are needed")


def _nearest_answer(r, metric: Column) -> Column:
    """The nearest candidate whose field has another value, all such in order of distance, and those left out."""
    every = F.transform(F.map_entries(r("candidates")), lambda c: F.struct(
        c["key"].alias("id"), F.from_json(F.element_at(c["value"], "xy"), "array<double>").alias("at"), F.coalesce(F.element_at(c["value"], r("exclude_field")), F.lit("undefined")).alias("f")))
    left = F.filter(every, lambda c: c["f"] == r("exclude_value"))
    kept = F.filter(every, lambda c: c["f"] != r("exclude_value"))
    goal = _p(r("target"))
    lat = (goal.y + F.aggregate(kept, F.lit(0.0), lambda a, c: a + F.get(c["at"], F.lit(1)))) / (F.size(kept) + 1)

    def far(c: Column) -> Column:
        at = _p(c["at"])
        q, t = geo.project(at, lat), geo.project(goal, lat)
        return F.when(metric, F.hypot(at.x - goal.x, at.y - goal.y)).otherwise(F.hypot(q.x - t.x, q.y - t.y))

    ranked = F.array_sort(F.transform(kept, lambda c, i: F.struct(far(c).alias("d"), i.alias("i"), c["id"].alias("id"), c["f"].alias("f"))))
    named = F.transform(ranked, lambda c: F.concat(c["id"], F.lit("("), c["f"], F.lit(")="), F.format_string("%.1f", c["d"])))
    text = F.concat(F.lit("nearest:"), F.coalesce(F.get(ranked, F.lit(0))["id"], F.lit("none")), F.lit(" | ranked: "), F.array_join(named, ", "), F.lit(" | excluded:"), _listed(F.transform(left, lambda c: c["id"])))
    fits = F.coalesce(_pair(r("target")) & r("exclude_field").isNotNull() & r("exclude_value").isNotNull() & (F.size(every) > 0) & F.forall(every, lambda c: _pair(c["at"])), F.lit(False))
    return F.when(fits, text).otherwise("ERROR: target, exclude_field, exclude_value and candidates with xy are needed")


def complete(requests: DataFrame, cables: int) -> DataFrame:
    """By text: crossing requests and whether they cover 60 % of so many cables at least."""
    tried = F.sum(F.when(F.col("r.op") == "segments_cross_polygons", F.coalesce(F.size("r.segments"), F.lit(0))).when(F.col("r.op") == "segment_intersects_polygon", 1).otherwise(0))
    rest = [c for c in requests.columns if c not in ("n", "r", "raw")]
    return requests.groupBy(*rest).agg(tried.alias("tried")).withColumn("complete", F.col("tried") >= 0.6 * cables)


def run(requests: DataFrame) -> DataFrame:
    """requests (from parse) with `number` (a distance, metres) or `answer` (text)."""
    r = lambda k: F.col(f"r.{k}")
    metric = r("units") == "m"
    plane = lambda a, b: F.hypot(a.x - b.x, a.y - b.y)
    a, b, p = _p(r("a")), _p(r("b")), _p(r("p"))
    lat = (a.y + b.y) / 2
    dist = F.when(metric, plane(a, b)).otherwise(plane(geo.project(a, lat), geo.project(b, lat)))
    line = geo.polyline_metres(p, _structs(r("line")))
    inside = geo.in_ring(p, _structs(r("ring")))
    hit = geo.segment_meets_ring(a, b, _structs(r("ring")))
    test = lambda v: F.when(r("cmp") == "le", v <= r("threshold")).when(r("cmp") == "lt", v < r("threshold")).when(r("cmp") == "ge", v >= r("threshold")).otherwise(v > r("threshold"))
    passed = F.transform(F.filter(F.arrays_zip(r("ids"), r("values")), lambda z: test(z["values"])), lambda z: z["ids"])
    two = (F.size(r("a")) == 2) & (F.size(r("b")) == 2)
    ring = F.size(r("ring")) >= 3
    bad = F.lit("ERROR: arguments")
    six = lambda k: F.format_string("%.6f", (F.get(r("a"), F.lit(k)) + F.get(r("b"), F.lit(k))) / 2)
    middle = F.concat(F.lit("["), six(0), F.lit(", "), six(1), F.lit("] ("), F.when(metric, "m").otherwise("lnglat"), F.lit(")"))
    number = F.when((r("op") == "dist") & two, dist).when((r("op") == "point_to_line_m") & (F.size(r("p")) == 2) & (F.size(r("line")) >= 2), line)
    answer = (
        F.when(F.col("r.op").isNull(), "ERROR: not a request")
        .when(r("op").isin("dist", "point_to_line_m"), F.when(number.isNull(), bad))
        .when(r("op") == "point_in_polygon", F.when(ring & (F.size(r("p")) == 2), inside.cast("string")).otherwise(bad))
        .when(r("op") == "segment_intersects_polygon", F.when(ring & two, hit.cast("string")).otherwise(bad))
        .when(r("op") == "filter_threshold", F.when(r("ids").isNotNull() & r("values").isNotNull() & r("threshold").isNotNull(), F.array_join(passed, ",")).otherwise(bad))
        .when(r("op") == "midpoint", F.when(two, middle).otherwise(bad))
        .when(r("op") == "convex_hull", _hull_answer(r))
        .when(r("op") == "segments_cross_polygons", _crossings_answer(r))
        .when(r("op") == "nearest_where", _nearest_answer(r, metric))
        .otherwise(F.concat(F.lit("ERROR: unknown op "), r("op")))
    )
    return requests.withColumns({"number": number, "answer": answer})
