"""Routing graphs along streets: nodes on both pavements, edges between them, crossings, and bridges between what is apart.

Every step is an expansion of rows or a join by cells; ids are text, so graphs of many scenes can lie in one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions.geo import P
from terrane.operators import graph as gr
from terrane.operators import spatial as sp

#: Cost of a metre by kind of edge, under ground and in the air.
EDGE_COSTS = {"sidewalk": (1.0, 0.7), "road_crossing": (3.0, 1.0), "aerial_span": (2.0, 0.5), "conduit": (0.3, 0.3)}
SIDE_M, STEP_M, BRIDGE_M = 5.0, 12.0, 100.0


def pavement_nodes(streets: DataFrame, step: float = STEP_M, side: float = SIDE_M) -> DataFrame:
    """(scene_id, street_id, side, k, id, x, y): points every `step` metres from a street's beginning, on both of its sides.
    A street without length has one point a side."""
    a, b = P(F.col("x"), F.col("y")), P(F.col("bx"), F.col("by"))
    length = geo.haversine(a, b)
    each = streets.select("scene_id", "street_id", "x", "y", "bx", "by", length.alias("m"), geo.bearing(a, b).alias("dir"))
    each = each.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / step).cast("int"))))
    each = each.withColumn("side", F.explode(F.array(F.lit("L"), F.lit("R"))))
    on = F.coalesce(F.try_divide(F.col("k") * step, F.col("m")), F.lit(0.0))
    middle = P(a.x + (b.x - a.x) * on, a.y + (b.y - a.y) * on)
    at = geo.destination(middle, F.lit(side), F.col("dir") + F.when(F.col("side") == "L", -90).otherwise(90))
    ident = F.concat_ws(":", F.col("scene_id").cast("string"), "street_id", "side", F.col("k").cast("string"))
    return each.select("scene_id", "street_id", "side", "k", ident.alias("id"), at.x.alias("x"), at.y.alias("y"))


def edges(nodes: DataFrame) -> DataFrame:
    """(scene_id, source, target, kind, metres) from each node to the next one of its side, and across the street."""
    mine = ["scene_id", "street_id", "side", "k", "id", "x", "y"]
    other = nodes.select("scene_id", "street_id", F.col("side").alias("oside"), F.col("k").alias("ok"), F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    along = nodes.select(*mine, (F.col("k") + 1).alias("ok"), F.col("side").alias("oside"), F.lit("sidewalk").alias("kind"))
    across = nodes.filter("side = 'L'").select(*mine, F.col("k").alias("ok"), F.lit("R").alias("oside"), F.lit("road_crossing").alias("kind"))
    both = along.unionByName(across).join(other, ["scene_id", "street_id", "oside", "ok"])
    return both.select("scene_id", F.col("id").alias("source"), F.col("oid").alias("target"), "kind", geo.haversine(P(F.col("x"), F.col("y")), P(F.col("ox"), F.col("oy"))).alias("metres"))


def bridges(nodes: DataFrame, found: DataFrame, metres: float = BRIDGE_M) -> DataFrame:
    """Edges that join components: of every two of one scene the nearest pair of nodes no farther apart than `metres`."""
    member = gr.components(found.select("source", "target"))
    member = nodes.select("id").join(member, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    near = gr.closest_between(nodes, member, metres)
    return nodes.select("scene_id", F.col("id").alias("a")).join(near, "a").select("scene_id", F.col("a").alias("source"), F.col("b").alias("target"), F.lit("sidewalk").alias("kind"), F.col("d").alias("metres"))


def costs(found: DataFrame) -> DataFrame:
    """Edges with their cost under ground and in the air."""
    rate = lambda i: F.element_at(F.create_map(*[F.lit(x) for kind, c in EDGE_COSTS.items() for x in (kind, c[i])]), F.col("kind"))
    return found.withColumns({"underground": F.col("metres") * rate(0), "aerial": F.col("metres") * rate(1)})


def directed(segments: DataFrame, oneway: Column) -> DataFrame:
    """Edges of segments (source, target, cost) in the ways that may be driven."""
    back = segments.filter(~F.coalesce(oneway, F.lit(False))).select(F.col("target").alias("source"), F.col("source").alias("target"), "cost")
    return segments.select("source", "target", "cost").unionByName(back)


def snapped(points: DataFrame, nodes: DataFrame, metres: float) -> DataFrame:
    """(scene_id, id, node, distance, ...) of points with a node (scene_id, id, x, y, ...) no farther than metres: the nearest one, distances equal to a
    micrometre tie, to the smaller id; by cells. Other columns of nodes go along."""
    more = [c for c in nodes.columns if c not in ("scene_id", "id", "x", "y")]
    others = nodes.select("scene_id", F.col("id").alias("node"), F.col("x").alias("bx"), F.col("y").alias("by"), *more)
    near = sp.met_within(points.select("scene_id", "id", "x", "y"), others, metres + 1e-6)
    best = near.groupBy("scene_id", "id").agg(F.min(F.struct(F.round("metres", 6).alias("d"), "node", F.col("metres").alias("distance"), *more)).alias("s"))
    return best.filter(F.col("s.distance") <= metres).select("scene_id", "id", *[f"s.{c}" for c in ("node", "distance", *more)])


def reach_by_component(points: DataFrame, offices: DataFrame, nodes: DataFrame, metres: float) -> DataFrame:
    """(scene_id, id, node, distance, reason) of points as of reach() where every edge runs both ways, so that the component of nodes (scene_id, id,
    x, y, component) says what is reachable: without rounds, costs and ways."""
    office = snapped(offices.select("scene_id", F.lit("office").alias("id"), "x", "y"), nodes, metres).select("scene_id", F.col("component").alias("start"))
    found = points.select("scene_id", "id").join(snapped(points, nodes, metres).hint("merge"), ["scene_id", "id"], "left").join(office.hint("merge"), "scene_id", "left")
    reason = F.when(F.col("node").isNull() | F.col("start").isNull(), "too_far_from_graph").when(F.col("component") == F.col("start"), "reachable").otherwise("different_component")
    return found.select("scene_id", "id", "node", "distance", reason.alias("reason"))


def reach(points: DataFrame, offices: DataFrame, nodes: DataFrame, edges: DataFrame, metres: float) -> DataFrame:
    """(scene_id, id, node, distance, reason, cost, way) of points: each is put on the nearest node (scene_id, id, x, y) no farther than
    metres, and so is the scene's office (scene_id, x, y). Reasons: reachable, different_component (no way over the directed edges
    (source, target, cost)), too_far_from_graph (the point or the office). The way runs from the point's node to the office's."""
    office = snapped(offices.select("scene_id", F.lit("office").alias("id"), "x", "y"), nodes, metres).select("scene_id", F.col("node").alias("start"))
    near = snapped(points, nodes, metres).select("scene_id", "id", "node", "distance")
    best = gr.shortest(edges, office.select("start").distinct())
    steps = best.filter("previous IS NOT NULL").select(F.col("previous").alias("source"), F.col("id").alias("target"), F.lit(0).alias("ord"))
    wanted = near.select(F.col("node").alias("id")).distinct()
    ways = gr.trace_up(wanted, steps, None).select(F.col("id").alias("node"), F.col("path").alias("way"))
    found = points.select("scene_id", "id").join(near, ["scene_id", "id"], "left").join(office, "scene_id", "left")
    found = found.join(best.select("start", F.col("id").alias("node"), "cost"), ["start", "node"], "left").join(ways, "node", "left")
    reason = F.when(F.col("node").isNull() | F.col("start").isNull(), "too_far_from_graph").when(F.col("cost").isNull(), "different_component").otherwise("reachable")
    return found.select("scene_id", "id", "node", "distance", reason.alias("reason"), "cost", F.when(F.col("cost").isNotNull(), F.col("way")).alias("way"))
