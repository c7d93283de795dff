"""Routing graphs of streets, step by step: samples on both sides, greedy merging, clipping to a service area, edges that no
building blocks, corner arcs, bridges between components and forced bridges to the first one.

All tables carry scene_id, so graphs of many scenes are built at once. Nodes have an `ord` that gives the order in which a
sequential builder would have met them; where the result depends on that order (merging), it is reached by rounds over
all scenes at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions.geo import P
from terrane.operators import graph as gr
from terrane.operators import spatial as sp

#: Fixed values of the graph builder.
STEP_M, SIDE_M, MERGE_M, BRIDGE_M, BUFFER_M = 12.0, 4.0, 15.0, 100.0, 50.0
ARC_M, ARC_POINTS, ARC_LEAST, ARC_MOST = 3.0, 3, 30.0, 330.0
INFRASTRUCTURE = ("pole", "handhole", "conduit_access")
_SAMPLES = 1 << 20  # of one side of a street, at most
SWEEP_CELL = 0.02  # degrees
GROUP_ROWS = 1 << 17  # nodes of a scene's side, or edges of a scene, that a task may hold; larger ones go by rounds


def sampled(streets: DataFrame, step: float = STEP_M, side: float = SIDE_M) -> DataFrame:
    """(scene_id, ord, street_id, name, side, k, last, x, y): points on both sides of straight streets, every `step` metres from the
    beginning and at the end. street_id is a whole number, and `ord` follows (street_id, right before left, k)."""
    a, b = P(F.col("x"), F.col("y")), P(F.col("bx"), F.col("by"))
    each = streets.select("scene_id", "street_id", "name", "x", "y", "bx", "by", geo.haversine(a, b).alias("m"), geo.bearing(a, b).alias("dir"))
    inner = F.greatest(F.ceil(F.col("m") / step) - 1, F.lit(0)).cast("int")  # samples strictly between the ends
    each = each.withColumn("last", inner + 1).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last"))))
    each = each.withColumn("left", F.explode(F.array(F.lit(0), F.lit(1))))
    share = F.when(F.col("k") == F.col("last"), 1.0).otherwise(F.coalesce(F.try_divide(F.col("k") * step, F.col("m")), F.lit(0.0)))
    middle = P(a.x + (b.x - a.x) * share, a.y + (b.y - a.y) * share)
    at = geo.destination(middle, F.lit(side), F.col("dir") + F.when(F.col("left") == 1, -90).otherwise(90))
    ord_ = F.col("street_id") * (2 * _SAMPLES) + F.col("left") * _SAMPLES + F.col("k")
    name = F.when(F.col("left") == 1, "left").otherwise("right")
    return each.select("scene_id", ord_.cast("long").alias("ord"), "street_id", "name", name.alias("side"), "k", (F.col("k") == F.col("last")).alias("last"), at.x.alias("x"), at.y.alias("y"))


def _sweep(rows: pd.DataFrame) -> pd.DataFrame:
    """Fates of the nodes of a cell, in order: taken where an earlier neighbour is a seed, a seed where all are taken, else open."""
    fate: dict[int, bool] = {}
    for i, own in rows.sort_values("id").groupby("id", sort=True):
        near = [fate.get(o) if k is None or k != k else bool(k) for o, k in zip(own["other"], own["seed"])]
        if any(f is True for f in near):
            fate[i] = False
        elif None not in near:
            fate[i] = True
    return pd.DataFrame({"scene_id": rows["scene_id"].iloc[0], "id": pd.Series(list(fate), dtype="int64"), "fate": pd.Series(list(fate.values()), dtype="bool")})


def _absorbed_by_sweeps(nodes: DataFrame, metres: float, cell: float) -> DataFrame:
    """absorbed() for sides of any size. Only neighbours within metres, found by cells, ever meet. A node's fate is known once an
    earlier neighbour is a seed or all are taken. Every round sweeps the nodes of each cell in order, with what is known of other cells, and leaves those that
    wait for one; so there are as many rounds as a chain of waiting nodes enters cells, whatever its length, and a task
    holds the open neighbours of one cell.
    """
    key = F.concat_ws("\u0001", F.col("scene_id").cast("string"), F.coalesce("side", F.lit("\u0002")))
    keyed = gr.settled(nodes.select(key.alias("scene_id"), F.col("ord").alias("id"), "x", "y", F.col("scene_id").alias("scene")))
    places = keyed.select("scene_id", "id", "x", "y")
    earlier = gr.settled(sp.within_metres(places, places, metres).filter("other < id").select("scene_id", "id", "other"))
    at = places.select("scene_id", "id", geo.cell(F.col("x"), cell).alias("cx"), geo.cell(F.col("y"), cell).alias("cy"))
    later = earlier.select("scene_id", F.col("id").alias("other")).distinct().withColumn("seed", F.lit(None).cast("boolean"))
    waiting = earlier.join(at, ["scene_id", "id"])
    free = waiting.join(later.drop("seed"), ["scene_id", "other"], "left_anti").withColumn("seed", F.lit(True))  # no earlier neighbour at all
    waiting = gr.settled(free.unionByName(waiting.join(later, ["scene_id", "other"])))
    fates = at.select("scene_id", "id").join(earlier, ["scene_id", "id"], "left_anti").withColumn("fate", F.lit(True))
    while True:
        found = gr.settled(waiting.groupBy("scene_id", "cx", "cy").applyInPandas(_sweep, "scene_id string, id long, fate boolean"))
        fates = fates.unionByName(found)
        known = found.withColumnRenamed("id", "other")
        rest = waiting.join(found, ["scene_id", "id"], "left_anti").join(known, ["scene_id", "other"], "left")
        waiting = gr.settled(rest.select("scene_id", "id", "other", "cx", "cy", F.coalesce("seed", "fate").alias("seed")))
        if waiting.isEmpty():
            break
    seeds = fates.filter("fate").select("scene_id", F.col("id").alias("other"))
    by = earlier.join(seeds, ["scene_id", "other"], "left_semi").groupBy("scene_id", "id").agg(F.min("other").alias("by"))
    own = keyed.join(by, ["scene_id", "id"], "left")
    return own.select(F.col("scene").alias("scene_id"), F.col("id").alias("ord"), F.coalesce("by", "id").alias("into"))


def _by_size(df: DataFrame, keys: list[str], most: int, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of at most so many rows (of `counted`, if given), and those of larger ones; None where there are none."""
    large = (df if counted is None else counted).groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most)
    if large.isEmpty():
        return df, None
    match = [F.col(f"d.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    one, two = df.alias("d"), gr.settled(large.drop("n")).alias("l")
    return one.join(two, match, "left_anti"), one.join(two, match, "left_semi")


def _absorbing(metres: float):
    """A function that merges the nodes of one side in order, with the seeds found so far by cells."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        high = metres / 110_000.0
        wide = high / math.cos(math.radians(min(89.5, rows["y"].abs().max() + high)))
        seeds: dict[tuple[int, int], list] = {}
        into = []
        for i, x, y in zip(rows["ord"].tolist(), rows["x"].tolist(), rows["y"].tolist()):
            by = None
            if math.isfinite(x) and math.isfinite(y):
                cx, cy, lat = math.floor(x / wide), math.floor(y / high), math.radians(y)
                flat = math.cos(lat)
                for near in ((cx + dx, cy + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
                    for j, sx, sy, sflat in seeds.get(near, ()):
                        if by is None or j < by:
                            h = math.sin(math.radians(sy - y) / 2) ** 2 + flat * sflat * math.sin(math.radians(sx - x) / 2) ** 2
                            if 2 * geo.EARTH_M * math.asin(min(1.0, math.sqrt(h))) <= metres:
                                by = j
                if by is None:
                    seeds.setdefault((cx, cy), []).append((i, x, y, flat))
            into.append(i if by is None else by)
        return pd.DataFrame({"scene_id": rows["scene_id"], "ord": rows["ord"], "into": into})

    return one


def absorbed(nodes: DataFrame, metres: float = MERGE_M, cell: float = SWEEP_CELL, most: int = GROUP_ROWS) -> DataFrame:
    """(scene_id, ord, into) of nodes (scene_id, ord, x, y, side): in the order of ord, a node that no earlier seed of its side has
    taken becomes a seed and takes all later ones within metres; null is a side of its own.

    Sides of at most `most` nodes are merged one by one inside tasks; larger ones by sweeps over their cells."""
    small, large = _by_size(nodes.select("scene_id", "ord", "x", "y", "side"), ["scene_id", "side"], most)
    kind = nodes.schema["scene_id"].dataType.simpleString()
    out = sp.spread(small, "scene_id", "side").groupBy("scene_id", "side").applyInPandas(_absorbing(metres), f"scene_id {kind}, ord long, into long")
    return out if large is None else out.unionByName(_absorbed_by_sweeps(large, metres, cell))


def merged(nodes: DataFrame, into: DataFrame) -> DataFrame:
    """(scene_id, ord, x, y, kind, side, name, streets, members) of nodes (scene_id, ord, x, y, kind, side, name, street_id) put together by
    absorbed(): the place of the first piece of infrastructure, else the mean; an intersection where several streets meet, else
    the last special kind; names and streets in order of appearance. A group holds what lies within reach of its seed."""
    own = nodes.join(into.hint("merge"), ["scene_id", "ord"])
    in_order = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ord", c)))), lambda s: s[c]))
    fixed = F.col("kind").isin(*INFRASTRUCTURE)
    special = fixed | (F.col("kind") == "intersection")
    g = own.groupBy("scene_id", F.col("into").alias("ord")).agg(
        F.min_by(F.when(fixed, F.struct("x", "y")), F.when(fixed, F.col("ord"))).alias("at"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.max_by(F.when(special, F.col("kind")), F.when(special, F.col("ord"))).alias("special"), F.first("side").alias("side"),
        in_order("name").alias("names"), in_order("street_id").alias("streets"), F.count("*").alias("members"),
    )
    kind = F.when(F.size("streets") > 1, "intersection").otherwise(F.coalesce("special", F.lit("street")))
    return g.select("scene_id", "ord", F.coalesce("at.x", "mx").alias("x"), F.coalesce("at.y", "my").alias("y"), kind.alias("kind"), "side", F.array_join("names", " / ").alias("name"), "streets", "members")


def offset_ring(ring: Column, metres: float = BUFFER_M, per_quarter: int = 4) -> Column:
    """The outline at a distance from a convex counter-clockwise ring (written without its closing point): at every corner an arc from
    the outer normal of the edge that comes in to that of the edge that leaves, in the frame of the first corner's latitude."""
    n = F.size(ring)
    lat = F.get(ring, F.lit(0))["y"]
    east, north = geo.LNG_M * F.cos(F.radians(lat)), geo.LAT_M

    def corner(v: Column, i: Column) -> Column:
        a, c = F.get(ring, F.pmod(i - 1, n)), F.get(ring, F.pmod(i + 1, n))
        first = F.atan2((v["y"] - a["y"]) * north, (v["x"] - a["x"]) * east) - F.lit(3.141592653589793 / 2)
        last = F.atan2((c["y"] - v["y"]) * north, (c["x"] - v["x"]) * east) - F.lit(3.141592653589793 / 2)
        sweep = F.pmod(last - first, F.lit(2 * 3.141592653589793))
        steps = F.greatest(F.lit(1), F.ceil(sweep / (3.141592653589793 / 2 / per_quarter) - 1e-9).cast("int"))
        angle = lambda k: first + sweep * k / steps
        return F.transform(F.sequence(F.lit(0), steps), lambda k: F.struct((v["x"] + metres * F.cos(angle(k)) / east).alias("x"), (v["y"] + metres * F.sin(angle(k)) / north).alias("y")))

    return F.flatten(F.transform(ring, corner))


def inside_buffered(p: P, ring: Column, metres: float = BUFFER_M) -> Column:
    """Inside a ring or no farther than metres from its outline: the buffered area of any ring. Fewer than three points: everything."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.coalesce(F.size(ring) < 3, F.lit(True)) | geo.in_ring(p, ring) | (geo.polyline_metres(p, closed) <= metres)


def clipped(nodes: DataFrame, areas: DataFrame, metres: float = BUFFER_M) -> DataFrame:
    """Nodes within metres of their scene's service area (scene_id, ring); all of a scene without an area."""
    near = nodes.join(areas.select("scene_id", "ring"), "scene_id", "left").filter(inside_buffered(P(F.col("x"), F.col("y")), F.col("ring"), metres))
    return near.drop("ring")


def unblocked(segments: DataFrame, buildings: DataFrame) -> DataFrame:
    """Segments (with scene_id, x, y, bx, by) that do not properly cross the outline of a footprint and do not lie inside one."""
    key = ["scene_id", "x", "y", "bx", "by"]
    hit = sp.segments_blocked(segments.select(*key).distinct(), buildings).distinct()
    return segments.join(hit.hint("merge"), key, "left_anti")


def _placed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (scene_id, source, target, ...) of nodes that both exist, with their places x, y, bx, by and metres."""
    a = nodes.select("scene_id", F.col("ord").alias("source"), "x", "y")
    b = nodes.select("scene_id", F.col("ord").alias("target"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = geo.haversine(P(F.col("x"), F.col("y")), P(F.col("bx"), F.col("by")))
    return pairs.join(a.hint("merge"), ["scene_id", "source"]).join(b.hint("merge"), ["scene_id", "target"]).withColumn("metres", d)


def street_edges(samples: DataFrame, into: DataFrame, nodes: DataFrame, buildings: DataFrame) -> DataFrame:
    """(scene_id, source, target, kind, metres) between merged nodes: `sidewalk` from sample to sample of a side, `road_crossing` at both
    ends of a street. Once for each pair of nodes and kind; none through a building."""
    s = samples.join(into.hint("merge"), ["scene_id", "ord"]).select("scene_id", "street_id", "side", "k", "last", "into")
    following = F.lead("into").over(Window.partitionBy("scene_id", "street_id", "side").orderBy("k"))
    along = s.select("scene_id", F.col("into").alias("source"), following.alias("target"), F.lit("sidewalk").alias("kind"))
    own = lambda side: F.max(F.when(F.col("side") == side, F.col("into")))
    across = s.filter("k = 0 OR last").groupBy("scene_id", "street_id", "k").agg(own("left").alias("source"), own("right").alias("target"))
    across = across.select("scene_id", "source", "target", F.lit("road_crossing").alias("kind"))
    both = along.unionByName(across).filter("source <> target")
    both = both.select("scene_id", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "kind").distinct()
    return unblocked(_placed(both, nodes), buildings).select("scene_id", "source", "target", "kind", "metres")


def corner_arcs(corners: DataFrame, streets: DataFrame, side: float = SIDE_M, radius: float = ARC_M, points: int = ARC_POINTS) -> DataFrame:
    """(scene_id, ord, street_id, next_id, j, x, y): points of the arcs around corners (scene_id, ord, x, y, streets) between one street and
    the next by bearing, unless the two run nearly straight on or lie on each other. streets: (scene_id, street_id, x, y, bx, by)."""
    met = corners.filter(F.size("streets") > 1).select("scene_id", "ord", "x", "y", F.explode("streets").alias("street_id"))
    lines = streets.select("scene_id", "street_id", *[F.col(c).alias(f"s{c}") for c in ("x", "y", "bx", "by")])
    at, a, b = P(F.col("x"), F.col("y")), P(F.col("sx"), F.col("sy")), P(F.col("sbx"), F.col("sby"))
    begins = geo.haversine(at, a) < geo.haversine(at, b)
    away = F.when(begins, geo.bearing(a, b)).otherwise(geo.bearing(b, a))
    met = met.join(lines, ["scene_id", "street_id"]).withColumn("dir", F.when(away > 180, away - 360).otherwise(away))
    around = Window.partitionBy("scene_id", "ord").orderBy("dir", "street_id")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = lambda c: F.coalesce(F.lead(c).over(around), F.first(c).over(whole))
    met = met.withColumns({"next_id": following("street_id"), "next_dir": following("dir")})
    turn = F.col("next_dir") - F.col("dir")
    met = met.withColumn("turn", F.when(turn < 0, turn + 360).otherwise(turn)).filter(F.col("turn").between(ARC_LEAST, ARC_MOST))
    start, end = F.col("dir") + 90, F.col("next_dir") - 90
    sweep = F.when(end < start, end + 360 - start).otherwise(end - start)
    each = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points))))
    spot = geo.destination(at, F.lit(side + radius), start + F.col("j") / points * sweep)
    return each.select("scene_id", "ord", "street_id", "next_id", "j", spot.x.alias("x"), spot.y.alias("y"))


def _components_inside(rows: pd.DataFrame) -> pd.DataFrame:
    """The least node reachable from each node of a scene's edges."""
    above: dict[int, int] = {}

    def top(i: int) -> int:
        while (up := above.setdefault(i, i)) != i:
            above[i] = above[up]
            i = up
        return i

    for a, b in zip(rows["source"].tolist(), rows["target"].tolist()):
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return pd.DataFrame({"scene_id": rows["scene_id"].iloc[0], "ord": pd.Series(list(above), dtype="int64"), "component": pd.Series([top(i) for i in above], dtype="int64")})


def component_of(nodes: DataFrame, edges: DataFrame, most: int = GROUP_ROWS) -> DataFrame:
    """(scene_id, ord, component): the least ord reachable in the scene. Scenes of at most `most` edges are joined up inside tasks; larger
    ones by rounds over all nodes."""
    small, large = _by_size(edges.select("scene_id", "source", "target"), ["scene_id"], most)
    kind = edges.schema["scene_id"].dataType.simpleString()
    found = sp.spread(small, "scene_id").groupBy("scene_id").applyInPandas(_components_inside, f"scene_id {kind}, ord long, component long")
    if large is not None:
        name = lambda c: F.struct("scene_id", F.col(c).alias("ord"))
        far = gr.components(large.select(name("source").alias("source"), name("target").alias("target")))
        found = found.unionByName(far.select(F.col("id.scene_id").alias("scene_id"), F.col("id.ord").alias("ord"), F.col("component.ord").alias("component")))
    return nodes.select("scene_id", "ord").join(found.hint("merge"), ["scene_id", "ord"], "left").select("scene_id", "ord", F.coalesce("component", "ord").alias("component"))


def _pairs_within(one: DataFrame, two: DataFrame, metres: float, kept: str) -> DataFrame:
    """(scene_id, ca, cb, source, target, metres, x, y, bx, by) of nodes (scene_id, ord, component, x, y) no farther apart than metres
    whose components satisfy `kept`."""
    a = one.select("scene_id", F.col("ord").alias("source"), F.col("component").alias("ca"), "x", "y")
    b = two.select("scene_id", F.col("ord").alias("target"), F.col("component").alias("cb"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return sp.met_within(a, b, metres).filter(kept)


def _nearest_first(pairs: pd.DataFrame) -> pd.DataFrame:
    """The pairs of every two components that may be the nearest: Spark's own distances, rounded to a micrometre, decide."""
    return pairs[pairs["d"] <= pairs.groupby(["ca", "cb"])["d"].transform("min") + 3e-6]


def _bridging(metres: float, step: int = 1 << 18):
    """A function that gives the free pairs of nodes (scene_id, ord, component, x, y) of a scene for bridges(): nodes in order of
    latitude are compared with those that follow within reach, in steps of about so many pairs."""

    def one(nodes: pa.Table, areas: pa.Table) -> pa.Table:
        n = nodes.to_pandas().sort_values("y", ignore_index=True)
        ids, comp, x, y = (n[c].to_numpy() for c in ("ord", "component", "x", "y"))
        rings = areas["footprint"].combine_chunks()
        lng, lat = np.radians(x), np.radians(y)
        more = np.maximum(np.searchsorted(y, y + metres / 110_000.0, side="right") - np.arange(1, len(n) + 1), 0)
        ends, found, begin = np.cumsum(more), [], 0
        while begin < len(n):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + step, side="right")))
            rows = more[begin:end]
            i = np.repeat(np.arange(begin, end), rows)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(rows) - rows, rows)
            h = np.sin((lat[j] - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[j]) * np.sin((lng[j] - lng[i]) / 2) ** 2
            d = 2 * geo.EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))
            near = (comp[i] != comp[j]) & (d <= metres + 1e-6)
            i, j, d = i[near], j[near], d[near]
            i, j = np.where(comp[i] < comp[j], i, j), np.where(comp[i] < comp[j], j, i)
            free = ~geo.blocked_inside(x[i], y[i], x[j], y[j], rings)
            i, j = i[free], j[free]
            found.append(_nearest_first(pd.DataFrame({"source": ids[i], "target": ids[j], "ca": comp[i], "cb": comp[j], "x": x[i], "y": y[i], "bx": x[j], "by": y[j], "d": d[free]})))
            begin = end
        best = _nearest_first(pd.concat(found)) if found else pd.DataFrame(columns=["source", "target", "ca", "cb", "x", "y", "bx", "by"])
        own = pa.repeat(nodes["scene_id"][0], len(best)) if found else nodes["scene_id"].combine_chunks()
        columns = {"scene_id": own} | {c: pa.array(best[c].to_numpy(), pa.int64()) for c in ("ca", "cb", "source", "target")}
        return pa.table(columns | {c: pa.array(best[c].to_numpy(), pa.float64()) for c in ("x", "y", "bx", "by")})

    return one


def _free_pairs(own: DataFrame, buildings: DataFrame, metres: float) -> DataFrame:
    """Free pairs for bridges() scene by scene inside tasks: only those that may be the nearest leave them."""
    kind = own.schema["scene_id"].dataType.simpleString()
    areas = buildings.select(F.col("scene_id").cast(kind).alias("scene_id"), "footprint")
    both = sp.spread(own, "scene_id").groupBy("scene_id").cogroup(sp.spread(areas, "scene_id").groupBy("scene_id"))
    ids, places = ("ca", "cb", "source", "target"), ("x", "y", "bx", "by")
    out = ", ".join([f"scene_id {kind}", *[f"{c} long" for c in ids], *[f"{c} double" for c in places]])
    pairs = both.applyInArrow(_bridging(metres), out)
    return pairs.withColumn("metres", geo.haversine(P(F.col("x"), F.col("y")), P(F.col("bx"), F.col("by")))).filter(F.col("metres") <= metres)


def bridges(nodes: DataFrame, member: DataFrame, buildings: DataFrame, metres: float = BRIDGE_M, most: int = sp.FEW) -> DataFrame:
    """(scene_id, source, target, kind, metres): for every two components of a scene the nearest pair of nodes no farther apart than
    metres whose line no building blocks; distances equal to a micrometre tie, to the smaller nodes.

    Scenes of at most `most` nodes and buildings find their pairs inside tasks; larger ones by cells."""
    own = nodes.select("scene_id", "ord", "x", "y").join(member.hint("merge"), ["scene_id", "ord"])
    small, large = _by_size(own, ["scene_id"], most, nodes.select("scene_id").unionByName(buildings.select("scene_id")))
    free = _free_pairs(small, buildings, metres)
    if large is not None:
        large = gr.settled(large)
        far = unblocked(gr.settled(_pairs_within(large, large, metres, "ca < cb")), buildings)
        free = free.unionByName(far.select(*free.columns))
    best = free.groupBy("scene_id", "ca", "cb").agg(F.min(F.struct(F.round("metres", 6).alias("d"), "source", "target", "metres")).alias("s"))
    return best.select("scene_id", "s.source", "s.target", F.lit("road_crossing").alias("kind"), "s.metres")


def forced_bridges(nodes: DataFrame, member: DataFrame, buildings: DataFrame, start_m: float = BRIDGE_M) -> DataFrame:
    """(scene_id, source, target, kind, metres, crosses): one edge from each component to the scene's first one (which holds the least
    ord), by the nearest pair whose line no building blocks, however far; only where no pair is free, by the nearest of all.

    Pairs are searched in growing circles: once a component has a free pair within the radius, none outside is nearer, and it
    is done. A component is compared with the whole first one only if buildings wall it in.
    """
    own = gr.settled(nodes.select("scene_id", "ord", "x", "y").join(member.hint("merge"), ["scene_id", "ord"]))
    first = own.groupBy("scene_id").agg(F.min("ord").alias("component"))
    base = gr.settled(own.join(first, ["scene_id", "component"], "left_semi").select("scene_id", "ord", "component", "x", "y"))
    todo = gr.settled(own.join(first, ["scene_id", "component"], "left_anti").select("scene_id", "ord", "component", "x", "y"))
    box = own.groupBy("scene_id").agg(geo.haversine(P(F.min("x"), F.min("y")), P(F.max("x"), F.max("y"))).alias("m"))
    span = box.agg(F.max("m")).head()[0] or 0.0
    out, metres = None, start_m
    while True:
        pairs = gr.settled(_pairs_within(base, todo, metres, "ca <> cb"))
        free = unblocked(pairs, buildings)
        best = lambda df, crosses: df.groupBy("scene_id", "cb").agg(F.min(F.struct(F.round("metres", 6).alias("d"), "source", "target", "metres")).alias("s")).select("scene_id", "cb", "s.source", "s.target", "s.metres", F.lit(crosses).alias("crosses"))
        done = gr.settled(best(free, False))
        out = done if out is None else out.unionByName(done)
        todo = gr.settled(todo.join(done.select("scene_id", F.col("cb").alias("component")), ["scene_id", "component"], "left_anti"))
        if metres >= 1.01 * span + 1:
            walled = pairs.join(todo.select("scene_id", F.col("component").alias("cb")).distinct(), ["scene_id", "cb"], "left_semi")
            out = out.unionByName(best(walled, True))
            return out.select("scene_id", "source", "target", F.lit("road_crossing").alias("kind"), "metres", "crosses")
        if todo.isEmpty():
            return out.select("scene_id", "source", "target", F.lit("road_crossing").alias("kind"), "metres", "crosses")
        metres *= 4


def built(streets: DataFrame, buildings: DataFrame, infrastructure: DataFrame | None = None, areas: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph of streets (scene_id, street_id, name, x, y, bx, by): nodes as of merged(), and edges (scene_id, source, target, kind,
    metres) that connect every scene. infrastructure: (scene_id, ord, kind, x, y), of no side and after all samples in order.
    buildings: (scene_id, id, footprint). areas: (scene_id, ring) to clip to, where given."""
    samples = gr.settled(sampled(streets))
    raw = samples.select("scene_id", "ord", "x", "y", F.lit("street").alias("kind"), "side", "name", "street_id")
    if infrastructure is not None:
        none = lambda t: F.lit(None).cast(t)
        raw = raw.unionByName(infrastructure.select("scene_id", "ord", "x", "y", "kind", none("string").alias("side"), none("string").alias("name"), none("long").alias("street_id")))
    into = gr.settled(absorbed(raw))
    nodes = merged(raw, into)
    nodes = gr.settled(nodes if areas is None else clipped(nodes, areas))
    edges = gr.settled(street_edges(samples, into, nodes, buildings))
    edges = gr.settled(edges.unionByName(bridges(nodes, component_of(nodes, edges), buildings)))
    return nodes, gr.settled(edges.unionByName(forced_bridges(nodes, component_of(nodes, edges), buildings).drop("crosses")))

