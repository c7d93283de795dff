"""Routing graphs and spatial search against sequential versions."""

import math
import random

from pyspark.sql import functions as F

from terrane.operators import graph as gr
from terrane.operators import routing as rt
from terrane.operators import spatial as sp
from terrane.operators import streetgraph as sg

X0, Y0 = -73.98, 40.75
EAST, NORTH = 111_320 * math.cos(math.radians(Y0)), 110_540


def metres(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def place(e, n):
    return X0 + e / EAST, Y0 + n / NORTH


def to_segment(p, a, b):
    k = 111_320 * math.cos(math.radians(p[1]))
    (px, py), (ax, ay), (bx, by) = ((x * k, y * NORTH) for x, y in (p, a, b))
    l2 = (bx - ax) ** 2 + (by - ay) ** 2
    t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / l2)) if l2 else 0
    return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))


def test_merging_is_the_sequential_rule(spark):
    rng = random.Random(4)
    rows = [(s, i, *place(rng.uniform(0, 400), rng.uniform(0, 400)), rng.choice(["left", "right", None])) for s in (1, 2) for i in range(250)]
    rows += [(3, i, *place(i * 10.0, 0), None) for i in range(60)]  # a chain in which each waits for the one before
    rng.shuffle(rows)
    want, seeds = {}, {}
    for s, i, x, y, side in sorted(rows, key=lambda r: r[:2]):
        own = seeds.setdefault((s, side), [])
        want[s, i] = next((j for j, p in own if metres(p, (x, y)) <= 15), i)
        if want[s, i] == i:
            own.append((i, (x, y)))
    nodes = spark.createDataFrame(rows, "scene_id int, ord long, x double, y double, side string")
    for cell in (0.02, 0.0005):
        assert {(r.scene_id, r.ord): r.into for r in sg.absorbed(nodes, 15.0, cell).collect()} == want
    assert sg.absorbed(nodes.filter("false")).count() == 0


def test_infrastructure_keeps_its_place(spark):
    rows = [(1, 1, 0.0, 0.0, "street", "right", "A", 10), (1, 2, 4.0, 0.0, "handhole", "right", None, None), (1, 3, 8.0, 0.0, "pole", "right", "B", 11), (1, 4, 900.0, 0.0, "street", "right", "A", 10), (1, 5, 904.0, 0.0, "street", "right", "A", 10)]
    nodes = spark.createDataFrame([(s, o, *place(e, n), *rest) for s, o, e, n, *rest in rows], "scene_id int, ord long, x double, y double, kind string, side string, name string, street_id long")
    got = {r.ord: r for r in sg.merged(nodes, sg.absorbed(nodes)).collect()}
    assert got[1].kind == "intersection" and got[1].name == "A / B" and got[1].streets == [10, 11] and got[1].members == 3
    assert (got[1].x, got[1].y) == place(4, 0)
    assert got[4].kind == "street" and abs(got[4].x - place(902, 0)[0]) < 1e-12


def test_offset_ring_lies_at_the_distance(spark):
    ring = [place(*p) for p in ((0, 0), (300, 0), (350, 200), (100, 260))]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring],)], "ring array<struct<x: double, y: double>>")
    out = df.select(sg.offset_ring(F.col("ring"), 50.0).alias("r")).head().r
    for p in out:
        assert abs(min(to_segment((p.x, p.y), a, b) for a, b in zip(ring, ring[1:] + ring[:1])) - 50) < 0.01
    inside = spark.createDataFrame([(*place(-10, 100),), (*place(-70, 100),), (*place(100, 100),), (*place(-30, -45),)], "x double, y double").crossJoin(df)
    assert [r.i for r in inside.select(sg.inside_buffered(sg.P(F.col("x"), F.col("y")), F.col("ring"), 50.0).alias("i")).collect()] == [True, False, True, False]


def test_forced_bridges_go_around_walls_if_they_can(spark):
    nodes = [(1, 0, 0, 0), (1, 1, 10, 0), (1, 2, 40, 0), (1, 3, 900, 900), (1, 4, 2000, 0), (2, 0, 0, 0)]
    wall = [(25, -30), (30, -30), (30, 5), (25, 5)]
    moat = [(890, 890), (910, 890), (910, 910), (890, 910)]
    df = spark.createDataFrame([(s, o, *place(e, n)) for s, o, e, n in nodes], "scene_id int, ord long, x double, y double")
    b = spark.createDataFrame([(1, k, [{"x": x, "y": y} for x, y in [place(*p) for p in ring + ring[:1]]]) for k, ring in enumerate((wall, moat))], "scene_id int, id long, footprint array<struct<x: double, y: double>>")
    edges = spark.createDataFrame([(1, 0, 1)], "scene_id int, source long, target long")
    member = sg.component_of(df, edges)
    got = {r.target: (r.scene_id, r.source, r.crosses) for r in sg.forced_bridges(df, member, b, 20.0).collect()}
    assert got == {2: (1, 1, True), 3: (1, 1, True), 4: (1, 1, True)}  # node 1 and 0 look along the wall's line
    low = spark.createDataFrame([(1, 9, [{"x": x, "y": y} for x, y in [place(*p) for p in [(25, 1), (30, 1), (30, 5), (25, 5), (25, 1)]]])], "scene_id int, id long, footprint array<struct<x: double, y: double>>")
    free = {r.target: (r.source, r.crosses) for r in sg.forced_bridges(df, member, low, 20.0).collect()}
    assert free == {2: (1, False), 3: (1, False), 4: (1, False)}
    assert {(r.source, r.target, r.kind) for r in sg.bridges(df, member, low).collect()} == {(1, 2, "road_crossing")}
    assert sg.bridges(df, member, b).count() == 0


def test_nearest_in_a_large_scene(spark):
    rng = random.Random(7)
    streets = [(1, i, f"S{i}", *place(e, n), *place(e + rng.uniform(-300, 300), n + rng.choice([0.0, rng.uniform(-300, 300)]))) for i in range(400) for e, n in [(rng.uniform(0, 9000), rng.uniform(0, 9000))]]
    points = [(1, i, *place(rng.uniform(-3000, 12000), rng.uniform(0, 9000))) for i in range(300)]
    s = spark.createDataFrame(streets, "scene_id int, street_id long, name string, x double, y double, bx double, by double")
    p = spark.createDataFrame(points, "scene_id int, id long, x double, y double")
    want = {i: min((round(to_segment((x, y), (a, b), (c, d)), 6), k) for _, k, _, a, b, c, d in streets)[1] for _, i, x, y in points}
    for rings in (True, False):
        assert {r.id: r.street_id for r in sp.nearest_street(p, s, 20.0, rings).collect()} == want
    near = {(r.id, r["rank"]): r.other for r in sp.nearest(p, p, 3, 30.0, True).collect()}
    for _, i, x, y in points:
        order = sorted((round(metres((x, y), (a, b)), 6), j) for _, j, a, b in points if j != i)
        assert [near[i, k] for k in (1, 2, 3)] == [j for _, j in order[:3]]


def test_a_scene_of_a_hundred_thousand_points_grows_in_proportion(spark):
    """Candidates per point of the street index stay the same when a scene grows fourfold at the same density."""
    def candidates(n):
        side = int(n**0.5)
        at = lambda k: [X0 + (F.col(k) % side) * 30 / EAST, Y0 + F.floor(F.col(k) / side) * 30 / NORTH]
        p = spark.range(n).select(F.lit(1).alias("scene_id"), "id", (at("id")[0] + 4e-5).alias("x"), (at("id")[1] + 5e-5).alias("y"))
        x, y = at("id")
        s = spark.range(n // 4).select(F.lit(1).alias("scene_id"), F.col("id").alias("street_id"), F.lit("s").alias("name"), F.col("id")).select("scene_id", "street_id", "name", x.alias("x"), (y * 1 + 0.0).alias("y"))
        s = s.withColumns({"bx": F.col("x") + 60 / EAST, "by": F.col("y") + 10 / NORTH})
        return sp.segments_within(p.filter(F.col("y") < Y0 + side * 30 / NORTH / 8), s, 100.0).count() / (n / 8)

    small, large = candidates(25_600), candidates(102_400)
    assert abs(large / small - 1) < 0.1


def test_merging_by_groups_and_by_sweeps_is_the_same(spark):
    rng = random.Random(5)
    rows = [(s, i, *place(rng.uniform(0, 300), rng.uniform(0, 300)), rng.choice(["left", "right", None])) for s in (1, 2) for i in range(150)]
    nodes = spark.createDataFrame([*rows, (1, 900, None, None, "left")], "scene_id int, ord long, x double, y double, side string")
    found = [sorted(map(tuple, sg.absorbed(nodes, 15.0, most=most).collect())) for most in (10**6, 50, 0)]
    assert len(found[0]) == 301 and found[0] == found[1] == found[2]


def test_components_by_groups_and_by_rounds_are_the_same(spark):
    rng = random.Random(6)
    nodes = spark.createDataFrame([(s, i) for s in (1, 2) for i in range(80)], "scene_id int, ord long")
    edges = spark.createDataFrame([(s, *rng.sample(range(80), 2)) for s, n in ((1, 30), (2, 60)) for _ in range(n)], "scene_id int, source long, target long")
    found = [sorted(map(tuple, sg.component_of(nodes, edges, most).collect())) for most in (10**6, 40, 0)]
    assert len(found[0]) == 160 and found[0] == found[1] == found[2]


def _broadcasts(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_growing_tables_of_a_graph_are_not_sent_to_the_driver(spark):
    """Small tables were broadcast in every step of a graph, so what the driver got grew with the nodes."""
    df = spark.createDataFrame([(s, k, *place(40.0 * k, 0)) for s in (1, 2) for k in range(20)], "scene_id int, ord long, x double, y double")
    df = sg.gr.settled(df)
    edges = sg.gr.settled(spark.createDataFrame([(1, 0, 1)], "scene_id int, source long, target long"))
    b = sg.gr.settled(spark.createDataFrame([(1, 9, [{"x": x, "y": y} for x, y in [place(*p) for p in [(25, 1), (30, 1), (30, 5), (25, 5), (25, 1)]]])], "scene_id int, id long, footprint array<struct<x: double, y: double>>"))
    member = sg.component_of(df, edges)
    assert _broadcasts(member) == 0
    assert _broadcasts(sg.bridges(df, sg.gr.settled(member), b)) == 0


def test_blocked_by_batches_is_the_test_of_expressions(spark):
    rng = random.Random(8)
    ring = lambda n: [{"x": 20 * math.cos(2 * math.pi * k / n) + rng.choice([0.0, 1.0]), "y": 20 * math.sin(2 * math.pi * k / n)} for k in range(n)]
    rows = [(*[float(rng.randint(-30, 30)) for _ in range(4)], r + r[:1] * rng.randint(0, 1)) for _ in range(600) for r in [ring(rng.randint(1, 7))]]
    df = spark.createDataFrame(rows, "x double, y double, bx double, by double, ring array<struct<x: double, y: double>>")
    geo = sg.geo
    one = geo.segment_meets_ring(geo.P(F.col("x"), F.col("y")), geo.P(F.col("bx"), F.col("by")), F.col("ring"), "both_ends")
    got = df.select(one.alias("a"), geo.meets_ring_both_ends("x", "y", "bx", "by", "ring").alias("b")).collect()
    assert all(r.a == r.b for r in got) and 0 < sum(r.a for r in got) < 600


def test_bridges_inside_tasks_and_by_cells_are_the_same(spark):
    """All pairs within reach were written, dealt by cells and sorted; of small scenes only pairs that may be the nearest leave a task."""
    rng = random.Random(9)
    rows = [(s, k, *place(rng.uniform(0, 250), rng.uniform(0, 250)), rng.randint(0, 12)) for s in (1, 2, 3) for k in range(90)]
    rows += [(4, 0, *place(0, 0), 0), (4, 1, *place(60, 0), 1), (4, 2, *place(-60, 0), 1), (4, 3, None, None, 3), (5, 0, *place(0, 0), 0)]  # two of one distance
    own = spark.createDataFrame(rows, "scene_id int, ord long, x double, y double, component long")
    square = lambda e, n, r: [{"x": x, "y": y} for x, y in [place(e + a * r, n + b * r) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]]
    areas = [(s, k, square(rng.uniform(0, 250), rng.uniform(0, 250), 12)) for s in (1, 2, 9) for k in range(40)]
    b = spark.createDataFrame([*areas, (1, 99, None), (2, 99, [])], "scene_id int, id long, footprint array<struct<x: double, y: double>>")
    nodes, member = own.drop("component"), own.select("scene_id", "ord", "component")
    found = [sorted(map(tuple, sg.bridges(nodes, member, b, 60.5, most).collect())) for most in (10**6, 100, 0)]
    assert len(found[0]) > 100 and found[0] == found[1] == found[2]
    assert [r[1:3] for r in found[0] if r[0] == 4] == [(0, 1)] and {r[0] for r in found[0]} == {1, 2, 3, 4}
    assert sg._free_pairs(own, b, 60.5).count() < 1.1 * len(found[0]) < sg._pairs_within(own, own, 60.5, "ca < cb").count() / 4
    parts = sorted(sg._free_pairs(own, b, 60.5).select("scene_id", "source", "target").collect())
    one, small = sg._bridging(60.5), sg._bridging(60.5, 50)
    tables = [own.filter("scene_id = 1").toArrow(), b.filter("scene_id = 1").toArrow()]
    cut = lambda t: {(r["ca"], r["cb"], r["source"], r["target"]) for r in t.to_pylist()}
    assert cut(one(*tables)) == cut(small(*tables)) and len(cut(one(*tables))) == sum(r.scene_id == 1 for r in parts)


def test_reach_by_components_is_reach_over_both_ways_without_rounds(spark):
    """Shortest ways took a round for each link of the longest one, for a column that only says whether there is a way."""
    chain = [(1, i, *place(50.0 * i, 0)) for i in range(12)]
    rows = [*chain, (1, 20, *place(0, 500)), (1, 21, *place(0, 540)), (2, 30, *place(0, 0)), (2, 9, *place(60, 0)), (2, 10, *place(-60, 0))]
    nodes = gr.settled(spark.createDataFrame(rows, "scene_id int, ord long, x double, y double"))
    edges = gr.settled(spark.createDataFrame([(1, i, i + 1) for i in range(11)] + [(1, 20, 21)], "scene_id int, source long, target long"))
    points = gr.settled(spark.createDataFrame([(1, 1, *place(550, 9)), (1, 2, *place(0, 530)), (1, 3, *place(0, -101)), (1, 4, *place(275, 0)), (2, 5, *place(0, 40)), (2, 6, None, None), (3, 7, *place(0, 0)), (2, 8, *place(0, -99))], "scene_id int, id long, x double, y double"))
    offices = gr.settled(spark.createDataFrame([(1, *place(10, 0)), (2, *place(0, 0))], "scene_id int, x double, y double"))
    named = nodes.join(sg.component_of(nodes, edges), ["scene_id", "ord"]).withColumn("id", F.col("ord").cast("string")).drop("ord")
    text = lambda c: F.col(c).cast("string").alias(c)
    ways = gr.both_ways(edges.select(text("source"), text("target"), F.lit(1.0).alias("cost")))
    keep = ("scene_id", "id", "node", "distance", "reason")
    want = sorted(map(tuple, rt.reach(points.withColumn("id", text("id")), offices, named, ways, 100.0).withColumn("id", F.col("id").cast("long")).select(*keep).collect()), key=repr)
    spark.sparkContext.setJobGroup("by-component", "")
    got = sorted(map(tuple, rt.reach_by_component(points, offices, gr.settled(named), 100.0).select(*keep).collect()), key=repr)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("by-component"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and jobs < 20
    assert {r[1]: (r[2], r[4]) for r in got} == {1: ("11", "reachable"), 2: ("21", "different_component"), 3: (None, "too_far_from_graph"), 4: ("5", "reachable"), 5: ("30", "reachable"), 6: (None, "too_far_from_graph"), 7: (None, "too_far_from_graph"), 8: ("30", "reachable")}
