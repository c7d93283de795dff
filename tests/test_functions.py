"""Functions on fixed cases, with values worked out by hand or published."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrane.functions import geo, stats
from terrane.functions import text as tx
from terrane.functions.geo import P
from terrane.operators import evaluation as ev
from terrane.operators import graph as gr
from terrane.operators import procedural as pr
from terrane.sources import readers


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def ring(*xy):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy]).cast("array<struct<x:double,y:double>>")


def p(x, y):
    return P(F.lit(float(x)), F.lit(float(y)))


def test_paired_test_has_the_published_values(spark):
    s = lambda b, c: stats.mcnemar(F.lit(b), F.lit(c))
    r = one(spark, a=s(14, 9)[0], b=s(14, 9)[1], c=s(67, 67)[0], d=s(67, 67)[1], e=s(0, 0)[0], f=s(0, 0)[1])
    assert (round(r.a, 2), round(r.b, 4), round(r.c, 2), round(r.d, 4), r.e, r.f) == (0.70, 0.4042, 0.01, 0.9312, 0.0, 1.0)


def test_interval_of_nothing_is_zero(spark):
    a, lo, hi = stats.wilson(F.lit(0), F.lit(0))
    r = one(spark, a=a, lo=lo, hi=hi)
    assert (r.a, r.lo, r.hi) == (0.0, 0.0, 0.0)
    a, lo, hi = stats.wilson(F.lit(54), F.lit(120))
    r = one(spark, a=a, lo=lo, hi=hi)
    assert (round(r.a, 3), round(r.lo, 3), round(r.hi, 3)) == (0.45, 0.364, 0.539)


def test_erfc_is_close(spark):
    for x in (-2.0, -0.3, 0.0, 0.5, 1.7, 3.0):
        assert abs(one(spark, v=stats.erfc(F.lit(x))).v - math.erfc(x)) < 2e-7


def test_point_in_ring_with_and_without_the_closing_vertex(spark):
    square, open_ = ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)), ring((0, 0), (2, 0), (2, 2), (0, 2))
    r = one(spark, a=geo.in_ring(p(1, 1), square), b=geo.in_ring(p(1, 1), open_), c=geo.in_ring(p(3, 1), square), d=geo.in_ring(p(1, 1), ring()), e=geo.in_ring(p(-1, 2), square))
    assert tuple(r) == (True, True, False, False, False)


def test_crossing_is_proper_and_touching_is_not(spark):
    r = one(
        spark, a=geo.crosses(p(0, 0), p(2, 2), p(0, 2), p(2, 0)), b=geo.crosses(p(0, 0), p(2, 0), p(1, 0), p(1, 2)), c=geo.touches(p(0, 0), p(2, 0), p(1, 0), p(1, 2)),
        d=geo.touches(p(0, 0), p(2, 0), p(3, 0), p(4, 0)), e=geo.segment_meets_ring(p(-1, 1), p(3, 1), ring((0, 0), (2, 0), (2, 2), (0, 2)), "sampled"),
    )
    assert tuple(r) == (True, False, True, False, True)


def test_clip(spark):
    lit = [F.lit(float(v)) for v in (0, 0, 2, 2)]
    r = one(spark, a=geo.clip(p(-1, 1), p(3, 1), *lit), b=geo.clip(p(5, 5), p(6, 6), *lit))
    assert tuple(r.a) == (0.0, 1.0, 2.0, 1.0) and r.b is None


def test_distance_of_a_short_line(spark):
    r = one(spark, a=geo.polyline_metres(p(0, 0), ring((0, 0))), b=geo.segment_metres(p(0, 0), p(0, 0.001), p(0, 0.001)), c=geo.haversine(p(0, 0), p(0, 1)))
    assert r.a == math.inf and abs(r.b - 110.54) < 1e-9 and abs(r.c - 111194.926) < 0.01


def test_hull_against_support_directions():
    rng = random.Random(3)
    for n in (1, 2, 3, 40):
        xy = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)]
        corners = {xy[i] for i in pr.hull_order(xy)}
        for k in range(64):
            d = (math.cos(k / 10.1), math.sin(k / 10.1))
            assert max(c[0] * d[0] + c[1] * d[1] for c in corners) == pytest.approx(max(c[0] * d[0] + c[1] * d[1] for c in xy))


def test_line_of_cells_is_connected_and_ends_where_it_should():
    for c, r in ((5, 2), (-4, 7), (0, 0), (3, -3)):
        cells = list(pr.cells_on_line(1, 1, c, r))
        assert cells[0] == (1, 1) and cells[-1] == (c, r) and len(cells) == max(abs(c - 1), abs(r - 1)) + 1
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(cells, cells[1:]))


def test_route_goes_around():
    wall = {(3, y) for y in range(0, 6)}
    way = pr.route(8, 8, wall, (0, 0), (7, 0))
    assert way[0] == (0, 0) and way[-1] == (7, 0) and not wall & set(way)
    assert pr.route(8, 8, {(3, y) for y in range(8)}, (0, 0), (7, 0)) == []


def test_generator_is_known():
    draw = pr.mulberry32(1)
    assert [round(next(draw), 6) for _ in range(3)] == [0.627074, 0.002736, 0.527447]


def test_text(spark):
    lit = F.lit
    r = one(
        spark, a=tx.address_plain(lit("Çédille-Str. 4, X")), b=tx.street_of(lit("45 Herzl St")), c=tx.street_of(lit("Herzl 45, Tel Aviv")), d=tx.number_of(lit("45A Main St")),
        e=tx.last_json(lit('x {"a": {"b": 1}} y {broken')), f=tx.splitter_ways(lit("1:32")), g=tx.splitter_ways(lit(None).cast("string")), h=tx.fibre_colour(lit(13)),
        i=tx.street_label(lit("Very Long Name Avenue")), j=tx.equipment_parts(lit("TLV-A1-CL-007"))["number"], k=F.size(tx.wkt_points(lit("POLYGON ((1 2, 3 x, 5 6), (0 0))"))), l=tx.wkt_points(lit("CIRCLE (1 2)")),
    )
    assert tuple(r) == ("cedille str 4 x", "Herzl St", "Herzl", "45A", '{"a": {"b": 1}}', 32, 8, "blue", "[VERY LONG NAME ]", 7, 2, None)


def test_grading(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    r = one(
        spark, a=ev.set_equal(a("x ", "y", "y"), a("y", "x")), b=ev.ordered_equal(a("x ", "y"), a("x", "y")), c=ev.bag_equal(a("x", "x"), a("x")),
        d=ev.set_equal(F.lit(None).cast("array<string>"), a()), e=F.size(ev.unknown_ids(a("x", " y ", "z", "z"), a("x", "y"))), f=ev.asked(F.lit("  ")), g=ev.asked(F.lit(None).cast("string")),
    )
    assert tuple(r) == (True, True, False, True, 1, False, False)


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    least = {}

    def root(x):
        least.setdefault(x, x)
        while least[x] != x:
            x = least[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        least[b] = a
    got = {r.id: r.component for r in gr.components(spark.createDataFrame(edges, "source long, target long")).collect()}
    assert got == {x: root(x) for x in least}


def test_trace_stops_at_a_cycle(spark):
    cables = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("a", "c", 3)], "source string, target string, ord int")
    got = {r.id: r.path for r in gr.trace_up(spark.createDataFrame([("c",), ("z",)], "id string"), cables).collect()}
    assert got == {"c": ["c", "a", "b"], "z": ["z"]}


def test_items_survive_line_breaks(spark, tmp_path):
    row = ("s1", "m", "json", "q", "c", 0, True, 5, 6, 7, True, ["a\nb", 'c"d'], "x, y", None, None)
    schema = readers.ITEMS.replace("hallucinatedIds string", "hallucinatedIds array<string>")
    readers.write_graded_items(spark.createDataFrame([row], schema), f"{tmp_path}/items")
    assert readers.graded_items(spark, f"{tmp_path}/items").select("hallucinatedIds", "missingInfo").first() == (["a\nb", 'c"d'], "x, y")


def test_city_extract(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"city": "x", "buildings": [{"id": "b1", "polygon": [[0,0],[1,0],[1,1]]}, {"id": "b2", "polygon": [[0,0]]}]}')
    (tmp_path / "s.json").write_text('{"city": "x", "segments": [{"id": "s1", "type": "service", "coordinates": [[0,0],[1,0]]}, {"id": "s2", "type": "primary", "coordinates": [[0,0],[1,0]]}]}')
    assert [r.id for r in readers.city_buildings(spark, f"{tmp_path}/c.json").collect()] == ["b1"]
    assert [r.id for r in readers.city_streets(spark, f"{tmp_path}/s.json").collect()] == ["s2"]


def test_stream_gives_the_batch_result(spark, tmp_path):
    from conftest import DATA

    from terrane.streaming.accuracy import windowed_accuracy

    e = spark.read.parquet(f"{DATA}/events.parquet").select("ts", F.col("event_type").alias("arm"), (F.col("value") >= 40).alias("correct"))
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = windowed_accuracy(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), "1 day")
    q = stream.writeStream.format("memory").queryName("acc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("acc").collect())) == sorted(map(tuple, windowed_accuracy(e, "1 day").collect()))


def test_documents_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("z", "a", 1.5, 2.5), ("z", "b", 3.0, 4.0)], "zone string, id string, x double, y double")
    lines = spark.createDataFrame([("z", "c", 1.5, 2.5, 3.0, 4.0)], "zone string, id string, x double, y double, bx double, by double")
    readers.feature_collection(nodes, "zone", lines).select("geojson").write.text(f"{tmp_path}/geo")
    got, ways = readers.zone_features(spark, f"{tmp_path}/geo")
    assert sorted((r.id, r.position.x, r.position.y) for r in got.collect()) == [("a", 1.5, 2.5), ("b", 3.0, 4.0)]
    assert [(r.id, len(r.path), r.path[1].y) for r in ways.collect()] == [("c", 2, 4.0)]

    (tmp_path / "rows.jsonl").write_text('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "family": "f", "scene": "s"}\nbroken\n')
    assert [(r.turn, r.role, r.content) for r in readers.tool_rows(spark, f"{tmp_path}/rows.jsonl").orderBy("turn").collect()] == [(0, "user", "q"), (1, "assistant", "a")]

    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "lng": 1, "lat": 2}, {"id": "b", "lng": 1, "lat": 3}], "edges": [{"id": "e", "source": "a", "target": "b", "distance": 5}, {"id": "x", "source": "a", "target": "none"}]}')
    n, e = readers.routing_graph(spark, f"{tmp_path}/g.json")
    assert n.count() == 2 and [r.id for r in e.collect()] == ["e"]
    readers.write_routing_graph(n, e, f"{tmp_path}/graph")
    assert spark.read.json(f"{tmp_path}/graph/edges").first().distance == 5

    (tmp_path / "m.md").write_text("# Site\n## Issues\n- 2024-05-01 duct full\n- no permit\ntext\n## Notes\n- call first\n")
    assert [(r.section, r.entry, str(r.day)) for r in readers.memory_entries(spark, f"{tmp_path}/m.md").orderBy("section", "at").collect()] == [("Issues", "2024-05-01 duct full", "2024-05-01"), ("Issues", "no permit", "None"), ("Notes", "call first", "None")]

    readers.write_report(spark.createDataFrame([("b", "| b |"), ("a", "| a |")], "arm string, line string"), f"{tmp_path}/report", "Run")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()] == ["# Run", "| arm | n | correct | share |", "|-|-|-|-|", "| a |", "| b |"]
    readers.write_split(spark.createDataFrame([(1, "train"), (2, "val")], "id int, split string"), f"{tmp_path}/split")
    assert spark.read.json(f"{tmp_path}/split/split=val").first().id == 2
