"""Text maps, vocabularies, fibres and shuffles on cases that the queries do not reach."""

from pyspark.sql import functions as F

from terrane.functions import random as rd
from terrane.functions import skins as sk
from terrane.operators import fibres as fb
from terrane.operators import graph as gr
from terrane.operators import textmap as tm

LINE = "array<struct<x: double, y: double>>"


def _plain_line(c0, r0, c1, r1):
    """Cells between two cells: one step at a time along the longer side."""
    dc, dr = abs(c1 - c0), abs(r1 - r0)
    steps = max(dc, dr)
    out = []
    for i in range(steps + 1):
        side = -((-(2 * i * min(dc, dr) - steps)) // (2 * steps)) if steps else 0  # i * short / long, halves down
        a, b = (i, side) if dc >= dr else (side, i)
        out.append((c0 + a * (1 if c1 >= c0 else -1), r0 + b * (1 if r1 >= r0 else -1)))
    return out


def test_line_cells(spark):
    ends = [(0, 0, 0, 0), (0, 0, 7, 3), (7, 3, 0, 0), (2, 9, 4, 0), (0, 0, 4, 2), (5, 5, 1, 1), (3, 1, 3, 6)]
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "k int, c0 int, r0 int, c1 int, r1 int")
    got = {}
    for r in tm.line_cells(df).collect():
        got.setdefault(r.k, set()).add((r.col, r.row))
    for i, e in enumerate(ends):
        assert got[i] == set(_plain_line(*e)) and {e[:2], e[2:]} <= got[i]


def test_map_of_a_frame_without_shapes_and_with_shapes_outside(spark):
    frames = spark.createDataFrame([(1, 0.0, 0.0, 0.001, 0.001), (2, 5.0, 5.0, 5.0, 5.0)], "scene_id int, min_x double, min_y double, max_x double, max_y double")
    f = tm.framed(frames, F.lit(8))
    streets = spark.createDataFrame([(1, 0, "Long Way", [(9.0, 9.0), (9.0, 8.0)]), (1, 1, None, []), (3, 0, "x", [(0.0, 0.0), (1.0, 1.0)])], f"scene_id int, ord int, name string, line {LINE}")
    buildings = spark.createDataFrame([], f"scene_id int, ord int, id string, x double, y double, footprint {LINE}, type string, floors int, address string")
    drawn = tm.grid(f, tm.geography(f, streets.filter("ord = 1 OR scene_id = 3"), buildings)).collect()
    assert len(drawn) == sum(r.gh for r in f.collect()) and all(set(r.line.split(" | ")[1]) == {".", " "} for r in drawn)
    equipment = spark.createDataFrame([(1, 0, "CO-1", "co", 0.0, 0.0, []), (1, 1, "CL-A", "closure", 7.0, 7.0, ["B-1"])], "scene_id int, ord int, id string, kind string, x double, y double, serves array<string>")
    cables = spark.createDataFrame([(1, 0, "far", "drop", "CO-1", "CL-A", [(0.0, 0.0), (7.0, 7.0)])], f"scene_id int, ord int, id string, kind string, source string, target string, line {LINE}")
    lines = {(r.scene_id, r.row): r.line.split(" | ")[1].split(" ") for r in tm.grid(f, tm.network(f, equipment, cables)).collect()}
    gh = next(r.gh for r in f.collect() if r.scene_id == 1)
    assert lines[1, gh - 1][0] == "*" and lines[1, 0][7] == "a" and "/" in lines[1, gh // 2]
    legend = {(r.section, r.n): r.line for r in tm.legend(f, streets, buildings, equipment, cables).collect()}
    assert "feeds=CL-A inside=none" in legend["equipment", 0] and "serves=B-1" in legend["equipment", 1] and "terminates_in" not in legend["cable", 0]


def test_skins_of_null_and_unknown(spark):
    rows = [("CL-A and a closure", "water"), (None, "water"), ("CL-A", "none"), ("CL-A", None), ("", "generic")]
    df = spark.createDataFrame(rows, "t string, s string")
    assert [r[0] for r in df.select(sk.apply(F.col("t"), F.col("s"))).collect()] == ["VL-A and a valve", None, "CL-A", "CL-A", ""]
    back = spark.createDataFrame([('{"valveId": "VL-A", "pipeIds": ["svc-1", "PL-2"]}', "water")], "t string, s string")
    assert back.select(sk.undo(F.col("t"), F.col("s"))).first()[0] == '{"closureId": "CL-A", "cableIds": ["drop-1", "CO-2"]}'


def test_hash_and_shuffle(spark):
    df = spark.createDataFrame([("", []), ("a", [1]), ("foobar", [1, 2, 3, 4, 5])], "t string, a array<int>")
    got = df.select(rd.hash32(F.col("t")).alias("h"), rd.shuffled(F.col("a"), F.lit(0)).alias("a")).collect()
    assert [r.h for r in got] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]  # published values of the hash
    assert [sorted(r.a) for r in got] == [[], [1], [1, 2, 3, 4, 5]]


def test_fibres_of_a_device_with_more_below_than_it_holds(spark):
    devices = spark.createDataFrame([("cab", "1:4", 12), ("none", "1:2", 0), ("alone", None, 3)], "id string, ratio string, fibres int")
    below = spark.createDataFrame([("cab", f"cl-{i}", i, 24) for i in range(400)], "id string, target string, ord int, fibres int")
    rows = fb.allocation(devices, below).collect()
    cab = sorted((r.fibre, r.usage, r.destination) for r in rows if r.id == "cab")
    assert [c[0] for c in cab] == list(range(1, 13)) and [c[2] for c in cab[1:]] == [f"cl-{i // 2}" for i in range(11)]
    assert sorted((r.fibre, r.usage) for r in rows if r.id == "alone") == [(1, "splitter_input"), (2, "reserve"), (3, "reserve")] and not [r for r in rows if r.id == "none"]
    drops = spark.createDataFrame([("cab", f"h-{i}", f"x-{i}", i) for i in range(9)], "id string, target string, cable string, ord int")
    ports = fb.ports(devices, drops)
    held = {(r.id, r.port): r.address for r in ports.collect()}
    assert [held["cab", p] for p in (1, 2, 3, 4)] == ["h-0", "h-1", "h-2", "h-3"] and held["none", 2] is None and len(held) == 14
    ask = spark.createDataFrame([("cab", 1, None, None), ("cab", 2, "new", "y"), ("none", 1, "new", "y"), ("cab", 99, "new", "y")], "id string, port int, address string, cable string")
    now = {(r.id, r.port): (r.address, r.status) for r in fb.changed(ports, ask).collect()}
    assert now["cab", 1] == (None, "available") and now["cab", 2] == ("h-1", "allocated") and now["none", 1] == ("new", "allocated") and len(now) == 14
    found = {(r.id, r.problem) for r in fb.problems(devices, fb.allocation(devices, below), ports).collect()}
    assert found == {("none", "no splitter input")}


def test_trace_without_a_bound(spark):
    n = 70
    cables = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 0) for i in range(n)], "source string, target string, ord int")
    starts = spark.createDataFrame([(f"n{n}",), ("other",)], "id string")
    got = {r.id: r.path for r in gr.trace_up(starts, cables, None).collect()}
    assert got[f"n{n}"] == [f"n{i}" for i in range(n, -1, -1)] and got["other"] == ["other"]


def test_every_port_of_a_large_splitter_is_dealt(spark):
    devices = spark.createDataFrame([("big", "1:256", 12), ("small", "1:2", 12)], "id string, ratio string, fibres int")
    drops = spark.createDataFrame([(d, f"h-{i}", f"c-{i}", i) for d in ("big", "small") for i in range(300)], "id string, target string, cable string, ord int")
    rows = fb.ports(devices, drops).collect()
    assert {(r.id, r.port): r.address for r in rows} == {("big", i + 1): f"h-{i}" for i in range(256)} | {("small", 1): "h-0", ("small", 2): "h-1"}
