"""Seeded tiles against the sequential rule, and questions with their graders."""

import math

import pytest
from pyspark.sql import functions as F

from terrane.operators import questions as qu
from terrane.operators import tiles as ti


def hashed(text):
    h = 2166136261
    for c in text:
        h = (h ^ ord(c)) * 16777619 % 2**32
    return h


def sequence(text):
    s = hashed(text) or 1
    while True:
        s = (s * 1103515245 + 12345) % 2**32
        yield s / 2**32


def around(lng, lat, metres):
    w, h = metres / 2 / (111320 * math.cos(math.radians(lat))), metres / 2 / 110540
    return lng - w, lat - h, lng + w, lat + h


def one_by_one(seed, boxes):
    """The first try that passes, made one after the other."""
    x0, y0, x1, y1 = ti.SLICE
    mid = around(x0, (y0 + y1) / 2, ti.TILE_M)
    mx, my = (mid[2] - mid[0]) / 2 + 0.001, (mid[3] - mid[1]) / 2 + 0.001
    rand = sequence(f"tile|{seed}")
    for attempt in range(500):
        lng = x0 + mx + next(rand) * (x1 - x0 - 2 * mx)
        b = around(lng, y0 + my + next(rand) * (y1 - y0 - 2 * my), ti.TILE_M)
        if not any(b[0] < q[2] and b[2] > q[0] and b[1] < q[3] and b[3] > q[1] for q in boxes):
            return attempt, *b
    return None, None, None, None, None


@pytest.mark.parametrize("cover", ["windows", "nearly all", "all", "none"])
def test_tiles_equal_the_sequential_rule(spark, cover):
    x0, y0, x1, y1 = ti.SLICE
    named = "x0 double, y0 double, x1 double, y1 double"
    windows = ti.evaluation_boxes(spark)
    boxes = {
        "windows": windows, "none": windows.limit(0), "all": spark.createDataFrame([ti.SLICE], named),
        "nearly all": spark.createDataFrame([(x0, y0, x1 - 0.006, y1), (x0, y0, x1, y1 - 0.012)], named),
    }[cover]
    plain = [tuple(r) for r in boxes.collect()]
    seeds = list(range(12)) + [2**40]
    got = {r.seed: tuple(r)[1:] for r in ti.tiles(spark.createDataFrame([(s,) for s in [*seeds, 3, 3, None]], "seed long"), boxes).collect()}
    assert sorted(got) == seeds
    for s in seeds:
        want = one_by_one(s, plain)
        assert got[s][0] == want[0] and (want[0] is None or got[s][1:] == pytest.approx(want[1:], abs=1e-12))
    if cover == "nearly all":
        assert max(g[0] for g in got.values() if g[0] is not None) >= ti.FIRST  # the later tries count on


def test_evaluation_boxes(spark):
    got = sorted(tuple(r) for r in ti.evaluation_boxes(spark).collect())
    want = sorted(around(-73.984 + ((r * 73 % 100) / 100 - 0.5) * 0.02, 40.7549 + ((r * 91 % 100) / 100 - 0.5) * 0.02, 550) for r in range(100))
    assert got == [pytest.approx(w, abs=1e-12) for w in want]


def test_draws_picks_and_wording(spark):
    rows = spark.createDataFrame([(s, i) for s in range(6) for i in range(10 * s, 10 * s + s + 1)], "scene_id int, id long")
    got = {r.scene_id: r.id for r in qu.picked(rows, "degree", "id", 2).collect()}
    for s in range(6):
        rand = sequence(f"degree|{s}")
        next(rand)
        assert got[s] == 10 * s + math.floor(next(rand) * (s + 1))
    lines = spark.createDataFrame([(s, "7", None, "{}") for s in range(6)], "scene_id int, a string, b string, truth string")
    words = ("first {a}", "second {a}{b}")
    said = {r.scene_id: r.question for r in qu.asked(lines, "nearest", words, 1).collect()}
    assert said == {s: ("first 7", "second 7")[math.floor(next(sequence(f"nearest|{s}")) * 2)] for s in range(6)}


GRADES = [
    ("containment", '{"equipmentIds":["1","2"]}', '{"equipmentIds":["2","1"],"why":"x"}', True),
    ("containment", '{"equipmentIds":["1","2"]}', '{"equipmentIds":["2","1","1"]}', False),
    ("containment", '{"equipmentIds":["1"]}', '{"equipmentIds":"1"}', True),
    ("containment", '{"equipmentIds":[]}', '{"equipmentIds":"none"}', True),
    ("containment", '{"equipmentIds":["1"]}', '{"equipmentIds":[1]}', True),
    ("containment", '{"equipmentIds":[]}', '{"buildingIds":[]}', False),
    ("crossing", '{"cableIds":[]}', '{"cableIds":[]}', True),
    ("nearest", '{"closureId":"5"}', '{"closureId":"5"}', True),
    ("nearest", '{"closureId":"5"}', '{"closureId":"6"}', False),
    ("street_of", '{"street":"Name 3"}', '{"street":"name 3"}', False),
    ("degree", '{"count":3}', '{"count":"3"}', True),
    ("degree", '{"count":3}', '{"count":3.5}', False),
    ("degree", '{"count":3}', '{"count":"many"}', False),
    ("dist_pair", '{"meters":10.0}', '{"meters":10.6}', True),
    ("dist_pair", '{"meters":10.0}', '{"meters":10.7}', False),
    ("dist_pair", '{"meters":10.0}', '{"meters":"10.0"}', False),
    ("dist_pair", '{"meters":10.0}', "no json", False),
    ("quadrant_of", '{"quadrant":"NE"}', None, False),
    ("riddle", "{}", "{}", None),
]


def test_graders(spark):
    rows = spark.createDataFrame([(i, *g) for i, g in enumerate(GRADES)], "i int, family string, truth string, answer string, want boolean")
    got = rows.select("i", "want", qu.graded(F.col("family"), F.col("truth"), F.col("answer")).alias("got")).collect()
    assert [GRADES[r.i] for r in got if r.got != r.want] == []
