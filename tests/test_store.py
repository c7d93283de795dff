"""Documents as rows, and the geometry executor on wrong and right lines."""

import pytest

from terrane.operators import executor as ex
from terrane.operators import store


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("a/x.json", "one\ntwo a+b\n"), ("a/b/y.md", "## Issues\n- first\n- second\ntext\n## Notes\n- other\n"), ("z.txt", "two a+b two")], "path string, content string")


def test_glob(files):
    names = lambda p: sorted(r.path for r in store.glob(files, p).collect())
    assert names("a/*") == ["a/x.json"] and names("a/**") == ["a/b/y.md", "a/x.json"] and names("?.txt") == ["z.txt"] and names("*.json") == []


def test_grep(files):
    assert [(r.path, r.line) for r in store.grep(files, "two").collect()] == [("a/x.json", 2), ("z.txt", 1)]


def test_edit_needs_exactly_one_place(files):
    assert {r.path: r.content for r in store.edit(files, "a/x.json", "a+b", "c").collect()}["a/x.json"] == "one\ntwo c\n"
    with pytest.raises(Exception, match="found 2 times"):
        store.edit(files, "z.txt", "two", "3").collect()


def test_section(files):
    from pyspark.sql import functions as F

    got = files.filter("path LIKE '%md'").select(store.section(F.col("content"), "Issues").alias("i"), store.section(F.col("content"), "None").alias("n")).first()
    assert (got.i, got.n) == (["first", "second"], [])


def test_executor(spark):
    text = "\n".join([
        "prose", '{"op": "dist", "units": "m", "a": [0, 0], "b": [3, 4]}', '{"op": "fly"}', '{"op": "dist", "a": [1]}', "{broken",
        '{"op": "point_in_polygon", "p": [0.5, 1], "ring": [[0,0],[2,0],[2,2]]}', '{"op": "point_in_polygon", "p": [1, 1], "ring": [[0,0],[2,0]]}',
        '{"op": "filter_threshold", "ids": ["u", "v"], "values": [1, 5], "cmp": "ge", "threshold": 3}', '{"op": "segment_intersects_polygon", "a": [-1, 1], "b": [3, 0.5], "ring": [[0,0],[2,0],[2,2]]}',
    ])
    got = [(r.number, r.answer) for r in ex.run(ex.parse(spark.createDataFrame([(1, text)], "id int, text string"))).orderBy("n").collect()]
    assert got == [(5.0, None), (None, "ERROR: unknown op fly"), (None, "ERROR: arguments"), (None, "ERROR: not a request"), (None, "false"), (None, "ERROR: arguments"), (None, "v"), (None, "true")]
    assert [ex.fixed(v, 1) for v in (0.15, 0.25, -2.5)] == ["0.1", "0.3", "-2.5"]


def test_executor_on_many_shapes(spark):
    text = "\n".join([
        '{"op": "midpoint", "units": "m", "a": [0, 0], "b": [3, 5]}',
        '{"op": "convex_hull", "points": {"a": [0,0], "m": [1,1], "b": [2,0], "c": [2,2], "d": [0,2]}}', '{"op": "convex_hull", "points": {"a": [0]}}', '{"op": "convex_hull"}',
        '{"op": "segments_cross_polygons", "segments": {"s": {"a": [-1,1], "b": [3,1]}, "t": {"a": [-1,1], "b": [3,1], "exclude": ["R"]}}, "rings": {"R": [[0,0],[2,0],[2,2],[0,2]], "Q": [[9,9],[10,9],[10,10]]}}',
        '{"op": "segments_cross_polygons", "segments": {}, "rings": {}}',
        '{"op": "nearest_where", "units": "m", "target": [0,0], "exclude_field": "street", "exclude_value": "Oak", "candidates": {"p": {"xy": [1,0], "street": "Oak"}, "q": {"xy": [3,4], "street": "Elm"}, "r": {"xy": [0,2], "street": "Ash"}}}',
        '{"op": "nearest_where", "target": [0,0]}',
    ])
    r = ex.run(ex.parse(spark.createDataFrame([(1, text)], "id int, text string")))
    got = [x.answer for x in r.orderBy("n").collect()]
    assert got[0] == "[1.500000, 2.500000] (m)" and got[1] == "hull: [a, b, c, d]  interior: [m]"
    assert got[4] == "s -> crosses: [R] | t -> crosses: []" and got[6] == "nearest:r | ranked: r(Ash)=2.0, q(Elm)=5.0 | excluded:[p]"
    assert all(got[i].startswith("ERROR") for i in (2, 3, 5, 7))
    bound = {n: ex.complete(ex.parse(spark.createDataFrame([(1, text)], "id int, text string")), n).first().complete for n in (3, 4)}
    assert bound == {3: True, 4: False}


def test_executor_caps_lines(spark):
    text = "\n".join(['{"op": "dist", "a": [0,0], "b": [0,0]}'] * 70)
    assert ex.parse(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")).count() == ex.MOST_LINES


def test_shortest_paths_are_whole_or_an_error(spark):
    from terrane.operators import graph

    edges = spark.createDataFrame([(str(i), str(i + 1), 1.0) for i in range(5)], "source string, target string, cost double")
    starts = spark.createDataFrame([("0",)], "start string")
    assert {(r.id, r.cost) for r in graph.shortest(edges, starts).collect()} == {(str(i), float(i)) for i in range(6)}
    with pytest.raises(RuntimeError):
        graph.shortest(edges, starts, rounds=3)
