"""Updates of zones and indexes against rebuilds, and what an update leaves alone."""

import glob
import os

from terrane.operators import zones as zn

NODES = "scene_id int, id long, kind string, x double, y double"
CABLES = "scene_id int, cable_id string, kind string, source long, target long"
CHANGED = ", op string, seq int"


def made(spark, node_changes=(), cable_changes=(), copies=1):
    """Two scenes with changes; copies: so many pairs of them without changes, ten scene ids apart."""
    n = [(1, 1, "co", 0.0001, 0.0001), (1, 2, "closure", 0.0021, 0.0001), (1, 3, "house", 0.0022, 0.0002), (1, 4, "house", 0.0043, 0.0001), (2, 5, "closure", 0.0, 0.0), (2, 6, "house", 0.01, 0.0)]
    c = [(1, "d1", "distribution", 1, 2), (1, "d2", "drop", 2, 3), (1, "d3", "drop", 2, 4), (2, "d4", "drop", 5, 6)]
    n, c = ([(10 * i + r[0], *r[1:]) for i in range(copies) for r in rows] for rows in (n, c))
    return zn.Change(spark.createDataFrame(n, NODES), spark.createDataFrame(c, CABLES), spark.createDataFrame(list(node_changes), NODES + CHANGED), spark.createDataFrame(list(cable_changes), CABLES + CHANGED))


def figures(nodes, cables):
    at = zn.placed(nodes)
    return zn.summaries(at, zn.spans(cables, at, at))


def streets_of(nodes):
    """A street by the side of a line, so that a move may change it."""
    return nodes.selectExpr("scene_id", "id", "if(x < 0.003, 'West', 'East') AS street")


def indexed(nodes, cables):
    at = zn.placed(nodes)
    return zn.entries(at, zn.spans(cables, at, at), streets_of(at))


CASES = {
    "nothing": ((), ()),
    "a house moves to a new zone": ([(1, 3, "house", 0.0062, 0.0, "put", 1)], ()),
    "a closure goes, its drops with it": ([(1, 2, "closure", None, None, "drop", 1)], ()),
    "the last change of a key counts": ([(1, 4, "house", 0.02, 0.0, "put", 1), (1, 4, "house", 0.0, 0.0, "drop", 2), (1, 9, "house", 0.001, 0.0, "drop", 1)], ()),
    "a house and its drop are new": ([(2, 103, "house", 0.0001, 0.0, "put", 1)], [(2, "d9", "drop", 5, 103, "put", 1)]),
    "a drop turns to another closure": ((), [(1, "d3", "drop", 1, 4, "put", 1)]),
    "a drop goes": ((), [(1, "d2", "drop", 2, 3, "drop", 1)]),
    "a scene is emptied": ([(2, 5, "closure", 0.0, 0.0, "drop", 1), (2, 6, "house", 0.0, 0.0, "drop", 1)], ()),
}


def test_update_equals_rebuild(spark):
    """Every case in scenes of its own."""
    node_changes, cable_changes = ([(10 * i + r[0], *r[1:]) for i, case in enumerate(CASES.values()) for r in case[k]] for k in (0, 1))
    change = made(spark, node_changes, cable_changes, len(CASES))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(zn.update_zones(figures(change.nodes, change.cables), change)) == rows(figures(change.nodes_after, change.cables_after))
    before = indexed(change.nodes, change.cables)
    entries, index = zn.update_index(before, zn.lookup_rows(before), change, streets_of)
    want = indexed(change.nodes_after, change.cables_after)
    assert rows(entries) == rows(want) and rows(index) == rows(zn.lookup_rows(want))


def test_update_reads_only_what_changes_touch(spark):
    change = made(spark, [(1, 3, "house", 0.0062, 0.0, "put", 1)])
    near = sorted((r.scene_id, r.id) for r in change.near_nodes().collect())
    assert near == [(1, 2), (1, 3)]
    touched = sorted((r.scene_id, r.zc, r.zr) for r in change.touched_zones().collect())
    assert touched == [(1, 1, 0), (1, 3, 0)]
    built = figures(change.nodes, change.cables).withColumn("houses", zn.F.col("houses") + 100)
    kept = {(r.scene_id, r.zc, r.zr): r.houses for r in zn.update_zones(built, change).collect()}
    assert kept == {(1, 0, 0): 100, (1, 1, 0): 0, (1, 2, 0): 101, (1, 3, 0): 1, (2, 0, 0): 100, (2, 5, 0): 101}


def test_figures_issues_and_area(spark):
    change = made(spark)
    z = figures(change.nodes, change.cables)
    at = zn.placed(change.nodes)
    one = z.filter("scene_id = 1 AND zc = 1").head()
    assert (one.nodes, one.houses, one.devices, one.cables, one.links, one.errors) == (2, 1, 1, 2, 1, 1)  # the drop of 245 m is too long
    assert one.max_db == 11.49
    got = sorted((r.scene_id, r.issue_id, r.severity) for r in zn.area_issues(z, zn.links(zn.spans(change.cables, at, at))).collect())
    assert got == [(1, "zone-errors-Z1_0", "error"), (2, "zone-errors-Z0_0", "error")]
    got = [r.description for r in zn.area_issues(z, zn.links(zn.spans(change.cables.filter("cable_id <> 'd1'"), at, at))).collect() if r.severity == "warning"]
    assert sorted(got) == ["No fiber connection between zones Z0_0 and Z1_0 (east)", "No fiber connection between zones Z1_0 and Z0_0 (west)"]
    area = {r.scene_id: (r.zones, r.nodes, r.coverage) for r in zn.area(z).collect()}
    assert area == {1: (3, 4, 100.0), 2: (6, 2, 33.333333)}
    high = zn.area_issues(z.withColumn("max_db", zn.F.lit(26.0)), zn.links(zn.spans(change.cables, at, at))).filter("type = 'high_optical_loss'").collect()
    assert sorted(r.description for r in high) == ["2 zones with optical loss > 25dB (approaching 28dB limit)", "3 zones with optical loss > 25dB (approaching 28dB limit)"]


def test_rewrite_leaves_other_parts(spark, tmp_path):
    path = str(tmp_path / "zones")
    change = made(spark)
    z = figures(change.nodes, change.cables)
    zn.rewrite(z, path, ["scene_id"])
    names = lambda s: sorted(map(os.path.basename, glob.glob(f"{path}/scene_id={s}/*.parquet")))
    one, two = names(1), names(2)
    zn.rewrite(z.filter("scene_id = 1").withColumn("nodes", zn.F.lit(7).cast("long")), path, ["scene_id"])
    assert names(2) == two and names(1) != one
    assert spark.read.parquet(path).filter("nodes = 7").count() == 3 and spark.read.parquet(path).count() == z.count()


def test_empty(spark):
    change = made(spark)
    none = zn.Change(change.nodes.limit(0), change.cables.limit(0), change.node_changes, change.cable_changes)
    assert zn.update_zones(figures(none.nodes, none.cables), none).count() == 0
