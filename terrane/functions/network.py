"""Rules of fibre networks as Column expressions: tiers, zones, losses, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BUDGET = 28.0
FIBRE_DB_KM, CONNECTOR_DB, SPLICE_DB = 0.35, 0.5, 0.1
#: Splitter losses by profile and outputs; what a missing ratio counts; connectors and splices; reserve; decimals.
SPLITTERS = {
    "index": {2: 3.6, 4: 7.2, 8: 10.8, 16: 14.1, 32: 17.5},
    "twin": {4: 7.3, 8: 10.7, 16: 14.1, 32: 17.5},
    "zone": {2: 3.6, 4: 7.2, 8: 10.8, 16: 14.1, 32: 17.5},
    "closure": {2: 3.6, 4: 7.2, 8: 10.8, 16: 14.1, 32: 17.5, 64: 21.0},
    "port": {2: 3.6, 4: 7.2, 8: 10.8, 16: 14.1, 32: 17.5},  # the splitter alone
}
MISSING = {"index": 10.8, "twin": 0.0, "zone": 0.0, "closure": 10.8, "port": 10.8}
RESERVE = {"index": 0.0, "twin": 3.0, "zone": 0.0, "closure": 3.0}
DECIMALS = {"index": 2, "twin": 1, "zone": None, "closure": 2}


def tier(source: Column, target: Column) -> Column:
    """feeder, distribution or drop by the kinds at the ends, in either order."""
    ends = F.array_sort(F.array(source, target))
    has = lambda *k: F.array_contains(ends, k[0]) & F.arrays_overlap(ends, F.array(*map(F.lit, k[1:])))
    return F.when(has("cabinet", "co"), "feeder").when(has("house", "closure", "den"), "drop").otherwise("distribution")


def splitter_db(ways: Column, profile: str) -> Column:
    out = F.lit(MISSING[profile])
    for n, db in SPLITTERS[profile].items():
        out = F.when(ways == n, F.lit(db)).otherwise(out)
    return out


def path_db(metres: Column, hops: Column, closures: Column, splitters: Column, profile: str) -> Column:
    """Loss of a path: fibre, splitters (a sum), and connectors and splices counted as the profile does."""
    fixed = {
        "index": CONNECTOR_DB * hops + SPLICE_DB * closures,
        "twin": CONNECTOR_DB * hops + SPLICE_DB * closures,
        "zone": F.lit(3 * CONNECTOR_DB + 3 * SPLICE_DB),
        "closure": F.lit(3 * CONNECTOR_DB + 3 * SPLICE_DB),
    }[profile]
    loss = metres / 1000 * FIBRE_DB_KM + splitters + fixed + RESERVE[profile]
    return loss if DECIMALS[profile] is None else F.floor(loss * 10 ** DECIMALS[profile] + 0.5) / 10 ** DECIMALS[profile]


def optical_status(db: Column) -> Column:
    return F.when(db >= 27, "critical").when(db >= 25, "warning").otherwise("ok")


def cable_status(crosses: Column, off_road: Column, kind: Column, metres: Column) -> Column:
    limit = F.when(kind == "drop", 100).when(kind == "distribution", 500).otherwise(2000)
    return F.when(crosses, "CROSSES_BUILDING").when(off_road, "OFF_ROAD").when(metres > limit, "TOO_LONG").otherwise("OK")


def _letter(n: Column) -> Column:
    return F.char(65 + n)


def zone(x: Column, y: Column, box: tuple[float, float, float, float], rows: int, cols: int, scheme: str) -> Column:
    """Zone id by one of three schemes: north (row letter from the north; outside: null), south (column letter, row number from
    the south; clamped), fixed (row letter from the south, cells of 0.0018 by 0.0024 degrees; outside: 'default')."""
    x0, y0, x1, y1 = box
    inside = x.between(x0, x1) & y.between(y0, y1)
    if scheme == "north":
        col = F.least(F.floor((x - x0) / ((x1 - x0) / cols)), F.lit(cols - 1))
        row = F.least(F.floor((y1 - y) / ((y1 - y0) / rows)), F.lit(rows - 1))
        return F.when(inside, F.concat(_letter(row), (col + 1).cast("string")))
    if scheme == "south":
        col = F.least(F.lit(cols - 1), F.greatest(F.lit(0), F.floor((x - x0) / (x1 - x0) * cols)))
        row = F.least(F.lit(rows - 1), F.greatest(F.lit(0), F.floor((y - y0) / (y1 - y0) * rows)))
        return F.concat(_letter(col), (row + 1).cast("string"))
    col, row = F.least(F.floor((x - x0) / 0.0024), F.lit(99)), F.least(F.floor((y - y0) / 0.0018), F.lit(25))
    return F.when(inside, F.concat(_letter(row), (col + 1).cast("string"))).otherwise("default")


def grid_preset(n: Column) -> Column:
    return F.when(n <= 5, "small").when(n <= 15, "medium").when(n <= 40, "large").otherwise("xlarge")


def enclosure_size(fibres: Column) -> Column:
    return F.when(fibres <= 12, 12).when(fibres <= 24, 24).when(fibres <= 48, 48).otherwise(96)
