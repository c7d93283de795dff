"""Seeded tiles that keep clear of given boxes: rejection sampling as rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import random as rd
from terrane.operators.spatial import cells_of_box

#: Box of the city extract (west, south, east, north), centre and spread of the evaluation windows.
SLICE = (-74.011, 40.732, -73.957, 40.778)
CENTRE, JITTER, WINDOWS = (-73.984, 40.7549), 0.02, 100
TILE_M, PAD_M, INSET = 350, 100, 0.001
TRIES, FIRST = 500, 16
CELL = 0.005
METRES_LNG, METRES_LAT = 111320, 110540


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def box_around(lng: Column, lat: Column, metres: float) -> Box:
    half_lat = metres / 2 / METRES_LAT
    half_lng = metres / 2 / (METRES_LNG * F.cos(F.radians(lat)))
    return Box(lng - half_lng, lat - half_lat, lng + half_lng, lat + half_lat)


def evaluation_boxes(spark) -> DataFrame:
    """The WINDOWS padded boxes (x0, y0, x1, y1) that evaluation scenes may come from."""
    at = lambda k: (F.pmod(F.col("id") * k, F.lit(WINDOWS)) / WINDOWS - 0.5) * JITTER
    b = box_around(CENTRE[0] + at(73), CENTRE[1] + at(91), TILE_M + 2 * PAD_M)
    return spark.range(WINDOWS).select(b.x0.alias("x0"), b.y0.alias("y0"), b.x1.alias("x1"), b.y1.alias("y1"))


def _tries(seeds: DataFrame, first: int, last: int) -> DataFrame:
    """(seed, attempt, x0, y0, x1, y1) of tries first to last - 1; a try takes two numbers of its seed's sequence."""
    jumps = [(k, *rd.jump(2 * k + 1), *rd.jump(2 * k + 2)) for k in range(first, last)]
    table = F.broadcast(seeds.sparkSession.createDataFrame(jumps, "attempt int, m1 long, a1 long, m2 long, a2 long"))  # a row a try
    start = rd.first_state(rd.hash32(F.concat(F.lit("tile|"), F.col("seed").cast("string"))))
    each = seeds.select("seed", start.alias("s"), F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("attempt")).join(table, "attempt")
    x0, y0, x1, y1 = SLICE
    in_lng = TILE_M / 2 / (METRES_LNG * math.cos(math.radians((y0 + y1) / 2))) + INSET
    in_lat = TILE_M / 2 / METRES_LAT + INSET
    lng = x0 + in_lng + rd.leap(F.col("s"), F.col("m1"), F.col("a1")) / rd.WORD * (x1 - x0 - 2 * in_lng)
    lat = y0 + in_lat + rd.leap(F.col("s"), F.col("m2"), F.col("a2")) / rd.WORD * (y1 - y0 - 2 * in_lat)
    b = box_around(F.col("lng"), F.col("lat"), TILE_M)
    return each.select("seed", "attempt", lng.alias("lng"), lat.alias("lat")).select("seed", "attempt", b.x0.alias("x0"), b.y0.alias("y0"), b.x1.alias("x1"), b.y1.alias("y1"))


def _passed(tries: DataFrame, boxes: DataFrame) -> DataFrame:
    """The first try of each seed that overlaps no box; tries and boxes meet by cells."""
    taken = cells_of_box(boxes.withColumnsRenamed({"x0": "bx0", "y0": "by0", "x1": "bx1", "y1": "by1"}), "bx0", "by0", "bx1", "by1", CELL)
    met = cells_of_box(tries, "x0", "y0", "x1", "y1", CELL).join(taken, ["cx", "cy"]).filter("x0 < bx1 AND x1 > bx0 AND y0 < by1 AND y1 > by0")
    free = tries.join(met.select("seed", "attempt").distinct(), ["seed", "attempt"], "left_anti")
    return free.groupBy("seed").agg(F.min(F.struct("attempt", "x0", "y0", "x1", "y1")).alias("t")).select("seed", "t.*")


def tiles(seeds: DataFrame, boxes: DataFrame) -> DataFrame:
    """(seed, attempt, x0, y0, x1, y1): of up to TRIES seeded tiles the first that overlaps none of the boxes; touching is no overlap.

    Nearly every seed passes within FIRST tries; the others alone make the rest of theirs. A seed that never passes has a row of
    nulls; repeated seeds count once; a null seed has no tile and is left out.
    """
    seeds = seeds.select("seed").filter("seed IS NOT NULL").distinct()
    early = _passed(_tries(seeds, 0, FIRST), boxes)
    late = _passed(_tries(seeds.join(early, "seed", "left_anti"), FIRST, TRIES), boxes)
    return seeds.join(early.unionByName(late), "seed", "left")
