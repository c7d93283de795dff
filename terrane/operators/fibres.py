"""Fibres and ports of the devices of a network: what each fibre of the incoming cable is for, who is at which port, the
hardware that holds them, and checks.

A device is a row (id, ratio, fibres) with the fibres of its incoming cable. A device has at most MOST fibres and as many ports as
its ratio says, so of the cables below it only the first that many can matter: they are taken by rank before anything is
summed or joined to ports, and a device with a large share of all cables sends no more rows on than its ports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import text as tx

#: Fibres up to which an enclosure is taken, and its name; fibres of a tray.
ENCLOSURES = ((12, "wall-12f"), (24, "inline-24f"), (48, "dome-48f"), (96, "dome-96f"))
LARGEST, TRAY, MOST = "rack-144f", 12, 144


def allocation(devices: DataFrame, below: DataFrame) -> DataFrame:
    """(id, fibre, usage, destination, colour): fibre 1 feeds the splitter, the next ones pass through to the devices below
    (id, target, ord, fibres) in order, one for each twelve fibres there, the rest is reserve. What does not fit gets none."""
    w = Window.partitionBy("id").orderBy("ord", "target")
    first = below.withColumn("r", F.row_number().over(w)).filter(F.col("r") < MOST).withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("fibres") / TRAY)))
    run = first.withColumn("last", 1 + F.sum("need").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    through = run.join(devices.select("id", F.col("fibres").alias("own")), "id").filter(F.col("last") - F.col("need") < F.col("own"))
    through = through.select("id", "target", "own", F.explode(F.sequence(F.col("last") - F.col("need") + 1, F.least("last", "own"))).alias("fibre"))
    used = through.groupBy("id").agg(F.max("fibre").alias("used"))
    split = devices.filter("fibres > 0").select("id", F.lit(1).cast("long").alias("fibre"), F.lit("splitter_input").alias("usage"), F.concat(F.lit("splitter-"), "ratio").alias("destination"))
    spare = devices.join(used, "id", "left").withColumn("used", F.coalesce("used", F.lit(1))).filter("used < fibres")
    spare = spare.select("id", F.explode(F.sequence(F.col("used") + 1, F.col("fibres").cast("long"))).alias("fibre"), F.lit("reserve").alias("usage"), F.lit(None).cast("string").alias("destination"))
    passing = through.select("id", F.col("fibre").cast("long"), F.lit("pass_through").alias("usage"), F.col("target").alias("destination"))
    return split.unionByName(passing).unionByName(spare).withColumn("colour", tx.fibre_colour(F.col("fibre")))


def ports(devices: DataFrame, drops: DataFrame) -> DataFrame:
    """(id, port, address, cable, status, colour): the houses of drops (id, target, cable, ord) in order at the ports of the splitter,
    however many it has; houses beyond the last port have none."""
    ways = devices.select("id", tx.splitter_ways(F.col("ratio")).alias("ways"))
    ranked = drops.join(ways, "id").withColumn("port", F.row_number().over(Window.partitionBy("id").orderBy("ord", "cable"))).filter("port <= ways")
    every = ways.select("id", F.explode(F.sequence(F.lit(1), "ways")).alias("port"))
    held = every.join(ranked.select("id", "port", F.col("target").alias("address"), "cable"), ["id", "port"], "left")
    return held.withColumns({"status": F.when(F.col("address").isNull(), "available").otherwise("allocated"), "colour": tx.fibre_colour(F.col("port"))})


def changed(state: DataFrame, requests: DataFrame) -> DataFrame:
    """Ports after requests (id, port, address, cable): a request with an address takes a free port, one without frees a port;
    taking a port that is held, and ports that are not there, change nothing. One request a port."""
    r = requests.select("id", "port", F.col("address").alias("_a"), F.col("cable").alias("_c"), F.lit(True).alias("_asked"))
    asked = F.coalesce("_asked", F.lit(False))
    frees, takes = asked & F.col("_a").isNull(), asked & F.col("_a").isNotNull() & (F.col("status") == "available")
    put = lambda new, old: F.when(takes, F.col(new)).when(~frees, F.col(old))
    status = F.when(takes, "allocated").when(frees, "available").otherwise(F.col("status"))
    return state.join(r, ["id", "port"], "left").select("id", "port", put("_a", "address").alias("address"), put("_c", "cable").alias("cable"), status.alias("status"), "colour")


def enclosure(fibres):
    out = F.lit(LARGEST)
    for most, name in ENCLOSURES[::-1]:
        out = F.when(fibres <= most, name).otherwise(out)
    return out


def trays(devices: DataFrame) -> DataFrame:
    """(id, enclosure, tray, fibres): trays of twelve with the range of fibres that each holds."""
    n = F.ceil(F.col("fibres") / TRAY).cast("int")
    each = devices.filter("fibres > 0").select("id", "fibres", F.explode(F.sequence(F.lit(1), n)).alias("tray"))
    low, high = (F.col("tray") - 1) * TRAY + 1, F.least(F.col("tray") * TRAY, F.col("fibres"))
    return each.select("id", enclosure(F.col("fibres")).alias("enclosure"), "tray", F.concat_ws("-", low.cast("string"), high.cast("string")).alias("fibres"))


def problems(devices: DataFrame, fibres: DataFrame, state: DataFrame) -> DataFrame:
    """(id, problem) of fibre and port tables: numbers given twice, counts that differ from the cable's or the splitter's, ports
    taken without an address, more ports taken than there are, no fibre to the splitter. Devices without rows are judged too."""
    f = fibres.groupBy("id").agg(F.count("*").alias("fn"), F.count_distinct("fibre").alias("fd"), F.count_if(F.col("usage") == "splitter_input").alias("fs"))
    p = state.groupBy("id").agg(
        F.count("*").alias("pn"), F.count_distinct("port").alias("pd"), F.count_if(F.col("status") == "allocated").alias("pa"),
        F.count_if((F.col("status") == "allocated") & F.col("address").isNull()).alias("po"),
    )
    d = devices.select("id", F.col("fibres").alias("own"), tx.splitter_ways(F.col("ratio")).alias("ways")).join(f, "id", "left").join(p, "id", "left").na.fill(0)
    tests = [
        ("duplicate fibre", F.col("fd") < F.col("fn")), ("duplicate port", F.col("pd") < F.col("pn")), ("fibre count", F.col("fn") != F.col("own")),
        ("port count", F.col("pn") != F.col("ways")), ("port without address", F.col("po") > 0), ("over capacity", F.col("pa") > F.col("ways")), ("no splitter input", F.col("fs") == 0),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
    return d.select("id", F.explode(found).alias("problem"))
