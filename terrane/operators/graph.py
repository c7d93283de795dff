"""Graph operators on edge tables: degrees, components, upstream traces, shortest paths.

Loops run on tables; each round is written to the checkpoint folder, so plans stay short and lost executors cost one round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df, written to the folder of spark.checkpoint.dir and read again: one pass, no lineage, and a known size, so that small tables
    are joined without a shuffle. Only a local session without that setting gets a folder of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="terrane-"))
    path = f"{sc.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (source, target, ...) in both directions."""
    swap = {"source": "target", "target": "source"}
    return edges.union(edges.select(*[F.col(swap.get(c, c)) for c in edges.columns]))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable. Least labels spread along edges and jump to the label of their label."""
    links = settled(both_ways(edges.select("source", "target")).distinct())
    labels = settled(links.groupBy(F.col("source").alias("id")).agg(F.min("target").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = links.join(labels, links.target == labels.id).groupBy(F.col("source").alias("id")).agg(F.min("component").alias("m"))
        spread = labels.join(near, "id").select("id", F.least("component", "m").alias("component"))
        jump = spread.select(F.col("id").alias("component"), F.col("component").alias("next"))
        after = spread.join(jump, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
        after = settled(after)
        changed = after.withColumnRenamed("component", "now").join(labels, "id").filter("now <> component").isEmpty()
        labels = after
        if changed:
            return labels


def trace_up(starts: DataFrame, cables: DataFrame, hops: int | None = 20) -> DataFrame:
    """(id, path): from each id along target -> source to the top, at most `hops` cables (None: all, for cables
    without a cycle), stopping before a node comes twice.
    Of several cables into a node the last by `ord` counts. Ways double in length each round, so there are about as
    many rounds as the longest way has binary digits; on a cycle a way repeats itself and is cut to its first turn."""
    up = cables.groupBy(F.col("target").alias("at")).agg(F.max_by("source", "ord").alias("last"))
    way = up.select("at", F.array("last").alias("way"), "last")
    for _ in range(64 if hops is None else max(1, hops).bit_length()):
        more = way.select(F.col("at").alias("last"), F.col("way").alias("rest"), F.col("last").alias("end"))
        longer = way.join(more, "last", "left").select("at", F.concat("way", F.coalesce("rest", F.array().cast("array<string>"))).alias("way"), F.coalesce("end", "last").alias("last"), F.col("end").isNotNull().alias("grew"))
        way = settled(longer)
        if way.filter("grew").isEmpty():
            break
        way = way.drop("grew")
    walked = starts.select("id").join(way.select(F.col("at").alias("id"), "way"), "id", "left")
    path = F.array_distinct(F.concat(F.array("id"), F.coalesce("way", F.array().cast("array<string>"))))
    return walked.select("id", (path if hops is None else F.slice(path, 1, hops + 1)).alias("path"))


def shortest(edges: DataFrame, starts: DataFrame, rounds: int | None = None) -> DataFrame:
    """(start, id, cost, previous): least cost from each start over directed edges (source, target, cost >= 0), ties to the
    smaller previous node. Only nodes improved in the last round are relaxed again, until none is; a bound of rounds that is hit
    before is an error."""
    best = settled(starts.select("start", F.col("start").alias("id"), F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("previous")))
    front = best
    done = 0
    while True:
        reached = front.select("start", F.col("id").alias("source"), F.col("cost").alias("base")).join(edges, "source")
        offers = reached.select("start", F.col("target").alias("id"), (F.col("base") + F.col("cost")).alias("cost"), F.col("source").alias("previous"))
        offers = offers.groupBy("start", "id").agg(F.min(F.struct("cost", "previous")).alias("o")).select("start", "id", "o.*")
        known = best.select("start", "id", F.col("cost").alias("known"))
        front = settled(offers.join(known, ["start", "id"], "left").filter("known IS NULL OR cost < known").drop("known"))
        if front.isEmpty():
            return best
        if done == rounds:
            raise RuntimeError(f"shortest paths are not final after {rounds} rounds")
        done += 1
        best = settled(best.unionByName(front).groupBy("start", "id").agg(F.min(F.struct("cost", "previous")).alias("o")).select("start", "id", "o.*"))


def ways_to(links: DataFrame, goals: DataFrame) -> DataFrame:
    """(id, path): from every node that a goal (id) reaches over links (source, target), walked in either direction, the way with the
    fewest links to the nearest goal, the node first and the goal last; of equal ways that of the smaller next node.

    All goals start at once, and a node is reached in one round only, so a cycle or a second goal costs nothing. There are as
    many rounds as the longest way has links.
    """
    both = settled(both_ways(links.select("source", "target")).distinct())
    front = settled(goals.select("id", F.array("id").alias("path")).distinct())
    reached = front
    while True:
        step = front.withColumnRenamed("id", "source").join(both, "source").groupBy(F.col("target").alias("id")).agg(F.min_by("path", "source").alias("rest"))
        front = settled(step.join(reached.select("id"), "id", "left_anti").select("id", F.concat(F.array("id"), "rest").alias("path")))
        if front.isEmpty():
            return reached
        reached = settled(reached.unionByName(front))


def tree_lines(nodes: DataFrame, cables: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, place, line): the tree below each root (id, label) as indented lines, of any depth. nodes: (id, label); cables: (source,
    target, ord), whose order is that of the branches. place holds the branch numbers from the root, so it sorts the lines.
    Branches to unknown nodes are left out, and so is one that leads back to a node above it."""
    w = Window.partitionBy("source")
    known = cables.join(nodes.withColumnsRenamed({"id": "target", "label": "text"}), "target").select("source", "target", "ord", "text")
    number = F.row_number().over(w.orderBy("ord", "target")).cast("long")
    branches = settled(known.withColumns({"k": number, "last": number == F.count("*").over(w)}).drop("ord"))
    empty = F.lit("")
    front = settled(roots.select(F.col("id").alias("root"), "id", F.array().cast("array<bigint>").alias("place"), F.col("label").alias("line"), empty.alias("prefix"), F.array("id").alias("above")))
    out = front.drop("prefix", "above")
    while True:
        step = front.drop("line").withColumnRenamed("id", "source").join(branches, "source").filter(~F.array_contains("above", F.col("target")))
        line = F.concat("prefix", F.when(F.col("last"), "└── ").otherwise("├── "), "text")
        step = step.select("root", F.col("target").alias("id"), F.array_append("place", F.col("k")).alias("place"), line.alias("line"), F.concat("prefix", F.when(F.col("last"), "    ").otherwise("│   ")).alias("prefix"), F.array_append("above", F.col("target")).alias("above"))
        front = settled(step)
        if front.isEmpty():
            return out
        out = out.unionByName(front.drop("prefix", "above"))


def closest_between(nodes: DataFrame, membership: DataFrame, metres: float = 100.0) -> DataFrame:
    """The nearest pair of nodes of every two components no farther apart than metres: (ca, cb, a, b, d)."""
    from terrane.operators.spatial import within_metres

    pairs = within_metres(nodes, nodes, metres).filter("id <> other")
    a = membership.select(F.col("id"), F.col("component").alias("ca"))
    b = membership.select(F.col("id").alias("other"), F.col("component").alias("cb"))
    across = pairs.join(a, "id").join(b, "other").filter("ca < cb")
    best = across.groupBy("ca", "cb").agg(F.min(F.struct("d", F.col("id").alias("a"), F.col("other").alias("b"))).alias("s"))
    return best.select("ca", "cb", "s.a", "s.b", "s.d")
