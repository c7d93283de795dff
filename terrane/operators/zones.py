"""Zones of scenes: their figures, issues and indexes, built whole or brought up to date from a set of changes.

Nodes are (scene_id, id, kind, x, y), cables (scene_id, cable_id, kind, source, target); a zone is a tile of TILE degrees, and a cable
belongs to the zone of its source. Changes are rows of the same columns with op ('put' or 'drop') and seq; of several changes of
one key the last by seq counts, a drop of an unknown key does nothing, and a cable that has lost an end goes with it.

What an update reads more than once is written once. It reads the changed rows, the cables at them and the zones (or index keys) these touch. All other rows of a built
table are kept as they are, so an update equals a rebuild and costs what has changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.functions import network as nw
from terrane.functions import text as tx
from terrane.functions.geo import P
from terrane.operators.graph import settled

TILE = 0.002
HIGH_DB = 25.0
WAYS = 8  # of the splitter before a drop
ZONE = ["scene_id", "zc", "zr"]
NODE = ["scene_id", "id"]
CABLE = ["scene_id", "cable_id"]


def zone_name(c: str = "zc", r: str = "zr") -> Column:
    return F.concat(F.lit("Z"), F.col(c).cast("string"), F.lit("_"), F.col(r).cast("string"))


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("c")).select(*keys, "c.*")


def merged(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """rows after the changes: keys that are put replace or join, keys that are dropped go."""
    last = latest(changes, keys)
    return rows.join(last.select(*keys), keys, "left_anti").unionByName(last.filter("op = 'put'").select(*rows.columns))


def placed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"zc": geo.cell(F.col("x"), TILE), "zr": geo.cell(F.col("y"), TILE)})


def spans(cables: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Cables between placed nodes: zone of the source (zc, zr), of the target (tc, tr), metres and the loss from the source on
    (of drops, with the splitter of eight and the fixed losses of one hop)."""
    a = sources.select("scene_id", F.col("id").alias("source"), "zc", "zr", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = targets.select("scene_id", F.col("id").alias("target"), F.col("zc").alias("tc"), F.col("zr").alias("tr"), F.col("x").alias("bx"), F.col("y").alias("by"))
    both = cables.join(a, ["scene_id", "source"]).join(b, ["scene_id", "target"])
    metres = geo.haversine(P(F.col("ax"), F.col("ay")), P(F.col("bx"), F.col("by")))
    both = both.withColumn("metres", metres).drop("ax", "ay", "bx", "by")
    splitter = nw.splitter_db(F.lit(WAYS), "index")
    return both.withColumn("db", F.when(F.col("kind") == "drop", nw.path_db(F.col("metres"), F.lit(1), F.lit(1), splitter, "index")))


def summaries(nodes: DataFrame, cables: DataFrame) -> DataFrame:
    """Figures of zones that have a node, from placed nodes and the spans of their cables."""
    kinds = nodes.groupBy(*ZONE).agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "house").alias("houses"), F.count_if(F.col("kind") != "house").alias("devices"))
    long = nw.cable_status(F.lit(False), F.lit(False), F.col("kind"), F.col("metres")) == "TOO_LONG"
    away = (F.col("zc") != F.col("tc")) | (F.col("zr") != F.col("tr"))
    own = cables.groupBy(*ZONE).agg(F.count("*").alias("cables"), F.round(F.sum("metres"), 3).alias("metres"), F.count_if(away).alias("links"), F.count_if(long).alias("errors"), F.max("db").alias("max_db"))
    return kinds.join(own, ZONE, "left").fillna(0, ["cables", "metres", "links", "errors", "max_db"])


def links(cables: DataFrame) -> DataFrame:
    """Pairs of zones of a scene that a cable joins, each once, the lesser first."""
    one, two = F.struct("zc", "zr"), F.struct(F.col("tc").alias("zc"), F.col("tr").alias("zr"))
    pair = cables.select("scene_id", F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).filter("a <> b")
    return pair.select("scene_id", "a.zc", "a.zr", F.col("b.zc").alias("tc"), F.col("b.zr").alias("tr")).distinct()


def area(zones: DataFrame) -> DataFrame:
    """Figures of a scene from those of its zones; coverage: the share of its box's zones that have a node."""
    box = (F.max("zc") - F.min("zc") + 1) * (F.max("zr") - F.min("zr") + 1)
    sums = [F.sum(c).alias(c) for c in ("nodes", "cables", "houses")]
    return zones.groupBy("scene_id").agg(box.alias("zones"), *sums, F.round(F.sum("metres"), 2).alias("metres"), F.max("max_db").alias("max_db"), F.round(100 * F.count("*") / box, 6).alias("coverage"))


def area_issues(zones: DataFrame, linked: DataFrame) -> DataFrame:
    """Issues of a scene: neighbouring zones without a cable between them (from either side), zones with errors, zones of high loss.

    A zone looks at its four neighbours by equal keys, so the work is linear in zones.
    """
    side = F.explode(F.array(*[F.struct(F.lit(n).alias("direction"), F.lit(c).alias("dc"), F.lit(r).alias("dr")) for n, c, r in (("north", 0, 1), ("south", 0, -1), ("east", 1, 0), ("west", -1, 0))])).alias("s")
    near = zones.select(*ZONE, side).select(*ZONE, "s.direction", (F.col("zc") + F.col("s.dc")).alias("tc"), (F.col("zr") + F.col("s.dr")).alias("tr"))
    near = near.join(zones.select("scene_id", F.col("zc").alias("tc"), F.col("zr").alias("tr")), ["scene_id", "tc", "tr"], "left_semi")
    either = linked.select("scene_id", "zc", "zr", "tc", "tr").union(linked.select("scene_id", "tc", "tr", "zc", "zr"))
    gaps = near.join(either, [*ZONE, "tc", "tr"], "left_anti").withColumns({"one": zone_name(), "two": zone_name("tc", "tr")})
    pair = F.concat_ws("-", F.least("one", "two"), F.greatest("one", "two"))
    row = lambda df, ident, severity, kind, text: df.select("scene_id", ident.alias("issue_id"), F.lit(severity).alias("severity"), F.lit(kind).alias("type"), text.alias("description"))
    text = F.concat(F.lit("No fiber connection between zones "), "one", F.lit(" and "), "two", F.lit(" ("), "direction", F.lit(")"))
    out = row(gaps, F.concat(F.lit("missing-link-"), pair), "warning", "missing_cross_zone_link", text)
    bad = zones.filter("errors > 0").withColumn("one", zone_name())
    count = lambda c, word: F.concat(c.cast("string"), F.lit(f" {word}"), F.when(c != 1, "s").otherwise(""))
    out = out.unionByName(row(bad, F.concat(F.lit("zone-errors-"), "one"), "error", "zone_has_errors", F.concat(F.lit("Zone "), "one", F.lit(" has "), count(F.col("errors"), "validation error"))))
    high = zones.filter(F.col("max_db") > HIGH_DB).groupBy("scene_id").agg(F.count("*").alias("n"))
    text = F.concat(count(F.col("n"), "zone"), F.lit(f" with optical loss > {HIGH_DB:g}dB (approaching 28dB limit)"))
    return out.unionByName(row(high, F.lit("high-optical-loss-zones"), "warning", "high_optical_loss", text))


@dataclass(frozen=True)
class Change:
    """Nodes and cables before, and what becomes of them."""

    nodes: DataFrame
    cables: DataFrame
    node_changes: DataFrame
    cable_changes: DataFrame

    @property
    def nodes_after(self) -> DataFrame:
        return merged(self.nodes, self.node_changes, NODE)

    @property
    def cables_after(self) -> DataFrame:
        """Cables after the changes; those without one of their ends are left out wherever ends are joined on."""
        return merged(self.cables, self.cable_changes, CABLE)

    def changed_nodes(self) -> DataFrame:
        """(scene_id, id) of nodes that change and of both ends of cables that change, before or after."""
        ends = F.explode(F.array("source", "target")).alias("id")
        keys = self.cable_changes.select(*CABLE).distinct()
        was = self.cables.join(keys, CABLE, "left_semi").select("scene_id", ends)
        will = self.cable_changes.filter("op = 'put'").select("scene_id", ends)
        return self.node_changes.select(*NODE).union(was).union(will).distinct()

    def near_nodes(self) -> DataFrame:
        """changed_nodes and the nodes at the other end of their cables."""
        hit = self.changed_nodes()
        both = self.cables.select("scene_id", "source", "target")
        out = both.join(hit.withColumnRenamed("id", "source"), ["scene_id", "source"]).select("scene_id", F.col("target").alias("id"))
        back = both.join(hit.withColumnRenamed("id", "target"), ["scene_id", "target"]).select("scene_id", F.col("source").alias("id"))
        return hit.union(out).union(back).distinct()

    def touched_zones(self) -> DataFrame:
        """Zones whose figures may change: those of near_nodes, before and after."""
        near = self.near_nodes()
        at = lambda nodes: placed(nodes.join(near, NODE, "left_semi")).select(*ZONE)
        return at(self.nodes).union(at(self.nodes_after)).distinct()


def refreshed(built: DataFrame, touched: DataFrame, keys: list[str], again: DataFrame) -> DataFrame:
    """A built table with the rows of touched keys replaced by those built again."""
    return built.join(touched, keys, "left_anti").unionByName(again)


def update_zones(built: DataFrame, change: Change) -> DataFrame:
    """summaries() after a change, from those before it; only touched zones are computed."""
    touched, after = settled(change.touched_zones()), placed(change.nodes_after)
    own = after.join(touched, ZONE, "left_semi")
    return refreshed(built, touched, ZONE, summaries(own, spans(change.cables_after, own, after)))


def entries(nodes: DataFrame, cables: DataFrame, streets: DataFrame) -> DataFrame:
    """One row a node, from placed nodes, spans and (scene_id, id, street): its element type, zone, street, closure and loss.

    A house's closure is the source of its drop, of several the first by cable id. Its address is its street and number.
    """
    drops = cables.filter("kind = 'drop'").groupBy("scene_id", F.col("target").alias("id")).agg(F.min_by(F.struct("source", "db"), "cable_id").alias("d"))
    known = nodes.join(drops, NODE, "left").join(streets, NODE, "left")
    address = F.when(F.col("kind") == "house", tx.address_key(F.concat_ws(" ", F.coalesce("street", F.lit("unnamed")), (F.col("id") % 100).cast("string"))))
    return known.select(*NODE, tx.element_type(F.col("kind")).alias("type"), zone_name().alias("zone"), "street", address.alias("address"), F.col("d.source").alias("closure"), F.col("d.db").alias("db"))


def lookup_rows(rows: DataFrame) -> DataFrame:
    """The three indexes as rows (scene_id, index, key, id, zone, closure, db, houses, closures, offices), from entries.

    by_address has two keys a house, its address and its id (of houses with one key the last by id stays); by_element has a key a
    node; by_street counts what stands on a street.
    """
    text = F.col("id").cast("string")
    none = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    counts = ("houses", "closures", "offices")
    last = rows.filter("type = 'house'").select("scene_id", F.explode(F.array("address", text)).alias("key"), "id", F.struct("id", "zone", "closure", "db").alias("e"))
    last = last.groupBy("scene_id", "key").agg(F.max_by("e", "id").alias("e")).select("scene_id", F.lit("by_address").alias("index"), "key", "e.*", *none(*counts))
    element = rows.select("scene_id", F.lit("by_element").alias("index"), text.alias("key"), "id", "zone", F.lit(None).cast("long").alias("closure"), F.lit(None).cast("double").alias("db"), *none(*counts))
    of = lambda kind, name: F.count_if(F.col("type") == kind).alias(name)
    street = rows.filter("street IS NOT NULL").groupBy("scene_id", F.lower("street").alias("key")).agg(of("house", "houses"), of("closure", "closures"), of("co", "offices"))
    street = street.select("scene_id", F.lit("by_street").alias("index"), "key", *none("id"), F.lit(None).cast("string").alias("zone"), *none("closure"), F.lit(None).cast("double").alias("db"), *counts)
    return last.unionByName(element).unionByName(street)


KEY = ["scene_id", "index", "key"]


def index_keys(rows: DataFrame) -> DataFrame:
    """The index keys that entries stand under."""
    text = F.col("id").cast("string")
    key = lambda index, c: F.struct(F.lit(index).alias("index"), c.alias("key"))
    each = F.explode(F.array(key("by_element", text), key("by_address", text), key("by_address", F.col("address")), key("by_street", F.lower("street")))).alias("k")
    return rows.select("scene_id", each).select("scene_id", "k.*").filter("key IS NOT NULL").distinct()


def update_index(before: DataFrame, built: DataFrame, change: Change, streets_of) -> tuple[DataFrame, DataFrame]:
    """(entries, lookup_rows) after a change, from those before it: before is entries, built their lookup_rows. streets_of gives
    (scene_id, id, street) of placed nodes and is asked for near nodes alone; keys are built again from entries that share them."""
    near, after = settled(change.near_nodes()), settled(placed(change.nodes_after))
    own = after.join(near, NODE, "left_semi")
    drops = change.cables_after.join(near.withColumnRenamed("id", "target"), ["scene_id", "target"], "left_semi")
    fresh = settled(entries(own, spans(drops, after, own), streets_of(own)))
    rows = settled(refreshed(before, near, NODE, fresh))
    keys = settled(index_keys(before.join(near, NODE, "left_semi").unionByName(fresh)))
    again = lookup_rows(settled(sharing(rows, keys))).join(keys, KEY, "left_semi")
    return rows, refreshed(built, keys, KEY, again)


def sharing(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries that stand under one of the keys."""
    at = lambda index, c: rows.select(*NODE, c.alias("key")).join(keys.filter(F.col("index") == index).select("scene_id", "key"), ["scene_id", "key"], "left_semi").select(*NODE)
    text = F.col("id").cast("string")
    found = at("by_element", text).union(at("by_address", F.col("address"))).union(at("by_street", F.lower("street"))).distinct()
    return rows.join(found, NODE, "left_semi")


def rewrite(rows: DataFrame, path: str, by: list[str]) -> None:
    """Writes rows to a folder parted by columns: parts that rows name are replaced, all others stay as they are."""
    rows.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
