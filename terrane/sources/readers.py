"""Readers and writers with explicit schemas: city extracts, GeoJSON zones, item tables, JSON lines, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import text as tx

BUILDING = "struct<id:string,center:array<double>,polygon:array<array<double>>,type:string,levels:int,units:int,address:struct<street:string,number:string>>"
SEGMENT = "struct<id:string,name:string,type:string,coordinates:array<array<double>>,oneway:boolean,lanes:int,surface:string>"
BOX = "struct<south:double,west:double,north:double,east:double>"
BUILDINGS = f"city string, displayName string, updated string, bbox {BOX}, count int, buildings array<{BUILDING}>"
STREETS = f"city string, displayName string, updated string, bbox {BOX}, segments array<{SEGMENT}>"
ITEMS = (
    "sceneId string, model string, arm string, questionId string, category string, repeat int, correct boolean, inputTokens long, outputTokens long, latencyMs long, "
    "hallucinated boolean, hallucinatedIds string, missingInfo string, error string, scaleM int"
)
FEATURES = "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
SMALL_ROADS = ("service", "unclassified")


def _points(coordinates):
    return F.transform(coordinates, lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")))


def city_buildings(spark: SparkSession, path: str) -> DataFrame:
    """One row per building of city extracts, in their order; rings of fewer than three points are left out."""
    d = spark.read.schema(BUILDINGS).json(path, multiLine=True).select("city", F.posexplode("buildings").alias("ord", "b"))
    out = d.select("city", "ord", "b.id", "b.type", "b.levels", "b.units", F.col("b.address.street").alias("street"), F.col("b.address.number").alias("number"), _points(F.col("b.polygon")).alias("footprint"))
    return out.filter(F.size("footprint") >= 3)


def city_streets(spark: SparkSession, path: str, small: bool = False) -> DataFrame:
    """One row per street segment; service and unclassified ways only on request."""
    d = spark.read.schema(STREETS).json(path, multiLine=True).select("city", F.posexplode("segments").alias("ord", "s"))
    out = d.select("city", "ord", "s.id", "s.name", "s.type", "s.oneway", _points(F.col("s.coordinates")).alias("line")).filter(F.size("line") >= 2)
    return out if small else out.filter(~F.col("type").isin(*SMALL_ROADS))


def graded_items(spark: SparkSession, path: str) -> DataFrame:
    """Item tables from CSV with quoted fields over several lines; records torn by a bare line break are dropped, cited ids split."""
    d = spark.read.schema(ITEMS).csv(path, header=True, multiLine=True, quote='"', escape='"').filter("inputTokens IS NOT NULL")
    return d.withColumn("hallucinatedIds", F.filter(F.split(F.coalesce("hallucinatedIds", F.lit("")), r"\|"), lambda x: x != ""))


def write_graded_items(items: DataFrame, path: str) -> None:
    """The same table, every text field quoted, so that no record is torn."""
    flat = items.withColumn("hallucinatedIds", F.array_join("hallucinatedIds", "|"))
    flat.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)


def zone_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, cables) of zone GeoJSON: points and lines, with their properties as a map."""
    d = spark.read.schema(FEATURES).json(path, multiLine=True).select(F.explode("features").alias("f"))
    props = d.select("f.geometry.type", "f.geometry.coordinates", "f.properties")
    nodes = props.filter("type = 'Point'").select(F.from_json("coordinates", "array<double>").alias("c"), "properties")
    cables = props.filter("type = 'LineString'").select(_points(F.from_json("coordinates", "array<array<double>>")).alias("path"), "properties")
    return nodes.select(F.col("properties")["id"].alias("id"), F.struct(F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(1)).alias("y")).alias("position"), "properties"), cables.select(
        F.col("properties")["id"].alias("id"), "path", "properties"
    )


def wkt_table(spark: SparkSession, path: str, column: str = "geometry") -> DataFrame:
    """CSV rows with the points of their well-known text."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').withColumn("points", tx.wkt_points(F.col(column)))


def write_run_log(path: str, **tables: DataFrame) -> None:
    """Tables as one log of JSON lines, each with its kind."""
    lines = None
    for kind, df in tables.items():
        own = df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("value"))
        lines = own if lines is None else lines.unionByName(own)
    if lines is not None:
        lines.write.text(path)


def feature_collection(nodes: DataFrame, zone: str, cables: DataFrame | None = None) -> DataFrame:
    """(zone, geojson): the nodes (id, x, y) of each zone, and its cables (id, x, y, bx, by), as one document; zones are small by
    definition. zone_features() reads it back."""

    def features(df: DataFrame, place: int, kind: str, at) -> DataFrame:
        shape = F.concat(F.lit(f'{{"type":"Feature","geometry":{{"type":"{kind}","coordinates":'), F.to_json(at), F.lit('},"properties":'), F.to_json(F.struct(F.col("id").cast("string").alias("id"))), F.lit("}"))
        return df.select(zone, F.lit(place).alias("place"), F.col("id").cast("string").alias("k"), shape.alias("f"))

    every = features(nodes, 0, "Point", F.array("x", "y"))
    if cables is not None:
        every = every.unionByName(features(cables, 1, "LineString", F.array(F.array("x", "y"), F.array("bx", "by"))))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "k", "f"))), lambda s: s["f"])
    return every.groupBy(zone).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}")).alias("geojson"))


TOOL_ROW = "messages array<struct<role:string,content:string>>, family string, scene string"
GRAPH = "nodes array<struct<id:string,lng:double,lat:double,type:string,streets:array<string>>>, edges array<struct<id:string,source:string,target:string,distance:double,kind:string>>"


def tool_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row per message of JSON lines with conversations: row id, family, scene, turn, role, content. Broken lines are left out."""
    d = spark.read.text(path).select(F.from_json("value", TOOL_ROW).alias("r"), F.xxhash64("value").alias("row")).filter("r.messages IS NOT NULL")
    return d.select("row", "r.family", "r.scene", F.posexplode("r.messages").alias("turn", "m")).select("row", "family", "scene", "turn", "m.role", "m.content")


def routing_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of routing graphs in JSON; edges whose ends are not among the nodes are left out."""
    d = spark.read.schema(GRAPH).json(path, multiLine=True)
    nodes, edges = d.select(F.explode("nodes").alias("n")).select("n.*"), d.select(F.explode("edges").alias("e")).select("e.*")
    known = nodes.select("id").distinct()
    ends = edges.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, ends.select("id", "source", "target", "distance", "kind")


def write_routing_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines in two folders, which any number of tasks can write."""
    nodes.write.json(f"{path}/nodes")
    edges.write.json(f"{path}/edges")


def write_split(rows: DataFrame, path: str, split: str = "split") -> None:
    """Rows as JSON lines in a folder for each split (train, val)."""
    rows.write.partitionBy(split).json(path)


def write_report(lines: DataFrame, path: str, title: str, order: str = "arm", line: str = "line") -> None:
    """report.md: a title and the table of a run's arms, which are few."""
    head = lines.sparkSession.createDataFrame([(0, "", f"# {title}"), (1, "", "| arm | n | correct | share |"), (2, "", "|-|-|-|-|")], "place int, k string, value string")
    body = lines.select(F.lit(3).alias("place"), F.col(order).cast("string").alias("k"), F.col(line).alias("value"))
    head.unionByName(body).repartition(1).sortWithinPartitions("place", "k").select("value").write.text(path)


def memory_entries(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, at, entry): the bullets of Markdown files below their '## ' headings, with dates where an entry begins with one."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"(?m)^## ")).alias("s", "body")).filter("s > 0")
    d = d.select("path", F.trim(F.substring_index("body", "\n", 1)).alias("section"), F.posexplode(F.split("body", "\n")).alias("at", "raw")).filter(F.col("raw").startswith("- "))
    entry = F.substring(F.col("raw"), 3, 1_000_000)
    return d.select("path", "section", "at", entry.alias("entry"), F.nullif(F.regexp_extract(entry, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")).try_cast("date").alias("day"))
