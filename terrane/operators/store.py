"""The network store: lookups and indexes by key, checks of zones and fibres, documents as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_by(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """One row per key with the values of the last row by order."""
    return df.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values])


def first_by(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.min_by(v, order).alias(v) for v in values])


def lookup(equipment: DataFrame, cables: DataFrame) -> DataFrame:
    """equipment (id, ...) with its incoming cable (the last one wins) and that cable's source; nulls where there is none."""
    incoming = cables.groupBy(F.col("target").alias("eid")).agg(F.max_by(F.struct(F.col("id").alias("cable"), "source"), "ord").alias("c"))
    return equipment.join(incoming, equipment["id"] == incoming["eid"], "left").select(*[equipment[c] for c in equipment.columns], F.col("c.cable").alias("cable"), F.col("c.source").alias("source"))


def two_keys(houses: DataFrame, address: Column) -> DataFrame:
    """An index with two keys a house, its address and its id; of houses with one key the last by ord stays."""
    keyed = houses.select(F.explode(F.array(address, F.col("id"))).alias("key"), "id", "ord")
    return keyed.groupBy("key").agg(F.max_by("id", "ord").alias("id"))


def cross_zone(cables: DataFrame, zones: DataFrame) -> DataFrame:
    """Cables whose ends lie in different zones, with both zones. zones: (id, zone) of all nodes."""
    a = zones.select(F.col("id").alias("source"), F.col("zone").alias("from_zone"))
    b = zones.select(F.col("id").alias("target"), F.col("zone").alias("to_zone"))
    return cables.join(a, "source").join(b, "target").filter("from_zone <> to_zone")


def issues(*checks: tuple[str, DataFrame, str]) -> DataFrame:
    """Rows (kind, id) of several checks, put one after the other."""
    out = None
    for kind, df, key in checks:
        own = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
        out = own if out is None else out.unionByName(own)
    return out


def duplicated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that come more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def glob(files: DataFrame, pattern: str) -> DataFrame:
    """Files (path, content) whose path fits a pattern with * (within a folder), ** (across) and ?."""
    form = pattern.replace(".", r"\.").replace("**", "\u0001").replace("*", "[^/]*").replace("?", "[^/]").replace("\u0001", ".*")
    return files.filter(F.col("path").rlike(f"^{form}$"))


def grep(files: DataFrame, pattern: str, most: int = 60) -> DataFrame:
    """(path, line, text) of lines that hold a pattern: the first `most` by path and line."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).filter(F.col("text").rlike(pattern))
    return lines.select("path", (F.col("at") + 1).alias("line"), "text").orderBy("path", "line").limit(most)


def edit(files: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """files with one snippet replaced; a snippet that is not there exactly once raises an error when the row is read."""
    times = F.size(F.split(F.col("content"), F.lit(r"\Q" + old + r"\E"), -1)) - 1
    done = F.when(times == 1, F.replace("content", F.lit(old), F.lit(new))).otherwise(F.raise_error(F.concat(F.lit("snippet found "), times.cast("string"), F.lit(" times"))))
    return files.withColumn("content", F.when(F.col("path") == path, done).otherwise(F.col("content")))


def section(content: Column, title: str) -> Column:
    """Bullets of a Markdown section '## title', in order."""
    body = F.regexp_extract(content, rf"(?s)(?:^|\n)## {title}[^\n]*\n(.*?)(?=\n## |\z)", 1)
    return F.transform(F.filter(F.split(body, "\n"), lambda x: x.startswith("- ")), lambda x: F.substring(x, 3, 1_000_000))
