"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's exact budget.

Documents of a source stand in the order of a hash of their id. Their order is dealt over cells (the first hex digits of the
hash), so that a source with a third of all documents is spread; the sums of the cells, added up within the source, are where
each cell begins, and a running sum within the cell places each document in its source's stream of words. A source whose
budget is above its size goes through its stream again, so the words taken from a document are whole rounds plus what the
last round's cut leaves of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.staging import Staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
CELL_DIGITS = 3  # 4096 cells a source
SPACE = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    """Runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(SPACE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Targets of sources (mx_none, mx_source, source_size): `share` of all words by weight, at most `most` times a source.

    Sources that would pass their limit get it, and what they leave goes to the others by weight, until none is above: with
    sources ordered by limit per weight, the first ones are at their limit and the rest share what is left. Needs the sources
    in one task: one row each.
    """
    rank = F.row_number().over(Window.orderBy("mx_none", "mx_source")) - 1
    weighed = sizes.withColumn("mx_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("mx_cap", F.col("source_size") * most)
    line = Window.orderBy(F.col("mx_cap") / F.col("mx_w"), "mx_none", "mx_source")
    whole = Window.partitionBy()
    ahead = weighed.withColumn("mx_all", share * F.sum("source_size").over(whole))
    ahead = ahead.withColumn("mx_rest", F.col("mx_all") - F.coalesce(F.sum("mx_cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ahead = ahead.withColumn("mx_ws", F.sum("mx_w").over(line.rowsBetween(0, Window.unboundedFollowing)))
    ahead = ahead.withColumn("mx_full", F.col("mx_cap") * F.col("mx_ws") < F.col("mx_rest") * F.col("mx_w"))
    rest = F.col("mx_all") - F.sum(F.when(F.col("mx_full"), F.col("mx_cap")).otherwise(0)).over(whole)
    ws = F.sum(F.when(F.col("mx_full"), 0).otherwise(F.col("mx_w"))).over(whole)
    shared = ahead.withColumn("mx_rest", rest).withColumn("mx_ws", ws)
    target = F.when(F.col("mx_full"), F.col("mx_cap").cast("double")).otherwise(F.col("mx_rest") * F.col("mx_w") / F.col("mx_ws"))
    return shared.select("mx_none", "mx_source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with source_size, target (both of the row's source) and taken (words of this row in the mix).

    `size` is a column with non-negative whole numbers, read twice. The sum of taken over a source is its target, rounded
    down. Rows without a source form a source of their own, the last; empty documents have taken 0, and so has a table of
    empty documents throughout; rows with equal keys are placed by size, and equal rows are interchangeable. Other columns
    pass through; source_size, target and taken are replaced, and names that begin with `mx_` are for internal use.
    """
    names = [c for c in docs.columns if c not in ("source_size", "target", "taken")]
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    keyed = docs.select(*names, F.col(source).isNull().alias("mx_none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("mx_source"), order.alias("mx_key"))
    keyed = keyed.withColumn("mx_cell", F.substring("mx_key", 1, CELL_DIGITS))
    cells = Staged(keyed.groupBy("mx_none", "mx_source", "mx_cell").agg(F.sum(size).alias("mx_sum")), "mix-cells").df
    sizes = cells.groupBy("mx_none", "mx_source").agg(F.sum("mx_sum").alias("source_size"))
    targets = Staged(source_targets(sizes, weights, share, most), "mix-targets").df
    ahead = Window.partitionBy("mx_none", "mx_source").orderBy("mx_cell").rowsBetween(Window.unboundedPreceding, -1)
    begins = cells.withColumn("mx_begin", F.coalesce(F.sum("mx_sum").over(ahead), F.lit(0))).drop("mx_sum")
    begins = begins.join(targets, ["mx_none", "mx_source"])
    own = Window.partitionBy("mx_none", "mx_source", "mx_cell").orderBy("mx_key", size).rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(begins, ["mx_none", "mx_source", "mx_cell"])
    placed = placed.withColumn("mx_at", F.col("mx_begin") + F.sum(size).over(own) - F.col(size))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.floor("target") - rounds * F.col("source_size")
    taken = rounds * F.col(size) + F.greatest(F.lit(0), F.least(F.col(size), left - F.col("mx_at")))
    return placed.select(*names, "source_size", "target", taken.cast("long").alias("taken"))


SQL = f"""
WITH d AS (SELECT doc_id, source IS NULL AS sn, coalesce(source, '') AS s,
                  CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) AS BIGINT) AS size,
                  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
z AS (SELECT sn, s, sum(size) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, {MOST} * source_size AS cap, [{', '.join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY sn, s) - 1) % {len(WEIGHTS)} + 1 AS INT)] AS w,
      {SHARE} * sum(source_size) OVER () AS total FROM z),
f AS (SELECT *, cap * sum(w) OVER (ORDER BY cap / w, sn, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      < (total - coalesce(sum(cap) OVER (ORDER BY cap / w, sn, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full FROM w),
t AS (SELECT sn, s, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
      ELSE CAST(total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS DOUBLE) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target FROM f),
p AS (SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target,
      CAST(sum(d.size) OVER (PARTITION BY d.sn, d.s ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS pos
      FROM d JOIN t ON d.sn = t.sn AND d.s = t.s),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM p)
SELECT doc_id, size, source_size, target,
       CAST(rounds * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - rounds * source_size - pos)) AS BIGINT) AS taken FROM r
"""
