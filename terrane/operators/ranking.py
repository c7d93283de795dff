"""Row numbers over a whole table without putting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 100_000


def global_row_number(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with its row number (from 1) by a whole-number column: rows are numbered within ranges of the column, whose counts,
    added up, give where each range begins. Ranges adapt to the column's span, so that a range holds about CELL_ROWS rows."""
    low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).head()
    width = max(1, -(-(int(high or 0) - int(low or 0) + 1) * CELL_ROWS // max(1, n)))
    celled = df.withColumn("rk_cell", F.floor((F.col(order) - F.lit(low or 0)) / width).cast("long"))
    ahead = Window.orderBy("rk_cell").rowsBetween(Window.unboundedPreceding, -1)
    begins = celled.groupBy("rk_cell").agg(F.count("*").alias("rk_n")).withColumn("rk_before", F.coalesce(F.sum("rk_n").over(ahead), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("rk_cell").orderBy(order))
    return celled.join(begins.drop("rk_n"), "rk_cell").withColumn(name, F.col("rk_before") + own).drop("rk_cell", "rk_before")
