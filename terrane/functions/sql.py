"""The scalar functions as temporary SQL functions, and the supplied tables and derived scenes as views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from terrane.sources import scenes

#: name: (arguments, result, body). SQL functions are inlined by the optimizer like Column expressions.
FUNCTIONS = {
    "haversine_m": (
        "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "DOUBLE",
        "2 * 6371000.0D * asin(least(1.0D, sqrt(pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2))))",
    ),
    "local_x": ("x DOUBLE, ref_lat DOUBLE", "DOUBLE", "x * 111320.0D * cos(radians(ref_lat))"),
    "local_y": ("y DOUBLE", "DOUBLE", "y * 110540.0D"),
    "half_up": ("v DOUBLE", "BIGINT", "CAST(floor(v + 0.5D) AS BIGINT)"),
    "wilson_lo": ("k BIGINT, n BIGINT", "DOUBLE", "coalesce(try_divide(try_divide(k, n) + try_divide(1.9208D, n) - 1.96D * sqrt(try_divide(try_divide(k, n) * (1 - try_divide(k, n)), n) + try_divide(0.9604D, n * n)), 1 + try_divide(3.8416D, n)), 0.0D)"),
    "wilson_hi": ("k BIGINT, n BIGINT", "DOUBLE", "coalesce(try_divide(try_divide(k, n) + try_divide(1.9208D, n) + 1.96D * sqrt(try_divide(try_divide(k, n) * (1 - try_divide(k, n)), n) + try_divide(0.9604D, n * n)), 1 + try_divide(3.8416D, n)), 0.0D)"),
    "cable_tier": ("a STRING, b STRING", "STRING", "CASE WHEN array_contains(array(a, b), 'cabinet') AND array_contains(array(a, b), 'co') THEN 'feeder' WHEN array_contains(array(a, b), 'house') AND arrays_overlap(array(a, b), array('closure', 'den')) THEN 'drop' ELSE 'distribution' END"),
    "optical_status": ("db DOUBLE", "STRING", "CASE WHEN db >= 27 THEN 'critical' WHEN db >= 25 THEN 'warning' ELSE 'ok' END"),
    "address_key": ("a STRING", "STRING", r"regexp_replace(regexp_replace(trim(lower(a)), '\\s+', ' '), ',\\s*', ', ')"),
    "splitter_ways": ("ratio STRING", "INT", "coalesce(CAST(nullif(regexp_extract(ratio, '1:([0-9]+)', 1), '') AS INT), 8)"),
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def register(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Makes the functions available to spark.sql, and with a folder of tables also its tables and scenes as views."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    if sf_dir:
        for name in TABLES:
            scenes.table(spark, sf_dir, name).createOrReplaceTempView(name)
        for view in (scenes.points, scenes.buildings, scenes.equipment, scenes.streets, scenes.distribution):
            view(spark, sf_dir).createOrReplaceTempView(f"scene_{view.__name__}")
