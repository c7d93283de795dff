"""The SQL functions say what the Column expressions say."""

from conftest import DATA
from pyspark.sql import functions as F

from terrane.functions import geo, network, sql, stats
from terrane.functions.geo import P


def test_functions_agree(spark):
    sql.register(spark, DATA)
    k = spark.range(0, 30).select(F.col("id"), (F.col("id") * 7 % 5).alias("c"))
    k.createOrReplaceTempView("k")
    _, lo, hi = stats.wilson(F.col("c"), F.col("id"))
    for a, b in zip(spark.sql("SELECT wilson_lo(c, id) AS lo, wilson_hi(c, id) AS hi FROM k WHERE c <= id OR id = 0").collect(), k.filter("c <= id OR id = 0").select(lo.alias("lo"), hi.alias("hi")).collect()):
        assert abs(a.lo - b.lo) < 1e-12 and abs(a.hi - b.hi) < 1e-12
    lit = lambda *v: P(*(F.lit(float(x)) for x in v))
    one = spark.range(1).select(geo.haversine(lit(1, 2), lit(3, 4)).alias("d"), network.tier(F.lit("co"), F.lit("cabinet")).alias("t"), network.tier(F.lit("house"), F.lit("den")).alias("u")).first()
    got = spark.sql("SELECT haversine_m(1, 2, 3, 4) AS d, cable_tier('co', 'cabinet') AS t, cable_tier('house', 'den') AS u, half_up(-2.5D) AS h, splitter_ways(NULL) AS w, optical_status(26) AS s, address_key('  A  b,C') AS a").first()
    assert (round(got.d, 6), got.t, got.u) == (round(one.d, 6), one.t, one.u) and (got.h, got.w, got.s, got.a) == (-2, 8, "warning", "a b, c")
    assert spark.sql("SELECT count(*) AS n FROM scene_buildings b JOIN embeddings e ON e.vec_id = b.id").first().n > 0
