"""The quick way to round rows against the decimals that define it, and what makes wide plans compile."""

import math
import random

from pyspark.sql import functions as F

from ratewise.functions.columns import fin, fin_row, fin_wide_row, rnd
from ratewise.sources.bookings import bookings


def _values():
    r = random.Random(5)
    out = [None, 0.0, -0.0, 1e-9, 0.005, 1.005, 2.675, -2.675, 0.125, 123456.785, 99999.995, 1e9 + 0.005, 9.9e9, 0.4999999949,
           0.0049999999949, 0.004999999995, 0.00500000001, 1234.56785, 1234.567849999999]
    out += [r.randrange(10 ** 7) / 1000 for _ in range(3000)]               # many halves
    out += [r.uniform(-1, 1) * 10 ** r.randrange(-3, 9) for _ in range(3000)]
    return [(x,) for x in out]


def test_rounding_equals_decimals(spark):
    df = spark.createDataFrame(_values(), "x double")
    for n in (0, 1, 2, 4, 6):
        slow = F.round(F.col("x").cast("decimal(18,8)"), n).cast("double")
        pairs = df.select("x", slow.alias("want"), rnd("x", n).alias("got"), fin_row("x", n).alias("row"),
                          fin("x", n).alias("wide"), fin_wide_row("x", n).alias("wide_row")).collect()
        for p in pairs:
            assert p["want"] == p["got"] == p["row"] and p["wide"] == p["wide_row"], (n, p)
            assert p["got"] is None or math.copysign(1, p["got"]) == math.copysign(1, p["want"]), (n, p)


def test_bookings_leave_out_methods_that_hotspot_does_not_compile(spark, small_dir):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "65535")
        bookings(spark, small_dir)
        assert int(spark.conf.get(name)) == 8000
        spark.conf.set(name, "4000")
        bookings(spark, small_dir)
        assert int(spark.conf.get(name)) == 4000
    finally:
        spark.conf.set(name, before)
