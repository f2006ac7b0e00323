"""Raw hotel-bookings ingest (C1-C3, S3, D1-D12 on the raw schema).

``to_bookings`` turns rows of the raw bookings CSV schema
(``io.RAW_BOOKINGS_SCHEMA``) into the bookings table; ``raw_from_tables``
derives rows of that raw schema from the driver's tables so the ingest path
runs on the given data at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.functions.columns import rnd, season
from ratewise.functions.seeded import room_base_price, seeded_event, seeded_int, seeded_uniform
from ratewise.operators.clean import row_hash
from ratewise.sources.bookings import mark_test, star_join
from ratewise.sources.io import arrival_date

MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December"]
ROOM_LETTERS = ["A", "B", "C", "D", "E", "F", "G", "H", "L", "P", "K", "X"]


def raw_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the raw CSV schema from the star schema (one per line item)."""
    j = star_join(spark, sf_dir)
    ship = F.to_date("l_shipdate")
    letters = F.array(*[F.lit(x) for x in ROOM_LETTERS])
    return j.select(
        row_hash(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).alias("booking_id"),
        F.col("r_name").alias("hotel"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_canceled"),
        (F.abs(F.datediff(ship, F.to_date("o_orderdate"))) % 366).cast("int").alias("lead_time"),
        F.year(ship).alias("arrival_date_year"),
        # padded month names exercise the trim of S3
        F.concat(F.lit(" "), F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(ship)), F.lit(" "))
        .alias("arrival_date_month"),
        F.dayofmonth(ship).alias("arrival_date_day_of_month"),
        (F.col("l_linenumber") % 3).cast("int").alias("stays_in_weekend_nights"),
        (F.col("l_quantity").cast("int") % 5).cast("int").alias("stays_in_week_nights"),
        (1 + F.col("l_partkey") % 3).cast("int").alias("adults"),
        F.when(F.col("l_suppkey") % 7 == 0, F.lit(None)).otherwise((F.col("l_suppkey") % 3).cast("double"))
        .alias("children"),
        F.col("p_brand").alias("market_segment"),
        F.col("o_orderpriority").alias("distribution_channel"),
        F.when(F.col("o_custkey") % 4 == 0, 1).otherwise(0).alias("is_repeated_guest"),
        F.element_at(letters, (F.col("l_partkey") % len(ROOM_LETTERS) + 1).cast("int")).alias("reserved_room_type"),
        F.col("c_mktsegment").alias("customer_type"),
        (F.col("l_extendedprice") / 500.0 - 2.0).alias("adr"),
    )


def to_bookings(raw: DataFrame, key: str = "booking_id", seed: int = 42) -> DataFrame:
    """C1 (adr > 5), C2 (rename/map), C3 (children null -> 0), S3 (date from
    month name), D1-D3 calendar, D4-D11 seeded augmentation, D12 split."""
    if key not in raw.columns:
        # no id column: a deterministic non-negative hash of the whole raw row
        raw = raw.withColumn(key, F.pmod(F.xxhash64(*raw.columns), F.lit(2 ** 62)))
    keys = [key]
    paid = raw.filter(F.col("adr") > 5)
    d = arrival_date("arrival_date_year", "arrival_date_month", "arrival_date_day_of_month")
    base = paid.select(
        F.col(key),
        rnd("adr", 2).alias("actual_price"),
        F.col("lead_time").alias("lead_time_days"),
        F.greatest(F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights"), F.lit(1)).alias("length_of_stay"),
        F.col("is_repeated_guest").alias("repeat_guest"),
        F.col("is_canceled").alias("cancellation"),
        F.col("hotel").alias("hotel_name"),
        F.col("reserved_room_type").alias("room_type"),
        F.col("distribution_channel").alias("channel"),
        F.col("customer_type").alias("guest_type"),
        "adults",
        F.coalesce(F.col("children"), F.lit(0.0)).cast("int").alias("children"),
        "market_segment", "is_canceled",
        d.alias("checkin_date"),
    )
    cal = base.withColumns({
        "year": F.year("checkin_date"), "month": F.month("checkin_date"),
        "day_of_week": F.weekday("checkin_date"),
        "day_of_week_name": F.date_format("checkin_date", "EEEE"),
        "week_of_year": F.weekofyear("checkin_date"), "day_of_year": F.dayofyear("checkin_date"),
        "is_holiday": F.lit(0),
    }).withColumns({"is_weekend": (F.col("day_of_week") >= 4).cast("int"), "season": season("month")})
    priced = cal.withColumn("base_price", room_base_price("room_type", keys, seed))
    comp_base = F.col("base_price") * seeded_uniform(keys, 0.90, 1.10, seed + 1)
    comp = priced.withColumn("_cb", comp_base).withColumns({
        "competitor_price_1": rnd(F.col("_cb") * seeded_uniform(keys, 0.95, 1.05, seed + 2), 2),
        "competitor_price_2": rnd(F.col("_cb") * seeded_uniform(keys, 0.90, 1.10, seed + 3), 2),
        "competitor_price_3": rnd(F.col("_cb") * seeded_uniform(keys, 0.85, 1.15, seed + 4), 2),
    }).drop("_cb")
    cp = [F.col(f"competitor_price_{i}") for i in (1, 2, 3)]
    ev, mag = seeded_event(keys, seed + 5)
    bump = F.when(F.col("month").isin(7, 8), 0.2).when(F.col("month").isin(6, 12), 0.15).otherwise(0.0)
    noise = (seeded_uniform(keys, -1, 1, seed + 8) + seeded_uniform(keys, -1, 1, seed + 9)
             + seeded_uniform(keys, -1, 1, seed + 10)) * 0.08
    out = comp.withColumns({
        "competitor_avg_price": rnd((cp[0] + cp[1] + cp[2]) / 3.0, 2),
        "competitor_min_price": F.least(*cp), "competitor_max_price": F.greatest(*cp),
        "event_type": ev, "event_magnitude": mag,
        "weather_score": seeded_int(keys, 1, 6, seed + 11),
        "reviews_score": rnd(seeded_uniform(keys, 3.5, 5.0, seed + 7), 1),
        "occupancy_rate": rnd(F.least(F.lit(0.98), F.greatest(F.lit(0.20), 0.60 + bump + noise)), 4),
    })
    out = out.withColumn("demand_score", rnd(F.least(F.lit(1.0), F.greatest(F.lit(0.1), (F.col("occupancy_rate") - 0.2) / 0.8)), 4))
    out = out.withColumns({
        "revenue_per_night": rnd(F.col("actual_price") * F.col("length_of_stay"), 2),
        "revpar": rnd(F.col("actual_price") * F.col("occupancy_rate"), 2),
    })
    return mark_test(out)
