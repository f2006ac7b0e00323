"""Registered cleaning queries (C4-C14) over the ``bookings_dirty`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.functions.columns import fin_row
from ratewise.operators import clean as C
from ratewise.plans.catalog import query
from ratewise.plans.oracle import R, RND, RR, with_bookings
from ratewise.session import cut_lineage
from ratewise.sources.bookings import BOOKING_COLS, KEY_COLS, bookings, dirty_bookings

IMPUTED_NUM = ["occupancy_rate", "reviews_score", "weather_score", "lead_time_days", "competitor_price_2"]
DOUBLE_COLS = {"l_extendedprice", "base_price", "competitor_price_1", "competitor_price_2",
               "competitor_price_3", "competitor_avg_price", "competitor_min_price",
               "competitor_max_price", "reviews_score", "occupancy_rate", "demand_score",
               "actual_price", "revenue_per_night", "revpar"}


def round_doubles(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[fin_row(c, n).alias(c) if isinstance(t, T.DoubleType) else F.col(c)
                       for c, t in ((f.name, f.dataType) for f in df.schema.fields)])


def _sel_rounded(cols, doubles, src):
    return "SELECT " + ", ".join(RR(c) + f" AS {c}" if c in doubles else c for c in cols) + f" FROM {src}"


_INTS_PRESENT = [c for c in C.INT_COLS if c in BOOKING_COLS]
_FLOATS_PRESENT = [c for c in C.FLOAT_COLS if c in BOOKING_COLS]

CLEAN_CTES = (
    "cl_med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in IMPUTED_NUM)
    + " FROM bookings_dirty)",
    """cl_mode AS (SELECT guest_type FROM bookings_dirty WHERE guest_type IS NOT NULL
                GROUP BY guest_type ORDER BY count(*) DESC, guest_type LIMIT 1)""",
    "cl_imp AS (SELECT d.* REPLACE (" + ", ".join(f"coalesce(d.{c}, m.{c}) AS {c}" for c in IMPUTED_NUM)
    + ", coalesce(d.guest_type, mo.guest_type) AS guest_type) FROM bookings_dirty d, cl_med m, cl_mode mo)",
    "cl_dd AS (SELECT DISTINCT * FROM cl_imp)",
    "cl_typed AS (SELECT * REPLACE (" + ", ".join(
        [f"CAST(trunc({c}) AS INT) AS {c}" for c in _INTS_PRESENT]
        + [f"{RND(f'CAST({c} AS DOUBLE)', 4)} AS {c}" for c in _FLOATS_PRESENT]) + ") FROM cl_dd)",
    "cl_q AS (SELECT " + ", ".join(f"quantile_cont({c}, [0.25, 0.75]) AS {c}" for c in C.PRICE_COLS)
    + " FROM cl_typed)",
    "cl_fence AS (SELECT " + ", ".join(
        f"{c}[1] AS {c}_q1, {c}[2] AS {c}_q3, {c}[1] - 3e0 * ({c}[2] - {c}[1]) AS {c}_lo, "
        f"{c}[2] + 3e0 * ({c}[2] - {c}[1]) AS {c}_hi" for c in C.PRICE_COLS) + " FROM cl_q)",
    "cleaned AS (SELECT t.* REPLACE (" + ", ".join(
        f"CASE WHEN t.{c} IS NOT NULL THEN least(greatest(t.{c}, f.{c}_lo), f.{c}_hi) END AS {c}"
        for c in C.PRICE_COLS) + ") FROM cl_typed t, cl_fence f)",
)


@query("c05_with_issues", with_bookings(_sel_rounded(BOOKING_COLS, DOUBLE_COLS, "bookings_dirty"), dirty=True))
def c05_with_issues(spark, d):
    """C5 + C6: planted nulls, duplicate rows (union all) and price outliers."""
    return round_doubles(dirty_bookings(spark, d))


@query("c07_impute_median", with_bookings(
    _sel_rounded(KEY_COLS + IMPUTED_NUM, DOUBLE_COLS | set(IMPUTED_NUM), "cl_imp"), *CLEAN_CTES[:3], dirty=True))
def c07_impute_median(spark, d):
    out = C.impute_median(cut_lineage(dirty_bookings(spark, d).select(*KEY_COLS, *IMPUTED_NUM)), IMPUTED_NUM)
    return round_doubles(out)


@query("c08_impute_mode", with_bookings(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, guest_type FROM cl_imp",
    *CLEAN_CTES[:3], dirty=True))
def c08_impute_mode(spark, d):
    return C.impute_mode(cut_lineage(dirty_bookings(spark, d).select(*KEY_COLS, "guest_type")), ["guest_type"])


@query("c09_dedupe", with_bookings(
    """SELECT (SELECT count(*) FROM cl_imp) AS n_before, (SELECT count(*) FROM cl_dd) AS n_after,
       (SELECT count(*) FROM cl_imp) - (SELECT count(*) FROM cl_dd) AS n_removed""",
    *CLEAN_CTES[:4], dirty=True))
def c09_dedupe(spark, d):
    imp = C.impute_mode(C.impute_median(cut_lineage(dirty_bookings(spark, d))))
    before = imp.agg(F.count(F.lit(1)).alias("n_before"))
    after = C.dedupe(imp).agg(F.count(F.lit(1)).alias("n_after"))
    return (before.crossJoin(after)
            .withColumn("n_removed", F.col("n_before") - F.col("n_after")))


@query("c11_winsorize_report", with_bookings(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column, {R(f'{c}_q1')} AS q1, {R(f'{c}_q3')} AS q3, {R(f'{c}_lo')} AS lower,
        {R(f'{c}_hi')} AS upper, (SELECT count(*) FROM cl_typed t WHERE t.{c} < f.{c}_lo OR t.{c} > f.{c}_hi) AS n_capped
        FROM cl_fence f""" for c in C.PRICE_COLS),
    *CLEAN_CTES[:7], dirty=True))
def c11_winsorize_report(spark, d):
    typed = cut_lineage(C.enforce_types(C.dedupe(C.impute_mode(C.impute_median(cut_lineage(dirty_bookings(spark, d))))))
                        .select(*C.PRICE_COLS))
    return C.winsorize_report(typed)


@query("c12_zscore_outliers", with_bookings(f"""
SELECT CAST(count(CASE WHEN occupancy_rate IS NOT NULL AND abs((occupancy_rate - mu) / sd) > 4e0 THEN 1 END) AS BIGINT)
         AS n_outliers, count(occupancy_rate) AS n
FROM bookings_dirty, (SELECT avg(occupancy_rate) AS mu, stddev_pop(occupancy_rate) AS sd FROM bookings_dirty) s""",
    dirty=True))
def c12_zscore_outliers(spark, d):
    return C.zscore_outliers(dirty_bookings(spark, d), "occupancy_rate", 4.0)


def _sql_hash(keys, seed):
    """``row_hash`` in SQL."""
    text = ", ".join([f"'{seed}'", *[f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys]])
    return f"CAST('0x' || substr(md5(concat_ws('|', {text})), 1, {C.HASH_BITS // 4}) AS BIGINT)"


def _sql_uniform(keys, seed):
    """``uniform01`` in SQL."""
    return f"(({_sql_hash(keys, seed)} >> {C.HASH_BITS - 53}) / 9007199254740992e0)"


_INT_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("c13_sample_n", with_bookings(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, actual_price, room_type FROM bookings
ORDER BY {_sql_hash(_INT_KEYS, 42)}, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 500"""))
def c13_sample_n(spark, d):
    s = C.sample_n(bookings(spark, d), 500, 42, _INT_KEYS)
    return s.select(*_INT_KEYS, "actual_price", "room_type")


@query("c14_partition_counts", with_bookings("""
SELECT count(CASE WHEN occupancy_rate > 0.8e0 THEN 1 END) AS n_match,
       count(CASE WHEN NOT coalesce(occupancy_rate > 0.8e0, false) THEN 1 END) AS n_rest,
       count(*) AS n_total FROM bookings_dirty""", dirty=True))
def c14_partition_counts(spark, d):
    df = dirty_bookings(spark, d)
    hit, rest = C.partition(df, F.col("occupancy_rate") > 0.8)
    return (hit.agg(F.count(F.lit(1)).alias("n_match"))
            .crossJoin(rest.agg(F.count(F.lit(1)).alias("n_rest")))
            .crossJoin(df.agg(F.count(F.lit(1)).alias("n_total"))))


@query("c15_clean_table", with_bookings(
    _sel_rounded(BOOKING_COLS, DOUBLE_COLS, "cleaned"), *CLEAN_CTES, dirty=True))
def c15_clean_table(spark, d):
    """Steps C7-C11 in order: the table every analysis reads."""
    return round_doubles(C.clean(dirty_bookings(spark, d)))
