"""Window and time-series operators.

Every window here runs on an *aggregated* series: one row per calendar day
(or month, or lead day per channel). Rows are first reduced by a grouped
aggregation with map-side partial aggregation, so the windows see a frame
bounded by the calendar, never the raw booking rows. Windows over several
series are partitioned by the series key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions.columns import fin


def daily_series(df: DataFrame, y: str = "revenue_per_night", date_col: str = "checkin_date") -> DataFrame:
    """Daily mean of ``y`` in date order (columns ``ds``, ``y``)."""
    col = y if y in df.columns else "actual_price"
    return df.groupBy(F.col(date_col).alias("ds")).agg(F.avg(col).alias("y"))


def rolling(series: DataFrame, n: int, fn=F.avg, order: str = "ds", by: str | None = None):
    """``n``-row trailing window (``min_periods=1``) expression over ``series``."""
    w = Window.orderBy(order) if by is None else Window.partitionBy(by).orderBy(order)
    return lambda c: fn(c).over(w.rowsBetween(-(n - 1), Window.currentRow))


def rolling_stats(series: DataFrame, digits: int = 6) -> DataFrame:
    """W2 + W3 + W4: 7/30-row rolling means, 30-row sample std (first row 0),
    the mean +/- 1.5 std band, and days elapsed since the series start."""
    w_all = Window.orderBy("ds").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r7 = rolling(series, 7)
    r30 = rolling(series, 30)
    sd30 = rolling(series, 30, F.stddev_samp)
    out = series.select(
        "ds", "y",
        r7("y").alias("roll7"), r30("y").alias("roll30"),
        F.coalesce(sd30("y"), F.lit(0.0)).alias("std30"),
        F.datediff("ds", F.min("ds").over(w_all)).alias("t_days"))
    return out.select("ds", "t_days", *[fin(c, digits).alias(c) for c in ("y", "roll7", "roll30", "std30")],
                      fin(F.col("roll30") - 1.5 * F.col("std30"), digits).alias("band_lo"),
                      fin(F.col("roll30") + 1.5 * F.col("std30"), digits).alias("band_hi"))


def poly_fit(series: DataFrame, deg: int = 3, x: str = "t_days", y: str = "y"):
    """Least-squares polynomial of degree ``deg`` (MLlib normal equations).

    ``t`` is scaled to [0, 1] by the series span for conditioning; returns
    (model, t_max) so forecasts scale the same way.
    """
    from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
    from pyspark.ml.regression import LinearRegression
    t_max = series.agg(F.max(x)).first()[0] or 1
    prepared = series.withColumn("_t", F.col(x) / F.lit(float(t_max)))
    vec = VectorAssembler(inputCols=["_t"], outputCol="_tv").transform(prepared)
    poly = PolynomialExpansion(degree=deg, inputCol="_tv", outputCol="_tp").transform(vec)
    model = LinearRegression(featuresCol="_tp", labelCol=y, solver="normal", regParam=0.0).fit(poly)
    return model, float(t_max)


def forecast(series: DataFrame, model, t_max: float, days: int = 30, deg: int = 3) -> DataFrame:
    """Date spine after the last day, polynomial values on it."""
    from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
    start = series.agg(F.min("ds").alias("d0"), F.max("ds").alias("d1"))
    spine = start.select("d0", F.explode(F.sequence(F.date_add("d1", 1), F.date_add("d1", days))).alias("ds"))
    spine = spine.withColumn("_t", F.datediff("ds", "d0") / F.lit(float(t_max)))
    vec = VectorAssembler(inputCols=["_t"], outputCol="_tv").transform(spine)
    poly = PolynomialExpansion(degree=deg, inputCol="_tv", outputCol="_tp").transform(vec)
    return model.transform(poly.withColumnRenamed("_tp", model.getFeaturesCol())) \
        .select("ds", fin("prediction").alias("forecast"))


def trend_seasonal(monthly: DataFrame, t: str = "t", y: str = "revenue") -> DataFrame:
    """Linear trend over the month index and the residual (seasonal part)."""
    fit = monthly.agg(F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("intercept"))
    out = monthly.crossJoin(F.broadcast(fit)).withColumn(
        "trend", F.col("intercept") + F.col("slope") * F.col(t))
    return out.select(t, fin(y).alias(y), fin("trend").alias("trend"),
                      fin(F.col(y) - F.col("trend")).alias("seasonal"))


def pct_change(c: str, order: str, by: str | None = None):
    """``c / lag(c) - 1`` in ``order`` (null for the first row)."""
    w = Window.orderBy(order) if by is None else Window.partitionBy(by).orderBy(order)
    prev = F.lag(c).over(w)
    return F.when(prev != 0, F.col(c) / prev - 1)


def lead_price_curve(df: DataFrame, max_lead: int = 120, window: int = 5,
                     y: str = "actual_price") -> DataFrame:
    """Per channel, mean price per lead day (<= max_lead), ``window``-row rolling mean."""
    per_day = (df.filter(F.col("lead_time_days") <= max_lead)
               .groupBy("channel", "lead_time_days").agg(F.avg(y).alias("avg_price")))
    w = Window.partitionBy("channel").orderBy("lead_time_days").rowsBetween(-(window - 1), 0)
    return per_day.select("channel", "lead_time_days", fin("avg_price").alias("avg_price"),
                          fin(F.avg("avg_price").over(w)).alias("rolling_price"))


def cum_share(df: DataFrame, key: str, value: str, descending: bool = True) -> DataFrame:
    """Cumulative sum and share of ``value`` in rank order of the groups."""
    order = [F.col(value).desc() if descending else F.col(value).asc(), F.col(key)]
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = df.agg(F.sum(value).alias("_tot"))
    return (df.crossJoin(F.broadcast(total))
            .select(key, fin(value, 4).alias(value), fin(F.sum(value).over(w), 4).alias("cum_value"),
                    fin(F.sum(value).over(w) / F.col("_tot") * 100).alias("cum_share_pct")))


def competitor_drop_alerts(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Days on which a room type's average competitor price fell by more
    than ``threshold`` from its previous day."""
    daily = df.groupBy("room_type", "checkin_date").agg(F.avg("competitor_avg_price").alias("comp"))
    w = Window.partitionBy("room_type").orderBy("checkin_date")
    prev = F.lag("comp").over(w)
    out = daily.select("room_type", "checkin_date", "comp", prev.alias("prev_comp"))
    drop = (F.col("prev_comp") - F.col("comp")) / F.col("prev_comp")
    return (out.filter(F.col("prev_comp").isNotNull() & (drop > threshold))
            .select("room_type", "checkin_date", fin("comp").alias("comp"),
                    fin("prev_comp").alias("prev_comp"), fin(drop * 100).alias("drop_pct")))
