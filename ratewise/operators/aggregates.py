"""Grouped aggregations (each chart of the reference re-aimed as its query).

All of these are hash aggregations with map-side partial aggregation, so the
shuffle carries one partial row per (task, group) whatever the group sizes --
a key holding a third of the rows costs no more than any other key. Pivots
always pass their values so Spark plans no extra distinct job. Global
statistics (min/max, totals) are one-row aggregates joined back with a
broadcast (one row is a proven size bound), never a window ``over ()`` on raw
rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions.columns import (
    fin_wide_row,
    DAY_ABBR, LEAD_BUCKET_ORDER, MONTH_ABBR, fin, lead_time_bucket, normal_quantile, occ_band,
    relabel, sample_skew, year_month,
)
from ratewise.operators.quantiles import column_quantiles, exact_quantiles, order_statistics, quantiles_of_counts, value_counts

TARGET = "actual_price"


def kpis(df: DataFrame) -> DataFrame:
    """G1."""
    return df.agg(fin(F.avg(TARGET)).alias("avg_price"),
                  fin(F.avg("occupancy_rate") * 100).alias("avg_occupancy_pct"),
                  fin(F.avg("lead_time_days")).alias("avg_lead_time"))


def price_by(df: DataFrame, by: str, y: str = TARGET, descending: bool = False,
             name: str = "avg_price") -> DataFrame:
    """Mean of ``y`` per group, sorted by the mean."""
    out = df.groupBy(by).agg(fin(F.avg(y)).alias(name))
    order = F.col(name).desc() if descending else F.col(name).asc()
    return out.orderBy(order, F.col(by))


def sum_by(df: DataFrame, by: str | Sequence[str], y: str = "revenue_per_night",
           name: str = "total_revenue") -> DataFrame:
    """G2, G35, G38."""
    keys = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*keys).agg(fin(F.sum(y), 4).alias(name)).orderBy(*keys)


def pivot_mean(df: DataFrame, row: str, col: str, values: Sequence, labels: Sequence[str],
               y: str, fill: float | None = 0.0) -> DataFrame:
    """``row`` x ``col`` matrix of means, columns named by ``labels``."""
    out = df.groupBy(row).pivot(col, list(values)).agg(F.avg(y))
    cols = [F.col(row)]
    for v, lab in zip(values, labels):
        cell = F.col(str(v))
        if fill is not None:
            cell = F.coalesce(cell, F.lit(float(fill)))
        cols.append(fin(cell).alias(lab))
    return out.select(*cols).orderBy(row)


def occ_heatmap(df: DataFrame) -> DataFrame:
    """Month x weekday mean occupancy, missing cells 0."""
    return pivot_mean(df, "month", "day_of_week", range(7), DAY_ABBR, "occupancy_rate")


def monthly_summary(df: DataFrame) -> DataFrame:
    """G6."""
    return (df.groupBy("month")
            .agg(fin(F.avg(TARGET)).alias("avg_price"),
                 fin(F.sum("revenue_per_night"), 4).alias("total_revenue"),
                 fin(F.avg("occupancy_rate")).alias("avg_occupancy"))
            .orderBy("month"))


def revenue_by_month(df: DataFrame) -> DataFrame:
    """G2 with month labels."""
    return (df.groupBy("month").agg(fin(F.sum("revenue_per_night"), 4).alias("total_revenue"))
            .withColumn("month_name", relabel("month", MONTH_ABBR, base=1))
            .orderBy("month"))


def price_by_event_flag(df: DataFrame) -> DataFrame:
    """Event vs no-event mean price, relabelled."""
    flag = (F.col("event_type") != "None").cast("int")
    return (df.groupBy(flag.alias("has_event"))
            .agg(fin(F.avg(TARGET)).alias("avg_price"))
            .withColumn("label", relabel("has_event", ["no event", "event day"]))
            .orderBy("has_event"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson matrix, long form, with a lower-triangle flag.

    Each pair uses the rows where both are present (pandas' rule): per pair
    count, sums, sums of squares and of products, in one pass. The data are
    first centred on the column means (one row), which keeps the sums stable.
    """
    cols = list(cols)
    n = len(cols)
    src = df.select(*cols)
    seen = src.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                   *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()   # one row
    cen = src.select(*[(F.col(c) - F.lit(seen[f"m{i}"])).alias(f"d{i}") for i, c in enumerate(cols)])
    holey = {i for i in range(n) if seen[f"n{i}"]}
    sums = []
    for i in range(n):
        for j in range(i + 1):
            x, y = F.col(f"d{i}"), F.col(f"d{j}")
            sums.append(F.sum(x * y).alias(f"s{i}_{j}"))
            if holey & {i, j}:                      # where a null can hide a row from one of the two
                both = x.isNotNull() & y.isNotNull()
                sums += [F.count_if(both).alias(f"c{i}_{j}"), F.sum(F.when(both, x)).alias(f"x{i}_{j}"),
                         F.sum(F.when(both, y)).alias(f"y{i}_{j}"), F.sum(F.when(both, x * x)).alias(f"xx{i}_{j}"),
                         F.sum(F.when(both, y * y)).alias(f"yy{i}_{j}")]
    sums = cen.agg(*sums)

    def r(i, j):
        a, b = max(i, j), min(i, j)
        if not holey & {a, b}:
            return F.col(f"s{a}_{b}") / F.sqrt(F.col(f"s{a}_{a}") * F.col(f"s{b}_{b}"))
        k = f"{a}_{b}"
        c = F.col(f"c{k}")
        return ((F.col(f"s{k}") - F.col(f"x{k}") * F.col(f"y{k}") / c)
                / F.sqrt((F.col(f"xx{k}") - F.pow(F.col(f"x{k}"), 2) / c) * (F.col(f"yy{k}") - F.pow(F.col(f"y{k}"), 2) / c)))
    cells = [F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                      r(i, j).alias("corr"), F.lit(int(j < i)).alias("lower"))
             for i in range(n) for j in range(n)]
    return (sums.select(F.explode(F.array(*cells)).alias("p"))
            .select("p.col_a", "p.col_b", fin("p.corr").alias("corr"), "p.lower"))


def corr_with(df: DataFrame, cols: Sequence[str], y: str = TARGET) -> DataFrame:
    """Correlation of each column with the target, strongest first."""
    row = df.agg(*[F.corr(c, y).alias(c) for c in cols])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr"))
                                for c in cols]))
    out = row.select(stack.alias("p")).select("p.*")
    return (out.select("feature", fin("corr").alias("corr"))
            .orderBy(F.abs("corr").desc(), "feature"))


def histogram(df: DataFrame, x: str | Column, bins: int, by: str | None = None,
              density: bool = False, name: str = "value") -> DataFrame:
    """Equal-width bins over [min, max], last bin closed (NumPy rule).

    Range per group when ``by`` is given (a separate histogram per group).
    Every bin is reported, empty ones with count 0: the bin spine is
    ``sequence(0, bins-1)`` exploded from the range row, so it has exactly
    ``bins`` rows per group. Rows whose group is null are left out.
    """
    keys = [by] if by else []
    if by:                                          # counts first, so that rows never meet on the group key
        counted = value_counts(df, x, keys, name).where(F.col(by).isNotNull())
    else:
        xv = x if isinstance(x, Column) else F.col(x)
        counted = df.select(xv.alias(name), F.lit(1).cast("long").alias("n")).where(F.col(name).isNotNull())
    rng = counted.groupBy(*keys).agg(F.min(name).alias("lo"), F.max(name).alias("hi"), F.sum("n").alias("n_group"))
    rng = rng.withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    idx = F.least(F.floor((F.col(name) - F.col("lo")) / F.col("width")), F.lit(bins - 1))
    idx = F.when(F.col("width") > 0, idx).otherwise(F.lit(0)).cast("int")
    joined = counted.join(rng, keys) if by else counted.crossJoin(F.broadcast(rng))
    counts = joined.groupBy(*keys, idx.alias("bin")).agg(F.sum("n").alias("count"))
    spine = rng.select(*keys, "lo", "width", "n_group",
                       F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = spine.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin",
        fin(F.col("lo") + F.col("bin") * F.col("width")).alias("bin_lo"),
        fin(F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        *([fin(F.coalesce(F.col("count"), F.lit(0)) / (F.col("n_group") * F.col("width")))
           .alias("density")] if density else []))
    return out.orderBy(*keys, "bin")


def box_stats(df: DataFrame, by: str, y: str = TARGET) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (furthest point inside), outlier count.

    Rows are first reduced to (group, value) counts; exact quartiles come from
    the sorted counts, and the whiskers from the counts joined to their group's
    fences.
    """
    counts = value_counts(df, y, [by], "_v")
    q = (quantiles_of_counts(counts, [0.25, 0.5, 0.75], [by], "_v")
         .select(F.col(by).alias("_by"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")))
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    v = F.col("_v")
    inside = (v >= F.col("lo_fence")) & (v <= F.col("hi_fence"))
    w = (counts.join(q, F.col(by).eqNullSafe(F.col("_by")))
         .groupBy(by)
         .agg(F.first("q1").alias("q1"), F.first("median").alias("median"),
              F.first("q3").alias("q3"),
              F.min(F.when(inside, v)).alias("whisker_lo"),
              F.max(F.when(inside, v)).alias("whisker_hi"),
              F.sum(F.when(~inside, F.col("n")).otherwise(0)).cast("long").alias("n_outliers"),
              F.sum("n").alias("n")))
    return w.select(by, *[fin(c).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                    "n_outliers", "n").orderBy(by)


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, median, bias-corrected skew per column."""
    aggs = []
    medians = column_quantiles(df, cols, [0.5])
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.lit(medians[c][0]).cast("double").alias(f"{c}__median"),
                 sample_skew(c).alias(f"{c}__skew")]
    row = df.agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__mean").alias("mean"),
                 F.col(f"{c}__median").alias("median"), F.col(f"{c}__skew").alias("skew"))
        for c in cols]))
    out = row.select(stack.alias("m")).select("m.*")
    return out.select("column", fin("mean").alias("mean"), fin("median").alias("median"),
                      fin("skew").alias("skew"))


def price_by_month(df: DataFrame) -> DataFrame:
    """Monthly mean and sample std, band, peak-month flag."""
    m = df.groupBy("month").agg(F.avg(TARGET).alias("avg_price"),
                                F.stddev_samp(TARGET).alias("std_price"))
    peak = m.agg(F.max("avg_price").alias("peak"))
    return (m.crossJoin(F.broadcast(peak))
            .select("month", fin("avg_price").alias("avg_price"), fin("std_price").alias("std_price"),
                    fin(F.col("avg_price") - F.col("std_price")).alias("band_lo"),
                    fin(F.col("avg_price") + F.col("std_price")).alias("band_hi"),
                    (F.col("avg_price") == F.col("peak")).cast("int").alias("is_peak"))
            .orderBy("month"))


def price_yoy(df: DataFrame) -> DataFrame:
    """G18."""
    return (df.groupBy("year", "month").agg(fin(F.avg(TARGET)).alias("avg_price"))
            .orderBy("year", "month"))


def price_by_magnitude(df: DataFrame) -> DataFrame:
    """G20."""
    return price_by(df.filter(F.col("event_magnitude") > 0), "event_magnitude").orderBy("event_magnitude")


def event_count_by_month(df: DataFrame) -> DataFrame:
    """G21."""
    return (df.filter(F.col("event_type") != "None").groupBy("month")
            .agg(F.count(F.lit(1)).alias("n_event_bookings")).orderBy("month"))


PRICE_LEVEL_COLS = ["base_price", "competitor_price_1", "competitor_price_2",
                    "competitor_price_3", TARGET]


def price_level_comparison(df: DataFrame) -> DataFrame:
    """Mean of each price column, as rows."""
    row = df.agg(*[F.avg(c).alias(c) for c in PRICE_LEVEL_COLS])
    return (row.unpivot([], PRICE_LEVEL_COLS, "price_kind", "avg_price")
            .select("price_kind", fin("avg_price").alias("avg_price")))


def price_by_occ_band(df: DataFrame) -> DataFrame:
    """G25 (bands right-closed, the lowest edge excluded)."""
    return (df.groupBy(occ_band("occupancy_rate").alias("occ_band"))
            .agg(fin(F.avg(TARGET)).alias("avg_price"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("occ_band").isNotNull()))


def ols_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Straight-line fit and r2 in one aggregation."""
    return df.agg(fin(F.regr_slope(y, x)).alias("slope"),
                  fin(F.regr_intercept(y, x)).alias("intercept"),
                  fin(F.regr_r2(y, x)).alias("r2"),
                  F.regr_count(y, x).alias("n"))


def revenue_by_ym(df: DataFrame) -> DataFrame:
    """G27."""
    return (df.groupBy(year_month("year", "month").alias("ym"))
            .agg(fin(F.avg("revenue_per_night")).alias("avg_revenue")).orderBy("ym"))


def revenue_by_channel(df: DataFrame) -> DataFrame:
    """G28."""
    return (df.groupBy("channel")
            .agg(fin(F.avg("revenue_per_night")).alias("avg_revenue"),
                 fin(F.sum("revenue_per_night") / 1e6).alias("total_revenue_m"))
            .orderBy(F.col("total_revenue_m").desc()))


SEASONS = ["Winter", "Spring", "Summer", "Fall"]


def revenue_pivot(df: DataFrame) -> DataFrame:
    """Room type x season mean stay revenue (missing cells stay null)."""
    return pivot_mean(df, "room_type", "season", SEASONS, SEASONS, "revenue_per_night", fill=None)


def revpar_by_hotel(df: DataFrame) -> DataFrame:
    """G30."""
    return (df.groupBy("hotel_name")
            .agg(fin(F.avg("revpar")).alias("avg_revpar"),
                 fin(F.sum("revenue_per_night"), 4).alias("total_revenue"))
            .orderBy("hotel_name"))


def price_by_lead_bucket(df: DataFrame) -> DataFrame:
    """Fixed bucket order, absent buckets reported as 0 (ordered dimension left join)."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(i, b) for i, b in enumerate(LEAD_BUCKET_ORDER)],
                                "bucket_order int, lead_time_bucket string")
    agg = (df.groupBy(lead_time_bucket("lead_time_days").alias("lead_time_bucket"))
           .agg(F.avg(TARGET).alias("avg_price")))
    return (F.broadcast(dim).join(agg, "lead_time_bucket", "left")
            .select("bucket_order", "lead_time_bucket",
                    fin(F.coalesce("avg_price", F.lit(0.0))).alias("avg_price"))
            .orderBy("bucket_order"))


def share_by(df: DataFrame, by: str) -> DataFrame:
    """Count and share % per group; the total is a one-row broadcast."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return (counts.crossJoin(F.broadcast(total))
            .select(by, "n", fin(F.col("n") / F.col("total") * 100).alias("share_pct"))
            .orderBy(F.col("n").desc(), by))


def occ_weekend_pivot(df: DataFrame) -> DataFrame:
    """G34."""
    return pivot_mean(df, "room_type", "is_weekend", [0, 1], ["weekday", "weekend"],
                      "occupancy_rate", fill=None)


def revenue_share(df: DataFrame, by: str = "room_type") -> DataFrame:
    """G36."""
    sums = df.groupBy(by).agg(F.sum("revenue_per_night").alias("revenue"))
    total = sums.agg(F.sum("revenue").alias("total"))
    return (sums.crossJoin(F.broadcast(total))
            .select(by, fin("revenue", 4).alias("revenue"),
                    fin(F.col("revenue") / F.col("total") * 100).alias("share_pct"))
            .orderBy(F.col("revenue").desc(), by))


MONTH_COLS = [f"m{m:02d}" for m in range(1, 13)]


def year_month_matrix(df: DataFrame, y: str) -> DataFrame:
    """Year x month means of ``y``, missing months 0."""
    return pivot_mean(df, "year", "month", range(1, 13), MONTH_COLS, y)


def cancel_rate(df: DataFrame) -> DataFrame:
    """G39."""
    return (df.groupBy("channel").agg(fin(F.avg("cancellation") * 100).alias("cancel_rate_pct"))
            .orderBy("channel"))


def monthly_series(df: DataFrame) -> DataFrame:
    """Monthly totals in date order with index t.

    The ``row_number`` window has no partition key, but it runs on the
    monthly aggregate (one row per calendar month), a calendar bound.
    """
    m = df.groupBy("year", "month").agg(
        F.sum("revenue_per_night").alias("revenue"), F.count(F.lit(1)).alias("bookings"),
        F.avg(TARGET).alias("avg_price"))
    w = Window.orderBy("year", "month")
    return m.select((F.row_number().over(w) - 1).alias("t"), "year", "month",
                    fin("revenue", 4).alias("revenue"), "bookings",
                    fin("avg_price").alias("avg_price"))


PREMIUM_FLAGS = {
    "weekend": lambda: F.col("is_weekend") == 1,
    "event_day": lambda: F.col("event_type") != "None",
    "last_minute": lambda: F.col("lead_time_days") <= 3,
    "jul_aug": lambda: F.col("month").isin(7, 8),
}


def premium_pct(df: DataFrame) -> DataFrame:
    """Price premium of each flagged group over the rest, one pass."""
    aggs = []
    for name, make in PREMIUM_FLAGS.items():
        cond = make()
        aggs += [F.avg(F.when(cond, F.col(TARGET))).alias(f"{name}__in"),
                 F.avg(F.when(~cond, F.col(TARGET))).alias(f"{name}__out")]
    row = df.agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(n).alias("flag"), F.col(f"{n}__in").alias("avg_in"),
                 F.col(f"{n}__out").alias("avg_out")) for n in PREMIUM_FLAGS]))
    out = row.select(stack.alias("p")).select("p.*")
    return out.select("flag", fin("avg_in").alias("avg_in"), fin("avg_out").alias("avg_out"),
                      fin((F.col("avg_in") / F.col("avg_out") - 1) * 100).alias("premium_pct"))


def filliben(i: Column, n: Column) -> Column:
    """Uniform order-statistic median of the ``i``-th of ``n`` sorted values (normal probability plot)."""
    last = F.pow(F.lit(0.5), 1 / n)
    return F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))


def qq_points(df: DataFrame, col: str, m: int | None = None) -> DataFrame:
    """Normal Q-Q points: the theoretical normal quantile at each Filliben
    position against the sample. By default a point for every non-null row (all order
    statistics, ranks by range); with ``m``, at ``m`` positions, from exact quantiles."""
    if m is None:
        points = order_statistics(df, F.col(col).cast("double"), "sample")
    else:
        spark = df.sparkSession
        last = 0.5 ** (1.0 / m)
        probs = [1.0 - last] + [(i - 0.3175) / (m + 0.365) for i in range(2, m)] + [last]
        points = (exact_quantiles(df, col, probs).select(F.posexplode("q").alias("i", "sample"))
                  .select((F.col("i") + 1).cast("long").alias("i"), "sample", F.lit(m).alias("n")))
    p = filliben(F.col("i"), F.col("n"))
    return points.select((F.col("i") - 1).alias("i"), fin_wide_row(p).alias("p"), fin_wide_row(normal_quantile(p)).alias("theoretical"),
                         fin_wide_row("sample").alias("sample"))


def qq_fit(df: DataFrame, col: str) -> DataFrame:
    """The least-squares line through all Q-Q points and its correlation (one row)."""
    points = order_statistics(df, F.col(col).cast("double"), "sample")
    z = points.select("sample", normal_quantile(filliben(F.col("i"), F.col("n"))).alias("z"))
    return z.agg(fin(F.regr_slope("sample", "z")).alias("slope"), fin(F.regr_intercept("sample", "z")).alias("intercept"),
                 fin(F.corr("sample", "z")).alias("r"), F.count(F.lit(1)).alias("n"))


def kde(df: DataFrame, col: str, by: str, grid: int = 200, cut: float = 3.0,
        bins: int | None = None) -> DataFrame:
    """Gaussian kernel density per group on a ``grid``-point axis
    (Scott bandwidth = sample std x n^(-1/5); axis from min - cut*h to
    max + cut*h).

    Rows are first reduced to (group, value) counts. Exact (default): each
    distinct value meets the grid inside its own task (an explode of
    ``sequence``), so only (group, grid point) partial sums are shuffled.
    ``bins=B``: the values are first counted into B
    equal-width bins per group (one pass, partial aggregation) and the kernel
    is summed over weighted bin centres, so the work after the scan is
    groups x B x grid whatever the number of rows.
    """
    import math
    st = (df.groupBy(by).agg(F.count(col).alias("n"), F.stddev_samp(col).alias("sd"),
                             F.min(col).alias("mn"), F.max(col).alias("mx"))
          .withColumn("h", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))))
    st = st.withColumns({"lo": F.col("mn") - cut * F.col("h"), "hi": F.col("mx") + cut * F.col("h")}) \
           .withColumn("step", (F.col("hi") - F.col("lo")) / (grid - 1))
    rows = value_counts(df, col, [by], "_x").withColumnRenamed("n", "_w").join(st, by)
    if bins:
        bw = (F.col("mx") - F.col("mn")) / bins
        b = F.when(bw > 0, F.least(F.floor((F.col("_x") - F.col("mn")) / bw), F.lit(bins - 1))).otherwise(F.lit(0))
        rows = (rows.groupBy(by, "n", "h", "lo", "step", "mn", "mx", b.alias("_b"))
                .agg(F.sum("_w").alias("_w"))
                .withColumn("_x", F.col("mn") + (F.col("_b") + 0.5) * (F.col("mx") - F.col("mn")) / bins))
    pts = rows.select(by, "_x", "_w", "n", "h", "lo", "step",
                      F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("gi"))
    z = (F.col("lo") + F.col("gi") * F.col("step") - F.col("_x")) / F.col("h")
    dens = (pts.groupBy(by, "gi").agg(F.sum(F.col("_w") * F.exp(-0.5 * z * z)).alias("s"), F.first("n").alias("n"),
                                      F.first("h").alias("h"), F.first("lo").alias("lo"),
                                      F.first("step").alias("step")))
    return dens.select(by, "gi", fin(F.col("lo") + F.col("gi") * F.col("step")).alias("x"),
                       fin(F.col("s") / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))
