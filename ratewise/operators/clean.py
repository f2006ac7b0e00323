"""Cleaning (C4-C14).

Fitted steps (median/mode imputation, IQR fences) follow the MLlib
estimator pattern: one aggregation pass computes the statistics as a
single row, the row is read on the driver (one value per column, a fixed
size), and the transform is a projection with those values as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.functions.columns import c as col_of, clip, fin, rnd
from ratewise.operators.profile import numeric_columns
from ratewise.operators.quantiles import column_quantiles

# --- fixed values --------------------------------------------------------
INT_COLS = ["year", "month", "day_of_week", "week_of_year", "day_of_year",
            "is_weekend", "is_holiday", "lead_time_days", "length_of_stay",
            "event_magnitude", "weather_score", "repeat_guest", "cancellation", "is_test"]
FLOAT_COLS = ["base_price", "occupancy_rate", "demand_score", "actual_price",
              "revenue_per_night", "revpar", "reviews_score"]
PRICE_COLS = ["actual_price", "base_price", "competitor_price_1", "competitor_price_2",
              "competitor_price_3", "revenue_per_night"]
# -------------------------------------------------------------------------

HASH_BITS = 60
MOST_BITS = 2 ** 24         # 2 MB, sent to every task of a dedupe


def row_hash(keys: Sequence[str | Column], seed: int = 0) -> Column:
    """Portable hash of key columns, in [0, 2^60).

    The first 60 bits of the md5 of the seed and the keys, so the draws of two
    seeds are unrelated, any engine gives the same value, and so does every
    partitioning and every retry. A null key counts as empty.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col_of(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sample_n(df: DataFrame, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """Exact-size reproducible sample of min(n, N) rows.

    Ordered by a hash of the row key and cut at ``n``: Spark plans this as a
    top-k (``TakeOrderedAndProject``) -- each task keeps its best ``n``
    candidates, no full sort, no shuffle of the rows.
    """
    return df.orderBy(row_hash(keys, seed), *keys).limit(n)


def impute_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls of numeric columns with the column's exact median."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df
    # cheap pass first (null counts), exact medians only where there are nulls
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    todo = [c for c in cols if nulls[c]]
    if not todo:
        return df
    med = column_quantiles(df, todo, [0.5])
    fills = {c: F.coalesce(F.col(c), F.lit(med[c][0])) for c in todo if med[c][0] is not None}
    return df.withColumns(fills) if fills else df


def impute_mode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls of string columns with the most frequent value (smallest on ties)."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    cols = list(cols)
    if not cols:
        return df
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    todo = [c for c in cols if nulls[c]]
    if not todo:
        return df
    # counts per value first, so that no task holds a column's values
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in todo]))
                        .alias("s")).select("s.*").where(F.col("value").isNotNull())
    counts = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("column").agg(F.max("n").alias("most"))
    modes = {r["column"]: r["value"] for r in counts.join(top, "column").where(F.col("n") == F.col("most"))
             .groupBy("column").agg(F.min("value").alias("value")).collect()}
    fills = {c: F.coalesce(F.col(c), F.lit(modes[c])) for c in todo if c in modes}
    return df.withColumns(fills) if fills else df


def dedupe(df: DataFrame, exclude: Sequence[str] = ("booking_id",)) -> DataFrame:
    """Drop rows repeating an earlier row on every column but ``exclude``.

    Equal rows have equal hashes: 8 bytes a row are shuffled to find the hashes that occur
    twice or more. They set bits in a bit set of at most ``MOST_BITS`` bits, however many they are; only rows
    whose bit is set meet them in a join, and only those whose hash repeats are compared as wholes.
    The others pass without a shuffle. ``df`` is read
    three times, so it should be a written table.
    """
    from ratewise.session import cut_lineage
    subset = [c for c in df.columns if c not in set(exclude)]
    if not subset:
        return df.dropDuplicates(subset)
    # -0.0 and 0.0 are one value in a comparison
    parts = [F.col(f"`{c}`") + F.lit(0.0) if t in ("double", "float") else F.col(f"`{c}`")
             for c, t in df.dtypes if c in subset]
    h = F.xxhash64(*parts)
    again = cut_lineage(df.groupBy(h.alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_h"))
    bits = min(MOST_BITS, max(64, 1 << (16 * again.count()).bit_length()))
    found = (again.groupBy(F.shiftright(F.pmod("_h", F.lit(bits)), 6).alias("id"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(_h, {bits}) % 64 as int))")).alias("w")))
    in_order = F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w"))))
    table = cut_lineage(df.sparkSession.range(bits // 64).join(found, "id", "left")
                        .agg(F.transform(in_order, lambda x: x["w"]).alias("_bits")))       # one row
    marked = df.withColumn("_h", h).crossJoin(F.broadcast(table))
    hit = F.expr(f"(shiftright(_bits[cast(shiftright(pmod(_h, {bits}), 6) as int)], cast(pmod(_h, {bits}) % 64 as int)) & 1) = 1")
    likely = cut_lineage(marked.where(hit).drop("_bits"))
    once = marked.where(~hit).drop("_bits").unionByName(likely.join(again, "_h", "left_anti"))
    rest = likely.join(again, "_h", "left_semi").drop("_h").dropDuplicates(subset)
    return once.drop("_h").unionByName(rest)


def enforce_types(df: DataFrame) -> DataFrame:
    """Integer columns cast (truncating), float columns rounded to 4 places."""
    ints = {c: F.col(c).cast("int") for c in INT_COLS if c in df.columns}
    floats = {c: rnd(F.col(c).cast("double"), 4) for c in FLOAT_COLS if c in df.columns}
    return df.withColumns({**ints, **floats})


def iqr_fences(df: DataFrame, cols: Sequence[str], k: float = 3.0) -> dict[str, tuple]:
    """Exact Q1/Q3 of every column in one pass; returns {col: (q1, q3, lo, hi)}."""
    quartiles = column_quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c in cols:
        q1, q3 = quartiles[c]
        if q1 is None:
            out[c] = (None, None, None, None)
            continue
        iqr = q3 - q1
        out[c] = (q1, q3, q1 - k * iqr, q3 + k * iqr)
    return out


def winsorize_iqr(df: DataFrame, cols: Sequence[str] = PRICE_COLS, k: float = 3.0,
                  fences: dict | None = None) -> DataFrame:
    """C11: cap each column to [Q1 - k*IQR, Q3 + k*IQR]; nulls stay null."""
    cols = [c for c in cols if c in df.columns]
    fences = fences or iqr_fences(df, cols, k)
    return df.withColumns({c: clip(c, fences[c][2], fences[c][3]) for c in cols if fences[c][0] is not None})


def winsorize_report(df: DataFrame, cols: Sequence[str] = PRICE_COLS, k: float = 3.0,
                     fences: dict | None = None) -> DataFrame:
    """C11 report: fences and the number of values each column had capped."""
    cols = [c for c in cols if c in df.columns]
    fences = fences or iqr_fences(df, cols, k)
    counts = df.agg(*[F.count_if((F.col(c) < fences[c][2]) | (F.col(c) > fences[c][3])).alias(c)
                      for c in cols])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(float(fences[c][0])).alias("q1"),
                 F.lit(float(fences[c][1])).alias("q3"), F.lit(float(fences[c][2])).alias("lower"),
                 F.lit(float(fences[c][3])).alias("upper"), F.col(c).alias("n_capped"))
        for c in cols]))
    out = counts.select(rows.alias("r")).select("r.*")
    return out.select("column", *[fin(x).alias(x) for x in ("q1", "q3", "lower", "upper")], "n_capped")


def zscore_outliers(df: DataFrame, col: str = "occupancy_rate", z: float = 4.0) -> DataFrame:
    """Count of |z| > ``z`` with population std (reported, not removed).

    The mean/std row is one row, broadcast to every task.
    """
    st = df.agg(F.avg(col).alias("mu"), F.stddev_pop(col).alias("sd"))
    x = F.col(col)
    return (df.select(col).crossJoin(F.broadcast(st))
            .agg(F.count_if(x.isNotNull() & (F.abs((x - F.col("mu")) / F.col("sd")) > z))
                 .cast("long").alias("n_outliers"),
                 F.count(x).alias("n")))


def partition(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """C14: rows where ``predicate`` holds, and the rest (null counts as not holding)."""
    holds = F.coalesce(predicate, F.lit(False))
    return df.filter(holds), df.filter(~holds)


def clean(df: DataFrame) -> DataFrame:
    """Steps C7 -> C8 -> C9 -> C10 -> C11 in the reference's order.

    The input is written once first (the null, median and mode passes scan
    it), and once more after the dedupe (the fence pass and the output scan
    it), so no pass re-derives the joins or repeats the shuffle.
    """
    from ratewise.session import cut_lineage
    out = impute_median(cut_lineage(df))
    out = impute_mode(out)
    # written once more after the dedupe shuffle: the fence pass and the
    # final projection both read it
    out = cut_lineage(enforce_types(dedupe(out)))
    return winsorize_iqr(out)
