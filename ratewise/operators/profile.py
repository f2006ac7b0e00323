"""Profiling (Q1-Q8): one aggregation pass per profile, results as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.functions.columns import fin


def shape(df: DataFrame) -> DataFrame:
    """Q1: row and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def dtype_counts(df: DataFrame) -> DataFrame:
    """Q2: column count per type (from the schema; no data is read)."""
    counts: dict[str, int] = {}
    for _, t in df.dtypes:
        counts[t] = counts.get(t, 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "dtype string, n_cols int")


def missing_profile(df: DataFrame) -> DataFrame:
    """Q3: null count and % per column, non-zero ones only, in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = row.unpivot(["__n"], df.columns, "column", "n_missing")
    return (long.filter(F.col("n_missing") > 0)
            .select("column", "n_missing",
                    fin(F.col("n_missing") / F.col("__n") * 100, 4).alias("pct_missing"))
            .orderBy(F.col("n_missing").desc(), "column"))


def duplicate_count(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Q4: rows that repeat an earlier row (on all columns but ``exclude``).

    Grouping on the full row with partial aggregation: each distinct row
    becomes one group, the count per group is reduced map-side.
    """
    cols = [c for c in df.columns if c not in set(exclude)]
    per_row = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("k"))
    return per_row.agg(F.sum(F.col("k") - 1).cast("long").alias("n_duplicates"))


def numeric_columns(df: DataFrame) -> list[str]:
    num = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num)]


def describe(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Q5 + Q6: count, mean, sample std, min, quartiles, max and cv% per column.

    One aggregation over the rows computes every statistic of every column;
    the one-row result is then stacked into one row per column. ``exact``
    quartiles come from sorted value counts; ``exact=False`` takes sketches.
    """
    from ratewise.operators.quantiles import column_quantiles
    aggs = []
    quartiles = column_quantiles(df, cols, [0.25, 0.5, 0.75]) if exact else {}
    for c in cols:
        x = F.col(c).cast("double")
        q = (F.array(*[F.lit(v).cast("double") for v in quartiles[c]]) if exact
             else F.percentile_approx(x, [0.25, 0.5, 0.75], 10000))
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 q.alias(f"{c}__q"), F.max(x).alias(f"{c}__max")]
    row = df.agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"),
                 F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                 F.col(f"{c}__min").alias("min"), F.col(f"{c}__q")[0].alias("p25"),
                 F.col(f"{c}__q")[1].alias("p50"), F.col(f"{c}__q")[2].alias("p75"),
                 F.col(f"{c}__max").alias("max")) for c in cols]))
    out = row.select(stack.alias("s")).select("s.*")
    return out.select(
        "column", "count", *[fin(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")],
        fin(F.when(F.col("mean") != 0, F.col("std") / F.col("mean") * 100)).alias("cv_pct"))


def cardinality(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Q7: distinct values per column (HyperLogLog++ when ``exact=False``)."""
    fn = F.count_distinct if exact else F.approx_count_distinct
    row = df.agg(*[fn(c).alias(c) for c in cols])
    return row.unpivot([], list(cols), "column", "n_distinct")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Q8: frequency per value, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), col)
