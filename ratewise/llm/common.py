"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.session import cut_lineage, ship_package
from ratewise.sources.tables import table_path

__all__ = ["cut_lineage", "ship_package", "read", "empty", "ordered"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def empty(df: DataFrame) -> bool:
    return not df.take(1)


def ordered(df: DataFrame, by: list, sums: dict[str, str]) -> DataFrame:
    """``df`` with its global 0-based ``position`` under the order ``by`` and,
    for each ``name: column`` in ``sums``, the sum of the column over all
    earlier rows. Ranges of the order are numbered in parallel; only one row a
    range meets in a single task. Cuts lineage, so the ranges are drawn once.
    """
    from pyspark.sql import Window
    part = cut_lineage(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    totals = part.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"),
                                        *[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = totals.select("_range", F.coalesce(F.sum("_n").over(before), zero).alias("_n0"),
                            *[F.coalesce(F.sum(f"_t_{k}").over(before), zero).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*by)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    cols = [c for c in part.columns if c != "_range"]
    return (part.withColumn("_i", F.row_number().over(inside) - 1)
            .withColumns({f"_s_{k}": F.coalesce(F.sum(c).over(upto), zero) for k, c in sums.items()} or {"_z": zero})
            .join(offsets, "_range")
            .select(*cols, (F.col("_n0") + F.col("_i")).alias("position"),
                    *[(F.col(f"_b_{k}") + F.col(f"_s_{k}")).alias(k) for k in sums]))
