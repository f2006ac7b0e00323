"""Structured Streaming: price a stream of pricing requests.

Every recommender step (P1 completion, P3 rule price, P4 factors, P5
context) is a per-row projection, so the same functions apply unchanged to
a streaming DataFrame; the query keeps no state and needs no watermark.
The sink writes Parquet with a checkpoint in the shared folder, so a
restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ratewise.operators.recommend import complete_requests, price_context, pricing_factors, rule_price

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("base_price", T.DoubleType()),
    T.StructField("occupancy_rate", T.DoubleType()),
    T.StructField("lead_time_days", T.IntegerType()),
    T.StructField("is_weekend", T.IntegerType()),
    T.StructField("is_holiday", T.IntegerType()),
    T.StructField("event_magnitude", T.IntegerType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("competitor_avg_price", T.DoubleType()),
    T.StructField("demand_score", T.DoubleType()),
    T.StructField("length_of_stay", T.IntegerType()),
])


def price_requests(requests: DataFrame) -> DataFrame:
    """Batch or streaming: completed request + rule price + factors + context."""
    done = complete_requests(requests)
    priced = rule_price(done)
    if "event_type" not in priced.columns:
        from pyspark.sql import functions as F
        priced = priced.withColumn("event_type", F.lit("event"))
    return price_context(pricing_factors(priced), "rule_price")


def request_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 100) -> DataFrame:
    return (spark.readStream.schema(REQUEST_SCHEMA)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))


def start_pricing(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                  available_now: bool = True):
    """Start the streaming pricing query (Parquet sink, exactly-once via the checkpoint)."""
    priced = price_requests(request_stream(spark, source_dir))
    writer = (priced.writeStream.format("parquet").option("path", out_dir)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
