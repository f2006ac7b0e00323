"""Streaming request pricing: same answers as the batch path."""

from ratewise.streaming.requests import REQUEST_SCHEMA, price_requests, start_pricing


def test_stream_prices_match_batch(spark, tmp_path):
    rows = [(1, 150.0, 0.60, 14, None, None, 0, "None", 3, None, None, None),
            (2, 150.0, 0.85, 3, 1, None, None, "None", 7, None, None, None),
            (3, 200.0, 0.95, 1, None, 1, 3, "Holiday", 12, 190.0, 0.9, 3)]
    src = tmp_path / "requests"
    spark.createDataFrame(rows, REQUEST_SCHEMA).coalesce(1).write.parquet(str(src))
    q = start_pricing(spark, str(src), str(tmp_path / "priced"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    streamed = {r.request_id: r.rule_price for r in spark.read.parquet(str(tmp_path / "priced")).collect()}
    batch = {r.request_id: r.rule_price for r in price_requests(spark.read.parquet(str(src))).collect()}
    assert streamed == batch == {1: 166.5, 2: 186.0, 3: 300.0}
