"""The pipeline on a small corpus, against the brute-force versions of its stages."""
import os
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from ratewise.llm import toxicity
from ratewise.llm.mixing import plan
from tests.llm.helpers import jaccard_rows
from tests.llm.test_bpe import digests, codec  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, tmp_path, codec):  # noqa: F811
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = [(90_000, None, None, None, None), (90_001, "", "en", "src1", 0), (90_001, "", "en", "src1", 0),
           (90_002, "one two", "en", None, 7), (90_003, "ONE two", "en", "src1", 7), (None, "one two", "en", "src1", 7)]
    folder = write(spark, tmp_path, [tuple(r) for r in docs.select(*COLUMNS).collect()] + odd, [tuple(r) for r in labels.collect()])
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder).cache()
        seen.append((now, out))
        now = out
    (d0, d1), (_, d2), (_, d3), (_, d4) = seen
    assert d1.columns == d2.columns == d3.columns == COLUMNS
    model = toxicity.learn(d0, spark.read.parquet(f"{folder}/labels.parquet"))
    assert Counter(d1.collect()) == Counter(toxicity.score(d0, model).where("predicted = 0").select(*COLUMNS).collect())
    # one of each group: brute force over the rows, numbered in order of their ids
    rows = sorted(d1.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, str(r)))
    least = {i for i, _, c in jaccard_rows([(i, r.text) for i, r in enumerate(rows)]) if i == c}
    assert Counter(d2.collect()) == Counter(r for i, r in enumerate(rows) if i in least)
    # the mix: as many copies of each row as its plan says
    copies = Counter()
    for r in plan(d2).collect():
        copies[tuple(r[c] for c in COLUMNS)] += len(r["copies"])
    assert Counter(tuple(r) for r in d3.collect()) == +copies
    want = Counter((r.doc_id, r.source, *digests(codec, r.text)) for r in d3.collect())
    assert Counter(tuple(r) for r in d4.collect()) == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == want


def test_rows_that_share_an_id_are_no_copies(spark):
    long, other = "a long clean text of seven words", "quite another clean text of seven words"
    rows = [(7, None, "en", "s", 0), (7, long, "en", "s", 0), (8, long, "en", "s", 0), (8, other, "en", "s", 0), (None, other, "en", "s", 0),
            (None, "a third text", "en", "s", 0)]
    out = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert Counter(tuple(r) for r in out.collect()) == Counter([rows[0], rows[1], rows[3], rows[5]])


def test_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
