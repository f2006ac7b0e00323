import numpy as np
from pyspark.sql import functions as F

from ratewise.llm import language_id as L
from ratewise.llm import queries
from ratewise.llm.common import read

LARGE = "/root/testdata/sf0.1"


def brute_bundle(text, dim=L.DIM):
    """Trigram vectors added up one by one."""
    total = np.zeros(dim)
    codes = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    for i, c in enumerate(codes):
        if c:
            a, d = (codes[i - 1] if i else 0), (codes[i + 1] if i + 1 < len(codes) else 0)
            va, vc, vd = L.letter_vectors(np.array([a, c, d]), dim).astype(int)
            total += np.roll(va, 2) * np.roll(vc, 1) * vd
    return total


def test_bundles_against_single_products(monkeypatch):
    texts = ["Hello, wörld", "", "a", "12 34", "日本語 です", "xx yy xx", "Ελληνικά καὶ"]
    want = np.array([brute_bundle(t) for t in texts])
    for chunk, table in ((L.CHUNK, L.TABLE), (3, L.TABLE), (7, 8)):      # long texts in chunks, many rare trigrams
        monkeypatch.setattr(L, "CHUNK", chunk)
        monkeypatch.setattr(L, "TABLE", table)
        got, lettered = L.bundles(texts, list(range(len(texts))), len(texts))
        assert np.array_equal(got, want)
        assert lettered.tolist() == [True, False, True, False, True, True, True]


def test_learning_sums_all_rows_and_predictions(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, "der hund ist im haus", "de"),
            (3, "der hund ist im haus", "de"), (4, None, "en"), (5, "12", "xx"), (6, "no label", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    sums = L.learn(df.repartition(5))
    assert set(sums) == {"en", "fr", "de", "xx"} and not sums["xx"].any()
    assert np.array_equal(sums["de"], 2 * brute_bundle(rows[2][1]))
    assert np.array_equal(sums["en"], brute_bundle(rows[0][1]))
    out = {(r.doc_id, r.lang): (r.lang_pred, r.score) for r in L.predict(df, sums).collect()}
    assert out[1, "en"][0] == "en" and out[2, "fr"][0] == "fr" and out[3, "de"][0] == "de"
    assert out[4, "en"] == out[5, "xx"] == ("und", 0.0)
    assert L.predict(df.where("false"), sums).collect() == []
    assert L.learn(df.where("false")) == {}
    assert {tuple(r) for r in L.predict(df, {}).select("lang_pred", "score").collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    docs = read(spark, LARGE, "documents").select("doc_id", "lang")
    got = queries.QUERIES["op11_language_id"](spark, LARGE).join(docs, "doc_id").where("held_out")
    r = got.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"),
                F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r.n > 1500 and r.right > 0.99 and 0 <= r.low and r.high <= 1
