"""The corpus pipeline: four stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet under the shared folder and rereads as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.llm import bpe, jaccard, mixing, toxicity
from ratewise.llm.common import cut_lineage, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents among ``docs`` and drops those that
    the model calls toxic. Every row is judged by its text, whatever its id; null texts
    are empty ones; without labels of both classes, or rows, nothing is learnt and
    (below a share of toxic labels of one half) nothing goes."""
    model = toxicity.learn(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("predicted") == 0).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest
    id (a null id comes last; of rows that share it, any one).

    What is a copy is decided by the texts alone: rows that share an id, or have
    none, are documents of their own. Documents without words are no copies of
    each other and all stay. An empty table stays empty; columns pass as they are.
    """
    cols = docs.columns
    # ids tell rows apart in most tables; where they don't, rows are numbered once, in a written table
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").take(1):
        docs = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))
        found = jaccard.jaccard_components(docs.select(F.col("_row").alias("doc_id"), "text"))
        found = docs.select("doc_id", "_row").join(found.select(F.col("doc_id").alias("_row"), "component_id"), "_row")
        first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("m"))
        kept = first.select(F.col("m._row").alias("_row"))
        return docs.join(cut_lineage(kept), "_row", "left_semi").select(*cols)
    found = jaccard.jaccard_components(docs)
    copies = cut_lineage(found.where(F.col("component_id") != F.col("doc_id")).select("doc_id"))
    return docs.join(copies, "doc_id", "left_anti").select(*cols)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row a copy, in training order. A
    document that the mix takes in part is kept whole. Null sources are a source;
    rows that share an id, or have none, are taken each for itself; documents
    without words have no place in a mix and go; an empty table stays empty."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of their decoded
    bytes: a row a document, also for repeated ids; null and empty texts have no
    tokens; other columns than the id and the source go."""
    import public_tokenizers
    out = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", one_of_each_group),
          ("mixing sources to target weights", mix), ("byte-level BPE", encode)]
# A learnt model and connected components are not for SQL: tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
