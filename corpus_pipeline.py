"""Documents to token ids, in stages that each read what the one before kept.

Each stage takes (spark, docs, sf_dir) and calls one operator of ``riskflow.llm`` on all
of ``docs``; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import bpe, exact_dedup, quality, simhash, source_mix
from riskflow.llm.common import free_name, stored, workers_can_import


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels' documents."""
    whole = workers_can_import(spark).read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(whole, labels, learn=F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    score = free_name(docs, "_score")
    scored = quality.scored(docs, model, name=score)
    return scored.filter(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by near fingerprints, the document with the smallest id stays."""
    return simhash.drop_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a document is there as often as it is taken."""
    return source_mix.write_order(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids of the tokens, their number, and whether they decode to the text."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", "source", "text", F.sha2(text, 256).alias("text_sha256"))
    # Encoded and decoded by the same worker, to which the text goes once.
    both = bpe.encoded(rows, ranks, public_tokenizers.PATTERN, data="decoded", keep_text=False)
    return both.select(
        "doc_id",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"),
    )


STAGES = [
    ("quality", accepted),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mix", mixed),
    ("bpe", encoded),
]

#: No SQL trains the classifier or replays merges; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written before the next one reads it."""
    docs = workers_can_import(spark).read.parquet(f"{sf_dir}/documents.parquet")
    *stages, (_, last) = STAGES
    for name, stage in stages:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
