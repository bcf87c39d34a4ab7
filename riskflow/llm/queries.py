"""One query per operator over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import bpe, centroid_clusters, exact_dedup, html_text, quality, secret_scan, simhash, source_mix
from riskflow.llm import suffix_dedup, token_alignment, toxicity, vector_search, window_dedup
from riskflow.llm.common import stored, workers_can_import


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return workers_can_import(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(m: int):
    return F.crc32(F.col("doc_id").cast("string")) % m


def _verdict(scored: DataFrame, held_out, threshold: float) -> list:
    return [
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    ]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, learn=_remainder(4) != 2)
    found = toxicity.located(docs, model)
    columns = _verdict(found, _remainder(4) == 2, toxicity.THRESHOLD)
    return found.select(*columns, F.size("offending").alias("n_offending"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op3_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.digests(_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.extracted(pages, html_text.train(pages)).drop("html")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_search.usable(_table(spark, sf_dir, "embeddings"))
    index = stored(vector_search.index(rows), "vectors")
    return vector_search.nearest(index.filter(F.col("vec_id") % 50 == 0), index, k=5)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.shares(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, learn=_remainder(5) != 0)
    found = quality.scored(docs, model)
    return found.select(*_verdict(found, _remainder(5) == 0, quality.THRESHOLD))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    left = token_alignment.byte_level(public_tokenizers.path("byte_bpe_50k.json"))
    right = token_alignment.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.digests(_table(spark, sf_dir, "documents"), left, right)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(_table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.clustered(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_toxicity,
        op2_suffix_dedup,
        op3_window_dedup,
        op4_html_text,
        op5_vector_search,
        op6_source_mix,
        op7_bpe,
        op8_exact_dedup,
        op9_simhash,
        op10_quality,
        op11_token_alignment,
        op12_secret_scan,
        op13_centroid_clusters,
    )
}

#: The others are tested against plain Python, a public library or held-out labels.
SQL = {
    "op3_window_dedup": window_dedup.QUERY_SQL,
    "op6_source_mix": source_mix.QUERY_SQL,
    "op8_exact_dedup": exact_dedup.QUERY_SQL,
    "op13_centroid_clusters": centroid_clusters.QUERY_SQL,
}
