"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

Equal texts have equal SHA-256 digests. A Misra-Gries pass names every digest
that more than ``SUPPORT`` of the rows share; their winners are verified by an
exact aggregate, which combines before it shuffles, and are broadcast, so that
their copies are decided (or dropped) where they are read. At most 1/SUPPORT
digests can be frequent, which bounds the broadcast whatever the data. The other
digests go through an ordinary shuffle, where no group is larger than SUPPORT
of the rows.

Defined cases: a null text is an empty text; a null id sorts below every id;
rows that repeat an id and a text are copies of each other, of which one stays;
an empty table gives an empty result; other columns pass through ``drop_copies``
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import stored, text_of

#: A digest on more than this share of the rows is a heavy hitter.
SUPPORT = 1 / 256


def _winners(digests: DataFrame) -> DataFrame:
    """(h_digest, h_keep, h_size) of the frequent digests: at most 1/SUPPORT rows."""
    frequent = digests.freqItems(["_digest"], SUPPORT).select(
        F.explode("_digest_freqItems").alias("_digest")
    )
    return (
        digests.join(F.broadcast(frequent), "_digest", "left_semi")
        .groupBy("_digest")
        .agg(F.max("_id").alias("h_keep"), F.count(F.lit(1)).alias("h_size"))
        .withColumnRenamed("_digest", "h_digest")
    )


def _with_winners(rows: DataFrame, winners: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(winners), rows["_digest"] == winners["h_digest"], "left")


def classes(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = stored(
        docs.select(docs[id].alias("_id"), F.unhex(F.sha2(text_of(docs, text), 256)).alias("_digest")),
        "digests",
    )
    rows = _with_winners(digests, stored(_winners(digests), "frequent"))
    lost = F.col("h_keep").isNotNull() & ~F.col("_id").eqNullSafe(F.col("h_keep"))
    decided = rows.filter(lost).select(
        "_id",
        "_digest",
        F.col("h_keep").alias("keep_id"),
        F.col("h_size").alias("group_size"),
        F.lit(False).alias("kept"),
    )
    group = Window.partitionBy("_digest")
    order = group.orderBy(F.col("_id").desc_nulls_last())
    rest = rows.filter(~lost).select(
        "_id",
        "_digest",
        F.max("_id").over(group).alias("keep_id"),
        F.coalesce("h_size", F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"),
    )
    return rest.unionByName(decided).select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns: the largest id of equal texts."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    rows = docs.select(
        docs[id].alias("_id"), F.unhex(F.sha2(text_of(docs, text), 256)).alias("_digest"), row
    )
    winners = stored(_winners(rows.select("_id", "_digest")), "frequent")
    alive = _with_winners(rows, winners).filter(
        F.col("h_keep").isNull() | F.col("_id").eqNullSafe(F.col("h_keep"))
    )
    order = Window.partitionBy("_digest").orderBy(F.col("_id").desc_nulls_last())
    return (
        alive.withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") == 1)
        .select("_row.*")
    )


QUERY_SQL = """
SELECT doc_id,
  max(doc_id) OVER same AS keep_id,
  count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
