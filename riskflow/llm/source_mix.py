"""Mixing sources to target weights by weighted fair queueing, DataFrames only.

A document's size is its number of words. Every source gets a target: its share
by weight of all sizes, but no more than ``max_repeats`` times what it has; what
is above goes to the others by weight until none is above. Inside a source the
documents are shuffled by a hash of their id, pass after pass, and each copy gets
the virtual time at which a fair queue would finish it: the words its source has
sent up to then, divided by the source's target. Sorted by that time, the copies
are taken until the total budget is reached.

No running sum is taken over a whole source or over all copies. Hashes are cut
into slices, and virtual time into intervals, of some ``SLICE`` documents each;
the sums before a slice come from one row per slice, added up in blocks of ``BLOCK``
and then inside each. Slices and intervals follow the number of documents, so a
source with a third of all rows has many.

Defined cases: a null text has size 0, and a document of size 0 is never taken;
null is a source of its own, the last; a null id sorts first; rows that repeat
an id are queued one after the other; an empty table gives an empty result; the
inputs' other columns pass through ``write_order`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from riskflow.llm.common import WORD, stored, text_of

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Documents in a slice, over all sources, about. A source's slice is smaller.
SLICE = 256
#: Slices or intervals that one task adds up one after the other, at most.
BLOCK = 4096


def _rows(docs: DataFrame, text: str, source: str, id: str) -> DataFrame:
    """id, source, size and shuffle key of every document, and the document itself."""
    return docs.select(
        docs[id].alias("_id"),
        docs[source].cast("string").alias("_source"),
        F.regexp_count(text_of(docs, text), F.lit(WORD)).cast("long").alias("_size"),
        # Never null, so that joins and windows on it share a shuffle.
        F.coalesce(F.concat(F.lit("="), docs[source].cast("string")), F.lit("")).alias("_lane"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(docs[id].cast("string"), F.lit("")))).alias("_key"),
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source_size, weight, target. ``sizes``: _lane, _source, source_size.

    Sources are filled in the order in which they reach their limit: a source is
    at its limit if an equal rate for all that are left would pass it.
    """
    everywhere = Window.partitionBy()
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    limited = (
        sizes.withColumn("_turn", (F.row_number().over(by_name) - 1) % len(weights))
        .withColumn("weight", cycle[F.col("_turn")])
        .withColumn("_limit", F.col("source_size") * float(max_repeats))
    )
    filled = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("_source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)

    def left(total: Column, used: str) -> Column:
        return total - F.coalesce(F.sum(used).over(before), F.lit(0.0))

    rated = limited.withColumn(
        "_rate",
        left(F.sum("source_size").over(everywhere), "_limit")
        / left(F.sum("weight").over(everywhere), "weight"),
    ).withColumn("_full", F.col("_rate") * F.col("weight") >= F.col("_limit"))
    rate = F.min(F.when(~F.col("_full"), F.struct(F.col("_limit") / F.col("weight"), "_rate")))
    return rated.withColumn("_common", rate.over(everywhere)["_rate"]).select(
        "_lane",
        "_source",
        "source_size",
        "weight",
        F.when(F.col("_full"), F.col("_limit"))
        .otherwise(F.col("_common") * F.col("weight"))
        .alias("target"),
    )


def _slice(slices: int) -> Column:
    """A slice of the hash's range; slices follow the order of the keys."""
    place = F.conv(F.substring("_key", 1, 12), 16, 10).cast("double") / float(2**48)
    return F.floor(place * slices)


def _sent(rows: DataFrame, slices: int, before: DataFrame) -> DataFrame:
    """Adds _sent, the words of the source up to and with this document in shuffled
    order, and the source's size and target. Window and join share one shuffle."""
    inside = (
        Window.partitionBy("_lane", "_slice")
        .orderBy("_key", F.col("_id").asc_nulls_first(), "_size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_slice", _slice(slices))
        .withColumn("_sum", F.sum("_size").over(inside))
        .join(before, ["_lane", "_slice"])
        .withColumn("_sent", F.col("_sum") + F.col("_before"))
        .drop("_sum", "_before")
    )


def _copies(sent: DataFrame, max_repeats: int) -> DataFrame:
    """One row per document and pass, with the virtual time at which it is finished."""
    return (
        sent.filter(F.col("_size") > 0)
        .withColumn("_pass", F.explode(F.array(*[F.lit(i) for i in range(max_repeats)])))
        .withColumn("_finish", _finish(F.col("_pass")))
    )


def _finish(passes: Column) -> Column:
    # A source without words has target 0; its documents are never served.
    sent = (F.col("_sent") + passes * F.col("source_size")).cast("double")
    return F.try_divide(sent, F.col("target"))


def _mark(finish: Column, passes: Column) -> Column:
    """What the queue is ordered by; null sources last, null ids first, as in ``_sent``."""
    return F.struct(
        finish.alias("f"),
        F.col("_source").isNull().alias("n"),
        F.col("_source").alias("s"),
        F.col("_key").alias("k"),
        F.col("_sent").alias("c"),
        passes.alias("p"),
    )


def _edge(totals: DataFrame, place: str, paid: int, budget: int) -> Row | None:
    """Where the budget ends in ``totals`` (place, _total), or the last place: that place,
    what is paid before it, and the place before it with what is paid before that."""
    order = Window.orderBy(place)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.struct(
        F.col(place).alias("place"),
        (F.col("_to") - F.col("_total")).alias("paid"),
        F.coalesce("_previous", place).alias("from"),
        (F.col("_to") - F.col("_total") - F.coalesce("_less", F.lit(0))).alias("paid_from"),
    )
    return (
        totals.withColumn("_to", F.sum("_total").over(running) + paid)
        .withColumns({"_previous": F.lag(place).over(order), "_less": F.lag("_total").over(order)})
        .agg(F.coalesce(F.min(F.when(F.col("_to") > budget, found)), F.max(found)).alias("edge"))
        .first()["edge"]
    )


def _last(sent: DataFrame, budget: int, intervals: int, max_repeats: int) -> Column | None:
    """The mark of the last copy that is taken, as a constant; none if no copy is.

    The sums of intervals are added up in blocks of ``BLOCK``, and one by one only in the
    block in which the budget ends and the one before it.
    """
    copies = _copies(sent, max_repeats).withColumn(
        "_interval", F.floor(F.col("_finish") * intervals).cast("long")
    )
    totals = stored(copies.groupBy("_interval").agg(F.sum("_size").alias("_total")), "intervals")
    blocks = totals.groupBy(F.floor(F.col("_interval") / BLOCK).alias("_block")).agg(
        F.sum("_total").alias("_total")
    )
    block = _edge(blocks, "_block", 0, budget)
    if block is None:
        return None
    near = totals.filter(
        (F.col("_interval") >= block["from"] * BLOCK)
        & (F.col("_interval") < (block["place"] + 1) * BLOCK)
    )
    edge = _edge(near, "_interval", block["paid_from"], budget)
    order = Window.partitionBy("_interval").orderBy(_mark(F.col("_finish"), F.col("_pass")))
    inside = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = (
        copies.filter(F.col("_interval").between(edge["from"], edge["place"]))
        .withColumn("_in", F.sum("_size").over(inside))
        .filter((F.col("_interval") < edge["place"]) | (edge["paid"] + F.col("_in") <= budget))
        .agg(F.max(_mark(F.col("_finish"), F.col("_pass"))).alias("mark"))
        .first()["mark"]
    )
    if mark is None:
        return None
    kinds = {"f": "double", "n": "boolean", "s": "string", "k": "string", "c": "long", "p": "int"}
    return F.struct(*[F.lit(mark[c]).cast(kind).alias(c) for c, kind in kinds.items()])


def _summed_before(per_slice: DataFrame) -> DataFrame:
    """(_lane, _slice, _before): the words of the lane in the slices before each.

    In two levels, so that no task adds up more than ``BLOCK`` slices, or the lane's
    blocks of so many.
    """
    slices = per_slice.withColumn("_block", F.floor(F.col("_slice") / BLOCK))

    def before(place: str, *of: str) -> Column:
        order = Window.partitionBy(*of).orderBy(place)
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_size").over(earlier), F.lit(0))

    blocks = slices.groupBy("_lane", "_block").agg(F.sum("_size").alias("_size"))
    blocks = blocks.select("_lane", "_block", before("_block", "_lane").alias("_blocks"))
    inside = slices.withColumn("_inside", before("_slice", "_lane", "_block"))
    return inside.join(blocks, ["_lane", "_block"]).select(
        "_lane", "_slice", (F.col("_inside") + F.col("_blocks")).alias("_before")
    )


def _mixed(rows, small, weights, max_repeats) -> DataFrame:
    """``rows`` with source_size, target, and _times: the passes in which each is taken."""
    facts = small.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    slices = max(1, facts[0] // SLICE)
    per_slice = small.groupBy("_lane", _slice(slices).alias("_slice")).agg(
        F.sum("_size").alias("_size")
    )
    sizes = small.groupBy("_lane", "_source").agg(F.sum("_size").alias("source_size"))
    before = _summed_before(per_slice).join(targets(sizes, weights, max_repeats).drop("_source", "weight"), "_lane")
    last = _last(_sent(small, slices, before), facts[1], slices, max_repeats)
    finished = F.array(*[_mark(_finish(F.lit(i)), F.lit(i)) for i in range(max_repeats)])
    served = F.lit(False) if last is None else F.col("_size") > 0
    return _sent(rows, slices, before).withColumn(
        "_times", F.filter(finished, lambda m: served if last is None else served & (m <= last))
    )


def shares(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    id: str = "doc_id",
    weights=WEIGHTS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words)."""
    small = stored(_rows(docs, text, source, id).drop("_row"), "sizes")
    return _mixed(small, small, weights, max_repeats).select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.size("_times") * F.col("_size")).alias("taken"),
    )


def write_order(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    id: str = "doc_id",
    weights=WEIGHTS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """The mix itself: the documents' own columns, repeats included, in queue order."""
    rows = _rows(docs, text, source, id)
    small = stored(rows.drop("_row"), "sizes")
    taken = _mixed(rows, small, weights, max_repeats).select("_row", F.explode("_times").alias("_m"))
    order = [F.col(f"_m.{c}") for c in "fnskcp"]
    return taken.repartitionByRange(*order).sortWithinPartitions(*order).select("_row.*")


QUERY_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || doc_id) AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM sized GROUP BY source
), rated AS (
  SELECT *, source_size * 3.0::DOUBLE AS most,
    (sum(source_size) OVER () - coalesce(sum(source_size * 3.0::DOUBLE) OVER earlier, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS rate
  FROM sources
  WINDOW earlier AS (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, CASE WHEN rate * weight >= most THEN most
    ELSE weight * (SELECT arg_min(rate, most / weight) FROM rated WHERE rate * weight < most) END AS target
  FROM rated
), sent AS (
  SELECT s.*, source_size, target,
    CAST(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sent
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, CAST(sent + pass * source_size AS DOUBLE) / target AS finish
  FROM sent, (VALUES (0), (1), (2)) AS p(pass) WHERE size > 0
), queue AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, sent, pass ROWS UNBOUNDED PRECEDING) AS paid
  FROM copies
), taken AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM queue
  WHERE paid <= (SELECT sum(size) FROM sized) GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM sent LEFT JOIN taken USING (doc_id)
"""
