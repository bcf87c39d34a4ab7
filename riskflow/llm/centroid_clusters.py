"""Centroid clustering of integer vectors by scalar lookup tables.

Every component x becomes the integer floor(1024 x). Vectors are laid out once in blocks
of at most ``BLOCK``: per dimension the integers that occur in the block, ascending, and
for every vector the places of its components among them. A round needs no arithmetic
on vectors: per block it tabulates the squared difference of each occurring integer and
each centroid's component, and a distance is the sum of 64 gathers from that table.
All values are integers, so results do not depend on the order of summing.

Centroids 0, 1, ... start as the vectors of the least digests of their id. In a round
every task sends one row of sums per centroid; k centroids are all that the driver
holds, and they replace the former ones as floor(sum / count). Blocks are stored in the
shared folder, so a lost executor repeats only its own tasks.

Defined cases: vectors that are null, of another length, or with a null or non-finite
component take no part; components beyond ``LARGEST`` after scaling count as that, so
that distances fit 64 bits; a null id takes part and comes last among the candidates for
a start; rows that repeat an id are vectors of their own (equal digests start in the
order of their components); with fewer vectors than k there are as many centroids as
vectors; a centroid without vectors stays where it is; ties go to the smaller number;
an empty table gives an empty result; other columns are ignored. An inertia beyond 64
bits is null.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import stored, workers_can_import

SCALE = 1024
SIZE = 64
#: Vectors in a block; places in it fit 16 bits.
BLOCK = 4096
LARGEST = 1 << 27

BLOCKS = "ids array<long>, occurring array<long>, counts array<int>, places binary"


def usable(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", size: int = SIZE
) -> DataFrame:
    """(vec_id, vector) of the rows that take part; the vector as doubles."""
    finite = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vectors.select(
        vectors[id].cast("long").alias("vec_id"),
        vectors[vector].cast("array<double>").alias("vector"),
    ).filter(F.col("vector").isNotNull() & (F.size("vector") == size) & finite)


def _integers(vectors: np.ndarray) -> np.ndarray:
    # A product with a power of two is exact; beyond the range of doubles it is infinite.
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * SCALE), -LARGEST, LARGEST).astype(np.int64)


def blocks(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """Usable vectors as blocks of occurring integers and places."""
    workers_can_import(rows.sparkSession)

    def lay_out(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                columns = _integers(flat.reshape(-1, size)).T
                found = [np.unique(column, return_inverse=True) for column in columns]
                counts = np.array([len(values) for values, _ in found], np.int32)
                places = np.stack([place for _, place in found], axis=1).astype(np.uint16)
                values = np.concatenate([values for values, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        _one_list(part.column("vec_id")),
                        _one_list(pa.array(values)),
                        _one_list(pa.array(counts)),
                        pa.array([places.tobytes()], pa.binary()),
                    ],
                    names=["ids", "occurring", "counts", "places"],
                )

    return rows.mapInArrow(lay_out, BLOCKS)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _nearest(batches, centroids: np.ndarray):
    """Per block: the ids, the vectors' integers, their nearest centroid and its distance."""
    size = centroids.shape[1]
    for batch in batches:
        for row in range(batch.num_rows):
            ids, occurring, counts = (batch.column(c)[row].values for c in range(3))
            occurring, counts = occurring.to_numpy(), counts.to_numpy()
            places = np.frombuffer(batch.column(3)[row].as_py(), np.uint16).reshape(-1, size)
            places = places + (np.cumsum(counts) - counts)
            table = occurring - np.repeat(centroids, counts, axis=1)
            table *= table
            distances = np.empty((len(centroids), len(places)), np.int64)
            for number, squares in enumerate(table):
                squares.take(places).sum(axis=1, out=distances[number])
            nearest = distances.argmin(axis=0)
            distance = distances[nearest, np.arange(len(places))]
            yield ids, occurring[places], nearest, distance


def starts(rows: DataFrame, k: int, seed: str, size: int = SIZE) -> np.ndarray:
    """The integers of the k usable vectors with the least digests of seed and id."""
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(digest.asc_nulls_last(), "vector").limit(k).collect()
    return _integers(np.array([row["vector"] for row in chosen]).reshape(len(chosen), size))


def moved(laid_out: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""

    def add_up(batches):
        totals = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for _, vectors, nearest, _ in _nearest(batches, centroids):
            for number in np.unique(nearest):
                own = vectors[nearest == number]
                totals[number, 0] += len(own)
                totals[number, 1:] += own.sum(axis=0)
        numbers = pa.array(np.arange(len(totals), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([numbers, pa.array(totals.tolist())], ["cluster", "totals"])

    parts = laid_out.mapInArrow(add_up, "cluster int, totals array<long>")
    sums = (
        parts.select("cluster", F.posexplode("totals").alias("at", "total"))
        .groupBy("cluster", "at")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    )
    total = {(row["cluster"], row["at"]): int(row["total"]) for row in sums.collect()}
    result = centroids.copy()
    for number in range(len(centroids)):
        count = total.get((number, 0), 0)
        if count:
            result[number] = [total[number, 1 + d] // count for d in range(centroids.shape[1])]
    return result


def fitted(laid_out: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        centroids = moved(laid_out, centroids)
    return centroids


def assigned(laid_out: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of every vector in the blocks."""

    def assign(batches):
        for ids, _, nearest, distance in _nearest(batches, centroids):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(nearest.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cluster", "distance"],
            )

    return laid_out.mapInArrow(assign, "vec_id long, cluster int, distance long")


def clustered(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    seed: str = "3:",
    id: str = "vec_id",
    vector: str = "embedding",
    size: int = SIZE,
) -> DataFrame:
    """Each vector's cluster and squared distance, and what the clusters sum up to."""
    spark = vectors.sparkSession
    rows = usable(vectors, id, vector, size)
    first = starts(rows, k, seed, size)
    if not len(first):
        kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long"
        return spark.createDataFrame([], f"{kinds}, centroid_sha256 string")
    laid_out = stored(blocks(rows, size), "vector-blocks")
    centroids = fitted(laid_out, first, rounds)
    found = stored(assigned(laid_out, centroids), "clusters")
    exact = F.col("distance").cast("decimal(38,0)")
    sums = found.groupBy("cluster").agg(F.sum(exact).alias("_sum"))
    total = sums.agg(F.sum("_sum")).scalar()
    digests = [
        (number, sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest())
        for number, centroid in enumerate(centroids)
    ]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    summary = sums.join(named, "cluster").select(
        "cluster",
        F.col("_sum").try_cast("long").alias("cluster_inertia"),
        total.try_cast("long").alias("inertia"),
        "centroid_sha256",
    )
    # One row per centroid.
    return found.join(F.broadcast(summary), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _round_sql(n: int) -> str:
    return f"""near{n} AS MATERIALIZED (
  SELECT vec_id, cluster, distance FROM (
    SELECT l.vec_id, c.cluster, sum((l.x - c.x) * (l.x - c.x)) AS distance
    FROM parts l JOIN centroids{n} c USING (d) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"""


def _moved_sql(n: int) -> str:
    return f"""moved{n} AS MATERIALIZED (
  SELECT cluster, d, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
  FROM near{n - 1} JOIN parts USING (vec_id) GROUP BY ALL),
centroids{n} AS MATERIALIZED (SELECT * FROM moved{n} UNION ALL
  SELECT * FROM centroids{n - 1} WHERE cluster NOT IN (SELECT cluster FROM moved{n}))"""


#: The default settings in SQL, for tables in which an id occurs once.
QUERY_SQL = f"""WITH kept AS (
  SELECT vec_id, list_transform(embedding,
    lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {SIZE}
    AND len(list_filter(embedding, lambda x: isfinite(x))) = {SIZE}),
parts AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept),
chosen AS (SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster FROM kept
  QUALIFY cluster < 8),
centroids0 AS MATERIALIZED (
  SELECT cluster, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM chosen),
{", ".join(f"{_round_sql(n)}, {_moved_sql(n + 1)}" for n in range(10))},
{_round_sql(10)},
digests AS (SELECT cluster, sha256(string_agg(x, ',' ORDER BY d)) AS centroid_sha256
  FROM centroids10 GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near10 JOIN digests USING (cluster)"""
