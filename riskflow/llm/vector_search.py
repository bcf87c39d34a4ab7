"""Nearest neighbours by cosine through randomly rotated one-bit codes.

Every vector is scaled to length one, rotated by a random orthogonal matrix and
kept as the signs of its coordinates, packed into words, with one correction: the
inner product of the vector with the unit vector its signs stand for. A query is
rotated too and cut into ``PLANES`` bit planes, so that its inner product with a code
is a weighted sum of counts of common bits; divided by the correction it estimates
the cosine without bias. The error is of the order of 1/sqrt(dimension); candidates
whose estimate plus ``SIGMAS`` times that reaches the k-th best cosine found so far
are measured exactly, on the original vectors in double precision.

Vectors are dealt into blocks by a hash of their id, queries into groups, and each
pair of block and group is one task, which passes on k candidates per query. All
rows are indexed and every block is searched; the only approximation is the error
bound, which a neighbour misses with a chance of about one in a thousand.

Defined cases: null ids, null or zero vectors and vectors with null or non-finite
components take no part; a query's candidates are the vectors with as many components
as it has, as a cosine needs; rows that repeat an id count once, with the least of
their vectors; ties go to the smaller id; with fewer than k candidates all are
returned; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import workers_can_import

SIGMAS = 3.0
PLANES = 5
BLOCK = 16_384
GROUP = 2_048
#: Estimates held at once in a task.
_AT_ONCE = 1 << 18
_SEED = 20_240

INDEX = "vec_id long, vector array<double>, code binary, factor double"


def _rotation(dimension: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    normal = np.random.default_rng(_SEED).standard_normal((dimension, dimension))
    q, r = np.linalg.qr(normal)
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    width = -(-bits.shape[1] // 64) * 64
    wide = np.zeros((len(bits), width), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    finite = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    rows = (
        vectors.select(vectors[id].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("vector"))
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .filter(finite & F.exists("vector", lambda x: x != 0))
    )
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _of_one_length(batches):
    """The rows of each batch in parts whose vectors have the same number of components."""
    for batch in batches:
        lengths = batch.column("vector").value_lengths().to_numpy()
        for length in np.unique(lengths):
            same = np.flatnonzero(lengths == length)
            yield batch if len(same) == batch.num_rows else batch.take(pa.array(same))


def index(rows: DataFrame) -> DataFrame:
    """Codes and corrections of usable vectors, with the vectors themselves."""
    workers_can_import(rows.sparkSession)

    def encode(batches):
        for batch in _of_one_length(batches):
            v = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            v = v.reshape(batch.num_rows, -1)
            # Scaled first, so that neither tiny nor huge components leave the range.
            unit = v / np.abs(v).max(axis=1, keepdims=True)
            unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            turned = unit @ _rotation(v.shape[1])
            factor = np.abs(turned).sum(axis=1) / np.sqrt(v.shape[1])
            codes = _packed(turned > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("vector"),
                    pa.array([code.tobytes() for code in codes], pa.binary()),
                    pa.array(factor),
                ],
                names=["vec_id", "vector", "code", "factor"],
            )

    return rows.mapInArrow(encode, INDEX)


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _length(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=-1))


def _best(queries: pa.Table, block: pa.Table, k: int):
    """For each query its k nearest of a block: (query row, block rows, cosines)."""
    ids, mine = block.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
    vectors, asked = _matrix(block, "vector"), _matrix(queries, "vector")
    dimension = vectors.shape[1]
    factor = block.column("factor").to_numpy()
    codes = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint64)
    codes = codes.reshape(len(ids), -1)
    slack = SIGMAS * np.sqrt(np.maximum(1 - factor**2, 0) / max(dimension - 1, 1)) / factor
    slack = slack.astype(np.float32) + np.float32(1e-5)

    scaled = asked / np.abs(asked).max(axis=1, keepdims=True)
    turned = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)) @ _rotation(dimension)
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum(turned.max(axis=1, keepdims=True) - low, 1e-12) / (2**PLANES - 1)
    level = np.rint((turned - low) / step).astype(np.int64)
    planes = [_packed((level >> b) & 1 == 1) for b in range(PLANES)]
    ones = np.bitwise_count(codes).sum(axis=1).astype(np.float32)
    scale = (1 / (np.sqrt(dimension) * factor)).astype(np.float32)

    length = _length(vectors)

    def cosines(row, places):
        products = (vectors[places] * asked[row]).sum(axis=1)
        return products / (length[places] * _length(asked[row]))

    rows = max(1, _AT_ONCE // len(ids))
    for begin in range(0, len(mine), rows):
        part = slice(begin, min(begin + rows, len(mine)))
        common = np.zeros((part.stop - begin, len(ids)), np.int32)
        for b, plane in enumerate(planes):
            for word in range(codes.shape[1]):
                both = np.bitwise_count(plane[part, word][:, None] & codes[None, :, word])
                common += np.left_shift(both, b, dtype=np.int32)
        estimate = (2 * step[part]).astype(np.float32) * common
        estimate += (2 * low[part]).astype(np.float32) * ones
        estimate -= turned[part].sum(axis=1, keepdims=True).astype(np.float32)
        estimate *= scale
        for row in range(begin, part.stop):
            guess = np.where(ids == mine[row], -np.inf, estimate[row - begin])
            others = len(ids) - int((ids == mine[row]).sum())
            if not others:
                continue
            if others > k:
                first = np.argpartition(-guess, k - 1)[:k]
                bound = cosines(row, first).min()
                within = guess + slack >= bound
                within[first] = True
                likely = np.flatnonzero(within)
            else:
                likely = np.flatnonzero(guess > -np.inf)
            cosine = cosines(row, likely)
            order = np.lexsort((ids[likely], -cosine))[:k]
            yield row, likely[order], cosine[order]


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query, from two indexes."""
    blocks = max(1, -(-candidates.count() // BLOCK))
    groups = max(1, -(-queries.count() // GROUP))

    def every(n):
        return F.explode(F.array(*[F.lit(i) for i in range(n)])) if n < 100 else F.explode(
            F.sequence(F.lit(0), F.lit(n - 1))
        )

    left = queries.select("vec_id", "vector", F.pmod(F.hash("vec_id"), F.lit(groups)).alias("_group"))
    left = left.withColumn("_block", every(blocks)).withColumn("_length", F.size("vector"))
    right = candidates.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    right = right.withColumn("_group", every(groups)).withColumn("_length", F.size("vector"))

    def search(asked: pa.Table, block: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if asked.num_rows and block.num_rows:
            ids = block.column("vec_id").to_numpy()
            mine = asked.column("vec_id").to_numpy()
            for row, near, cosine in _best(asked, block, k):
                found["query_id"].append(np.full(len(near), mine[row]))
                found["vec_id"].append(ids[near])
                found["score"].append(cosine)
        types = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table(
            {c: np.concatenate([np.zeros(0, t), *found[c]]) for c, t in types.items()}
        )

    keys = ["_length", "_block", "_group"]
    near = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(search, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
