"""Near-duplicates by SimHash fingerprints, compared in bit slices.

A fingerprint has a bit set where more than half of the XXH64 values of a text's
shingles have it. Equal fingerprints are one node. Two of the others that differ
in at most ``RADIUS`` bits agree in ``BLOCKS - RADIUS`` of ``BLOCKS`` blocks of bits, so
each fingerprint is sent to a bucket for every such choice of blocks, and every
link is found in some bucket, exactly.

In a bucket the fingerprints stand in blocks of 64 lanes, stored as bit planes: one
machine word holds the same bit of 64 fingerprints. All distances of a fingerprint
to a block are counted at once by two carry-save counters and an overflow word, plane
by plane, and a block is abandoned as soon as all its lanes have overflowed. A
bucket passes on a spanning forest of its links, never all its pairs.

Defined cases: a null or empty text, or one without words, has fingerprint zero and
is linked like any other; a text of fewer words than a shingle is one shingle; a null
id is never the smallest unless there is no other; rows that repeat are in the same
component; an empty table gives an empty result; ``drop_near`` keeps all columns.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm import arrays as A
from riskflow.llm.common import free_name, stored, tasks, text_of, workers_can_import
from riskflow.llm.components import roots

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Buckets share BLOCKS - RADIUS blocks of bits: 25 bits, in ten ways.
BLOCKS = 5

_ALL = np.uint64(2**64 - 1)


def _fingerprints(raw, offsets, shingle=SHINGLE):
    n = len(offsets) - 1
    raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
    starts, ends, docs = A.words(raw, offsets)
    result = np.zeros(n, np.uint64)
    if not len(starts):
        return result
    # The words again, each followed by one space.
    length = ends - starts + 1
    to = np.cumsum(length)
    take = np.repeat(starts - (to - length), length) + np.arange(to[-1])
    flat = np.append(raw, np.uint8(32))[take]
    flat[to - 1] = 32
    flat = flat.tobytes()
    count = np.bincount(docs, minlength=n)
    first = np.cumsum(count) - count
    shingles = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    # Word at which each shingle begins, and the last word in it.
    begin = np.arange(shingles.sum()) + np.repeat(first - (np.cumsum(shingles) - shingles), shingles)
    last = begin + np.repeat(np.minimum(count, shingle) - 1, shingles)
    digest = xxhash.xxh64_intdigest
    left, right = (to - length)[begin].tolist(), (to[last] - 1).tolist()
    hashes = np.fromiter(
        (digest(flat[a:b], SEED) for a, b in zip(left, right, strict=True)), np.uint64, len(left)
    )
    owners = np.flatnonzero(shingles)
    cuts = (np.cumsum(shingles) - shingles)[owners]
    for k in range(8):
        byte = (hashes >> np.uint64(8 * k)).astype(np.uint8)
        bits = np.unpackbits(byte[:, None], axis=1, bitorder="little")
        sums = np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        majority = np.packbits(2 * sums > shingles[owners, None], axis=1, bitorder="little")
        result[owners] |= majority[:, 0].astype(np.uint64) << np.uint64(8 * k)
    return result


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """All columns of the documents and ``fingerprint`` as a long, instead of one of its name."""
    workers_can_import(docs.sparkSession)
    rest, own = docs.drop("fingerprint"), free_name(docs, "_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)

    def run(batches):
        for piece, raw, offsets in A.pieces(batches, own):
            columns = [piece.column(c) for c in range(piece.num_columns - 1)]
            columns.append(pa.array(_fingerprints(raw, offsets, shingle).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                columns, names=[*piece.schema.names[:-1], "fingerprint"]
            )

    return rest.withColumn(own, text_of(docs, text)).mapInArrow(run, f"{schema}, fingerprint long")


def _planes(codes: np.ndarray) -> np.ndarray:
    """64 planes of one word per 64 codes: bit j of a word belongs to lane j."""
    padded = np.zeros((len(codes) + 63) // 64 * 64, np.uint64)
    padded[: len(codes)] = codes
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = bits.reshape(-1, 64, 64).transpose(2, 0, 1)
    packed = np.packbits(lanes, axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)[:, :, 0]


def near_pairs(codes: np.ndarray, first: np.ndarray, radius: int = RADIUS, at_once: int = 1 << 19):
    """Pairs (i, j), first[i] <= j < i, whose codes differ in at most ``radius`` < 4 bits."""
    planes = _planes(codes)
    index = np.arange(len(codes))
    blocks = index // 64 - first // 64 + 1
    edges = np.concatenate(([0], np.cumsum(blocks)))
    begin = 0
    while begin < len(codes):
        end = max(int(np.searchsorted(edges, edges[begin] + at_once, "right")) - 1, begin + 1)
        mine = np.repeat(index[begin:end], blocks[begin:end])
        block = np.arange(edges[end] - edges[begin]) - np.repeat(
            edges[begin:end] - edges[begin], blocks[begin:end]
        )
        block += first[mine] // 64
        # Only lanes of the same bucket, before the code itself, are compared.
        low = np.maximum(first[mine] - block * 64, 0).astype(np.uint64)
        high = np.minimum(mine - block * 64, 64).astype(np.uint64)
        upto = np.where(high == 64, _ALL, (np.uint64(1) << (high % np.uint64(64))) - np.uint64(1))
        over = ~(upto & (_ALL << low))
        ones, twos = np.zeros_like(over), np.zeros_like(over)
        for plane in range(64):
            bit = (codes[mine] >> np.uint64(plane)) & np.uint64(1)
            differ = planes[plane, block] ^ (np.uint64(0) - bit)
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
            if plane % 8 == 7:
                alive = over != _ALL
                if not alive.all():
                    mine, block, over = mine[alive], block[alive], over[alive]
                    ones, twos = ones[alive], twos[alive]
        if radius < 3:
            over |= twos & ones if radius == 2 else twos if radius == 1 else twos | ones
        lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(lanes)
        yield mine[row], block[row] * 64 + lane
        begin = end


def _forest(batches):
    """Links of whole buckets, rows sorted by bucket: a spanning forest of each."""

    def links(bucket, codes):
        same = np.concatenate(([True], bucket[1:] != bucket[:-1]))
        first = np.maximum.accumulate(np.where(same, np.arange(len(codes)), 0))
        parent = list(range(len(codes)))

        def top(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        found = []
        for left, right in near_pairs(codes, first):
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                a, b = top(i), top(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((i, j))
        ends = codes.view(np.int64)[np.array(found, np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_pydict({"u": ends[:, 0], "v": ends[:, 1]})

    held_bucket, held_code, size = [], [], 0
    for batch in batches:
        held_bucket.append(batch.column("bucket").to_numpy())
        held_code.append(batch.column("code").to_numpy().view(np.uint64))
        size += batch.num_rows
        if size >= 200_000:
            bucket, code = np.concatenate(held_bucket), np.concatenate(held_code)
            cut = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if bucket[0] != bucket[-1] else 0
            if cut:
                yield links(bucket[:cut], code[:cut])
            held_bucket, held_code, size = [bucket[cut:]], [code[cut:]], len(bucket) - cut
    if size:
        yield links(np.concatenate(held_bucket), np.concatenate(held_code))


def _blocks(blocks: int) -> list[int]:
    """One mask per block of bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def links(codes: DataFrame, blocks: int = BLOCKS, radius: int = RADIUS) -> DataFrame:
    """(u, v): fingerprints that differ in at most ``radius`` bits, as forests of buckets.

    ``codes`` has one column, code, of different longs.
    """
    keys = [
        F.struct(
            F.lit(k).alias("way"),
            F.col("code").bitwiseAND(F.lit(_signed(sum(chosen)))).alias("part"),
        )
        for k, chosen in enumerate(combinations(_blocks(blocks), blocks - radius))
    ]
    dealt = codes.select("code", F.explode(F.array(*keys)).alias("key")).select(
        F.xxhash64("key.way", "key.part").alias("bucket"), "code"
    )
    sorted_ = dealt.repartition(tasks(codes.sparkSession), "bucket").sortWithinPartitions("bucket", "code")
    return sorted_.mapInArrow(_forest, "u long, v long").distinct()


def components(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = docs.select(docs[id].alias("doc_id"), text_of(docs, text).alias("text"))
    known = stored(fingerprints(rows).drop("text"), "fingerprints")
    return _labelled(known).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def _labelled(known: DataFrame) -> DataFrame:
    """Adds component_id to rows of doc_id and fingerprint.

    A fingerprint may belong to very many rows, so its label is brought to them by a
    join that adaptive execution can split, after all aggregates have combined.
    """
    codes = stored(
        known.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("least")), "codes"
    )
    root = roots(links(codes.select("code")))
    whole = codes.join(root, codes["code"] == root["u"], "left").select(
        "code", "least", F.coalesce("v", "code").alias("root")
    )
    labels = whole.join(
        whole.groupBy("root").agg(F.min("least").alias("component_id")), "root"
    ).select(F.col("code").alias("fingerprint"), "component_id")
    return known.join(labels, "fingerprint")


def drop_near(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns: the smallest id of each component."""
    mark = F.xxhash64(text_of(docs, text))
    rows = docs.select(docs[id].alias("doc_id"), mark.alias("mark"), text_of(docs, text).alias("text"))
    known = stored(fingerprints(rows).drop("text"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first")
    stays = (
        _labelled(known)
        .groupBy(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fingerprint")))
        .agg(first)
        .select(F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"))
    )
    whole = docs.select(
        docs[id].alias("_i"), mark.alias("_m"), F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    )
    once = Window.partitionBy("_i", "_m").orderBy(F.lit(0))
    return (
        whole.join(stays, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_m") == F.col("_mark")), "left_semi")
        .withColumn("_place", F.row_number().over(once))
        .filter("_place = 1")
        .select("_row.*")
    )
