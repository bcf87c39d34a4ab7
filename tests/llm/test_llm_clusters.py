import hashlib

import numpy as np
import pytest

from riskflow.llm import centroid_clusters, queries

SCHEMA = "vec_id long, embedding array<float>"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def expected(rows, k=8, rounds=10):
    """The same in plain Python integers."""
    kept = [
        (i, [int(np.floor(1024 * float(x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)
    ]
    ordered = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in ordered[:k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), m in zip(kept, own, strict=True) if m == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    per = {n: sum(d for _, m, d in found if m == n) for n in range(len(centroids))}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, per[n], sum(per.values()), digests[n]) for i, n, d in found]


def in_order(rows):
    return sorted(rows, key=str)


def clustered(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return in_order([tuple(r) for r in centroid_clusters.clustered(df, **options).select(*COLUMNS).collect()])


def vectors(n, seed=0):
    values = np.random.default_rng(seed).normal(0, 0.1, (n, 64)).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(values)]


@pytest.mark.parametrize("block", [4096, 7])
def test_equal_to_plain_integers(spark, monkeypatch, block):
    monkeypatch.setattr(centroid_clusters, "BLOCK", block)
    rows = vectors(150)
    # Copies, ties between centroids, repeated ids, odd vectors, and an id that is missing.
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [(5, rows[9][1]), (5, rows[9][1])]
    rows += [(None, rows[11][1]), (300, None), (301, []), (302, [0.5] * 63), (303, [0.0] * 64)]
    rows += [(304, [None] + [0.1] * 63), (305, [float("nan")] * 64), (306, [float("inf")] + [0.0] * 63)]
    assert clustered(spark, rows) == in_order(expected(rows))


def test_equal_vectors_leave_clusters_empty(spark):
    rows = [(i, [0.25] * 64) for i in range(12)] + [(20, [-0.0004] * 64)]
    got = clustered(spark, rows)
    assert got == in_order(expected(rows))
    assert len({r[1] for r in got}) < 8


def test_few_vectors_and_none(spark):
    rows = vectors(3)
    assert clustered(spark, rows) == in_order(expected(rows))
    assert clustered(spark, rows, k=2, rounds=0) == in_order(expected(rows, 2, 0))
    assert clustered(spark, []) == []
    assert clustered(spark, [(1, None)]) == []


def test_huge_components_are_bounded(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    got = {r[0]: r for r in clustered(spark, rows, k=1, rounds=0)}
    wide = 2 * centroid_clusters.LARGEST
    assert max(r[2] for r in got.values()) <= 64 * wide**2 < 2**63
    assert len(got) == 3


def test_clashing_columns_are_ignored(spark):
    from llm_cases import clashing

    rows = vectors(40)
    df = clashing(spark.createDataFrame(rows, SCHEMA), "vector", "cluster", "distance", "ids")
    found = centroid_clusters.clustered(df)
    assert found.columns == COLUMNS
    assert in_order([tuple(r) for r in found.collect()]) == in_order(expected(rows))


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = queries.QUERIES["op13_centroid_clusters"](spark, path).select(*COLUMNS).collect()
    assert in_order([tuple(r) for r in got]) == in_order(expected(rows))
