import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.llm import queries, vector_search

ROWS = "vec_id long, embedding array<float>, label int"


def brute(vectors, queries, k=5):
    """vectors: id -> array. Cosines in double precision, ties to the smaller id."""
    ids = sorted(vectors)
    matrix = np.array([vectors[i] for i in ids])
    length = np.sqrt((matrix * matrix).sum(axis=1))
    found = []
    for q in sorted(queries):
        a = vectors[q]
        cosine = (matrix * a).sum(axis=1) / (length * np.sqrt((a * a).sum()))
        order = [n for n in np.lexsort((ids, -cosine)) if ids[n] != q][:k]
        found += [(q, r + 1, ids[n], cosine[n]) for r, n in enumerate(order)]
    return found


def search(df, k=5):
    index = vector_search.index(vector_search.usable(df))
    rows = vector_search.nearest(index.filter("vec_id % 50 = 0"), index, k).collect()
    return sorted(map(tuple, rows))


def test_nulls_zeros_ties_and_repeats(spark):
    choose = np.random.default_rng(0)
    rows = [(i, choose.standard_normal(24).astype(np.float32).tolist(), 1) for i in range(300)]
    rows += [(1000 + i, rows[50][1], 1) for i in range(9)]
    good = {r[0]: np.array(r[1], float) for r in rows}
    rows += [(7, rows[7][1], 2), (2000, None, 1), (2050, [0.0] * 24, 1), (None, rows[3][1], 1)]
    rows += [(2100, [float("nan")] + [1.0] * 23, 1), (2150, [None] + [1.0] * 23, 1)]
    rows += [(2200, [float("inf")] + [1.0] * 23, 1), (2250, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(0) for c in ("vector", "code", "rank")})
    got = search(df.repartition(4))
    expected = brute(good, [i for i in good if i % 50 == 0])
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert [g[3] for g in got] == pytest.approx([e[3] for e in expected], abs=1e-14)


@pytest.mark.parametrize(("block", "group"), [(64, 3), (16_384, 2_048)])
def test_blocks_and_groups_do_not_matter(spark, monkeypatch, block, group):
    monkeypatch.setattr(vector_search, "BLOCK", block)
    monkeypatch.setattr(vector_search, "GROUP", group)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    good = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    got = search(df)
    expected = brute(good, [i for i in good if i % 50 == 0])
    assert len(got) == len(expected)
    both = {g[:1] + g[2:3] for g in got} & {e[:1] + e[2:3] for e in expected}
    assert len(both) >= 0.9 * len(expected)


def test_recall_of_the_query(spark):
    sf_dir = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    good = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    got = queries.QUERIES["op5_vector_search"](spark, sf_dir).collect()
    expected = brute(good, [i for i in good if i % 50 == 0])
    both = {(r["query_id"], r["vec_id"]) for r in got} & {(e[0], e[2]) for e in expected}
    assert len(both) >= 0.98 * len(expected)
    assert len(got) == len(expected)


def test_estimates_are_close_and_unbiased():
    choose = np.random.default_rng(1)
    v = choose.standard_normal((400, 64))
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    turned = v @ vector_search._rotation(64)
    signs = np.where(turned > 0, 1, -1) / 8
    factor = (turned * signs).sum(axis=1)
    estimate = signs @ turned.T / factor[:, None]
    error = (estimate - v @ v.T)[~np.eye(400, dtype=bool)]
    assert abs(error.mean()) < 0.003
    assert (np.abs(error) < 3.5 * np.sqrt((1 - 0.6) / 0.6 / 63)).mean() > 0.999


def test_few_or_no_candidates(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1)]
    assert [g[:3] for g in search(spark.createDataFrame(rows, ROWS))] == [(0, 1, 1)]
    assert search(spark.createDataFrame(rows[:1], ROWS)) == []
    assert search(spark.createDataFrame([], ROWS)) == []


def test_vectors_of_different_lengths_are_all_searched(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 40)
    monkeypatch.setattr(vector_search, "GROUP", 2)
    choose = np.random.default_rng(5)
    sizes = {n: (24, 24, 3, 70)[n % 4] for n in range(300)}
    rows = [(n, choose.standard_normal(size).astype(np.float32).tolist(), 1) for n, size in sizes.items()]
    rows += [(350, [1.0, 2.0], 1)]
    found = search(spark.createDataFrame(rows, ROWS).repartition(3))
    expected = []
    for size in (24, 3, 70):
        same = {i: np.array(v, float) for i, v, _ in rows if len(v) == size}
        expected += brute(same, [i for i in same if i % 50 == 0])
    assert [g[:3] for g in found] == [e[:3] for e in sorted(expected)]
