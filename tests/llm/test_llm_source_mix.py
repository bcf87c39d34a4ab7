import hashlib
from collections import Counter, defaultdict

import pytest
from llm_cases import clashing, documents, odd_documents, words

from riskflow.llm import source_mix


def expected(rows, weights=(5, 2, 1), repeats=3):
    """The same queue, served copy by copy."""
    sizes = Counter()
    for row in rows:
        sizes[row[2]] += len(words(row[1]))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, left = sum(sizes.values()), {}, set(names)
    rest = float(total)
    while left:
        rate = rest / sum(weight[s] for s in left)
        full = {s for s in left if rate * weight[s] >= repeats * sizes[s]}
        for s in full or left:
            target[s] = float(repeats * sizes[s]) if full else rate * weight[s]
        rest -= sum(target[s] for s in full)
        left -= full or left
    sent, queue = defaultdict(int), []
    def key(row):
        return hashlib.md5(f"mix:{'' if row[0] is None else row[0]}".encode()).hexdigest()
    order = sorted(rows, key=lambda r: (key(r), r[0] is not None, r[0] or 0, len(words(r[1]))))
    for k, row in enumerate(order):
        size = len(words(row[1]))
        sent[row[2]] += size
        for p in range(repeats if size else 0):
            finish = (sent[row[2]] + p * sizes[row[2]]) / target[row[2]]
            queue.append((finish, row[2] is None, row[2] or "", key(row), sent[row[2]], p, k, size))
    taken, paid = Counter(), 0
    for *_, k, size in sorted(queue):
        if paid + size > total:
            break
        paid += size
        taken[k] += size
    return sorted(
        (
            (r[0], len(words(r[1])), sizes[r[2]], pytest.approx(target[r[2]]), taken[k])
            for k, r in enumerate(order)
        ),
        key=lambda t: (str(t[0]), t[1], t[4]),
    )


@pytest.mark.parametrize("slice_size", [1, 3, 256])
def test_shares_equal_a_served_queue(spark, monkeypatch, slice_size):
    monkeypatch.setattr(source_mix, "SLICE", slice_size)
    got = source_mix.shares(documents(spark)).collect()
    got = sorted(map(tuple, got), key=lambda t: (str(t[0]), t[1], t[4]))
    assert got == expected(odd_documents())


@pytest.mark.parametrize("block", [1, 2, 5])
def test_sums_in_blocks_equal_a_served_queue(spark, monkeypatch, block):
    monkeypatch.setattr(source_mix, "SLICE", 1)
    monkeypatch.setattr(source_mix, "BLOCK", block)
    got = source_mix.shares(documents(spark)).collect()
    got = sorted(map(tuple, got), key=lambda t: (str(t[0]), t[1], t[4]))
    assert got == expected(odd_documents())


def test_no_task_adds_up_all_slices(spark):
    """The sums before the slices are taken per block of them."""
    sums = spark.range(10_000).selectExpr("'' AS _lane", "id AS _slice", "id % 7 AS _size")
    found = source_mix._summed_before(sums)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan
    expected, total = {}, 0
    for n in range(10_000):
        expected[n] = total
        total += n % 7
    assert {r["_slice"]: r["_before"] for r in found.collect()} == expected


def test_taken_words_come_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = source_mix.shares(docs).collect()
    taken, target, most = Counter(), {}, Counter()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        most[source[r["doc_id"]]] = max(most[source[r["doc_id"]]], r["size"])
        assert r["taken"] <= 3 * r["size"]
        assert r["target"] <= 3 * r["source_size"]
    for name in target:
        assert abs(taken[name] - target[name]) <= 2 * most[name]
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))


def test_write_order_repeats_documents_as_often_as_they_are_taken(spark):
    docs = clashing(documents(spark), "_id", "_row", "_size", "target", "_times", "f")
    mixed = source_mix.write_order(docs)
    assert mixed.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    shares = source_mix.shares(docs).filter("size > 0").collect()
    assert sum(len(words(text)) * n for (_, text), n in got.items()) == sum(r["taken"] for r in shares)
    assert sum(got.values()) == sum(r["taken"] // r["size"] for r in shares)
    assert mixed.collect() == source_mix.write_order(docs).collect()


def test_no_python_and_no_hot_window(spark):
    plan = source_mix.shares(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian"))


def test_empty_tables(spark):
    assert source_mix.shares(documents(spark, [])).collect() == []
    nothing = [(1, "", "a", "en", 0), (2, None, "b", "en", 0)]
    got = source_mix.shares(documents(spark, nothing)).collect()
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in got) == [(1, 0, 0), (2, 0, 0)]
