import hashlib

import pytest
from llm_cases import clashing, documents, odd_documents

from riskflow.llm import exact_dedup


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1] or "", []).append(row[0])
    found = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        left = 1
        for i in ids:
            found.append((i, keep, len(ids), i == keep and left == 1, digest))
            left -= i == keep
    return sorted(found, key=str)


def test_classes_equal_brute_force(spark):
    got = exact_dedup.classes(documents(spark)).collect()
    assert sorted(map(tuple, got), key=str) == expected(odd_documents())


@pytest.mark.parametrize("copies", [3, 700])
def test_frequent_texts_take_the_same_way(spark, copies):
    """A text on most rows is decided by broadcast, with the same result."""
    rows = [(i, "hot", "s", "en", 3) for i in range(copies)]
    rows += [(10_000 + i, f"text {i // 2}", "s", "en", 3) for i in range(40)]
    got = exact_dedup.classes(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_frequent_digests_are_found_and_bounded(spark):
    from pyspark.sql import functions as F

    digests = spark.range(20_000).select(
        F.col("id").alias("_id"),
        F.when(F.col("id") % 3 == 0, F.lit(b"hot")).otherwise(F.col("id").cast("string").cast("binary")).alias("_digest"),
    )
    found = exact_dedup._winners(digests).collect()
    hot = [r for r in found if bytes(r["h_digest"]) == b"hot"]
    assert len(found) <= 1 / exact_dedup.SUPPORT
    assert [(r["h_keep"], r["h_size"]) for r in hot] == [(19_998, 6_667)]


def test_drop_copies_keeps_one_of_each_text_and_all_columns(spark):
    docs = clashing(documents(spark), "_id", "_digest", "keep_id", "h_keep", "_place")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({row[1] or "" for row in odd_documents()})
    best = {}
    for i, text, *_ in odd_documents():
        best[text or ""] = max(best.get(text or "", -1), -1 if i is None else i)
    assert {(r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in rows} == set(best.items())


def test_no_python_on_the_executors(spark):
    plan = exact_dedup.classes(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    assert "Cartesian" not in plan


def test_empty_table(spark):
    assert exact_dedup.classes(documents(spark, [])).collect() == []
    assert exact_dedup.drop_copies(documents(spark, [])).collect() == []
