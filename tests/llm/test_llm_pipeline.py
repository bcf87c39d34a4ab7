import hashlib
from collections import Counter

import pytest
import tiktoken
from llm_cases import DATA, words
from test_llm_simhash import expected as components

import corpus_pipeline as pipeline
from riskflow.llm.bpe import read_ranks
from riskflow.llm.common import stored, workers_can_import

vocabularies = pytest.importorskip("public_tokenizers")


def test_each_stage_does_its_part(spark):
    workers_can_import(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    quality, exact, near, mix, bpe = (stage for _, stage in pipeline.STAGES)

    before = docs.collect()
    docs = stored(quality(spark, docs, DATA), "a")
    assert docs.columns == columns
    after = docs.collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    good = [i for i, y in labels.items() if y == 1]
    poor = [i for i, y in labels.items() if y == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i in poor) <= 0.2 * len(poor)
    assert set(after) <= set(before)

    before = after
    docs = stored(exact(spark, docs, DATA), "b")
    after = docs.collect()
    best = {}
    for r in before:
        best[r["text"]] = max(best.get(r["text"], r), r, key=lambda x: x["doc_id"])
    assert docs.columns == columns and set(after) == set(best.values())

    before = after
    docs = stored(near(spark, docs, DATA), "c")
    after = docs.collect()
    first = {c for _, _, c in components([(r["doc_id"], r["text"]) for r in before])}
    assert docs.columns == columns and {r["doc_id"] for r in after} == first
    assert len(after) == len(first)

    before = after
    docs = stored(mix(spark, docs, DATA), "d")
    after = docs.collect()
    assert docs.columns == columns and set(after) <= set(before)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3
    total = sum(len(words(r["text"])) for r in before)
    assert 0.98 * total <= sum(len(words(r["text"])) for r in after) <= total

    ranks = read_ranks(
        vocabularies.path("byte_bpe_50k.tiktoken")
    )
    library = tiktoken.Encoding("t", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in after}
    rows = bpe(spark, docs, DATA).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in after)
    for r in rows:
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
    for r in rows[:100]:
        assert r["ids"] == library.encode_ordinary(text[r["doc_id"]])


def test_run_is_the_stages_in_order_and_repeats(spark):
    def digest():
        rows = pipeline.run(spark, "/root/testdata/sf0.001").collect()
        return Counter((r["doc_id"], hashlib.sha256(str(r["ids"]).encode()).hexdigest()) for r in rows)

    first = digest()
    assert first and first == digest()


def test_stages_take_odd_tables(spark):
    from llm_cases import documents

    workers_can_import(spark)
    for rows in (None, []):
        docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in pipeline.STAGES:
            result = stored(stage(spark, docs, "/root/testdata/sf0.001"), name.replace(" ", "-"))
            if name != "bpe":
                assert result.columns == docs.columns
            if not rows and rows is not None:
                assert result.count() == 0
            docs = result
