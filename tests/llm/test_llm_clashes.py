"""Input columns named like those that operators and stages make for themselves."""

import numpy as np
import pytest
from llm_cases import clashing, documents

import corpus_pipeline as pipeline
from riskflow.llm import bpe, html_text, linear, quality, simhash, toxicity
from riskflow.llm.common import free_name, stored, workers_can_import

vocabularies = pytest.importorskip("public_tokenizers")
NAMES = ["_text", "__text", "_html", "_score", "score", "ids", "decoded", "fingerprint", "offending", "row"]


def _values(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


def _same(result, docs, *own):
    """All other columns are there, with their types and values, and then the operator's."""
    kept = [c for c in docs.columns if c not in own]
    assert result.columns == [*kept, *own]
    assert dict(result.dtypes).items() >= {c: t for c, t in docs.dtypes if c in kept}.items()
    assert _values(result, kept) == _values(docs, kept)


def test_a_free_name(spark):
    df = spark.createDataFrame([(1, 2)], "_a int, __A int")
    assert free_name(df, "_a") == "___a" and free_name(df, "b") == "b"


def test_operators_leave_other_columns_alone(spark):
    workers_can_import(spark)
    docs = clashing(documents(spark), *NAMES)
    weights = np.zeros(linear.DIMENSIONS + 1, np.float32)
    _same(quality.scored(docs, weights), docs, "score")
    _same(quality.scored(docs, weights, name="_s"), docs, "_s")
    _same(toxicity.located(docs, weights), docs, "score", "offending")
    _same(simhash.fingerprints(docs), docs, "fingerprint")
    ranks = bpe.read_ranks(vocabularies.path("byte_bpe_50k.tiktoken"))
    _same(bpe.encoded(docs, ranks, vocabularies.PATTERN), docs, "ids")
    both = bpe.encoded(docs, ranks, vocabularies.PATTERN, data="decoded", keep_text=False)
    _same(both, docs.drop("text"), "ids", "decoded")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_id = [r for r in both.collect() if r["doc_id"] not in (None, 20, 21)]
    assert all(bytes(r["decoded"]).decode() == (texts[r["doc_id"]] or "") for r in by_id)
    pages = spark.createDataFrame([(1, "u", "<p>One</p>"), (2, None, None)], "page_id long, url string, html string")
    pages = clashing(pages, "_html", "__html", "_text", "blocks")
    _same(html_text.extracted(pages, html_text.train(pages)), pages, "text")


def test_stages_return_the_columns_of_their_input(spark):
    workers_can_import(spark)
    docs = clashing(documents(spark).select("doc_id", "text", "lang", "source", "n_chars"), *NAMES)
    for name, stage in pipeline.STAGES:
        result = stored(stage(spark, docs, "/root/testdata/sf0.001"), name.replace(" ", "-"))
        if name == "bpe":
            assert result.columns == ["doc_id", "source", "ids", "n_tokens", "round_trip"]
            assert all(r["round_trip"] for r in result.collect())
        else:
            assert result.columns == docs.columns and result.dtypes == docs.dtypes
            assert set(_values(result, docs.columns)) <= set(_values(docs, docs.columns))
        docs = result
    assert docs.count() > 0
