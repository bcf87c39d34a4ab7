import hashlib

import pytest
import regex
import tiktoken
from llm_cases import clashing, documents, odd_documents, prose

from riskflow.llm import bpe, queries

vocabularies = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(vocabularies.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding(
        "test", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_ids_equal_the_library(spark, ranks, reference):
    docs = clashing(documents(spark), "ids", "decoded", "_more")
    both = bpe.decoded(bpe.encoded(docs, ranks, vocabularies.PATTERN), ranks)
    rows = both.collect()
    assert both.columns == [*docs.drop("ids", "decoded").columns, "ids", "decoded"]
    assert len(rows) == len(odd_documents())
    for r in rows:
        assert r["ids"] == reference.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")


def test_texts_with_marks_spaces_and_special_strings(ranks, reference):
    texts = ["", " ", "\n\n \t", "a" * 3000, "ab" * 900, "it's 'TIS we'll", "<|endoftext|> x", "\u0000é​",
             "日本語" * 70, "😀" * 50, prose(3, 500)]
    got = bpe._lists(texts, regex.compile(vocabularies.PATTERN), ranks, "t").to_pylist()
    assert got == [reference.encode_ordinary(t) for t in texts]


def test_replay_in_any_order_of_ranks():
    """A merge that only becomes possible late, with a rank below the one at hand."""
    single = {bytes([b]): b for b in range(256)}
    ranks = single | {b"ab": 300, b"bc": 301, b"abc": 260, b"abcabc": 259, b"ca": 302, b"aa": 270}
    library = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    words = [b"abcabc", b"abcab", b"cabcabcab", b"aaaaa", b"aaabaabc", b"bcabcabcaab", b"a"]
    assert [list(t) for t in bpe.replay(words, ranks, bpe.merge_table(ranks))] == [library.encode_ordinary(w.decode()) for w in words]


def test_a_full_memory_changes_nothing(monkeypatch, ranks, reference):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "LONGEST", 4)
    pattern = regex.compile(vocabularies.PATTERN)
    for seed in range(5):
        texts = [prose(seed, 60), "unforgettable " * 3]
        assert bpe._lists(texts, pattern, ranks, "small").to_pylist() == [
            reference.encode_ordinary(t) for t in texts
        ]


def test_query(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.QUERIES["op7_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = reference.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_null_ids_and_empty_tables(spark, ranks):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [72, 105])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decoded(rows, ranks).collect()}
    vocabulary = {rank: token for token, rank in ranks.items()}
    assert got == {1: b"", 2: b"", 3: vocabulary[72] + vocabulary[105]}
    assert bpe.encoded(documents(spark, []), ranks, vocabularies.PATTERN).collect() == []
