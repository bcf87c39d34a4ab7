import numpy as np
import pytest
from llm_cases import clashing, documents, odd_documents, prose, remainder
from pyspark.sql import functions as F

from riskflow.llm import queries, quality, toxicity

BAD = ["vile", "awful", "rotten"]


def labelled(spark, n=400, label="toxic", mark=lambda i: i % 4 == 0):
    """Documents of five sentences; one sentence of a marked one has a telling word."""
    rows, labels = [], []
    for i in range(n):
        sentences = [prose(i * 10 + k, 8) + "." for k in range(5)]
        if mark(i):
            sentences[i % 5] = f"so {BAD[i % 3]} is this."
        rows.append((i, " ".join(sentences), "s", "en", 0))
        labels.append((i, int(mark(i))))
    return documents(spark, rows), spark.createDataFrame(labels, f"doc_id long, {label} int")


def test_toxicity_finds_the_sentence(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, learn=F.col("doc_id") % 5 != 0)
    rows = toxicity.located(docs, model).filter("doc_id % 5 = 0").collect()
    for r in rows:
        assert (r["score"] >= 0.3) == (r["doc_id"] % 4 == 0)
        found = [r["text"].encode()[s["first"] : s["end"]].decode() for s in r["offending"]]
        assert all(any(bad in s for bad in BAD) for s in found)
        assert bool(found) == (r["doc_id"] % 4 == 0)


def test_noisy_or():
    whole, _ = toxicity._noisy_or(np.array([0.5, 0.5, 0.2]), np.array([0, 0, 2]), 3)
    assert whole.tolist() == pytest.approx([0.75, 0.0, 0.2])


def test_sentences_and_their_places():
    text = "One two. THREE\nfour five! six"
    raw = np.frombuffer((text + "Seven").encode(), np.uint8)
    _, doc, first, end = toxicity._sentences(raw, np.array([0, len(text), len(raw)]))
    cut = [raw[a:b].tobytes().decode() for a, b in zip(first, end, strict=True)]
    assert cut == ["One two.", "THREE", "four five!", "six", "Seven"]
    assert doc.tolist() == [0, 0, 0, 0, 1]


def test_quality_learns_words_and_shapes(spark):
    def good(i):
        return i % 3 != 0

    docs, labels = labelled(spark, 300, "quality", lambda i: False)
    labels = labels.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    shouted = F.upper(F.regexp_replace("text", " ", "!! "))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, shouted).otherwise(F.col("text")))
    model = quality.train(docs, labels, learn=F.col("doc_id") % 5 != 0)
    for r in quality.scored(docs, model).filter("doc_id % 5 = 0").collect():
        assert (r["score"] >= 0.3) == good(r["doc_id"])


@pytest.mark.parametrize("operator", ["quality", "toxicity"])
def test_odd_documents_and_columns(spark, operator):
    docs = clashing(documents(spark), "score", "offending", "_more", "label", "order")
    labels = [(i, i % 2, i % 2) for i in range(30)] + [(None, 1, 1), (3, None, None), (3, 0, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    if operator == "quality":
        found = quality.scored(docs, quality.train(docs, labels))
        assert found.columns == [*docs.drop("score").columns, "score"]
    else:
        found = toxicity.located(docs, toxicity.train(docs, labels))
        assert found.columns == [*docs.drop("score", "offending").columns, "score", "offending"]
    rows = found.collect()
    assert len(rows) == len(odd_documents())
    assert all(0 <= r["score"] <= 1 for r in rows)
    again = {}
    for r in rows:
        assert again.setdefault(r["text"] or "", r["score"]) == r["score"]


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_without_labels_or_documents(spark, operator):
    score = quality.scored if operator is quality else toxicity.located
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = operator.train(documents(spark), labels)
    scores = {r["score"] for r in score(documents(spark), model).filter("length(text) < 9").collect()}
    assert all(s == 0.5 if operator is quality else s < 0.01 for s in scores)
    assert score(documents(spark, []), model).collect() == []


@pytest.mark.parametrize(
    ("query", "label", "rest", "fold", "least"),
    [("op1_toxicity", "toxic", 4, 2, 0.85), ("op10_quality", "quality", 5, 0, 0.95)],
)
def test_queries_on_held_out_rows(spark, query, label, rest, fold, least):
    rows = queries.QUERIES[query](spark, "/root/testdata/sf0.1").collect()
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r["doc_id"]: r[label] for r in truth.collect()}
    assert len(rows) == 10_000
    right = total = 0
    for r in rows:
        assert r["held_out"] == (remainder(r["doc_id"], rest) == fold)
        assert r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and r["doc_id"] in truth:
            right += r["predicted"] == truth[r["doc_id"]]
            total += 1
    assert right / total >= least


def test_same_model_from_any_layout(spark):
    docs, labels = labelled(spark, 120)
    for train in (quality.train, toxicity.train):
        one = train(docs.repartition(1), labels, "toxic")
        other = train(docs.repartition(7), labels.repartition(5), "toxic")
        assert (one == other).all()


def test_sample_is_bounded(spark):
    docs, labels = labelled(spark, 200)
    from riskflow.llm import linear

    rows = linear.sample(docs, labels, "toxic", F.lit(True), 50, "text", "doc_id")
    assert rows.count() == 50
