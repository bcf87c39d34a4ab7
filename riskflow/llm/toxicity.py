"""Toxicity by multiple-instance learning: sentences are scored, documents labelled.

A sentence's probability is a logistic function of its hashed words, word pairs
and word beginnings; a document is toxic unless none of its sentences is, so its probability
is their noisy-or. Training sees document labels only: the gradient of the
document's likelihood is passed to its sentences in proportion to what each
contributes. Weights that stay small are set to zero as training goes. Scoring
gives the document's probability and the sentences that carry it.

Words are compared without case (A-Z) and without marks around them. A sentence
ends at a line break or after a word that ends in . ! or ?

Defined cases: a null text is empty; a text without words has no sentences and
scores 0; without labelled rows all scores are small and equal per sentence; a
label given twice counts as the larger; rows that repeat an id are scored each
for itself; an empty table gives an empty result; only the text enters a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm import arrays as A
from riskflow.llm import linear
from riskflow.llm.common import free_name, text_of, workers_can_import

#: A document is toxic from this probability on, and so is a sentence.
THRESHOLD = 0.3
EPOCHS = 30
BATCH = 128
#: Log odds of a sentence without known words; low, so that thousands of them add up to little.
START = -9.0

#: A longer word also enters by its first bytes, so that inflected forms share weight.
STEMS = (4, 6, 8)

SPANS = "array<struct<first: long, end: long, score: double>>"


def _sentences(raw, offsets):
    """Per word: features of the word and its pair, and its sentence; per sentence: its place."""
    starts, ends, docs = A.words(raw, offsets)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return (none, none), none, none, none
    lower = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
    solid = ((lower >= 97) & (lower <= 122)) | ((raw >= 48) & (raw <= 57)) | (raw >= 128)
    places = np.arange(len(raw))
    after = np.minimum.accumulate(np.where(solid, places, len(raw))[::-1])[::-1][starts]
    before = np.maximum.accumulate(np.where(solid, places, -1))[ends - 1]
    bare = after < ends
    left, right = np.where(bare, after, starts), np.where(bare, before + 1, ends)
    hasher = A.Hasher(lower)
    unit = hasher.spans(left, right)

    broken = np.concatenate(([0], np.cumsum(raw == 10)))
    opens = np.ones(n, bool)
    stop = np.isin(raw[ends - 1], [46, 33, 63])
    opens[1:] = (
        (docs[1:] != docs[:-1]) | stop[:-1] | (broken[starts[1:]] > broken[ends[:-1]])
    )
    sentence = np.cumsum(opens) - 1
    together = sentence[1:] == sentence[:-1]
    hashes, of = [unit, A.joined(unit[:-1], unit[1:])[together]], [sentence, sentence[:-1][together]]
    for size in STEMS:
        longer = right - left > size
        stem = hasher.spans(left[longer], left[longer] + size)
        hashes.append(A.mixed(stem + np.uint64(size)))
        of.append(sentence[longer])
    features = (np.concatenate(hashes) % np.uint64(linear.DIMENSIONS)).astype(np.int64)
    of = np.concatenate(of)
    first = starts[opens]
    end = ends[np.append(np.flatnonzero(opens)[1:], n) - 1]
    return (features, of), docs[opens], first, end


def _features(batches):
    """Words of each document as bytes, with the number of each one's sentence."""
    for piece, raw, offsets in A.pieces(batches, "text"):
        n = len(offsets) - 1
        (features, of), doc, _, _ = _sentences(raw, offsets)
        order = np.argsort(of, kind="stable")
        features, of = features[order], of[order]
        begin = np.searchsorted(doc, np.arange(n + 1))
        cut = np.searchsorted(of, begin)
        yield pa.RecordBatch.from_pydict(
            {
                "order": piece.column("order"),
                "label": piece.column("label"),
                "places": [features[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)],
                "sentences": [
                    (of[a:b] - s).astype(np.int32).tobytes()
                    for a, b, s in zip(cut[:-1], cut[1:], begin[:-1], strict=True)
                ],
            }
        )


def _noisy_or(p, doc, n):
    """1 - prod(1 - p) per document, and the log of the product."""
    none = A.group_sums(np.log1p(-np.minimum(p, 1 - 1e-12)), doc, n)
    return -np.expm1(none), none


def _learn(rows, rate=0.5, l1=1e-4):
    """Adaptive gradient steps on the noisy-or likelihood, with soft thresholds."""
    size = linear.DIMENSIONS
    w, seen = np.zeros(size + 1), np.full(size + 1, 1e-6)
    w[size] = START
    bags = [
        (np.frombuffer(r["places"], np.int32), np.frombuffer(r["sentences"], np.int32), r["label"])
        for r in rows
        if len(r["places"])
    ]
    order = np.arange(len(bags))
    random = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        random.shuffle(order)
        for at in range(0, len(order), BATCH):
            chosen = [bags[i] for i in order[at : at + BATCH]]
            counts = np.array([s[-1] + 1 for _, s, _ in chosen])
            begin = np.concatenate(([0], np.cumsum(counts)))
            places = np.concatenate([p for p, _, _ in chosen])
            sentence = np.concatenate([s + b for (_, s, _), b in zip(chosen, begin, strict=False)])
            doc = np.repeat(np.arange(len(chosen)), counts)
            label = np.array([y for _, _, y in chosen])
            odds = w[size] + A.group_sums(w[places], sentence, begin[-1])
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            whole, none = _noisy_or(p, doc, len(chosen))
            # d log likelihood / d odds of a sentence
            pull = np.where(label[doc] > 0, np.exp(none[doc]) / np.maximum(whole[doc], 1e-9), -1.0) * p
            step = np.bincount(places, pull[sentence], minlength=size + 1)
            touched = np.flatnonzero(step)
            g = step[touched]
            seen[touched] += g**2
            speed = rate / np.sqrt(seen[touched])
            moved = w[touched] + speed * g
            w[touched] = np.sign(moved) * np.maximum(np.abs(moved) - speed * l1 * len(chosen), 0)
    return w


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    learn: Column | None = None,
    rows: int = linear.TRAINING_ROWS,
    text: str = "text",
    id: str = "doc_id",
) -> np.ndarray:
    """Weights learnt from at most ``rows`` of the labels that ``learn`` admits."""
    learn = F.lit(True) if learn is None else learn
    known = linear.sample(docs, labels, label, learn, rows, text, id)
    return linear.fitted(known, _features, "places binary, sentences binary", _learn)


def located(
    docs: DataFrame, model: np.ndarray, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """All columns of the documents, ``score``, and ``offending``: the byte spans and
    probabilities of sentences from ``threshold`` on. Both replace columns of their name."""
    spark = workers_can_import(docs.sparkSession).sparkContext
    shared = spark.broadcast(model)

    def score(batches):
        weights = shared.value.astype(np.float64)
        bias = weights[linear.DIMENSIONS]
        for piece, raw, offsets in A.pieces(batches, own):
            n = len(offsets) - 1
            (features, of), doc, first, end = _sentences(raw, offsets)
            odds = bias + A.group_sums(weights[features], of, len(doc))
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            whole, _ = _noisy_or(p, doc, n)
            hit = np.flatnonzero(p >= threshold)
            lists = np.concatenate(([0], np.cumsum(np.bincount(doc[hit], minlength=n))))
            spans = pa.StructArray.from_arrays(
                [
                    pa.array(first[hit] - offsets[doc[hit]]),
                    pa.array(end[hit] - offsets[doc[hit]]),
                    pa.array(p[hit]),
                ],
                names=["first", "end", "score"],
            )
            kept = [piece.column(c) for c in range(piece.num_columns - 1)]
            kept += [
                pa.array(np.clip(whole, 0.0, 1.0)),
                pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), spans),
            ]
            yield pa.RecordBatch.from_arrays(
                kept, names=[*piece.schema.names[:-1], "score", "offending"]
            )

    rest, own = docs.drop("score", "offending"), free_name(docs, "_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.withColumn(own, text_of(docs, text)).mapInArrow(
        score, f"{schema}, score double, offending {SPANS}"
    )
