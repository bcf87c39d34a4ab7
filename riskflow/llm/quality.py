"""Quality classifier: logistic regression on hashed word n-grams, fitted by FTRL.

Every word enters as itself and as its shape (case, marks at its end, length,
whether it repeats the word before), as single words, pairs and, for shapes,
triples. A document's feature is the share of its n-grams that hash to it, so a
score is a sparse dot product of counts and weights and does not grow with
length. The follow-the-regularised-leader updates run over at most
``TRAINING_ROWS`` labelled documents, in the order of a hash of their id.

Defined cases: a null text is empty; an empty text gets the score of the bias
alone; without labelled rows every score is 0.5; a label given twice counts as
the larger; rows that repeat an id are scored each for itself; an empty table
gives an empty result. Neither labels nor any column but the text enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm import arrays as A
from riskflow.llm import linear
from riskflow.llm.common import free_name, text_of, workers_can_import

#: A document is accepted from this score on.
THRESHOLD = 0.3
PASSES = 3
#: The bias has its own place, before the hashed ones.
_SIZE = linear.DIMENSIONS + 1


def _shapes(raw, starts, ends, hashes, docs):
    """A small number for what each word looks like."""

    def count(mask):
        running = np.concatenate(([0], np.cumsum(mask)))
        return running[ends] - running[starts]

    letters = raw | 32
    letter = ((letters >= 97) & (letters <= 122)) | (raw >= 128)
    upper = (raw >= 65) & (raw <= 90)
    digit = (raw >= 48) & (raw <= 57)
    marks = np.minimum(count(~letter & ~digit), 3)
    length = np.minimum(np.log2(ends - starts).astype(np.int64), 7)
    again = np.zeros(len(starts), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
    end = raw[ends - 1].astype(np.int64)
    end = np.where(letter[ends - 1], 0, end)
    parts = (np.minimum(count(upper), 2), np.minimum(count(digit), 2), marks, length, again, end)
    code = np.zeros(len(starts), np.int64)
    for part, width in zip(parts, (3, 3, 4, 8, 2, 256), strict=True):
        code = code * width + part
    return A.mixed(code.astype(np.uint64) + np.uint64(1))


def _grams(raw, offsets):
    """Pairs of (feature, document) arrays, one pair per kind of n-gram."""
    starts, ends, docs = A.words(raw, offsets)
    if not len(starts):
        return []
    hashes = A.Hasher(raw).spans(starts, ends)
    shapes = _shapes(raw, starts, ends, hashes, docs)
    found = []
    for k, (unit, longest) in enumerate(((hashes, 2), (shapes, 3))):
        gram = unit
        for n in range(1, longest + 1):
            if n > 1:
                gram = A.joined(gram[:-1], unit[n - 1 :])
            here = docs[: len(gram)]
            whole = here == docs[n - 1 :]
            place = A.mixed(gram[whole] + np.uint64(11 * k + n)) % np.uint64(linear.DIMENSIONS)
            found.append((place.astype(np.int64) + 1, here[whole]))
    return found


def _features(batches):
    """Sorted places and shares of each document, as bytes."""
    for piece, raw, offsets in A.pieces(batches, "text"):
        n = len(offsets) - 1
        parts = []
        for place, doc in _grams(raw, offsets):
            total = np.bincount(doc, minlength=n)
            pair, counts = np.unique(doc * _SIZE + place, return_counts=True)
            parts.append((pair, counts / total[pair // _SIZE]))
        pairs = np.concatenate([p for p, _ in parts] or [np.zeros(0, np.int64)])
        shares = np.concatenate([s for _, s in parts] or [np.zeros(0)])
        order = np.argsort(pairs, kind="stable")
        pairs, shares = pairs[order], shares[order]
        cuts = np.searchsorted(pairs, np.arange(n + 1) * _SIZE)
        places = (pairs % _SIZE).astype(np.int32)
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        yield pa.RecordBatch.from_pydict(
            {
                "order": piece.column("order"),
                "label": piece.column("label"),
                "places": [places[a:b].tobytes() for a, b in spans],
                "shares": [shares[a:b].astype(np.float32).tobytes() for a, b in spans],
            }
        )


def _follow_leader(rows, alpha=3.0, beta=1.0, l1=0.002, l2=0.02):
    """FTRL-proximal: one update per document, per-coordinate rates."""
    z, n = np.zeros(_SIZE), np.zeros(_SIZE)
    examples = []
    for row in rows:
        # The same place may come from several kinds of n-grams: add them up.
        places = np.frombuffer(row["places"], np.int32)
        shares = np.frombuffer(row["shares"], np.float32)
        first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1]))[: len(places)])
        if len(first):
            shares = np.add.reduceat(shares, first)
        examples.append(
            (
                np.concatenate(([0], places[first])),
                np.concatenate(([1.0], shares)),
                row["label"],
            )
        )

    def weights(z, n):
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n)) / alpha + l2)

    for _ in range(PASSES):
        for places, shares, label in examples:
            w = weights(z[places], n[places])
            gap = 1 / (1 + np.exp(-np.clip(w @ shares, -35, 35))) - label
            gradient = gap * shares
            grown = n[places] + gradient**2
            z[places] += gradient - (np.sqrt(grown) - np.sqrt(n[places])) / alpha * w
            n[places] = grown
    return weights(z, n)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    learn: Column | None = None,
    rows: int = linear.TRAINING_ROWS,
    text: str = "text",
    id: str = "doc_id",
) -> np.ndarray:
    """Weights learnt from at most ``rows`` of the labels that ``learn`` admits."""
    learn = F.lit(True) if learn is None else learn
    known = linear.sample(docs, labels, label, learn, rows, text, id)
    return linear.fitted(known, _features, "places binary, shares binary", _follow_leader)


def scored(
    docs: DataFrame, model: np.ndarray, text: str = "text", name: str = "score"
) -> DataFrame:
    """All columns of the documents and the score, which replaces one of its name."""
    spark = workers_can_import(docs.sparkSession).sparkContext
    shared = spark.broadcast(model)

    def score(batches):
        weights = shared.value.astype(np.float64)
        for piece, raw, offsets in A.pieces(batches, own):
            n = len(offsets) - 1
            total = np.full(n, weights[0])
            for place, doc in _grams(raw, offsets):
                count = np.maximum(np.bincount(doc, minlength=n), 1)
                total += A.group_sums(weights[place], doc, n) / count
            kept = [piece.column(c) for c in range(piece.num_columns - 1)]
            kept.append(pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35)))))
            yield pa.RecordBatch.from_arrays(kept, names=[*piece.schema.names[:-1], name])

    rest, own = docs.drop(name), free_name(docs, "_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.withColumn(own, text_of(docs, text)).mapInArrow(score, f"{schema}, `{name}` double")
