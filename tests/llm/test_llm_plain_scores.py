"""The two text classifiers' scores, and their features, in plain Python integers."""

import math

import numpy as np
import pytest
from llm_cases import documents, odd_documents, words

from riskflow.llm import linear, quality, toxicity

ALL = 2**64 - 1
BASE = 0x9E3779B97F4A7C15
DOCS = [
    "One TWO two two, (three) 4four! 55\nsix? seven... Eight-nine ünï 中文 😀!",
    "a a a. A a! ?? !! ..\n\n.hello. 'Quoted words' and unforgettably long ones.",
]


def mix(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & ALL
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & ALL
    return h ^ (h >> 31)


def hashed(word):
    return mix(sum((b + 1) * pow(BASE, k, 2**64) for k, b in enumerate(word)) & ALL)


def joined(left, right):
    return mix(left * 3 + (right ^ (right >> 32)) * 0xD6E8FEB86659FD93 & ALL)


def is_letter(b):
    return b >= 128 or 97 <= b | 32 <= 122


def shape(word, again):
    digits = sum(48 <= b <= 57 for b in word)
    marks = sum(not is_letter(b) and not 48 <= b <= 57 for b in word)
    parts = (
        (min(sum(65 <= b <= 90 for b in word), 2), 3),
        (min(digits, 2), 3),
        (min(marks, 3), 4),
        (min(int(math.log2(len(word))), 7), 8),
        (int(again), 2),
        (0 if is_letter(word[-1]) else word[-1], 256),
    )
    code = 0
    for part, width in parts:
        code = code * width + part
    return mix(code + 1)


def plain_quality(text, weights):
    found = [w.encode() for w in words(text)]
    units = [hashed(w) for w in found]
    shapes = [shape(w, n and found[n - 1] == w) for n, w in enumerate(found)]
    odds = float(weights[0])
    for kind, (unit, longest) in enumerate(((units, 2), (shapes, 3))):
        grams = unit
        for n in range(1, longest + 1):
            if n > 1:
                grams = [joined(a, b) for a, b in zip(grams, unit[n - 1 :])]  # noqa: B905
            places = [mix(g + 11 * kind + n & ALL) % linear.DIMENSIONS + 1 for g in grams]
            odds += sum(float(weights[p]) for p in places) / max(len(places), 1)
    return 1 / (1 + math.exp(-odds))


def is_solid(b):
    return is_letter(b) or 48 <= b <= 57


def plain_toxicity(text, weights):
    """The document's score, and that of each sentence with its bytes."""
    raw = (text or "").encode()
    sentences, at, before = [], 0, None
    for word in (w.encode() for w in words(text)):
        start = raw.index(word, at)
        if before is None or raw[before - 1] in b".!?" or b"\n" in raw[before:start]:
            sentences.append([])
        sentences[-1].append((start, word))
        at = before = start + len(word)
    scores = []
    for sentence in sentences:
        places, last = [], None
        for _, word in sentence:
            bare = bytes(b | 32 if 65 <= b <= 90 else b for b in word)
            solid = [k for k, b in enumerate(bare) if is_solid(b)]
            if solid:
                bare = bare[solid[0] : solid[-1] + 1]
            unit = hashed(bare)
            places.append(unit)
            if last is not None:
                places.append(joined(last, unit))
            places += [mix(hashed(bare[:n]) + n & ALL) for n in (4, 6, 8) if len(bare) > n]
            last = unit
        odds = float(weights[-1]) + sum(float(weights[p % linear.DIMENSIONS]) for p in places)
        p = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        scores.append((p, sentence[0][0], sentence[-1][0] + len(sentence[-1][1])))
    return 1 - math.prod(1 - p for p, *_ in scores), scores


@pytest.fixture(scope="module")
def weights():
    return np.random.default_rng(8).normal(0, 1, linear.DIMENSIONS + 1).astype(np.float32)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r[0], (r[1] or "")[:4000] if r[1] is not None else None, *r[2:]) for r in odd_documents()]
    rows += [(100 + n, text, "s", "en", 0) for n, text in enumerate(DOCS)]
    return documents(spark, rows)


def test_quality_scores(docs, weights):
    for r in quality.scored(docs, weights).collect():
        assert r["score"] == pytest.approx(plain_quality(r["text"], weights), abs=1e-9)


def test_toxicity_scores_and_spans(docs, weights):
    rare = weights.copy()
    rare[-1] = -6
    for r in toxicity.located(docs, rare).collect():
        score, sentences = plain_toxicity(r["text"], rare)
        assert r["score"] == pytest.approx(score, abs=1e-9)
        expected = [(a, b) for p, a, b in sentences if p >= toxicity.THRESHOLD]
        assert [(s["first"], s["end"]) for s in r["offending"]] == expected
