"""Suffix-array dedup: bytes under a 100-byte string that occurs earlier are removed.

The suffix array is dealt, not kept whole: every suffix goes to the bucket of the
minimiser of its first ``WINDOW`` bytes (a gram of ``GRAM`` bytes, see ``superkmers``), so
suffixes that agree that far meet. Strings that occur once in a bucket, and copies of
a whole string, are settled by comparing them. The suffixes of all others are sorted by
the difference-cover algorithm: triples at two of three places are sorted and named,
the names' string is sorted by the same algorithm until names reach ``WINDOW`` bytes,
the remaining suffixes are merged in by their first byte and what follows, and the
first ``WINDOW`` bytes of neighbours in that order are compared.

Only the order by the first ``WINDOW`` bytes matters, so the recursion has at most as
many levels as it takes for 3**level to reach that, and ties may stand in any order.

Defined cases: a null text is empty; texts shorter than a window stay whole; a null id
is smaller than every id; rows that share an id but not the text are neither earlier
nor later than each other, and rows that share both get the same result; strings do
not cross documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm import arrays as A
from riskflow.llm import superkmers as K
from riskflow.llm.common import NULL_ID

WINDOW = 100
GRAM = 16
#: Bytes of text sorted at once; all strings of a minimiser are sorted together.
SORTED = 1 << 19


def _packed(*columns: np.ndarray) -> np.ndarray:
    """One number per row of the columns, in the order of the rows."""
    key = columns[0]
    for column in columns[1:]:
        span = int(column.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * span >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * span + column
    return key


def _named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and the rank of each, from 1, equal ones alike."""
    order = np.argsort(key, kind="stable")
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(np.concatenate(([1], np.diff(key[order]) != 0)))[: len(key)]
    return order, names


def _order(ranks: np.ndarray) -> np.ndarray:
    """What stands in the order of the ranks; no sort if all differ."""
    if ranks.max() < len(ranks):
        return np.argsort(ranks, kind="stable")
    order = np.empty(len(ranks), np.int64)
    order[ranks - 1] = np.arange(len(ranks))
    return order


def suffix_ranks(text: np.ndarray, reach: int) -> np.ndarray:
    """Ranks that order all suffixes of ``text`` (positive integers) by ``reach`` symbols at least.

    Suffixes that agree that far stand next to each other, in any order.
    """
    n = len(text)
    s = np.concatenate((text, np.zeros(3, np.int64)))
    if n < 4 or reach <= 1:
        return _named(_packed(*(s[k : k + n] for k in range(max(1, min(reach, n))))))[1]
    ones, twos, zeros = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate((ones, twos))
    order, names = _named(_packed(s[sample], s[sample + 1], s[sample + 2]))
    if reach > 3 and names.max() < len(names):
        # The names of the first class, an end, and those of the second.
        word = np.concatenate((names[: len(ones)] + 1, [1], names[len(ones) :] + 1))
        order = _order(suffix_ranks(word, -(-reach // 3)))
        order = order[order != len(ones)]
        order = order - (order > len(ones))
    # Sampled suffixes in order, and the place of each from 1.
    sampled = sample[order]
    place = np.zeros(n + 3, np.int64)
    place[sampled] = np.arange(1, len(sampled) + 1)

    # The others, by first symbol and the sampled suffix after it; then merged in by how
    # many sampled suffixes are smaller. The sampled ones are in order already.
    key = _packed(s[zeros], place[zeros + 1])
    zeros = zeros[np.argsort(key, kind="stable")]
    below = np.zeros(len(zeros), np.int64)
    for class_, width in ((sampled[sampled % 3 == 1], 1), (sampled[sampled % 3 == 2], 2)):
        both = np.concatenate((zeros, class_))
        key = _packed(*(s[both + k] for k in range(width)), place[both + width])
        below += np.searchsorted(key[len(zeros) :], key[: len(zeros)], "left")
    below = np.maximum.accumulate(below) if len(below) else below
    result = np.empty(n, np.int64)
    result[zeros] = below + np.arange(1, len(zeros) + 1)
    ahead = np.cumsum(np.bincount(below, minlength=len(sampled) + 1))
    result[sampled] = np.arange(1, len(sampled) + 1) + ahead[: len(sampled)]
    return result


def _same_prefix(text: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` bytes at each pair of places are equal."""
    wide = np.lib.stride_tricks.sliding_window_view(text, 4).copy().view(np.uint32)[:, 0]
    same = np.ones(len(left), bool)
    for at in [*range(0, size - 3, 4), size - 4]:
        alive = np.flatnonzero(same)
        same[alive] = wide[left[alive] + at] == wide[right[alive] + at]
    return same


def _windows_of(runs: K.Runs, chosen: np.ndarray, window: int):
    """Suffix-sorts the strings of the chosen runs: run, place and class of each window."""
    size = runs.size[chosen]
    text = np.frombuffer(runs.text, np.uint8)
    room = size + 1
    to = np.cumsum(room) - room
    take = np.repeat(runs.begins()[chosen] - to, room) + np.arange(room.sum())
    joined = text[np.minimum(take, len(text) - 1)].astype(np.int64) + 2
    joined[to + size] = 1
    order = _order(suffix_ranks(joined, window))
    # Only suffixes that begin a window of their string are of interest.
    string = np.repeat(np.arange(len(chosen)), room)
    offset = np.arange(len(joined)) - to[string]
    place = order[(offset <= size[string] - window)[order]]
    run, at = string[place], offset[place]
    raw = (joined - 2).astype(np.uint8)
    new = np.ones(len(place), bool)
    if len(place) > 1:
        new[1:] = ~_same_prefix(raw, place[:-1], place[1:], window)
    return chosen[run], at, np.cumsum(new)


def _suffix_sorted(runs: K.Runs, window: int):
    """Classes of equal windows, some minimisers' strings at a time."""
    edge = np.flatnonzero(np.concatenate(([True], runs.key[1:] != runs.key[:-1], [True])))
    total = np.concatenate(([0], np.cumsum(runs.size)))
    found, last, begin = [], 0, 0
    while begin < len(edge) - 1:
        end = int(np.searchsorted(total[edge], total[edge[begin]] + SORTED, "right")) - 1
        end = max(end, begin + 1)
        run, at, cls = _windows_of(runs, np.arange(edge[begin], edge[end]), window)
        found.append((run, at, cls + last))
        last += int(cls.max(initial=0))
        begin = end
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _read(raw, offsets) -> K.Units:
    places = np.arange(len(raw))
    grams = A.Hasher(raw).grams(GRAM) if len(raw) >= GRAM else np.zeros(0, np.uint64)
    return K.Units(raw, places, places + 1, A.owner(offsets, places), grams)


def cleaned(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, kept (bytes), removed (spans of bytes)."""
    rows = K.identified(docs, text, id)
    spans = K.repeated_spans(rows, _read, _suffix_sorted, WINDOW, GRAM, K.earlier_start)

    def cut(batches):
        for piece, raw, offsets in A.pieces(batches, "text"):
            gone = K.covered(piece.column("spans"), offsets[:-1], len(raw))
            docs = A.owner(offsets, np.arange(len(raw)))
            kept = raw[~gone].tobytes()
            at = np.concatenate(([0], np.cumsum(~gone)))[offsets]
            first, last = K.edges_by_document(gone, docs)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array([kept[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    K.span_lists(first, last, docs, offsets),
                ],
                names=["doc_id", "n_bytes", "kept", "removed"],
            )

    return (
        K.with_spans(rows, spans)
        .mapInArrow(cut, f"doc_id long, n_bytes long, kept binary, removed {K.SPAN_LIST}")
        .withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["first"])
    return cleaned(docs).select(
        "doc_id",
        "n_bytes",
        length.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
