"""Substring dedup: windows of words that an earlier document has are removed.

Windows of ``WINDOW`` consecutive words travel as super-k-mers (see ``superkmers``) to
the bucket of their minimiser, a gram of ``GRAM`` words. In a bucket, equal strings are
joined, and windows of the strings that still differ are sorted and counted exactly, by
their bytes. A word goes if a window over it also starts in a document with a smaller
id, judged on the input.

Defined cases: a null text is empty; texts shorter than a window keep all words; a
null id is smaller than every id; rows that share an id are no smaller than each
other, and rows that share id and text get the same result; windows do not cross
documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm import arrays as A
from riskflow.llm import superkmers as K
from riskflow.llm.common import NULL_ID

WINDOW = 13
GRAM = 3


def spaced(raw, starts, ends):
    """The words one after the other, each followed by a space, and where each begins and ends."""
    length = ends - starts + 1
    to = np.cumsum(length)
    take = np.repeat(starts - (to - length), length) + np.arange(to[-1] if len(to) else 0)
    flat = np.append(raw, np.uint8(32))[take]
    flat[to - 1] = 32
    return flat, to - length, to - 1


def _read(raw, offsets) -> K.Units:
    starts, ends, docs = A.words(raw, offsets)
    flat, left, right = spaced(raw, starts, ends)
    hashes = A.Hasher(flat).spans(left, right)
    grams = hashes
    for n in range(1, GRAM):
        grams = A.joined(grams[: len(hashes) - n], hashes[n:]) if len(hashes) > n else grams[:0]
    return K.Units(flat, left, right, docs, grams)


def _sorted_windows(runs: K.Runs, window: int):
    """Every window's run, place in it, and class: sorted by its bytes, equal ones adjacent."""
    found = []
    ends = np.cumsum(runs.size).tolist()
    for run, (begin, end) in enumerate(zip(runs.begins().tolist(), ends, strict=True)):
        words = runs.text[begin:end].split(b" ")
        found += [
            (b" ".join(words[at : at + window]), run, at) for at in range(len(words) - window + 1)
        ]
    found.sort()
    classes, last = [], None
    for content, _, _ in found:
        classes.append(classes[-1] + (content != last) if classes else 0)
        last = content
    run = np.array([f[1] for f in found], np.int64)
    return run, np.array([f[2] for f in found], np.int64), np.array(classes, np.int64)


def cleaned(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, kept (words joined by spaces), removed (spans of words)."""
    rows = K.identified(docs, text, id)
    spans = K.repeated_spans(rows, _read, _sorted_windows, WINDOW, GRAM, K.earlier_document)

    def cut(batches):
        for piece, raw, offsets in A.pieces(batches, "text"):
            n = len(offsets) - 1
            starts, ends, docs = A.words(raw, offsets)
            flat, left, right = spaced(raw, starts, ends)
            zeros = np.searchsorted(docs, np.arange(n + 1))
            gone = K.covered(piece.column("spans"), zeros[:-1], len(docs))
            kept = flat[np.repeat(~gone, right - left + 1)].tobytes()
            size = np.where(gone, 0, right - left + 1)
            at = np.concatenate(([0], np.cumsum(size)))[zeros]
            first, end = K.edges_by_document(gone, docs)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(np.diff(zeros)),
                    pa.array([kept[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    K.span_lists(first, end, docs, zeros),
                ],
                names=["doc_id", "n_words", "kept", "removed"],
            )

    return (
        K.with_spans(rows, spans)
        .mapInArrow(cut, f"doc_id long, n_words long, kept binary, removed {K.SPAN_LIST}")
        .withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
        .withColumn("kept", F.decode("kept", "UTF-8"))
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["first"])
    return cleaned(docs).select(
        "doc_id", "n_words", length.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERY_SQL = """
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, unnest(list_transform(range(1, len(words) - 11),
      lambda i: md5_number(array_to_string(words[i:i + 12], ' ')))) AS content,
    unnest(range(1, len(words) - 11)) AS place
  FROM split WHERE len(words) >= 13
), gone AS (
  SELECT DISTINCT doc_id, place + step AS place
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY content) AS first_doc FROM windows), range(13) AS steps(step)
  WHERE first_doc < doc_id
), single AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split
), kept AS (
  SELECT w.doc_id, count(g.place) AS n_removed,
    string_agg(word, ' ' ORDER BY w.place) FILTER (g.place IS NULL) AS text
  FROM single w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.place = g.place GROUP BY w.doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""
