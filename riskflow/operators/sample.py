"""A bounded sample per class that depends on the rows' keys alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import schema as S
from riskflow.functions import split_hash

_HALF = 16


@dataclass(frozen=True)
class _Bound:
    """Rows of a class up to a hash: all below ``hash``, and ``ties`` of those at it."""

    hash: int
    ties: int


def _first(cells: list[tuple[int, int]], rows: int) -> tuple[int, int] | None:
    """The cell in which the ``rows``-th row lies, and how many rows come before it."""
    before = 0
    for cell, n in sorted(cells):
        if before + n >= rows:
            return cell, before
        before += n
    return None


def _counts(df: DataFrame, cell: Column) -> dict[bool, list[tuple[int, int]]]:
    """Rows per class and cell, of which there are at most 65,536 each."""
    found: dict[bool, list[tuple[int, int]]] = {}
    for row in df.groupBy("fraud", cell.alias("cell")).count().collect():
        found.setdefault(row["fraud"], []).append((row["cell"], row["count"]))
    return found


def stratified_sample(
    df: DataFrame, rows: int, key: str | None = None, label: str = S.LABEL
) -> DataFrame:
    """Of each class the ``rows`` rows with the least hashes of their key, or all it has.

    The hash has 32 bits. One aggregate counts both classes by its upper half, another
    one by the lower half of the one upper half in which the sample ends; after that
    each row is kept or not by its own hash, so the rows themselves are not moved or
    sorted. Only rows that share the very last hash are ranked, by key and content.
    Without a key the whole row is the key. A null key has no hash and is never chosen; a
    null label is not fraud. The columns stay as they are.
    """
    hashed = split_hash(F.xxhash64(*df.columns) if key is None else key)
    fraud = F.coalesce(F.col(label) == 1, F.lit(False))
    narrow = df.select(fraud.alias("fraud"), hashed.alias("hash")).filter("hash IS NOT NULL")
    upper = F.shiftright("hash", _HALF)
    bounds: dict[bool, _Bound] = {}
    ends = {
        kind: end
        for kind, cells in _counts(narrow, upper).items()
        if (end := _first(cells, rows)) is not None
    }
    if ends:
        at_end = F.lit(False)
        for kind, (cell, _) in ends.items():
            at_end |= (F.col("fraud") == kind) & (upper == cell)
        lower = _counts(narrow.filter(at_end), F.col("hash").bitwiseAND((1 << _HALF) - 1))
        for kind, (cell, before) in ends.items():
            last, inside = _first(lower[kind], rows - before)
            bounds[kind] = _Bound(cell << _HALF | last, rows - before - inside)

    whole = F.lit(False)
    for kind in (True, False):
        inside = hashed < bounds[kind].hash if kind in bounds else hashed.isNotNull()
        whole |= (fraud == kind) & inside
    sample = df.filter(whole)
    content = F.xxhash64(*df.columns)
    order = [content] if key is None else [F.col(key), content]
    for kind, bound in sorted(bounds.items()):
        at_bound = df.filter((fraud == kind) & (hashed == bound.hash))
        sample = sample.unionByName(at_bound.orderBy(*order).limit(bound.ties))
    return sample
