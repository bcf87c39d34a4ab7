"""Area under the ROC curve between two bounds, without sorting the scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow import schema as S

#: Cells of the first pass, and those that each undecided cell is cut into later.
CELLS = 4096
PARTS = 64
#: Undecided cells that one pass looks into, those with the most pairs first.
REFINED = 1024
PASSES = 3
#: The differences of scores must be finite.
FARTHEST = 1e300


@dataclass(frozen=True)
class Area:
    """The area lies between ``lower`` and ``upper``; NaN without rows of both classes."""

    lower: float
    upper: float

    @property
    def middle(self) -> float:
        return (self.lower + self.upper) / 2


@dataclass(frozen=True)
class _Cell:
    """Scores from ``low`` to ``high``, in the order of the scores; ``key`` tells where it lies."""

    key: tuple[int, ...]
    low: float
    high: float
    fraud: int
    others: int

    @property
    def pairs(self) -> int:
        return self.fraud * self.others

    @property
    def undecided(self) -> bool:
        return self.pairs > 0 and self.low < self.high


def _part(score: Column, low: Column, high: Column, parts: int) -> Column:
    """The part of the range that holds a score; monotone in the score."""
    part = F.floor((score - low) / (high - low) * parts).cast("int")
    return F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1))


def _cells(placed: DataFrame, keys: list[str]) -> list[_Cell]:
    """One aggregate; at most one row per cell comes back."""
    rows = placed.groupBy(*keys).agg(
        F.min("score").alias("low"),
        F.max("score").alias("high"),
        F.count_if("fraud").alias("n_fraud"),
        F.count_if(~F.col("fraud")).alias("n_others"),
    )
    return [
        _Cell(tuple(r[k] for k in keys), r["low"], r["high"], r["n_fraud"], r["n_others"])
        for r in rows.collect()
    ]


def auc_bounds(
    scored: DataFrame,
    score: str = "Fraud_Probability",
    label: str = S.LABEL,
    within: float = 1e-4,
    passes: int = PASSES,
) -> Area:
    """Bounds of the area, at most ``within`` apart unless the passes run out.

    The first pass counts both classes in ``CELLS`` cells of the scores' range. Pairs of
    rows from different cells are decided; so are those of a cell that holds one score
    or one class (equal scores count half). The others may go either way, which is the
    distance of the bounds. Further passes cut the undecided cells into parts and read
    only their rows. What is shuffled is a row per cell and task; nothing is sorted.

    Rows whose score is null or NaN take no part, and infinite scores count as
    ``FARTHEST``. A null label is not fraud.
    """
    finite = F.greatest(F.least(F.col(score).cast("double"), F.lit(FARTHEST)), F.lit(-FARTHEST))
    rows = scored.filter(F.col(score).isNotNull() & ~F.isnan(score)).select(
        finite.alias("score"),
        F.coalesce(F.col(label) == 1, F.lit(False)).alias("fraud"),
    )
    ends = rows.agg(F.min("score"), F.max("score")).first()
    if ends[0] is None:
        return Area(float("nan"), float("nan"))
    if ends[0] == ends[1]:
        placed = rows.withColumn("_0", F.lit(0))
    else:
        placed = rows.withColumn("_0", _part(F.col("score"), F.lit(ends[0]), F.lit(ends[1]), CELLS))
    keys = ["_0"]
    cells = _cells(placed, keys)
    fraud, others = sum(c.fraud for c in cells), sum(c.others for c in cells)
    total = fraud * others
    if not total:
        return Area(float("nan"), float("nan"))
    for level in range(1, passes):
        undecided = [c for c in cells if c.undecided]
        if sum(c.pairs for c in undecided) <= within * total:
            break
        # Cells that an earlier pass left out are not looked into again.
        last = sorted((c for c in undecided if len(c.key) == level), key=lambda c: -c.pairs)
        chosen = last[:REFINED]
        known = placed.sparkSession.createDataFrame(
            [(*c.key, c.low, c.high) for c in chosen],
            ", ".join([*(f"{k} int" for k in keys), "_low double", "_high double"]),
        )
        # At most REFINED rows.
        inside = placed.join(F.broadcast(known), keys)
        part = _part(F.col("score"), F.col("_low"), F.col("_high"), PARTS)
        placed = inside.withColumn(f"_{level}", part).drop("_low", "_high")
        done = {c.key for c in chosen}
        rest = [c for c in cells if c.key not in done]
        keys = [*keys, f"_{level}"]
        cells = rest + _cells(placed, keys)
    lower = upper = 0.0
    below = 0
    for cell in sorted(cells, key=lambda c: (c.low, c.high)):
        pairs = cell.pairs
        sure = cell.fraud * below
        lower += sure + (0 if cell.undecided else pairs / 2)
        upper += sure + (pairs if cell.undecided else pairs / 2)
        below += cell.others
    return Area(lower / total, upper / total)
