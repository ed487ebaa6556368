"""Exact interpolated percentiles whose memory need does not grow with the data."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.session import stored_copy

QUARTILES = (0.25, 0.5, 0.75)
BUCKETS = 2_048
#: Size of the sketch, and how far from the wanted share its answer may be: three times its usual error.
SKETCH = 2_048
MARGIN = 0.005


@dataclass(frozen=True)
class Spread:
    """What the search needs to know about a column beforehand."""

    rows: int
    low: float | None
    high: float | None
    #: For each fraction, in order, the sketch's values a margin below and above it.
    bounds: tuple[tuple[float, float], ...] = ()

    @staticmethod
    def columns(x: Column, fractions: tuple[float, ...] = QUARTILES) -> list[Column]:
        """Aggregates for one pass over the data, to be handed to :meth:`of`."""
        shares = [min(1.0, max(0.0, q + side)) for q in sorted(fractions) for side in (-MARGIN, MARGIN)]
        sketch = F.kll_sketch_agg_double(x, SKETCH)
        # The sketch leaves out NaN, and an empty one has no quantiles.
        some = F.count_if(~F.isnan(x)) > 0
        asked = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(s) for s in shares]))
        return [
            F.count(x).alias("_rows"),
            F.min(x).alias("_low"),
            F.max(x).alias("_high"),
            F.when(some, asked).alias("_bounds"),
        ]

    @staticmethod
    def of(row) -> Spread:
        found = row["_bounds"] or []
        return Spread(row["_rows"], row["_low"], row["_high"], tuple(zip(found[::2], found[1::2], strict=True)))

    def ranges(self, ranks: list[int]) -> list[_Range]:
        """The sketch's brackets, and what lies between them. Of the gaps only the rows are counted at
        first; a rank that lies in one after all is searched there."""
        merged: list[list[float]] = []
        for low, high in self.bounds:
            if merged and low <= merged[-1][1]:
                merged[-1][1:] = [max(high, merged[-1][1]), merged[-1][2] + 1]
            else:
                merged.append([low, high, 1])
        if not merged:
            return [_Range(self.low, self.high, self.rows, 0, tuple(ranks))]
        starts = [self.low, *(high for _, high, _ in merged)]
        ends = [*(low for low, _, _ in merged), self.high]
        gaps = [_Range(low, high, self.rows, None, ()) for low, high in zip(starts, ends, strict=True)]
        expected = 2 * MARGIN * self.rows
        return gaps + [_Range(low, high, int(n * expected), None, tuple(ranks)) for low, high, n in merged]


def exact_percentiles(
    df: DataFrame,
    column: str,
    fractions: tuple[float, ...] = QUARTILES,
    spread: Spread | None = None,
) -> list[float | None]:
    """Percentiles with linear interpolation between the two neighbouring ranks.

    The built-in ``percentile`` keeps every distinct value in one task. Here a quantile sketch, made in
    the pass that counts, brackets the wanted ranks; a second pass counts the rows outside the brackets
    and, for all ranks together, those per bucket inside. Where a bucket still holds several values, as
    in very large columns, further passes split it into ``BUCKETS`` parts. The result is exact whatever
    the sketch says. Without a ``spread`` (of the same ``fractions``) the column is stored first, once,
    and read for every pass. Infinite values and NaN (the largest) are ranked like any other.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    if spread is not None:
        return _interpolated(values, fractions, spread)
    with stored_copy(values, "percentiles") as copy:
        spread = Spread.of(copy.agg(*Spread.columns(F.col("v"), fractions)).first())
        return _interpolated(copy, fractions, spread)


def _interpolated(values: DataFrame, fractions: tuple[float, ...], spread: Spread) -> list[float | None]:
    if spread.rows == 0:
        return [None] * len(fractions)
    positions = [q * (spread.rows - 1) for q in fractions]
    ranks = sorted({r for p in positions for r in (math.floor(p), math.ceil(p))})
    at_rank = _values_at_ranks(values, ranks, spread)
    out = []
    for p in positions:
        low, high = at_rank[math.floor(p)], at_rank[math.ceil(p)]
        out.append(low if _same(low, high) else low + (high - low) * (p - math.floor(p)))
    return out


def _same(a: float, b: float) -> bool:
    return a == b or (math.isnan(a) and math.isnan(b))


@dataclass(frozen=True)
class _Range:
    """A range of values: rows inside (or about so many), rows below it where known, and the ranks
    to look for in it; without any it is one bucket."""

    low: float
    high: float
    rows: int
    below: int | None
    ranks: tuple[int, ...]

    def bucket(self) -> Column:
        """Number of the part a value falls into. Few rows, or a range finer than doubles can
        split, go by the value itself."""
        if not self.ranks:
            return F.lit(0.0)
        if not (math.isfinite(self.low) and math.isfinite(self.high)):
            return F.when(F.isnan("v") | F.abs("v").eqNullSafe(math.inf), F.col("v")).otherwise(0.0)
        width = self.high / BUCKETS - self.low / BUCKETS
        if self.rows <= BUCKETS or self.low + width == self.low:
            return F.col("v")
        return F.floor(F.col("v") / width - self.low / width).cast("double")


def _counted(values: DataFrame, ranges: list[_Range]) -> DataFrame:
    """Rows, least and greatest value per bucket of the ranges. Where ranges touch, the later one has the value."""
    which = bucket = F.lit(None)
    for i, r in enumerate(ranges):
        inside = F.col("v").between(r.low, r.high)
        which = F.when(inside, i).otherwise(which)
        bucket = F.when(inside, r.bucket()).otherwise(bucket)
    return (
        values.select("v", which.alias("which"), bucket.alias("bucket"))
        .filter("which IS NOT NULL")
        .groupBy("which", "bucket")
        .agg(F.count("v").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
    )


def _values_at_ranks(values: DataFrame, ranks: list[int], spread: Spread) -> dict[int, float]:
    """The value at each zero-based rank of the sorted column."""
    found: dict[int, float] = {}
    ranges = spread.ranges(ranks)
    while ranges:
        following, at, last = [], 0, None
        # A few thousand buckets at most, in order of value.
        for part in sorted(_counted(values, ranges).collect(), key=lambda p: (math.isnan(p.low), p.low)):
            if part.which != last and ranges[part.which].below is not None:
                at = ranges[part.which].below
            last = part.which
            wanted = tuple(r for r in ranks if at <= r < at + part.rows)
            if wanted and _same(part.low, part.high):
                found.update({r: part.low for r in wanted})
            elif wanted:
                following.append(_Range(part.low, part.high, part.rows, at, wanted))
            at += part.rows
        ranges = following
    return found
