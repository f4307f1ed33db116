"""Joining intervals that overlap, within a key of any size.

Intervals are half open. Each goes to every bin of a fixed width that it touches, bins of a
key meet by equality, and a pair is kept only in the bin where its later interval begins: so
it is found once, and a document of a million blocks spreads over as many tasks as it has bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins are so many times as wide as the mean interval of the side with the longer ones.
MEANS = 4


def bin_width(spans: DataFrame, span: tuple[str, str], ranges: DataFrame, rng: tuple[str, str]) -> int:
    """A width at which few intervals touch more than two bins."""
    mean = [df.agg(F.avg(F.col(e) - F.col(s))).first()[0] or 0 for df, (s, e) in ((spans, span), (ranges, rng))]
    return max(1, round(MEANS * max(mean)))


def overlapping(spans: DataFrame, ranges: DataFrame, by: list[str], span: tuple[str, str] = ("span_start", "span_end"), rng: tuple[str, str] = ("range_start", "range_end"), width: int | None = None) -> DataFrame:
    """Pairs of a span and a range of one key that overlap: start < the other's end on both sides; ranges' key columns are left out.

    Null keys and ends meet nothing. Equal rows are pairs of their own. width: of a bin; found from the mean lengths if not given.
    """
    width = width or bin_width(spans, span, ranges, rng)

    def binned(df: DataFrame, ends: tuple[str, str], mark: str) -> DataFrame:
        start, last = F.col(ends[0]).cast("long"), F.col(ends[1]).cast("long") - 1
        low, high = _floor(start, width), F.greatest(_floor(start, width), _floor(last, width))
        there = df.where(F.col(ends[0]).isNotNull() & F.col(ends[1]).isNotNull())
        return there.withColumn(f"_low{mark}", low).withColumn("_bin", F.explode(F.sequence(low, high)))

    left, right = binned(spans, span, "_s"), binned(ranges, rng, "_r").withColumnsRenamed({k: f"_r_{k}" for k in by})
    on = (left["_bin"] == right["_bin"]) & (F.col(span[0]) < F.col(rng[1])) & (F.col(span[1]) > F.col(rng[0])) & (left["_bin"] == F.greatest("_low_s", "_low_r"))
    for k in by:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(right, on).drop("_bin", "_low_s", "_low_r", *[f"_r_{k}" for k in by])


def _floor(x: Column, width: int) -> Column:
    w = F.lit(width).cast("long")
    return ((x - F.pmod(x, w)) / w).cast("long")
