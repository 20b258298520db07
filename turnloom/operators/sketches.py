"""Distinct counts that merge: sketches of bounded size per period, added up without reading the rows again.

A count of distinct values has to see all rows of a group again when a period is added. A sketch (HyperLogLog, 2^``lg``
registers) holds a few kilobytes whatever it has seen, and sketches of periods merge into the sketch of all. Estimates
deviate by about 1.04 / sqrt(2^lg): 1.6 % for the default, and hardly at all for small sets. ``approximate`` is also an
option of the exact operators: ``entity_rollup(mentions, distinct=sketches.approximate())``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG = 12


def _sketch(column: str, lg: int) -> Column:
    return F.hll_sketch_agg(F.col(column).cast("string"), F.lit(lg))


def error(lg: int = LG) -> float:
    """One standard error of an estimate, as a share of the count."""
    return 1.04 / 2 ** (lg / 2)


def approximate(lg: int = LG) -> Callable[[str], Column]:
    """A stand-in for ``count_distinct`` with a sketch of 2^lg registers; like it, it passes over nulls."""
    return lambda column: F.coalesce(F.hll_sketch_estimate(_sketch(column, lg)), F.lit(0).cast("bigint"))


def by_period(rows: DataFrame, keys: Sequence[str], column: str, period: str = "day", lg: int = LG) -> DataFrame:
    """``period, keys, n, sketch``: rows and the sketch of ``column`` in each period; to be stored, a period at a time."""
    return rows.groupBy(period, *keys).agg(F.count("*").alias("n"), _sketch(column, lg).alias("sketch"))


def merged(periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, n, distinct`` over all periods of ``by_period``; sketches of different sizes merge to the smaller one."""
    return periods.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(True))).alias("distinct"))
