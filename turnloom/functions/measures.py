"""Small numeric and set measures."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from turnloom import constants as K


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def concentration(mentions: Column, convos: Column) -> Column:
    return F.when(mentions <= 0, 0.0).otherwise(1.0 - convos / mentions)


def is_concentrated(mentions: Column, convos: Column, max_convos: int = K.TRIGGER_CONVOS_MAX,
                    minimum: float = K.CONCENTRATION_MIN) -> Column:
    return ((mentions > 0) & (convos > 0) & (convos < max_convos)
            & (concentration(mentions, convos) > minimum))


def minmax(value: Column, over: WindowSpec) -> Column:
    """Scale to [0, 1] within the window; 1 everywhere when all values agree."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high - low < 1e-12, 1.0).otherwise((value - low) / (high - low))
