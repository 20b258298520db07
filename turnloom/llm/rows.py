"""Carrying a user's columns through joins and tasks without meeting their names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Carried:
    """The columns of ``df`` but those in ``without`` (in any case of letters), packed into one struct while an operator works."""

    def __init__(self, df: DataFrame, without: Iterable[str] = ()):
        left_out = {name.lower() for name in without}
        self.names = [c for c in df.columns if c.lower() not in left_out]

    def packed(self, alias: str = "row") -> Column:
        fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(self.names)]
        return F.struct(*fields, F.lit(0).alias("last")).alias(alias)

    def columns(self, of: str = "row") -> list[Column]:
        return [F.col(of)[f"c{i}"].alias(c) for i, c in enumerate(self.names)]
