"""Keys at given ranks of any order, without sorting the table: sampled splitters with exact counts.

The interval around each wanted rank is narrowed pass by pass. A pass draws keys of the open intervals by a hash (about
``SAMPLE`` an interval, whatever its size), takes a few of them around the expected place of the rank as
splitters, and counts the rows between the splitters exactly. The count says in which gap the rank lies, so a
sample that misses costs another pass, never a wrong key. A gap that holds no more than ``SAMPLE`` rows is read back.
With ten intervals a pass returns some ten thousand keys to the driver at most, and a gap is about a hundredth of the
interval before: a table of 10^12 rows takes five passes over its key columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

SAMPLE = 4_096
_SPACE = 1 << 30
_ORDERED = (Ty.IntegralType, Ty.StringType, Ty.DecimalType, Ty.DateType, Ty.BooleanType, Ty.FractionalType, Ty.BinaryType)


@dataclass(frozen=True)
class _Gap:
    """Rows with keys strictly between ``low`` and ``high`` (None: no bound): ``rows`` of them after ``before`` others."""

    low: Row | None
    high: Row | None
    before: int
    rows: int

    def holds(self, rank: int) -> bool:
        return self.before <= rank < self.before + self.rows


def _wall_micros(time: Column) -> Column:
    seconds = F.unix_date(time.cast("date")).cast("bigint") * 86_400 + F.hour(time) * 3_600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")


class Order:
    """The order by several columns of a table, first column first. Rows with a null in any of them have no place."""

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.names, self.types, parts = [], [], []
        for number, name in enumerate(columns):
            kind = df.schema[name].dataType
            part = F.col(f"`{name}`")
            # Times are read back and compared as numbers, whatever the time zone of the session.
            if isinstance(kind, Ty.TimestampType):
                part, kind = F.unix_micros(part), Ty.LongType()
            elif isinstance(kind, Ty.TimestampNTZType):
                part, kind = _wall_micros(part), Ty.LongType()
            elif not isinstance(kind, _ORDERED):
                raise TypeError(f"no order for '{name}' of type {kind.simpleString()}")
            self.names.append(f"k{number}")
            self.types.append(kind)
            parts.append(part.alias(self.names[-1]))
        self.known = reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in columns))
        self.key = F.struct(*parts)
        self.keys = df.filter(self.known).select(*parts)

    def at(self, key: Row) -> Column:
        return F.struct(*[F.lit(key[n]).cast(t).alias(n) for n, t in zip(self.names, self.types)])

    def inside(self, gap: _Gap) -> Column:
        key, bounds = F.struct(*self.names), []
        if gap.low is not None:
            bounds.append(key > self.at(gap.low))
        if gap.high is not None:
            bounds.append(key < self.at(gap.high))
        return reduce(lambda a, b: a & b, bounds, F.lit(True))


def _sampled(order: Order, gaps: list[_Gap], seed: int) -> dict[int, list[Row]]:
    """Keys of each gap in order, with their number of rows: all of a small gap, about ``SAMPLE`` of a large one.

    Equal keys share a hash and are drawn together; the key of the smallest hash is always drawn.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), *order.names), F.lit(_SPACE))
    number = reduce(lambda chain, i: chain.when(order.inside(gaps[i]), i), range(1, len(gaps)),
                    F.when(order.inside(gaps[0]), 0))
    share = F.element_at(F.array(*[F.lit(_SPACE if g.rows <= SAMPLE else SAMPLE * _SPACE // g.rows) for g in gaps]),
                         F.col("gap") + 1)
    rows = order.keys.select(number.alias("gap"), *order.names).filter("gap IS NOT NULL")
    drawn = rows.filter(draw < share).groupBy("gap", *order.names).count()
    found: dict[int, list[Row]] = {}
    for row in drawn.orderBy("gap", *order.names).collect():  # sorted by Spark, so its own order of the types holds
        found.setdefault(row.gap, []).append(row)
    # Few keys with very many rows each may all escape the draw.
    missed = [i for i in range(len(gaps)) if i not in found]
    if missed:
        for row in rows.filter(F.col("gap").isin(missed)).groupBy("gap").agg(
                F.min_by(F.struct(*order.names), draw).alias("key")).collect():
            found[row.gap] = [row.key]
    return found


def _splitters(gap: _Gap, keys: list[Row], ranks: list[int]) -> list[Row]:
    """Sampled keys around the expected places of the ranks, closer together next to them."""
    scatter = max(1, int(len(keys) ** 0.5 / 2))
    places = set()
    for rank in ranks:
        expected = (rank - gap.before) * len(keys) // gap.rows
        places |= {expected + side * scatter * step // 2 for side in (-1, 1) for step in (0, 1, 2, 4, 8)}
    return [keys[p] for p in sorted({min(max(p, 0), len(keys) - 1) for p in places})]


def _counted(order: Order, cuts: list[tuple[_Gap, list[Row]]]) -> list[_Gap | tuple[Row, int, int]]:
    """Gaps between the splitters of each gap, and the splitters themselves as (key, before, rows), counted exactly."""
    key = F.struct(*order.names)
    cell = None
    for number, (gap, splitters) in enumerate(cuts):
        # 0 before the first splitter, 1 at it, 2 after it, and so on.
        place = reduce(lambda total, s: total + F.when(key > order.at(s), 2).when(key == order.at(s), 1).otherwise(0),
                       splitters, F.lit(0))
        value = F.struct(F.lit(number).alias("gap"), place.alias("place"))
        cell = F.when(order.inside(gap), value) if cell is None else cell.when(order.inside(gap), value)
    counts = {(r.at.gap, r.at.place): r["count"] for r in
              order.keys.groupBy(cell.alias("at")).count().filter("at IS NOT NULL").collect()}
    parts: list[_Gap | tuple[Row, int, int]] = []
    for number, (gap, splitters) in enumerate(cuts):
        before = gap.before
        for place in range(2 * len(splitters) + 1):
            rows = counts.get((number, place), 0)
            if place % 2:
                parts.append((splitters[place // 2], before, rows))
            else:
                low = splitters[place // 2 - 1] if place else gap.low
                high = splitters[place // 2] if place // 2 < len(splitters) else gap.high
                parts.append(_Gap(low, high, before, rows))
            before += rows
    return parts


def keys_at(order: Order, ranks: Sequence[int], n: int) -> list[Row]:
    """Keys at the 0-based ``ranks`` among the ``n`` rows that have a key. Rows with equal keys follow each other."""
    if any(not 0 <= rank < n for rank in ranks):
        raise ValueError(f"ranks must lie in 0 to {n - 1}")
    found: dict[int, Row] = {}
    gaps, seed = {rank: _Gap(None, None, 0, n) for rank in ranks}, 0
    while gaps:
        seed += 1
        open_gaps = sorted(set(gaps.values()), key=lambda g: g.before)
        sampled = _sampled(order, open_gaps, seed)
        cuts = []
        for number, gap in enumerate(open_gaps):
            keys, asked = sampled[number], sorted(r for r, g in gaps.items() if g == gap)
            if gap.rows <= SAMPLE:  # every key with its number of rows is here
                before = gap.before
                for key in keys:
                    found.update({r: key for r in asked if before <= r < before + key["count"]})
                    before += key["count"]
            else:
                cuts.append((gap, _splitters(gap, keys, asked)))
        gaps = {rank: gap for rank, gap in gaps.items() if rank not in found}
        if not cuts:
            continue
        for part in _counted(order, cuts):
            if isinstance(part, _Gap):
                gaps.update({r: part for r in gaps if part.holds(r)})
            else:
                key, before, rows = part
                found.update({r: key for r in gaps if before <= r < before + rows})
        gaps = {rank: gap for rank, gap in gaps.items() if rank not in found}
    return [found[rank] for rank in ranks]
