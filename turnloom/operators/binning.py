"""Assign rows to ``n_bins`` periods by row order, session order or time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from turnloom import constants as K
from turnloom.operators import splitters
from turnloom.scaling import materialize

TIME_COLUMNS = ("timestamp", "created_at", "date", "datetime", "ts")
STRATEGIES = ("row", "session", "timestamp")
# Counts read back per boundary and pass when looking for a boundary key.
_CELLS = 4096


@dataclass(frozen=True)
class Binning:
    """How periods were made."""

    strategy: str
    reason: str
    n_bins: int
    chronology: str

    def column(self) -> Column:
        return F.struct(F.lit(self.strategy).alias("strategy"), F.lit(self.reason).alias("reason"),
                        F.lit(self.n_bins).alias("n_bins"), F.lit(self.chronology).alias("chronology"))


def _time_column(df: DataFrame) -> str | None:
    return next((c for c in df.columns if c.lower() in TIME_COLUMNS), None)


def _session_column(df: DataFrame) -> str | None:
    for column in df.columns:
        if column.lower() == "session_id":
            return column
        if column.lower() == "conversation_id":
            rows, ids = df.agg(F.count("*"), F.count_distinct(column)).first()
            if ids < rows:
                return column
    return None


def pick_strategy(df: DataFrame) -> tuple[str, str]:
    """Strategy and reason, from the column names and whether a conversation id repeats."""
    time = _time_column(df)
    if time is not None:
        return "timestamp", f"found temporal column '{time}'"
    session = _session_column(df)
    if session is not None:
        return "session", f"found grouping column '{session}'"
    return "row", "no temporal or grouping column present, falling back to row order"


def keys_at_ranks(df: DataFrame, key: str, ranks: list[int], n: int, low: int, high: int) -> list[int]:
    """Values of the unique integer ``key`` at the given 0-based ranks, without sorting.

    Each pass cuts the interval around every wanted rank into a fixed number of cells, counts them
    with one aggregate and keeps the cell that holds the rank. A pass returns at most ``_CELLS``
    counts per boundary whatever the table's size, reads only the key column, and the interval
    filter reaches the scan. Raises where fewer keys than a rank asks for lie between ``low`` and ``high``;
    null keys have no rank.
    """
    wanted = {rank: (low, high, 0) for rank in set(ranks)}
    while any(lo < hi for lo, hi, _ in wanted.values()):
        open_intervals = sorted({(lo, hi) for lo, hi, _ in wanted.values() if lo < hi})
        value = F.col(key)
        cell, inside = None, F.lit(False)
        for number, (lo, hi) in enumerate(open_intervals):
            width = -(-(hi - lo + 1) // _CELLS)
            within = value.between(lo, hi)
            index = F.struct(F.lit(number).alias("interval"),
                             F.expr(f"(`{key}` - {lo}L) div {width}L").alias("cell"))
            cell = F.when(within, index) if cell is None else cell.when(within, index)
            inside = inside | within
        counted = df.filter(inside).groupBy(cell.alias("at")).count().select("at.*", "count").collect()
        cells = {}
        for row in sorted(counted):
            cells.setdefault(open_intervals[row.interval], []).append((row.cell, row["count"]))
        for rank, (lo, hi, before) in wanted.items():
            if lo == hi:
                continue
            width = -(-(hi - lo + 1) // _CELLS)
            for index, count in cells.get((lo, hi), ()):
                if rank < before + count:
                    start = lo + index * width
                    wanted[rank] = (start, min(start + width - 1, hi), before)
                    break
                before += count
            else:
                raise ValueError(f"no key at rank {rank} of '{key}'")
    return [wanted[rank][0] for rank in ranks]


def _bin_by_key(df: DataFrame, columns: Sequence[str], n_bins: int) -> Column:
    """Bin of each row when rows are laid out in the order of ``columns`` and cut into equal runs; null for a null key.

    One integer column needs counts alone; any other order takes sampled splitters as well.
    """
    if n_bins < 1:
        raise ValueError("n_bins must be >= 1")
    if len(columns) == 1 and isinstance(df.schema[columns[0]].dataType, Ty.IntegralType):
        return _bin_by_unique_key(df, columns[0], n_bins)
    order = splitters.Order(df, columns)
    n = order.keys.count()
    if n == 0 or n_bins == 1:
        return F.when(order.known, 0)
    starts = splitters.keys_at(order, [b * n // n_bins for b in range(1, n_bins)], n)
    return F.when(order.known, sum((F.when(order.key >= order.at(s), 1).otherwise(0) for s in starts), F.lit(0)))


def _bin_by_unique_key(df: DataFrame, key: str, n_bins: int) -> Column:
    """``_bin_by_key`` for one integer column."""
    n, low, high = df.agg(F.count(key), F.min(key), F.max(key)).first()
    known = F.col(key).isNotNull()
    if n == 0 or n_bins == 1:
        return F.when(known, 0)
    starts = keys_at_ranks(df, key, [b * n // n_bins for b in range(1, n_bins)], n, low, high)
    return F.when(known, sum((F.when(F.col(key) >= F.lit(start), 1).otherwise(0) for start in starts), F.lit(0)))


def _columns(order_by: str | Sequence[str]) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


def bin_by_rows(df: DataFrame, n_bins: int = K.N_BINS, order_by: str | Sequence[str] = "conversation_id") -> DataFrame:
    """Equal runs of rows in ``order_by`` order: one column or several that are unique together, of numbers, strings,
    dates or timestamps. Rows are not moved.

    Rows with a null in the key get a null day. Rows with equal keys share a day.
    """
    columns = _columns(order_by)
    return df.withColumn("day", _bin_by_key(df.select(*[f"`{c}`" for c in columns]), columns, n_bins).cast("int"))


def bin_by_session(df: DataFrame, n_bins: int = K.N_BINS, session_col: str = "session_id",
                   order_by: str | Sequence[str] | None = None) -> DataFrame:
    """Equal runs of sessions in order of first appearance; a session's rows share their day.

    ``order_by`` is a unique row order of one or several columns. Without it sessions are ordered by their own
    id, a number or a string, which needs no join at all. Rows without a session get a null day, and so
    does a session without a complete row key.
    """
    if session_col not in df.columns:
        raise KeyError(f"session column '{session_col}' not in the table")
    columns = [] if order_by is None else _columns(order_by)
    if columns in ([], [session_col]):
        ids = df.select(session_col).distinct()
        return df.withColumn("day", _bin_by_key(materialize(ids), [session_col], n_bins).cast("int"))
    if len(columns) == 1:
        first = F.min(columns[0])
    else:
        known = F.forall(F.array(*[F.col(f"`{c}`").isNull() for c in columns]), lambda missing: ~missing)
        first = F.min(F.when(known, F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(columns)])))
    sessions = df.groupBy(session_col).agg(first.alias("first_row"))
    if len(columns) > 1:
        sessions = sessions.select(session_col, "first_row.*")
    sessions = materialize(sessions)
    places = [c for c in sessions.columns if c != session_col]
    days = sessions.select(session_col, _bin_by_key(sessions.select(*places), places, n_bins).cast("int").alias("day"))
    return df.join(days.dropna(subset=[session_col]), session_col, "left")


def bin_by_timestamp(df: DataFrame, n_bins: int = K.N_BINS, time_col: str | None = None) -> DataFrame:
    """Equal-width, right-closed intervals between the first and last time.

    Unparseable or missing times get a null day; one constant time falls in the middle bin.
    """
    time_col = time_col or _time_column(df)
    if time_col is None:
        raise KeyError("no temporal column found")
    time = F.col(time_col)
    if isinstance(df.schema[time_col].dataType, Ty.StringType):
        time = F.try_to_timestamp(time)
    micros = F.unix_micros(time.cast("timestamp"))
    low, high = df.agg(F.min(micros), F.max(micros)).first()
    if low is None:
        raise ValueError(f"could not parse '{time_col}' as datetimes")
    if low == high:
        day = F.when(F.col("_micros").isNotNull(), (n_bins - 1) // 2)
    else:
        # The smallest bin whose right edge is not before the time, in whole numbers.
        cut = F.expr(f"((_micros - {low}L) * {n_bins}L - 1L) div {high - low}L")
        day = F.when(F.col("_micros").isNotNull(), F.greatest(cut, F.lit(0)))
    return df.withColumn("_micros", micros).withColumn("day", day.cast("int")).drop("_micros")


def assign_days(df: DataFrame, n_bins: int = K.N_BINS, strategy: str | None = None,
                order_by: str | Sequence[str] = "conversation_id") -> tuple[DataFrame, Binning]:
    """Add ``day``, choosing the strategy from the schema unless one is forced."""
    if strategy is None:
        strategy, reason = pick_strategy(df)
    elif strategy in STRATEGIES:
        reason = "forced by caller"
    else:
        raise ValueError(f"unknown strategy '{strategy}'")
    if strategy == "row":
        return bin_by_rows(df, n_bins, order_by), Binning(strategy, reason, n_bins, "synthetic_row_order")
    if strategy == "session":
        session = _session_column(df) or "session_id"
        return (bin_by_session(df, n_bins, session, order_by),
                Binning(strategy, reason, n_bins, f"session_order:{session}"))
    return bin_by_timestamp(df, n_bins), Binning(strategy, reason, n_bins, "wallclock")
