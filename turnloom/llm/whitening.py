"""Whitening of embeddings by an incremental eigendecomposition of their covariance.

1. The distinct integer vectors (the fit list) are dealt over tasks. A task keeps the eigendecomposition of its
   vectors' centred scatter, one rank-one update a vector (``spectrum``), and gives it as one row.
2. Rows are joined, ``FAN_IN`` at a time in separate tasks and level by level, again by rank-one updates.
3. The leading eigenvectors span a subspace; a pass over the fit list multiplies it by the covariance with exact
   means, and the small projected matrix gives refined components (Rayleigh-Ritz). Where a component's
   residual is not down to rounding, the residuals are added to the subspace and the pass repeats.

Counts, sums and deviations are integers throughout; only spectra and scores are floating point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm import vectors
from turnloom.llm.spectrum import Spectrum
from turnloom.llm.storage import stored

LIMIT = 1 << 44  # scaled entries from here on have no exact squares in a decimal, and count as non-finite
FAN_IN = 8
GUARD = 8  # eigenvectors kept beyond the components asked for
RESIDUAL = 1e-13  # of the largest eigenvalue: refined enough
ROUNDS = 6
_SPECTRUM = "part bigint, n bigint, mean array<double>, values array<double>, vectors array<double>"


def _row(part: int, s: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "part": pa.array([part], pa.int64()), "n": pa.array([s.n], pa.int64()), "mean": [s.mean], "values": [s.values],
        "vectors": [np.ascontiguousarray(s.vectors).reshape(-1)]})


def _spectra(batch) -> list[Spectrum]:
    return [Spectrum(n, np.array(m), np.array(v), np.array(u).reshape(len(m), len(m))) for n, m, v, u in zip(
        *(batch.column(c).to_pylist() for c in ("n", "mean", "values", "vectors")))]


def _totals(fit: DataFrame, dims: int) -> tuple[int, list[int], list[int]]:
    """Count, sums and sums of squares of the fit list, exact."""
    one = fit.select(F.posexplode("x").alias("j", "v"))
    wide = F.col("v").cast("decimal(20,0)")
    rows = one.groupBy("j").agg(F.count("*").alias("n"), F.sum(wide).alias("s"), F.sum(wide * wide).alias("q")).collect()
    found = {row.j: row for row in rows}
    return (found[0].n if found else 0, [int(found[j].s) for j in range(dims)] if found else [],
            [int(found[j].q) for j in range(dims)] if found else [])


def spectrum_of(fit: DataFrame, dims: int, base: np.ndarray) -> Spectrum:
    """The eigendecomposition of the centred scatter of ``x - base``, joined over all tasks."""
    def update(batches):
        s = Spectrum.empty(dims)
        for batch in batches:
            for x in (vectors.matrix(batch.column("x"), dims) - base).astype(float):
                s.add(x)
        if s.n:
            yield _row(TaskContext.get().partitionId(), s)

    def join(rows):
        parts = _spectra(rows.sort_by("part"))
        first = parts[0]
        for other in parts[1:]:
            first.join(other)
        return pa.Table.from_batches([_row(rows.column("group")[0].as_py(), first)])

    parts = fit.rdd.getNumPartitions()
    level = stored(fit.select("x").mapInArrow(update, _SPECTRUM), "whitening-spectra")
    while parts > 1:
        grouped = level.withColumn("group", F.expr(f"part div {FAN_IN}"))
        level = stored(grouped.groupBy("group").applyInArrow(join, _SPECTRUM), "whitening-spectra")
        parts = -(-parts // FAN_IN)
    return _spectra(level.toArrow())[0]


def _times_covariance(fit: DataFrame, base: np.ndarray, off: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """Covariance of the fit list times the columns of ``block``."""
    dims, width = block.shape

    def multiply(batches):
        total = np.zeros((dims, width))
        for batch in batches:
            x = (vectors.matrix(batch.column("x"), dims) - base).astype(float) - off
            total += x.T @ (x @ block)
        yield vectors.cells(total)

    return vectors.summed(fit.select("x").mapInArrow(multiply, vectors.cells_schema("double")), dims, width) / n


def _refined(fit, base, off, n, start: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of the covariance, by Rayleigh-Ritz steps."""
    block = np.linalg.qr(start)[0]
    values = directions = None
    for _ in range(ROUNDS):
        image = _times_covariance(fit, base, off, n, block)
        small = block.T @ image
        found, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-found, kind="stable")
        values, turn = found[order], turn[:, order]
        directions = block @ turn
        residual = image @ turn - directions * values
        sizes = np.linalg.norm(residual[:, :wanted], axis=0)
        if not len(sizes) or sizes.max() <= RESIDUAL * max(values[0], 0.0) * np.sqrt(len(off)):
            break
        more = residual[:, :wanted][:, sizes > 0]
        more = more / np.linalg.norm(more, axis=0)
        for _ in range(2):
            more = more - directions @ (directions.T @ more)
        u, s, _ = np.linalg.svd(more, full_matrices=False)
        more = u[:, s > 1e-8][:, :max(0, len(off) - directions.shape[1])]
        if not more.shape[1]:
            break
        block = np.linalg.qr(np.hstack([directions, more]))[0]
    return values[:wanted], directions[:, :wanted]


def deviations(x: np.ndarray, n: int, rest: list[int]) -> list[int]:
    """``sum((n * x_j - rest_j)**2)`` of each row, exact."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, rest), default=0)
    if most * most * max(len(rest), 1) < 1 << 63:
        y = n * x - np.array(rest, np.int64)
        return (y * y).sum(axis=1).tolist()
    y = x.astype(object) * n - np.array(rest, object)
    return (y * y).sum(axis=1).tolist()


def whiten(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = vectors.SCALE,
    shift: int = 1_000_000,
) -> DataFrame:
    """A row per usable vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``.

    ``x = floor(scale * c) + shift``; the covariance is that of the distinct ``x``, ``n`` of them. ``deviation`` is
    the exact ``sum((n*x - S)**2)`` as ``decimal(38,0)`` (null beyond that), ``whitened`` the centred ``x`` along the
    component over the root of its eigenvalue, ``explained`` the eigenvalue's share of the trace.

    * Left out are null and empty vectors, those with null or non-finite entries or entries of ``2**44`` or more after
      scaling, and those whose length is not the most frequent one (of equally frequent ones the largest).
    * Components without variance (fewer distinct vectors or directions than ``components``) have no rows; one
      distinct vector, or an empty table, gives none at all.
    * Repeated rows are returned as often as they occur and fitted once. Extra columns are ignored.
    """
    spark = df.sparkSession
    held = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    held = held.filter((F.size("v") > 0) & vectors.usable("v", LIMIT, scale))
    lengths = held.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    schema = (f"`{id_col}` {held.schema['id'].dataType.simpleString()}, component int, n bigint, deviation decimal(38,0), "
              "whitened double, explained double, identity_error double")
    if not lengths:
        return spark.createDataFrame([], schema)
    dims = lengths[0].d
    held = held.filter(F.size("v") == dims).select("id", vectors.integers("v", scale, shift).alias("x"))
    tasks = max(spark.sparkContext.defaultParallelism, 4 * held.rdd.getNumPartitions())
    fit = stored(held.select("x").repartition(tasks, "x").distinct(), "whitening-fit")

    n, sums, squares = _totals(fit, dims)
    base = np.array([s // n for s in sums], np.int64)
    rest = [s - n * int(b) for s, b in zip(sums, base)]  # sums of x - base
    off = np.array([r / n for r in rest])
    # centred squares, exact: n * sum(x^2) - S^2
    trace = sum(n * q - s * s for q, s in zip(squares, sums)) / n / n
    spectrum = spectrum_of(fit, dims, base)
    wanted = min(components, dims)
    start = spectrum.vectors[:, ::-1][:, :min(dims, wanted + GUARD)]
    values, directions = _refined(fit, base, off, n, start, wanted)
    real = values > 1e-12 * max(trace, 0.0)
    values, directions = values[real], directions[:, real]
    if not len(values):
        return spark.createDataFrame([], schema)
    project = directions / np.sqrt(values)
    k = len(values)

    def gram(batches):
        total = np.zeros((k, k))
        for batch in batches:
            w = ((vectors.matrix(batch.column("x"), dims) - base).astype(float) - off) @ project
            total += w.T @ w
        yield vectors.cells(total)

    identity = vectors.summed(fit.mapInArrow(gram, vectors.cells_schema("double")), k, k) / n
    error = float(np.abs(identity - np.eye(k)).max())

    def apply(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = vectors.matrix(part.column("x"), dims) - base
                w = (x.astype(float) - off) @ project
                exact = [str(v) if v < 10 ** 38 else None for v in deviations(x, n, rest)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(exact, pa.string()),
                     pa.FixedSizeListArray.from_arrays(w.reshape(-1), k).cast(pa.list_(pa.float64()))], names=["id", "deviation", "w"])

    scored = held.mapInArrow(apply, f"id {held.schema['id'].dataType.simpleString()}, deviation string, w array<double>")
    shares = F.array(*(F.lit(float(v / trace)) for v in values))
    return scored.select("id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("at", "whitened")).select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
