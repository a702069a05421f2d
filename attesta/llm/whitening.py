"""Whitening of embeddings by shifted Cholesky QR over distributed Gram passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.vectors import integer_rows, matrix

SCALE, OFFSET = 64, 1_000_000
MOST = 1 << 40
COMPONENTS = 32
ROUND_OFF = 2.0**-53
MOST_PASSES = 24
COUNTED_ROWS = 10_000_000
NO_VARIANCE = 1e-13
BLOCK = 4096
Step = tuple[str, np.ndarray]


@dataclass
class Basis:
    """What the passes over the rows give: exact sums, principal axes and their variances."""

    n: int
    sums: np.ndarray  # exact, one per dimension
    axes: np.ndarray  # unit columns by falling variance
    variances: np.ndarray
    trace: float


def solve_right(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x times the inverse of the upper triangular r, column by column by substitution."""
    q = np.empty_like(x)
    for j in range(r.shape[1]):
        q[:, j] = (x[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def numerators(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: as Python integers where 64 bits do not hold it."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums.tolist()), default=0)
    return n * x - sums.astype(np.int64) if reach < 1 << 63 else n * x.astype(object) - sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x minus the mean, rounded once, as its numerator is exact."""
    return (numerators(x, n, sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Per row the exact sum of (n * x - sums)^2 over the dimensions."""
    far = numerators(x, n, sums)
    reach = max(abs(int(far.max(initial=0))), abs(int(far.min(initial=0))))
    if reach**2 * x.shape[1] >= 1 << 63:
        far = far.astype(object)
    return (far * far).sum(axis=1)


def orthogonal(x: np.ndarray, steps: list[Step]) -> np.ndarray:
    for kind, m in steps:
        x = solve_right(x, m) if kind == "solve" else x @ m
    return x


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield matrix(batch.slice(at, BLOCK).column("x"), width)


def gram(rows: DataFrame, width: int, image: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of q'q, with q the image of a block of rows.

    Every task adds its blocks up and sends the upper half once; Spark sums these by
    cell, so the driver gets size * (size + 1) / 2 numbers however many tasks there are.
    """
    upper = np.triu_indices(size)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((size, size)), False
        for x in _blocks(batches, width):
            q = image(x)
            total, some = total + q.T @ q, True
        if some:
            cell = pa.array(np.arange(len(upper[0]), dtype=np.int32))
            yield pa.record_batch([cell, pa.array(total[upper])], names=["cell", "value"])

    got = rows.select("x").mapInArrow(part, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    half = np.zeros(len(upper[0]))
    for r in got:
        half[r["cell"]] = r["value"]
    full = np.zeros((size, size))
    full[upper] = half
    return full + np.triu(full, 1).T


def column_sums(rows: DataFrame, width: int, image: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x in _blocks(batches, width):
            total = total + image(x).sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "value"])

    got = rows.select("x").mapInArrow(part, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["at"]] = r["value"]
    return out


def exact_sums(rows: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Count of the rows and exact sum of each entry, as Python integers."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * width, 0
        for x in _blocks(batches, width):
            n += len(x)
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
        at = pa.array(np.arange(-1, width, dtype=np.int32))
        yield pa.record_batch([at, pa.array([str(n), *map(str, total)])], names=["at", "value"])

    got = rows.select("x").mapInArrow(part, "at int, value string")
    by = {r["at"]: int(r["s"]) for r in got.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s")).collect()}
    return by.get(-1, 0), np.array([by.get(i, 0) for i in range(width)], dtype=object)


def fit(rows: DataFrame, width: int) -> Basis:
    """Principal axes of the centred rows from the R factor of their QR decomposition.

    Pass after pass takes the Gram matrix of the rows as orthogonalised so far and its
    Cholesky factor, by whose inverse the next pass solves the rows. While that matrix is
    too ill-conditioned, it is shifted by a multiple of the round-off first, which makes narrow
    directions wider relative to the others. A direction narrower than ``NO_VARIANCE`` of the widest
    has none but round-off and is projected out as soon as it can be told from it. The passes end when
    the rows are orthonormal. The product of the factors is R, whose singular values and right
    singular vectors are those of the rows.
    """
    n, sums = exact_sums(rows, width)
    if n == 0:
        return Basis(0, sums, np.eye(width), np.zeros(width), 0.0)
    steps: list[Step] = []
    r, size, widened = np.eye(width), width, 1.0
    for turn in range(MOST_PASSES):
        image = lambda x, steps=tuple(steps): orthogonal(centred(x, n, sums), steps)
        g = gram(rows, width, image, size)
        if turn and np.abs(g - np.eye(size)).max(initial=0.0) <= max(64 * size, n**0.5) * ROUND_OFF:
            break
        values, vectors = np.linalg.eigh(g)
        top = float(values[-1]) if size else 0.0
        if top <= 0:  # all rows are equal
            size, r = 0, np.zeros((0, width))
            break
        alive = values > max((NO_VARIANCE * widened) ** 2, size * ROUND_OFF**2) * top
        if not alive.all() and NO_VARIANCE * widened > ROUND_OFF**0.5:
            kept = vectors[:, alive]
            steps.append(("project", kept))
            g, r, size, values = kept.T @ g @ kept, kept.T @ r, kept.shape[1], values[alive]
        # block sums lose less than single ones, so rows count up to a bound
        shift = 11 * (min(n, COUNTED_ROWS) * size + size * (size + 1)) * ROUND_OFF
        if turn == 0 or values[0] <= 4 * shift * top:
            g, widened = g + shift * top * np.eye(size), widened / shift**0.5
        factor = np.linalg.cholesky(g).T
        steps.append(("solve", factor))
        r = factor @ r
    else:
        raise ArithmeticError(f"rows not orthonormal after {MOST_PASSES} passes")
    _, singular, axes = np.linalg.svd(r, full_matrices=True) if size else (None, np.zeros(0), np.eye(width))
    variances = np.concatenate([singular**2 / n, np.zeros(width - len(singular))])
    axes = axes.T
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(width)])
    return Basis(n, sums, axes * np.where(sign == 0, 1, sign), variances, float(variances.sum()))


def whiten(df: DataFrame, components: int = COMPONENTS, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per usable row and component: id, component, n, deviation, whitened, explained, identity_error.

    An entry c becomes x = floor(64 * c) + 1000000. Components are the axes of x's covariance
    by falling variance, at most as many as the vectors have entries; each axis points to
    where its largest entry is positive, for all rows. ``deviation`` is decimal(38,0), exact
    at any number of rows; ``whitened`` is the centred row along the axis over the root of
    the variance there, ``identity_error`` the largest entry of the whitened rows' covariance
    minus the identity, measured on the rows. Along an axis without variance (repeated
    or single rows, constant entries) ``whitened`` is null and ``explained`` 0; such
    axes do not count in ``identity_error``, which is null where all are such. Axes of equal
    variance are any basis of their plane. Which rows are left out, and which error entries
    of 2^40 / 64 and more raise, is said at ``integer_rows``. Repeated rows and ids are rows of their
    own, a null id stays null, an empty table gives no rows; other columns are not read.
    """
    rows, width = integer_rows(df, vector, SCALE, OFFSET, MOST, {"id": F.col(id_)})
    kind = rows.schema["id"].dataType.simpleString()
    if width == 0:
        rest = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], f"{id_} {kind}, {rest}")
    basis = fit(rows, width)
    n, sums = basis.n, basis.sums
    shown = min(components, width)
    alive = int((basis.variances[:shown] > 0).sum())
    scaled = basis.axes[:, :alive] / np.sqrt(basis.variances[:alive])
    image = lambda x: centred(x, n, sums) @ scaled
    error = None
    if alive:
        mean = column_sums(rows, width, image, alive) / n
        covariance = gram(rows, width, lambda x: image(x) - mean, alive) / n
        error = float(np.abs(covariance - np.eye(alive)).max())
    explained = basis.variances[:shown] / basis.trace if basis.trace > 0 else np.zeros(shown)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                x = matrix(piece.column("x"), width)
                flat = np.full((len(x), shown), np.nan)
                flat[:, :alive] = image(x)
                whitened = pa.array(flat.ravel(), mask=np.tile(np.arange(shown) >= alive, len(x)))
                each = pa.array(np.repeat(np.arange(len(x)), shown))
                deviation = pa.array([str(v) for v in deviations(x, n, sums).tolist()])
                component = pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), len(x)))
                yield pa.record_batch(
                    [piece.column("id").take(each), component, deviation.take(each), whitened, pa.array(np.tile(explained, len(x)))],
                    names=["id", "component", "deviation", "whitened", "explained"],
                )

    out = rows.select("id", "x").mapInArrow(project, f"id {kind}, component int, deviation string, whitened double, explained double")
    return out.select(
        F.col("id").alias(id_),
        "component",
        F.lit(n).cast("bigint").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened",
        "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
