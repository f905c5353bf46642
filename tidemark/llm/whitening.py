"""Embedding whitening: principal components refined in mixed precision from a distributed covariance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import own, written

#: Steps a unit, and what is added to each entry.
STEPS, SHIFT = 64, 1_000_000

COMPONENTS = 16
LARGEST = float(1 << 46)  # an entry's size from which its steps are no exact double
SWEEPS = 30  # refinements at most; each about doubles the number of right digits


def _sound(vector: Column) -> Column:
    """Neither null nor empty, without null, NaN, infinite or unrepresentable entries."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry)


def steps(rows: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x) of the rows whose vector is sound: x = floor(64 * c) + 1000000 for every entry c."""
    whole = lambda c: F.floor(c.cast("double") * F.lit(float(STEPS))).cast("long") + F.lit(SHIFT)
    column = F.col(f"`{vector}`")
    return rows.where(_sound(column)).select(F.col(f"`{id}`").alias("id"), F.transform(column, whole).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch of vectors, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the sum of every entry, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                count, total = count + len(x), x.sum(axis=0) + (0 if total is None else total)
        if count:
            at = pa.array(range(len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([at, pa.array([count] * len(total), pa.int64()), pa.array(total)], ["i", "n", "s"])

    made = fit.select("x").mapInArrow(run, "i int, n long, s long").groupBy("i")
    found = made.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row an entry
    return (found[0]["n"] if found else 0), [int(r["s"]) for r in sorted(found, key=lambda r: r["i"])]


def _products(fit: DataFrame, of) -> np.ndarray:
    """The sum of ``of(x)`` transposed times ``of(x)`` over all batches x.

    A task adds up its own, and what it sends are the entries of one half, added up by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = of(_matrix(batch.column(0)))
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"]
            )

    made = fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = made.collect()  # an entry of the matrix each
    size = max(r["i"] for r in found) + 1
    total = np.zeros((size, size))
    for r in found:
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["v"]
    return total


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of neighbouring values, in order, that are nearer than ``gap`` to the next."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refined(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, in extended precision.

    They begin as eigenvectors in float32 and are corrected by the iteration of Ogita and Aishima:
    with R = I - X'X, S = X'AX and l = diag(S) / (1 - diag(R)), X becomes X + XE, where
    E = (S + Rl) / (l_j - l_i), or R / 2 where two values are too near to be told apart. All of it is
    matrix products. Vectors of such a cluster span the right space and may be turned in it, so each
    cluster is solved by itself, shifted by its mean (which keeps the digits in which its values
    differ), and the iteration goes on, with a smaller bound on what is too near.
    """
    wide = np.longdouble
    a = matrix.astype(wide)
    size = len(a)
    scale = np.abs(a).max(initial=wide(0))
    if not scale:
        return np.zeros(size, wide), np.eye(size, dtype=wide)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(wide)
    unit, norm = np.eye(size, dtype=wide), np.sqrt((a * a).sum())
    floor = 8 * size * np.finfo(wide).eps * norm
    for _ in range(SWEEPS):
        r, s = unit - x.T @ x, x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        near = max(2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum())), floor)
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > near
        e = np.where(apart, (s + r * values[None, :]) / np.where(apart, gaps, 1), r / 2)
        x = x + x @ e
        turned = 0.0
        for cluster in _clusters(values, float(near)):
            part = x[:, cluster]
            half = np.eye(len(cluster), dtype=wide) + (np.eye(len(cluster), dtype=wide) - part.T @ part) / 2
            part = part @ half
            shifted = part.T @ (a @ part) - values[cluster].mean() * (part.T @ part)
            spread = np.abs(shifted).max()
            if spread > floor:
                turn = np.linalg.eigh((shifted / spread).astype(np.float64))[1].astype(wide)
                turned = max(turned, float(spread))
                part = part @ turn
            x[:, cluster] = part
        if np.abs(e).max() <= floor and turned <= near:
            break
    for _ in range(3):  # what rounding over a narrow gap has turned is still made orthogonal
        x = x + x @ ((unit - x.T @ x) / 2)
    values = np.diag(x.T @ (a @ x))
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


@dataclass
class Whitening:
    """A fit: number of distinct vectors, sums of entries, and components (columns) with variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centre(self) -> np.ndarray:
        """The whole number next to each entry's mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def projector(self):
        """A function from rows of x to their whitened components."""
        centre = self.centre()
        rest = np.array([s - self.n * int(c) for s, c in zip(self.sums, centre)], float) / self.n
        turn = self.components / np.sqrt(self.variances)
        return lambda x: ((x - centre).astype(float) - rest) @ turn

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S) ** 2 of every row, exactly; None where that is beyond a long."""
        centre, found = self.centre(), []
        rest = [s - self.n * int(c) for s, c in zip(self.sums, centre)]
        y = x - centre
        rough = ((self.n * y.astype(float) - np.array(rest, float)) ** 2).sum(axis=1)
        if rough.max(initial=0) < float(1 << 61):
            return ((self.n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        for row in y.tolist():
            total = sum((self.n * v - r) ** 2 for v, r in zip(row, rest))
            found.append(total if total < 1 << 63 else None)
        return found


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of distinct vectors ``x`` of one length; None if there are none.

    Entries are centred on the whole number next to their mean, so products and their sums are whole
    numbers, exact in doubles up to 2 ** 53 and hardly rounded beyond; the rest of the mean, half a
    step at most, is taken off their covariance. Only the sums and the covariance reach the driver: a
    matrix as large as the vectors are long, however many there are.

    A component whose variance is zero to double precision can't be whitened and is left out.
    """
    n, sums = _sums(fit)
    if not n:
        return None
    model = Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0))
    centre = model.centre()
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre)], np.longdouble) / n
    covariance = _products(fit, lambda x: (x - centre).astype(float)).astype(np.longdouble) / n - np.outer(rest, rest)
    values, vectors = refined(covariance)
    total = np.trace(covariance)
    count = min(components, int((values > len(sums) * np.finfo(float).eps * values[0]).sum())) if total > 0 else 0
    model.variances, model.components = values[:count].astype(float), vectors[:, :count].astype(float)
    model.explained = (values[:count] / (total or 1)).astype(float)
    if count:
        project = model.projector()
        # A column of ones brings the sums along, by which the covariance is centred.
        sums_and_products = _products(fit, lambda x: np.hstack([project(x), np.ones((len(x), 1))])) / n
        mean = sums_and_products[-1, :-1]
        error = sums_and_products[:-1, :-1] - np.outer(mean, mean) - np.eye(count)
        model.identity_error = float(np.abs(error).max())
    return model


def whitened(
    rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """A row for each row with a sound vector and each component: ``id``, component (from 1), n,
    deviation, whitened, explained, identity_error. See ``fitted`` for the fit.

    Dropped are rows whose vector is null or empty, holds a null, NaN, an infinity or an entry of
    2 ** 46 or more, and, should vectors differ in length, those not of the most frequent length (ties:
    the longest). Each remaining row is returned, repeated ones too; the fit takes equal vectors once.
    ``deviation`` is null where it is beyond a long. There are fewer components than asked for where
    vectors are shorter or their variance has fewer dimensions: none, and so no row, if all vectors
    are equal. An empty table gives none. Equal variances leave their components' choice open.

    Vectors move once, to be made distinct (a map-side step, so a frequent vector is no burden).
    """
    kind = rows.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    entries = written(steps(rows, id, vector), "whitening-steps")
    length = own("length")
    lengths = entries.groupBy(F.size("x").alias(length)).count()
    most = lengths.orderBy(F.col("count").desc(), F.col(length).desc()).first()
    if most is None:
        return spark.createDataFrame([], schema)
    entries = entries.where(F.size("x") == most[length])
    fit = written(entries.select("x").distinct(), "whitening-fit")
    model = fitted(fit, components)
    count = len(model.variances)
    project = model.projector()
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            if not size or not count:
                continue
            x = _matrix(batch.column(1))
            deviations = pa.array(model.deviations(x), pa.int64())
            every = pa.array(np.repeat(np.arange(size), count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(every),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * count, model.n, np.int64)),
                    deviations.take(every),
                    pa.array(project(x).ravel()),
                    pa.array(np.tile(model.explained, size)),
                    pa.array(np.full(size * count, model.identity_error)),
                ],
                names=[id, *names],
            )

    return entries.select("id", "x").mapInArrow(run, schema)
