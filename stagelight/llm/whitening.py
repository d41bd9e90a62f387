"""Embedding whitening: distributed centred scatter, cyclic Jacobi on the driver, a broadcast matrix (operator 13)."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from stagelight.llm.common import Scratch

#: The driver holds a few matrices of this many dimensions squared at most: 32 MB each.
MOST_DIMENSIONS = 2048
#: Sweeps after which rotations must have ended; ten do for any matrix met so far.
MOST_SWEEPS = 60
#: Rows of a batch that are multiplied at once.
ROWS = 4096

COMPONENTS = 32
#: The query's fixed-point form of an entry: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries this large would leave the range of a long.
MOST_ENTRY = float(1 << 56)


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, by falling eigenvalue.

    Each sweep rotates every pair of rows and columns once, in rounds of disjoint pairs that are rotated together. An
    entry counts as zero once it is below the precision of its own two diagonal entries, not of the largest one, which
    is what keeps small eigenvalues of a positive matrix accurate.
    """
    a = np.array(a, dtype=np.float64)
    d = len(a)
    v = np.eye(d)
    least = np.finfo(float).tiny + np.finfo(float).eps ** 2 * np.abs(a).max(initial=0.0)
    if d > 1:
        players = np.arange(d + d % 2)  # an odd one rests in each round
        for _ in range(MOST_SWEEPS):
            turned = False
            ring = players.copy()
            for _ in range(len(players) - 1):
                p, q = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
                there = (p < d) & (q < d)
                p, q = np.minimum(p, q)[there], np.maximum(p, q)[there]
                off = a[p, q]
                turn = np.abs(off) > np.maximum(np.finfo(float).eps * np.sqrt(np.abs(a[p, p] * a[q, q])), least)
                if turn.any():
                    turned = True
                    p, q, off = p[turn], q[turn], off[turn]
                    with np.errstate(over="ignore"):
                        theta = (a[q, q] - a[p, p]) / (2 * off)
                        t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
                    c = 1 / np.hypot(t, 1.0)
                    s = t * c
                    for m, axis in ((a, 0), (a, 1), (v, 1)):
                        if axis:
                            x, y = m[:, p], m[:, q]
                            m[:, p], m[:, q] = x * c - y * s, x * s + y * c
                        else:
                            x, y = m[p], m[q]
                            m[p], m[q] = x * c[:, None] - y * s[:, None], x * s[:, None] + y * c[:, None]
                    a[p, q] = a[q, p] = 0.0
                ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            if not turned:
                break
        else:
            raise ArithmeticError(f"off-diagonal entries did not vanish in {MOST_SWEEPS} sweeps")
    order = np.argsort(-a.diagonal(), kind="stable")
    v = v[:, order]
    return a.diagonal()[order].copy(), v / np.linalg.norm(v, axis=0)


def _matrix(column: pa.Array) -> np.ndarray:
    """[row, entry] of a list column whose lists have one length and no nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _partial_sums(near: np.ndarray | None, lo: np.ndarray | None):
    """One row for each dimension and task: with `near` the centred scatter's row, else the sums of shifted entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                part = rows.column("part")[0].as_py()
                x = _matrix(rows.column("v"))
                if near is None:
                    one = x.astype(np.float64).sum(axis=0, keepdims=True) if x.dtype.kind == "f" else x.astype(object).sum(axis=0, keepdims=True)
                elif lo is None:
                    one = (x - near).astype(np.float64).sum(axis=0, keepdims=True)
                else:
                    y = (x - near).astype(np.float64) - lo
                    one = y.T @ y
                total = one if total is None else total + one
        if total is not None:
            i = np.arange(len(total))
            if near is None and total.dtype == object:
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.full(len(i), part)), pa.array([[str(v) for v in r] for r in total])], ["i", "part", "exact"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.full(len(i), part)), pa.array(list(total))], ["i", "part", "values"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one i added up, in the order of their parts, so that a task run again gives the same bits."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column("i").to_pylist(), _matrix(batch.column("values"))):
            total[i] = total[i] + row if i in total else row
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()))], ["i", "values"])


@dataclass(frozen=True)
class Moments:
    """n vectors, their sums (exact integers where the entries are integers), the mean as near + rest, and the covariance."""

    n: int
    sums: list
    near: np.ndarray
    rest: np.ndarray
    covariance: np.ndarray


def moments(vectors: DataFrame, column: str) -> Moments:
    """Mean and covariance (divisor n, centred before multiplying) of an array column of one length without nulls.

    Two or three passes; each task sends a row of the matrix for each dimension, and the rows of a dimension are added
    by one task. The mean is kept in two parts, so that centring loses nothing to a large common offset.
    """
    kind = vectors.schema[column].dataType.elementType.typeName()
    whole = kind in ("byte", "short", "integer", "long")
    rows = vectors.select(F.col(column).alias("v"), F.spark_partition_id().cast("long").alias("part"))
    n, dim = vectors.agg(F.count("*"), F.max(F.size(column))).first()
    if not n or not dim:
        return Moments(n, [], np.zeros(0), np.zeros(0), np.zeros((0, 0)))
    if dim > MOST_DIMENSIONS:
        raise ValueError(f"{dim} dimensions; the driver rotates matrices of at most {MOST_DIMENSIONS}")
    added = "i long, values array<double>"

    def summed(near, lo) -> np.ndarray:
        parts = rows.mapInArrow(_partial_sums(near, lo), "i long, part long, values array<double>")
        return np.array([r["values"] for r in parts.repartition("i").sortWithinPartitions("i", "part").mapInArrow(_added, added).orderBy("i").collect()])

    if whole:
        exact = rows.mapInArrow(_partial_sums(None, None), "i long, part long, exact array<string>").select(F.posexplode("exact").alias("j", "value"))
        sums = [int(r["total"]) for r in exact.groupBy("j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).orderBy("j").collect()]
        near = np.array([s // n for s in sums], dtype=np.int64)
        rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, near)])
    else:
        sums = summed(None, None)[0].tolist()
        near = np.array(sums) / n
        rest = summed(near, None)[0] / n
    v = summed(near, rest) / n
    return Moments(n, sums, near, rest, (v + v.T) / 2)


@dataclass(frozen=True)
class Whitening:
    """What was fitted: eigenvalues e by falling size, unit eigenvectors as columns, and how much each one explains."""

    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def fit(vectors: DataFrame, column: str, components: int) -> Whitening:
    """The first components of the covariance of an array column. Directions in which the vectors don't vary, to
    rounding, can't be scaled to variance 1 and are no components."""
    m = moments(vectors, column)
    values, axes = jacobi(m.covariance)
    trace = float(m.covariance.trace())
    some = values[:components] > len(values) * np.finfo(float).eps * max(trace, 0.0)
    return Whitening(m, values[:components][some], axes[:, :components][:, some], values[:components][some] / (trace or 1.0))


def transform(vectors: DataFrame, column: str, fitted: Whitening, to: str) -> DataFrame:
    """vectors with an array of whitened components; the matrix travels with the task: dimensions x components doubles."""
    near, rest = fitted.moments.near, fitted.moments.rest
    matrix = fitted.vectors / np.sqrt(fitted.values)
    names = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                w = ((_matrix(rows.column(column)) - near).astype(np.float64) - rest) @ matrix
                off = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(off, pa.array(w.reshape(-1)))], [*names, to])

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, StructField(to, ArrayType(DoubleType()))]))


def identity_error(white: DataFrame, column: str) -> float:
    """Largest absolute entry of the covariance of whitened vectors minus the identity."""
    v = moments(white, column).covariance
    return float(np.abs(v - np.eye(len(v))).max()) if len(v) else 0.0


def usable(vector: Column, most: float = math.inf) -> Column:
    """Not null, not empty, and all entries finite numbers below `most`."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(most))), F.lit(False))


def whiten(vectors: DataFrame, column: str, components: int = COMPONENTS, to: str = "whitened") -> tuple[DataFrame, Whitening, float]:
    """Rows of `vectors` with their whitened components, what was fitted, and the error of the whitened covariance.

    Rows whose vector is null, empty or holds null, NaN or infinite entries go, as do vectors of another length than
    the commonest one (of equally common ones the shortest): they have no place in the covariance. All others are
    fitted and returned, repeated rows and ids included; other columns stay, but one named `to` is replaced. Where no
    vector is left, or none differs from another, there are no components: the arrays are empty. Eigenvectors of equal
    eigenvalues are any orthonormal ones. `vectors` has to be a scan or a written table.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    whole = vectors.schema[column].dataType.elementType.typeName() in ("byte", "short", "integer", "long")
    kept = vectors.drop(to) if to != column else vectors
    good = kept.where(F.coalesce((F.size(column) > 0) & F.forall(column, lambda c: c.isNotNull()), F.lit(False)) if whole else usable(F.col(column)))
    lengths = good.groupBy(F.size(column).alias("length")).count().orderBy(F.desc("count"), "length").first()
    rows = good.where(F.size(column) == (lengths["length"] if lengths else 0))
    fitted = fit(rows, column, components)
    white = scratch.write(transform(rows, column, fitted, to), "white")
    return white, fitted, identity_error(white, to)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows of embeddings; `deviation` is null where it leaves the range of a long, and vectors with an entry
    of 2^56 or more, whose x does, are left out like infinite ones."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").where(usable(F.col("embedding"), MOST_ENTRY))
    fixed = table.select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(SCALE) * c.cast("double")) + F.lit(SHIFT)).alias("x"))
    white, fitted, error = whiten(fixed, "x")
    n = fitted.moments.n
    constant = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
    far = F.zip_with("x", constant([int(s) for s in fitted.moments.sums], "bigint"), lambda x, s: F.try_subtract(F.try_multiply(F.lit(n), x), s))
    deviation = F.aggregate(far, F.lit(0).cast("long"), lambda total, v: F.try_add(total, F.try_multiply(v, v)))
    rows = white.select("vec_id", deviation.alias("deviation"), "whitened").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
    share = F.element_at(constant(fitted.explained.tolist(), "double"), F.col("at") + 1)
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), share.alias("explained"), F.lit(error).alias("identity_error")
    )


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLE_SQL: dict[str, str] = {}
