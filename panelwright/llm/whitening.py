"""Whitening of embeddings by a tiled covariance.

The covariance of D dimensions is cut into square tiles of ``TILE`` dimensions, one for each pair of
column blocks. Rows are taken in blocks; every column block of a row block is sent to the tiles
that need it, keyed by tile and row block. Where the two column blocks of a tile and row block
meet they are centred and multiplied, products are added up tile by tile in each task, and the
sums of all tasks are assembled on the driver, which holds D x D numbers, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, schema_of, stored, unused, without

#: Dimensions of a tile; rows of a block; most dimensions (the driver assembles their square).
TILE, BLOCK_ROWS, MOST_DIMENSIONS = 32, 4096, 8192


def integer_vectors(rows: DataFrame, column: str, out: str, scale: int = 256) -> DataFrame:
    """``rows`` whose vector has no null, NaN or infinite entry, with ``out``: floor(scale * entry) as whole numbers.

    Entries beyond 64 bits end at the largest of them.
    """
    number = lambda c: c.cast("double")
    sound = F.forall(F.col(column), lambda c: F.coalesce(~F.isnan(number(c)) & (F.abs(number(c)) < float("inf")), F.lit(False)))
    return rows.where(sound).withColumn(out, F.transform(F.col(column), lambda c: F.floor(scale * number(c)).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column, all of one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def moments(vectors: DataFrame, width: int) -> tuple[int, list]:
    """Number of rows and the sum of every dimension; whole numbers are added exactly. ``vectors``: one list column."""
    exact = "bigint" in vectors.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            own = _matrix(batch.column(0), width)
            if exact:  # halves, so that no partial sum leaves 64 bits
                high, low = own >> 32, own & 0xFFFFFFFF
                total = [t + (int(a) << 32) + int(b) for t, a, b in zip(total, high.sum(axis=0), low.sum(axis=0), strict=True)]
            else:
                total = [t + float(a) for t, a in zip(total, own.sum(axis=0), strict=True)]
            n += len(own)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), type=pa.int32()), pa.array([str(t) if exact else repr(t) for t in total]), pa.array([n] * width, type=pa.int64())], names=["d", "total", "n"])

    parts = vectors.mapInArrow(run, "d int, total string, n long")
    sums = parts.groupBy("d").agg(F.sum(F.col("total").cast("decimal(38,0)" if exact else "double")).alias("total"), F.sum("n").alias("n")).collect()
    total: list = [0] * width
    for r in sums:
        total[r["d"]] = int(r["total"]) if exact else r["total"]
    return (sums[0]["n"] if sums else 0), total


def covariance(vectors: DataFrame, width: int, n: int, mean: np.ndarray, tile: int = TILE, rows: int = BLOCK_ROWS) -> np.ndarray:
    """Covariance (divisor ``n``) of one list column, centred on ``mean`` before multiplying."""
    blocks = -(-width // tile)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Column blocks of row blocks, once for every tile that needs them."""
        task, made = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                own = _matrix(batch.column(0).slice(at, rows), width)
                if own.dtype == np.int64:  # the narrowest type that holds them travels
                    kind = np.result_type(np.min_scalar_type(own.min()), np.min_scalar_type(own.max()))
                    own = own.astype(kind if kind.kind in "iu" else np.int64)
                out = []
                for b in range(blocks):
                    data = np.ascontiguousarray(own[:, b * tile : (b + 1) * tile]).tobytes()
                    out += [(min(b, other), max(b, other), task + made, b, len(own), own.dtype.str, data) for other in range(blocks)]
                made += 1
                yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in out], schema=shape)

    shape = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("row_block", pa.int64()), ("b", pa.int32()), ("n", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of products, one matrix for each tile of the task; its rows come sorted."""
        now, total, left = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["i"], r["j"]) != now:
                    if now:
                        yield _tile(now, total)
                    now, total = (r["i"], r["j"]), 0.0
                b = r["b"]
                own = np.frombuffer(r["data"], dtype=r["kind"]).reshape(r["n"], -1) - mean[b * tile : (b + 1) * tile]
                if r["i"] == r["j"]:
                    total = total + own.T @ own
                elif b == r["i"]:
                    left = own
                else:
                    total = total + left.T @ own
        if now:
            yield _tile(now, total)

    sent = vectors.mapInArrow(columns, "i int, j int, row_block long, b int, n int, kind string, data binary")
    met = sent.repartition("i", "j", "row_block").sortWithinPartitions("i", "j", "row_block", "b")
    parts = met.mapInArrow(multiply, "i int, j int, cells array<double>")
    sums = parts.select("i", "j", F.posexplode("cells").alias("at", "v")).groupBy("i", "j", "at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((width, width))
    i, j, at, v = (sums.column(c).to_numpy() for c in ("i", "j", "at", "v"))
    wide = np.minimum(tile, width - j * tile)  # columns of the tile
    x, y = i * tile + at // wide, j * tile + at % wide
    out[x, y] = v
    out[y, x] = v
    return out / max(n, 1)


def _tile(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], type=pa.int32()), pa.array([key[1]], type=pa.int32()), pa.array([total.ravel().tolist()], type=pa.list_(pa.float64()))], names=["i", "j", "cells"])


@dataclass
class Whitening:
    """A fitted whitening: rows, sums, and the components with their eigenvalues, the largest first."""

    width: int
    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of whole-number vectors."""
        mean = np.array([t / self.n for t in self.total])
        return (x - mean) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; null where that is beyond 64 bits."""
        most = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.total)) if x.size else 0
        if most * most * max(self.width, 1) < 1 << 63:
            d = self.n * x - np.array(self.total, dtype=np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.total, strict=True)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def _project(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """Whitened coordinates of a list column, as the one column ``w``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_lists(fitted.coordinates(_matrix(batch.column(0), fitted.width)))], names=["w"])

    return vectors.mapInArrow(run, "w array<double>")


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(matrix).ravel()))


def fit_whitening(vectors: DataFrame, width: int, components: int = 4, tile: int = TILE) -> Whitening:
    """Fit to the distinct vectors of one list column of whole numbers, all of length ``width``.

    Components whose eigenvalue is nothing but rounding (up to D * 2e-16 of the largest) are left
    out, as are those that do not exist: fewer than ``components`` may be had. The error is the
    largest entry of the whitened vectors' covariance less the identity, measured in a pass of its own.
    """
    if width > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} dimensions")
    distinct = stored(vectors.distinct())  # copies are counted away before rows are shuffled
    n, total = moments(distinct, width) if width else (0, [])
    empty = Whitening(width, max(n, 1), total, np.zeros(0), np.zeros((width, 0)), 0.0)
    if n < 2:
        return empty
    v = covariance(distinct, width, n, np.array([t / n for t in total]), tile)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    sound = values > width * np.finfo(float).eps * max(values[0], 0)
    values, axes = values[sound], axes[:, sound]
    if not len(values):
        return empty
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))] < 0, -1, 1)  # one sign, wherever it runs
    fitted = Whitening(width, n, total, values, axes, float(np.trace(v)))
    white = _project(distinct, fitted)
    _, sums = moments(white, len(values))
    fitted.identity_error = float(np.abs(covariance(white, len(values), n, np.array(sums) / n, tile) - np.eye(len(values))).max())
    return fitted


def whiten(rows: DataFrame, column: str = "embedding", components: int = 4, scale: int = 256, tile: int = TILE) -> tuple[DataFrame, Whitening]:
    """``rows`` (any columns) with ``deviation`` and ``whitened`` (a list, the strongest component first), and what was fitted.

    Rows whose vector is null, or holds a null, NaN or infinite entry, are left out. Vectors should
    have one length; where they don't, those of the commonest length are kept (the longer one on
    ties). Copies and repeated rows count once in the fit and are each returned. A table without
    variance (no rows, one distinct vector, no dimensions) gives empty lists. Columns named as the
    outputs give way. Runs jobs when called.
    """
    base = without(rows, "deviation", "whitened")
    if column.lower() not in {c.lower() for c in base.columns}:
        raise ValueError(f"the vectors' column must not be named as an output: {column}")
    (x,) = unused(base, "x")
    sound = integer_vectors(base, column, x, scale)
    common = sound.groupBy(F.size(x).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common["width"] if common else 0
    sound = sound.where(F.size(x) == width)
    fitted, keep = fit_whitening(sound.select(x), width, components, tile), list(base.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column(x), fitted.width) if fitted.width else np.zeros((batch.num_rows, 0), dtype=np.int64)
            more = [pa.array(fitted.deviation(own), type=pa.int64()), _lists(fitted.coordinates(own))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more], names=[*keep, "deviation", "whitened"])

    return sound.mapInArrow(run, schema_of(base, "deviation long, whitened array<double>")), fitted


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding, a row a component."""
    out, fitted = whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    share = F.array(*[F.lit(float(v / fitted.trace)) for v in fitted.values]) if len(fitted.values) else F.array().cast("array<double>")
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(fitted.identity_error).alias("identity_error"),
    )
