"""Whitening of embeddings: principal components of their covariance, by Chan's pairwise merging of partial moments.

Each task holds the count, the mean and the centred scatter of its own vectors; treeReduce merges the states in pairs; the driver
solves the symmetric eigenproblem of one matrix a vector length. A second pass whitens the fitted vectors and merges the moments of what it
got in the same way, which tells how far their covariance is from the identity.

Cases. A vector that is null or holds a null or non-finite entry is dropped, and so is an empty one, which has no component. Equal vectors are
fitted once, and each of their rows is answered. Vectors of another length are a population of their own, with its own components and n.
A component without variance has a null whitened value; with no variance at all explained is null too. There are no more components than
dimensions. An entry beyond a long's range becomes the range's end, and a deviation beyond it null. Ids may be null, repeat or be of any type; other columns are
left alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkforge.session import settled

#: (count, exact sums, mean, centred scatter) of vectors of one length.
Moments = tuple[int, list[int], np.ndarray, np.ndarray]
STATE = "size int, n long, sums array<decimal(38,0)>, mean binary, scatter binary"


def moments(x: np.ndarray) -> Moments:
    """The moments of the rows of x, integers or doubles; sums are exact for integers."""
    v = x.astype(np.float64)
    mean = v.mean(0)
    v -= mean
    # What rounding left of the mean is taken out of the scatter as well.
    rest = v.mean(0)
    return len(x), (exact_sums(x) if x.dtype == np.int64 else [0] * x.shape[1]), mean + rest, v.T @ v - len(x) * np.outer(rest, rest)


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as Python integers, from halves of 32 bits that can't overflow."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(a) << 32) + int(b) for a, b in zip(high.sum(0), low.sum(0))]


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's formula: the moments of both sets together."""
    n = a[0] + b[0]
    gap = b[2] - a[2]
    return n, [x + y for x, y in zip(a[1], b[1])], a[2] + gap * (b[0] / n), a[3] + b[3] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _merged_by_size(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    out = dict(a)
    for size, m in b.items():
        out[size] = merged(out[size], m) if size in out else m
    return out


def rounded(df: DataFrame, vector: str, scale: int, *keep: str) -> DataFrame:
    """(*keep, x): floor(scale * entry) as longs, of the vectors that are whole."""
    v = F.col(vector).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(vector).isNotNull()).where(fine).select(*keep, F.transform(v, lambda c: F.floor(c * scale)).cast("array<long>").alias("x"))


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield rows, flat[off[rows][:, None] + np.arange(d)]


def _gathered(frame: DataFrame, picked: dict[int, tuple] | None = None) -> dict[int, Moments]:
    """The moments of column x, or of its whitened values, by length: one state a task and length, merged pairwise."""
    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            for _, x in by_size(batch.column(0)):
                d = x.shape[1]
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    if picked is not None:
                        part = whitened(part, *picked[d])
                        if not part.shape[1]:
                            continue
                    held = _merged_by_size(held, {d: moments(part)})
        rows = [(d, n, sums, mean.tobytes(), scatter.tobytes()) for d, (n, sums, mean, scatter) in held.items()]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["size", "n", "sums", "mean", "scatter"])

    def opened(r: T.Row) -> dict[int, Moments]:
        mean = np.frombuffer(r["mean"])
        return {r["size"]: (r["n"], [int(s) for s in r["sums"]], mean, np.frombuffer(r["scatter"]).reshape(len(mean), len(mean)))}

    kept = frame.select("x").mapInArrow(states, STATE)
    return kept.rdd.map(opened).union(frame.sparkSession.sparkContext.parallelize([{}], 1)).treeReduce(_merged_by_size, depth=3)


def components(m: Moments, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(unit eigenvectors as columns, eigenvalues, trace) of the covariance, by falling eigenvalue, k at most."""
    cov = m[3] / m[0]
    e, v = np.linalg.eigh((cov + cov.T) / 2)
    top = np.argsort(-e, kind="stable")[:k]
    return v[:, top], np.maximum(e[top], 0.0), float(np.trace(cov))


def _floor(e: np.ndarray, trace: float, d: int) -> float:
    """Eigenvalues up to here are rounding, not variance."""
    return max(trace, 0.0) * d * np.finfo(float).eps


def whitened(x: np.ndarray, mean: np.ndarray, v: np.ndarray, e: np.ndarray, trace: float) -> np.ndarray:
    """Rows of x on the components that have variance, each over its root."""
    some = e > _floor(e, trace, x.shape[1])
    return (x - mean) @ v[:, some] / np.sqrt(e[some])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n * x - sum) ** 2; null beyond a long."""
    span = max(n * float(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0), 1.0)
    if span * span * x.shape[1] < 2.0**62:
        gap = n * x - np.array(sums, np.int64)
        return (gap * gap).sum(1).tolist()
    out = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [y if y < 1 << 63 else None for y in out]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 4, scale: int = 256) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): one row for each whole vector and component up to k."""
    spark = df.sparkSession
    fitted = settled(rounded(df, vector, scale).distinct(), "fitted")
    found = _gathered(fitted)
    picked, facts = {}, {}
    for d, m in found.items():
        v, e, trace = components(m, k)
        mean = np.array([s / m[0] for s in m[1]])
        picked[d] = (mean, v, e, trace)
        facts[d] = (m[0], m[1])
    errors = {d: float(np.abs(m[3] / m[0] - np.eye(len(m[2]))).max()) for d, m in _gathered(fitted, picked).items()}
    shared = spark.sparkContext.broadcast((picked, facts, errors))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked_, facts_, errors_ = shared.value
        for batch in batches:
            ids = batch.column(0)
            for rows, x in by_size(batch.column(1)):
                d = x.shape[1]
                mean, v, e, trace = picked_[d]
                n, sums = facts_[d]
                c = len(e)
                some = e > _floor(e, trace, d)
                values = np.full((len(x), c), np.nan)
                values[:, some] = whitened(x, mean, v, e, trace)
                share = [float(a) / trace if trace > 0 else None for a in e]
                cols = [
                    ids.take(pa.array(np.repeat(rows, c))), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * c, n, np.int64)),
                    pa.array(np.repeat(np.array(deviations(x, n, sums), object), c).tolist(), pa.int64()), pa.array(values.ravel(), from_pandas=True),
                    pa.array(share * len(x), pa.float64()), pa.array([errors_.get(d)] * (len(x) * c), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = df.schema[key].dataType.simpleString()
    rows = rounded(df.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector", scale, "key")
    out = rows.mapInArrow(answer, f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("key", key)
