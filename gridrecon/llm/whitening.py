"""Embedding whitening: principal components by Chebyshev-filtered subspace iteration over distributed passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrecon.llm.common import written

#: Whole numbers that entries become: floor(SCALE * c) + SHIFT, held within LIMIT either way.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 61
#: Vectors of one stored block; guard vectors beside the wanted ones, also the step by which a slow block widens.
BLOCK, GUARD = 4096, 16
#: Degree of one filter; residual (of the largest eigenvalue) that certifies a component; components below FLAT of the largest have no spread.
DEGREE, SURE, FLAT, CYCLES = 10, 1e-13, 1e-9, 40
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Spread:
    """Centred vectors of a table of blocks, for passes over them: n, sums and the blocks themselves."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.blocks, self.n, self.sums, self.d = blocks, n, sums, len(sums)

    def total(self, of: Callable[[np.ndarray], np.ndarray], rows: int, cols: int) -> np.ndarray:
        """Sum over all blocks of the matrix (rows x cols) that of() makes of a block's centred vectors.

        A task adds up its own blocks; Spark sums its rows with the other tasks' by row number, and the driver gets one matrix.
        """
        n, sums = self.n, self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = None
            for b in batches:
                for x in b.column(0):
                    part = of(offsets(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, len(sums)), n, sums)[1])
                    acc = part if acc is None else acc + part
            if acc is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array(list(acc), pa.list_(pa.float64()))], ["i", "y"])

        parts = self.blocks.select("x").mapInArrow(run, "i int, y array<double>")
        out = np.zeros((rows, cols))
        for r in parts.groupBy("i").agg(F.array(*(F.sum(F.col("y")[j]) for j in range(cols))).alias("y")).collect():
            out[r.i] = r.y
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """Covariance times q, without the covariance: one pass of X'(Xq) over the centred vectors."""
        return self.total(lambda x: x.T @ (x @ q), *q.shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda x: (x * x).sum(0)[None], 1, self.d).sum() / self.n)


def offsets(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(n*x - S exactly, the same over n in double) of a block; Python integers where 64 bits do not hold them."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62 and max(map(abs, sums)) < 1 << 62:
        y = n * x - np.array(sums, np.int64)
        return y, y / n
    y = n * x.astype(object) - np.array(sums, object)
    return y, np.array([[float(c) / n for c in row] for row in y.tolist()]).reshape(y.shape)


def squares(y: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row; None where it is no long."""
    if y.dtype != object and y.shape[1] * int(np.abs(y).max(initial=0)) ** 2 < 1 << 63:
        return (y * y).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(c * c for c in row) for row in y.tolist())]


def usable(vec: Column) -> Column:
    return vec.isNotNull() & ~F.coalesce(F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(True))


def spread(vectors: DataFrame, id_col: str, vec_col: str) -> Spread | None:
    """Blocks of whole-number vectors of the commonest length (ties: the longer), written once; None without any."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(usable(F.col("v")) & (F.size("v") > 0))
    size = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return None
    d = size.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                c = np.floor(SCALE * part.column(1).flatten().to_numpy().reshape(-1, d))
                x = np.clip(c, -float(LIMIT), float(LIMIT)).astype(np.int64) + SHIFT
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()),
                     pa.array([[sum(col) for col in x.T.tolist()]] if abs(c).max() * BLOCK > 1 << 61 else [x.sum(0).tolist()], pa.list_(pa.decimal128(38, 0)))],
                    ["ids", "x", "s"],
                )

    blocks = written(src.where(F.size("v") == d).mapInArrow(run, "ids array<long>, x binary, s array<decimal(38,0)>"), "blocks")
    got = blocks.select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = {r.i: int(r.s) for r in got}
    return Spread(blocks.select("ids", "x"), size["count"], [sums[i] for i in range(d)])


# --- components ------------------------------------------------------------------------------------------------------


def chebyshev(times, q: np.ndarray, vq: np.ndarray, low: float, cut: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of degree DEGREE on [low, cut] applied to q: what lies there is damped against what lies above."""
    half, mid = (cut - low) / 2, (cut + low) / 2
    s = half / (top - mid)
    first = s
    before, now = q, (vq - mid * q) * (s / half)
    for _ in range(DEGREE - 1):
        s_next = 1 / (2 / first - s)
        before, now, s = now, 2 * (s_next / half) * (times(now) - mid * now) - s * s_next * before, s_next
    return now


def principal(times, d: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the symmetric matrix behind times, wanted of them, certified.

    Each cycle filters the block, orthonormalises it (QR), solves the small problem inside it (Rayleigh-Ritz) and measures the residuals of
    the wanted vectors. A block whose residuals fall too slowly, as the eigenvalue at its edge is close to the last wanted one, widens; as
    wide as the space it needs no filter.
    """
    rng = np.random.default_rng(seed)
    width = min(d, wanted + GUARD)
    q, worst = np.linalg.qr(rng.standard_normal((d, width)))[0], np.inf
    for _ in range(CYCLES):
        vq = times(q)
        e, u = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        e, u = e[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        live = [k for k in range(wanted) if e[k] > FLAT * e[0]] if e[0] > 0 else []
        now = max((np.linalg.norm(vq[:, k] - e[k] * q[:, k]) / e[0] for k in live), default=0.0)
        if now <= SURE or width == d:
            return e[live], q[:, live]
        slow, worst = now > worst / 10, now
        if slow:
            more = min(d - width, GUARD)
            width += more
            q = np.linalg.qr(np.c_[q, rng.standard_normal((d, more))])[0]
            if width < d:
                continue
        else:
            q = chebyshev(times, q, vq, 0.0, max(e[-1], e[0] * 1e-12), e[0])
        q = np.linalg.qr(q)[0]
    raise ArithmeticError(f"components not certified: residual {worst:.1e} of the largest eigenvalue")


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    Vectors that are null, empty or hold null or non-finite entries take no part, nor do those of another length than the commonest (ties:
    the longer). Entries beyond 2^61 after scaling are held there. Repeated rows count and return as often as they occur; null ids stay null.
    Components without spread (eigenvalue at most 1e-9 of the largest) cannot be whitened and have no rows, so fewer dimensions or vectors
    than components give fewer; a single vector, equal vectors or an empty table give no row. deviation is null where it is no long.
    """
    spark = vectors.sparkSession
    s = spread(vectors, id_col, vec_col)
    if s is None or not (trace := s.trace()):
        return spark.createDataFrame([], OUT)
    e, q = principal(s.times, s.d, min(components, s.d))
    k, n, sums = len(e), s.n, s.sums
    onto = q / np.sqrt(e)
    # mean and second moments of the whitened values themselves, as they are returned
    m = s.total(lambda x: np.c_[np.ones(len(x)), x @ onto].T @ (x @ onto), k + 1, k) / n
    error = float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(k)).max())
    shares = e / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in zip(b.column(0), b.column(1)):
                y, c = offsets(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, len(sums)), n, sums)
                w, rows = c @ onto, len(y)
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)),
                     pa.array(squares(y), pa.int64()).take(each), pa.array(w.ravel()), pa.array(np.tile(shares, rows)), pa.array(np.full(rows * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return s.blocks.mapInArrow(run, OUT)
