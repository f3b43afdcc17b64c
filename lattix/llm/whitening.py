"""Whitening components of embeddings by shifted Cholesky QR.

An entry c becomes the whole number x = floor(1024 c) + 100000 (``SCALE``, ``OFFSET``). With the exact sums S of the n
x-vectors, rows are centred as (n x - S) / n before anything is multiplied. A pass sums the Gram matrix G of the rows, its
Cholesky factor (of G plus a small shift, so that it exists however ill-conditioned G is) is sent out, and the next pass
takes the rows through a triangular solve by every factor so far. That repeats until the rows are orthonormal. The product R
of the factors then has the rows' singular values and right singular vectors, without the covariance's squared condition:
components are the right singular vectors v of R by falling singular value s, with eigenvalues s^2 / n.

How it scales: nothing moves but sums. A pass sends, for each task, one matrix with as many rows as a vector has entries,
added up cell by cell with sums per task; factors of that size are all that is broadcast or reaches the driver. Tables
are read by column, once for each pass (six for well-conditioned rows). Whatever vector is common counts as often as it occurs.

Results for odd inputs: rows whose vector is null, empty, or holds null or non-finite entries are left out, as are rows of
another length than the commonest (of equally common ones, the longest), which have no place in the space; entries beyond
2^42 count as that; repeated rows and null ids are rows of their own; components whose variance is nothing but rounding
(equal rows, fewer rows than dimensions) don't exist, so such tables have fewer than ``k`` or none; an empty table gives an
empty result; other columns are not read. ``deviation`` is null beyond 64 bits, where ``deviation_exact`` still has it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
TOP = 8
#: Largest entry, least rows that a worker multiplies at a time, passes at most, and how near to orthonormal rows must come.
LARGEST, ROWS, PASSES, NEAR = 1 << 42, 4096, 8, 1e-12
_ROUND = np.finfo(np.float64).eps


def whole(batch: pa.RecordBatch, d: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of rows, x-vectors) of the valid rows of a batch (id, vector), by length or of one length only."""
    vectors = batch.column(1)
    vectors = vectors.cast(pa.list_(pa.float64())) if vectors.type != pa.list_(pa.float64()) else vectors
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes) if d is None else [d]:
        at = np.flatnonzero(sizes == size)
        if not size or not len(at):
            continue
        flat = pc.list_flatten(vectors.take(pa.array(at)))
        c = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, size)
        good = np.isfinite(c).all(1)
        yield at[good], np.floor(np.clip(c[good], -LARGEST, LARGEST) * SCALE).astype(np.int64) + OFFSET


def _sizes(batches):
    for batch in batches:
        found = [(x.shape[1], x.shape[0]) for _, x in whole(batch)]
        yield pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["size", "n"])


def _sums(d: int):
    """dim, n, low, high: sums of the entries' lower 32 bits and of what is above, which 64 bits hold exactly."""

    def run(batches):
        n, low, high = 0, np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
        for batch in batches:
            for _, x in whole(batch, d):
                n, low, high = n + len(x), low + (x & 0xFFFFFFFF).sum(0), high + (x >> 32).sum(0)
        yield pa.record_batch([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(low), pa.array(high)], names=["dim", "n", "low", "high"])

    return run


@dataclass
class Centre:
    """The number of rows and the sums of their entries, S = n * base + rest."""

    n: int
    sums: list[int]
    base: np.ndarray = field(init=False)
    rest: np.ndarray = field(init=False)

    def __post_init__(self):
        self.base = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = np.array([s % self.n for s in self.sums], dtype=np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in doubles; whole parts are subtracted as whole numbers."""
        return (x - self.base) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of (n x - S)^2."""
        near = x - self.base
        if len(x) and (int(np.abs(near).max()) + 1) ** 2 * self.n**2 * x.shape[1] < 1 << 63:
            z = near * self.n - self.rest
            return (z * z).sum(1).tolist()
        z = near.astype(object) * self.n - self.rest.astype(object)
        return (z * z).sum(1).tolist()


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """The rows through the triangular solve by each upper factor, column by column."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(rows.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def _gram(centre: Centre, taken: Callable[[np.ndarray], np.ndarray], width: int):
    """i, j, g: what a task's rows add to the upper half of the Gram matrix."""
    i, j = np.triu_indices(width)

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for _, x in whole(batch, len(centre.sums)):
                for k in range(0, len(x), ROWS):
                    q = taken(centre.rows(x[k : k + ROWS]))
                    total += q.T @ q
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "g"])

    return run


def gram(rows: DataFrame, centre: Centre, taken: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    cells = rows.mapInArrow(_gram(centre, taken, width), "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toArrow()
    out = np.zeros((width, width))
    i, j, g = (cells.column(c).to_numpy() for c in ("i", "j", "g"))
    out[i, j] = out[j, i] = g
    return out


@dataclass
class Whitening:
    """A fitted model: the centre, unit components as columns, their eigenvalues, all eigenvalues' sum, and the error of the result."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def matrix(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))


def triangular(rows: DataFrame, centre: Centre) -> np.ndarray:
    """R of the QR decomposition of the centred rows: the product of the factors of all passes."""
    d = len(centre.sums)
    factors: list[np.ndarray] = []
    for _ in range(PASSES):
        sent = list(factors)
        g = gram(rows, centre, lambda q: solved(q, sent), d)
        if not factors and not np.trace(g) > 0:
            return np.zeros((d, d))
        if factors and np.abs(g - np.eye(d)).max() < NEAR:
            break
        shift = 0.0 if factors else 11 * (ROWS * d + d * (d + 1)) * _ROUND * np.trace(g)
        while True:  # a factor exists once the shift is above the rounding of g
            try:
                factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
                break
            except np.linalg.LinAlgError:
                shift = max(16 * shift, 11 * d * (d + 1) * _ROUND * np.trace(g))
    r = np.eye(d)
    for factor in factors:
        r = factor @ r
    return r


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP) -> Whitening | None:
    """The whitening of all valid rows; None without any."""
    rows = _vectors(df, id_col, vector_col)
    sizes = rows.mapInArrow(_sizes, "size long, n long").groupBy("size").agg(F.sum("n").alias("n")).where("n > 0")
    most = sizes.orderBy(F.col("n").desc(), F.col("size").desc()).first()
    if most is None:
        return None
    wide = "decimal(38,0)"
    sums = rows.mapInArrow(_sums(most["size"]), "dim long, n long, low long, high long").groupBy("dim")
    sums = sums.agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast(wide)).alias(c) for c in ("low", "high")]).orderBy("dim").collect()
    centre = Centre(sums[0]["n"], [int(r["high"]) * (1 << 32) + int(r["low"]) for r in sums])
    r = triangular(rows, centre)
    _, s, v = np.linalg.svd(r)
    values = s**2 / centre.n
    held = min(k, int((s > len(s) * 64 * _ROUND * s[0]).sum())) if s[0] > 0 else 0
    components = v[:held].T
    components = components * np.sign(components[np.abs(components).argmax(0), np.arange(held)])
    found = Whitening(centre, components, values[:held], float(values.sum()))
    if held:
        matrix = found.matrix
        found.identity_error = float(np.abs(gram(rows, centre, lambda q: q @ matrix, held) / centre.n - np.eye(held)).max())
    return found


_SCHEMA = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("deviation_exact", pa.decimal128(38, 0)), ("values", pa.list_(pa.float64()))])


def _whitened(model: Whitening):
    def run(batches):
        d, width = model.components.shape
        matrix = model.matrix
        for batch in batches:
            for at, x in whole(batch, d):
                exact = model.centre.deviations(x)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array((model.centre.rows(x) @ matrix).ravel()))
                fits = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
                yield pa.record_batch([batch.column(0).take(pa.array(at)), fits, pa.array([Decimal(e) for e in exact], pa.decimal128(38, 0)), values], schema=_SCHEMA)

    return run


def whiten(df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact: a row for each vector and component."""
    rows = _vectors(df, id_col, vector_col)
    if model is None or not len(model.values):
        rows, shares, n, error = rows.limit(0), [1.0], 0, 0.0
        done = rows.select(F.col(rows.columns[0]).alias("vec_id"), F.lit(0).cast("long").alias("deviation"), F.lit(0).cast("decimal(38,0)").alias("deviation_exact"), F.array(F.lit(0.0)).alias("values"))
    else:
        shares, n, error = (model.values / model.trace).tolist(), model.centre.n, model.identity_error
        done = rows.mapInArrow(_whitened(model), "vec_id long, deviation long, deviation_exact decimal(38,0), values array<double>")
    tall = done.select("vec_id", "deviation", "deviation_exact", F.posexplode("values").alias("at", "whitened"))
    return tall.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, shares)), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact",
    )


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(rows, fit(rows))
