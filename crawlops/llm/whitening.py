"""Whitening of embeddings by float32 eigenvectors that are refined in higher precision.

Counts, sums and the Gram matrix are sums of whole numbers, so they are exact and the same for
any dealing of the rows.  Single-precision eigenvectors of the covariance are a start only:
each step of Ogita and Aishima multiplies matrices in extended precision and doubles the right
digits.  Eigenvectors whose eigenvalues lie too close for that are turned within their
space by the eigenvectors of the small problem that the cluster leaves (a sub-solve).
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 64
COMPONENTS = 32
ROWS = 4_096  # vectors multiplied at a time
WIDEST = 1 << 62  # components beyond this, as whole numbers, count as this
LIMB = 40  # bits of a part of a large whole number
LIMBS = 4
EXACT = 1 << 53
STEPS = 12  # at most; each one doubles the right digits
SLICES = 3  # of about 21 bits, so that a product has 63
ALIKE = 2.0**-62  # eigenvalues that differ by less than this share of the largest are equal as far as the numbers tell

Matrix = np.ndarray


def usable(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole(vectors: pa.Array, size: int) -> Matrix:
    """Floors of 64 times the components; a shorter vector ends in zeros."""
    ends = np.diff(np.asarray(vectors.offsets))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.repeat(np.arange(len(ends)), ends)
    places = np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)
    out = np.zeros((len(ends), size), dtype=np.int64)
    with np.errstate(over="ignore"):
        scaled = np.floor(np.clip(SCALE * flat, -float(WIDEST), float(WIDEST)))
    out[rows, places] = scaled.astype(np.int64)
    return out


def gram(z: Matrix) -> Matrix:
    """Exact products of the columns as Python integers."""
    most = int(np.abs(z).max(initial=0))
    if most * most * max(len(z), 1) < EXACT:  # doubles hold all sums
        wide = z.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).astype(object)
    wide = z.astype(object)
    return wide.T.dot(wide)


def limbs(value: int) -> list[int]:
    """Parts of LIMB bits, the last one signed: their sums over many tasks stay in a long."""
    mask = (1 << LIMB) - 1
    return [value >> (LIMB * i) & mask for i in range(LIMBS - 1)] + [value >> (LIMB * (LIMBS - 1))]


def exact_sums(vectors: DataFrame, add: Callable[[pa.Array], dict[tuple[int, int], int]]) -> dict[tuple[int, int], int]:
    """Whole numbers that ``add`` finds in each batch of ``vector``, summed over all tasks by (i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for key, value in add(batch.column(0).slice(at, ROWS)).items():
                    total[key] = total.get(key, 0) + int(value)
        rows = [(*key, *limbs(value)) for key, value in total.items()]
        names = ["i", "j", *[f"l{k}" for k in range(LIMBS)]]
        types = [pa.int32()] * 2 + [pa.int64()] * LIMBS
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], names=names)

    parts = [f"l{k}" for k in range(LIMBS)]
    found = vectors.select("vector").mapInArrow(run, "i int, j int, " + ", ".join(f"{p} long" for p in parts))
    summed = found.groupBy("i", "j").agg(*[F.sum(p).alias(p) for p in parts]).collect()  # one row per pair of dimensions
    return {(r["i"], r["j"]): sum(r[p] << (LIMB * k) for k, p in enumerate(parts)) for r in summed}


@dataclass(frozen=True)
class Whitening:
    """What turns a vector into whitened components; ``sums`` are those of the shifted whole numbers."""

    n: int
    sums: list[int]  # of floor(64 c), by dimension
    values: Matrix  # falling eigenvalues of the covariance
    vectors: Matrix  # unit eigenvectors as columns
    trace: float

    @property
    def kept(self) -> Matrix:
        """Which components have any variance."""
        return self.values > len(self.sums) * np.finfo(np.float64).eps * max(self.trace, 0.0)

    def centred(self, y: Matrix) -> Matrix:
        """``x - S / n``: the difference of whole numbers is exact, the division is rounded once."""
        middle = [s // self.n for s in self.sums]
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        near = y - np.array(middle, dtype=np.int64)
        return near.astype(np.float64) - rest

    def deviations(self, y: Matrix) -> list[int]:
        """Exact sums over the dimensions of ``(n x - S)^2``."""
        bound = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums), default=0)
        if y.shape[1] * bound * bound < 1 << 63:
            d = self.n * y - np.array(self.sums, dtype=np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * y.astype(object) - np.array(self.sums, dtype=object)
        return [int(v) for v in (d * d).sum(axis=1)] if y.shape[1] else [0] * len(y)


def slices(m: Matrix, axis: int, bits: int) -> list[Matrix]:
    """Doubles of few bits, aligned along ``axis``, that add up to the matrix."""
    out = []
    for _ in range(SLICES):
        top = np.abs(m).max(axis=axis, keepdims=True).astype(np.float64)
        unit = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1))) - bits)
        out.append((np.rint((m / unit).astype(np.float64)) * unit).astype(np.float64))
        m = m - out[-1]
    return out


def multiplied(a: Matrix, b: Matrix) -> Matrix:
    """Matrix product in extended precision: exact double products of slices, added as long doubles.

    Where the platform's long double is a plain double, so is the result.
    """
    bits = (53 - int(np.ceil(np.log2(max(a.shape[1], 2))))) // 2
    left, right = slices(a.astype(np.longdouble), 1, bits), slices(b.astype(np.longdouble), 0, bits)
    pairs = sorted(((i, j) for i in range(SLICES) for j in range(SLICES) if i + j <= SLICES), key=sum, reverse=True)
    return sum((left[i] @ right[j]).astype(np.longdouble) for i, j in pairs)


def corrected(a: Matrix, x: Matrix) -> tuple[Matrix, Matrix, Matrix]:
    """One step of Ogita and Aishima: better vectors, their values, and which pairs lie too close to be told apart."""
    size = len(a)
    lack = np.eye(size, dtype=np.longdouble) - multiplied(x.T, x)
    spread = multiplied(x.T, multiplied(a, x))
    values = np.diag(spread) / (1 - np.diag(lack))
    off = spread - np.diag(values)
    close = 2 * (np.linalg.norm(off.astype(np.float64), 2) + np.linalg.norm(a.astype(np.float64), 2) * np.linalg.norm(lack.astype(np.float64), 2))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= close
    step = np.where(near, lack / 2, (spread + values[None, :] * lack) / np.where(near, 1, gap))
    return x + multiplied(x, step), values, near


def clusters(near: Matrix, values: Matrix) -> list[Matrix]:
    """Neighbours in the order of the values that hang together."""
    order = np.argsort(-values.astype(np.float64), kind="stable")
    joined = [near[order[i], order[i + 1]] for i in range(len(order) - 1)]
    cuts = np.flatnonzero(~np.array(joined, dtype=bool)) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refined(a: Matrix) -> tuple[Matrix, Matrix]:
    """Falling eigenvalues and unit eigenvectors of a symmetric matrix, to double precision."""
    size = len(a)
    largest = np.abs(a).max(initial=0)
    if not size or not largest:
        return np.zeros(size), np.eye(size)
    a = a.astype(np.longdouble) / largest
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    norm = np.linalg.norm(a.astype(np.float64), 2)
    best, stuck = np.inf, 0
    for _ in range(STEPS):
        x, values, near = corrected(a, x)
        for group in clusters(near, values):
            # The space of the cluster is known far better than the vectors in it: what the matrix does there,
            # less its mean value, is a small problem whose own scale tells the values apart.
            own = x[:, group]
            own = orthogonal(own)
            mean = values[group].mean()
            inside = multiplied(own.T, multiplied(a, own) - mean * own)
            scale = np.abs(inside).max()
            if scale > ALIKE * norm:
                small = np.linalg.eigh(((inside + inside.T) / (2 * scale)).astype(np.float64))[1]
                x[:, group] = multiplied(own, small)
        change = residual(a, x)
        stuck = stuck + 1 if change >= best / 2 else 0
        best = min(best, change)
        if stuck == 2 or best < size * np.finfo(np.longdouble).eps:
            break
    x = orthogonal(orthogonal(x))
    values = np.einsum("ij,ij->j", x, multiplied(a, x))
    order = np.argsort(-values.astype(np.float64), kind="stable")
    x, values = x[:, order], values[order] * largest
    signs = np.sign(x[np.abs(x.astype(np.float64)).argmax(axis=0), np.arange(size)])
    return values.astype(np.float64), (x * signs).astype(np.float64)


def orthogonal(x: Matrix) -> Matrix:
    """Columns that are nearer to orthogonal and of length one."""
    return multiplied(x, np.eye(x.shape[1]) * np.longdouble(1.5) - multiplied(x.T, x) / 2)


def residual(a: Matrix, x: Matrix) -> float:
    """Largest entry of what is missing from orthogonal vectors that make the matrix diagonal."""
    spread = multiplied(x.T, multiplied(a, x))
    off = spread - np.diag(np.diag(spread))
    lack = np.eye(len(a)) - multiplied(x.T, x)
    return float(max(np.abs(off).max(), np.abs(lack).max()))


def fit(vectors: DataFrame) -> Whitening | None:
    """Whitening of all rows of ``vector``, usable arrays of numbers; None without rows.

    The driver gets one row per dimension and per pair of dimensions, whatever the number of rows.
    """
    sizes = vectors.agg(F.max(F.size("vector")).alias("size"), F.count(F.lit(1)).alias("n")).first()
    if not sizes["n"]:
        return None
    size, n = sizes["size"], sizes["n"]

    def sums(part: pa.Array) -> dict[tuple[int, int], int]:
        y = whole(part, size)
        small = int(np.abs(y).max(initial=0)) * ROWS < 1 << 62
        return {(i, -1): int(v) for i, v in enumerate((y if small else y.astype(object)).sum(axis=0))}

    found = exact_sums(vectors, sums)
    total = [found.get((i, -1), 0) for i in range(size)]
    middle = np.array([s // n for s in total], dtype=np.int64)

    def products(part: pa.Array) -> dict[tuple[int, int], int]:
        g = gram(whole(part, size) - middle)
        return {(i, j): g[i, j] for i in range(size) for j in range(i, size)}

    # The centre of the products is the whole part of the mean; what is left of it comes off in whole numbers.
    pairs, rest = exact_sums(vectors, products), [s % n for s in total]
    cov = np.zeros((size, size), dtype=np.longdouble)
    for i in range(size):
        for j in range(i, size):
            top = n * pairs[i, j] - rest[i] * rest[j]
            cov[i, j] = cov[j, i] = np.longdouble(top // (n * n)) + np.longdouble(top % (n * n)) / np.longdouble(n * n)
    values, axes = refined(cov)
    return Whitening(n, total, values, axes, float(np.trace(cov)))


def identity_error(vectors: DataFrame, found: Whitening, count: int) -> float:
    """Largest absolute entry of the covariance of the whitened components minus the identity."""
    turn = projection(found, count)
    size = len(found.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, count))
        first = np.zeros(count)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = found.centred(whole(batch.column(0).slice(at, ROWS), size)) @ turn
                total += w.T @ w
                first += w.sum(axis=0)
        i, j = np.indices((count, count))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i.ravel(), np.arange(count)), pa.int32()), pa.array(np.append(j.ravel(), [-1] * count), pa.int32()),
             pa.array(np.append(total.ravel(), first))], names=["i", "j", "v"],
        )

    rows = vectors.select("vector").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    by = {(r["i"], r["j"]): r["v"] / found.n for r in rows}
    # The rows are centred before they are multiplied; what rounding leaves of their mean comes off here.
    return max(abs(by[i, j] - by[i, -1] * by[j, -1] - (i == j)) for i in range(count) for j in range(count))


def projection(found: Whitening, count: int) -> Matrix:
    return found.vectors[:, :count] / np.sqrt(found.values[:count])


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error``: every usable vector along its leading components.

    ``whitened`` and ``explained`` are arrays with one entry per component, in the order of falling
    eigenvalues; ``deviation`` is an exact decimal, null beyond 38 digits.  Each component c counts
    as floor(64 c) + 1000000.

    Rows whose vector is null or holds null or non-finite entries leave; null ids and repeated
    rows stay and count each time; shorter vectors end in zeros; components
    without variance (a constant dimension, equal vectors, fewer rows than dimensions) are left
    out, so the arrays can be empty; components beyond 2^62 / 64 count as that; an empty table gives
    no rows; other columns are not read.
    """
    kind = vectors.schema[id_col].dataType
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    schema = f"vec_id {kind.simpleString()}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    found = fit(rows)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    count = min(components, int(found.kept.sum()))
    error = identity_error(rows, found, count) if count else 0.0
    turn = projection(found, count)
    explained = (found.values[:count] / found.trace if count else np.zeros(0)).tolist()
    size, most = len(found.sums), 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y = whole(part.column(1), size)
                w = found.centred(y) @ turn
                deep = found.deviations(y)
                if max(deep, default=0) >= 1 << 63:
                    deviation = pa.array([decimal.Decimal(d) if d < most else None for d in deep], pa.decimal128(38, 0))
                else:
                    deviation = pa.array(deep, pa.int64()).cast(pa.decimal128(38, 0))
                offsets = pa.array(np.arange(len(y) + 1) * count, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), deviation, pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))],
                    names=["vec_id", "deviation", "whitened"],
                )

    out = rows.mapInArrow(run, f"vec_id {kind.simpleString()}, deviation decimal(38,0), whitened array<double>")
    return out.select(
        "vec_id", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.lit(explained).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"),
    )
