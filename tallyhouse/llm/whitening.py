"""Whitening of embeddings by eigenvectors found in single precision and refined in a higher one.

Entries become whole numbers, so the count, the sums and the centred second moments of the distinct vectors are exact,
whatever the partitions are, and add up in a shuffle of one row for each pair of dimensions and task. The covariance is
then small (dimensions squared). Its eigenvectors come from a float32 solver and are corrected by the matrix
multiplications of Ogita and Aishima in extended precision, which double the right digits each time; eigenvalues too
close for that are handled together, by solving the small problem within their common space. Rows are projected where
they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.common import Store

#: The higher precision: 64 bits of mantissa on x86.
WIDE = np.longdouble
#: Steps of refinement at most; each doubles the right digits of float32's seven.
STEPS = 12
#: Vectors multiplied together in a task.
BLOCK = 4096
#: Doubles hold whole numbers up to this exactly.
EXACT = 1 << 53

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x array<long>), x = floor(scale * entry) of each entry as double; vectors that are null, empty or hold null or non-finite entries go."""
    e = F.col(vector_col).cast("array<double>")
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = vectors.where(e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(bad, F.lit(True)))
    return usable.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(e, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_gram(z: np.ndarray) -> np.ndarray:
    """z^T z of whole numbers, exactly, as Python ints: by products of doubles where these can't round, else by ints."""
    most = int(np.abs(z).max(initial=0))
    out = np.zeros((z.shape[1], z.shape[1]), object)
    rows = BLOCK if not most else min(BLOCK, EXACT // (most * most))
    if rows == 0:
        wide = z.astype(object)
        return wide.T @ wide
    for lo in range(0, len(z), rows):
        d = z[lo : lo + rows].astype(np.float64)
        out = out + (d.T @ d).astype(np.int64).astype(object)
    return out


def _by_dimension(parts, arrays: list[str]):
    """Rows (i, j, s) of sums over a task, s as text, since sums may pass 64 bits."""
    import pyarrow as pa

    i, j, s = parts
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(x) for x in s], pa.string())], arrays)


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and the sum of each dimension over (x), exactly."""

    def run(batches):
        n, total = 0, np.zeros(d, object)
        for b in batches:
            x = _matrix(b.column(0))
            n += len(x)
            wide = x if len(x) * int(np.abs(x).max(initial=0)) < 1 << 62 else x.astype(object)
            total = total + wide.sum(axis=0).astype(object)
        if n:
            yield _by_dimension(([-1, *range(d)], [0] * (d + 1), [n, *total]), ["i", "j", "s"])

    rows = fit.select("x").mapInArrow(run, "i int, j int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = {r["i"]: int(r["s"]) for r in rows.collect()}  # one row for each dimension
    return got.get(-1, 0), [got.get(i, 0) for i in range(d)]


def moments(fit: DataFrame, centre: list[int]) -> tuple[np.ndarray, list[int]]:
    """Sums of z z^T and of z over (x), z = x - centre, exactly."""
    d, at = len(centre), np.array(centre, np.int64)
    upper = np.triu_indices(d)

    def run(batches):
        gram, first = np.zeros((d, d), object), np.zeros(d, object)
        for b in batches:
            z = _matrix(b.column(0)) - at
            gram = gram + exact_gram(z)
            first = first + z.astype(object).sum(axis=0)
        yield _by_dimension(([*upper[0].tolist(), *[-1] * d], [*upper[1].tolist(), *range(d)], [*gram[upper], *first]), ["i", "j", "s"])

    rows = fit.select("x").mapInArrow(run, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    gram, first = np.zeros((d, d), object), [0] * d
    for r in rows.collect():  # one row for each pair of dimensions
        if r["i"] < 0:
            first[r["j"]] = int(r["s"])
        else:
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = int(r["s"])
    return gram, first


def covariance(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, sums and the covariance with divisor n in WIDE. Centring takes the whole part of the means first; what their
    fractions add is then taken off exactly, so nothing cancels."""
    n, total = sums(fit, d)
    if n == 0:
        return 0, total, np.zeros((d, d), WIDE)
    gram, first = moments(fit, [s // n for s in total])
    exact = n * gram - np.outer(np.array(first, object), np.array(first, object))  # n^2 times the covariance
    return n, total, np.array([[WIDE(str(x)) for x in row] for row in exact], WIDE).reshape(d, d) / (WIDE(n) * WIDE(n))


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Places of neighbouring eigenvalues (sorted) that lie within `near` of the next one."""
    cuts = np.flatnonzero(np.abs(np.diff(values)) > near) + 1
    return np.split(np.arange(len(values)), cuts)


def refined(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix in WIDE, from a float32 start.

    Each step measures by products in WIDE how far the vectors are from orthogonal and from diagonal, and corrects both.
    Pairs of eigenvalues that lie too near for this step's errors are only made orthogonal; their common space is then
    solved on its own, with their mean taken off, which brings out differences that were lost beside the large values.
    """
    d = len(a)
    scale = np.abs(a).max(initial=0)
    if d == 0 or scale == 0:
        return np.zeros(d, WIDE), np.eye(d, dtype=WIDE)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(WIDE)
    one, eps, last = np.eye(d, dtype=WIDE), np.finfo(WIDE).eps, np.inf
    for step in range(STEPS):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diagonal(s) / (1 - np.diagonal(r))
        off = s - np.diag(np.diagonal(s))
        near = 2 * (np.linalg.norm(off.astype(np.float64)) + np.linalg.norm(r.astype(np.float64)))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > near
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        e = np.triu(e) + np.triu(r - e, 1).T  # e + e^T = r, whatever was rounded where a gap is small
        x = x + x @ e
        order = np.argsort(-values, kind="stable")
        x, values = x[:, order], values[order]
        for places in _clusters(values, near):
            if len(places) > 1:
                some = x[:, places]
                middle = values[places].mean()
                inner = some.T @ (a @ some - middle * some)
                spread = np.abs(inner).max()
                if spread > 0:
                    turn = np.linalg.eigh((inner / spread).astype(np.float64))[1][:, ::-1]
                    x[:, places] = some @ turn.astype(WIDE)
        change = float(np.abs(e).max())
        if change <= 4 * d * eps or change >= last and step > 5:
            break
        last = change
    x = x + x @ ((one - x.T @ x) / 2)
    x = x / np.sqrt((x * x).sum(axis=0))
    values = np.array([v @ (a @ v) for v in x.T], WIDE)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


@dataclass
class Whitener:
    """What the fit list says: n, sums, and of each component its vector and its eigenvalue's root and share."""

    n: int
    total: list[int]
    vectors: np.ndarray
    roots: np.ndarray
    explained: list[float]

    def rows(self, ids, x: np.ndarray):
        """Columns of SCHEMA but the last, for rows of x."""
        import pyarrow as pa

        small = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.total)) < 1 << 62
        off = x * self.n - np.array(self.total) if small else x.astype(object) * self.n - np.array(self.total, object)
        most = int(np.abs(off).max(initial=0))
        wide = off if most * most * x.shape[1] < 1 << 63 else off.astype(object)
        deviation = [int(v) for v in (wide * wide).sum(axis=1)]
        k = len(self.roots)
        white = ((off.astype(WIDE) / self.n) @ self.vectors / self.roots).astype(np.float64)
        m = len(x)
        return [
            pa.array([i for i in ids for _ in range(k)], pa.int64()), pa.array(list(range(1, k + 1)) * m, pa.int32()), pa.array([self.n] * (k * m), pa.int64()),
            pa.array([v if v < 1 << 63 else None for v in deviation for _ in range(k)], pa.int64()), pa.array(white.reshape(-1)), pa.array(self.explained * m, pa.float64()),
        ]


def fit(x: DataFrame, d: int, components: int = 4) -> Whitener:
    """The whitener of the distinct vectors (x). Components whose eigenvalue is 0 to double precision are left out."""
    n, total, v = covariance(x, d)
    values, vectors = refined(v)
    trace = np.trace(v)
    k = int((values[:components] > d * np.finfo(np.float64).eps * max(values.max(initial=0), 0)).sum()) if n else 0
    return Whitener(n, total, vectors[:, :k], np.sqrt(values[:k]), [float(e / trace) for e in values[:k]])


def apply(x: DataFrame, w: Whitener) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained) of (vec_id, x)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                some = b.slice(lo, BLOCK)
                yield pa.RecordBatch.from_arrays(w.rows(some.column(0).to_pylist(), _matrix(some.column(1))), SCHEMA_NAMES)

    return x.mapInArrow(run, SCHEMA.rsplit(",", 1)[0])


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")][:-1]


def identity_error(x: DataFrame, w: Whitener) -> float:
    """Largest absolute entry of the covariance of the distinct vectors (x), whitened, minus the identity, from the doubles that apply() gives."""
    k = len(w.roots)
    if k == 0:
        return 0.0

    def run(batches):
        import pyarrow as pa

        for b in batches:
            white = w.rows([0] * b.num_rows, _matrix(b.column(0)))[4].to_numpy().reshape(-1, k)
            yield pa.RecordBatch.from_arrays([pa.array(white[:, i]) for i in range(k)], [f"c{i}" for i in range(k)])

    white = x.mapInArrow(run, ", ".join(f"c{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = white.agg(*[F.covar_pop(f"c{i}", f"c{j}").alias(f"{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """Rows of SCHEMA: each usable vector's first principal coordinates, brought to variance 1 over the distinct vectors.

    Null, empty, and partly null or non-finite vectors have no rows. Repeated rows all have rows, and count once in the
    fit; ids may be shared or null; other columns do no harm. Vectors of different lengths are whitened apart, each
    length by its own fit (the distinct vectors are written once, and dropped when they were read), of which n and identity_error then speak. Fewer than `components` rows come where a length
    has fewer dimensions or variance in fewer directions; a single distinct vector has none. A deviation beyond 64 bits
    is null. Signs: the entry of greatest size in a component's vector is positive.
    """
    x = whole(vectors, id_col, vector_col)
    lengths = sorted(r["d"] for r in x.select(F.size("x").alias("d")).distinct().collect())  # dimensions of the models in use
    found, store = [], Store(vectors.sparkSession, "whitening")
    for d in lengths:
        rows = x.where(F.size("x") == d)
        distinct = store.put(rows.select("x").distinct())
        w = fit(distinct, d, components)
        if len(w.roots):
            top = np.abs(w.vectors).argmax(axis=0)
            w.vectors = w.vectors * np.sign(w.vectors[top, np.arange(len(w.roots))])
            found.append(apply(rows, w).withColumn("identity_error", F.lit(identity_error(distinct, w)).cast("double")))
    store.drop_all_but()
    return reduce(DataFrame.unionByName, found) if found else x.sparkSession.createDataFrame([], SCHEMA)
