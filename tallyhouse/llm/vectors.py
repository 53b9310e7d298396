"""Embedding tables as rows of bytes: what the two operators on vectors share."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

#: Vectors looked at to place cells: those least by a hash of vec_id.
SAMPLE = 20_000


def as_bytes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None) -> DataFrame:
    """(vec_id, label, key, v): v holds the components as doubles, key is a 128-bit digest of them.

    Both are null where the vector is null, zero, empty, or has a null or non-finite component. label is null if not named.
    """
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys, values = [], []
            for x in b.column(2):
                key = value = None
                if x.is_valid:
                    v = x.values
                    if v.null_count == 0 and len(v):
                        a = v.to_numpy(zero_copy_only=False) + 0.0
                        if np.isfinite(a).all() and a.any():
                            value = a.tobytes()
                            key = xxhash.xxh128_digest(value)
                keys.append(key)
                values.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["vec_id", "label", "key", "v"])

    return rows.mapInArrow(run, "vec_id long, label string, key binary, v binary")


def matrix(values) -> np.ndarray:
    """Rows of bytes as a matrix of doubles; no rows give none."""
    values = list(values)
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if values else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows brought to length 1; scaled first, so that neither very large nor very small ones lose their squares."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def sample(rows: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """Up to most vectors of (vec_id, v), of the commonest length, in an order that the ids decide."""
    got = [r["v"] for r in rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()]
    if not got:
        return np.zeros((0, 0))
    lengths = [len(v) for v in got]
    usual = max(set(lengths), key=lengths.count)
    return matrix(v for v in got if len(v) == usual)
