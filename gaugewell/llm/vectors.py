"""Reading vectors: which take part, and how they travel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import bounded_batches


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, v) of the vectors that take part: not null, of the usual length, finite, not zero.

    v holds the components as float64, little-endian. The usual length is the one most rows have.
    """
    bounded_batches(df.sparkSession)
    sizes = df.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            flat = column.flatten()
            v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(d, 1)) if d else np.zeros((0, 1))
            good = np.isfinite(v).all(axis=1) & (np.abs(v).max(axis=1, initial=0) > 0)
            v = np.ascontiguousarray(v + 0.0, dtype="<f8")  # one zero
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() if g else None for r, g in zip(v, good)], pa.binary())], names=["vec_id", "v"])

    whole = df.where(F.size(vector_col) == F.lit(d)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return whole.mapInArrow(run, "vec_id long, v binary").where("v IS NOT NULL")


def matrix(column) -> np.ndarray:
    """Rows of the v column as a matrix."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1) if raw else np.zeros((0, 0))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is taken out first, so that no square overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))
