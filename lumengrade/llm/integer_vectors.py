"""Integer vectors of the embedding operators: each component x becomes floor(256 * x), x as double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Largest magnitude of an integer component: squared distances and inner products of up to 64 components then fit a long.
LARGEST = 1 << 27


def integer_rows(column: pa.Array) -> list[bytes | None]:
    """The integer components of each vector as 64-bit bytes; None where the vector or a component is null, a component is not finite or
    beyond LARGEST, or there is none."""
    out: list[bytes | None] = []
    for row in column:
        values = row.values if row.is_valid else None
        if values is None or not len(values) or values.null_count:
            out.append(None)
            continue
        x = values.to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(SCALE * x)
        out.append(x.astype(np.int64).tobytes() if (np.abs(x) <= LARGEST).all() else None)  # NaN and infinity compare false
    return out


def integer_vectors(rows: DataFrame, keep: dict[str, str]) -> DataFrame:
    """(*keep, vec) of the rows whose `embedding` is usable; keep maps kept columns to their SQL types."""
    names = [*keep, "vec"]

    def run(batches):
        for part in batches:
            vec = pa.array(integer_rows(part.column("embedding")), pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), vec], names=names).filter(vec.is_valid())

    schema = ", ".join(f"`{k}` {kind}" for k, kind in {**keep, "vec": "binary"}.items())
    return rows.select(*(F.col(k).cast(kind).alias(k) for k, kind in keep.items()), "embedding").mapInArrow(run, schema)


def matrix(vec: pa.Array, dim: int) -> np.ndarray:
    """Vectors of `dim` components each, as rows of a long matrix."""
    return np.frombuffer(b"".join(vec.to_pylist()), np.int64).reshape(len(vec), dim)
