"""Helpers for embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(id_col: str, vec_col: str):
    """Condition: the id is not null, and the vector is neither null nor zero and holds finite numbers only."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(id_col).isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def usable_vectors(rows: DataFrame, id_col: str, vec_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of keep, dim and vec (little-endian doubles) of the usable rows."""
    chosen = rows.select(F.col(id_col).cast("long").alias("id"), *keep, F.col(vec_col).cast("array<double>").alias("vec"))
    good = chosen.filter(usable("id", "vec"))
    kept = good.drop("vec").schema

    def pack(batches):
        for batch in batches:
            at = batch.schema.get_field_index("vec")
            lists = batch.column(at)
            flat, sizes = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
            ends = np.cumsum(sizes)
            vec = [flat[e - n : e].tobytes() for e, n in zip(ends, sizes)]
            others = [batch.column(k) for k in range(at)]
            yield pa.RecordBatch.from_arrays([*others, pa.array(sizes, pa.int32()), pa.array(vec, pa.binary())], names=[*batch.schema.names[:at], "dim", "vec"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return good.select(*kept.names, "vec").mapInArrow(pack, f"{fields}, dim int, vec binary")


def matrix(column) -> np.ndarray:
    """Rows of equal dimension from a binary column of doubles."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def trusted(norms: np.ndarray) -> np.ndarray:
    """Whether products of norms are such that no square in them can have overflowed or vanished."""
    return (norms > 1e-120) & (norms < 1e120)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
