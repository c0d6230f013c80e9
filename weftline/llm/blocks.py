"""Integer vectors packed into blocks, so that each row of a table is a matrix and not a vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors in a block.
ROWS = 4_096
#: Element types by the first byte of a packed block.
WIDTHS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))


def pack(x: np.ndarray) -> bytes:
    """A matrix of integers in the narrowest type that holds all of them."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(k for k, w in enumerate(WIDTHS) if np.iinfo(w).min <= low and high <= np.iinfo(w).max)
    return bytes([kind]) + x.astype(WIDTHS[kind]).tobytes()


def unpack(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, WIDTHS[data[0]], offset=1).astype(np.int64).reshape(-1, dims)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of a list column whose lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def usable(vector: Column, below: float) -> Column:
    """Whether a vector is neither null nor empty and all its entries are finite and smaller than ``below``."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < below)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry), F.lit(False))


def grid(vector: Column, scale: int) -> Column:
    """Each entry times ``scale``, as double, rounded down to a long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * float(scale)))


def blocked(rows: DataFrame, x: str = "x") -> DataFrame:
    """Blocks of rows: ``x`` (array of longs, one length) packed, every other column as a list.

    Blocks follow the partitions and batches of ``rows``; nothing is shuffled.
    """
    others = [f for f in rows.schema.fields if f.name != x]
    schema = ", ".join([*(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in others), f"{x} binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(f.name)) for f in others]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([pack(matrix(part.column(x)))], pa.binary())], [*(f.name for f in others), x])

    return rows.mapInArrow(run, schema)
