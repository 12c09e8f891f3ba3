"""Vectors as exact integers, so that distances and inner products do not depend on how sums are ordered.

Used by the operators on vectors. A component x becomes floor(scale * x), x as a double; results beyond MOST are taken as MOST (and
below -MOST as -MOST), so that squares of up to 64 components and 100 times an inner product fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 1 << 25


def integers(df: DataFrame, keep: list[str], vector: str, scale: int = 256, width: int | None = None) -> DataFrame:
    """The columns of keep and values (array<int>). Rows with a null vector, a null or non-finite component, or (given a width)
    another number of components are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(len(keep))
            usable = pc.is_valid(listed)
            if width is not None:
                usable = pc.and_(usable, pc.equal(pc.fill_null(pc.list_value_length(listed), -1), width))
            batch = batch.filter(usable)
            listed = batch.column(len(keep))
            lengths = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
            x = listed.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            odd = np.repeat(np.arange(len(lengths)), lengths)[~np.isfinite(x)]
            good = np.ones(len(lengths), bool)
            good[odd] = False
            x = x[np.repeat(good, lengths)]
            values = pa.array(np.clip(np.floor(scale * x), -MOST, MOST).astype(np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths[good])]).astype(np.int32))
            kept = [batch.column(i).filter(pa.array(good)) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(offsets, values)], [*keep, "values"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "values array<int>"])
    return df.select(*keep, F.col(vector).cast("array<double>").alias("values")).mapInArrow(run, schema)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one width as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x and of y. Small numbers go through floating point, where all sums are exact."""
    most = max((int(abs(m).max()) for m in (x, y) if m.size), default=0)
    if most * most * max(1, x.shape[-1]) < 1 << 52:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T
