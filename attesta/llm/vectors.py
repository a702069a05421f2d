"""Vectors as rows of exact integers, and their blocks as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.session import staged


def integer_rows(
    df: DataFrame, vector: str, scale: int, offset: int, most: int, keep: dict[str, Column]
) -> tuple[DataFrame, int]:
    """(stored rows with the columns of ``keep`` and x, width): x is floor(scale * entry) + offset per entry.

    Left out: rows whose vector is null, has no entries, holds a null or non-finite entry,
    or has another length than the commonest one (of equally common ones the longest), which
    no vector of that length can be compared with. An entry whose scaled value is not
    between -most and most raises an error: sums over it would no longer be exact.
    The width is 0 where no row is left.
    """
    entry = F.col("_v")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

    def scaled(c: Column) -> Column:
        wide = c.cast("double") * F.lit(float(scale))
        wrong = F.raise_error(F.format_string("entry %s times %s is out of range", c.cast("string"), F.lit(scale)))
        return F.when(F.abs(wide) > F.lit(float(most)), wrong.cast("bigint")).otherwise(F.floor(wide) + F.lit(offset))

    clean = df.select(*(c.alias(k) for k, c in keep.items()), F.col(vector).alias("_v")).filter(
        F.col("_v").isNotNull() & (F.size("_v") > 0) & F.forall("_v", finite)
    )
    rows = staged(clean.select(*keep, F.transform(entry, scaled).alias("x")))
    common = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common["width"] if common else 0
    return rows.filter(F.size("x") == width), width


def matrix(column: pa.Array, width: int, dtype: type = np.int64) -> np.ndarray:
    """A list column without nulls as a matrix of its rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)
