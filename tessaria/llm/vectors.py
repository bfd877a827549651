"""Integer vectors: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component becomes floor(SCALE * x).
SCALE = 256
#: Integers lie within this bound on both sides; what a component beyond it would become is set to it.
LARGEST = 1 << 62


def usable(vector: Column) -> Column:
    """The vector isn't null, nor is a component null, infinite or not a number."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector.cast("array<double>"), bad)


def integers(vector: Column, width: int) -> Column:
    """floor(SCALE * x) of each component, as an array of longs; a shorter vector is filled up with zeros to ``width``."""
    whole = F.transform(vector.cast("array<double>"), lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("long"))
    return F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(width) - F.size(whole))))


def extent(rows: DataFrame, vector: str) -> tuple[int, int, int]:
    """(rows, largest number of components, largest magnitude of a component as an integer) of usable vectors, from one aggregate."""
    top = F.coalesce(F.array_max(F.transform(F.col(vector).cast("array<double>"), F.abs)), F.lit(0.0))
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("w"), F.coalesce(F.max(top), F.lit(0.0)).alias("m")).first()
    return r["n"], r["w"], min(LARGEST, int(min(r["m"] * SCALE, 2.0**63)) + 1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of ``width`` longs as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
