"""Column functions on vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this many dimensions a dot product is unrolled, so that it compiles into the stage.
UNROLLED = 128


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(vector: Column, query: Sequence[float]) -> Column:
    """The dot product with a constant vector, in doubles, left to right. A null coordinate gives null."""
    if len(query) <= UNROLLED:
        total = F.lit(0.0)
        for i, q in enumerate(query):
            total = total + F.get(vector, F.lit(i)).cast("double") * F.lit(float(q))
        return total
    return F.aggregate(F.zip_with(vector, vector_literal(query), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def valid_embedding(vector: Column, dim: int | None = None) -> Column:
    """Not empty, all coordinates there and finite, of the right dimension."""
    ok = (F.size(vector) > 0) & ~F.exists(vector, lambda x: ~is_finite(x))
    return F.coalesce(ok & (F.size(vector) == dim) if dim is not None else ok, F.lit(False))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
