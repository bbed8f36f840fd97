"""Vector columns: norm, unit vectors, dot product with a literal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    """Euclidean length, summed in double precision."""
    return F.sqrt(
        F.aggregate(
            v,
            F.lit(0.0),
            lambda acc, x: acc + x.cast("double") * x.cast("double"),
        )
    )


def unit(v: Column) -> Column:
    """Vector of length one as ``ARRAY<FLOAT>``; zero vectors stay zero."""
    parts = F.struct(v.alias("v"), norm(v).alias("n"))
    scaled = F.transform(
        F.array(parts),
        lambda p: F.transform(
            p["v"],
            lambda x: (
                x.cast("double") / F.when(p["n"] == 0, F.lit(1.0)).otherwise(p["n"])
            ).cast("float"),
        ),
    )
    return F.get(scaled, F.lit(0))


def dot(v: Column, query: Sequence[float]) -> Column:
    """Dot product with a literal vector, summed in double precision."""
    other = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(
        F.zip_with(v, other, lambda a, b: a.cast("double") * b),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
