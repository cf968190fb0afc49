"""Vector functions in double precision; 0 vectors have no direction and give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda n, x: n + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double")))


def normalised(a: Column | str) -> Column:
    size = norm(a)
    return F.transform(_col(a), lambda x: F.try_divide(x.cast("double"), size))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cos, never below 0. Vectors of different length are an error."""
    checked = F.when(F.size(_col(a)) == F.size(_col(b)), _col(a)).when(_col(a).isNull() | _col(b).isNull(), None).otherwise(F.raise_error(F.lit("vectors of different length")).cast("array<double>"))
    cosine = F.try_divide(dot(checked, b), norm(a) * norm(b))
    return F.when(cosine > 1, 0.0).otherwise(1 - cosine)


def similarity(distance: Column | str) -> Column:
    """0 for opposite, 1 for equal directions."""
    return 1 - _col(distance) / 2
