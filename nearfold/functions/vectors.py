"""Vector scalar functions as Spark Column expressions.

Vectors are ``array<float>``; arithmetic is done in double.  All builders
accept a Column or a column name and stay JVM-side (higher-order functions).
A component-count mismatch makes ``zip_with`` pad with NULL, so every
two-vector function returns NULL for vectors of different dimension.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed format of the vector text literal: "[" + "%.6f" components joined by "," + "]".
VECTOR_TEXT_FORMAT = "%.6f"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    """Inner product (V6)."""
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    """Euclidean norm (V4)."""
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def l2_distance(a, b) -> Column:
    """Euclidean distance, the ``<->`` operator (V1)."""
    return F.sqrt(
        _sum(F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)))
    )


def l1_distance(a, b) -> Column:
    """Manhattan distance (V3)."""
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def cosine_distance(a, b, norm_a=None, norm_b=None) -> Column:
    """1 - cosine similarity, the ``<=>`` operator (V2); NULL when a norm is 0.

    Pass precomputed norm columns to avoid recomputing them per pair.
    """
    na = norm(a) if norm_a is None else _c(norm_a)
    nb = norm(b) if norm_b is None else _c(norm_b)
    den = na * nb
    return F.when(den > 0, F.lit(1.0) - dot(a, b) / den)


def normalize(a, norm_a=None) -> Column:
    """v / |v| as array<double>; NULL for the zero vector (V5)."""
    n = norm(a) if norm_a is None else _c(norm_a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n))


def dims(a) -> Column:
    """Number of components (V7)."""
    return F.size(_c(a))


def has_nan(a) -> Column:
    """True when some component is NaN (V8)."""
    return F.exists(_c(a), lambda x: F.isnan(x))


def to_vector_text(a) -> Column:
    """``[0.123456,...]`` text literal, 6 decimals."""
    return F.concat(
        F.lit("["),
        F.array_join(F.transform(_c(a), lambda x: F.format_string(VECTOR_TEXT_FORMAT, x.cast("double"))), ","),
        F.lit("]"),
    )


def from_vector_text(s) -> Column:
    """Parse a ``[v1,v2,...]`` literal back to array<float>."""
    return F.from_json(_c(s), "array<float>")


DISTANCES = {
    "l2": l2_distance,
    "cosine": cosine_distance,
    "l1": l1_distance,
}


def distance(metric: str, a, b) -> Column:
    try:
        return DISTANCES[metric](a, b)
    except KeyError:
        raise ValueError(f"unknown metric {metric!r}; expected one of {sorted(DISTANCES)}") from None
