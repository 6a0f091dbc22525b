"""Vector expressions over ARRAY<DOUBLE> columns, evaluated JVM-side.

Every function takes and returns `Column`s, so the expressions stay inside
the optimiser's plan (no Python round trip per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double_vector(x) -> Column:
    """ARRAY<FLOAT> at rest -> ARRAY<DOUBLE> for arithmetic."""
    return _c(x).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda u, v: u * v), F.lit(0.0), lambda acc, t: acc + t)


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, t: acc + t * t)


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def sq_euclidean(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda u, v: (u - v) * (u - v)), F.lit(0.0),
                       lambda acc, t: acc + t)


def euclidean(a, b) -> Column:
    return F.sqrt(sq_euclidean(a, b))


def cosine_distance(a, b, norm_a=None, norm_b=None) -> Column:
    """1 - a.b / (|a||b|); 1.0 when either norm is zero."""
    na = norm(a) if norm_a is None else _c(norm_a)
    nb = norm(b) if norm_b is None else _c(norm_b)
    den = na * nb
    return F.when(den == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / den)


def scale(a, s) -> Column:
    s = _c(s) if not isinstance(s, (int, float)) else F.lit(float(s))
    return F.transform(_c(a), lambda t: t * s)


def l2_normalize(a) -> Column:
    """Row L2 normalisation; a zero row stays zero."""
    n = norm(a)
    return F.when(n == 0, F.transform(_c(a), lambda t: t * 0.0)).otherwise(F.transform(_c(a), lambda t: t / n))


def subtract(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda u, v: u - v)


def elementwise_divide(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda u, v: u / v)


def whiten(z, lam, ridge: float = 1e-8) -> Column:
    """z_k / sqrt(lambda_k + ridge): Mahalanobis with a diagonal inverse covariance
    becomes plain Euclidean distance on whitened coordinates."""
    return F.zip_with(_c(z), _c(lam), lambda u, v: u / F.sqrt(v + F.lit(ridge)))


def pad_to(a, dim: int) -> Column:
    """Zero-pad (or leave) a vector to `dim` entries."""
    n = F.size(_c(a))
    return F.when(n >= dim, _c(a)).otherwise(
        F.concat(_c(a), F.array_repeat(F.lit(0.0), F.lit(dim) - n)))
