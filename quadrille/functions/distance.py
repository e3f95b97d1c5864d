"""Distances and diversity on arrays whose NULL elements are missing (FN24-FN29), and value transforms (FN18, FN19)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.basic import col


def _fold(a, b, f) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), f), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def euclidean(a, b) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a, b) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def cosine(a, b) -> Column:
    """1 - cosine similarity, with 1e-8 added to the norms' product."""
    return 1 - _fold(a, b, lambda x, y: x * y) / (F.sqrt(_fold(a, a, lambda x, y: x * y)) * F.sqrt(_fold(b, b, lambda x, y: x * y)) + 1e-8)


def bray_curtis(a, b) -> Column:
    """Negative values count as 0; the denominator is at least 1e-8."""
    up = lambda x: F.greatest(x, F.lit(0.0))
    return _fold(a, b, lambda x, y: F.abs(up(x) - up(y))) / F.greatest(_fold(a, b, lambda x, y: up(x) + up(y)), F.lit(1e-8))


def shared_features(a, b) -> Column:
    return F.size(F.filter(F.zip_with(col(a), col(b), lambda x, y: x.isNotNull() & y.isNotNull()), lambda k: k))


def _both(f):
    return lambda x, y: F.when(x.isNotNull() & y.isNotNull(), f(x, y))


def partial_bray_curtis(a, b, least: int = 2) -> Column:
    """FN25: over features that both have; NULL with fewer than ``least``, 0 where all of them are 0."""
    total = _fold(a, b, _both(lambda x, y: x + y))
    value = F.when(total > 0, _fold(a, b, _both(lambda x, y: F.abs(x - y))) / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    return F.when(shared_features(a, b) >= least, value)


def partial_euclidean(a, b, least: int = 2) -> Column:
    """FN25: scaled by the root of features / shared features."""
    n = shared_features(a, b)
    return F.when(n >= least, F.sqrt(_fold(a, b, _both(lambda x, y: (x - y) * (x - y)))) * F.sqrt(F.size(col(a)) / F.nullif(n, F.lit(0))))


def partial_jaccard(a, b, least: int = 2) -> Column:
    """FN25: on presence."""
    either = _fold(a, b, _both(lambda x, y: ((x > 0) | (y > 0)).cast("double")))
    both = _fold(a, b, _both(lambda x, y: ((x > 0) & (y > 0)).cast("double")))
    return F.when(shared_features(a, b) >= least, F.when(either > 0, 1 - both / F.nullif(either, F.lit(0.0))).otherwise(0.0))


def partial_cosine(a, b, least: int = 2) -> Column:
    dot, x2, y2 = (_fold(a, b, _both(f)) for f in (lambda x, y: x * y, lambda x, y: x * x, lambda x, y: y * y))
    norm = F.sqrt(x2) * F.sqrt(y2)
    return F.when(shared_features(a, b) >= least, F.when(norm > 0, 1 - dot / F.nullif(norm, F.lit(0.0))).otherwise(1.0))


def weighted_bray_curtis(a, b, weights, least: int = 2) -> Column:
    """FN26: infinite with fewer than ``least`` shared features."""
    at = F.sequence(F.lit(0), F.size(col(a)) - 1)

    def total(f):
        return F.aggregate(F.transform(at, lambda k: F.get(col(weights), k) * f(F.get(col(a), k), F.get(col(b), k))), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))

    return F.when(shared_features(a, b) >= least, total(lambda x, y: F.abs(x - y)) / (total(lambda x, y: x + y) + 1e-10)).otherwise(F.lit(float("inf")))


def least_features(lat, lon) -> Column:
    """FN27: 1 beyond 66.5 degrees, 2 beyond 45 and else 3; 2 without both coordinates."""
    return F.when(col(lat).isNull() | col(lon).isNull(), 2).when(F.abs(col(lat)) > 66.5, 1).when(F.abs(col(lat)) > 45, 2).otherwise(3)


def shannon(values) -> Column:
    """FN28: natural logarithm; 0 where the total isn't positive."""
    total = F.aggregate(col(values), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    terms = F.aggregate(col(values), F.lit(0.0), lambda s, x: s + F.when(x > 0, (x / F.nullif(total, F.lit(0.0))) * F.log(x / F.nullif(total, F.lit(0.0)))).otherwise(0.0))
    return F.when(total > 0, -terms).otherwise(0.0)


def simpson(values) -> Column:
    """FN28."""
    total = F.aggregate(col(values), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return F.when(total > 0, 1 - F.aggregate(col(values), F.lit(0.0), lambda s, x: s + F.pow(F.coalesce(x, F.lit(0.0)) / F.nullif(total, F.lit(0.0)), F.lit(2.0)))).otherwise(0.0)


def richness(values, abundance: bool = True) -> Column:
    """FN29: features above 0, or their sum."""
    return F.size(F.filter(col(values), lambda x: x > 0)).cast("double") if abundance else F.aggregate(col(values), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def valid_count(values) -> Column:
    return F.size(F.filter(col(values), lambda x: x.isNotNull()))


TRANSFORMS = {
    "log1p": lambda x: F.log1p(F.greatest(x, F.lit(0.0))),
    "sqrt": lambda x: F.sqrt(F.greatest(x, F.lit(0.0))),
    "arcsinh": F.asinh,
    "binary": lambda x: (x > 0).cast("double"),
    "log1p_abs": lambda x: F.log1p(F.abs(x)),
}
INVERSES = {"log1p": F.expm1, "sqrt": lambda x: x * x, "arcsinh": F.sinh}
