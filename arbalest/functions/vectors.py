"""Column functions on array<double> vectors. All sums run in order, so that they are reproducible bit for bit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def let(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row; plainly nested, it would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(ZERO), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column | str) -> Column:
    """L2-normalised; a zero vector stays zero."""
    return let(v, lambda u: let(norm(u), lambda n: F.when(n > 0, F.transform(u, lambda x: x / n)).otherwise(u)))


def floor_unit(v: Column | str, least: float = 1e-6) -> Column:
    """Divided by its norm, or by ``least`` if that is larger."""
    return let(v, lambda u: let(F.greatest(norm(u), F.lit(least)), lambda n: F.transform(u, lambda x: x / n)))


def combine(a: Column | str, b: Column | str, wa: float, wb: float) -> Column:
    return F.zip_with(a, b, lambda x, y: F.lit(wa) * x + F.lit(wb) * y)


def mean(v: Column) -> Column:
    return let(v, lambda u: total(u) / F.size(u))


def frobenius(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def l1(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def min_max(v: Column | str) -> Column:
    """Scaled to 0..1; a constant vector becomes zeros."""
    scaled = lambda u, r: F.transform(u, lambda x: F.when(r["hi"] > r["lo"], (x - r["lo"]) / (r["hi"] - r["lo"])).otherwise(F.lit(ZERO)))
    return let(v, lambda u: let(bounds(u), lambda r: scaled(u, r)))


def bounds(v: Column) -> Column:
    return F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))


def z_score(v: Column | str, eps: float = 1e-6) -> Column:
    """(x - mean) / (population deviation + eps)."""
    spread = lambda u, m: F.sqrt(total(F.transform(u, lambda x: (x - m) * (x - m))) / F.size(u))
    return let(v, lambda u: let(mean(u), lambda m: let(spread(u, m), lambda s: F.transform(u, lambda x: (x - m) / (s + F.lit(eps))))))


def clean(v: Column | str) -> Column:
    """NaN and infinities become 0."""
    return F.transform(v, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(ZERO)).otherwise(x))


def close(a: Column, b: Column, atol: float = 1e-4) -> Column:
    """Equal lengths and all components within ``atol``."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= atol)


def entropy(codes: Column) -> Column:
    """Shannon entropy (nats) of the values of an array, summed in the order of the values."""

    def shares(c: Column) -> Column:
        n = lambda v: F.size(F.filter(c, lambda x: x == v)).cast("double") / F.size(c)
        return total(F.transform(F.array_sort(F.array_distinct(c)), lambda v: let(n(v), lambda p: p * F.log(p))))

    return let(codes, lambda c: -shares(c))


def interpolated(ordered: Column, q: float) -> Column:
    """Quantile of a sorted array, with linear interpolation."""
    at = F.lit(q) * (F.size(ordered) - 1)
    lo = F.floor(at)
    low, high = F.get(ordered, lo.cast("int")), F.get(ordered, F.least(lo + 1, F.size(ordered) - 1).cast("int"))
    return low + (high - low) * (at - lo)
