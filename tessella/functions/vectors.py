"""Vector functions, Column -> Column, of built-in higher-order functions; arithmetic is in doubles."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def bound(v: Column, f: Callable[[Column], Column]) -> Column:
    """f of v, which is computed once, however often f uses it; a column that is named in a lambda would be computed for each element."""
    return F.get(F.transform(F.array(v), f), F.lit(0))


def rounded(v: Column | str, digits: int) -> Column:
    """A double, rounded as SQL does: times 10^digits to the nearest whole number, halves away from zero, and back. A negative number near zero gives -0.0."""
    m = 10.0**digits

    def f(x: Column) -> Column:
        size = F.abs(x * m)
        whole = F.floor(size).cast("double")
        near = F.signum(x) * F.when(size - whole >= 0.5, whole + 1.0).otherwise(whole) / m
        return F.when(size < 2.0**52, near).when(size < float("inf"), x * m / m).otherwise(x)

    return bound((F.col(v) if isinstance(v, str) else v).cast("double"), f)


def total(v: Column) -> Column:
    """The sum of an array, in order."""
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x)


def zipped(a: Column, b: Column, f: Metric) -> Column:
    return F.zip_with(doubles(a), doubles(b), f)


def dot(a: Column, b: Column) -> Column:
    return total(zipped(a, b, lambda x, y: x * y))


def ip_dist(a: Column, b: Column) -> Column:
    """One less the inner product."""
    return 1 - dot(a, b)


def l2sq(a: Column, b: Column) -> Column:
    return total(zipped(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; -1 for vectors of different size."""
    return F.when(F.size(a) != F.size(b), F.lit(-1.0)).otherwise(F.sqrt(l2sq(a, b)))


def l1(a: Column, b: Column) -> Column:
    return total(zipped(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float) -> Column:
    """The sum of powers, without the root."""
    return total(zipped(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(zipped(a, b, lambda x, y: F.abs(x - y)))


def hist_intersect(a: Column, b: Column) -> Column:
    return total(zipped(a, b, lambda x, y: F.least(x, y)))


def hellinger(a: Column, b: Column) -> Column:
    return total(zipped(a, b, lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y))))


def chi2(a: Column, b: Column) -> Column:
    """Bins whose sum is not positive count nothing."""
    return total(zipped(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0)))


def kl(a: Column, b: Column) -> Column:
    """Bins that are zero on a side count nothing."""
    return total(zipped(a, b, lambda x, y: F.when((x > 0) & (y > 0), x * F.ln(F.when((x > 0) & (y > 0), x / y).otherwise(1.0))).otherwise(0.0)))


def jensen_shannon(a: Column, b: Column) -> Column:
    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.ln(F.when(x > 0, 2 * x / (x + y)).otherwise(1.0))).otherwise(0.0)

    return total(zipped(a, b, lambda x, y: half(x, y) + half(y, x)))


def mahalanobis(a: Column, b: Column, scale: Column) -> Column:
    """With a diagonal scale: the root of the sum of scaled squares."""
    squares = zipped(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(dot(squares, scale))


def kernel(name: str, a: Column, b: Column) -> Column:
    """Kernels l1 (intersection), l2 (linear), chi2, hellinger and js of the histogram family."""
    if name == "l1":
        return hist_intersect(a, b)
    if name == "l2":
        return dot(a, b)
    if name == "chi2":
        return total(zipped(a, b, lambda x, y: F.when(x + y > 0, 2 * x * y / (x + y)).otherwise(0.0)))
    if name == "hellinger":
        return total(zipped(a, b, lambda x, y: F.sqrt(x * y)))
    if name == "js":
        part = lambda x, y: F.when(x > 0, x * F.log2(F.when(x > 0, (x + y) / x).otherwise(1.0))).otherwise(0.0)
        return total(zipped(a, b, lambda x, y: 0.5 * (part(x, y) + part(y, x))))
    raise ValueError(name)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2norm(v: Column, least: float = 1e-12) -> Column:
    return bound(doubles(v), lambda u: bound(F.greatest(norm(u), F.lit(least)), lambda n: F.transform(u, lambda x: x / n)))


def root_sift(v: Column, eps: float = 1e-7) -> Column:
    """Absolute values over their sum, square roots, unit length."""
    size = F.transform(doubles(v), lambda x: F.abs(x))
    return l2norm(bound(size, lambda a: bound(total(a) + F.lit(eps), lambda s: F.transform(a, lambda x: F.sqrt(x / s)))))


def l1_root(v: Column) -> Column:
    return bound(doubles(v), lambda u: bound(total(u), lambda s: F.transform(u, lambda x: F.sqrt(x / s))))


def to_u8(v: Column) -> Column:
    """round(512 x), clamped to 0..255."""
    return F.transform(doubles(v), lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(x * 512))).cast("int"))


def permute(v: Column, order: Sequence[int]) -> Column:
    """Element i of the result is element order[i] of v, from 0."""
    return F.transform(F.array(*map(F.lit, order)), lambda i: F.get(v, i))


def residual(v: Column, centre: Column) -> Column:
    return zipped(v, centre, lambda x, y: x - y)


def segment(v: Column, i: int, width: int) -> Column:
    return F.slice(v, i * width + 1, width)


def matmul(rows: Column, v: Column) -> Column:
    """A matrix, an array of rows, times a vector."""
    return F.transform(rows, lambda r: dot(r, v))


def sift_angle(a: Column, b: Column) -> Column:
    """The angle of vectors of length 512."""
    return F.acos(F.least(dot(a, b) / (512.0 * 512.0), F.lit(1.0)))


def threshold_bits(v: Column, thresholds: Column) -> Column:
    """Bit i is set if element i is over threshold i; at most 64 elements, one long."""
    over = zipped(v, thresholds, lambda x, t: F.when(x > t, 1.0).otherwise(0.0))
    places = F.transform(over, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(places, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def hamming_weight(distance: Column, most: int = 24, sigma2: float = 256.0) -> Column:
    return F.when(distance <= most, F.exp(-(distance * distance) / sigma2)).otherwise(0.0)


METRICS: dict[str, Metric] = {
    "ip": ip_dist, "l2sq": l2sq, "l2": l2, "l1": l1, "linf": linf, "hist_intersect": hist_intersect, "hellinger": hellinger, "chi2": chi2, "kl": kl, "js": jensen_shannon, "cosine": cosine,
}


def kernel_map(x: Column, period: float = 0.65) -> Column:
    """Three numbers whose inner product with those of another positive number is near their chi-square kernel 2 x y / (x + y)."""
    size = F.sqrt(x * (2 * period) / F.cosh(F.lit(math.pi * period)))
    return F.array(F.sqrt(x * period), size * F.cos(period * F.ln(x)), size * F.sin(period * F.ln(x)))
