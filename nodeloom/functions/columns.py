"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Neither NaN nor infinite."""
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def is_positive(v: Column, threshold: float = 0.5) -> Column:
    """Marker is present: strictly above the threshold, and not NaN (which Spark sorts above all)."""
    return (v > threshold) & ~F.isnan(v)


def positives(x: Column, threshold: float = 0.5) -> Column:
    """Positions (marker ids) of a node's positive markers, as array<int>."""
    return F.transform(
        F.filter(F.transform(x, lambda v, i: F.struct(i.alias("i"), v.cast("double").alias("v"))), lambda s: is_positive(s["v"], threshold)),
        lambda s: s["i"],
    )


def has_no_positive(x: Column, threshold: float = 0.5) -> Column:
    return ~F.exists(x, lambda v: is_positive(v.cast("double"), threshold))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def weighted_total(x: Column, w: Column) -> Column:
    """Sum of x[i] * w[i]."""
    return F.aggregate(F.zip_with(x, w, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, v: a + v)


def baseline_of(x: Column, mu: Column, mu_none: Column, thresholded: bool = False) -> Column:
    """Mean of the means of a node's markers: (x . mu) / sum(x); ``mu_none`` where sum(x) is 0.

    ``thresholded`` divides by the number of positive markers instead of the sum of x.
    """
    n = F.size(positives(x)).cast("double") if thresholded else total(x)
    return F.when(n > 0, F.try_divide(weighted_total(x, mu), n)).otherwise(mu_none)


def digitize(y: Column, edges: Column) -> Column:
    """Bin of y in half-open bins [edge_b, edge_b+1); NULL outside, and at the last edge."""
    b = F.size(F.filter(edges, lambda e: e <= y)) - 1
    return F.when((b >= 0) & (b < F.size(edges) - 1), b)


def linspace(lo: Column, hi: Column, n: int) -> Column:
    """n + 1 equally spaced edges."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.when(i == n, hi).otherwise(lo + (hi - lo) * i / F.lit(float(n))))


def huber(pred: Column, target: Column, delta: float = 1.0) -> Column:
    """Half squared error up to ``delta``, linear beyond; ``delta`` 0 is half squared error."""
    e = F.abs(pred - target)
    if delta == 0:
        return 0.5 * e * e
    near = F.least(e, F.lit(float(delta)))
    return 0.5 * near * near + delta * (e - near)


def inverse_transform(c: Column, scale: Column | float, center: Column | float) -> Column:
    """Undo standardisation."""
    return c * scale + center


def sem(c: Column, ddof: int = 1) -> Column:
    """Standard error of the mean; with ``ddof`` 1 it is 0 for a single row; NULL for none."""
    spread = F.stddev_pop(c) if ddof == 0 else F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return F.when(F.count(c) > 0, F.try_divide(spread, F.sqrt(F.count(c).cast("double"))))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))
