"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window


def yes(p: Column) -> Column:
    """A predicate that is false where it is unknown."""
    return F.coalesce(p, F.lit(False))


def finite(x: Column) -> Column:
    """Double value; NaN and infinities become null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def hazen_of(values: Column, p: float) -> Column:
    """Quantile of a sorted array without nulls by the mid-point rule: position n*p + 1/2 held in 1..n, linear between neighbours."""
    n = F.size(values)
    h = F.least(F.greatest(n * F.lit(float(p)) + 0.5, F.lit(1.0)), n.cast("double"))
    low, high = F.get(values, F.floor(h).cast("int") - 1), F.get(values, F.ceil(h).cast("int") - 1)
    return low + (h - F.floor(h)) * (high - low)


def hazen(x: Column, p: float) -> Column:
    """Aggregate: mid-point quantile of a group; nulls are left out. For groups of one series' length."""
    return hazen_of(F.sort_array(F.collect_list(x)), p)


def sample_std(x: Column) -> Column:
    """Aggregate: standard deviation (n - 1); 0 for a single value."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def strict(aggregate, x: Column) -> Column:
    """Aggregate that is null as soon as one value is."""
    return F.when(F.count(x) == F.count(F.lit(1)), aggregate(x))


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def unit(v: tuple[Column, Column]) -> tuple[Column, Column]:
    """Unit vector; null for zero length."""
    n = F.nullif(norm(*v), F.lit(0.0))
    return v[0] / n, v[1] / n


def minus(a, b):
    return a[0] - b[0], a[1] - b[1]


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1]


def left_of(v):
    """The vector turned by 90 degrees."""
    return -v[1], v[0]


def angle_deg(a, b) -> Column:
    """Signed angle from a to b in (-180, 180]."""
    return F.degrees(F.atan2(a[0] * b[1] - a[1] * b[0], dot(a, b)))


def cosine(a, b) -> Column:
    return dot(a, b) / F.nullif(norm(*a) * norm(*b), F.lit(0.0))


def series(*keys: str):
    """Window over one series in order of frames."""
    return Window.partitionBy(*keys).orderBy("frame")


def around(w, before: int, after: int):
    return w.rowsBetween(-before, after)


def dilated(mask: Column, half: int, w) -> Column:
    """Mask widened by ``half`` frames on either side."""
    return yes(F.bool_or(mask).over(around(w, half, half))) if half > 0 else mask


def step(x: Column, y: Column, w) -> Column:
    """Distance from the frame before; null at the first frame or a missing end."""
    return norm(x - F.lag(x).over(w), y - F.lag(y).over(w))


def gradient(x: Column, fps: float, w) -> Column:
    """Backward difference times fps; 0 at the first frame."""
    return F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise((x - F.lag(x).over(w)) * fps)


def moving_mean(x: Column, span: int, w) -> Column:
    """Centred mean that leaves nulls out and shrinks at the ends; an even span takes one more from before."""
    return F.avg(x).over(around(w, span // 2, (span - 1) // 2))


def smoothed(x: Column, span: int, w, whole) -> Column:
    """Moving mean, but a series of zeros and ones (or nothing) stays as it is."""
    if span <= 1:
        return x
    flags = F.coalesce(F.bool_and(x.isin(0.0, 1.0)).over(whole), F.lit(True))
    return F.when(flags, x).otherwise(moving_mean(x, span, w))

