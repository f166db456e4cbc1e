"""Tables behind figures: histograms of many columns in one pass, and tracks as their extent in each column of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from .runs import TRACK, displacement


def histograms(df: DataFrame, columns: list[str], bins: int = 25, keys: list[str] | None = None) -> DataFrame:
    """(keys, metric, bin, low, high, count, share) of columns by equal bins from their least to their largest value; the last bin is closed.

    Nulls are left out, a column without values has no rows, one with a single value has one bin. All columns share two aggregates.
    """
    checks.whole(bins=bins)
    checks.columns(df.columns, [*columns, *(keys or [])])
    by = [*(keys or []), "metric"]
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns]
    long = df.select(*(keys or []), F.explode(F.array(*cells)).alias("c")).select(*(keys or []), "c.metric", "c.v").where("v is not null")
    edges = long.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(F.lit(bins), F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))).cast("int") + 1))
    got = long.join(edges, by).select(*by, place.alias("bin"), "lo", width.alias("width"), "n").groupBy(*by, "bin", "lo", "width", "n").agg(F.count("*").alias("count"))
    return got.select(*by, "bin", (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("low"), (F.col("lo") + F.col("bin") * F.col("width")).alias("high"), "count", (F.col("count") / F.col("n")).alias("share"))


def step_histograms(pose: DataFrame, node: int, bins: int = 120) -> DataFrame:
    """``histograms`` of the steps of one node by session and animal, for raw or cleaned tracks."""
    return histograms(displacement(pose.where(F.col("node") == node)), ["disp"], bins, ["session_idx", "animal"])


def extents(pose: DataFrame, pixels: int = 1600) -> DataFrame:
    """(track keys, pixel, first_frame, last_frame, min_x, max_x, min_y, max_y, n): what a plot of ``pixels`` columns can show of each track.

    A column of pixels stands for equal parts of the session's frames; its extremes draw the same line as all of its frames.
    """
    checks.whole(pixels=pixels)
    ends = pose.groupBy(F.col("session_idx").alias("_s")).agg(F.min("frame").alias("_lo"), F.max("frame").alias("_hi"))  # a row for each session
    at = F.floor((F.col("frame") - F.col("_lo")) * F.lit(pixels) / (F.col("_hi") - F.col("_lo") + 1)).cast("int")
    rows = pose.join(ends, F.col("session_idx").eqNullSafe(F.col("_s"))).withColumn("pixel", at)
    return rows.groupBy(*TRACK, "pixel").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))], F.count("x").alias("n"))
