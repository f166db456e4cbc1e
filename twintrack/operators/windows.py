"""Multi-scale sliding summaries of frame features: windows of frames, complete ones only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import checks
from ..functions.core import around, series
from .frames import FEATURES, kind

META = ["session_idx", "center_frame", "center_time_s", "window_sec", "valid_frame_fraction"]
STATS = {"numeric": ["mean", "std", "min", "max", "delta", "slope"], "boolean": ["occupancy", "onset_rate"], "circular": ["circmean", "resultant"]}
SCALES = (0.2, 0.5, 1.0, 2.0)


def frames_of(seconds: float, fps: float) -> tuple[int, int, int]:
    """(frames, before, after) of a window of that many seconds."""
    n = max(1, math.floor(seconds * fps + 0.5))
    return n, (n - 1) // 2, n // 2


def label(feature: str, stat: str, seconds: float) -> str:
    return f"{feature}__{stat}__{seconds:.1f}s".replace(".", "_")


def _columns(feature: str, as_kind: str, w, frame, fps: float, stats: list[str], method: str, before: int, after: int) -> tuple[dict, dict]:
    """(columns to add first, statistics by name). ``method`` prefix: sums over a window as differences of running sums."""
    x = F.col(feature)
    have = x.isNotNull()
    n = F.count(x).over(frame)
    if method == "prefix":
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        total = lambda c: F.lead(F.sum(F.coalesce(c, F.lit(0.0))).over(run), after).over(w) - F.coalesce(F.lag(F.sum(F.coalesce(c, F.lit(0.0))).over(run), before + 1).over(w), F.lit(0.0))
    else:
        total = lambda c: F.sum(F.coalesce(c, F.lit(0.0))).over(frame)
    if as_kind == "numeric":
        k = f"_k_{feature}"
        first = {k: F.sum(have.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))}
        if method == "prefix":
            # about the session's mean, so that squares don't cancel
            c = f"_c_{feature}"
            whole = Window.partitionBy("session_idx")
            first |= {c: x - F.avg(x).over(whole)}
            m = total(F.col(c)) / F.nullif(n, F.lit(0))
            var = (total(F.col(c) * F.col(c)) - n * m * m) / F.nullif(n - 1, F.lit(0))
            mean = F.avg(x).over(whole) + m
            std = F.when(n == 1, F.lit(0.0)).when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0))))
            # k is a run of whole numbers over the window's values: its mean and spread are known
            kc = F.when(have, (F.col(k) - F.max(k).over(whole) / 2).cast("double"))
            km = total(kc) / F.nullif(n, F.lit(0))
            sxy = total(kc * F.col(c)) - n * km * m
            # the largest of a window: of the rest of the piece that it begins in, and of the piece that it ends in so far
            piece = Window.partitionBy("session_idx", "_seg")
            for name, best in (("min", F.min), ("max", F.max)):
                if name in stats:
                    first |= {f"_{name}_to_{feature}": best(x).over(piece.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)), f"_{name}_from_{feature}": best(x).over(piece.orderBy(F.col("frame").desc()).rowsBetween(Window.unboundedPreceding, 0))}
            slope = F.when(n >= 2, sxy * 12 / F.nullif(n * (n.cast("double") * n - 1), F.lit(0.0)) * fps)
        else:
            mean = F.avg(x).over(frame)
            std = F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(x).over(frame))
            slope = F.when(n >= 2, F.regr_slope(x, F.when(have, F.col(k))).over(frame) * fps)
        made = {
            "mean": mean, "std": std, "slope": slope,
            **{name: both(F.lag(f"_{name}_from_{feature}", before).over(w), F.lead(f"_{name}_to_{feature}", after).over(w)) if method == "prefix" else one(x).over(frame) for name, one, both in (("min", F.min, F.least), ("max", F.max, F.greatest))},
            "delta": F.last(x, ignorenulls=True).over(frame) - F.first(x, ignorenulls=True).over(frame),
        }
    elif as_kind == "boolean":
        b, rise = f"_b_{feature}", f"_r_{feature}"
        on = F.when(have, (x > 0.5).cast("int"))
        previous = F.last(on, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        first = {b: on, rise: F.when(have, ((on == 1) & (F.coalesce(previous, F.lit(0)) == 0)).cast("int"))}
        # the first value of a window counts as a rise if it is on
        head = F.first(F.when(have, F.struct(F.col(b).alias("b"), F.col(rise).alias("r"))), ignorenulls=True).over(frame)
        extra = ((head["b"] == 1) & (head["r"] == 0)).cast("int")
        made = {"occupancy": F.avg(b).over(frame), "onset_rate": F.when(n > 0, (F.sum(rise).over(frame) + extra) / F.nullif(n, F.lit(0)))}
    else:
        c, s = f"_cos_{feature}", f"_sin_{feature}"
        first = {c: F.cos(F.radians(x)), s: F.sin(F.radians(x))}
        mc, ms = (total(F.col(v)) / F.nullif(n, F.lit(0)) if method == "prefix" else F.avg(v).over(frame) for v in (c, s))
        made = {"circmean": F.degrees(F.atan2(ms, mc)), "resultant": F.hypot(mc, ms)}
    return first, {k: v for k, v in made.items() if k in stats}


def summarize_scale(features: DataFrame, seconds: float, fps: float = 80.0, names: list[str] | None = None, stats: dict | None = None, full: bool = True, max_missing: float = 0.1, method: str = "sliding", plain: bool = False) -> DataFrame:
    """One row for each complete window of one scale: META columns and ``feature__stat__scale`` (``plain``: without the scale).

    A window has round(seconds * fps) frames, the extra one of an even number after its centre. Windows that reach over an end are
    left out, and with ``full`` those with fewer ok frames than 1 - ``max_missing``. Statistics leave nulls out; the slope is
    against the count of values, not against time. ``method`` prefix takes sums from running sums and extremes from those of pieces
    as long as a window, in time independent of its length.
    """
    names, stats = FEATURES if names is None else names, stats or STATS
    checks.positive(seconds=seconds, fps=fps)
    checks.share(max_missing=max_missing)
    checks.one_of("method", method, ("sliding", "prefix"))
    checks.columns(features.columns, names)
    n, before, after = frames_of(seconds, fps)
    w = series("session_idx")
    frame = around(w, before, after)
    first, made = {}, {}
    for f in names:
        extra, got = _columns(f, kind(f), w, frame, fps, stats[kind(f)], method, before, after)
        first |= extra
        made |= {f"{f}__{s}" if plain else label(f, s, seconds): c for s, c in got.items()}
    rows = features.select("session_idx", "frame", "time_s", "frame_ok", *names)
    size = F.count(F.lit(1)).over(Window.partitionBy("session_idx"))
    rows = rows.withColumns({"_pos": F.row_number().over(w), "_size": size})
    if method == "prefix":
        rows = rows.withColumn("_seg", F.floor((F.col("_pos") - 1) / n))
    rows = rows.withColumns(first)
    rows = rows.select("session_idx", F.col("frame").alias("center_frame"), F.col("time_s").alias("center_time_s"), F.lit(float(seconds)).alias("window_sec"), F.avg(F.col("frame_ok").cast("double")).over(frame).alias("valid_frame_fraction"), "_pos", "_size", *[c.alias(k) for k, c in made.items()])
    rows = rows.where((F.col("_pos") > before) & (F.col("_pos") + after <= F.col("_size"))).drop("_pos", "_size")
    return rows.where(F.col("valid_frame_fraction") >= 1 - max_missing) if full else rows


def summarize(features: DataFrame, scales=SCALES, fps: float = 80.0, layout: str = "wide", **options) -> DataFrame:
    """All scales together. Layout wide: a column for each scale, null in rows of the others; per_scale: the same columns for all scales."""
    labels = [f"{s:.1f}" for s in scales]
    if len(set(labels)) < len(labels):
        raise ValueError("window sizes must differ at one decimal")
    if layout not in ("wide", "per_scale"):
        raise ValueError(f"unknown layout {layout!r}")
    parts = [summarize_scale(features, s, fps, plain=layout == "per_scale", **options) for s in scales]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def summary_meta(spark, scales=SCALES, first_scale_only: bool = False) -> DataFrame:
    """(summary_name, source_feature, statistic, family) of every summary column."""
    from .frames import FAMILIES

    rows = [(label(f, s, w), f, s, family) for w in (scales[:1] if first_scale_only else scales) for family, names in FAMILIES for f in names for s in STATS[kind(f)]]
    return spark.createDataFrame(rows, "summary_name string, source_feature string, statistic string, family string")


def prune_frames(features: DataFrame, first: int, last: int, halo: int) -> DataFrame:
    """Frames that rows with a centre in [first, last] need: Spark doesn't push such a range below a window by itself."""
    return features.where(F.col("frame").between(first - halo, last + halo))
