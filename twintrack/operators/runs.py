"""Time-series kernels as windows: runs, dilation, displacement, gap filling, jump candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.core import around, dilated, hazen, series, step, yes
from ..params import Params, by_node

TRACK = ["session_idx", "animal", "node"]


def find_runs(df: DataFrame, mask: str, keys: list[str]) -> DataFrame:
    """(keys, run_start, run_stop, run_length): the maximal runs of frames where ``mask`` holds (null: it doesn't)."""
    w = series(*keys)
    m = yes(F.col(mask))
    begins = m & ~F.lag(m, 1, False).over(w)
    runs = df.select(*keys, "frame", m.alias("_m"), begins.cast("int").alias("_b"))
    runs = runs.withColumn("_run", F.sum("_b").over(w)).where("_m")
    return runs.groupBy(*keys, "_run").agg(F.min("frame").alias("run_start"), F.max("frame").alias("run_stop"), F.count("*").alias("run_length")).drop("_run")


def dilate(df: DataFrame, mask: str, half: int, keys: list[str], to: str) -> DataFrame:
    """Adds ``to``: the mask widened by ``half`` frames on either side; half 0 is the mask."""
    return df.withColumn(to, dilated(yes(F.col(mask)), half, series(*keys)))


def displacement(pose: DataFrame, to: str = "disp") -> DataFrame:
    return pose.withColumn(to, step(F.col("x"), F.col("y"), series(*TRACK)))


def jump_candidates(pose: DataFrame, p: Params | None = None) -> DataFrame:
    """Adds ``disp``, ``cutoff`` and ``jump``: the first pass of the jump filter.

    The cutoff of a track is the smaller of its displacement quantile and the pixel limit. A frame is a candidate if it is not
    excluded, is there, and lies farther than the cutoff from the frame before; candidates are widened within frames that are not
    excluded. Tracks with fewer than ``min_valid_points`` usable frames have none.
    """
    p = p or Params()
    w = series(*TRACK)
    moved = displacement(pose)
    limit = by_node(p.jump.max_disp_px_per_frame_by_node, p.jump.max_disp_px_per_frame, F.col("node"))
    usable = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.col("excluded")
    per = moved.groupBy(*TRACK).agg(hazen(F.col("disp"), p.jump.diff_quantile).alias("q"), F.count_if(usable).alias("good"))
    per = per.select(*TRACK, F.when(F.col("good") >= p.jump.min_valid_points, F.least("q", limit)).alias("cutoff"), "good")
    bad = yes((F.col("disp") > F.col("cutoff")) & ~F.col("excluded"))
    moved = moved.join(per, TRACK).withColumn("_bad", bad)
    wide = dilated(F.col("_bad"), p.jump.dilate_frames, w)
    # with fewer than two frames left to interpolate from nothing is flagged
    flagged = moved.withColumn("_flag", wide & ~F.col("excluded"))
    left = F.count_if(usable & ~F.col("_flag")).over(Window.partitionBy(*TRACK))
    return flagged.withColumn("jump", F.col("_flag") & (left >= 2)).drop("_bad", "_flag", "good")


def fill_gaps(pose: DataFrame, p: Params | None = None) -> DataFrame:
    """Fills short runs of frames that lack a coordinate, both coordinates, by interpolation in time; adds ``filled``.

    Methods linear and nearest (the later neighbour at the middle). Runs longer than the node's limit and tracks with too few
    points stay. Runs at an end stay; with ``fill_ends`` they lose the coordinate they still have, as nothing is extrapolated.
    """
    p = p or Params()
    if p.gaps.method not in ("linear", "nearest"):
        raise ValueError("window-based filling knows linear and nearest; see kernels.fill_gaps_kernel")
    w = series(*TRACK)
    back = Window.partitionBy(*TRACK).orderBy(F.col("frame").desc())
    there = F.col("x").isNotNull() & F.col("y").isNotNull()
    point = F.when(there, F.struct("frame", "time_s", "x", "y"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = pose.withColumn("_a", F.last(point, ignorenulls=True).over(before))
    rows = rows.withColumn("_b", F.last(point, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_good", F.count(point).over(Window.partitionBy(*TRACK)))
    limit = by_node(p.gaps.max_gap_frames_by_node, p.gaps.max_gap_frames, F.col("node"))
    inner = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    length = F.col("_b.frame") - F.col("_a.frame") - 1
    fill = yes(~there & inner & (length <= limit) & (F.col("_good") >= p.gaps.min_points_for_interp))
    share = (F.col("time_s") - F.col("_a.time_s")) / F.nullif(F.col("_b.time_s") - F.col("_a.time_s"), F.lit(0.0))
    if p.gaps.method == "linear":
        value = lambda c: F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * share
    else:
        value = lambda c: F.when(share >= 0.5, F.col(f"_b.{c}")).otherwise(F.col(f"_a.{c}"))
    lost = F.lit(False)
    if p.gaps.fill_ends:
        whole = Window.partitionBy(*TRACK)
        size = F.when(F.col("_a").isNull(), F.col("_b.frame") - F.min("frame").over(whole)).otherwise(F.max("frame").over(whole) - F.col("_a.frame"))
        lost = yes(~there & ~inner & (size <= limit) & (F.col("_good") >= p.gaps.min_points_for_interp))
    new = lambda c: F.when(fill, value(c)).when(lost, F.lit(None)).otherwise(F.col(c))
    rows = rows.withColumns({"_x": new("x"), "_y": new("y"), "filled": fill})
    return rows.drop("x", "y", "_a", "_b", "_good").withColumnsRenamed({"_x": "x", "_y": "y"})


def smooth_segments(pose: DataFrame, p: Params | None = None, repaired: str | None = None) -> DataFrame:
    """(track keys, run_start, run_stop, run_length) of the segments that the smoother filters: long enough, without missing frames or repairs."""
    p = p or Params()
    gap = F.col("x").isNull() | F.col("y").isNull()
    if repaired and p.smooth.break_at_repaired_points:
        gap = gap | dilated(yes(F.col(repaired)), p.smooth.repair_break_halfwidth, series(*TRACK))
    marked = pose.withColumn("_gap", gap).withColumn("_free", ~F.col("_gap"))
    return find_runs(marked, "_free", TRACK).where(F.col("run_length") >= p.smooth.min_segment_length)


__all__ = ["TRACK", "around", "dilate", "displacement", "fill_gaps", "find_runs", "jump_candidates", "smooth_segments"]
