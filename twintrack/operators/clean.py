"""Track cleaning: confidence mask, jumps, gaps, geometry, arena, smoothing, and their composition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import hazen, hazen_of, norm, series, step, yes
from ..params import Params, by_node
from ..sources.scratch import written
from . import kernels
from .runs import TRACK, fill_gaps, jump_candidates

ANIMAL = ["session_idx", "animal"]


def confidence_thresholds(pose: DataFrame, p: Params | None = None) -> DataFrame:
    """(track keys, threshold, was_relaxed, mask_fraction_initial, mask_fraction_final) of every track."""
    c = (p or Params()).confidence
    mode = c.mode.lower()
    s = F.sort_array(F.collect_list("score"))
    rows = pose.groupBy(*TRACK).agg(s.alias("s"), F.count("*").alias("n"))
    if mode == "adaptive_per_node":
        start = F.coalesce(F.greatest(F.lit(c.min_threshold), hazen_of(F.col("s"), c.prctile / 100)), F.lit(c.min_threshold))
    elif mode == "fixed":
        start = F.lit(c.threshold)
    else:
        start = by_node(c.threshold_by_node, None, F.col("node"))
    below = lambda t: F.size(F.filter("s", lambda v: v < t)) / F.col("n")
    rows = rows.withColumn("t0", start).withColumn("mask_fraction_initial", below(F.col("t0")))
    rows = rows.withColumn("was_relaxed", F.col("mask_fraction_initial") > c.max_mask_fraction)
    rows = rows.withColumn("threshold", F.when(F.col("was_relaxed"), F.least("t0", F.lit(c.relaxed_threshold))).otherwise(F.col("t0")))
    return rows.select(*TRACK, "threshold", "was_relaxed", "mask_fraction_initial", below(F.col("threshold")).alias("mask_fraction_final"))


def mask_confidence(pose: DataFrame, p: Params | None = None) -> DataFrame:
    """Coordinates with a score below their track's threshold become null; adds ``low_conf``. A missing score masks nothing."""
    p = p or Params()
    if not p.confidence.enabled:
        return pose.withColumn("low_conf", F.lit(False))
    t = confidence_thresholds(pose, p).select(*TRACK, "threshold")
    rows = pose.join(t, TRACK).withColumn("low_conf", yes(F.col("score") < F.col("threshold")))
    return hide(rows, "low_conf").drop("threshold")


def hide(rows: DataFrame, mask: str) -> DataFrame:
    return rows.withColumns({c: F.when(~F.col(mask), F.col(c)) for c in ("x", "y")})


def pair_distances(pose: DataFrame, p: Params | None = None) -> DataFrame:
    """(session_idx, animal, frame, n1, n2, dd, s1, s2, d1, d2): distance, scores and displacements (0 at the first frame) of each node pair."""
    pairs = (p or Params()).qc.geometry_node_pairs
    nodes = sorted({n for q in pairs for n in q})
    w = series(*TRACK)
    moved = F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(step(F.col("x"), F.col("y"), w))
    rows = pose.where(F.col("node").isin(nodes)).select(*ANIMAL, "frame", "node", F.struct("x", "y", "score", moved.alias("d")).alias("v"))
    wide = rows.groupBy(*ANIMAL, "frame").agg(*[F.max(F.when(F.col("node") == n, F.col("v"))).alias(f"v{n}") for n in nodes])
    one = lambda a, b: F.struct(F.lit(a).alias("n1"), F.lit(b).alias("n2"), norm(F.col(f"v{a}.x") - F.col(f"v{b}.x"), F.col(f"v{a}.y") - F.col(f"v{b}.y")).alias("dd"), F.col(f"v{a}.score").alias("s1"), F.col(f"v{b}.score").alias("s2"), F.col(f"v{a}.d").alias("d1"), F.col(f"v{b}.d").alias("d2"))
    return wide.select(*ANIMAL, "frame", F.explode(F.array(*[one(a, b) for a, b in pairs])).alias("q")).select(*ANIMAL, "frame", "q.*")


def geometry_limits(distances: DataFrame, p: Params | None = None) -> DataFrame:
    """(session_idx, animal, n1, n2, low, high) of the pairs with at least 20 distances."""
    low, high = (p or Params()).qc.geometry_prctile_range
    got = distances.groupBy(*ANIMAL, "n1", "n2").agg(hazen(F.col("dd"), low / 100).alias("low"), hazen(F.col("dd"), high / 100).alias("high"), F.count("dd").alias("n"))
    return got.where("n >= 20").drop("n")


def geometry_blame(pose: DataFrame, p: Params | None = None) -> DataFrame:
    """(session_idx, animal, frame, node): the blamed node of each pair whose distance is outside its limits.

    The lower score is blamed; a missing score where the other is there; at equal scores or without scores the node that moved
    farther (the first unless the second moved strictly farther); the first if both scores are missing in a scored session.
    """
    dist = pair_distances(pose, p)
    scored = pose.groupBy(*ANIMAL).agg(F.bool_or(F.col("score").isNotNull()).alias("scored"))
    rows = dist.join(geometry_limits(dist, p), [*ANIMAL, "n1", "n2"]).join(scored, ANIMAL)
    rows = rows.where((F.col("dd") < F.col("low")) | (F.col("dd") > F.col("high")))
    far = F.when(yes(F.col("d2") > F.col("d1")), F.col("n2")).otherwise(F.col("n1"))
    s1, s2 = F.col("s1"), F.col("s2")
    blame = (
        F.when(~F.col("scored"), far)
        .when(s1 == s2, far)
        .when(s2 < s1, F.col("n2"))
        .when(s1 < s2, F.col("n1"))
        .when(s1.isNotNull() & s2.isNull(), F.col("n2"))
        .otherwise(F.col("n1"))
    )
    return rows.select(*ANIMAL, "frame", blame.alias("node")).distinct()


def mask_geometry(pose: DataFrame, p: Params | None = None) -> DataFrame:
    """Blamed coordinates become null; adds ``geom``."""
    blamed = geometry_blame(pose, p).withColumn("geom", F.lit(True))
    rows = pose.join(blamed, [*ANIMAL, "frame", "node"], "left").withColumn("geom", yes(F.col("geom")))
    return hide(rows, "geom")


def arena_bounds(pose: DataFrame, p: Params | None = None, geom: str | None = None) -> DataFrame:
    """(session_idx, animal, n, x0, x1, y0, y1) from the anchor node's frames that are not excluded (or blamed); null limits below 50 points.

    A session of fewer nodes has its last one as the anchor.
    """
    q = (p or Params()).qc
    pose = pose.join(pose.groupBy("session_idx").agg(F.least(F.max("node"), F.lit(q.arena_anchor_node)).alias("_anchor")), "session_idx")
    ok = (F.col("node") == F.col("_anchor")) & ~F.col("excluded") & F.col("x").isNotNull() & F.col("y").isNotNull()
    if geom:
        ok = ok & ~F.col(geom)
    lo, hi = (v / 100 for v in q.arena_percentile)
    at = lambda c: F.when(ok, F.col(c))
    got = pose.groupBy(*ANIMAL).agg(F.count(at("x")).alias("n"), *[hazen(at(c), v).alias(f"{c}{k}") for c in "xy" for k, v in enumerate((lo, hi))])
    side = lambda c, sign: F.when(F.col("n") >= 50, F.col(c) + sign * q.arena_margin_px).alias(c)
    return got.select(*ANIMAL, "n", side("x0", -1), side("x1", 1), side("y0", -1), side("y1", 1))


def mask_arena(pose: DataFrame, p: Params | None = None, geom: str | None = None) -> DataFrame:
    """Coordinates outside the animal's arena become null; adds ``arena``."""
    box = arena_bounds(pose, p, geom).drop("n")
    out = (F.col("x") < F.col("x0")) | (F.col("x") > F.col("x1")) | (F.col("y") < F.col("y0")) | (F.col("y") > F.col("y1"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    rows = pose.join(box, ANIMAL).withColumn("arena", yes(out & both)).drop("x0", "x1", "y0", "y1")
    return hide(rows, "arena")


def _grouped(pose: DataFrame, kernel, extra: str = "") -> DataFrame:
    """A numpy kernel on each track, an Arrow table in order of frames."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pose.schema) + extra

    def one(t: pa.Table) -> pa.Table:
        return kernel(t.take(np.argsort(t["frame"].to_numpy(), kind="stable")))

    return pose.groupBy(*TRACK).applyInArrow(one, fields)


def _numbers(t: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as doubles, NaN for null."""
    return [np.asarray(t[n].to_numpy(), float) for n in names]


def _with_xy(t: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.Table:
    """The track with other coordinates, null for NaN."""
    for c, v in (("x", x), ("y", y)):
        t = t.set_column(t.schema.get_field_index(c), c, pa.array(v, pa.float64(), from_pandas=True))
    return t


def _of_node(t: pa.Table, by: tuple, other):
    """The parameter of the track's node."""
    node = t["node"][0].as_py()
    return by[node - 1] if node <= len(by) else other


def jump_filter(pose: DataFrame, p: Params | None = None) -> DataFrame:
    """The iterative jump filter on each track; adds ``jump``. It only detects: coordinates stay."""
    p = p or Params()

    def one(t: pa.Table) -> pa.Table:
        limit = _of_node(t, p.jump.max_disp_px_per_frame_by_node, p.jump.max_disp_px_per_frame)
        return t.append_column("jump", pa.array(kernels.jump_mask(*_numbers(t, "x", "y", "time_s"), ~t["excluded"].to_numpy().astype(bool), p.jump, limit)))

    return _grouped(pose, one, ", jump boolean")


def smooth(pose: DataFrame, p: Params | None = None, repaired: str = "repaired") -> DataFrame:
    """Zero-phase low-pass on each segment without missing or repaired frames; the ``n_pad`` outer samples and short segments stay."""
    p = p or Params()

    def one(t: pa.Table) -> pa.Table:
        fc = _of_node(t, p.smooth.low_pass_frq_by_node, p.smooth.low_pass_frq)
        return _with_xy(t, *kernels.smooth_track(*_numbers(t, "x", "y"), t[repaired].to_numpy().astype(bool), p.smooth, fc, p.data.fps))

    return _grouped(pose, one)


def interpolate(pose: DataFrame, p: Params | None = None) -> DataFrame:
    """Short gaps by any method: windows for linear and nearest, a numpy kernel for the cubic ones; adds ``filled``."""
    p = p or Params()
    if not p.gaps.enabled:
        return pose.withColumn("filled", F.lit(False))
    if p.gaps.method in ("linear", "nearest"):
        return fill_gaps(pose, p)

    def one(t: pa.Table) -> pa.Table:
        limit = _of_node(t, p.gaps.max_gap_frames_by_node, p.gaps.max_gap_frames)
        x, y, filled = kernels.fill_track(*_numbers(t, "x", "y", "time_s"), p.gaps, limit)
        return _with_xy(t, x, y).append_column("filled", pa.array(filled))

    return _grouped(pose, one, ", filled boolean")


def clean_tracks(pose: DataFrame, p: Params | None = None) -> DataFrame:
    """Pose samples with cleaned ``x`` and ``y`` and the masks low_conf, jump, interp, geom, arena, final_nan.

    In order: confidence, jumps (hidden, not replaced), short gaps, geometry, arena, short gaps again, smoothing. One pass of the
    jump filter (``max_iter`` 1) and everything but smoothing run as windows and aggregates; the iterated filter and the smoother
    are grouped kernels. Geometry and arena read their tracks several times over, so these are written before each.
    """
    p = p or Params()
    rows = mask_confidence(pose, p)
    if not p.jump.enabled:
        rows = rows.withColumn("jump", F.lit(False))
    elif p.jump.max_iter == 1:
        rows = jump_candidates(rows, p).drop("disp", "cutoff")
    else:
        rows = jump_filter(rows, p)
    rows = written(interpolate(hide(rows, "jump"), p).withColumnRenamed("filled", "_first"))
    rows = mask_arena(written(mask_geometry(rows, p)), p, "geom")
    rows = interpolate(rows, p)
    rows = rows.withColumn("interp", F.col("_first") | F.col("filled")).drop("_first", "filled")
    if p.smooth.enabled and p.smooth.method == "lowpass":
        rows = smooth(rows.withColumn("repaired", F.col("jump") | F.col("interp")), p).drop("repaired")
    return rows.withColumn("final_nan", F.col("x").isNull() | F.col("y").isNull())
