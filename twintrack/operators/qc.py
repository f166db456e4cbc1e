"""Quality control of cleaned tracks: frames, nodes, animals, sessions, and the review tables over sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.core import dilated, hazen, hazen_of, norm, series, step, strict, yes
from ..params import Params
from .clean import ANIMAL

MASKS = {"final_nan": "final_nan", "interp": "interp", "jump": "jump", "geom": "geom", "arena": "arena", "low_conf": "low_conf"}
FRACTIONS = [f"frac_{m}" for m in MASKS]
_EPS = 2.220446049250313e-16
#: Metrics of an animal that the review looks at, and the flag limits on a session's medians.
METRICS = ["pct_bad", "pct_interp_frames", "pct_jump_frames", "pct_geom_frames", "pct_arena_frames", "pct_low_conf_frames", "median_distortion"]
FLAGS = {"pct_bad": 25.0, "pct_interp_frames": 20.0, "pct_jump_frames": 20.0, "pct_geom_frames": 15.0, "pct_arena_frames": 10.0, "pct_low_conf_frames": 15.0, "median_distortion": 0.10}


def missing_frames(pose: DataFrame) -> DataFrame:
    """(session_idx, frame, animal, any_missing, all_missing) of raw coordinates."""
    lost = F.col("x").isNull() | F.col("y").isNull()
    none = F.col("x").isNull() & F.col("y").isNull()
    return pose.groupBy("session_idx", "frame", "animal").agg(F.bool_or(lost).alias("any_missing"), F.bool_and(none).alias("all_missing"))


def _fraction(mask: str):
    return F.avg(F.col(mask).cast("double"))


def node_or_last(node: int, column: str):
    """Aggregate of the rows of a frame: the column at that node, or at the last one if the session has fewer nodes."""
    return F.max_by(column, F.when(F.col("node") <= node, F.col("node")))


def frame_qc(clean: DataFrame, p: Params | None = None) -> DataFrame:
    """Per session, frame and animal: mask fractions, body length and whether it is an outlier, anchor displacement over body length, excluded, bad."""
    q = (p or Params()).qc
    a, b = q.body_length_nodes
    named = {f"{c}{k}": node_or_last(n, c) for k, n in (("1", a), ("2", b), ("0", q.arena_anchor_node)) for c in "xy"}
    rows = clean.groupBy(*ANIMAL, "frame").agg(*[_fraction(m).alias(f) for f, m in zip(FRACTIONS, MASKS.values())], F.bool_or("excluded").alias("excluded"), *[v.alias(k) for k, v in named.items()])
    rows = rows.withColumn("body_length", norm(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")))
    w = series(*ANIMAL)
    rows = rows.withColumn("anchor_disp_ratio", step(F.col("x0"), F.col("y0"), w) / F.greatest("body_length", F.lit(_EPS)))
    lo, hi = q.body_length_prctile_range
    limits = rows.groupBy(*ANIMAL).agg(hazen(F.col("body_length"), lo / 100).alias("_lo"), hazen(F.col("body_length"), hi / 100).alias("_hi"), F.count("body_length").alias("_n"))
    rows = rows.join(limits, ANIMAL)
    rows = rows.withColumn("body_length_outlier", yes((F.col("_n") >= 10) & ((F.col("body_length") < F.col("_lo")) | (F.col("body_length") > F.col("_hi")))))
    over = {"frac_final_nan": q.frame_bad_node_frac_thresh, "frac_interp": q.max_interp_frac_per_frame, "frac_jump": q.max_jump_frac_per_frame, "frac_geom": q.max_geom_frac_per_frame, "frac_arena": q.max_arena_frac_per_frame, "frac_low_conf": q.max_lowconf_frac_per_frame}
    bad = F.col("excluded") | F.col("body_length_outlier")
    for f, limit in over.items():
        bad = bad | (F.col(f) > limit)
    if q.require_finite_body_length:
        bad = bad | F.col("body_length").isNull()
    if q.expand_severe_badframes:
        severe = F.col("excluded") | (F.col("frac_arena") > 0) | (F.col("frac_geom") > 0)
        bad = bad | dilated(severe, q.expand_severe_badframes, w)
    return rows.withColumn("bad", bad).select(*ANIMAL, "frame", *FRACTIONS, "body_length", "body_length_outlier", "anchor_disp_ratio", "excluded", "bad")


def bad_pairs(frames: DataFrame) -> DataFrame:
    """(session_idx, frame, bad): bad for any animal."""
    return frames.groupBy("session_idx", "frame").agg(F.bool_or("bad").alias("bad"))


def node_qc(clean: DataFrame) -> DataFrame:
    return clean.groupBy(*ANIMAL, "node").agg(*[_fraction(m).alias(f) for f, m in zip(FRACTIONS, MASKS.values())])


def animal_qc(frames: DataFrame, clean: DataFrame, raw: DataFrame | None = None, p: Params | None = None) -> DataFrame:
    """Thirteen metrics and three mask cross-checks of each animal. Raw medians only if ``raw`` samples are given, else null."""
    q = (p or Params()).qc
    pct = lambda f: 100 * F.avg((F.col(f) > 0).cast("double"))
    short = {"interp": "frac_interp", "jump": "frac_jump", "geom": "frac_geom", "arena": "frac_arena", "low_conf": "frac_low_conf"}
    out = frames.groupBy(*ANIMAL).agg(
        F.count("*").alias("n_frames"),
        (100 * F.avg(F.col("bad").cast("double"))).alias("pct_bad"),
        *[pct(f).alias(f"pct_{k}_frames") for k, f in short.items()],
        (100 * F.avg("frac_jump")).alias("pct_jump_samples"),
        (100 * F.avg("frac_interp")).alias("pct_interp_samples"),
        F.median("body_length").alias("median_body_length"),
        F.median("anchor_disp_ratio").alias("median_distortion"),
        pct("frac_jump").alias("mask_pct_jump"), pct("frac_interp").alias("mask_pct_interp"), pct("frac_final_nan").alias("mask_pct_final_nan"),
    )
    w = series(*ANIMAL)

    def medians(samples: DataFrame, tag: str) -> DataFrame:
        a, b = q.body_length_nodes
        wide = samples.groupBy(*ANIMAL, "frame").agg(*[node_or_last(n, c).alias(f"{c}{k}") for k, n in (("1", a), ("2", b), ("0", q.arena_anchor_node)) for c in "xy"])
        wide = wide.select(*ANIMAL, step(F.col("x0"), F.col("y0"), w).alias("s"), norm(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")).alias("b"))
        return wide.groupBy(*ANIMAL).agg(F.median("s").alias(f"median_anchor_step_{tag}"), F.median("b").alias(f"median_body_length_{tag}"))

    out = out.join(medians(clean, "clean").drop("median_body_length_clean"), ANIMAL)
    if raw is None:
        return out.withColumns({"median_anchor_step_raw": F.lit(None).cast("double"), "median_body_length_raw": F.lit(None).cast("double")})
    return out.join(medians(raw, "raw"), ANIMAL)


def review_sessions(frames: DataFrame, raw_missing: DataFrame) -> DataFrame:
    """(session_idx, n_frames, n_animals, pct_bad_any, pct_bad_all, pct_any_missing_raw)."""
    per = frames.groupBy("session_idx", "frame").agg(F.bool_or("bad").alias("any"), F.bool_and("bad").alias("every"), F.count("*").alias("k"))
    out = per.groupBy("session_idx").agg(F.count("*").alias("n_frames"), F.max("k").alias("n_animals"), (100 * F.avg(F.col("any").cast("double"))).alias("pct_bad_any"), (100 * F.avg(F.col("every").cast("double"))).alias("pct_bad_all"))
    lost = raw_missing.groupBy("session_idx", "frame").agg(F.bool_or("any_missing").alias("m")).groupBy("session_idx").agg((100 * F.avg(F.col("m").cast("double"))).alias("pct_any_missing_raw"))
    return out.join(lost, "session_idx")


def session_medians(animals: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Medians over a session's animals; null as soon as one animal's value is."""
    return animals.groupBy("session_idx").agg(*[strict(F.median, F.col(m)).alias(m) for m in metrics or METRICS])


def ranked_sessions(animals: DataFrame) -> DataFrame:
    """Session medians with their rank by bad frames, worst (and unknown) first, ties in order of sessions."""
    order = Window.orderBy(F.col("pct_bad").desc_nulls_first(), "session_idx")  # one row for each session
    return session_medians(animals, METRICS[:-1]).withColumn("rank", F.row_number().over(order))


def metric_zscores(animals: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Session medians minus their mean over sessions by their standard deviation; 0 where that is 0 or unknown, null where the median is."""
    metrics = metrics or METRICS
    m = session_medians(animals, metrics)
    stats = m.agg(*[F.avg(c).alias(f"{c}_m") for c in metrics], *[F.stddev_samp(c).alias(f"{c}_s") for c in metrics])
    both = m.join(F.broadcast(stats), F.lit(True), "left")  # one row
    z = lambda c: F.when(yes(F.col(f"{c}_s") > 0), (F.col(c) - F.col(f"{c}_m")) / F.nullif(F.col(f"{c}_s"), F.lit(0.0))).otherwise(F.lit(0.0))
    return both.select("session_idx", *[z(c).alias(c) for c in metrics])


def qc_flags(animals: DataFrame) -> DataFrame:
    """Session medians, a flag for each metric over its limit, the number of flags; most flags and bad frames first by ``position``."""
    m = session_medians(animals)
    m = m.select("*", *[yes(F.col(c) > limit).alias(f"flag_{c}") for c, limit in FLAGS.items()])
    total = sum((F.col(f"flag_{c}").cast("int") for c in FLAGS), F.lit(0))
    m = m.withColumn("n_flags", total)
    order = Window.orderBy(F.col("n_flags").desc(), F.col("pct_bad").desc_nulls_first(), "session_idx")
    return m.withColumn("position", F.row_number().over(order))


def console_summary(animals: DataFrame) -> DataFrame:
    """(metric, median, p90, max) over animals; metrics without a value are left out."""
    long = animals.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("r")).select("r.*").where("v is not null")
    s = F.sort_array(F.collect_list("v"))  # one value for each animal
    return long.groupBy("metric").agg(F.median("v").alias("median"), hazen_of(s, 0.9).alias("p90"), F.max("v").alias("max"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, count, share) of a column between its least and largest value; the last bin is closed. Nulls are left out."""
    x = df.select(F.col(column).alias("v")).where("v is not null")
    edges = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(F.lit(bins), F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))).cast("int") + 1))
    rows = x.join(F.broadcast(edges), F.lit(True), "inner").select(at.alias("bin"), "lo", width.alias("width"), "n")
    got = rows.groupBy("bin").agg(F.count("*").alias("count"), F.first("lo").alias("lo"), F.first("width").alias("width"), F.first("n").alias("n"))
    return got.select("bin", (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("low"), (F.col("lo") + F.col("bin") * F.col("width")).alias("high"), "count", (F.col("count") / F.col("n")).alias("share"))
