"""Fixtures with known values, invariants, and pairs of implementations for the pose-track operators."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twintrack.functions.core import hazen, sample_std, strict
from twintrack.operators import clean, frames, kernels, qc, runs, select, windows
from twintrack.params import Params, merge
from twintrack.plans import pipeline
from twintrack.sources import pose as source

SCHEMA = "session_id string, session_idx int, frame int, time_s double, animal int, node int, x double, y double, score double, excluded boolean"


def track(spark, xy, node=1, animal=1, scores=None, fps=80.0, session=1):
    rows = [(f"session_{session:04d}", session, k + 1, k / fps, animal, node, x, y, None if scores is None else scores[k], False) for k, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, SCHEMA)


def by_frame(df, *cols):
    return {r.frame: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


# -- parameters


def test_parameters_merge_validate_and_ignore():
    p = Params.of({"gaps": {"max_gap_frames": 3}, "qc": {"arena_percentile": [5, 95]}, "jump": {"max_disp_mm_per_frame": 50.0}, "debug": {"enabled": False}})
    assert p.gaps.max_gap_frames == 3 and p.gaps.method == "linear" and p.qc.arena_percentile == (5, 95)
    assert p.jump.max_disp_px_per_frame == pytest.approx(49.25)  # does not follow
    assert Params().smooth.min_segment_length == 45 and Params().confidence.threshold == 0.2
    for wrong in ({"data": {"fps": 0}}, {"confidence": {"mode": "x"}}, {"jump": {"max_iter": 1.5}}, {"qc": {"arena_percentile": (9, 1)}}, {"smooth": {"method": "median"}}, {"confidence": {"mode": "fixed_by_node"}}, {"gaps": {"nothing": 1}}):
        with pytest.raises(ValueError):
            Params.of(wrong)
    assert merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}


# -- functions


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=30), st.sampled_from([0.01, 0.25, 0.5, 0.9]))
def test_kernel_quantile_rule(values, p):
    v = sorted(values)
    h = min(max(len(v) * p + 0.5, 1), len(v))
    lo, hi = v[math.floor(h) - 1], v[math.ceil(h) - 1]
    assert kernels.hazen(np.array(values), p) == pytest.approx(lo + (h - math.floor(h)) * (hi - lo))


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 4.0), (1, None), (2, 5.0), (3, None)], "g int, x double")
    got = {r.g: r for r in df.groupBy("g").agg(hazen(F.col("x"), 0.25).alias("q"), sample_std(F.col("x")).alias("s"), strict(F.median, F.col("x")).alias("m")).collect()}
    assert got[1].q == 1.5 and got[2].s == 0.0 and got[1].m is None and got[2].m == 5.0 and got[3].q is None


# -- cleaning


def test_confidence_thresholds(spark):
    a = track(spark, [(0.0, 0.0)] * 100, node=1, scores=np.linspace(0, 1, 100).tolist())
    b = track(spark, [(0.0, 0.0)] * 100, node=2, scores=np.linspace(0.2, 0.8, 100).tolist())
    got = {r.node: r for r in clean.confidence_thresholds(a.unionByName(b)).collect()}
    assert got[1].threshold == pytest.approx(0.03) and got[2].threshold == pytest.approx(0.20909091)
    assert got[1].mask_fraction_final == pytest.approx(0.03) and got[2].mask_fraction_final == pytest.approx(0.02)
    low = clean.confidence_thresholds(track(spark, [(0.0, 0.0)] * 100, scores=[0.001] * 100)).first()
    assert low.was_relaxed and low.threshold == 0.01 and low.mask_fraction_final == 1.0
    fixed = clean.mask_confidence(track(spark, [(1.0, 1.0)] * 20, scores=[1.0] * 4 + [0.1] + [1.0] * 15), Params.of({"confidence": {"mode": "fixed"}}))
    assert [f for f, m in by_frame(fixed, "low_conf").items() if m] == [5]
    each = Params.of({"confidence": {"mode": "fixed_by_node", "threshold_by_node": [0.1, 0.1, 0.1, 0.5]}})
    some = [0.3, 0.3, 1.0, 1.0, 1.0]  # fewer than half, or the threshold is relaxed
    both = track(spark, [(1.0, 1.0)] * 5, node=3, scores=some).unionByName(track(spark, [(1.0, 1.0)] * 5, node=4, scores=some))
    assert {r.node for r in clean.mask_confidence(both, each).where("low_conf").collect()} == {4}


GAP = [(None, None) if k in (5, 6) or 10 <= k <= 15 else (float(k), 100.0 + k) for k in range(1, 21)]


def test_short_gaps_are_filled(spark):
    p = Params.of({"gaps": {"max_gap_frames": 2, "max_gap_frames_by_node": ()}})
    got = by_frame(runs.fill_gaps(track(spark, GAP), p), "x", "y", "filled")
    assert got[5] == (pytest.approx(5), pytest.approx(105), True) and got[6][2] and got[10] == (None, None, False)
    assert sum(v[2] for v in got.values()) == 2
    # a frame that lacks one coordinate gets both; runs at an end stay
    half = [(None, 1.0), (1.0, 1.0), (None, 9.0), (3.0, 3.0), (4.0, None)]
    got = by_frame(runs.fill_gaps(track(spark, half), p), "x", "y", "filled")
    assert got[3] == (2.0, 2.0, True) and got[1] == (None, 1.0, False) and got[5] == (4.0, None, False)
    ends = Params.of({"gaps": {"max_gap_frames": 2, "max_gap_frames_by_node": (), "fill_ends": True}})
    got = by_frame(runs.fill_gaps(track(spark, half), ends), "x", "y", "filled")
    assert got[1] == (None, None, False) and got[5] == (None, None, False)


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_gaps_by_windows_and_by_kernel(spark, method):
    r = np.random.default_rng(4)
    xy = [(None if r.random() < 0.3 else float(v), None if r.random() < 0.3 else float(v) * 2) for v in r.normal(size=80)]
    p = Params.of({"gaps": {"method": method, "max_gap_frames_by_node": (4,)}})
    got = by_frame(runs.fill_gaps(track(spark, xy), p), "x", "y", "filled")
    a = np.array([[np.nan if v is None else v for v in q] for q in xy])
    x, y, filled = kernels.fill_track(a[:, 0], a[:, 1], np.arange(80) / 80, p.gaps, 4)
    for k in range(80):
        want = tuple(None if math.isnan(v) else v for v in (x[k], y[k]))
        assert got[k + 1][:2] == pytest.approx(want) and got[k + 1][2] == filled[k]


@pytest.mark.parametrize("method", ["pchip", "makima", "spline"])
def test_cubic_interpolation(method):
    t = np.array([0.0, 1.0, 2.5, 3.0, 4.2, 5.0])
    at = np.linspace(-1, 6, 50)
    line = kernels.interpolated(t, 2 * t + 1, at, method)
    inside = (at >= 0) & (at <= 5)
    assert line[inside] == pytest.approx(2 * at[inside] + 1) and np.isnan(line[~inside]).all()
    assert kernels.interpolated(t, t**2, t, method) == pytest.approx(t**2)
    if method == "spline":
        assert kernels.interpolated(t, t**3, at[inside], method) == pytest.approx(at[inside] ** 3)
    if method == "pchip":
        steps = kernels.interpolated(t, np.array([0.0, 0, 0, 1, 1, 1]), np.linspace(0, 5, 200), method)
        assert (np.diff(steps) >= -1e-12).all()


def test_single_jump(spark):
    xy = [(float(k) + (100 if k == 50 else 0), 0.0) for k in range(1, 101)]
    p = Params.of({"jump": {"diff_quantile": 0.95, "max_disp_px_per_frame": 50.0, "max_iter": 1}})
    one = by_frame(runs.jump_candidates(track(spark, xy), p), "jump")
    assert [f for f, j in one.items() if j] == [49, 50, 51, 52]
    assert by_frame(clean.jump_filter(track(spark, xy), p), "jump") == one
    circle = [(math.sin(k / 10), math.cos(k / 10)) for k in range(100)]
    circle[49] = (circle[48][0] + 100, circle[48][1] + 100)
    got = by_frame(clean.jump_filter(track(spark, circle), Params.of({"jump": {"diff_quantile": 0.95, "dilate_frames": 0}})), "jump")
    assert got[50]
    assert not any(by_frame(clean.jump_filter(track(spark, circle[:5]), Params()), "jump").values())


def test_low_pass():
    b, a = kernels.butterworth(8, 80)
    assert b == pytest.approx([0.06745527, 0.13491055, 0.06745527], abs=1e-8) and a == pytest.approx([1, -1.1429805, 0.4128016], abs=1e-7)
    t = np.arange(45) / 80
    x = np.sin(4 * np.pi * t) + 0.5 * np.sin(40 * np.pi * t)
    y = kernels.lowpass(x, 8, 80, 20)
    assert np.flatnonzero(y != x).tolist() == [20, 21, 22, 23, 24]
    assert y[20:25] == pytest.approx([0.000001, -0.150386, -0.307957, -0.457945, -0.585772], abs=1e-6)
    assert kernels.lowpass(np.full(50, 3.0), 8, 80, 2) == pytest.approx(np.full(50, 3.0))
    assert kernels.lowpass(x, 40, 80, 0) is x and kernels.lowpass(x[:6], 8, 80, 0) is not None


def test_smoother_breaks_at_repairs(spark):
    xy = [(500.0, 500.0) if k == 50 else (float(k), float(k)) for k in range(1, 101)]
    pose = track(spark, xy).withColumn("repaired", F.col("frame") == 50)
    p = Params.of({"smooth": {"low_pass_frq_by_node": (4,), "n_pad": 2, "min_segment_length": 5}})
    assert sorted((r.run_start, r.run_stop) for r in runs.smooth_segments(pose, p, "repaired").collect()) == [(1, 48), (52, 100)]
    got = by_frame(clean.smooth(pose, p), "x")
    assert got[50] == 500.0 and got[49] == 49.0


def test_geometry_blames_one_node(spark):
    rows = None
    for n in range(1, 14):
        xy = [(500.0 if (k, n) == (40, 1) else float(n), 0.0) for k in range(1, 101)]
        scores = [0.05 if (k, n) == (40, 1) else 0.9 if (k, n) == (40, 10) else 1.0 for k in range(1, 101)]
        t = track(spark, xy, node=n, scores=scores)
        rows = t if rows is None else rows.unionByName(t)
    p = Params.of({"qc": {"geometry_node_pairs": ((1, 10),)}})
    lim = clean.geometry_limits(clean.pair_distances(rows, p), p).first()
    assert (lim.low, lim.high) == (9.0, 249.5)
    assert [(r.frame, r.node) for r in clean.geometry_blame(rows, p).collect()] == [(40, 1)]


def test_runs_and_dilation(spark):
    xy = [(None, None) if k in (3, 4, 8, 10) else (1.0, 1.0) for k in range(1, 11)]
    df = track(spark, xy).withColumn("m", F.col("x").isNull())
    assert sorted((r.run_start, r.run_stop, r.run_length) for r in runs.find_runs(df, "m", runs.TRACK).collect()) == [(3, 4, 2), (8, 8, 1), (10, 10, 1)]
    wide = by_frame(runs.dilate(df, "m", 1, runs.TRACK, "w"), "w")
    assert [f for f, v in sorted(wide.items()) if v] == [2, 3, 4, 5, 7, 8, 9, 10]
    assert by_frame(runs.dilate(df, "m", 0, runs.TRACK, "w"), "w") == by_frame(df, "m")


# -- sessions


def test_synthetic_session_end_to_end(spark):
    raw = source.synthetic(spark, 120, gap=True, teleport=True)
    done = pipeline.preprocess(raw)
    rows = {(r.frame, r.animal, r.node): r for r in done.clean.collect()}
    assert len(rows) == 120 * 13 * 2
    assert rows[60, 1, 3].jump and all(rows[k, 1, 2].interp for k in (20, 23))
    assert {r.animal for r in done.animals.collect()} == {1, 2}
    for r in rows.values():
        assert r.final_nan == (r.x is None or r.y is None)
    q = {(r.frame, r.animal): r for r in done.frames.collect()}
    assert all(0 <= r.frac_interp <= 1 for r in q.values())


def test_excluded_and_low_confidence_frames_are_bad(spark):
    raw = source.synthetic(spark, 100).withColumn("excluded", F.col("frame").between(10, 15)).withColumn("score", F.when(F.col("frame") == 30, 0.05).otherwise(F.col("score")))
    done = pipeline.preprocess(raw, {"confidence": {"mode": "fixed"}})
    got = {(r.frame, r.animal): r for r in done.frames.collect()}
    assert all(got[f, a].bad for f in range(10, 16) for a in (1, 2)) and got[30, 1].frac_low_conf == 1.0 and got[30, 1].bad


def test_arena_excursion(spark):
    raw = source.synthetic(spark, 150)
    at = (F.col("frame") == 100) & (F.col("node") == 10) & (F.col("animal") == 1)
    raw = raw.withColumns({c: F.when(at, 1000.0).otherwise(F.col(c)) for c in "xy"})
    p = Params.of({"qc": {"arena_percentile": (5, 95), "arena_margin_px": 5.0}, "jump": {"enabled": False}})
    done = pipeline.preprocess(raw, p)
    hit = done.clean.where((F.col("frame") == 100) & (F.col("node") == 10) & (F.col("animal") == 1)).first()
    assert hit.arena or hit.geom
    one = pipeline.preprocess(source.synthetic(spark, 120, animals=1))
    assert one.clean.count() == 120 * 13 and one.animals.count() == 1


def test_validation_and_defaults(spark):
    raw = source.synthetic(spark, 20).select("session_idx", "frame", "animal", "node", "x", "y")
    pose = source.normalised(raw)
    r = pose.where("frame = 3").first()
    assert r.time_s == pytest.approx(2 / 80) and r.excluded is False and r.session_id == "session_0001" and r.score is None
    assert pipeline.validate(pose).first().ok
    with pytest.raises(ValueError, match="aren't valid"):
        pipeline.preprocess(pose.where("frame = 1"))
    odd = source.normalised(raw.withColumn("x", F.lit(float("nan"))).withColumn("y", F.lit(float("inf"))))
    assert odd.where("x is null and y is null").count() == pose.count()
    with pytest.raises(ValueError):
        source.node_number("tail")


def test_files(spark, tmp_path):
    pose = source.synthetic(spark, 10).unionByName(source.synthetic(spark, 10).withColumn("session_idx", F.lit(2)))
    source.write_sessions(pose, f"{tmp_path}/s")
    assert source.read_sessions(spark, f"{tmp_path}/s", ["frame", "x"], 2).count() == 260
    assert source.read_either(spark, [f"{tmp_path}/none", f"{tmp_path}/s"]).count() == 520
    with pytest.raises(FileNotFoundError):
        source.read_either(spark, [f"{tmp_path}/none"])
    assert [r.position for r in source.session_files(spark, f"{tmp_path}/s", "*.parquet").collect()][:1] == [1]
    assert source.merge_outputs(pose, pose.select("session_idx").distinct()).count() == 520
    with pytest.raises(ValueError, match="without output"):
        source.merge_outputs(pose, pose.where("session_idx = 1").select("session_idx").distinct())
    source.write_csv(pose.limit(3), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 3
    scores = pose.select("session_idx", "frame", "node", F.lit(0.5).alias("score")).distinct()
    assert source.with_scores(pose, scores).where("score = 0.5").count() == 520


# -- features


def pair(spark):
    rows = []
    for k in range(40):
        for a, pts in ((1, {1: k, 9: k - 5, 10: k - 10, 13: k - 7}), (2, {1: 50, 9: 45, 10: 40, 13: 43})):
            rows += [("session_0001", 1, k + 1, k / 80, a, n, float(x), 0.0, 1.0, False) for n, x in pts.items()]
    return spark.createDataFrame(rows, SCHEMA)


def test_pair_features(spark):
    f = by_frame(frames.frame_features(pair(spark)), "centroid_dist", "approach_speed_1", "in_contact", "close_pair", "facing_1_to_2", "facing_2_to_1", "mutual_facing", "speed_alignment", "asym_investigate", "frame_ok")
    assert [f[k][0] for k in (1, 2, 3, 4, 39, 40)] == pytest.approx([49, 48.5, 48, 47, 12.5, 12])
    assert [f[k][1] for k in (1, 2, 3, 4)] == pytest.approx([53.333333, 60, 64, 80], abs=1e-5)
    assert [k for k in f if f[k][2] == 1.0] == list(range(21, 41)) and all(v[3] == 1.0 for v in f.values())
    assert f[10][4:7] == pytest.approx((1, -1, -1)) and f[10][7] is None and f[10][8] == 1.0 and f[10][9]
    raw = frames.raw_features(frames.wide_points(pair(spark)))
    assert raw.where("abs(approach_speed_1 - approach_speed_2) > 1e-9 or abs(approach_speed_1 + radial_speed_12) > 1e-9").count() == 0
    bad = spark.createDataFrame([(1, 5, True), (1, 6, False)], "session_idx int, frame int, bad boolean")
    ok = by_frame(frames.frame_features(pair(spark), bad), "frame_ok")
    assert not ok[5] and ok[6] and ok[7]


def test_catalogue():
    rows = frames.catalogue()
    assert len(rows) == 34 and sum(r[3] for r in rows) == 5 and sum(r[4] for r in rows) == 6 and len(frames.NUMERIC) == 23


def series(spark, n=100):
    d = np.linspace(10, 20, n)
    c = np.linspace(-90, 90, n)
    b = ([0.0] * 10 + [1.0] * 10) * (n // 20)
    rows = [(1, k + 1, k / 80, True, float(d[k]), b[k], float(c[k])) for k in range(n)]
    return spark.createDataFrame(rows, "session_idx int, frame int, time_s double, frame_ok boolean, centroid_dist double, in_contact double, heading_diff_deg double")


NAMES = ["centroid_dist", "in_contact", "heading_diff_deg"]


def test_window_summaries(spark):
    got = windows.summarize(series(spark), (0.5, 1.0), names=NAMES)
    assert got.count() == 82 and len(got.columns) == 25
    r = got.where("center_frame = 20 and window_sec = 0.5").first().asDict()
    want = {"mean": 11.969697, "std": 1.180854, "min": 10, "max": 13.939394, "delta": 3.939394, "slope": 8.080808}
    for s, v in want.items():
        assert r[f"centroid_dist__{s}__0_5s"] == pytest.approx(v, abs=1e-5)
    assert (r["in_contact__occupancy__0_5s"], r["in_contact__onset_rate__0_5s"]) == pytest.approx((0.5, 0.05))
    assert (r["heading_diff_deg__circmean__0_5s"], r["heading_diff_deg__resultant__0_5s"]) == pytest.approx((-54.545455, 0.934245), abs=1e-5)
    r = got.where("center_frame = 40 and window_sec = 1.0").first().asDict()
    assert (r["centroid_dist__mean__1_0s"], r["centroid_dist__std__1_0s"]) == pytest.approx((13.989899, 2.347263), abs=1e-5)
    with pytest.raises(ValueError):
        windows.summarize(series(spark), (0.5, 0.52))


@pytest.mark.parametrize("method", ["sliding", "prefix"])
def test_windows_with_missing_values_are_numpy(spark, method):
    r = np.random.default_rng(8)
    n = 70
    x, b, c = r.normal(1000, 1, n), (r.random(n) < 0.5).astype(float), r.uniform(-180, 180, n)
    gone = r.random((3, n)) < 0.4
    gone[:, 20:45] = True
    none = lambda v, g: None if g else float(v)
    rows = [(1, k + 1, k / 80, True, none(x[k], gone[0, k]), none(b[k], gone[1, k]), none(c[k], gone[2, k])) for k in range(n)]
    df = spark.createDataFrame(rows, series(spark, 20).schema)
    got = {q.center_frame: q.asDict() for q in windows.summarize_scale(df, 0.2, names=NAMES, full=False, method=method, plain=True).collect()}
    assert sorted(got) == list(range(8, 63))
    for f, q in got.items():
        lo, hi = f - 1 - 7, f - 1 + 8 + 1
        v = x[lo:hi][~gone[0, lo:hi]]
        want = {"mean": v.mean() if v.size else None, "std": (v.std(ddof=1) if v.size > 1 else 0.0) if v.size else None, "min": v.min() if v.size else None, "max": v.max() if v.size else None, "delta": v[-1] - v[0] if v.size else None, "slope": np.polyfit(np.arange(v.size) / 80, v, 1)[0] if v.size > 1 else None}
        for s, w in want.items():
            assert q[f"centroid_dist__{s}"] == (None if w is None else pytest.approx(w, abs=1e-6, rel=1e-6)), (f, s)
        v = b[lo:hi][~gone[1, lo:hi]] > 0.5
        on = (np.diff(np.concatenate([[False], v]).astype(int)) == 1).sum() / v.size if v.size else None
        assert q["in_contact__occupancy"] == (pytest.approx(v.mean()) if v.size else None) and q["in_contact__onset_rate"] == (pytest.approx(on) if v.size else None)
        v = np.radians(c[lo:hi][~gone[2, lo:hi]])
        if v.size:
            assert q["heading_diff_deg__resultant"] == pytest.approx(math.hypot(np.cos(v).mean(), np.sin(v).mean()), abs=1e-9)
        else:
            assert q["heading_diff_deg__circmean"] is None


def test_range_with_a_halo_gives_the_same_rows(spark):
    f = series(spark, 200)
    whole = windows.summarize_scale(f, 0.5, names=NAMES).where("center_frame between 90 and 110")
    part = windows.summarize_scale(windows.prune_frames(f, 90, 110, 25), 0.5, names=NAMES).where("center_frame between 90 and 110")
    cols = [c for c in whole.columns if "slope" not in c]
    assert whole.select(cols).exceptAll(part.select(cols)).count() == 0 and whole.count() == part.count()


# -- matrix


@pytest.fixture(scope="module")
def matrix(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 10))
    x[:, 9] = x[:, 0] + r.normal(size=500) * 0.01
    x[r.random(x.shape) < 0.02] = np.nan
    names = [f"f{k}" for k in range(10)]
    rows = [(k % 3, k, 0.2, *[None if math.isnan(v) else float(v) for v in x[k]]) for k in range(500)]
    return spark.createDataFrame(rows, "session_idx int, center_frame int, window_sec double, " + ", ".join(f"{n} double" for n in names)), names, pd.DataFrame(x, columns=names)


def test_statistics_and_correlations_are_pandas(matrix):
    df, names, x = matrix
    got = {r.feature: r for r in select.feature_stats(df, names).collect()}
    for n in names:
        v = x[n].dropna()
        assert got[n].valid_n == v.size and got[n].median == pytest.approx(v.median()) and got[n].mad == pytest.approx((v - v.median()).abs().median()) and got[n].std == pytest.approx(v.std())
        assert got[n].iqr == pytest.approx(kernels.hazen(v.to_numpy(), 0.75) - kernels.hazen(v.to_numpy(), 0.25)) and not got[n].is_binary
    pairs = [("f0", "f1"), ("f0", "f9"), ("f3", "f4")]
    for method, f in (("pearson", select.corr_pearson), ("spearman", select.corr_spearman)):
        for r in f(df, pairs).collect():
            both = x[[r.a, r.b]].dropna()  # ranks anew on the rows where both are there
            want = both.corr().iloc[0, 1] if method == "pearson" else both.rank().corr().iloc[0, 1]
            assert r.rho == pytest.approx(want)
    assert {r.feature: r.max_abs_corr for r in select.inspect(df, ["f0", "f1", "f9"]).collect()}["f9"] > 0.99


def test_selection_and_readiness(matrix):
    df, names, _ = matrix
    kept, scores = select.select_features(df, names, max_keep=8, min_keep=5, max_corr=0.95)
    assert 5 <= len(kept) <= 8 and not {"f0", "f9"} <= set(kept)
    for r in scores.collect():
        assert r.score is None or r.score > 1
    ready = select.readiness(df, names, kept).first()
    assert not ready.is_ready and ready.num_windows == 500 and "Enough windows" in ready.reasons and ready.effective_rank >= 2
    assert select.readiness(df.limit(0), names, kept).first().reasons == ["Empty feature matrix."]
    x = df.select(*kept).toPandas()
    x = x.fillna(x.median())
    v = np.linalg.eigvalsh(np.cov(x.to_numpy().T))[::-1]
    assert select.pca_ratios(df, kept) == pytest.approx((100 * v / v.sum()).tolist())


def test_wide_layout_keeps_nothing_and_per_scale_does(spark):
    raw = source.synthetic(spark, 200)
    out = pipeline.run(raw, scales=(0.2, 0.5))
    assert out["kept"] == [] and not out["readiness"].first().is_ready
    done = out["preprocessed"]
    per = pipeline.features_of(done, (0.2, 0.5), "per_scale")
    assert len(per.columns) == 165 and set(windows.META) <= set(per.columns)
    assert windows.summary_meta(spark).count() == 640 and windows.summary_meta(spark, first_scale_only=True).count() == 160


# -- review


def test_review_medians_flags_and_histogram(spark):
    rows = [(1, 1, 30.0, None), (1, 2, 50.0, 0.2), (2, 1, 1.0, 0.05), (2, 2, 3.0, 0.07)]
    base = spark.createDataFrame(rows, "session_idx int, animal int, pct_bad double, median_distortion double")
    animals = base.select("*", *[F.lit(0.0).alias(m) for m in qc.METRICS[1:-1]])
    flags = {r.session_idx: r for r in qc.qc_flags(animals).collect()}
    assert flags[1].pct_bad == 40.0 and flags[1].median_distortion is None and flags[1].n_flags == 1 and flags[1].position == 1 and flags[2].n_flags == 0
    z = {r.session_idx: r for r in qc.metric_zscores(animals).collect()}
    assert z[1].pct_bad == pytest.approx(math.sqrt(0.5)) and z[1].pct_jump_frames == 0.0
    assert {r.metric: r.max for r in qc.console_summary(animals).collect()}["pct_bad"] == 50.0
    h = qc.histogram(spark.createDataFrame([(float(v),) for v in range(11)], "v double"), "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 2, 2, 2, 3]


def test_sessions_must_have_all_frames_and_required_scores(spark):
    whole = source.synthetic(spark, 60)
    holed = whole.where(~F.col("frame").between(20, 39))
    assert not pipeline.validate(holed).first().ok and pipeline.validate(whole).first().ok
    with pytest.raises(ValueError, match="aren't valid"):
        pipeline.preprocess(holed)
    with pytest.raises(ValueError, match="without scores"):
        pipeline.preprocess(source.synthetic(spark, 60, scores=False), {"confidence": {"require_scores": True}})


def test_few_nodes_take_the_last_one(spark):
    done = pipeline.preprocess(source.synthetic(spark, 120, nodes=5))
    rows = done.frames.collect()
    # cleaning takes some coordinates away
    assert np.mean([r.body_length is not None for r in rows]) > 0.9 and np.mean([r.bad for r in rows]) < 0.5
    assert all(r.x0 is not None for r in clean.arena_bounds(done.clean).collect())
