"""Blocks of sessions against whole sessions, for any block size: random masks and series, sessions with holes, a plan of many tasks."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twintrack.operators import frames, runs, segments, windows
from twintrack.sources import pose as source

SCHEMA = "session_idx int, animal int, node int, frame int, x double, y double, gap boolean, keep string"


def track(seed, sizes=(1, 7, 40, 97), hole=False):
    r = random.Random(seed)
    rows = []
    for s, n in enumerate(sizes):
        first = r.randint(-3, 5)
        for node in (1, 2):
            p, on = r.choice([0.02, 0.3, 0.9]), False
            for k in range(n):
                on = (not on) if r.random() < p else on
                x = None if r.random() < 0.2 else r.uniform(0, 9)
                if not (hole and s == 2 and k == 20 and node == 1):
                    rows.append((s, 1, node, first + k, x, r.uniform(0, 9), None if r.random() < 0.05 else on, "k"))
    return rows


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [1, 2, 5, 33, 1000])
@pytest.mark.parametrize("hole", [False, True])
def test_runs_masks_and_steps(spark, block, hole):
    df = spark.createDataFrame(track(block, hole=hole), SCHEMA).repartition(3).cache()
    keys = ["session_idx", "animal", "node"]
    run = (*keys, "run_start", "run_stop", "run_length")
    assert rows_of(segments.find_runs_blocks(df, "gap", keys, block), *run) == rows_of(runs.find_runs(df, "gap", keys), *run)
    for half in (0, 3):
        assert rows_of(segments.dilate_blocks(df, "gap", half, keys, "wide", block), *keys, "frame", "wide", "keep") == rows_of(runs.dilate(df, "gap", half, keys, "wide"), *keys, "frame", "wide", "keep")
    assert rows_of(segments.displacement_blocks(df, block=block), *keys, "frame", "disp") == rows_of(runs.displacement(df), *keys, "frame", "disp")


@pytest.mark.parametrize("block", [1, 4, 50])
def test_running_values(spark, block):
    data = track(block + 100)
    df = spark.createDataFrame(data, SCHEMA)
    got = segments.running(df, [("x", "n", "count"), ("x", "s", "sum"), ("x", "l", "last"), ("x", "lo", "min"), ("x", "hi", "max")], ["session_idx", "animal", "node"], block)
    seen = {}
    want = {}
    for s, a, n, f, x, *_ in data:
        past = seen.setdefault((s, a, n), [])
        if x is not None:
            past.append(x)
        want[s, a, n, f] = (len(past), sum(past), past[-1] if past else None, min(past, default=None), max(past, default=None))
    for r in got.collect():
        n, s, *others = want[r.session_idx, r.animal, r.node, r.frame]
        assert r.n == n and r.s == pytest.approx(s) and [r.l, r.lo, r.hi] == others
    with pytest.raises(ValueError, match="kinds"):
        segments.running(df, [("x", "n", "median")], ["session_idx"])


@pytest.fixture(scope="module")
def pose(spark):
    return source.from_embeddings(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).where("session_idx <= 2 and (session_idx = 1 or frame <= 45)").cache()


def table(df):
    pdf = df.toPandas()
    pdf = pdf.sort_values([c for c in ("session_idx", "window_sec", "frame", "center_frame") if c in pdf]).reset_index(drop=True)
    return pdf[sorted(pdf.columns)]


@pytest.mark.parametrize("block", [7, 64, 10_000])
def test_features_and_summaries(spark, pose, block):
    whole = frames.frame_features(pose).cache()
    parts = segments.frame_features_blocks(pose, block=block)
    a, b = table(whole), table(parts)
    assert list(a) == list(b) and len(a) == len(b)
    for c in a:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-12, atol=1e-12, err_msg=c)
    for method in ("sliding", "prefix"):
        options = {"scales": (0.2, 0.5), "names": ["centroid_dist", "in_contact", "heading_diff_deg"], "full": False, "method": method}
        a, b = table(windows.summarize(whole, **options)), table(segments.summarize_blocks(whole, block=block, **options))
        assert len(a) == len(b) and set(a) == set(b)
        for c in a:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_one_long_session_is_many_tasks(spark):
    df = spark.range(1, 20_001).select(F.lit(1).alias("session_idx"), F.col("id").cast("int").alias("frame"), (F.col("id") % 7).cast("double").alias("x"))
    parts = segments.dealt(df, ["session_idx"], 3, 3, 500)
    sizes = [r["count"] for r in parts.groupBy("session_idx").count().collect()]
    assert len(sizes) == 40 and max(sizes) <= 506
    assert segments.own(parts).count() == 20_000


def test_no_rows_and_bad_sizes(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert segments.find_runs_blocks(none, "gap", ["session_idx", "animal", "node"]).collect() == []
    assert segments.displacement_blocks(none).collect() == []
    with pytest.raises(ValueError):
        segments.dealt(none, ["session_idx"], block=0)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 20), st.integers(0, 9), st.integers(0, 9))
def test_halo_rule(n, block, before, after):
    """The blocks that a row is copied to are those that look at it."""
    for at in range(n):
        low, high = max(0, (at - after) // block), min((n - 1) // block, (at + before) // block)
        seen = {c // block for c in range(n) if c - before <= at <= c + after}
        assert seen <= set(range(low, high + 1))
