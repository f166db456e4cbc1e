"""Histograms of many columns against numpy, extents of tracks, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twintrack.operators import figures


@pytest.mark.parametrize("bins", [1, 25, 120])
def test_histograms_are_those_of_numpy(spark, bins):
    r = np.random.default_rng(bins)
    x, y = r.normal(size=400), r.integers(0, 9, 400).astype(float)
    rows = [(k % 2, None if k % 7 == 0 else float(a), float(b), 3.0, None) for k, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "g int, x double, y double, same double, none double")
    got = {}
    for h in figures.histograms(df, ["x", "y", "same", "none"], bins, ["g"]).collect():
        got.setdefault((h.g, h.metric), {})[h.bin] = h
    for g in (0, 1):
        assert (g, "none") not in got and got[g, "same"][1]["count"] == 200 and len(got[g, "same"]) == 1
        for i, name in ((1, "x"), (2, "y")):
            v = np.array([row[i] for row in rows if row[0] == g and row[i] is not None])
            count, edge = np.histogram(v, bins)
            have = got[g, name]
            # a value on an edge may round to either side of it
            assert sum(abs(count[b] - (have[b + 1]["count"] if b + 1 in have else 0)) for b in range(bins)) <= 4
            assert sum(h["count"] for h in have.values()) == len(v) and sum(h.share for h in have.values()) == pytest.approx(1)
            assert all(h.low == pytest.approx(edge[b - 1]) and h.high == pytest.approx(edge[b]) for b, h in have.items())


def test_extents_hold_every_sample(spark):
    df = spark.range(1, 1001).select(F.lit(1).alias("session_idx"), F.lit(1).alias("animal"), F.lit(1).alias("node"), F.col("id").cast("int").alias("frame"), F.when(F.col("id") % 5 != 0, F.sin(F.col("id") / 30)).alias("x"), F.cos(F.col("id") / 9).alias("y"))
    rows = figures.extents(df, 64).orderBy("pixel").collect()
    assert [r.pixel for r in rows] == list(range(64)) and sum(r.n for r in rows) == 800
    for k in range(1, 1001):
        r = rows[(k - 1) * 64 // 1000]
        assert r.first_frame <= k <= r.last_frame and r.min_y <= np.cos(k / 9) <= r.max_y
    assert figures.extents(df.limit(0), 64).collect() == [] and figures.histograms(df.limit(0), ["x"]).collect() == []
    with pytest.raises(ValueError):
        figures.extents(df, 0)
    with pytest.raises(ValueError):
        figures.histograms(df, ["no_such"])
