"""Review in one call, options through the pipeline, argument checks, window extremes."""

import glob
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twintrack.operators import frames, select, windows
from twintrack.plans import pipeline, review
from twintrack.sources import pose as source


@pytest.fixture(scope="module")
def pair(spark):
    return source.from_embeddings(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).cache()


@pytest.fixture(scope="module")
def done(spark, pair):
    return pipeline.preprocess(pair, {"jump": {"max_iter": 1}, "smooth": {"enabled": False}})


def test_review_writes_tables_and_skips_what_is_not_whole(spark, done, tmp_path):
    review.save(done, f"{tmp_path}/in")
    said = []
    got = review.review(spark, f"{tmp_path}/in", f"{tmp_path}/out", said.append)
    assert got["sessions"].count() == 2 and got["animals"].count() == 4 and got["skipped"].count() == 0
    assert "Sessions reviewed: 2" in said[0] and "pct_bad" in said[0]
    csv = pd.concat(map(pd.read_csv, glob.glob(f"{tmp_path}/out/preprocessing_qc_animal_summary.csv/*.csv")))
    assert len(csv) == 4 and {"session_idx", "animal", "pct_bad"} <= set(csv)
    assert sorted(r.session_idx for r in spark.read.parquet(f"{tmp_path}/out/{review.BUNDLE}/flags").collect()) == [1, 2]
    shutil.rmtree(f"{tmp_path}/in/animals/session_idx=2")
    with pytest.warns(UserWarning, match="session 2 is skipped: no animals"):
        got = review.review(spark, f"{tmp_path}/in", f"{tmp_path}/out2", None)
    assert [r.session_idx for r in got["sessions"].collect()] == [1] and [r.session_idx for r in got["skipped"].collect()] == [2]


def test_options_reach_every_step(spark, pair):
    raw = pair.where("session_idx = 1")
    options = {"overrides": {"data": {"fps": 40.0}, "jump": {"max_iter": 1}, "smooth": {"enabled": False}}, "scales": (0.5,), "layout": "per_scale", "window": {"names": ["centroid_dist", "head2head_dist"], "full": False, "stats": windows.STATS | {"numeric": ["mean", "std"]}}, "selection": {"max_keep": 1}, "ready": {"min_windows": 10, "min_features": 1}}
    got = pipeline.run(raw, **options)
    assert len(got["kept"]) == 1 and len(got["names"]) == 4
    # half a second at 40 frames a second
    assert got["matrix"].count() == 250 - 20 + 1
    assert {r.criterion: r["pass"] for r in got["checks"].collect()}["Enough windows"]
    parts = pipeline.run(raw, block=37, **options)
    a, b = (x["matrix"].orderBy("center_frame").toPandas() for x in (got, parts))
    assert list(a) == list(b) and len(a) == len(b)
    for c in a:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_extremes_by_pieces_are_those_of_windows(spark, pair, n):
    f = frames.frame_features(pair.where("session_idx = 1 and frame <= 60")).withColumn("centroid_dist", F.when(F.col("frame") % 9 != 0, F.col("centroid_dist")))
    options = {"seconds": n / 80, "names": ["centroid_dist"], "stats": windows.STATS | {"numeric": ["min", "max"]}, "full": False, "plain": True}
    a, b = (windows.summarize_scale(f, method=m, **options).orderBy("center_frame").toPandas() for m in ("sliding", "prefix"))
    pd.testing.assert_frame_equal(a, b)


def test_arguments_are_checked(spark, pair):
    f = pair.select("session_idx", "frame", "time_s", F.lit(True).alias("frame_ok"), F.col("x").alias("centroid_dist"))
    for bad in ({"seconds": -1.0}, {"seconds": 0.0}, {"seconds": 0.2, "fps": 0.0}, {"seconds": 0.2, "max_missing": 1.5}, {"seconds": 0.2, "method": "fast"}, {"seconds": 0.2, "names": ["no_such"]}):
        with pytest.raises(ValueError):
            windows.summarize_scale(f, **({"names": ["centroid_dist"]} | bad))
    t = f.select("centroid_dist")
    for bad in ({"max_missing": -0.1}, {"min_mad": -1.0}, {"min_iqr": float("nan")}, {"max_keep": 0}, {"min_keep": 1.5}, {"max_corr": 1.01}, {"max_corr": 0.0}):
        with pytest.raises(ValueError):
            select.select_features(t, ["centroid_dist"], **bad)
    for bad in ({"min_windows": 0}, {"max_median_missing": 2.0}, {"min_features": -1}, {"max_features": 0.5}):
        with pytest.raises(ValueError):
            select.readiness(f, ["centroid_dist"], [], **bad)
    with pytest.raises(ValueError, match="no such"):
        select.select_features(t, ["other"])
