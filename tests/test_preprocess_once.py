"""Preprocessing makes each step once, and nothing that isn't asked for."""

import pytest

from twintrack.operators import clean, qc
from twintrack.plans import pipeline
from twintrack.sources import pose as source


def test_cleaning_does_not_repeat_the_jump_filter(spark):
    raw = source.normalised(source.synthetic(spark, 60, gap=True))
    plan = clean.clean_tracks(raw)._jdf.queryExecution().optimizedPlan().toString()
    # only the smoother is left; geometry and arena each read tracks that are written
    assert plan.count("FlatMapGroupsIn") == 1


def test_clean_tracks_alone_need_no_frame_quality(spark, monkeypatch):
    monkeypatch.setattr(qc, "frame_qc", lambda *_: pytest.fail("frame quality was not asked for"))
    done = pipeline.preprocess(source.synthetic(spark, 60, teleport=True))
    assert done.clean.count() == 60 * 26 and done.clean.where("jump").count() > 0


def test_frame_quality_is_written_once(spark):
    done = pipeline.preprocess(source.synthetic(spark, 60))
    assert done.frames is done.frames and done.frames.count() == 120 and done.bad.count() == 60
