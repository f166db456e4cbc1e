"""Whole pipelines: preprocessing of sessions, and from tracks to features ready for clustering."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import checks
from ..operators import qc, segments
from ..operators.clean import clean_tracks
from ..operators.frames import frame_features
from ..operators.select import inspect, readiness, readiness_checks, select_features, summary_names
from ..operators.windows import META, SCALES, summarize
from ..params import Params
from ..sources.pose import normalised
from ..sources.scratch import written


def validate(pose: DataFrame, animals: tuple[int, ...] = (1, 2)) -> DataFrame:
    """One row for each session: frames, nodes, animals, least time step, whether frames 1 to the last are there with all rows, and ``ok``."""
    per = pose.groupBy("session_idx", "frame").agg(F.min("time_s").alias("t"), F.count("*").alias("n"))
    gaps = per.select("session_idx", "frame", "n", (F.lead("t").over(Window.partitionBy("session_idx").orderBy("frame")) - F.col("t")).alias("dt"))
    frames = gaps.groupBy("session_idx").agg(F.count("*").alias("n_frames"), F.min("dt").alias("min_step_s"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    sizes = pose.groupBy("session_idx").agg(F.countDistinct("node").alias("n_nodes"), F.countDistinct("animal").alias("n_animals"))
    rows = frames.join(sizes, "session_idx")
    whole = (F.col("least") == F.col("most")) & (F.col("most") == F.col("n_nodes") * F.col("n_animals")) & (F.col("first") == 1) & (F.col("last") == F.col("n_frames"))
    ok = (F.col("n_frames") >= 2) & (F.col("min_step_s") > 0) & F.col("n_animals").isin(*animals) & whole
    return rows.select("session_idx", "n_frames", "n_nodes", "n_animals", "min_step_s", whole.alias("complete"), F.coalesce(ok, F.lit(False)).alias("ok"))


@dataclass
class Preprocessed:
    """Cleaned tracks, written, and what follows from them, made when it is first asked for."""

    clean: DataFrame
    pose: DataFrame
    params: Params

    @cached_property
    def frames(self) -> DataFrame:
        return written(qc.frame_qc(self.clean, self.params))

    @cached_property
    def nodes(self) -> DataFrame:
        return qc.node_qc(self.clean)

    @cached_property
    def animals(self) -> DataFrame:
        return qc.animal_qc(self.frames, self.clean, self.pose if self.params.output.return_raw else None, self.params)

    @cached_property
    def missing(self) -> DataFrame:
        return qc.missing_frames(self.pose)

    @property
    def bad(self) -> DataFrame:
        return qc.bad_pairs(self.frames)


def preprocess(raw: DataFrame, overrides: dict | Params | None = None, check: bool = True) -> Preprocessed:
    """All sessions of ``raw`` at once: one plan, dealt out by track, then by frame. An error names sessions that aren't valid or lack required scores."""
    p = overrides if isinstance(overrides, Params) else Params.of(overrides)
    pose = normalised(raw, p.data.fps)
    if check:
        wrong = [r.session_idx for r in validate(pose).where("not ok").orderBy("session_idx").limit(10).collect()]
        if wrong:
            raise ValueError(f"sessions that aren't valid: {wrong}")
    if p.confidence.require_scores:
        none = pose.groupBy("session_idx").agg(F.count("score").alias("n")).where("n = 0")
        if lost := [r.session_idx for r in none.orderBy("session_idx").limit(10).collect()]:
            raise ValueError(f"sessions without scores, which are required: {lost}")
    return Preprocessed(written(clean_tracks(pose, p)), pose, p)


def preprocess_one(raw: DataFrame, session_idx: int, overrides: dict | None = None) -> Preprocessed:
    return preprocess(raw.where(F.col("session_idx") == session_idx), overrides)


def features_of(done: Preprocessed, scales=SCALES, layout: str = "wide", fps: float = 80.0, block: int | None = None, window: dict | None = None, **options) -> DataFrame:
    """Window summaries of preprocessed sessions. ``options`` are those of ``frame_features``, ``window`` those of ``summarize``; with ``block`` sessions are dealt out in blocks of so many frames."""
    window = window or {}
    if block is None:
        return summarize(frame_features(done.clean, done.bad, fps=fps, **options), scales, fps, layout, **window)
    known = segments.frame_spans(done.clean)
    features = segments.frame_features_blocks(done.clean, done.bad, fps=fps, block=block, known=known, **options)
    return segments.summarize_blocks(features, scales, fps, block, known, layout=layout, **window)


def run(raw: DataFrame, overrides: dict | None = None, scales=SCALES, layout: str = "wide", fps: float | None = None, block: int | None = None, compute: dict | None = None, window: dict | None = None, selection: dict | None = None, ready: dict | None = None) -> dict:
    """From raw samples to a selection: matrix, report, kept features, readiness.

    ``compute``, ``window``, ``selection`` and ``ready`` hold options of ``frame_features``, ``summarize``, ``select_features`` and ``readiness``; fps
    is that of the data unless given. With the layout wide and several scales every column is missing in the rows of the other
    scales, so no feature passes the limit on missing values; per_scale shares the columns.
    """
    p = overrides if isinstance(overrides, Params) else Params.of(overrides)
    fps = p.data.fps if fps is None else fps
    checks.positive(fps=fps)
    done = preprocess(raw, p)
    matrix = written(features_of(done, scales, layout, fps, block, window, **(compute or {})))
    names = summary_names(matrix)
    kept, scores = select_features(matrix, names, **(selection or {}))
    state = readiness(matrix, names, kept, **(ready or {}))
    return {"preprocessed": done, "matrix": matrix, "names": names, "scores": scores, "kept": kept, "selected": matrix.select(*META, *kept), "report": inspect(matrix, kept) if kept else None, "inspection": inspect(matrix, names) if names else None, "readiness": state, "checks": readiness_checks(state)}
