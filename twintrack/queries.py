"""The registered queries over the pose adapter. Numbers are rounded to 6 decimals for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.core import hazen, moving_mean, series
from .operators import clean, figures, frames, qc, runs, segments, select, windows
from .params import Params
from .plans import pipeline
from .sources import pose as source

#: Cleaning by windows and aggregates alone: one pass of the jump filter, no smoothing.
NATIVE = Params.of({"jump": {"max_iter": 1}, "smooth": {"enabled": False}})
KEYS = ["session_idx", "animal", "node", "frame"]
#: Features of the matrix queries, and pairs of them.
MATRIX = ["centroid_dist", "partner_long_1", "approach_speed_1", "facing_1_to_2", "head2head_dist", "speed_alignment"]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c.name, 6) + F.lit(0.0)).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in df.schema])


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[DataFrame], DataFrame]):
    """Register a query on pose samples."""
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(pose(spark, sf_dir)))
    return f


def big(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query
def pose_long(p):
    return p


@query
def session_validation(p):
    return big(pipeline.validate(p), "n_frames", "n_nodes", "n_animals")


@query
def missing_frames(p):
    return qc.missing_frames(p)


@query
def conf_thresholds(p):
    return clean.confidence_thresholds(p)


@query
def conf_mask(p):
    return clean.mask_confidence(p).select(*KEYS, "x", "y", "low_conf")


def _missing(p):
    return p.withColumn("gap", F.col("x").isNull() | F.col("y").isNull())


@query
def find_runs(p):
    return big(runs.find_runs(_missing(p), "gap", runs.TRACK), "run_length")


@query
def dilate_mask(p):
    return runs.dilate(_missing(p), "gap", 2, runs.TRACK, "wide").select(*KEYS, "gap", "wide")


@query
def displacement(p):
    return runs.displacement(p).select(*KEYS, "disp")


@query
def jump_candidates(p):
    return runs.jump_candidates(p).select(*KEYS, "disp", "cutoff", "jump")


@query
def gap_fill_linear(p):
    return runs.fill_gaps(p).select(*KEYS, "x", "y", "filled")


@query
def gap_fill_nearest(p):
    return runs.fill_gaps(p, Params.of({"gaps": {"method": "nearest"}})).select(*KEYS, "x", "y", "filled")


@query
def geometry_limits(p):
    return clean.geometry_limits(clean.pair_distances(p))


@query
def geometry_blame(p):
    return clean.geometry_blame(p)


@query
def arena_bounds(p):
    return clean.arena_bounds(p)


@query
def arena_mask(p):
    return clean.mask_arena(p, Params.of({"qc": {"arena_percentile": (5, 95), "arena_margin_px": 1.0}})).select(*KEYS, "x", "y", "arena")


@query
def smooth_segments(p):
    return big(runs.smooth_segments(p, Params.of({"smooth": {"min_segment_length": 20}})), "run_length")


@query
def clean_native(p):
    return clean.clean_tracks(p, NATIVE).select(*KEYS, "x", "y", "low_conf", "jump", "interp", "geom", "arena", "final_nan")


def _frames(p):
    return qc.frame_qc(clean.clean_tracks(p, NATIVE), NATIVE)


@query
def frame_qc(p):
    return _frames(p).drop("excluded", "bad")


@query
def bad_frames(p):
    return _frames(p).select("session_idx", "animal", "frame", "bad")


@query
def bad_frames_pair(p):
    return qc.bad_pairs(_frames(p))


@query
def bad_frames_expanded(p):
    wide = Params.of({"jump": {"max_iter": 1}, "smooth": {"enabled": False}, "qc": {"expand_severe_badframes": 3}})
    return qc.frame_qc(clean.clean_tracks(p, wide), wide).select("session_idx", "animal", "frame", "bad")


@query
def node_qc(p):
    return qc.node_qc(clean.clean_tracks(p, NATIVE))


def _animals(p):
    c = clean.clean_tracks(p, NATIVE)
    return qc.animal_qc(qc.frame_qc(c, NATIVE), c, p, NATIVE)


@query
def session_qc(p):
    return big(_animals(p), "n_frames")


@query
def review_session(p):
    return big(qc.review_sessions(_frames(p), qc.missing_frames(p)), "n_frames", "n_animals")


@query
def ranked_sessions(p):
    return big(qc.ranked_sessions(_animals(p)), "rank")


@query
def metric_zscore(p):
    return qc.metric_zscores(_animals(p))


@query
def qc_flags(p):
    return big(qc.qc_flags(_animals(p)), "position", "n_flags")


@query
def qc_console_summary(p):
    return qc.console_summary(_animals(p))


@query
def qc_histogram(p):
    return big(qc.histogram(runs.displacement(p), "disp", 25), "bin", "count")


@query
def qc_histograms(p):
    """All metrics of the review at once."""
    return big(figures.histograms(_animals(p), qc.METRICS), "bin", "count")


@query
def step_histograms(p):
    return big(figures.step_histograms(p, 9), "bin", "count")


@query
def track_extents(p):
    return big(figures.extents(p, 40), "n")


def _features(p, **options):
    return frames.frame_features(p, **options)


for _family, _names in {
    "feat_distance": frames.FEATURES[0:8],
    "feat_egocentric": frames.FEATURES[8:12],
    "feat_orientation": frames.FEATURES[12:17] + frames.FEATURES[23:27],
    "feat_kinematics": frames.FEATURES[17:21],
    "feat_coupling": frames.FEATURES[21:23],
    "feat_contact": frames.FEATURES[27:31],
    "feat_interaction": frames.FEATURES[31:34],
}.items():
    QUERIES[_family] = lambda spark, sf_dir, names=_names: rounded(_features(pose(spark, sf_dir)).select("session_idx", "frame", *names))


@query
def frame_mask(p):
    return _features(p, bad=qc.bad_pairs(_frames(p))).select("session_idx", "frame", "time_s", "frame_ok")


QUERIES["feature_catalog"] = lambda spark, sf_dir: frames.catalogue_frame(spark)


@query
def contact_windows(p):
    """The shortest way through: distance of centroids, smoothed, contact, means over 0.2 s."""
    return windows.summarize_scale(_features(p), 0.2, names=["centroid_dist", "in_contact"], stats={"numeric": ["mean"], "boolean": ["occupancy"], "circular": []}, full=False)


def _scale(p, kind: str, seconds: float, stats: list[str] | None = None, full: bool = False, method: str = "sliding"):
    names = {"numeric": frames.NUMERIC, "boolean": frames.BOOLEAN, "circular": frames.CIRCULAR}[kind]
    return windows.summarize_scale(_features(p), seconds, names=names, stats=windows.STATS | ({kind: stats} if stats else {}), full=full, method=method).drop("center_time_s")


@query
def win_numeric(p):
    return _scale(p, "numeric", 0.2, ["mean", "std", "min", "max", "delta"], full=True)


@query
def win_slope(p):
    return _scale(p, "numeric", 0.5, ["slope"])


@query
def win_prefix(p):
    """The same statistics from running sums."""
    return _scale(p, "numeric", 0.5, ["mean", "std", "slope"], method="prefix")


@query
def win_extremes(p):
    """Least and largest values by running extremes of pieces."""
    return _scale(p, "numeric", 0.5, ["min", "max"], method="prefix")


@query
def win_boolean(p):
    return _scale(p, "boolean", 0.5)


@query
def win_circular(p):
    return _scale(p, "circular", 0.5)


@query
def win_valid_frac(p):
    f = _features(p)
    parts = [windows.summarize_scale(f, s, names=[], full=False) for s in windows.SCALES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _matrix(p, scales=windows.SCALES, layout: str = "wide", full: bool = True):
    return windows.summarize(_features(p), scales, layout=layout, names=MATRIX, stats={"numeric": ["mean", "std"], "boolean": [], "circular": []}, full=full)


@query
def win_multiscale_wide(p):
    return _matrix(p)


@query
def feature_matrix(p):
    """All sessions, in two groups of unequal columns put together again: odd ones have all scales, even ones the first two."""
    sessions = [_matrix(p.where(F.col("session_idx") % 2 == k), scales=s) for k, s in ((1, windows.SCALES), (0, windows.SCALES[:2]))]
    return select.feature_matrix(sessions)[0]


def _table(p):
    t = _matrix(p, layout="per_scale", full=False)
    return t, select.summary_names(t)


@query
def feature_stats(p):
    t, names = _table(p)
    return big(select.feature_stats(t, names), "pos")


@query
def corr_pearson(p):
    t, names = _table(p)
    return select.corr_pearson(t, [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]])


def _pairs(names):
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


@query
def corr_spearman(p):
    t, names = _table(p)
    return select.corr_spearman(t, _pairs(names)).drop("n")


@query
def rank_correlations(p):
    """All pairs of columns, with the rows that they share."""
    t, names = _table(p)
    return select.corr_spearman(t, _pairs(names))


@query
def variable_scores(p):
    t, names = _table(p)
    return big(select.variable_scores(select.feature_stats(t, names)), "pos")


@query
def topk_features(p):
    t, names = _table(p)
    return select.candidates(select.variable_scores(select.feature_stats(t, names)), max_keep=5, min_keep=5).select("feature", "score")


@query
def feature_report(p):
    t, names = _table(p)
    return select.inspect(t, names).select("feature", "valid_n", "median", "max_abs_corr")


@query
def inspection(p):
    """The whole report of every column."""
    t, names = _table(p)
    return big(select.inspect(t, names), "pos")


@query
def row_missing(p):
    t = _matrix(p, full=False)
    return select.row_missing(t, select.summary_names(t))


@query
def session_dominance(p):
    return select.session_dominance(_table(p)[0])


@query
def moving_mean_series(p):
    return p.withColumn("x_mean", moving_mean(F.col("x"), 5, series(*runs.TRACK))).select(*KEYS, "x_mean")


@query
def hazen_quantiles(p):
    return p.groupBy(*runs.TRACK).agg(*[hazen(F.col("x"), q).alias(f"q{int(q * 100)}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)])


@query
def merge_outputs(p):
    sessions = p.select("session_idx", "session_id").distinct()
    return source.merge_outputs(sessions, qc.bad_pairs(_frames(p)).groupBy("session_idx").agg(F.count_if("bad").alias("n_bad")))


QUERIES["node_lookup"] = lambda spark, sf_dir: spark.createDataFrame(sorted(source.node_map().items()), "name string, node int")


@query
def jump_filter_full(p):
    return clean.jump_filter(p).select(*KEYS, "jump")


@query
def smooth_lowpass(p):
    few = Params.of({"smooth": {"min_segment_length": 20, "n_pad": 4}})
    return clean.smooth(p.withColumn("repaired", F.lit(False)), few).select(*KEYS, "x", "y")


@query
def gap_fill_cubic(p):
    return clean.interpolate(p, Params.of({"gaps": {"method": "pchip"}})).select(*KEYS, "x", "y", "filled")


@query
def preprocess_full(p):
    return pipeline.preprocess(p).clean.select(*KEYS, "x", "y", "low_conf", "jump", "interp", "geom", "arena", "final_nan")


@query
def greedy_selection(p):
    t, names = _table(p)
    kept, scores = select.select_features(t, names, max_keep=8, min_keep=5)
    return scores.select("feature", "score", F.col("feature").isin(kept).alias("keep"))


@query
def readiness(p):
    t, names = _table(p)
    kept, _ = select.select_features(t, names)
    return select.readiness(t, names, kept)


def supplier_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark scale: the lines of each supplier as a session, 0.5 s windows of two features."""
    p = source.from_lineitem(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return rounded(windows.summarize_scale(_features(p), 0.5, names=["centroid_dist", "in_contact"], stats={"numeric": ["mean", "max"], "boolean": ["occupancy"], "circular": []}, full=False).drop("center_time_s"))


QUERIES["supplier_windows"] = supplier_windows


# -- the same as above on blocks of sessions, short ones here so that sessions have several
SHORT = 60


def _summary_blocks(p, kind: str, seconds: float, stats: list[str] | None = None, full: bool = False, method: str = "sliding"):
    names = {"numeric": frames.NUMERIC, "boolean": frames.BOOLEAN, "circular": frames.CIRCULAR}[kind]
    known = segments.frame_spans(p)
    f = segments.frame_features_blocks(p, block=SHORT, known=known)
    return segments.summarize_blocks(f, (seconds,), block=SHORT, known=known, names=names, stats=windows.STATS | ({kind: stats} if stats else {}), full=full, method=method).drop("center_time_s")


@query
def block_win_numeric(p):
    return _summary_blocks(p, "numeric", 0.2, ["mean", "std", "min", "max", "delta"], full=True)


@query
def block_win_prefix(p):
    return _summary_blocks(p, "numeric", 0.5, ["mean", "std", "slope"], method="prefix")


@query
def block_win_boolean(p):
    return _summary_blocks(p, "boolean", 0.5)


@query
def block_win_circular(p):
    return _summary_blocks(p, "circular", 0.5)


@query
def block_kinematics(p):
    return segments.frame_features_blocks(p, block=SHORT).select("session_idx", "frame", *frames.FEATURES[17:21])


@query
def block_runs(p):
    return segments.find_runs_blocks(_missing(p), "gap", runs.TRACK, SHORT)


@query
def block_dilate(p):
    return segments.dilate_blocks(_missing(p), "gap", 2, runs.TRACK, "wide", SHORT).select(*KEYS, "gap", "wide")


@query
def block_displacement(p):
    return segments.displacement_blocks(p, block=SHORT).select(*KEYS, "disp")


@query
def block_running(p):
    """How many samples a track has had, how far it has come, and where it was last."""
    known = segments.spans(p, runs.TRACK)
    made = segments.displacement_blocks(p, block=SHORT, known=known)
    made = segments.running(made, [("x", "seen", "count"), ("disp", "path", "sum"), ("x", "last_x", "last"), ("y", "max_y", "max")], runs.TRACK, SHORT, known)
    return made.select(*KEYS, "seen", "path", "last_x", "max_y")
