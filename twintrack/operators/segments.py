"""Long sessions in blocks: the same rows as whole-session windows, from as many tasks as there are blocks.

A session's frames are cut into blocks. Windows of bounded reach see a block with a halo: rows near a border are copied to the blocks
that look at them. What reaches without bound (running sums and counts, the last value, the number of a run) is computed in each
block, and one row a block carries it on. A session with missing or repeated frames stays one block, as a halo of frames would
not be one of rows; ``preprocess`` refuses such sessions anyway.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.core import moving_mean, series
from ..sources.scratch import written
from . import runs
from .frames import FEATURES, SMOOTHED, raw_features, wide_points
from .windows import SCALES, frames_of, summarize

#: Frames of a block: a quarter of an hour at 80 frames a second.
BLOCK = 72_000


def spans(df: DataFrame, keys: list[str]) -> DataFrame:
    """(_session, lo, hi, dense) by session, written; dense: every series of ``keys`` has each frame of the session once.

    What is computed from a table with the same frames can be dealt out by the same spans.
    """
    per = df.groupBy(*keys).agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"), F.count("*").alias("n"), F.countDistinct("frame").alias("d"))
    fine = F.bool_and((F.col("n") == F.col("d")) & (F.col("n") == F.col("hi") - F.col("lo") + 1)) & (F.min("lo") == F.max("lo")) & (F.min("hi") == F.max("hi"))
    return written(per.groupBy(F.col("session_idx").alias("_session")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), fine.alias("dense")))


def frame_spans(pose: DataFrame) -> DataFrame:
    """Spans for features, which have a row for each frame of ``pose`` if every track has one."""
    return spans(pose, runs.TRACK)


def dealt(df: DataFrame, keys: list[str], before: int = 0, after: int = 0, block: int = BLOCK, known: DataFrame | None = None) -> DataFrame:
    """``df`` with ``session_idx`` as a struct (session, block, first, last): a part of the session with ``before`` rows ahead of its frames and ``after`` rows behind.

    ``known``: the ``spans`` of the frames, if they are known already. Any operator that partitions by session_idx then works on blocks; ``own`` keeps the rows of the frames first to last.
    """
    if block < 1 or before < 0 or after < 0:
        raise ValueError("a block has one frame at least, a halo none at least")
    known = spans(df, keys) if known is None else known  # a row for each session
    at = F.col("frame") - F.col("lo")
    last = F.floor((F.col("hi") - F.col("lo")) / block)
    floor = lambda x: F.floor(x / block)
    which = F.when(F.col("dense"), F.sequence(F.greatest(F.lit(0), floor(at - after)), F.least(last, floor(at + before)))).otherwise(F.array(F.lit(0).cast("long")))
    rows = df.join(known, F.col("session_idx").eqNullSafe(F.col("_session"))).withColumn("_block", F.explode(which))
    first = F.when(F.col("dense"), F.col("lo") + F.col("_block") * block).otherwise(F.col("lo"))
    stop = F.when(F.col("dense"), F.least(F.col("hi").cast("long"), F.col("lo") + (F.col("_block") + 1) * block - 1)).otherwise(F.col("hi"))
    part = F.struct(F.col("session_idx").alias("session"), F.col("_block").alias("block"), first.cast("long").alias("first"), stop.cast("long").alias("last"))
    return rows.withColumn("session_idx", part).select(*df.columns)


def own(df: DataFrame, frame: str = "frame") -> DataFrame:
    """The rows of the blocks' own frames, with the session in ``session_idx`` again."""
    s = F.col("session_idx")
    return df.where(F.col(frame).between(s["first"], s["last"])).withColumn("session_idx", s["session"])


def in_blocks(df: DataFrame, work: Callable[[DataFrame], DataFrame], before: int, after: int, keys: list[str] | None = None, block: int = BLOCK, frame: str = "frame", known: DataFrame | None = None) -> DataFrame:
    """``work`` applied to blocks: equal to ``work(df)`` if each row of it depends on ``before`` rows ahead and ``after`` rows behind in its series."""
    return own(work(dealt(df, keys or ["session_idx"], before, after, block, known)), frame)


def summarize_blocks(features: DataFrame, scales=SCALES, fps: float = 80.0, block: int = BLOCK, known: DataFrame | None = None, **options) -> DataFrame:
    """``windows.summarize`` on blocks; the halo is that of the longest window."""
    reach = [frames_of(s, fps) for s in scales]
    return in_blocks(features, lambda d: summarize(d, scales, fps, **options), max(r[1] for r in reach), max(r[2] for r in reach), block=block, frame="center_frame", known=known)


def frame_features_blocks(pose: DataFrame, bad: DataFrame | None = None, nodes: dict[str, int] | None = None, fps: float = 80.0, px2mm: float = 1.0, contact_mm: float = 30.0, close_mm: float = 60.0, span: int = 5, block: int = BLOCK, known: DataFrame | None = None) -> DataFrame:
    """``frames.frame_features`` on blocks. Which series are flags, and not smoothed, is settled for whole sessions first."""
    known = frame_spans(pose) if known is None else known
    wide = wide_points(pose, nodes)
    raw = in_blocks(wide, lambda d: raw_features(d, fps, px2mm, contact_mm, close_mm), 2, 0, block=block, known=known)
    if span > 1:
        flags = raw.groupBy("session_idx").agg(*[F.coalesce(F.bool_and(F.col(f).isin(0.0, 1.0)), F.lit(True)).alias(f"_flag_{f}") for f in SMOOTHED])
        w = series("session_idx")
        smooth = lambda d: d.select("session_idx", "frame", "time_s", "core", *[moving_mean(F.col(f), span, w).alias(f"_m_{f}") for f in SMOOTHED], *FEATURES)
        rows = in_blocks(raw, smooth, span // 2, (span - 1) // 2, block=block, known=known).join(flags, "session_idx")
        raw = rows.select("session_idx", "frame", "time_s", "core", *[F.when(F.col(f"_flag_{f}"), F.col(f)).otherwise(F.col(f"_m_{f}")).alias(f) if f in SMOOTHED else F.col(f) for f in FEATURES])
    ok = F.col("core")
    if bad is not None:
        marks = bad.groupBy("session_idx", "frame").agg(F.bool_or("bad").alias("_bad"))
        raw = raw.join(marks, ["session_idx", "frame"], "left")
        ok = ok & ~F.coalesce("_bad", F.lit(False))
    return raw.select("session_idx", "frame", "time_s", ok.alias("frame_ok"), *FEATURES)


def displacement_blocks(pose: DataFrame, to: str = "disp", block: int = BLOCK, known: DataFrame | None = None) -> DataFrame:
    """``runs.displacement`` on blocks."""
    return in_blocks(pose, lambda d: runs.displacement(d, to), 1, 0, runs.TRACK, block, known=known)


def dilate_blocks(df: DataFrame, mask: str, half: int, keys: list[str], to: str, block: int = BLOCK, known: DataFrame | None = None) -> DataFrame:
    """``runs.dilate`` on blocks; the first of ``keys`` is session_idx."""
    return in_blocks(df, lambda d: runs.dilate(d, mask, half, keys, to), half, half, keys, block, known=known)


def find_runs_blocks(df: DataFrame, mask: str, keys: list[str], block: int = BLOCK, known: DataFrame | None = None) -> DataFrame:
    """``runs.find_runs`` on blocks: runs that touch a border are joined with what goes on behind it, two rows a block at most."""
    parts = runs.find_runs(dealt(df, keys, block=block, known=known), mask, keys)
    s, rest = F.col("session_idx"), keys[1:]
    parts = parts.select(s["session"].alias("session_idx"), s["block"].alias("_block"), *rest, "run_start", "run_stop", "run_length", (F.col("run_start") == s["first"]).alias("_left"), (F.col("run_stop") == s["last"]).alias("_right"))
    inner = parts.where(~(F.col("_left") | F.col("_right"))).select(*keys, "run_start", "run_stop", "run_length")
    w = Window.partitionBy(*keys).orderBy("_block", "run_start")
    goes_on = F.col("_left") & F.coalesce(F.lag("_right").over(w) & (F.lag("_block").over(w) == F.col("_block") - 1), F.lit(False))
    edge = parts.where(F.col("_left") | F.col("_right")).withColumn("_new", (~goes_on).cast("int")).withColumn("_run", F.sum("_new").over(w))
    whole = edge.groupBy(*keys, "_run").agg(F.min("run_start").alias("run_start"), F.max("run_stop").alias("run_stop"), F.sum("run_length").alias("run_length"))
    return inner.unionByName(whole.drop("_run"))


#: How what a block passes on is made of its rows, and what the blocks before pass on together.
_KINDS = {
    "sum": (lambda v: F.sum(v), lambda v, w: F.sum(v).over(w), lambda carry, here: F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))),
    "count": (lambda v: F.count(v), lambda v, w: F.sum(v).over(w), lambda carry, here: F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))),
    "last": (lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("frame"))), lambda v, w: F.last(v, ignorenulls=True).over(w), lambda carry, here: F.coalesce(here, carry)),
    "min": (lambda v: F.min(v), lambda v, w: F.min(v).over(w), lambda carry, here: F.least(carry, here)),
    "max": (lambda v: F.max(v), lambda v, w: F.max(v).over(w), lambda carry, here: F.greatest(carry, here)),
}


def running(df: DataFrame, wanted: list[tuple[str, str, str]], keys: list[str], block: int = BLOCK, known: DataFrame | None = None) -> DataFrame:
    """Adds a column for each (value, name, kind) of ``wanted``: the sum, count, last, min or max of value (nulls left out) from a series' first frame to the row's own.

    Each block passes one row on; prefixes over these rows are joined back. Sums and counts of nothing are 0, the others null.
    """
    if unknown := {k for _, _, k in wanted} - set(_KINDS):
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    rows = dealt(df, keys, block=block, known=known)
    rest, s = keys[1:], F.col("session_idx")
    own_rows = series(*keys).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True)
    here = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "last": last}
    local = rows.withColumns({f"_here{i}": here[k](F.col(v)).over(own_rows) for i, (v, _, k) in enumerate(wanted)})
    passed = rows.groupBy(*keys).agg(*[_KINDS[k][0](F.col(v)).alias(f"_passed{i}") for i, (v, _, k) in enumerate(wanted)])
    w = Window.partitionBy(F.col("session_idx.session"), *rest).orderBy(s["block"]).rowsBetween(Window.unboundedPreceding, -1)
    carry = passed.select(*keys, *[_KINDS[k][1](F.col(f"_passed{i}"), w).alias(f"_carry{i}") for i, (_, _, k) in enumerate(wanted)])
    both = local.join(carry, keys).withColumns({to: _KINDS[k][2](F.col(f"_carry{i}"), F.col(f"_here{i}")) for i, (_, to, k) in enumerate(wanted)})
    return own(both).select(*df.columns, *[to for _, to, _ in wanted])
