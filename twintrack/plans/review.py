"""Review of what preprocessing has left, in one call: tables, CSV reports, a bundle and a text for the console."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import qc
from ..sources.pose import write_csv
from .pipeline import Preprocessed

#: The tables that a review needs of each session.
NEEDED = ("frames", "animals", "missing")
BUNDLE = "preprocessing_qc_review"


def save(done: Preprocessed, path: str, mode: str = "errorifexists") -> None:
    """The tables of preprocessed sessions below ``path``, one folder for each session in each."""
    for name in ("clean", "nodes", *NEEDED):
        getattr(done, name).repartition("session_idx").write.mode(mode).partitionBy("session_idx").parquet(f"{path}/{name}")


def console_text(sessions: DataFrame, animals: DataFrame) -> str:
    """The summary as lines of text: how many sessions and animals, and median, 90th percentile and maximum of each metric."""
    lines = ["===== Preprocessing QC summary =====", f"Sessions reviewed: {sessions.count()}", f"Animal rows:       {animals.count()}", ""]
    known = {r.metric: r for r in qc.console_summary(animals).collect()}  # a row for each metric
    lines += [f"{m:<34} median={known[m].median:7.3f}   p90={known[m].p90:7.3f}   max={known[m]['max']:7.3f}" for m in qc.METRICS if m in known]
    return "\n".join(lines)


def review(spark: SparkSession, path: str, out: str, show=print) -> dict[str, DataFrame]:
    """Reviews the outputs that ``save`` wrote: {sessions, animals, skipped}; ``show`` gets the text (None: nobody).

    Written below ``out``: preprocessing_qc_session_summary.csv, preprocessing_qc_animal_summary.csv and the bundle of both tables with
    ranks, flags and z-scores as Parquet. A session that lacks a table or whose table has no row is left out with a warning and
    listed in ``skipped(session_idx, reason)``; if none is left, that is an error.
    """
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in NEEDED}
    there = [t.select("session_idx").distinct().withColumn("name", F.lit(n)) for n, t in tables.items()]
    have = there[0].unionByName(there[1]).unionByName(there[2]).groupBy("session_idx").agg(F.collect_set("name").alias("names"))
    lost = F.array_sort(F.array_except(F.array(*[F.lit(n) for n in NEEDED]), "names"))
    skipped = have.where(F.size(lost) > 0).select("session_idx", F.concat(F.lit("no "), F.array_join(lost, ", ")).alias("reason"))
    for r in skipped.orderBy("session_idx").limit(20).collect():
        warnings.warn(f"session {r.session_idx} is skipped: {r.reason}", stacklevel=2)
    whole = have.where(F.size(lost) == 0).select("session_idx")
    if whole.isEmpty():
        raise ValueError(f"no preprocessed session below {path} can be reviewed")
    frames, animals, missing = (tables[n].join(whole, "session_idx", "left_semi") for n in NEEDED)
    sessions = qc.review_sessions(frames, missing)
    write_csv(sessions.orderBy("session_idx"), f"{out}/preprocessing_qc_session_summary.csv")
    write_csv(animals.orderBy("session_idx", "animal"), f"{out}/preprocessing_qc_animal_summary.csv")
    bundle = {"sessions": sessions, "animals": animals, "ranked": qc.ranked_sessions(animals), "flags": qc.qc_flags(animals), "zscores": qc.metric_zscores(animals), "skipped": skipped}
    for name, table in bundle.items():
        table.write.mode("overwrite").parquet(f"{out}/{BUNDLE}/{name}")
    got = {n: spark.read.parquet(f"{out}/{BUNDLE}/{n}") for n in bundle}
    if show:
        show(console_text(got["sessions"], got["animals"]))
    return got
