"""Pose samples: one row for each session, frame, animal and node; NaN and infinities are null. Readers, writers, adapters."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import finite

KEYS = ["session_idx", "frame", "animal", "node"]
#: The 13 body points, numbered from 1.
NODES = ("nose", "neck", "left_ear", "right_ear", "LF_paw", "RF_paw", "LH_paw", "RH_paw", "body_pos", "tail_base", "mid_tail", "tail_tip", "mid_body_pos")
#: Names by which features know nodes.
ALIASES = {"nose": "nose", "neck": "neck", "body": "body_pos", "tailBase": "tail_base", "midBody": "mid_body_pos"}


def node_number(name: str, nodes: tuple[str, ...] = NODES) -> int:
    """1-based number of a body point; the name must be there exactly once, in any case."""
    found = [i for i, n in enumerate(nodes, 1) if n.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"body point {name!r} occurs {len(found)} times")
    return found[0]


def node_map(nodes: tuple[str, ...] = NODES) -> dict[str, int]:
    return {a: node_number(n, nodes) for a, n in ALIASES.items()}


def from_embeddings(embeddings: DataFrame, frames: int = 250, fps: float = 80.0) -> DataFrame:
    """Pose samples as a pure function of ``embeddings(vec_id, embedding)``: runs of ``frames`` vectors are sessions of two animals."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    at = lambda i: F.get(e, i.cast("int"))
    base = embeddings.select("vec_id", "embedding", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("animal"))
    base = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(13))).alias("node"))
    slot = ((F.col("animal") - 1) * 13 + F.col("node") - 1) * 2
    base = base.withColumns({"ex": at(slot), "ey": at(slot + 1), "es": at(52 + (F.col("node") - 1) % 12)})
    seen = F.abs("ex") <= 0.3
    shift = 3 * F.col("node") + 40 * F.col("animal")
    k = F.col("vec_id") % frames
    return base.select(
        F.format_string("session_%04d", F.floor(F.col("vec_id") / frames) + 1).alias("session_id"),
        (F.floor(F.col("vec_id") / frames) + 1).cast("int").alias("session_idx"),
        (k + 1).cast("int").alias("frame"),
        (k / F.lit(fps)).alias("time_s"),
        "animal",
        "node",
        F.when(seen, 200.0 + 100.0 * F.col("ex") + shift).alias("x"),
        F.when(seen, 200.0 + 100.0 * F.col("ey") + shift).alias("y"),
        F.least(F.lit(1.0), F.abs("es") * 4.0).alias("score"),
        ((k + 1) % 97 == 0).alias("excluded"),
    )


def from_lineitem(lineitem: DataFrame, fps: float = 80.0) -> DataFrame:
    """Benchmark-scale pose samples: a supplier's lines are a session, coordinates affine in quantity, price, discount and tax."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    rows = lineitem.select("l_suppkey", F.row_number().over(w).alias("frame"), *[F.col(c).cast("double").alias(c[2:]) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("animal")).select("*", F.explode(F.sequence(F.lit(1), F.lit(13))).alias("node"))
    return rows.select(
        F.format_string("session_%04d", "l_suppkey").alias("session_id"), F.col("l_suppkey").cast("int").alias("session_idx"), "frame", ((F.col("frame") - 1) / F.lit(fps)).alias("time_s"), "animal", "node",
        (200.0 + F.col("quantity") + 3 * F.col("node") + 40 * F.col("animal") + 100 * F.col("discount")).alias("x"),
        (200.0 + F.col("extendedprice") / 1000 + 2 * F.col("node") - 30 * F.col("animal") + 100 * F.col("tax")).alias("y"),
        F.lit(1.0).alias("score"), F.lit(False).alias("excluded"),
    )


def synthetic(spark: SparkSession, frames: int, nodes: int = 13, animals: int = 2, gap: bool = False, teleport: bool = False, scores: bool = True, fps: float = 80.0) -> DataFrame:
    """A session of animals that swing about fixed centres; optionally a short gap (animal 1, node 2, frames 20-23) and jumps at frame 60."""
    n, a, t = F.col("node"), F.col("animal"), F.col("time_s")
    base = spark.range(1, frames + 1).select(F.col("id").cast("int").alias("frame"))
    base = base.select("frame", ((F.col("frame") - 1) / F.lit(fps)).alias("time_s"), F.explode(F.sequence(F.lit(1), F.lit(animals))).alias("animal")).select("*", F.explode(F.sequence(F.lit(1), F.lit(nodes))).alias("node"))
    phase = 2 * math.pi * 0.01 * n
    body = 25 + 2 * a
    x = lambda t: 100 + 30 * a + 2 * n + 15 * F.sin(0.4 * math.pi * t + phase) + F.when(n == 1, body).when(n == 10, -body).otherwise(0)
    y = lambda t: 150 + 25 * a - n + 12 * F.cos(0.4 * math.pi * t + phase)
    px, py = x(t), y(t)
    if teleport:
        at, before = (n == 3) & (F.col("frame") == 60), (F.lit(60) - 2) / F.lit(fps)
        px = F.when(at, x(before) + F.when(a == 1, 120).otherwise(150)).otherwise(px)
        py = F.when(at, y(before) - F.when(a == 1, 90).otherwise(120)).otherwise(py)
    hole = (a == 1) & (n == 2) & F.col("frame").between(20, 23) if gap else F.lit(False)
    return base.select(
        F.lit("session_0001").alias("session_id"), F.lit(1).alias("session_idx"), "frame", "time_s", "animal", "node",
        F.when(~hole, px).alias("x"), F.when(~hole, py).alias("y"), (F.lit(1.0) if scores else F.lit(None).cast("double")).alias("score"), F.lit(False).alias("excluded"),
    )


def normalised(raw: DataFrame, fps: float = 80.0) -> DataFrame:
    """Raw samples with every column of pose samples: missing optional ones get their defaults, non-finite numbers become null."""
    has = set(raw.columns)
    pick = lambda c, default: F.col(c) if c in has else default
    return raw.select(
        F.coalesce(pick("session_id", F.lit(None).cast("string")), F.format_string("session_%04d", "session_idx")).alias("session_id"),
        F.col("session_idx").cast("int"), F.col("frame").cast("int"),
        F.coalesce(finite(pick("time_s", F.lit(None).cast("double"))), (F.col("frame") - 1) / F.lit(fps)).alias("time_s"),
        pick("animal", F.lit(1)).cast("int").alias("animal"), F.col("node").cast("int"),
        finite(F.col("x")).alias("x"), finite(F.col("y")).alias("y"), finite(pick("score", F.lit(None).cast("double"))).alias("score"),
        F.coalesce(pick("excluded", F.lit(False)), F.lit(False)).alias("excluded"),
    )


def with_scores(pose: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores joined to samples by session, frame and node, and by animal if ``scores`` has one (else the same for all animals)."""
    on = ["session_idx", "frame", "node"] + ["animal"] * ("animal" in scores.columns)
    return pose.drop("score").join(scores.select(*on, "score"), on, "left")


def write_sessions(pose: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder for each session, so that a filter on ``session_idx`` reads that session alone."""
    pose.repartition("session_idx").sortWithinPartitions("animal", "node", "frame").write.mode(mode).partitionBy("session_idx").parquet(path)


def read_sessions(spark: SparkSession, path: str, columns: list[str] | None = None, session_idx: int | None = None) -> DataFrame:
    """Sessions written before; one session and some columns only if asked for. The folder must be there and not empty."""
    got = spark.read.parquet(path)
    if session_idx is not None:
        got = got.where(F.col("session_idx") == session_idx)
    return got.select(*columns) if columns else got


def read_either(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of several places that is there; an error if none is."""
    errors = []
    for p in paths:
        try:
            return spark.read.parquet(p)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # a broken first source is an error
                raise
            errors.append(f"{p}: {str(e).splitlines()[0]}")
    raise FileNotFoundError("; ".join(errors))


def session_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(position, file_name, session_id) of the files below ``path``, in order of their names."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"))
    return files.select(F.row_number().over(Window.orderBy("file_name")).alias("position"), "file_name", F.regexp_replace("file_name", r"(_preproc)?\.[A-Za-z0-9]+$", "").alias("session_id"))


def merge_outputs(sessions: DataFrame, outputs: DataFrame) -> DataFrame:
    """Sessions with their outputs by session_idx; an error if a session has none."""
    missing = sessions.select("session_idx").distinct().join(outputs, "session_idx", "left_anti")
    lost = [r.session_idx for r in missing.orderBy("session_idx").limit(10).collect()]
    if lost:
        raise ValueError(f"sessions without output: {lost}")
    return sessions.join(outputs, "session_idx")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)
