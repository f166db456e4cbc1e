"""The 34 pairwise features of a frame and their catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.core import angle_deg, cosine, dot, gradient, left_of, minus, norm, series, smoothed, unit, yes
from ..sources.pose import node_map

#: Features by family, in order.
FAMILIES = [
    ("distance", ["centroid_dist", "body2body_dist", "head2head_dist", "tailbase2tailbase_dist", "nose1_to_body2_dist", "nose2_to_body1_dist", "nose1_to_tail2_dist", "nose2_to_tail1_dist"]),
    ("egocentric", ["partner_long_1", "partner_lat_1", "partner_long_2", "partner_lat_2"]),
    ("orientation", ["facing_1_to_2", "facing_2_to_1", "mutual_facing", "heading_diff_deg"]),
    ("orientation", ["cos_head_alignment"]),
    ("kinematics", ["radial_speed_12", "tangential_speed_12", "approach_speed_1", "approach_speed_2"]),
    ("coupling", ["speed_alignment", "accel_alignment"]),
    ("orientation", ["nose_bearing_1_deg", "nose_bearing_2_deg", "body_bearing_1_deg", "body_bearing_2_deg"]),
    ("contact", ["in_contact", "head_close", "body_close", "close_pair"]),
    ("interaction_logic", ["mutual_approach", "withdrawal", "asym_investigate"]),
]
FEATURES = [f for _, names in FAMILIES for f in names]
BOOLEAN = ["in_contact", "head_close", "body_close", "close_pair", "mutual_approach", "withdrawal"]
SMOOTHED = FEATURES[:27]
CIRCULAR = [f for f in FEATURES if "bearing_" in f or "heading_diff" in f]
NUMERIC = [f for f in FEATURES if f not in BOOLEAN and f not in CIRCULAR]


def kind(feature: str) -> str:
    return "boolean" if feature in BOOLEAN else "circular" if feature in CIRCULAR else "numeric"


def catalogue() -> list[tuple[str, str, bool, bool, bool, str]]:
    """(name, family, is_directed, is_circular, is_boolean, transform_hint) of every feature."""
    rows = []
    for family, names in FAMILIES:
        for f in names:
            directed = any(k in f for k in ("_1", "_2", "1_to_", "2_to_"))
            hint = "log1p" if "dist" in f else "binary" if f in BOOLEAN else "circular" if f in CIRCULAR else "zscore"
            rows.append((f, family, directed, f in CIRCULAR, f in BOOLEAN, hint))
    return rows


def catalogue_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalogue(), "name string, family string, is_directed boolean, is_circular boolean, is_boolean boolean, transform_hint string")


def wide_points(pose: DataFrame, nodes: dict[str, int] | None = None) -> DataFrame:
    """One row a frame with the points that features use, of both animals: one aggregate instead of self-joins."""
    nodes = nodes or node_map()
    need = {"nose": nodes["nose"], "body": nodes["body"], "tail": nodes["tailBase"], "mid": nodes.get("midBody", nodes["body"])}
    at = lambda a, n, c: F.max(F.when((F.col("animal") == a) & (F.col("node") == n), F.col(c)))
    cols = [at(a, n, c).alias(f"{name}{a}_{c}") for a in (1, 2) for name, n in need.items() for c in "xy"]
    return pose.where(F.col("node").isin(sorted(set(need.values())))).groupBy("session_idx", "frame").agg(F.min("time_s").alias("time_s"), *cols)


def raw_features(wide: DataFrame, fps: float = 80.0, px2mm: float = 1.0, contact_mm: float = 30.0, close_mm: float = 60.0) -> DataFrame:
    """Unsmoothed features and ``core`` (all core points are there), one row a frame; keys session_idx, frame, time_s."""
    p = lambda name: (F.col(f"{name}_x"), F.col(f"{name}_y"))

    def mean(parts: list) -> F.Column:
        n = sum((c.isNotNull().cast("int") for c in parts), F.lit(0))
        total = sum((F.coalesce(c, F.lit(0.0)) for c in parts), F.lit(0.0))
        return total / F.nullif(n, F.lit(0))

    first = wide.select("*", *[mean([F.col(f"{k}{a}_{c}") for k in ("body", "mid", "tail")]).alias(f"c{a}_{c}") for a in (1, 2) for c in "xy"])
    w = series("session_idx")
    first = first.select("*", *[gradient(F.col(f"c{a}_{c}") * px2mm, fps, w).alias(f"v{a}_{c}") for a in (1, 2) for c in "xy"])
    first = first.select("*", *[gradient(F.col(f"v{a}_{c}"), fps, w).alias(f"a{a}_{c}") for a in (1, 2) for c in "xy"])
    axes = {f"u{a}_{c}": v for a in (1, 2) for c, v in zip("xy", unit(minus(p(f"nose{a}"), p(f"tail{a}"))))}
    axes |= {f"r_{c}": v for c, v in zip("xy", unit(minus(p("c2"), p("c1"))))}
    first = first.withColumns(axes)
    c1, c2, n1, n2, b1, b2, t1, t2, u1, u2, v1, v2, r = map(p, ("c1", "c2", "nose1", "nose2", "body1", "body2", "tail1", "tail2", "u1", "u2", "v1", "v2", "r"))
    gap = lambda a, b: norm(*minus(a, b)) * px2mm
    v12, v21 = minus(c2, c1), minus(c1, c2)
    back = (-r[0], -r[1])
    apart = minus(v2, v1)
    f1, f2 = dot(u1, unit(minus(c2, n1))), dot(u2, unit(minus(c1, n2)))
    f = {
        "centroid_dist": gap(c1, c2), "body2body_dist": gap(b1, b2), "head2head_dist": gap(n1, n2), "tailbase2tailbase_dist": gap(t1, t2),
        "nose1_to_body2_dist": gap(n1, b2), "nose2_to_body1_dist": gap(n2, b1), "nose1_to_tail2_dist": gap(n1, t2), "nose2_to_tail1_dist": gap(n2, t1),
        "partner_long_1": dot(v12, u1) * px2mm, "partner_lat_1": dot(v12, left_of(u1)) * px2mm, "partner_long_2": dot(v21, u2) * px2mm, "partner_lat_2": dot(v21, left_of(u2)) * px2mm,
        "facing_1_to_2": f1, "facing_2_to_1": f2, "mutual_facing": F.least(f1, f2), "heading_diff_deg": angle_deg(u1, u2), "cos_head_alignment": dot(u1, u2),
        "radial_speed_12": dot(apart, r), "tangential_speed_12": dot(apart, left_of(r)), "approach_speed_1": dot(minus(v1, v2), r), "approach_speed_2": dot(apart, back),
        "speed_alignment": cosine(v1, v2), "accel_alignment": cosine(p("a1"), p("a2")),
        "nose_bearing_1_deg": angle_deg(u1, unit(minus(n2, n1))), "nose_bearing_2_deg": angle_deg(u2, unit(minus(n1, n2))),
        "body_bearing_1_deg": angle_deg(u1, unit(minus(b2, n1))), "body_bearing_2_deg": angle_deg(u2, unit(minus(b1, n2))),
    }
    flag = lambda c: yes(c).cast("double")
    f |= {
        "in_contact": flag(f["centroid_dist"] <= contact_mm), "head_close": flag(f["head2head_dist"] <= contact_mm), "body_close": flag(f["body2body_dist"] <= contact_mm), "close_pair": flag(f["centroid_dist"] <= close_mm),
        "mutual_approach": flag((f["approach_speed_1"] > 0) & (f["approach_speed_2"] > 0)), "withdrawal": flag((f["approach_speed_1"] < 0) & (f["approach_speed_2"] < 0)),
        "asym_investigate": flag(f["nose1_to_body2_dist"] < f["nose2_to_body1_dist"]) - flag(f["nose2_to_body1_dist"] < f["nose1_to_body2_dist"]),
    }
    core = F.lit(True)
    for q in (c1, c2, n1, n2, b1, b2, t1, t2):
        core = core & q[0].isNotNull() & q[1].isNotNull()
    return first.select("session_idx", "frame", "time_s", core.alias("core"), *[f[k].alias(k) for k in FEATURES])


def frame_features(pose: DataFrame, bad: DataFrame | None = None, nodes: dict[str, int] | None = None, fps: float = 80.0, px2mm: float = 1.0, contact_mm: float = 30.0, close_mm: float = 60.0, span: int = 5) -> DataFrame:
    """(session_idx, frame, time_s, frame_ok, 34 features): the first 27 smoothed, the others as they are.

    ``bad(session_idx, frame, bad)`` marks frames that are not ok for any animal; frames without a row there are.
    """
    rows = raw_features(wide_points(pose, nodes), fps, px2mm, contact_mm, close_mm)
    w, whole = series("session_idx"), Window.partitionBy("session_idx")
    rows = rows.select("session_idx", "frame", "time_s", "core", *[(smoothed(F.col(f), span, w, whole) if f in SMOOTHED else F.col(f)).alias(f) for f in FEATURES])
    if bad is not None:
        marks = bad.groupBy("session_idx", "frame").agg(F.bool_or("bad").alias("_bad"))
        rows = rows.join(marks, ["session_idx", "frame"], "left")
        return rows.select("session_idx", "frame", "time_s", (F.col("core") & ~yes(F.col("_bad"))).alias("frame_ok"), *FEATURES)
    return rows.select("session_idx", "frame", "time_s", F.col("core").alias("frame_ok"), *FEATURES)
