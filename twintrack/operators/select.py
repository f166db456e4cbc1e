"""Feature matrix: statistics, correlations, selection and readiness for clustering."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import checks
from ..sources.scratch import written
from . import order
from .windows import META


def feature_matrix(sessions: list[DataFrame]) -> tuple[DataFrame, list[str]]:
    """Rows of all sessions and the names of the summary columns; columns that a session lacks are null."""
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sessions)
    return table, summary_names(table)


def summary_names(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in META]


def once(table: DataFrame, names: list[str]) -> DataFrame:
    """The columns as doubles, written so that what lies behind them is computed once; a table that this has returned stays as it is."""
    if getattr(table, "_tw_written", None) == names:
        return table
    made = written(table.select(*[F.col(n).cast("double").alias(n) for n in names]))
    made._tw_written = list(names)
    return made


def feature_stats(table: DataFrame, names: list[str]) -> DataFrame:
    """(feature, pos, valid_n, missing_frac, median, mad, iqr, std, is_binary, prevalence).

    mad: median absolute deviation from the median; iqr: mid-point rule; prevalence of binary features over all rows. Order statistics
    come from the sorted distinct values of all columns together, see ``order``; the table is computed once.
    """
    table = once(table, names)
    one = table.agg(F.count(F.lit(1)).alias("rows"), *[f(n).alias(f"{n}__{k}") for n in names for k, f in (("n", F.count), ("sd", F.stddev_samp), ("bin", lambda c: F.bool_and(F.col(c).isin(0.0, 1.0))), ("on", lambda c: F.count_if(F.col(c) > 0.5)))]).first()
    q = order.Sorted(order.cells(table, [F.col(n) for n in names])).quantiles([0.25, 0.5, 0.75])
    away = [F.abs(F.col(n) - F.lit(q.get((i, 0.5)))) for i, n in enumerate(names)]
    mads = order.Sorted(order.cells(table, away)).quantiles([0.5])
    rows = []
    for i, n in enumerate(names):
        k, total = one[f"{n}__n"], one["rows"]
        iqr = q[i, 0.75] - q[i, 0.25] if k else None
        std = None if not k else 0.0 if k == 1 else one[f"{n}__sd"]
        binary = bool(k) and bool(one[f"{n}__bin"])
        rows.append((n, i, k, (total - k) / total if total else None, q.get((i, 0.5)), mads.get((i, 0.5)), iqr, std, binary, one[f"{n}__on"] / total if binary else None))
    rows = [tuple(None if v is None else float(v) if isinstance(v, float) else v for v in r) for r in rows]
    return table.sparkSession.createDataFrame(rows, "feature string, pos int, valid_n long, missing_frac double, median double, mad double, iqr double, std double, is_binary boolean, prevalence double")


def corr_pearson(table: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, rho) of pairs of columns on the rows where both are there, in one pass."""
    got = table.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return _long(got, pairs)


def _long(one_row: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("rho")) for i, (a, b) in enumerate(pairs)]
    return one_row.select(F.explode(F.array(*cells)).alias("c")).select("c.a", "c.b", F.when(~F.isnan("c.rho"), F.col("c.rho")).alias("rho"))


def corr_spearman(table: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, n, rho) of mean-tie ranks of pairs of columns, ranked on the n rows where both are there; see ``order.spearman``."""
    names = sorted({x for p in pairs for x in p})
    at = {n: i for i, n in enumerate(names)}
    got = order.spearman(table, names, [(at[a], at[b]) for a, b in pairs])
    return table.sparkSession.createDataFrame([(a, b, *got[at[a], at[b]]) for a, b in pairs], "a string, b string, n long, rho double")


def inspect(table: DataFrame, names: list[str], method: str = "spearman") -> DataFrame:
    """``feature_stats`` with ``max_abs_corr``, the largest absolute correlation with another feature."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    table = once(table, names)
    stats = feature_stats(table, names)
    if not pairs:
        return stats.withColumn("max_abs_corr", F.lit(None).cast("double"))
    rho = (corr_pearson if method == "pearson" else corr_spearman)(table, pairs)
    ends = rho.select("a", "rho").unionByName(rho.select(F.col("b").alias("a"), "rho"))
    top = ends.groupBy(F.col("a").alias("feature")).agg(F.max(F.abs("rho")).alias("max_abs_corr"))
    return stats.join(top, "feature", "left")


def variable_scores(stats: DataFrame, max_missing: float = 0.10, min_mad: float = 1e-6, min_iqr: float = 1e-6) -> DataFrame:
    """(feature, pos, base, score): score of features with few missing values that vary, null for the others.

    The robustly scaled column has a median absolute deviation of 1 and an interquartile range of iqr / mad; their sum is the score.
    """
    base = (F.col("missing_frac") <= max_missing) & (F.col("mad") > min_mad) & (F.col("iqr") > min_iqr)
    base = F.coalesce(base, F.lit(False))
    return stats.select("feature", "pos", base.alias("base"), F.when(base, 1 + F.col("iqr") / F.col("mad")).alias("score"))


def candidates(scores: DataFrame, max_keep: int = 120, min_keep: int = 20) -> DataFrame:
    """The best scored features, at most ``max_keep``; ties keep their order. Only scored ones can be taken, so ``min_keep`` changes nothing; it is accepted."""
    checks.whole(max_keep=max_keep, min_keep=min_keep)
    return scores.where("score is not null").orderBy(F.col("score").desc_nulls_last(), "pos").limit(int(max_keep))


def select_features(table: DataFrame, names: list[str], max_missing: float = 0.10, min_mad: float = 1e-6, min_iqr: float = 1e-6, max_keep: int = 120, min_keep: int = 20, max_corr: float = 0.90) -> tuple[list[str], DataFrame]:
    """(kept features in order of columns, scores). Candidates go by score; one is kept if its rank correlation with every kept one is below ``max_corr`` or unknown.

    The correlations of all candidates are computed at once; only the greedy choice over at most ``max_keep`` of them is on the driver.
    """
    checks.share(max_missing=max_missing)
    checks.least_zero(min_mad=min_mad, min_iqr=min_iqr)
    checks.whole(max_keep=max_keep, min_keep=min_keep)
    checks.positive(max_corr=max_corr)
    if max_corr >= 1.01:
        raise ValueError(f"max_corr must be below 1.01, not {max_corr!r}")
    checks.columns(table.columns, names)
    table = once(table, names)
    scores = variable_scores(feature_stats(table, names), max_missing, min_mad, min_iqr)
    best = [r.feature for r in candidates(scores, max_keep, min_keep).collect()]
    pairs = [(a, b) for i, a in enumerate(best) for b in best[i + 1 :]]
    rho = {(r.a, r.b): r.rho for r in corr_spearman(table, pairs).collect()} if pairs else {}
    kept: list[str] = []
    for f in best:
        known = (rho.get((g, f), rho.get((f, g))) for g in kept)
        if all(r is None or abs(r) < max_corr for r in known):
            kept.append(f)
    return [n for n in names if n in set(kept)], scores


def row_missing(table: DataFrame, names: list[str]) -> DataFrame:
    """META keys and the share of missing summary columns of each row."""
    gaps = sum((F.col(n).isNull().cast("int") for n in names), F.lit(0))
    return table.select("session_idx", "center_frame", "window_sec", (gaps / max(1, len(names))).alias("row_missing"))


def session_dominance(table: DataFrame) -> DataFrame:
    """(session_idx, n, share) of rows."""
    n = table.groupBy("session_idx").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each session


def pca_ratios(table: DataFrame, names: list[str]) -> list[float]:
    """Explained percentages of the principal components of the median-imputed columns, centred, not scaled."""
    import numpy as np

    table = once(table, names)
    medians = order.Sorted(order.cells(table, [F.col(n) for n in names])).quantiles([0.5])
    # about the median, so that large means don't cancel; what is missing is at the median
    x = table.select(*[F.coalesce(F.col(n) - F.lit(medians.get((i, 0.5))), F.lit(0.0)).alias(n) for i, n in enumerate(names)], F.lit(1.0).alias("_one"))
    g = order.products(x, len(names) + 1, order.plain)
    n = g[-1, -1]
    c = (g[:-1, :-1] - np.outer(g[-1, :-1], g[-1, :-1]) / n) / (n - 1)
    v = np.maximum(np.linalg.eigvalsh(c)[::-1], 0.0)
    return (100 * v / v.sum()).tolist() if v.sum() > 0 else [math.nan] * len(names)


#: What readiness asks for.
CRITERIA = ["Enough windows", "Median missingness acceptable", "Feature count in range", "PC1 not dominant", "Session dominance acceptable"]


def readiness(table: DataFrame, names: list[str], kept: list[str], min_windows: int = 2000, max_median_missing: float = 0.05, min_features: int = 20, max_features: int = 200) -> DataFrame:
    """One row: figures, the five checks, whether all pass, and the failed ones. An empty matrix is not ready."""
    checks.whole(min_windows=min_windows, min_features=min_features, max_features=max_features)
    checks.share(max_median_missing=max_median_missing)
    checks.columns(table.columns, [*names, *kept])
    spark = table.sparkSession
    n = table.count()
    schema = "num_windows long, median_row_missing double, num_selected int, effective_rank int, pc1_explained_pct double, largest_session_fraction double, is_ready boolean, reasons array<string>"
    if not n or not names:
        return spark.createDataFrame([(n, None, len(kept), None, None, None, False, ["Empty feature matrix."])], schema)
    missing = row_missing(table, names).agg(F.median("row_missing")).first()[0]
    rank = pc1 = None
    if min(n, len(kept), 20) >= 2:
        ratios = pca_ratios(table, kept)
        if not math.isnan(ratios[0]):
            rank, pc1 = sum(r > 1 for r in ratios), ratios[0]
    top = session_dominance(table).agg(F.max("share")).first()[0]
    checked = {
        "Enough windows": n >= min_windows,
        "Median missingness acceptable": missing is not None and missing <= max_median_missing,
        "Feature count in range": min_features <= len(kept) <= max_features,
        "PC1 not dominant": pc1 is None or pc1 < 60,
        "Session dominance acceptable": top is None or top < 0.7,
    }
    return spark.createDataFrame([(n, missing, len(kept), rank, pc1, top, all(checked.values()), [k for k, ok in checked.items() if not ok])], schema)


def readiness_checks(one: DataFrame) -> DataFrame:
    """(criterion, pass) of the checks of ``readiness``; an empty matrix has none."""
    reasons = F.array(*[F.lit(c) for c in CRITERIA])
    return one.where("num_windows > 0 and median_row_missing is not null").select(F.explode(F.transform(reasons, lambda c: F.struct(c.alias("criterion"), (~F.array_contains("reasons", c)).alias("pass")))).alias("c")).select("c.*")
