"""Order statistics, ranks and products of columns against numpy and pandas: ties, missing values, constant and empty columns, many partitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twintrack.operators import order, select


def table(seed, n):
    r = np.random.default_rng(seed)
    t = pd.DataFrame({"a": r.normal(size=n), "b": r.integers(0, 4, n).astype(float), "c": (r.random(n) < 0.97).astype(float), "d": r.normal(size=n) * 1e9, "e": np.full(n, 7.5), "f": np.full(n, np.nan), "g": np.where(r.random(n) < 0.5, 0.0, -0.0)})
    t.loc[r.random(n) < 0.3, "b"] = np.nan
    t.loc[t.b.isna(), "d"] = np.nan
    t.loc[r.random(n) < 0.2, "a"] = np.nan
    t["h"] = t.a + r.normal(size=n) / 9
    return t


def spark_table(spark, t):
    rows = [tuple(None if v != v else float(v) for v in r) for r in t.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in t.columns)).repartition(5)


def hazen(x, p):
    x = np.sort(x)
    h = min(max(len(x) * p + 0.5, 1.0), float(len(x)))
    return x[int(np.floor(h)) - 1] + (h - np.floor(h)) * (x[int(np.ceil(h)) - 1] - x[int(np.floor(h)) - 1])


@pytest.mark.parametrize("n", [1, 2, 17, 400])
def test_quantiles_and_statistics(spark, n):
    t = table(n, n)
    got = order.Sorted(order.cells(spark_table(spark, t), [F.col(c) for c in t])).quantiles([0.0, 0.25, 0.5, 0.9, 1.0])
    for i, c in enumerate(t):
        x = t[c].dropna().to_numpy()
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert ((i, p) in got) == bool(len(x))
            if len(x):
                assert got[i, p] == pytest.approx(hazen(x, p), rel=1e-12)
    stats = {r.feature: r for r in select.feature_stats(spark_table(spark, t), list(t)).collect()}
    for c in t:
        x = t[c].dropna().to_numpy()
        assert stats[c].valid_n == len(x) and stats[c].missing_frac == pytest.approx(1 - len(x) / n)
        if len(x):
            assert stats[c].mad == pytest.approx(np.median(np.abs(x - np.median(x))), rel=1e-12, abs=1e-12)
            assert stats[c].iqr == pytest.approx(hazen(x, 0.75) - hazen(x, 0.25), rel=1e-12, abs=1e-12)
        else:
            assert stats[c].median is None and stats[c].mad is None and stats[c].iqr is None and stats[c].std is None


def test_places_in_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(3000).select((F.col("id") % 3).cast("int").alias("pos"), ((F.col("id") * 7919) % 1009 / 4).alias("value"))
        kept = order.Sorted(rows)
        want = {p: sorted(((k * 7919) % 1009 / 4) for k in range(3000) if k % 3 == p) for p in range(3)}
        assert len({part for part, _ in kept.offsets}) > 1 and kept.counts == {p: 1000 for p in range(3)}
        got = kept.at({p: list(range(0, 1000, 37)) + [999, 1000, -1] for p in range(3)})
        assert got == {(p, k): want[p][k] for p in range(3) for k in [*range(0, 1000, 37), 999]}
        assert order.Sorted(rows.limit(0)).at({0: [0]}) == {}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("n", "most"), [(2, 400), (60, 400), (60, 3), (300, 400)])
def test_rank_correlations_are_those_of_pandas(spark, monkeypatch, n, most):
    monkeypatch.setattr(order, "MOST", most)
    t = table(n + 5, n)
    names = list(t)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    got = {(r.a, r.b): r for r in select.corr_spearman(spark_table(spark, t), pairs).collect()}
    assert set(got) == set(pairs)
    for a, b in pairs:
        both = t[[a, b]].dropna() + 0.0
        assert got[a, b].n == len(both)
        ranks = both.rank()
        sd = ranks.std(ddof=0)
        if len(both) > 1 and sd.min() > 0:
            assert got[a, b].rho == pytest.approx(ranks[a].corr(ranks[b]), abs=1e-9)
        else:
            assert got[a, b].rho is None
    assert select.corr_spearman(spark_table(spark, t), []).collect() == []


def test_products_and_principal_components(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 40)) @ r.normal(size=(40, 40)) + 1e6
    t = pd.DataFrame(x, columns=[f"c{i}" for i in range(40)])
    df = spark_table(spark, t)
    np.testing.assert_allclose(order.products(df, 40, order.plain), x.T @ x, rtol=1e-12)
    v = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    np.testing.assert_allclose(select.pca_ratios(df, list(t)), 100 * v / v.sum(), rtol=1e-6, atol=1e-9)


def test_hot_values_are_one_row(spark):
    """A value that fills a column is counted before anything is sorted."""
    df = spark.range(20_000).select(F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).otherwise(0.0).alias("x"))
    kept = order.Sorted(order.cells(df, [F.col("x")]))
    assert kept.rows.count() == 20 and kept.counts[0] == 20_000
    assert kept.quantiles([0.5]) == {(0, 0.5): 0.0}
