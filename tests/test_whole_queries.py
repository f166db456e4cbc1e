"""Registered queries on small tables of more sessions or columns than their SQL covers."""

import numpy as np
import pytest

from twintrack import queries

SESSIONS, FRAMES = 4, 250


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Embeddings that give four sessions."""
    path = str(tmp_path_factory.mktemp("sessions"))
    vectors = np.clip(np.random.default_rng(5).normal(0, 0.12, (SESSIONS * FRAMES, 64)), -0.29, 0.29)
    rows = [(k, v) for k, v in enumerate(vectors.tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_feature_matrix_has_every_session(spark, sf_dir):
    got = queries.QUERIES["feature_matrix"](spark, sf_dir).toPandas()
    scales = got.groupby("session_idx").window_sec.unique().map(sorted).to_dict()
    assert scales == {1: [0.2, 0.5, 1.0, 2.0], 2: [0.2, 0.5], 3: [0.2, 0.5, 1.0, 2.0], 4: [0.2, 0.5]}
    whole = queries.QUERIES["win_multiscale_wide"](spark, sf_dir).toPandas()
    want = whole[(whole.session_idx % 2 == 1) | (whole.window_sec <= 0.5)]
    key = ["session_idx", "window_sec", "center_frame"]
    got, want = (d.sort_values(key).reset_index(drop=True) for d in (got, want))
    assert got.equals(want[got.columns])


@pytest.fixture(scope="module")
def ranks(spark, sf_dir):
    """Rank correlations of all summary columns of the same table by pandas, and their names."""
    t, names = queries._table(queries.pose(spark, sf_dir))
    return t.select(*names).toPandas().astype(float), names


def test_rank_correlations_of_all_pairs(spark, sf_dir, ranks):
    d, names = ranks
    got = {(r.a, r.b): r.rho for r in queries.QUERIES["corr_spearman"](spark, sf_dir).collect()}
    assert len(names) == 12 and set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :]}
    for (a, b), rho in got.items():
        both = d[[a, b]].dropna().rank()
        assert rho == pytest.approx(both[a].corr(both[b]), abs=2e-6)


def test_report_has_all_features(spark, sf_dir, ranks):
    d, names = ranks
    got = {r.feature: r for r in queries.QUERIES["feature_report"](spark, sf_dir).collect()}
    assert set(got) == set(names)
    for a in names:
        pairs = [d[[a, b]].dropna().rank() for b in names if b != a]
        assert got[a].max_abs_corr == pytest.approx(max(abs(p[a].corr(p.iloc[:, 1])) for p in pairs), abs=2e-6)
        assert got[a].valid_n == d[a].count() and got[a]["median"] == pytest.approx(d[a].median(), abs=2e-6)
