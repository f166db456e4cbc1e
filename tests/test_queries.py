"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from twintrack import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
#: A few of each kind; the driver compares all of them.
SOME = ["pose_long", "conf_thresholds", "find_runs", "jump_candidates", "gap_fill_linear", "geometry_blame", "arena_mask", "clean_native", "bad_frames", "qc_flags", "feat_orientation", "feat_kinematics", "win_numeric", "win_slope", "win_boolean", "win_circular", "feature_stats", "corr_spearman", "supplier_windows"]


def plain(d: pd.DataFrame) -> list:
    d = d[sorted(d.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in d.itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_entry_imports_and_names_agree():
    import __spark_entry__ as entry

    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) <= set(entry.queries())
    assert registry.FLAGSHIP in registry.QUERIES
