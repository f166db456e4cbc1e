"""Streamed windows against the batch ones."""

import math

import numpy as np
import pytest

from twintrack.operators import windows
from twintrack.streaming.windows import sliding_means


def test_streamed_means_are_the_batch_ones(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(s, k + 1, k / 80, True, None if r.random() < 0.2 else float(r.normal())) for s in (1, 2) for k in range(90)]
    schema = "session_idx int, frame int, time_s double, frame_ok boolean, centroid_dist double"
    whole = spark.createDataFrame(rows, schema)
    for part, (lo, hi) in enumerate(((1, 30), (31, 33), (25, 90))):  # the last part repeats frames that came before
        whole.where(f"frame between {lo} and {hi}").coalesce(1).write.parquet(f"{tmp_path}/in/p{part}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = sliding_means(stream, "centroid_dist", 0.2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(x.session_idx, x.center_frame): x.mean for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = windows.summarize_scale(whole, 0.2, names=["centroid_dist"], stats={"numeric": ["mean"]}, full=False, plain=True)
    want = {(x.session_idx, x.center_frame): x["centroid_dist__mean"] for x in batch.collect()}
    assert got.keys() == want.keys() and len(want) == 150
    assert all((got[k] is None or math.isnan(got[k])) if want[k] is None else got[k] == pytest.approx(want[k]) for k in want)
