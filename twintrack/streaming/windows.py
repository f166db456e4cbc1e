"""Sliding window means of a feature as frames arrive, for Structured Streaming. An addition: batches give the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.windows import frames_of

OUT = "session_idx int, center_frame int, window_sec double, n_values long, mean double"


def sliding_means(frames: DataFrame, feature: str, seconds: float, fps: float = 80.0) -> DataFrame:
    """A row for each complete window, in append mode, once its last frame has come.

    ``frames(session_idx, frame, <feature>)``: a session's frames count up from its first one. The state of a session is the values of
    one window, however long the session gets. A frame that is not after the last one of its session (late or repeated) is left
    out; a missing frame counts as a missing value, so that windows keep their length.
    """
    size, before, _ = frames_of(seconds, fps)

    def step(key, batches, state):
        last, held = state.get if state.exists else (None, [])
        held = list(held)
        new = pd.concat(list(batches), ignore_index=True).sort_values("frame", kind="stable")
        rows = []
        for frame, value in zip(new["frame"].tolist(), new["v"].tolist()):
            if last is not None and frame <= last:
                continue
            for at in range(frame if last is None else last + 1, frame + 1):
                held.append(float(value) if at == frame and value is not None else float("nan"))
                held = held[-size:]
                if len(held) == size:
                    there = [v for v in held if v == v]
                    rows.append((key[0], at - size + 1 + before, seconds, len(there), sum(there) / len(there) if there else None))
            last = frame
        state.update((last, held))
        yield pd.DataFrame(rows, columns=["session_idx", "center_frame", "window_sec", "n_values", "mean"])

    values = frames.selectExpr("session_idx", "frame", f"cast(`{feature}` as double) v")
    return values.groupBy("session_idx").applyInPandasWithState(step, OUT, "last int, held array<double>", "append", GroupStateTimeout.NoTimeout)
