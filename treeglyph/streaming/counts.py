"""Window codes of a stream: values arrive in order per series; each new value closes one window of every length.

State per series is its last ``longest - 1`` values; a value with a time before the watermark or not later than the series' last one is late and dropped.
With ``idle``, a series that has had no value for so long, by the watermark, is forgotten, and begins anew with its next value; without, state stays.
Counts over event time are then ordinary windowed aggregations with the watermark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.kernels import Windows
from ..operators.counts import lengths_of

COLUMNS = ["series_id", "ts", "length", "code"]


def closed_windows(stream: DataFrame, lengths: Iterable[int], ties: str = "strict", delay: str = "1 hour", idle: str | None = None) -> DataFrame:
    """From series_id long, ts timestamp and value double: series_id, ts (of the last value), length, code of each window that a value closes."""
    sizes = lengths_of(lengths)
    keep = sizes[-1] - 1
    patience = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=COLUMNS)
            return
        times, values = (list(map(list, state.get)) if state.exists else ([], []))
        old = len(times)
        stamps: list[pd.Timestamp | None] = [None] * old
        new = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for ts, value in zip(new["ts"], new["value"] + 0.0, strict=True):
            if times and ts.value <= times[-1]:
                continue
            times.append(ts.value)
            values.append(float(value))
            stamps.append(ts)
        n = np.array([len(values)])
        w = Windows(ties, np.array([0, len(values)]), np.array(values, np.float64), np.zeros(1, np.int64), n, n)
        out = []
        for m in sizes:
            start = np.arange(max(0, old - m + 1), len(values) - m + 1)
            start = start[w.room[start] >= m]
            out += [(key[0], stamps[a + m - 1], m, code) for a, code in zip(start.tolist(), w.texts(start, m), strict=True)]
        state.update((times[-keep:], values[-keep:]))
        if patience and times:
            state.setTimeoutTimestamp(max(times[-1] // 1_000_000, state.getCurrentWatermarkMs()) + patience)
        yield pd.DataFrame(out, columns=COLUMNS)

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return stream.withWatermark("ts", delay).groupBy("series_id").applyInPandasWithState(step, "series_id long, ts timestamp, length int, code string", "times array<long>, vals array<double>", "append", timeout)


def counts_by_time(closed: DataFrame, width: str = "1 day") -> DataFrame:
    """Support of each code by tumbling windows of event time."""
    return closed.groupBy(F.window("ts", width).alias("period"), "length", "code").agg(F.count("*").alias("support"))
