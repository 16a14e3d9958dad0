"""Streaming forms of event operators: binning with a watermark, sessions of events, TTL pulses with keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bin_events(stream: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts per key and tumbling window; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "n")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Events less than ``gap`` apart as one segment per key."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def pulses(stream: DataFrame, key: str, time: str, on: str, late: str = "0 seconds") -> DataFrame:
    """Rising edge to next falling edge per key, as timestamps: key, start, stop.

    Edges wait until the watermark (``late`` behind the newest time) has passed them and are then taken in order of time, so late rows
    within it come right; later ones are left out. The state is the edges that wait and the open pulse.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, times, flags = state.get if state.exists else (None, [], [])
        passed = state.getCurrentWatermarkMs() * 1000
        waiting = list(zip(times or [], flags or []))
        for pdf in batches:
            us = pdf[time].astype("datetime64[us]").astype("int64")
            waiting += [(int(t), bool(f)) for t, f in zip(us, pdf[on]) if t > passed]
        waiting.sort()
        out: list[tuple[Any, ...]] = []
        while waiting and waiting[0][0] <= passed:
            t, is_on = waiting.pop(0)
            if is_on and start is None:
                start = t
            elif not is_on and start is not None:
                out.append((k[0], start, t))
                start = None
        if waiting or start is not None:
            state.update((start, [t for t, _ in waiting], [f for _, f in waiting]))
            if waiting:
                state.setTimeoutTimestamp(max(waiting[0][0] // 1000, passed // 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "start", "stop"])

    rows = stream.withWatermark(time, late).filter(F.col(on).isNotNull()).select(key, time, on).groupBy(key)
    out = rows.applyInPandasWithState(step, f"key {dict(stream.dtypes)[key]}, start long, stop long", "start long, times array<long>, flags array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("key", F.timestamp_micros("start").alias("start"), F.timestamp_micros("stop").alias("stop"))
