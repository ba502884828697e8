"""Time windows over an event stream; each works on batch and streaming DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _late(df: DataFrame, time: str, delay: str | None) -> DataFrame:
    return df.withWatermark(time, delay) if delay and df.isStreaming else df


def tumbling(df: DataFrame, time: str, length: str, keys: Iterable[str], aggs: Iterable[Column], slide: str | None = None, delay: str | None = "10 minutes") -> DataFrame:
    """Fixed windows, overlapping if ``slide`` is shorter than ``length``."""
    w = F.window(F.col(time), length, slide) if slide else F.window(F.col(time), length)
    out = _late(df, time, delay).groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(c for c in out.columns if c != "w"))


def sessions(df: DataFrame, time: str, gap: str, keys: Iterable[str], aggs: Iterable[Column], delay: str | None = "10 minutes") -> DataFrame:
    out = _late(df, time, delay).groupBy(F.session_window(F.col(time), gap).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *(c for c in out.columns if c != "w"))


def running_totals(df: DataFrame, key: str, value: str, timeout: str = "1 hour") -> DataFrame:
    """(key, n, total) after each batch that brings rows of a key; forgotten after ``timeout``."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[value].sum())
        state.update((n, total))
        state.setTimeoutDuration(_milliseconds(timeout))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    out = f"{key} {df.schema[key].dataType.simpleString()}, n long, total double"
    return df.groupBy(key).applyInPandasWithState(update, out, "n long, total double", "update", GroupStateTimeout.ProcessingTimeTimeout)


def _milliseconds(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)
