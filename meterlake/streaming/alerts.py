"""Stateful limit streams: alerts, forecasts and last-known-good limits, one small state per key.

Samples are ``(key, at TIMESTAMP, id LONG, percent DOUBLE[, reset_at TIMESTAMP])``. They need the RocksDB
state store (``STATE_STORE``). Rows of a key arrive unordered inside a micro-batch and are sorted by
(at, id); the trigger size bounds how many there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.limits import ALERT_LEVELS, LOOKBACK_MINUTES, RESET_DROP

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MAX_SAMPLES = 240


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(*STATE_STORE)


def _in_order(chunks: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(chunks), ignore_index=True)
    finite = rows[pd.notna(rows["percent"]) & (rows["percent"].abs() < float("inf"))]
    return finite.sort_values(["at", "id"], kind="stable")


def edge_alerts(before: float | None, now: float, levels: Sequence[float] = ALERT_LEVELS) -> list[tuple[str, int | None]]:
    """Alerts between two percents; nothing on the first one, and a reset hides thresholds."""
    if before is None:
        return []
    if before - now >= RESET_DROP or (before >= levels[0] and now < levels[0]):
        return [("reset", None)]
    return [("threshold", int(level)) for level in levels if before < level <= now]


class AlertProcessor(StatefulProcessor):
    """Keeps the last percent and the newest observation of a key; one observation counts once."""

    def __init__(self, levels: Sequence[float] = ALERT_LEVELS):
        self.levels = sorted(levels)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at_us long, id long, percent double")

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get() if self.last.exists() else None
        out = []
        for at, id_, percent in _in_order(rows)[["at", "id", "percent"]].itertuples(index=False):
            place = (int(at.value // 1000), int(id_))
            if last is not None and place <= (last[0], last[1]):
                continue  # seen before, or late
            for kind, level in edge_alerts(None if last is None else last[2], percent, self.levels):
                out.append((key[0], at, int(id_), kind, level, float(percent)))
            last = (*place, float(percent))
        if last is not None:
            self.last.update(tuple(last))
        if out:
            frame = pd.DataFrame(out, columns=["key", "at", "id", "kind", "level", "percent"])
            frame["level"] = frame["level"].astype("Int32")
            yield frame

    def close(self) -> None:
        pass


ALERT_SCHEMA = "key string, at timestamp, id long, kind string, level int, percent double"


def stream_alerts(samples: DataFrame, levels: Sequence[float] = ALERT_LEVELS) -> DataFrame:
    return samples.groupBy("key").transformWithStateInPandas(AlertProcessor(levels), ALERT_SCHEMA, "Append", "None")


class ForecastProcessor(StatefulProcessor):
    """Keeps the samples of the lookback (240 at most) of a key and projects when they reach 100."""

    def __init__(self, lookback_minutes: int = LOOKBACK_MINUTES):
        self.lookback_ms = lookback_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "at_ms array<long>, percent array<double>")

    def handleInputRows(self, key, rows, timerValues):
        state = self.recent.get() if self.recent.exists() else None
        samples = list(zip(state[0], state[1])) if state else []
        out = []
        for at, id_, percent in _in_order(rows)[["at", "id", "percent"]].itertuples(index=False):
            at_ms = int(at.value // 1_000_000)
            if samples and at_ms < samples[-1][0]:
                continue  # late
            samples = [s for s in samples if at_ms - s[0] <= self.lookback_ms][-(MAX_SAMPLES - 1):] + [(at_ms, float(percent))]
            out.append((key[0], at, int(id_), float(percent), project(samples)))
        if samples:
            self.recent.update(([s[0] for s in samples], [s[1] for s in samples]))
        if out:
            frame = pd.DataFrame(out, columns=["key", "at", "id", "percent", "hit_ms"])
            frame["hit_ms"] = frame["hit_ms"].astype("Int64")
            yield frame

    def close(self) -> None:
        pass


def project(samples: Sequence[tuple[int, float]]) -> int | None:
    """Epoch milliseconds at which the line from the first to the last sample reaches 100, or None."""
    if len(samples) < 2:
        return None
    (t0, p0), (t1, p1) = samples[0], samples[-1]
    if p1 >= 100:
        return t1
    if t1 <= t0 or p1 <= p0:
        return None
    return math.floor(t1 + (100.0 - p1) / ((p1 - p0) / float(t1 - t0)) + 0.5)


FORECAST_SCHEMA = "key string, at timestamp, id long, percent double, hit_ms long"


def stream_forecast(samples: DataFrame, lookback_minutes: int = LOOKBACK_MINUTES) -> DataFrame:
    return samples.groupBy("key").transformWithStateInPandas(ForecastProcessor(lookback_minutes), FORECAST_SCHEMA, "Append", "None")


class KnownLimitProcessor(StatefulProcessor):
    """Emits each present sample; at its reset a timer emits 0, also when no newer sample came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "at_us long, percent double, reset_ms long")

    def handleInputRows(self, key, rows, timerValues):
        last = self.known.get() if self.known.exists() else None
        out = []
        now_ms = timerValues.getCurrentProcessingTimeInMs()
        for at, percent, reset in _in_order(rows)[["at", "percent", "reset_at"]].itertuples(index=False):
            at_us = int(at.value // 1000)
            if last is not None and at_us < last[0]:
                continue
            reset_ms = -1 if pd.isna(reset) else int(reset.value // 1_000_000)
            expired = 0 <= reset_ms <= now_ms
            if expired:
                percent, reset_ms = 0.0, -1
            last = (at_us, float(percent), reset_ms)
            out.append((key[0], at, float(percent), pd.NaT if reset_ms < 0 else reset))
        if last is not None:
            self.known.update(tuple(last))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if last[2] >= 0:
                self.handle.registerTimer(last[2])
        if out:
            frame = pd.DataFrame(out, columns=["key", "at", "percent", "reset_at"])
            frame["reset_at"] = pd.to_datetime(frame["reset_at"])
            yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at_us, _, _ = self.known.get()
        self.known.update((at_us, 0.0, -1))
        at = pd.to_datetime(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame({"key": [key[0]], "at": [at], "percent": [0.0], "reset_at": pd.to_datetime([None])})

    def close(self) -> None:
        pass


LIMIT_SCHEMA = "key string, at timestamp, percent double, reset_at timestamp"


def stream_limits(samples: DataFrame) -> DataFrame:
    return samples.groupBy("key").transformWithStateInPandas(KnownLimitProcessor(), LIMIT_SCHEMA, "Append", "ProcessingTime")
