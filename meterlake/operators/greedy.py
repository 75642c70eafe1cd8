"""Greedy windows: burst coalescing and throttling.

Where a window opens depends on where the one before it closed, so a frame cannot express them and a
whole key must not sit in one task. Rows are first folded to one per millisecond, and each key is cut into
time chunks of at most ``CHUNK_ROWS`` of them. A first pass works out, for the few ways a chunk can be entered, how it
is left. Bursts then compose these summaries in a tree, ``FAN`` neighbours at a time, until a key has few, and pass
the entries down again; a throttle walks the chunks of a key. A last pass settles each chunk from its known entry.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialize

CHUNK_WINDOWS = 32
#: Rows of a chunk, one a millisecond; a throttle's chunk holds two intervals at least.
CHUNK_ROWS = 100_000
#: Summaries that are composed in one task.
FAN = 64
NEVER = -(2**62)


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _schema(df: DataFrame, keys: Sequence[str], extra: str) -> T.StructType:
    return T.StructType([*_key_fields(df, keys), *T.StructType.fromDDL(extra).fields])


def _repeat(pdf: pd.DataFrame, keys: Sequence[str], n: int | None = None) -> dict[str, list]:
    """The group's key columns for ``n`` result rows."""
    return {k: [pdf[k].iat[0]] * (len(pdf) if n is None else n) for k in keys}


def burst_jumps(t: np.ndarray, delay: int) -> np.ndarray:
    """For each event, the first one at or after its window's end."""
    return np.searchsorted(t, t + delay, side="left")


def burst_exits(t: np.ndarray, delay: int) -> np.ndarray:
    """For each event that opens a window, when the last window opened in the chunk closes."""
    jump, n = burst_jumps(t, delay), len(t)
    out = t + delay
    for i in range(n - 1, -1, -1):
        if jump[i] < n:
            out[i] = out[jump[i]]
    return out


def through(pieces: Sequence[tuple[np.ndarray, np.ndarray]], entry: np.ndarray) -> np.ndarray:
    """When the last window closes behind neighbouring chunks, for entries before which all is taken.

    A piece (``upto``, ``leaves``) says how a chunk is left if its first event not taken is one up to ``upto``.
    """
    for upto, leaves in pieces:
        place = np.searchsorted(upto, entry, side="left")
        entry = np.where(place < len(upto), np.append(leaves, NEVER)[place], entry)
    return entry


def composed(pieces: Sequence[tuple[np.ndarray, np.ndarray]], latest: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring chunks as one, for entries up to ``latest``."""
    upto = np.concatenate([u for u, _ in pieces])
    upto = upto[: int(np.searchsorted(upto, latest, side="right")) + 1]
    leaves = through(pieces, upto)
    keep = np.append(leaves[1:] != leaves[:-1], True)
    return upto[keep], leaves[keep]


def coalesce_bursts(events: DataFrame, delay_ms: int, keys: Sequence[str] = ("handle",), at: str = "at_ms",
                    chunk_rows: int = CHUNK_ROWS, fan: int = FAN) -> DataFrame:
    """Bursts of events: a window opens at the first event and takes every event before its end.

    Result: (keys, opened_ms, events). The delay counts from the first event and is never extended.
    """
    keys = list(keys)
    width = min(delay_ms * CHUNK_WINDOWS, chunk_rows)
    moments = events.groupBy(*keys, F.col(at).alias("t")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "chunk", F.floor(F.col("t") / width).cast("long"))
    summary = _schema(moments, keys, "node long, upto array<long>, leaves array<long>")

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy())
        exits = burst_exits(t, delay_ms)
        # a window from before the chunk ends within one delay of its start
        last = int(np.searchsorted(t, pdf["chunk"].iat[0] * width + delay_ms, side="right"))
        t, exits = t[: last + 1], exits[: last + 1]
        keep = np.append(exits[1:] != exits[:-1], True)
        return pd.DataFrame({**_repeat(pdf, keys, 1), "node": [pdf["chunk"].iat[0]], "upto": [t[keep].tolist()], "leaves": [exits[keep].tolist()]})

    def pieces(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.asarray(u), np.asarray(v)) for u, v in zip(pdf["upto"], pdf["leaves"])]

    def compose(size: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node")
            node = int(pdf["node"].iat[0]) // fan
            upto, leaves = composed(pieces(pdf), node * size + delay_ms)
            return pd.DataFrame({**_repeat(pdf, keys, 1), "node": [node], "upto": [upto.tolist()], "leaves": [leaves.tolist()]})
        return run

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        """The entries of neighbours, the first of which is entered with ``entry``."""
        pdf = pdf.sort_values("node")
        entry, entries = np.array([pdf["entry"].iat[0]]), []
        for piece in pieces(pdf):
            entries.append(int(entry[0]))
            entry = through([piece], entry)
        return pd.DataFrame({**_repeat(pdf, keys), "node": pdf["node"].tolist(), "entry": entries})

    above = lambda column: F.floor(F.col(column) / fan).cast("long")
    levels, size = [materialize(moments.groupBy(*keys, "chunk").applyInPandas(leave, summary), "bursts")], width
    while levels[-1].groupBy(*keys).count().filter(F.col("count") > fan).limit(1).count():
        size *= fan
        levels.append(materialize(levels[-1].groupBy(*keys, above("node").alias("__above")).applyInPandas(compose(size), summary), "bursts"))
    entry = _schema(moments, keys, "node long, entry long")
    entered = levels[-1].withColumn("entry", F.lit(NEVER)).groupBy(*keys).applyInPandas(enter, entry)
    for level in levels[-2::-1]:
        parents = entered.withColumnRenamed("node", "__above")
        entered = level.withColumn("__above", above("node")).join(parents, [*keys, "__above"]).groupBy(*keys, "__above").applyInPandas(enter, entry)
    entered = entered.withColumnRenamed("node", "chunk")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, n, entry = pdf["t"].to_numpy(), pdf["n"].to_numpy(), int(pdf["entry"].iat[0])
        jump = burst_jumps(t, delay_ms)
        place = int(np.searchsorted(t, entry, side="left"))
        opened, counts = [], []
        if place > 0:
            opened.append(entry - delay_ms)
            counts.append(int(n[:place].sum()))
        while place < len(t):
            opened.append(int(t[place]))
            counts.append(int(n[place : jump[place]].sum()))
            place = int(jump[place])
        return pd.DataFrame({**_repeat(pdf, keys, len(opened)), "opened_ms": opened, "events": counts})

    placed = moments.join(entered, [*keys, "chunk"])
    parts = placed.groupBy(*keys, "chunk").applyInPandas(settle, _schema(moments, keys, "opened_ms long, events long"))
    return parts.groupBy(*keys, "opened_ms").agg(F.sum("events").alias("events"))


def differing(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place (and the end) the first place from there with a positive value, and the first after that with another one."""
    n = len(v)
    places = np.flatnonzero(v > 0)
    starts = np.append(np.flatnonzero(np.append(True, np.diff(v[places]) != 0)), len(places)) if len(places) else np.array([0])
    run = np.searchsorted(starts, np.arange(len(places)), side="right")
    other = np.full(n + 1, n)
    other[places] = np.append(places, n)[starts[run]] if len(places) else places
    positive = np.append(places, n)[np.searchsorted(places, np.arange(n + 1))]
    return positive, other


def throttle_flights(t: np.ndarray, v: np.ndarray, at: np.ndarray, value: np.ndarray, interval: int, end: int) -> tuple[np.ndarray, ...]:
    """Follows emissions made at ``at`` of ``value`` while each next one comes exactly one interval later.

    Result: the moment at which the next emission is made instead (-1: none), and the due time and last value when
    the flight ends. The due time is ``NEVER`` if it passed within the chunk with nothing to send.
    """
    positive, other = differing(v)
    due, value, landed, flying = at + interval, value.copy(), np.full(len(at), -1), np.ones(len(at), bool)
    while True:
        i = np.flatnonzero(flying & (due < end))
        if not len(i):
            return landed, due, value
        after = np.searchsorted(t, due[i], side="right")
        pending = v[after - 1]
        sends = (pending > 0) & (pending != value[i])
        on, off, after = i[sends], i[~sends], after[~sends]
        value[on], due[on] = pending[sends], due[on] + interval
        j = positive[after]
        j = np.where((j < len(t)) & (np.append(v, 0)[j] == value[off]), other[j], j)
        landed[off], due[off], flying[off] = np.where(j < len(t), j, -1), NEVER, False


def throttle_run(t: np.ndarray, v: np.ndarray, due: int, synced: int, carry: int, interval: int, end: float) -> tuple[list[int], list[int]]:
    """Emissions before ``end``, one after the other, of a chunk that is entered with these values."""
    at, out = [], []
    while due < end:
        place = int(np.searchsorted(t, due, side="right"))
        value, moment = int(v[place - 1]) if place else carry, due
        if value <= 0 or value == synced:
            while place < len(t) and (v[place] <= 0 or v[place] == synced):
                place += 1
            if place == len(t):
                break
            moment, value = int(t[place]), int(v[place])
        at.append(moment)
        out.append(value)
        synced, due = value, moment + interval
    return at, out


def throttle_summary(t: np.ndarray, v: np.ndarray, interval: int, end: int) -> dict[str, list]:
    """How a chunk is left, for each way to enter it.

    ``at, value, due, synced``: moments at which the first emission may be made, and the exit then. ``since, leap, to``: the
    first emission may also fall due between moments; from ``since`` on it leaves the chunk ``leap`` intervals later or, where
    ``leap`` is 0, as ``due, synced`` number ``to``. ``late_at, late``: the values of the chunk's last interval.
    """
    landed, due, synced = throttle_flights(t, v, t, v, interval, end)
    for i in range(len(t) - 1, -1, -1):
        if landed[i] >= 0:
            due[i], synced[i] = due[landed[i]], synced[landed[i]]
    # first emissions at any instant of the first interval: outcomes change only where a later value does, or at the end
    since = np.unique(t[0] + (np.append(t, end) - t[0]) % interval)
    where, out_due, out_synced = throttle_flights(t, v, since, v[np.searchsorted(t, since, side="right") - 1], interval, end)
    leap = np.where(out_due == NEVER, 0, (out_due - since) // interval)
    fixed = leap == 0
    out_due, out_synced = (np.where(where >= 0, x[where], y) for x, y in ((due, out_due), (synced, out_synced)))
    exits, to = np.unique(np.stack([out_due[fixed], out_synced[fixed]]), axis=1, return_inverse=True)
    number = np.zeros(len(since), np.int64)
    number[fixed] = to.ravel()
    keep = np.append(True, (leap[1:] != leap[:-1]) | (number[1:] != number[:-1]))
    # moments of the first interval, and of those beyond the first positive one and the next with another value
    early = int(np.searchsorted(t, t[0] + interval, side="right"))
    positive, other = differing(v)
    beyond = [int(j) for j in (positive[early], other[positive[early]]) if j < len(t)]
    entry = [*range(early), *beyond]
    late = max(int(np.searchsorted(t, end - interval, side="right")) - 1, 0)
    return {"at": t[entry].tolist(), "value": v[entry].tolist(), "due": due[entry].tolist() + exits[0].tolist(), "synced": synced[entry].tolist() + exits[1].tolist(),
            "since": since[keep].tolist(), "leap": leap[keep].tolist(), "to": (number[keep] + len(entry)).tolist(),
            "late_at": t[late:].tolist(), "late": v[late:].tolist()}


def throttle_exit(chunk: dict[str, np.ndarray], due: int, synced: int, carry: int, interval: int, end: int) -> tuple[int, int]:
    """The due time and last value with which a chunk is left, from those with which it is entered."""
    at, value = chunk["at"], chunk["value"]
    if due < at[0] and carry > 0 and carry != synced:
        due, synced = due + interval, carry
    if due >= end:
        return due, synced
    place = int(np.searchsorted(at, due, side="right"))
    if place and value[place - 1] > 0 and value[place - 1] != synced:
        piece = int(np.searchsorted(chunk["since"], due, side="right")) - 1
        if chunk["leap"][piece]:
            due += int(chunk["leap"][piece]) * interval
            return due, int(chunk["late"][np.searchsorted(chunk["late_at"], due - interval, side="right") - 1])
        place = int(chunk["to"][piece])
    else:
        while place < len(at) and (value[place] <= 0 or value[place] == synced):
            place += 1
        if place == len(at):
            return due, synced
    return int(chunk["due"][place]), int(chunk["synced"][place])


def throttle(observations: DataFrame, interval_ms: int, keys: Sequence[str] = ("handle",), until_ms: int | None = None) -> DataFrame:
    """At most one emission per interval, of the newest value, never the value emitted before.

    ``observations(keys, at_ms, id, tokens)``; of one instant the largest id is the newest. The first value goes out at
    once. What comes within an interval waits for its end, when the newest value goes out, also after the last
    observation (up to ``until_ms``). A value of zero or less empties the wait; NULL is no observation.
    Result: (keys, at_ms, tokens).
    """
    keys = list(keys)
    width = interval_ms * max(2, min(CHUNK_WINDOWS, CHUNK_ROWS // interval_ms))
    moments = observations.filter("tokens IS NOT NULL").groupBy(*keys, F.col("at_ms").alias("t")).agg(
        F.greatest(F.max_by("tokens", "id"), F.lit(0)).cast("long").alias("v")).withColumn("chunk", F.floor(F.col("t") / width).cast("long"))
    parts = ("at", "value", "due", "synced", "since", "leap", "to", "late_at", "late")

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        chunk = int(pdf["chunk"].iat[0])
        made = throttle_summary(pdf["t"].to_numpy(), pdf["v"].to_numpy(), interval_ms, (chunk + 1) * width)
        return pd.DataFrame({**_repeat(pdf, keys, 1), "chunk": [chunk], "carry": [int(pdf["v"].iat[-1])], **{c: [made[c]] for c in parts}})

    borders = moments.groupBy(*keys, "chunk").applyInPandas(
        leave, _schema(moments, keys, "chunk long, carry long, " + ", ".join(f"{c} array<long>" for c in parts)))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        state, entries = (NEVER, 0, 0), []
        for row in pdf[["chunk", "carry", *parts]].to_dict("records"):
            entries.append(state)
            state = (*throttle_exit(row, *state, interval_ms, (row["chunk"] + 1) * width), row["carry"])
        due, synced, carry = zip(*entries)
        final = [False] * (len(entries) - 1) + [True]
        return pd.DataFrame({**_repeat(pdf, keys), "chunk": pdf["chunk"].tolist(), "due": due, "synced": synced, "carry": carry, "final": final})

    entered = borders.groupBy(*keys).applyInPandas(walk, _schema(moments, keys, "chunk long, due long, synced long, carry long, final boolean"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        end = float("inf") if pdf["final"].iat[0] else (int(pdf["chunk"].iat[0]) + 1) * width
        at, out = throttle_run(pdf["t"].to_numpy(), pdf["v"].to_numpy(), *(int(pdf[c].iat[0]) for c in ("due", "synced", "carry")), interval_ms, end)
        if not at:
            return pd.DataFrame()
        return pd.DataFrame({**_repeat(pdf, keys, len(at)), "at_ms": at, "tokens": out})

    placed = moments.join(entered, [*keys, "chunk"])
    sent = placed.groupBy(*keys, "chunk").applyInPandas(settle, _schema(moments, keys, "at_ms long, tokens long"))
    return sent if until_ms is None else sent.filter(F.col("at_ms") <= until_ms)
