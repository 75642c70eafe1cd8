"""Order-dependent columns that survive hot keys.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here each key is cut
into chunks (a file split, an hour of time): the window runs inside (key, chunk), one
summary row per chunk is chained over the key, and the chained value is joined back.
Tasks are then bounded by the chunk, and the only per-key sort is over chunk summaries.

``chunk`` must be a function of the row and grow with ``order``; keys must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_SECONDS = 3600


def time_chunk(ts: Column | str, seconds: int = CHUNK_SECONDS) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(col) / F.lit(seconds * 1_000_000)).cast("long")


def _position(order: Sequence[str]) -> Column:
    return F.struct(*order)


def _windows(key: Sequence[str], chunk: str, order: Sequence[str]):
    inside = W.partitionBy(*key, chunk).orderBy(*order)
    chain = W.partitionBy(*key).orderBy(chunk)
    return inside, chain


def _attach(df: DataFrame, chained: DataFrame, key: Sequence[str], chunk: str) -> DataFrame:
    """Left join of the chunk values on (key, chunk), the partitioning and order that the window already has.

    Their number grows with the rows, and Spark's estimate of them before the run may be far too small, so they are merged
    and never broadcast.
    """
    keys = [*key, chunk]
    rest = [c for c in chained.columns if c not in keys]
    renamed = chained.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], *rest)
    condition = F.lit(True)
    for i, c in enumerate(keys):
        condition = condition & (F.col(c) == F.col(f"__k{i}"))
    return df.join(renamed.hint("merge"), condition, "left").drop(*[f"__k{i}" for i in range(len(keys))])


@dataclass(frozen=True)
class Scan:
    """One column of a scan: ``kind`` is ``sum`` (running sum), ``last`` (last non-null) or ``previous`` (row before)."""

    kind: str
    value: Column
    name: str
    include_current: bool = True


def scan(df: DataFrame, key: Sequence[str], chunk: str, order: Sequence[str], specs: Sequence[Scan]) -> DataFrame:
    """Adds every column of ``specs`` in one pass over the rows and one over their chunk summaries.

    The input is read twice (rows, summaries), so put all columns of one order into one call and
    materialise between calls that feed each other when the input is costly.
    """
    inside, chain = _windows(key, chunk, order)
    place = _position(order)
    earlier = chain.rowsBetween(W.unboundedPreceding, -1)
    summary, chained, scanned = [], [], []
    values = {}
    for i, spec in enumerate(specs):
        v, end = F.col(f"__v{i}"), F.col(f"__end{i}")
        values[f"__v{i}"] = F.struct(spec.value.alias("v")) if spec.kind == "previous" else spec.value
        here = inside.rowsBetween(W.unboundedPreceding, 0 if spec.include_current else -1)
        if spec.kind == "sum":
            summary.append(F.sum(v).alias(f"__end{i}"))
            chained.append(F.sum(end).over(earlier).alias(f"__before{i}"))
            scanned.append(F.sum(v).over(here).alias(f"__in{i}"))
        elif spec.kind == "last":
            summary.append(F.max_by(v, F.when(v.isNotNull(), place)).alias(f"__end{i}"))
            chained.append(F.last(end, ignorenulls=True).over(earlier).alias(f"__before{i}"))
            scanned.append(F.last(v, ignorenulls=True).over(here).alias(f"__in{i}"))
        else:
            summary.append(F.max_by(v, place).alias(f"__end{i}"))
            chained.append(F.lag(end).over(chain).alias(f"__before{i}"))
            scanned.append(F.lag(v).over(inside).alias(f"__in{i}"))
    columns = df.columns
    prepared = df.withColumns(values)
    ends = prepared.groupBy(*key, chunk).agg(*summary).select(*key, chunk, *chained)
    joined = _attach(prepared.select(*columns, *scanned), ends, key, chunk)
    zero = F.lit(0)
    out = []
    for i, spec in enumerate(specs):
        here, before = F.col(f"__in{i}"), F.col(f"__before{i}")
        if spec.kind == "sum":
            result = F.coalesce(here, zero) + F.coalesce(before, zero)
        else:
            result = F.coalesce(here, before)
        out.append((result["v"] if spec.kind == "previous" else result).alias(spec.name))
    return joined.select(*columns, *out)


def carry_last(df: DataFrame, key: Sequence[str], chunk: str, order: Sequence[str], value: Column, name: str,
               include_current: bool = True) -> DataFrame:
    """``name`` = last non-null ``value`` up to the row (or before it, without the row)."""
    return scan(df, key, chunk, order, [Scan("last", value, name, include_current)])


def running_sum(df: DataFrame, key: Sequence[str], chunk: str, order: Sequence[str], value: Column, name: str,
                include_current: bool = True) -> DataFrame:
    """``name`` = sum of ``value`` over the rows up to this one (or before it)."""
    return scan(df, key, chunk, order, [Scan("sum", value, name, include_current)])


def previous(df: DataFrame, key: Sequence[str], chunk: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``name`` = ``value`` of the row just before this one in its key; NULL on the first row."""
    return scan(df, key, chunk, order, [Scan("previous", value, name)])


def earliest_within(samples: DataFrame, key: Sequence[str], at_ms: str, lookback_ms: int, payload: Sequence[str],
                    order: Sequence[str], name: str, chunk_ms: int = CHUNK_SECONDS * 1000) -> DataFrame:
    """``name`` = struct of ``payload`` of the first sample not older than ``lookback_ms`` before the row.

    A sliding frame would rescan itself for each row; instead each row also sends a probe to its
    lookback instant, and probes take the nearest sample at or after them in one backward scan.
    ``order`` starts with ``at_ms`` and is unique per key.
    """
    tail = [c for c in order if c != at_ms]
    columns = samples.columns
    real = samples.select(
        "*",
        (-F.col(at_ms)).alias("__t"),
        F.lit(0).alias("__probe"),
        F.struct(*payload).alias("__seen"),
    )
    probes = samples.select(
        "*",
        (F.lit(lookback_ms) - F.col(at_ms)).alias("__t"),
        F.lit(1).alias("__probe"),
        F.lit(None).cast(real.schema["__seen"].dataType).alias("__seen"),
    )
    # backward: later instants first, larger ids first, so the last one seen is the smallest at or after the probe
    both = real.unionByName(probes)
    for i, c in enumerate(tail):
        both = both.withColumn(f"__o{i}", -F.col(c))
    both = both.withColumn("__chunk", F.floor(F.col("__t") / F.lit(chunk_ms)).cast("long"))
    scanned = carry_last(both, key, "__chunk", ["__t", "__probe", *[f"__o{i}" for i in range(len(tail))]],
                         F.col("__seen"), name)
    return scanned.filter("__probe = 1").select(*columns, name)


def rank_desc(df: DataFrame, value: str, name: str = "rank", steps: int = 256, keys: Sequence[str] = ()) -> DataFrame:
    """Competition rank by ``value`` (a whole number, largest first) over the whole table, or per ``keys``; NULL for a NULL value.

    One window would sort every row of a board in one task. Equal values are first collapsed to
    one row with a count; these are ranked inside value bands (``steps`` bands for each doubling),
    and only the band totals (bounded by the value range, not by the data) are chained.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__band", _band(F.col("__value"), steps))
    bands = counts.groupBy(*keys, "__band").agg(F.sum("__n").alias("__n"))
    chain = (W.partitionBy(*keys) if keys else W).orderBy(F.desc("__band")).rowsBetween(W.unboundedPreceding, -1)
    above_band = bands.select(*keys, "__band", F.coalesce(F.sum("__n").over(chain), F.lit(0)).alias("__above"))
    inside = W.partitionBy(*keys, "__band").orderBy(F.desc("__value")).rowsBetween(W.unboundedPreceding, -1)
    ranked = counts.withColumn("__within", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(
        above_band, [*keys, "__band"]
    ).select(*keys, F.col("__value").alias(value), (F.col("__above") + F.col("__within") + 1).alias(name))
    return df.join(ranked, [*keys, value], "left").select(*df.columns, name)


def _band(value: Column, steps: int) -> Column:
    """A whole number that grows with ``value``: its leading bits and their position, so exact in integers."""
    size = F.abs(value.cast("long"))
    bits = steps.bit_length()
    return _leading(size, bits) * F.signum(value.cast("double")).cast("long")


def _leading(size: Column, bits: int) -> Column:
    shift = F.greatest(F.length(F.bin(size)) - F.lit(bits), F.lit(0))
    return shift * F.lit(2 ** (bits - 1)) + F.call_function("shiftright", size, shift)
