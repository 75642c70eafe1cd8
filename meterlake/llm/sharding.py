"""Sharding by a minimax contiguous partition.

Equal texts form a group; groups are ordered by a hash of the text and those of one hash cell are atomic. The smallest
capacity for which a greedy walk over the cells needs no more than the wanted shards is found by binary search. A cell
that alone sets the capacity gets a shard for itself and the search goes on over the stretches beside it; else the cells
are cut within the capacity as near equal parts as they allow. Law ``bytes``: shard sizes are as near equal as whole,
contiguous groups allow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.session import materialize

from .common import packed

SHARDS = 40
#: Cells of the text hash. Their sizes are all that the driver sees: two numbers a cell, whatever the input.
CELLS = 1 << 18
ROW_BYTES = 16
#: Rows of a shard that are numbered together.
BLOCK = 8192


def cuts_for(capacity: int, ends: np.ndarray, shards: int) -> list[int] | None:
    """First cells of the shards after the first, filling each greedily up to ``capacity``; None if they do not suffice."""
    cuts, start, base = [], 0, 0
    while True:
        stop = int(np.searchsorted(ends, base + capacity, "right"))
        if stop == len(ends):
            return cuts
        if stop == start or len(cuts) == shards - 1:
            return None
        cuts.append(stop)
        start, base = stop, int(ends[stop - 1])


def least_capacity(parts: list[np.ndarray], shards: int) -> tuple[int, list[int]]:
    """The least capacity at which ``shards`` hold all parts, none of which shares a shard with another, and what each needs."""
    ends = [np.cumsum(p) for p in parts]

    def needs(capacity: int) -> list[int] | None:
        found = [cuts_for(capacity, e, shards) for e in ends]
        return None if any(c is None for c in found) or sum(map(len, found)) + len(found) > shards else [len(c) + 1 for c in found]

    total = sum(int(e[-1]) for e in ends)
    low, high = max(-(-total // shards), *(int(p.max()) for p in parts)), total
    while low < high:
        middle = (low + high) // 2
        if needs(middle) is None:
            low = middle + 1
        else:
            high = middle
    return low, needs(low)


def even_cuts(sizes: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Cuts into ``shards`` of at most ``capacity``, each as near as it may be to an equal part of what is left."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    first = [len(sizes)]  # the least start from which so many shards reach the end
    for _ in range(shards - 1):
        first.append(int(np.searchsorted(ends, ends[first[-1]] - capacity)))
    cuts, start = [], 0
    for left in range(shards - 1, 0, -1):
        goal = ends[start] + (ends[-1] - ends[start]) / (left + 1)
        at = int(np.searchsorted(ends, goal))
        at -= at > start and goal - ends[at - 1] < ends[at] - goal
        last = int(np.searchsorted(ends, ends[start] + capacity, "right")) - 1
        start = int(min(max(at, start, first[left]), last))
        cuts.append(start)
    return cuts


def minimax_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """Cuts of the ordered ``sizes`` at the smallest feasible capacity, the other shards as near equal as that leaves them.

    Cells that alone set the capacity get a shard each; the stretches between them are cut at the capacity that is left.
    """
    parts, alone, left, shares = [(0, len(sizes))] if sizes.any() else [], [], shards, []
    while parts:
        capacity, shares = least_capacity([sizes[a:b] for a, b in parts], left)
        a, b = max(parts, key=lambda p: int(sizes[slice(*p)].max()))
        hot = a + int(sizes[a:b].argmax())
        if capacity > sizes[hot]:
            break
        alone.append(hot)
        left -= 1
        parts = [p for q in parts for p in (((a, hot), (hot + 1, b)) if q == (a, b) else (q,)) if sizes[slice(*p)].any()]
    if parts and not alone:
        return even_cuts(sizes, shards, capacity)
    for _ in range(left - sum(shares) if parts else 0):  # what is to spare goes where most lies in a shard
        k = max(range(len(shares)), key=lambda k: int(sizes[slice(*parts[k])].sum()) / shares[k])
        shares[k] += 1
    starts = [*alone, *(a for a, _ in parts)]
    inner = [a + c for (a, b), k in zip(parts, shares if parts else [], strict=True) for c in minimax_cuts(sizes[a:b], k)]
    return sorted([*sorted(starts)[1:], *inner])


def sharded(docs: DataFrame, text: str = "text", shards: int = SHARDS, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``carry``, all by default), size, text_crc32, shard and slot.

    A null text has no bytes and lies with the empty ones. Equal texts share a shard. Slots of a shard run from 0
    without gaps; rows are numbered in blocks of a hash of their place in the table, so a text that fills a third of
    all rows is numbered by many tasks.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = packed(docs, carry, text=text).select(
        "row", (F.length(raw) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(CELLS)).cast("int").alias("cell"), F.monotonically_increasing_id().alias("at"))
    rows = materialize(rows, "sized")
    found = rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toPandas()
    sizes, counts = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
    sizes[found["cell"]], counts[found["cell"]] = found["size"], found["n"]
    cuts = minimax_cuts(sizes, shards)
    shard = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<int>"), lambda c: c <= F.col("cell")))
    most = max((int(c.sum()) for c in np.split(counts, cuts)), default=0)
    blocks = max(8, -(-most // BLOCK))
    placed = materialize(rows.select("row", "size", "text_crc32", shard.alias("shard"),
                                     F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int").alias("block"), "at"), "placed")
    before = placed.groupBy("shard", "block").agg(F.count("*").alias("n")).selectExpr(
        "shard", "block", "sum(n) OVER (PARTITION BY shard ORDER BY block) - n AS base")
    inside = placed.selectExpr("*", "row_number() OVER (PARTITION BY shard, block ORDER BY at) - 1 AS inside")
    return inside.join(before, ["shard", "block"]).select("row", "size", "text_crc32", "shard", (F.col("base") + F.col("inside")).alias("slot"))


def op5(docs: DataFrame) -> DataFrame:
    return sharded(docs, carry=["doc_id"]).select(
        "row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
