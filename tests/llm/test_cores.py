"""Parts of the corpus operators that small tables don't reach by themselves: exchanged gaps, clamped sources, long texts."""

import random

import numpy as np

from meterlake.llm import mixing, packing, quality_rules


def test_partitions_with_gaps_exchange_documents(spark):
    rng = random.Random(8)
    lengths = [rng.choice([rng.randint(1, 1023), rng.randint(300, 420), rng.randint(500, 540)]) for _ in range(700)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    one_round = packing.pack(items, group_rows=20, rounds=1).select("sequence_id").distinct().count()
    got = packing.pack(items, group_rows=20).collect()
    assert sorted((r.item, r.length) for r in got) == list(enumerate(lengths))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    bound = packing.lower_bound(np.bincount(lengths, minlength=packing.SIZE + 1))
    assert bound <= len(bins) <= one_round


def filled(sizes, weights, most):
    """Targets by clamping one source after the other."""
    budget, clamped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in clamped]
        left = budget - sum(most * sizes[i] for i in clamped)
        targets = [most * s if i in clamped else left * weights[i] / sum(weights[k] for k in free) for i, s in enumerate(sizes)]
        over = {i for i in free if targets[i] > most * sizes[i] + 1e-9}
        if not over:
            return targets
        clamped |= over


def test_clamped_sources_share_their_excess(spark):
    sizes = [4000, 50, 300, 10, 2500, 0]  # weights 1, 2, 3 again and again: the second, fourth and last are clamped
    rows, rng = [], random.Random(3)
    for s, size in enumerate(sizes):
        left, i = size, 0
        while left > 0 or i == 0:
            n = min(left, rng.randint(1, 9))
            rows.append((1000 * s + i, " ".join(["w"] * n), f"s{s}" if s < 5 else None))
            left, i = left - n, i + 1
    got = mixing.op6(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = filled(sizes, [1, 2, 3, 1, 2, 3], 3)
    assert want[1] == 150 and want[3] == 30
    for s, size in enumerate(sizes):
        mine = [r for r in got if r.doc_id // 1000 == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == size and r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 9


def test_long_texts(spark):
    text = " ".join(f"word{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text, "a"), (2, text + " end", "a"), (3, "short", "a")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.op1(docs).collect()}
    assert got[1].n_words == 20_000 and not got[1].base_failed and got[3].base_failed
    pieces = packing.op2(docs).collect()
    assert sum(r.length for r in pieces if r.doc_id == 2) > 40_000 and all(r.length <= packing.SIZE for r in pieces)
