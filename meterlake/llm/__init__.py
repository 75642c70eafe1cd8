"""Operators that prepare a training corpus: filter, score, deduplicate, mix, shard and pack documents."""
