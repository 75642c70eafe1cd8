"""Host-level quality rules.

Each document is held against four rules. The failures of a host's documents are added up, the failure rate is
shrunk towards the rate of all hosts by an empirical beta prior, and the host's verdict is joined back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.session import materialize

from .common import map_column, packed, unpacked, utf8

COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
WINDOW = 5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in some ``window``-word run found twice or more, each word counted once."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    one = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(ids) == len(words):
        return 0
    run = one[:n]
    for k in range(1, window):  # runs of k + 1 words get dense numbers from those of k words
        run = np.unique(run * len(ids) + one[k:k + n], return_inverse=True)[1]
    twice = np.bincount(run)[run] > 1
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, np.flatnonzero(twice), 1)
    np.add.at(step, np.flatnonzero(twice) + window, -1)
    return int(np.count_nonzero(np.cumsum(step)))


def text_counts(text: str | None) -> tuple[int, ...]:
    raw = utf8(text)
    words = raw.split()  # bytes split at exactly the white space that ends a word
    seen: set[bytes] = set()
    lines = dups = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dups += line in seen
            seen.add(line)
    chars = len(text or "") - sum(raw.count(bytes([c])) for c in SPACES)
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    return len(words), chars, symbols, lines, dups, repeated_words(words)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def own_failed() -> Column:
    """A document's failure of any rule: the base, more than a symbol in ten words, more than half the lines repeated."""
    return base_failed() | (10 * F.col("n_symbols") > F.col("n_words")) | (2 * F.col("n_dup_lines") > F.col("n_lines"))


def host_verdicts(judged: DataFrame, limit: float) -> DataFrame:
    """host, host_rejected: whether the shrunk failure rate exceeds ``limit``.

    The prior has the mean of all documents and, by the method of moments, the spread between hosts; its weight is
    held between 1 and 1000 documents.
    """
    hosts = materialize(judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f")), "hosts")
    n, f = F.sum("n").cast("double"), F.sum("f").cast("double")
    total = hosts.agg(n.alias("n"), f.alias("f"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff")).first()
    if not total.n:
        return hosts.select("host", F.lit(False).alias("host_rejected"))
    mean = total.f / total.n
    spread = max(total.ff / total.n - mean * mean, 1e-12)
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1000.0)
    return hosts.select("host", ((F.col("f") + mean * weight) / (F.col("n") + weight) > limit).alias("host_rejected"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", limit: float = 0.5,
                  carry: list[str] | None = None, copy: bool = True) -> DataFrame:
    """``row`` (the columns ``carry`` of ``docs``, all by default), the counts, base_failed, host_rejected and kept.

    A document is kept unless it fails a rule itself or its host is rejected. A null text has no words, so it fails.
    A null host is a host of its own. Repeated rows count as often as they occur. An empty table gives no rows.
    The counted rows are written between the two passes; without ``copy``, for wide rows, they are counted in each.
    """
    rows = packed(docs, carry, text=text, host=host)

    def judge(keep: list[str]) -> DataFrame:
        return map_column(rows, "text", COUNTS, lambda texts: [text_counts(t) for t in texts], keep).withColumn("failed", own_failed())

    judged = materialize(judge(["row", "host"]), "quality") if copy else judge(["row", "host"])
    keys = [F.coalesce("host", F.lit("")), F.col("host").isNull()]
    verdicts = host_verdicts((judged if copy else judge(["host"])).select("host", "failed"), limit).select(
        keys[0].alias("key"), keys[1].alias("missing"), "host_rejected")
    return (judged.join(verdicts, (keys[0] == F.col("key")) & (keys[1] == F.col("missing")))
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("failed") & ~F.col("host_rejected"))
            .drop("key", "missing", "failed", "host"))


def op1(docs: DataFrame) -> DataFrame:
    return quality_rules(docs, carry=["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


def keep_good(docs: DataFrame) -> DataFrame:
    return unpacked(quality_rules(docs, copy=False).where("kept"), docs.columns)
