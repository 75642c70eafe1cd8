"""Language-model scores by context-tree weighting.

A byte is eight binary decisions. Each decision has a tree of contexts, the bytes before it; every node mixes the
Krichevsky-Trofimov estimate of its own counts with what its children give, weighed by how well either codes the
training text. The counts come from all training documents; a text's score is its code length under the mixture.

Documents are dealt to blocks of bounded size. Each block asks for the strings and words that it contains, once each,
and gets their values back by a join, so no task holds more of the model than its own block needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.session import materialize

from .common import remainder, utf8

DEPTH = 5
BLOCK_BYTES = 24 << 20
#: Bytes whose strings are counted or looked up at once.
SLICE = 1 << 20
#: Strings gathered from slices before equal ones are added up.
GATHERED = 1 << 20
END = b"\n"


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()  # bytes: lower() changes A-Z alone, split() knows the six spaces alone


def plain(words: list[bytes]) -> bytes:
    """What the model codes: the words with single spaces, then the end."""
    return b" ".join(words) + END


def string_codes(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts with the ``depth`` bytes before it (zeros before a text), as one number; bytes a text."""
    joined = np.frombuffer(b"".join(bytes(depth) + t for t in texts), np.uint8).astype(np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = joined.copy()
    for j in range(1, depth + 1):
        codes[j:] |= joined[:-j] << (8 * j)
    real = np.ones(len(joined), bool)
    starts = np.concatenate(([0], np.cumsum(lengths + depth)[:-1]))
    real[(starts[:, None] + np.arange(depth)).ravel()] = False
    return codes[real], lengths


def slices(texts: list[bytes]) -> list[list[int]]:
    """Positions of ``texts`` in runs of about ``SLICE`` bytes."""
    runs, size = [[]], 0
    for i, t in enumerate(texts):
        if size + len(t) > SLICE and runs[-1]:
            runs.append([])
            size = 0
        runs[-1].append(i)
        size += len(t)
    return runs


def counted(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift of 8; exact to 1e-10 for x > 0."""
    y = x + 8
    shift = sum(np.log(x + k) for k in range(8))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of the Krichevsky-Trofimov estimator for a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def decision(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each code's last byte the node (1 and the ``k`` bits decided before) and the bit of its decision ``k``."""
    byte = codes & 255
    return (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


class Level:
    """The nodes of one depth: counts, weighted probability and the weight of the own estimate."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None) -> None:
        self.nodes, self.zeros, self.ones = nodes, zeros, ones
        own = log_kt(zeros, ones)
        if children is None:
            self.log_pw, self.weight = own, np.ones(len(nodes))
        else:
            self.log_pw = np.logaddexp(own, children) - np.log(2)
            self.weight = 1 / (1 + np.exp(np.clip(children - own, -700, 700)))

    def predict(self, at: np.ndarray, bit: np.ndarray, below: np.ndarray | None, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Probability of ``bit`` at the nodes; a context that training never saw leaves the choice to its parent."""
        total = self.zeros[at] + self.ones[at]
        p = (np.where(bit == 1, self.ones[at], self.zeros[at]) + 0.5) / (total + 1)
        if below is not None:
            w = self.weight[at]
            p = np.where(seen, w * p + (1 - w) * below, p)
        return p, total > 0


def lower_levels(codes: np.ndarray, counts: np.ndarray, depth: int, k: int, top: int = 2) -> list[tuple[Level, np.ndarray]]:
    """Levels from ``depth`` up to ``top`` of decision ``k`` in the strings of one context of ``top`` bytes, with each string's node.

    The nodes of different decisions are never related, so one decision at a time takes an eighth of the memory.
    """
    prefix, bit = decision(codes, k)
    levels: list[tuple[Level, np.ndarray]] = []
    for d in range(depth, top - 1, -1):
        context = (codes >> 8) & ((1 << (8 * d)) - 1)
        nodes, at = np.unique((context << 8) | prefix, return_inverse=True)
        ones = np.bincount(at, counts * bit, len(nodes))
        zeros = np.bincount(at, counts * (1 - bit), len(nodes))
        children = None
        if levels:
            child = levels[-1][0]
            parent = np.searchsorted(nodes, child.nodes & ((1 << (8 * (d + 1))) - 1))
            children = np.bincount(parent, child.log_pw, len(nodes))
        levels.append((Level(nodes, zeros, ones, children), at.astype(np.int32)))
    return levels


def upper_levels(nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_pw: np.ndarray) -> tuple[Level, Level]:
    """Depths 1 and 0 from the sums over the nodes of depth 2 by last byte and decision."""
    size = 1 << 16
    spread = lambda v, at, n: np.bincount(at, v, n)
    one = Level(np.arange(size), spread(zeros, nodes, size), spread(ones, nodes, size), spread(log_pw, nodes, size))
    low = np.arange(size) & 255
    zero = Level(np.arange(256), spread(one.zeros, low, 256), spread(one.ones, low, 256), spread(one.log_pw, low, 256))
    return one, zero


def code_lengths(codes: np.ndarray, counts: np.ndarray, depth: int, one: Level, zero: Level) -> np.ndarray:
    """log10 of the mixture's probability of each code's last byte after the bytes before."""
    total = np.zeros(len(codes))
    for k in range(8):
        prefix, bit = decision(codes, k)
        p = seen = None
        for level, at in lower_levels(codes, counts, depth, k):
            p, seen = level.predict(at, bit, p, seen)
        p, seen = one.predict(((codes >> 8) & 255) << 8 | prefix, bit, p, seen)
        p, seen = zero.predict(prefix, bit, p, seen)
        total += np.log10(np.where(seen, p, 0.5))
    return total


def block_strings(table: pa.Table, depth: int) -> pa.Table:
    """The words and strings of one block, each once, with their counts in training documents."""
    texts, held = table.column("text").to_pylist(), table.column("held").to_pylist()
    words: dict[bytes, int] = {}
    plains = []
    for text, out in zip(texts, held, strict=True):
        found = words_of(text)
        for w in found:
            words[w] = words.get(w, 0) + (not out)
        words[b""] = words.get(b"", 0) + (not out)  # the end
        plains.append(plain(found))
    del texts
    codes, counts = [], []
    for part in (False, True):
        mine = [t for t, out in zip(plains, held, strict=True) if out == part]
        for run in slices(mine):
            # an unseen text adds its strings with a count of 0
            c, n = np.unique(string_codes([mine[i] for i in run], depth)[0], return_counts=True) if run else (np.empty(0, np.int64), np.empty(0, np.int64))
            codes.append(c)
            counts.append(n * (not part))
            if sum(map(len, codes[1:])) > GATHERED:
                codes, counts = ([x] for x in counted(codes, counts))
    strings, n = counted(codes, counts)
    del plains, codes, counts
    empty, nothing = len(words), len(strings)
    block = table.column("block")[0].as_py()
    return pa.table({
        "block": pa.array([block] * (empty + nothing), pa.int64()),
        "word": pa.concat_arrays([pa.array(list(words), pa.binary()), pa.nulls(nothing, pa.binary())]),
        "string": pa.concat_arrays([pa.nulls(empty, pa.int64()), pa.array(strings)]),
        "n": pa.concat_arrays([pa.array(list(words.values()), pa.int64()), pa.array(n)])})


def block_scores(docs: pa.Table, values: pa.Table, depth: int, unknown: float) -> pa.Table:
    """The rows of one block scored with the values of its words and strings."""
    is_word = values.column("word").is_valid().to_numpy()
    value = values.column("value").to_numpy()
    place = {w: i for i, w in enumerate(values.column("word").drop_null().to_pylist())}
    of_word = value[is_word]
    strings = values.column("string").drop_null().to_numpy()
    order = np.argsort(strings)
    strings, of_string = strings[order], value[~is_word][order]
    plains, tokens, known, base = [], [], [], []
    for text in docs.column("text").to_pylist():
        found = words_of(text)
        each = of_word[np.fromiter(map(place.__getitem__, [*found, b""]), np.int64, len(found) + 1)]
        tokens.append(len(each))
        known.append(int((each > unknown).sum()))
        base.append(float(each.sum()))
        plains.append(plain(found))
    score = np.zeros(len(plains))
    for run in slices(plains):
        if run:
            codes, lengths = string_codes([plains[i] for i in run], depth)
            each = of_string[np.searchsorted(strings, codes)]
            score[run] = np.add.reduceat(each, np.concatenate(([0], np.cumsum(lengths)[:-1])))
    return pa.table({"key": docs.column("key"), "held_out": docs.column("held"), "n_tokens": pa.array(tokens, pa.int64()),
                     "n_known": pa.array(known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score),
                     "n_bytes": pa.array([len(t) for t in plains], pa.int64())})


def string_values(strings: DataFrame, depth: int) -> DataFrame:
    """string, value (log10 probability) for each ``string`` with its training count ``n``."""
    paired = strings.withColumn("pair", F.shiftright("string", 8).bitwiseAND(F.lit(65535)))

    def lower(table: pa.Table) -> pa.Table:
        codes, counts = table.column("string").to_numpy(), table.column("n").to_numpy()
        tops = [lower_levels(codes, counts, depth, k)[-1][0] for k in range(8)]
        fields = {c: np.concatenate([getattr(top, c) for top in tops]) for c in ("nodes", "zeros", "ones", "log_pw")}
        return pa.table({"node": fields.pop("nodes") & 65535, **fields})

    sums = paired.groupBy("pair").applyInArrow(lower, "node long, zeros double, ones double, log_pw double").groupBy("node").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_pw").alias("log_pw")).toPandas()  # 65,536 rows at most
    one, zero = upper_levels(*(sums[c].to_numpy() for c in ("node", "zeros", "ones", "log_pw")))
    shared = strings.sparkSession.sparkContext.broadcast((one, zero))

    def lengths(table: pa.Table) -> pa.Table:
        codes = table.column("string").to_numpy()
        return pa.table({"string": codes, "value": code_lengths(codes, table.column("n").to_numpy(), depth, *shared.value)})

    return paired.groupBy("pair").applyInArrow(lengths, "string long, value double")


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: int = 10, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for each row of ``docs``.

    Learns from the rows whose crc32 of the key is not 0 modulo ``held_out``. The base is the unigram model of words and
    an end; the score codes the same sequence, byte by byte, the end included, so both are log10 probabilities of the
    same thing. A null text is an empty one, of which only the end is coded. Rows that are equal are scored alike; a
    null key counts as the empty text in the split. Without training rows every decision costs one bit.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = docs.select("key", "text", (remainder(F.col("key"), held_out) == 0).alias("held"),
                        F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).alias("block"))
    seen = materialize(dealt.groupBy("block").applyInArrow(lambda t: block_strings(t, depth), "block long, word binary, string long, n long"), "strings")
    asked_words, asked_strings = seen.where("word IS NOT NULL"), seen.where("string IS NOT NULL")
    words = materialize(asked_words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, True)).alias("v")).first()
    floor = total.n + 0.1 * (total.v + 1)
    base = words.select("word", F.log10((F.col("n") + 0.1) / F.lit(floor)).alias("value"))
    unknown = float(np.log10(0.55 / floor))  # between a count of none and of one
    strings = materialize(asked_strings.groupBy("string").agg(F.sum("n").alias("n")), "counts")
    values = asked_words.select("block", "word").join(base, "word").select("block", "word", F.lit(None).cast("long").alias("string"), "value").unionByName(
        asked_strings.select("block", "string").join(string_values(strings, depth), "string").select(
            "block", F.lit(None).cast("binary").alias("word"), "string", "value"))
    kind = docs.schema["key"].dataType.simpleString()
    done = dealt.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(
        lambda left, right: block_scores(left, right, depth, unknown),
        f"key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return done.withColumn("train_tokens", F.lit(int(total.n)).cast("long")).withColumn(
        "bits_per_byte", F.col("score") * F.lit(-np.log2(10)) / F.col("n_bytes"))


def op7(docs: DataFrame) -> DataFrame:
    return scored(docs).select(F.col("key").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
