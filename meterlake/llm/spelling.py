"""Spelling variants: words one edit apart, found by pivotal grams.

Bigrams are ordered from rare to common over the vocabulary. A word's prefix are its three rarest bigrams, with all others
as common as the third. Of the prefix, dynamic programming chooses two disjoint bigrams that are expected to meet the fewest words: the
pivots. One edit spoils one pivot at most, so of two near words the one whose prefix ends sooner keeps a pivot in the
prefix of the other. Where it stands there is limited: the edit lies behind the first pivot or before the second, so
either the words agree up to the first pivot's end, or from the second pivot's start on. Pivots therefore meet the
prefixes by place, length and a hash of the letters that must agree, the bigram included. What meets is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.session import materialize

from .common import lower_ascii

LETTERS = "[A-Za-zÀ-ÿ]"
SHORTEST, FEWEST, TIMES = 7, 2, 10
#: Every run whose hash this divides loses a letter.
SPOILED = 31
#: Bigrams of a prefix: one edit spoils two at most, and of three some two are disjoint.
PREFIX = 3
RARER = 0.2
#: Letters of words that are verified where they meet.
SHORT = 64
PRIME, BASE = (1 << 61) - 1, 1_000_003


def spoiled_runs(docs: DataFrame, key: str, text: str, shortest: int = SHORTEST) -> DataFrame:
    """word: every run of letters of all texts, lower-cased, some without a letter; shorter ones than asked for are left out."""
    # a run that is too short stays so, and a longer one is matched whole
    runs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(h % SPOILED == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", fewest: int = FEWEST) -> DataFrame:
    """word, n of the words that occur ``fewest`` times or more."""
    return spoiled_runs(docs, key, text).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How often each bigram stands in the vocabulary: a row for two letters, so the alphabet bounds the table (90 letters here)."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    return {r.gram: r.n for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}


def disjoint(places: list[int], firsts: list[float], lasts: list[float]) -> tuple[int, int]:
    """The two of ascending ``places`` that are two or more apart with the least sum of one's ``firsts`` and a later one's ``lasts``."""
    # least[i]: the cheapest first pivot among the places up to the i-th
    least, best, fits = [0] * len(places), None, 0
    for i, place in enumerate(places):
        least[i] = i if not i or firsts[i] < firsts[least[i - 1]] else least[i - 1]
        while places[fits] + 2 <= place:
            fits += 1
        if fits and (best is None or firsts[least[fits - 1]] + lasts[i] < best[0]):
            best = (firsts[least[fits - 1]] + lasts[i], places[least[fits - 1]], place)
    return best[1:]


def rolling(word: str) -> list[int]:
    """Hashes of the word's beginnings of every length."""
    h, out = 0, [0]
    for c in word:
        h = (h * BASE + ord(c)) % PRIME
        out.append(h)
    return out


def selected(word: str, order: dict[str, int], counts: dict[str, int]) -> tuple[int, list[int], tuple[int, int]]:
    """The prefix's last bigram by ``order``, the prefix's places and the pivots' places.

    What a pivot would meet is taken as its bigram's count, less by ``RARER`` for each letter more that must agree.
    """
    ranks = [order[word[i:i + 2]] for i in range(len(word) - 1)]
    last = sorted(ranks)[PREFIX - 1]
    prefix = [i for i, rank in enumerate(ranks) if rank <= last]
    weights = [counts[word[i:i + 2]] for i in prefix]
    end = len(word) - 2
    return last, prefix, disjoint(prefix, [w * RARER ** i for w, i in zip(weights, prefix, strict=True)],
                                  [w * RARER ** (end - i) for w, i in zip(weights, prefix, strict=True)])


def meeting(side: int, place: int, length: int, shared: int) -> int:
    """Hash of where a bigram stands and of the letters that must agree, it included."""
    return (((shared * BASE + place) * BASE + length) * 2 + side) % PRIME


def entries(word: str, order: dict[str, int], counts: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """The prefix's last bigram; where the pivots look, and under what the prefix is found.

    A place is counted from the word's beginning on side 0, from its end on side 1.
    """
    n = len(word)
    last, prefix, (first, second) = selected(word, order, counts)
    front, back = rolling(word), rolling(word[::-1])
    looks = [meeting(*at) for length in (n - 1, n, n + 1) for at in ((0, first, length, front[first + 2]), (1, n - second, length, back[n - second]))]
    return last, looks, [meeting(*at) for i in prefix for at in ((0, i, n, front[i + 2]), (1, n - i, n, back[n - i]))]


def letters(word: str) -> int:
    """A bit for each letter (modulo 63) of the word."""
    bits = 0
    for c in set(word):
        bits |= 1 << ord(c) % 63
    return bits


def near_words(words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """a, b (ids): all pairs of words, each in both orders, that one inserted, deleted or replaced letter makes equal.

    ``words`` has id and word, of four letters or more; ``counts`` are those of its bigrams. Words of up to ``SHORT``
    letters are verified where they meet, so that only near ones are kept; longer ones by their ids afterwards.
    """
    order = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    def lists(values: list[list[int]]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, values)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter((x for v in values for x in v), np.int64, ends[-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                texts = part.column("word").to_pylist()
                last, looks, found = zip(*(entries(w, order, counts) for w in texts), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([w if len(w) <= SHORT else None for w in texts], pa.string()), pa.array(map(letters, texts), pa.int64()),
                     pa.array(last, pa.int32()), lists(looks), lists(found)], names=["id", "short", "letters", "last", "looks", "found"])

    made = materialize(words.select("id", "word").mapInArrow(
        run, "id long, short string, letters long, last int, looks array<long>, found array<long>"), "grams")
    side = lambda s, keys: made.select(F.explode(keys).alias("key"), *(F.col(c).alias(f"{c}_{s}") for c in ("id", "last", "letters", "short")))
    near = one_edit("short_a", "short_b")
    # one edit takes one letter out and brings one in at most
    may = ("last_a <= last_b AND id_a <> id_b AND bit_count(letters_a ^ letters_b) <= 2")
    met = side("a", "looks").join(side("b", "found"), "key").where(F.expr(may) & F.coalesce(near, F.lit(True)))
    met = met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), near.isNotNull().alias("sure")).distinct()
    met = materialize(met, "met")
    asked = met.where("NOT sure")
    for s in "ab":
        asked = asked.join(words.select(F.col("id").alias(s), F.col("word").alias(f"word_{s}")), s)
    pairs = met.where("sure").select("a", "b").unionByName(asked.where(one_edit("word_a", "word_b")).select("a", "b"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def one_edit(a: str, b: str) -> Column:
    return F.levenshtein(a, b, 1) == 1


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the steps word -> form end. Each round doubles the steps; a form is so much more frequent that they are few."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(at.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(counted: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n), whose words are unique and of four letters or more.

    A word's form is its near word of the largest n, if that is ``times`` its own or more; of equals the least by code
    points. Following forms ends at the root, for each is more frequent than the one before.
    """
    words = materialize(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    counts = gram_counts(words)
    pairs = near_words(words, counts)
    other = words.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("less"), "word").alias("of"))
    best = pairs.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min("of").alias("of"))
    enough = -F.col("of.less") >= times * F.col("n")
    named = materialize(words.join(best, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("of.word")).alias("form"), F.when(enough, -F.col("of.less")).alias("form_n")), "forms")
    ends = roots(named.where("form IS NOT NULL"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(docs: DataFrame) -> DataFrame:
    """The variants of all words of ``documents``. A null text has no words, a null doc_id counts as the empty text.

    Every row counts, repeated ones too; other columns are not read. Long texts are read whole and long words compared whole.
    """
    return variants(word_counts(docs))
