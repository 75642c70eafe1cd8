"""Toxicity by a weighted finite-state pattern grammar.

Small transducers for insult, threat, target, negation and reported speech are composed into one; it reads the words
of a clause and gives the clause's weight. Insults and their weights are learned from labelled documents; the words
of the other classes are fixed. A document's score is the calibrated sum of its matched clauses.
"""

from __future__ import annotations

import math
import re
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.session import materialize

from .common import map_column, packed, remainder, unpacked

# Fixed word classes of the grammar, for English, German, French and Spanish.
THREATS = "kill hurt destroy beat punish töten verletzen zerstören tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your he him she her they them du dich dein ihr euch tu toi vous ils elles tú usted ellos ustedes".split()
NEGATIONS = "not never isn't aren't nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says wrote called claimed quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()

CLAUSE = re.compile(r"[.!?;:,\n]+")
TOKEN = re.compile(r"\w[\w']*")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: How many words a target or a negation reaches ahead.
REACH = 3


class Transducer:
    """States from 0; ``step[state][word class]`` is (next state, factor on that word's weight)."""

    def __init__(self, step: list[list[tuple[int, float]]]) -> None:
        self.step = step

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same words; the factors multiply."""
        width = len(other.step)
        return Transducer([
            [(a[0] * width + b[0], a[1] * b[1]) for a, b in zip(left, right, strict=True)]
            for left, right in product(self.step, other.step)])


def within(opener: int, factor: float) -> Transducer:
    """After a word of class ``opener`` the weights of the next ``REACH`` words are multiplied."""
    return Transducer([
        [(REACH, 1.0) if kind == opener else (max(state - 1, 0), factor if state else 1.0) for kind in range(6)]
        for state in range(REACH + 1)])


def grammar() -> Transducer:
    """Insults count in full, threats only near a target; negation and reported speech weaken what follows."""
    needs_target = Transducer([
        [(REACH, 1.0) if kind == TARGET else (max(state - 1, 0), 0.0 if kind == THREAT and not state else 1.0) for kind in range(6)]
        for state in range(REACH + 1)])
    reported = Transducer([
        [(1 if kind == REPORT else 0, 1.0) for kind in range(6)],
        [(1, 0.6) for _ in range(6)]])
    return needs_target.compose(within(TARGET, 1.5)).compose(within(NEGATION, 0.5)).compose(reported)


class Scorer:
    """``stems``: weight of a learned insult, a whole word or (with a final ``*``) the start of one."""

    def __init__(self, stems: dict[str, float], slope: float = 0.0, bias: float = -20.0) -> None:
        self.words = {s: w for s, w in stems.items() if not s.endswith("*")}
        self.starts = {s[:-1]: w for s, w in stems.items() if s.endswith("*")}
        self.lengths = sorted({len(s) for s in self.starts}, reverse=True)
        self.kinds = {w: k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.step = grammar().step
        self.slope, self.bias = slope, bias

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in self.lengths:
            found = max(found, self.starts.get(word[:n], 0.0))
        return found

    def clause(self, words: list[str]) -> float:
        state, total = 0, 0.0
        for word in words:
            kind, weight = self.kinds.get(word, OTHER), 0.0
            if kind == THREAT:
                weight = 3.0
            elif kind == OTHER and (weight := self.weight(word)):
                kind = INSULT
            state, factor = self.step[state][kind]
            total += factor * weight
        return total

    def raw(self, text: str | None) -> float:
        """Log of one plus the weights of all matched clauses."""
        low = (text or "").lower()
        words = set(TOKEN.findall(low))
        if not any(self.kinds.get(w) == THREAT or self.weight(w) for w in words):
            return 0.0
        return math.log1p(sum(self.clause(TOKEN.findall(c)) for c in CLAUSE.split(low)))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * self.raw(text) + self.bias))))


def stems_of(text: str | None) -> set[str]:
    """The words of a text, and their starts of 4 to 7 letters."""
    words = set(TOKEN.findall((text or "").lower()))
    return {w for w in words if len(w) >= 3} | {w[:n] + "*" for w in words for n in range(4, 8) if len(w) > n}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and bias by Newton's steps."""
    a = np.column_stack([x, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + len(x) * ridge * np.diag([1.0, 1e-3]) / 10
        step = np.linalg.solve(hess, a.T @ (y - p) - len(x) * ridge * np.array([w[0], 1e-3 * w[1]]) / 10)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 10_000, max_stems: int = 2_000, support: int = 8) -> Scorer:
    """Learns from the labelled documents whose remainder by 5 is not 0, on a hash sample of about ``fit_rows`` of them.

    A stem is an insult if it occurs in ``support`` unlike toxic documents (near copies share the least hash of their
    words and count once) and the lower bound of its log odds against clean ones is above 1.2. At most ``max_stems`` are kept.
    A document with several labels is toxic if one says so, and one with several rows counts by its highest score where the
    slope is fitted. Without labels of both kinds nothing is learned, and every score is that of the untrained grammar.
    """
    known = labels.where(remainder(F.col("doc_id"), 5) != 0).where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(
        F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    known = materialize(known, "labels")
    share = min(1.0, fit_rows / max(known.count(), 1))
    some = known.where(F.pmod(F.xxhash64("label_id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col("doc_id").alias("label_id"), "text")  # other columns may have any name
    rows = materialize(texts.join(F.broadcast(some), "label_id"), "labelled")
    counts = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_clean:
        return Scorer({})

    def toxic_stems(texts: list) -> list[tuple]:
        import zlib

        found = []
        for text in texts:
            stems = stems_of(text)
            least = min((zlib.crc32(s.encode()) for s in stems), default=0)
            found.append((sorted(stems), least))
        return found

    seen = map_column(rows.where("toxic = 1"), "text", "stems array<string>, least long", toxic_stems, ["toxic"])
    often = (seen.select(F.explode("stems").alias("stem"), "least").groupBy("stem")
             .agg(F.countDistinct("least").alias("unlike"), F.count("*").alias("n"))
             .where(F.col("unlike") >= support).orderBy(F.desc("unlike"), "stem").limit(10 * max_stems).collect())
    wanted = {r.stem: (r.unlike, r.n) for r in often}

    def clean_stems(texts: list) -> list[tuple]:
        return [(sorted(stems_of(t) & wanted.keys()),) for t in texts]

    clean = {r.stem: r.n for r in map_column(rows.where("toxic = 0"), "text", "stems array<string>", clean_stems, ["toxic"]).select(
        F.explode("stems").alias("stem")).groupBy("stem").agg(F.count("*").alias("n")).collect()}
    stems: dict[str, float] = {}
    for stem, (unlike, _) in wanted.items():
        p, q = unlike + 0.5, clean.get(stem, 0) + 0.5
        bound = math.log(p / (n_toxic + 1)) - math.log(q / (n_clean + 1)) - 1.64 * math.sqrt(1 / p + 1 / q)
        if bound > 1.2:
            stems[stem] = bound
    scorer = Scorer(dict(sorted(stems.items(), key=lambda x: (-x[1], x[0]))[:max_stems]))
    raw = map_column(rows, "text", "raw double", lambda texts: [(scorer.raw(t),) for t in texts], ["label_id", "toxic"])
    raw = raw.groupBy("label_id", "toxic").agg(F.max("raw").alias("raw")).collect()  # a row a label of the sample
    scorer.slope, scorer.bias = logistic(np.array([r.raw for r in raw]), np.array([float(r.toxic == 1) for r in raw]))
    return scorer


def scored(docs: DataFrame, scorer: Scorer, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``carry``, all by default) and score, 0 to 1.

    Null and empty texts get the score of a text without matches. Every row is scored by its own text alone.
    """
    return map_column(packed(docs, carry, text=text), "text", "score double", lambda texts: [(scorer.score(t),) for t in texts], ["row"])


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, repeated ones too; a null doc_id counts as the empty text.

    Long texts are scored whole. Other columns are not read, whatever their names.
    """
    return scored(docs, fit(docs, labels), carry=["doc_id"]).select(
        "row.doc_id", (remainder(F.col("row.doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return unpacked(scored(docs, fit(docs, labels)).where("score < 0.5"), docs.columns)
