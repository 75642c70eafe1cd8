"""Exact near-duplicate join on word shingles in the metric space of Jaccard distances.

Pivots cut the space into regions. The first pivots are the single shingles, ordered from rare to common by counts over
all documents. A set lies in the regions of its first shingles only: linked sets share so much that the first shingle
that they have in common stands early in both, and in the smaller one earlier still, so passages that many documents
have make hardly any regions; and a region holds only sets of sizes that a link allows. Every region is then cut around one of its sets: those within the threshold of the pivot
are linked to it; the rest form the next region, and of the linked ones only those stay beside them whose distance to
the pivot is by the triangle inequality near enough to a set that is not linked to the same pivot. Regions whose sets are
all of one component are done; small ones are compared in full, those that are small from the start without a cut.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.session import materialize, passing

from .common import WORD, map_column, utf8
from .graph import components

WIDTH = 3
#: Links join sets whose intersection is at least this many hundredths of their union.
PERCENT = 90
REGION = 16
ROUNDS = 4
#: Cells in which shingles are counted; the table of their classes has a byte a cell, whatever the input.
CELLS = 1 << 20
#: Neighbouring cells that are counted in one row.
ROW = 16
HASH_BITS = 56
MASK = np.uint64((1 << HASH_BITS) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """A hash for each shingle of a text, in text order; of fewer than ``width`` words, the whole sequence is one."""
    import xxhash

    words = utf8(text).lower().split()  # bytes: lower() changes A-Z alone, split() knows the six spaces alone
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n, run = len(words) - width + 1, np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        run = mixed(run * np.uint64(0x9E3779B97F4A7C15) + one[k:k + n])
    return run & MASK


def shingles(text: str | None, width: int, classes: np.ndarray) -> np.ndarray:
    """The set of a text, sorted: the shingles' hashes below the class that ``classes`` has for them, rare ones first."""
    run = shingle_hashes(text, width)
    return np.unique(classes[run & np.uint64(len(classes) - 1)].astype(np.uint64) << np.uint64(HASH_BITS) | run)


def pool_sizes(n: int, percent: int) -> tuple[int, int]:
    """Where the first shingle that a set of ``n`` shares with a linked one may stand: places in its pool, and early ones.

    They share ``percent n / 100`` or more, so fewer than the pool's come before. If the other set is no smaller, they
    share ``2 percent n / (100 + percent)`` or more, so the shared one is early.
    """
    return n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1


def shingle_classes(docs: DataFrame, width: int, cells: int = CELLS) -> np.ndarray:
    """Binary logarithm of the number of shingles of all texts in each cell of their hash."""
    counts = [f"n{k}" for k in range(ROW)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(cells, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                at, n = np.unique(shingle_hashes(text, width) & np.uint64(cells - 1), return_counts=True)
                found[at] += n
        rows = found.reshape(-1, ROW)
        at = np.flatnonzero(rows.any(axis=1))
        for k in range(0, len(at), 1 << 14):
            part = at[k:k + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *map(pa.array, rows[part].T.copy())], names=["block", *counts])

    fields = ", ".join(f"{c} long" for c in counts)
    sums = docs.select("text").mapInArrow(count, f"block int, {fields}").groupBy("block").agg(*(F.sum(c).alias(c) for c in counts))
    table = sums.select("block", *(F.floor(F.log2(F.greatest(c, F.lit(1)))).cast("tinyint").alias(c) for c in counts)).toArrow()  # little more than a byte a cell
    classes = np.zeros((cells // ROW, ROW), np.uint8)
    classes[table.column("block").to_numpy()] = np.stack([table.column(c).to_numpy() for c in counts], axis=1)
    return classes.reshape(-1)


def set_digest(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def linked(inter: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * inter >= percent * (a + b - inter)


def sides(pairs: DataFrame, table: DataFrame, *fields: str) -> DataFrame:
    """``pairs`` (a, b) with ``fields`` of either node."""
    for side in "ab":
        pairs = pairs.join(table.select(F.col("node").alias(side), *(F.col(f).alias(f"{f}_{side}") for f in fields)), side)
    return pairs


def most_shared() -> Column:
    """Upper bound of two sets' intersection: shingles below both pools' ends that only one pool has are not shared."""
    end = F.least("last_a", "last_b")
    both = F.size(F.array_intersect("pool_a", "pool_b"))
    return F.least(*(F.col(f"n_{s}") - (F.size(F.filter(f"pool_{s}", lambda x: x <= end)) - both) for s in "ab"))


class Comparison:
    """Distances of pairs of sets; a set is built from its text the first time that its pool can't decide a pair."""

    def __init__(self, docs: DataFrame, sets: DataFrame, width: int, percent: int, classes: Broadcast) -> None:
        self.docs, self.sets, self.width, self.percent, self.classes = docs, sets, width, percent, classes
        self.built: DataFrame | None = None

    def build(self, wanted: DataFrame) -> None:
        if self.built is not None:
            wanted = wanted.join(self.built.select("node"), "node", "left_anti")
        width, classes = self.width, self.classes
        texts = self.docs.join(wanted.join(self.sets.select("node", "least", "digest", "n"), "node"), F.col("key").eqNullSafe(F.col("least")))

        def full(texts: list) -> list[tuple]:
            found = [shingles(t, width, classes.value) for t in texts]
            return [(f.astype(np.int64), set_digest(f)) for f in found]

        made = map_column(texts, "text", "full array<long>, found_digest binary", full, ["node", "n", "digest"])
        made = materialize(made.where("digest = found_digest").select("node", "n", "full"), "sets")
        self.built = made if self.built is None else self.built.unionByName(made)

    def distances(self, pairs: DataFrame) -> DataFrame:
        """a, b, linked, lo, hi: equal bounds of the distance, or for a pair that the pools rule out the least that they allow and 1."""
        far = lambda inter: 1 - inter / (F.col("n_a") + F.col("n_b") - inter)
        may = lambda inter: linked(inter, F.col("n_a"), F.col("n_b"), self.percent)
        bounds = sides(pairs, self.sets, "n", "pool", "last").select("a", "b", "n_a", "n_b", most_shared().alias("most"))
        bounds = materialize(bounds.withColumn("open", may(F.col("most"))), "bounds")
        asked = bounds.where("open").select("a", "b")
        ruled = bounds.where("NOT open").select("a", "b", F.lit(False).alias("linked"), far(F.col("most")).alias("lo"), F.lit(1.0).alias("hi"))
        if asked.isEmpty():
            return ruled
        self.build(asked.select(F.col("a").alias("node")).unionByName(asked.select(F.col("b").alias("node"))).distinct())
        inter = F.size(F.array_intersect("full_a", "full_b"))
        exact = sides(asked, self.built, "n", "full").select("a", "b", "n_a", "n_b", inter.alias("inter"))
        exact = exact.select("a", "b", may(F.col("inter")).alias("linked"), far(F.col("inter")).alias("lo"), far(F.col("inter")).alias("hi")).distinct()
        return materialize(exact.unionByName(ruled), "distances")


def meets(turns: int, percent: int, x: str, y: str) -> Column:
    """Whether the bounds of two sets' distances to the pivots of all turns allow a link by the triangle inequality.

    Only an exact distance has an upper bound below 1, so a lower bound alone rules nothing out from above.
    """
    reach = 1 - percent / 100 + 1e-9
    near = (F.get(f"lo{a}", F.lit(k)) <= F.get(f"hi{b}", F.lit(k)) + reach for k in range(turns) for a, b in ((x, y), (y, x)))
    return reduce(and_, near, F.lit(True))


def all_pairs(regions: DataFrame, turns: int, percent: int) -> DataFrame:
    """a < b of each region that may be linked by their distances and sizes, are not known to be, and of which the smaller is early and the larger of the region's band.

    Two linked sets share nothing before their first common shingle, so in the region of that one they share at most what
    either has from there on; in their other regions they need not be listed.
    """
    left = regions.where("early").select("region", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"), F.col("root").alias("rx"), F.col("lo").alias("lo_x"), F.col("hi").alias("hi_x"))
    right = regions.where("native").select("region", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"), F.col("root").alias("ry"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"))
    larger = (F.col("nx") < F.col("ny")) | (F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))
    rest = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    fits = larger & (F.col("rx") != F.col("ry")) & linked(rest, F.col("nx"), F.col("ny"), percent) & meets(turns, percent, "_x", "_y")
    return left.join(right, "region").where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def size_band(n: Column, percent: int) -> Column:
    """Linked sets are of the same band or of neighbouring ones; a band is a little wider than the sizes that a link allows."""
    return F.floor(F.log(n) / math.log(100 / percent * (1 + 1e-9)))


def rare_regions(sets: DataFrame, percent: int) -> DataFrame:
    """region, members, node, n, place, early, native: each set in the regions of its pool where a link may be found first.

    A region is a shingle and a band of sizes: that of the larger set of a link, which is native there. The smaller one is
    native too, or of the band below; so sets of any size that share a shingle by chance do not meet. Regions of the same
    sets become one, in which a set is early if it is so in one of them.
    """
    posts = sets.select("node", "n", "n_early", F.posexplode("pool").alias("place", "shingle"))
    shared = posts.groupBy("shingle").agg(F.count("*").alias("members"), F.bool_or(F.col("place") < F.col("n_early")).alias("any")).where("members > 1 AND any")
    met = posts.join(shared.select("shingle"), "shingle").select("shingle", "node", "n", "place", (F.col("place") < F.col("n_early")).alias("early"), size_band("n", percent).alias("own"))
    met = materialize(met.select("*", F.explode(F.when(F.col("early"), F.array("own", F.col("own") + 1)).otherwise(F.array("own"))).alias("band")).select(
        "shingle", "band", "node", "n", "place", "early", (F.col("band") == F.col("own")).alias("native")), "posts")
    regions = met.groupBy("shingle", "band").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        F.bool_or("early").alias("any"), F.bool_or("native").alias("natives"),
        F.min(F.col("n") - F.col("place")).alias("rest"), F.min("n").alias("lo"), F.max("n").alias("hi")).where("members > 1 AND any AND natives")
    regions = regions.where((F.col("members") > 2) | linked(F.col("rest"), F.col("lo"), F.col("hi"), percent))  # most that share by chance are two
    same = Window.partitionBy("band", "members", "x", "y")
    one = regions.select("shingle", "band", "members", F.min("shingle").over(same).alias("first"))
    return met.join(one, ["shingle", "band"]).groupBy(F.xxhash64("first", "band").alias("region"), "node").agg(
        F.first("members").alias("members"), F.first("n").alias("n"), F.min("place").alias("place"), F.bool_or("early").alias("early"), F.bool_or("native").alias("native"))


def region_links(regions: DataFrame, compare: Comparison, percent: int) -> DataFrame:
    """Links (a, b) between nodes of the same region, up to those that follow from others."""
    none = F.array().cast("array<double>")
    # owner: the turn whose pivot the set is linked to, -1 for the rest; lo and hi: bounds of its distance to each turn's pivot
    regions = materialize(regions.withColumns({"owner": F.lit(-1), "lo": none, "hi": none}), "regions")
    small = regions.where(F.col("members") <= REGION).withColumn("root", F.col("node"))
    found = materialize(compare.distances(all_pairs(small, 0, percent)).where("linked").select("a", "b"), "found")
    active = regions.where(F.col("members") > REGION).drop("members")
    for turn in range(ROUNDS):
        if active.isEmpty():
            break
        sizes = active.groupBy("region").agg(
            F.count("*").alias("members"), F.min(F.struct(F.col("owner") >= 0, "place", "node")).getField("node").alias("pivot"),
            F.bit_xor(F.xxhash64("node", "owner", "early", "native")).alias("x"), F.bit_xor(F.xxhash64("native", "early", "owner", "node")).alias("y"),
            F.bool_or("early").alias("any"), F.bool_or("native").alias("natives"), F.min("place").alias("first")).where("members > 1 AND any AND natives")
        # regions of the same sets ask the same question once, where their first shingle is
        sizes = sizes.groupBy("members", "pivot", "x", "y").agg(F.min_by("region", F.struct("first", "region")).alias("region")).select("region", "members", "pivot")
        active = materialize(active.join(sizes, "region").where("node <> pivot").select(
            "region", "members", "node", "n", "place", "early", "native", "owner", F.col("lo").alias("lo_past"), F.col("hi").alias("hi_past"), F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")), "regions")
        far = compare.distances(active.select("a", "b").distinct())
        fresh = far.where("linked").select("a", "b")
        found = materialize(found.unionByName(fresh), "found")
        placed = materialize(active.join(far, ["a", "b"]).select(
            "region", "members", "node", "n", "place", "early", "native", F.array_append("lo_past", F.col("lo")).alias("lo"),
            F.array_append("hi_past", F.col("hi")).alias("hi"), F.when(F.col("linked") & (F.col("owner") < 0), turn).otherwise(F.col("owner")).alias("owner")), "placed")
        others = placed.groupBy(F.col("region").alias("of"), F.col("owner").alias("other")).agg(
            F.array(*(F.min(F.get("lo", F.lit(k))) for k in range(turn + 1))).alias("lo_other"),
            F.array(*(F.max(F.get("hi", F.lit(k))) for k in range(turn + 1))).alias("hi_other"))
        near = (F.col("region") == F.col("of")) & (F.col("owner") != F.col("other")) & meets(turn + 1, percent, "", "_other")
        ring = placed.where("owner < 0").unionByName(placed.where("owner >= 0").join(others, near, "left_semi"))
        roots = components(found)
        found = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))  # stars, which the next turn's components begin with
        known = ring.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        undecided = known.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("region")
        known = materialize(known.join(undecided, "region"), "open")
        if known.isEmpty():
            break
        small = known if turn == ROUNDS - 1 else known.where(F.col("members") <= REGION)
        fresh = compare.distances(all_pairs(small, turn + 1, percent)).where("linked").select("a", "b")
        if not fresh.isEmpty():
            found = materialize(found.unionByName(fresh), "found")
        active = known.where(F.col("members") > REGION).select("region", "node", "n", "place", "early", "native", "owner", "lo", "hi")
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles and component (the least key reachable by links) for each row of ``docs``.

    Two rows are linked when their shingle sets overlap in ``percent`` hundredths of the union; equal sets always are.
    A null text, or one without words, has an empty set and is linked with nothing. Keys may repeat or be of any type
    that has an order; rows of one key are linked only by their texts. Sets are compared by 56-bit shingle hashes.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    classes = docs.sparkSession.sparkContext.broadcast(shingle_classes(docs, width))

    def sketch(texts: list) -> list[tuple]:
        rows = []
        for t in texts:
            found = shingles(t, width, classes.value)
            n = len(found)
            size, early = pool_sizes(n, percent)
            rows.append((n, set_digest(found), found[:size].astype(np.int64) if n else None, early))
        return rows

    with passing(docs.sparkSession):
        with passing(docs.sparkSession):
            base = materialize(map_column(docs, "text", "n int, digest binary, pool array<long>, n_early int", sketch, ["key"]), "sketch")
            sets = base.where("n > 0").groupBy("digest").agg(
                F.min("key").alias("least"), *(F.first(c).alias(c) for c in ("n", "pool", "n_early")))
            sets = materialize(sets.withColumns({"node": F.monotonically_increasing_id(), "last": F.array_max("pool")}), "classes", lasting=True)
            base = materialize(base.select("key", "n", "digest"), "sizes", lasting=True)
        links = region_links(rare_regions(sets, percent), Comparison(docs, sets, width, percent, classes), percent)
        rooted = sets.select("digest", "node", "least").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = rooted.groupBy("root").agg(F.min("least").alias("component"))
        found = rooted.join(named, "root").select(F.col("digest").alias("of"), "component")
        whole = base.where("n > 0").join(found, F.col("digest") == F.col("of")).select("key", "n", "component")
        alone = base.where("n = 0").select("key", "n", F.col("key").alias("component"))
        done = whole.unionByName(alone).select("key", F.col("n").cast("long").alias("n_shingles"), "component")
        return materialize(done, "components", lasting=True)


def op8(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The row of the least doc_id of each component, of rows with equal doc_id and text one; rows without words all stay."""
    texts = docs.withColumns({"near_id": F.col("doc_id"), "near_text": F.xxhash64("text")})
    keyed = texts.select(F.struct("near_id", "near_text").alias("key"), "text")
    kept = near_duplicates(keyed, "key", width=width, percent=percent).where("key = component AND n_shingles > 0").groupBy("key").agg(F.count("*").alias("copies"))
    kept = kept.select(F.col("key.near_id").alias("of_id"), F.col("key.near_text").alias("of_text"), "copies")
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    same = F.col("near_id").eqNullSafe(F.col("of_id")) & (F.col("near_text") == F.col("of_text"))
    rows = texts.where(worded).join(kept, same)
    one = Window.partitionBy("near_id", "near_text").orderBy("near_text")
    repeated = rows.where("copies > 1").withColumn("near_row", F.row_number().over(one)).where("near_row = 1")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rows.where("copies = 1").select(columns).unionByName(repeated.select(columns)).unionByName(docs.where(~worded))
