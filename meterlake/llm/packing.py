"""Best-fit packing with certified bounds.

Documents become pieces of at most ``size`` tokens. Full pieces are sequences of their own; the rest is dealt to
partitions of bounded size and packed by best-fit decreasing. Dual-feasible functions give a lower bound for each
partition; where it equals the number of sequences the partition is done. Partitions with a gap give up the documents
of their unfilled sequences, which are dealt anew and packed again.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.session import materialize

from .common import map_column, packed

SIZE = 1024
END_ID = 2
# The byte-level pre-tokenizer's pattern, for texts of the characters of PLAIN; others go to the library as a whole.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼½¾]+| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+|\s+(?!\S)|\s+")
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
#: Words whose ids a worker remembers.
REMEMBERED = 1_000_000


@cache
def tokenizer(path: str):
    """The tokenizer, and the ids (little-endian) of the words seen so far."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


def ids_of(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers.

    The model never merges across the pre-tokenizer's pieces, so each distinct piece is encoded once by the library.
    """
    model, known = tokenizer(path)
    special = [t.content for t in model.get_added_tokens_decoder().values()]
    as_bytes = lambda ids: np.array(ids, "<u4").tobytes()
    cut = [PIECE.findall(t) if PLAIN.fullmatch(t) and not any(s in t for s in special) else None for t in texts]
    new: set[str] = set()
    for pieces in cut:
        new.update(pieces or ())
    new -= known.keys()
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = {p for pieces in cut for p in pieces or ()}
    for blank in [p for p in new if p.isspace()]:
        known[blank] = as_bytes(model.encode(blank, add_special_tokens=False).ids)
    words = [p for p in new if not p.isspace()]
    line = model.encode("\n", add_special_tokens=False).ids[0]
    for k in range(0, len(words), 4096):  # many at once: a line end is a piece of its own before any of them
        part = words[k:k + 4096]
        ids = np.array(model.encode("\n".join(part), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(ids == line)
        raw, starts, stops = ids.tobytes(), [0, *(4 * (ends + 1)).tolist()], [*(4 * ends).tolist(), 4 * len(ids)]
        known.update((word, raw[a:b]) for word, a, b in zip(part, starts, stops, strict=True))
    return [as_bytes(model.encode(text, add_special_tokens=False).ids) if pieces is None else b"".join(map(known.__getitem__, pieces))
            for text, pieces in zip(texts, cut, strict=True)]


def pieces_of(ids: bytes, size: int = SIZE) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of one document; of more than ``size`` ids the first piece takes the remainder."""
    n = len(ids) // 4
    starts = [0, *range(n % size or size, n, size)] if n > size else [0]
    return [(i, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for i, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True))]


def lower_bound(counts: np.ndarray, size: int = SIZE) -> int:
    """Sequences that ``counts[s]`` documents of s tokens need at least, by dual-feasible functions.

    Total size; for each threshold e, sizes above ``size - e`` as full and those below e as nothing; and the rounding
    functions that map a share x to floor((k + 1) x) / k unless (k + 1) x is whole.
    """
    s = np.arange(size + 1)
    best = -(-int((s * counts).sum()) // size)
    many, mass = np.cumsum(counts), np.cumsum(s * counts)
    e = np.arange(1, size // 2 + 1)
    big = many[size] - many[size - e]
    middle = mass[size - e] - mass[e - 1]
    best = max(best, int((big - (-middle // size)).max()))
    for k in range(1, 21):
        whole = (k + 1) * s % size == 0
        scaled = np.where(whole, k * s, size * ((k + 1) * s // size))  # size * k times the function
        best = max(best, -(-int((scaled * counts).sum()) // (size * k)))
    return best


def best_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each length by best-fit decreasing, and the number of sequences."""
    order = np.argsort(-lengths, kind="stable")
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]
    free, made = 0, 0  # bit r of free: a sequence with room r is open
    for i in order.tolist():
        n = int(lengths[i])
        fits = free >> n
        if fits:
            r = n + ((fits & -fits).bit_length() - 1)
            at = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            r, at, made = size, made, made + 1
        place[i], offset[i] = at, size - r
        if r > n:
            room[r - n].append(at)
            free |= 1 << (r - n)
    return place, offset, made


def pack_group(group: pd.DataFrame, size: int = SIZE) -> pd.DataFrame:
    """One partition packed; ``settled`` is false for the documents of unfilled sequences if a gap to the bound is left."""
    group = group.sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
    lengths = group["length"].to_numpy()
    place, offset, made = best_fit(lengths, size)
    gap = made > lower_bound(np.bincount(lengths, minlength=size + 1), size)
    filled = np.bincount(place, weights=lengths, minlength=made) == size
    return group.assign(bin=place, offset=offset, settled=filled[place] | (not gap))


def pack(items: DataFrame, size: int = SIZE, group_rows: int = 8192, rounds: int = 4) -> DataFrame:
    """Packs ``items`` (item, length of 1 to ``size``, other columns) into sequences: adds sequence_id and offset.

    Each round deals what is not settled to about one partition for ``group_rows`` items, by a hash of item and round;
    the last round settles everything.
    """
    schema = T.StructType([*items.schema.fields])  # the frame's own must stay as it is
    for name, kind in (("part", "long"), ("bin", "long"), ("offset", "long"), ("settled", "boolean")):
        schema = schema.add(name, kind)
    done, left, count, used = None, items, items.count(), 0
    for turn in range(rounds):
        parts = max(1, -(-count // group_rows))
        dealt = left.withColumn("part", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(parts)))
        out = materialize(dealt.groupBy("part").applyInPandas(lambda g: pack_group(g, size), schema), "packed")
        last = turn == rounds - 1 or parts == 1
        settled = (out if last else out.where("settled")).withColumn(
            "sequence_id", (F.col("part") + F.lit(used)) * (1 << 32) + F.col("bin")).drop("part", "bin", "settled")
        done = settled if done is None else done.unionByName(settled)
        used += parts
        if last:
            break
        left = out.where("NOT settled").select(*items.columns)
        count = left.count()
        if not count:
            break
    return done


def packed_sequences(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with the end token. Rows that repeat an id are packed each on their own.
    """
    def cut(texts: list) -> list[tuple]:
        end = np.array([END_ID], "<u4").tobytes()
        made = []
        for k in range(0, len(texts), 512):
            made += [(pieces_of(ids + end),) for ids in ids_of([t or "" for t in texts[k:k + 512]], path)]
        return made

    fields = "pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>"
    made = map_column(packed(docs, [key], text=text, key=key).select("key", "text"), "text", fields, cut, ["key"])
    pieces = materialize(made.select("key", F.explode("pieces").alias("p")).select(
        F.col("key").alias("doc_id"), "p.*").withColumn("item", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == SIZE).withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_id", -F.col("item") - 1)
    return pack(pieces.where(F.col("length") < SIZE)).unionByName(whole).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return packed_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))
