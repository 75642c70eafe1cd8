"""Byte-level BPE, encoding and decoding, by segment trees over byte positions.

Text is cut by the pre-tokenizer's pattern and each match encoded for itself. A leaf of a match's tree holds the rank of
the pair of tokens that begins at its byte, an inner node the least rank below it and the leftmost place of that rank, so
the root names the next merge. A merge takes the right token's byte out of the list of live neighbours and sets three
leaves anew (the merged token's, the taken one's, the left neighbour's); each setting climbs to the root.

The distinct matches of some texts are merged side by side, one tree a row of an array. Matches of more than ``LONG``
bytes have a tree of their own, so a match of n bytes takes n log n steps, however long.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Greater than every rank and place in a tree: no pair of tokens here.
NONE = np.int64(1) << 62
#: Matches of more bytes are merged one at a time.
LONG = 128
#: Leaves of trees that are merged side by side at once, characters that are cut at once, and matches a worker remembers.
LEAVES, SLICE, REMEMBERED = 1 << 19, 1 << 20, 400_000


#: A character that versions of Unicode may class differently.
WIDE = re.compile("[^\x00-\xff]")


class Ranks:
    """A rank file: the tokens by id, and the rank of each pair of tokens that is one together."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.size = max(self.ids.values()) + 1
        self.tokens: list[bytes | None] = [None] * self.size
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ids.items():
            for k in range(1, len(token)):
                left, right = self.ids.get(token[:k]), self.ids.get(token[k:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each two tokens together, NONE where they are no token."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)


@cache
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


@cache
def remembered(path: str) -> dict[str, bytes]:
    """The ids (little-endian) of the matches that this worker has seen, ``REMEMBERED`` at most."""
    return {}


@cache
def stand_ins() -> dict[int, str]:
    """For each character that the two libraries class differently, one that ``regex`` classes as ``tiktoken`` does.

    They follow different versions of Unicode, and the matches are to be those of ``tiktoken``, which drops what its
    pattern does not match: so one pass over all characters tells its letters, numbers and spaces.
    """
    import regex
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    found: dict[str, str] = {}
    theirs: dict[str, str] = {}
    for kind, one in ((r"\p{L}", "\u0100"), (r"\p{N}", "\u00b2"), (r"\s", "\u2003")):
        model = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs.update(dict.fromkeys(bytes(model.encode_ordinary(every)).decode(), one))
        found.update(dict.fromkeys(regex.findall(kind, every), one))
    return {ord(c): theirs.get(c, "\ue000") for c in {*found, *theirs} if found.get(c) != theirs.get(c)}


@cache
def patterns(pattern: str):
    """The compiled pattern, and one for texts of the first 256 characters with its classes spelt out, which is faster."""
    import regex

    cut = regex.compile(pattern)
    sets = {kind: "".join(re.escape(chr(c)) for c in range(256) if regex.match(kind, chr(c))) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, spelt = [], False, True
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        kind = sets.get(part)
        if part in "[]":
            inside = part == "["
        elif kind is not None:
            part = kind if inside else f"[{kind}]"
        elif part == r"\S" and not inside:
            part = f"[^{sets[chr(92) + 's']}]"
        spelt &= not part.startswith((r"\p", r"\P", r"\S", r"\w", r"\W", r"\d", r"\D", r"\b", r"\B"))
        out.append(part)
    return cut, re.compile("".join(out)) if spelt else cut


def matches(text: str, pattern: str) -> list[str]:
    """The matches of the pattern, by the character classes of ``tiktoken``."""
    cut, narrow = patterns(pattern)
    if not WIDE.search(text):
        return narrow.findall(text)
    alike = text.translate(stand_ins())
    return cut.findall(text) if alike == text else [text[m.start():m.end()] for m in cut.finditer(alike)]


def merge_long(word: bytes, ranks: Ranks) -> list[int]:
    """The ids of one match, by a tree in a list."""
    n, ids = len(word), ranks.ids
    size = 1 << max(0, n - 2).bit_length()
    none = int(NONE)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def pair(i: int) -> int:
        """The value of the leaf of byte i: rank and place of its token and the next."""
        j = after[i]
        rank = ids.get(word[i:after[j]]) if j < n else None
        return none if rank is None else rank * size + i

    tree = [none] * (2 * size)
    tree[size:size + n - 1] = map(pair, range(n - 1))
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least

    while tree[1] < none:
        i = tree[1] % size
        j = after[i]
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        if j < n - 1:
            put(j, none)
        if i < n - 1:
            put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    found, i = [], 0
    while i < n:
        found.append(ids[word[i:after[i]]])
        i = after[i]
    return found


def merge_rows(words: list[bytes], leaves: int, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """All ids of ``words`` (of 2 to ``leaves`` + 1 bytes, ``leaves`` a power of two) and how many each has: a tree a row."""
    rows, width = len(words), leaves + 1
    lengths = np.fromiter(map(len, words), np.int64, rows)
    filled = np.arange(width) < lengths[:, None]
    byte = np.zeros((rows, width), np.uint8)
    byte[filled] = np.frombuffer(b"".join(words), np.uint8)
    token = ranks.single[byte].ravel()
    # neighbours by place in ``token``; the place after a word's end is the first of a spare column, so links have one column more
    after = np.tile(np.arange(1, width + 2, dtype=np.int32), (rows, 1)).ravel()
    before = np.tile(np.arange(-1, width, dtype=np.int32), (rows, 1)).ravel()
    live = filled.ravel().copy()
    tree = np.full((rows, 2 * leaves), NONE)
    value = ranks.of_pairs(token.reshape(rows, width)[:, :-1], token.reshape(rows, width)[:, 1:])
    pairs = filled[:, 1:] & (value < NONE)
    tree[:, leaves:] = np.where(pairs, value * leaves + np.arange(leaves), NONE)
    level = leaves
    while level > 1:
        below = tree[:, level:2 * level]
        level //= 2
        tree[:, level:2 * level] = np.minimum(below[:, ::2], below[:, 1::2])
    flat = tree.ravel()

    def put(row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        """Sets one leaf of each of these rows and climbs to the root."""
        base, node = row * (2 * leaves), place + leaves
        flat[base + node] = value
        while leaves > 1 and node[0] > 1:
            node = node >> 1
            at = base + 2 * node
            flat[base + node] = np.minimum(flat[at], flat[at + 1])

    def pair(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        rank = ranks.of_pairs(token[row * width + i], token[row * width + j])
        return np.where(rank < NONE, rank * leaves + i, NONE)

    row = np.arange(rows)
    while True:
        root = flat[row * (2 * leaves) + 1]
        row, root = row[root < NONE], root[root < NONE]
        if not len(row):
            break
        rank, i = np.divmod(root, leaves)
        links = row * (width + 1)
        j = after[links + i].astype(np.int64)
        k = after[links + j].astype(np.int64)
        token[row * width + i] = rank
        live[row * width + j] = False
        after[links + i] = k
        before[links + k] = i
        inner = j < leaves  # the last byte has no leaf
        put(row[inner], j[inner], NONE) if inner.any() else None
        ends = k >= lengths[row]
        value = np.where(ends, NONE, pair(row, i, np.where(ends, i, k)))
        put(row, i, value)
        left = before[links + i].astype(np.int64)
        has = left >= 0
        if has.any():
            put(row[has], left[has], pair(row[has], left[has], i[has]))
    live = live.reshape(rows, width)
    return token.reshape(rows, width)[live], live.sum(1)


def encode_words(words: list[bytes], ranks: Ranks) -> list[bytes]:
    """The ids of each match as little-endian unsigned 32-bit numbers; a match that is a token as a whole is that token."""
    found: list[bytes] = [b""] * len(words)
    groups: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        if len(word) < 2:
            found[at] = np.array([ranks.ids[word]] if word else [], "<u4").tobytes()
        elif len(word) > LONG:
            found[at] = np.array(merge_long(word, ranks), "<u4").tobytes()
        else:
            groups.setdefault(1 << (len(word) - 2).bit_length(), []).append(at)
    for leaves, group in groups.items():
        for k in range(0, len(group), max(1, LEAVES // leaves)):
            part = group[k:k + max(1, LEAVES // leaves)]
            ids, counts = merge_rows([words[at] for at in part], leaves, ranks)
            raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
            for at, start, end in zip(part, (ends - 4 * counts).tolist(), ends.tolist(), strict=True):
                found[at] = raw[start:end]
    for at, word in enumerate(words):
        if len(found[at]) > 4 and (whole := ranks.ids.get(word)) is not None:
            found[at] = np.array([whole], "<u4").tobytes()
    return found


def slices(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, as many together as have about ``SLICE`` characters."""
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_texts(texts: list[str | None], path: str, pattern: str) -> Iterator[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers."""
    ranks, known = ranks_of(path), remembered(path)
    for part in slices(texts):
        pieces = [matches(text, pattern) for text in part]
        new = list(set().union(*pieces) - known.keys())
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set().union(*pieces))
        known.update(zip(new, encode_words([w.encode("utf-8", "surrogatepass") for w in new], ranks), strict=True))
        yield from (b"".join(map(known.__getitem__, p)) for p in pieces)
        for word in new:  # long ones are not kept
            if len(word) > LONG:
                del known[word]


def list_array(values: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(v) // 4 for v in values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(values), "<u4").astype(np.int32)))


def public_ranks() -> tuple[str, str]:
    """Rank file and pattern of the public 50k vocabulary, where every worker has them."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def added(df: DataFrame, column: str, name: str, kind: T.DataType, make) -> DataFrame:
    """All columns of ``df`` and ``name``, which ``make`` computes from a batch of ``column``; an old column ``name`` gives way."""
    keep = [c for c in df.columns if c != name]
    schema = df.select(*(F.col(f"`{c}`") for c in keep)).schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), make(part.column(column))], names=[*keep, name])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the column ``ids`` (array<int>), the token ids of ``text``; a null text has none, as the empty one.

    Every row is encoded for itself and whole, repeated rows and very long texts too; text of special tokens is plain
    text. The file of ``path`` must lie on every worker (default: the public 50k vocabulary and its pattern).
    """
    own_path, own_pattern = (path, pattern) if path and pattern else public_ranks()
    return added(df, text, ids, T.ArrayType(T.IntegerType()), lambda c: list_array(list(encode_texts(c.to_pylist(), path or own_path, pattern or own_pattern))))


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds ``to`` (binary), the bytes of the ids; null where they are null or hold an id that is none."""
    own_path = path or public_ranks()[0]

    def make(column: pa.Array) -> pa.Array:
        ranks = ranks_of(own_path)
        found = column.flatten().cast(pa.int64()).fill_null(-1).to_numpy()
        held = np.array([t is not None for t in ranks.tokens])
        known = (found >= 0) & (found < ranks.size)
        known[known] = held[found[known]]
        bad = np.concatenate([[0], np.cumsum(~known)])
        out, start, token = [], 0, ranks.tokens.__getitem__
        for n in column.value_lengths().to_pylist():
            end = start + (n or 0)
            out.append(None if n is None or bad[end] > bad[start] else b"".join(map(token, found[start:end].tolist())))
            start = end
        return pa.array(out, pa.binary())

    return added(df, ids, to, T.BinaryType(), make)


def op12(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; rows of one doc_id stay rows of their own."""
    coded = encode(docs.select("doc_id", "text"))
    back = decode(coded.drop("text"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
