"""Spelling variants, byte pairs and centroid clustering against brute force, a public library and SQL, with odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from meterlake.llm import byte_pairs, spelling, walsh

SCHEMA = "doc_id long, text string, n int, word string, ids string, cluster string"


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, 3, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# ---------------------------------------------------------------- spelling variants

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def vocabulary(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def variants_by_brute_force(words):
    found = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        form = min(near, key=lambda x: (-words[x], x), default=None)
        found[w] = (form if form and words[form] >= 10 * n else None, n, len(near))
    rows = set()
    for w, (form, n, near) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        rows.add((w, form, root, n, near, words[form] if form else None))
    return rows


def test_variants_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abÀß", k=rng.randint(6, 9))) for _ in range(60)]
    texts = []
    for k in range(150):
        line = []
        for _ in range(80):
            w = list(rng.choice(base[:10] if rng.random() < 0.8 else base))
            if rng.random() < 0.2:
                w[rng.randrange(len(w))] = rng.choice(["", "aa", "B", "ß"])
            line.append("".join(w))
        texts.append(rng.choice([" ", ", ", "\n", "1"]).join(line))
    texts += [None, "", "x", "été×÷àà " * 3, ("ab" * 4000 + " ") * 2, ("ab" * 4000 + "a ") * 3, "a" * 3000 + " " + "a" * 3000]
    ids = [None if i == 7 else i % 140 for i in range(len(texts))]
    got = spelling.op11(frame(spark, texts, ids))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants_by_brute_force(vocabulary(zip(ids, texts, strict=True)))
    rows = {tuple(r) for r in got.collect()}
    assert rows == want and len(want) > 100 and max(r[4] for r in rows) > 5 and any(len(r[0]) > 5000 and r[4] for r in rows)


def test_roots_follow_chains(spark):
    words = {"abcdefgh": 1, "abcdefgx": 10, "abcdefyx": 100, "abcdezyx": 1000, "zzzzzzz": 1000, "zzzzzzzz": 100, "bbbbbbbb": 100, "bbbbbbbc": 9, "bbbbbbba": 100}
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == variants_by_brute_force(words)
    assert ("abcdefgh", "abcdefgx", "abcdezyx", 1, 1, 10) in got and ("bbbbbbbc", "bbbbbbba", "bbbbbbba", 9, 2, 100) in got


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(3)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        firsts, lasts = ([rng.randrange(50) for _ in places] for _ in range(2))
        a, b = spelling.disjoint(places, firsts, lasts)
        cost = dict(zip(places, firsts, strict=True))[a] + dict(zip(places, lasts, strict=True))[b]
        assert b >= a + 2 and cost == min(firsts[i] + lasts[k] for i, x in enumerate(places) for k, y in enumerate(places) if y >= x + 2)


# ---------------------------------------------------------------- byte pairs

@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, pattern = byte_pairs.public_ranks()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_pairs.ranks_of(path).ids, special_tokens={})


ODD = [None, "", " ", "a", "\x1c\x85 x ", "it's <|endoftext|> I'LL", "naïve “quotes” 日本 ²½", "a" * 5000, " " * 3000, "ab" * 4000, "é ퟿\U0001f600" * 50,
       "word " * 20_000, "same", "same"]


def test_byte_pairs_as_the_library(spark, library):
    rng = random.Random(2)
    texts = [*ODD, *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD800), rng.randrange(0x10000, 0x110000)])) for _ in range(300)) for _ in range(20))]
    got = {}
    for r in byte_pairs.op12(frame(spark, texts)).collect():
        got[r.doc_id] = tuple(r)[1:]
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert len(got) == len(texts)


def test_trees_merge_the_leftmost_least_pair():
    """Against merging by scanning all pairs, with ranks in which ties and long chains abound."""
    path, _ = byte_pairs.public_ranks()
    ranks, rng = byte_pairs.ranks_of(path), random.Random(4)

    def plain(word):
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            pairs = [(ranks.ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks.ids]
            if not pairs:
                return [ranks.ids[p] for p in parts]
            i = min(pairs)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    words = ["".join(rng.choices(rng.choice(["ab", "the ", "aaab", "tion\n"]), k=rng.randint(1, 200))).encode() for _ in range(300)]
    want = [plain(w) for w in words]
    assert [np.frombuffer(b, "<u4").tolist() for b in byte_pairs.encode_words(words, ranks)] == want
    assert [byte_pairs.merge_long(w, ranks) for w in words if len(w) > 1] == [x for w, x in zip(words, want, strict=True) if len(w) > 1]


def test_memory_of_matches_is_bounded(monkeypatch, library):
    monkeypatch.setattr(byte_pairs, "REMEMBERED", 50)
    monkeypatch.setattr(byte_pairs, "SLICE", 200)
    path, pattern = byte_pairs.public_ranks()
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdef", k=5)) for _ in range(30)) for _ in range(60)]
    got = [np.frombuffer(b, "<u4").tolist() for b in byte_pairs.encode_texts([*texts, None], path, pattern)]
    assert got == [library.encode_ordinary(t) for t in texts] + [[]] and len(byte_pairs.remembered(path)) <= 250


def test_encode_and_decode_keep_columns(spark):
    coded = byte_pairs.encode(frame(spark, ["two words", None]))
    assert coded.columns == ["doc_id", "text", "n", "word", "cluster", "ids"]
    back = {r.doc_id: r.decoded for r in byte_pairs.decode(coded).collect()}
    assert back == {0: b"two words", 1: b""}
    odd = spark.createDataFrame([(1, None), (2, [50_256]), (3, [-1]), (4, [0])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in byte_pairs.decode(odd).collect()} == {1: None, 2: None, 3: None, 4: b"!"}


# ---------------------------------------------------------------- clusters

def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(9, 64))
    return (middle[rng.integers(0, 9, n)] + 0.3 * rng.normal(size=(n, 64))).astype(np.float32)


def clusters_by_sql(rows):
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
    con = duckdb.connect()
    con.register("embeddings", table)
    return sorted(con.execute(walsh.SQL).fetchall())


def test_clusters_equal_sql(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors(400))]
    rows += [(500 + i, [1.5] * 64) for i in range(30)]  # ties
    rows += [rows[3], rows[3], (700, None), (701, []), (702, [1.0] * 63), (703, [1.0] * 65), (704, [float("nan")] * 64), (705, [float("inf")] + [0.0] * 63), (706, [None] + [0.0] * 63)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, cluster string, distance int").repartition(5)
    got = sorted(tuple(r) for r in walsh.op13(df).collect())
    assert got == clusters_by_sql(rows) and len(got) == 432


@pytest.mark.parametrize("n", [1, 5, 16])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors(n))]
    got = sorted(tuple(r) for r in walsh.op13(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == clusters_by_sql(rows) and {r[2] for r in got} == {0}


def test_search_is_exact_and_eliminates():
    rng = np.random.default_rng(6)
    for scale in (1, 40, walsh.LARGEST - 1):
        v, c = (rng.integers(-scale, scale + 1, (n, 64)) for n in (700, 16))
        v[:50] = c[rng.integers(0, 16, 50)]
        c[7] = c[3]
        plain = ((v[:, None, :] - c[None, :, :]).astype(object) ** 2).sum(2)
        cluster, distance, compared = walsh.nearest(walsh.transform(v), walsh.transform(c))
        assert (cluster == plain.argmin(1)).all() and (distance == plain.min(1)).all()
        assert (walsh.inverse(walsh.transform(v)) == v).all() and 7 not in cluster
    near = c[rng.integers(0, 16, 700)] + rng.integers(-3, 4, (700, 64))
    assert walsh.nearest(walsh.transform(near), walsh.transform(c))[2] < 700 * 16 * 64 / 3


def test_empty_tables(spark):
    docs, none = frame(spark, ["x"]).limit(0), spark.createDataFrame([], "vec_id long, embedding array<float>")
    found = [spelling.op11(docs), byte_pairs.op12(docs), walsh.op13(none)]
    assert [df.count() for df in found] == [0, 0, 0]
    assert found[2].columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
