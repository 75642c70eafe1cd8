"""The corpus operators against brute force, round trips and held-out rows, with odd inputs."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from meterlake.llm import context_tree, html_text, jaccard, mixing, motion_jpeg, packing, quality_rules, sharding, toxicity, url_filter

SCHEMA = "doc_id long, text string, source string, key string, n_words int"
ODD = [None, "", " \t\n", "one", "a b", "x " * 50, "é ü ñ ß " * 30, "line\nline\nline with words\n\n", "a" * 5000]


def documents(n=120, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 6))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(15, 120))) for _ in range(n)]
    for i in range(0, n, 6):  # near copies: one word in forty changed
        base = texts[i].split()
        base[len(base) // 2] = "changed"
        texts.append(" ".join(base))
    return [*texts, *texts[:10], *ODD]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 11 == 0 else f"s{i % 3}", "clash", 5) for i, t in enumerate(documents())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_quality_counts(docs):
    got = {r.doc_id: r for r in quality_rules.op1(docs).collect()}
    for r in docs.collect():
        w = words(r.text)
        runs = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if runs[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n")]
        dups = sum(bool(x.split()) and x in lines[:i] for i, x in enumerate(lines))
        g = got[r.doc_id]
        assert (g.n_words, g.n_repeat_words, g.n_dup_lines) == (len(w), len(covered), dups)
        assert g.word_chars == sum(len(x.decode()) for x in w)
        assert g.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (g.base_failed and g.kept)


def test_bad_host_goes(spark):
    rows = [(i, "word " * 40 if i % 10 else " ".join(f"w{j}" for j in range(60)), "bad", "", 0) for i in range(60)]
    rows += [(100 + i, " ".join(f"w{j}" for j in range(60)), "good", "", 0) for i in range(60)]
    got = quality_rules.op1(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got if r.kept} == set(range(100, 160))


def test_jaccard_against_all_pairs(docs):
    rows = docs.collect()
    sets = {}
    for r in rows:
        w = words((r.text or "").lower())
        sets[r.doc_id] = {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= Fraction(9, 10):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op8(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert len({c for _, c in got.values()}) < len(got)


def components_by_brute_force(sets, percent):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def check_sets(spark, sets, percent=90):
    """Sets of words, as texts with shingles of one word."""
    rows = [(i, " ".join(sorted(s))) for i, s in enumerate(sets)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1, percent=percent).collect()
    assert {r.key: r.component for r in got} == components_by_brute_force(dict(enumerate(sets)), percent)


def by_hash(stem, n):
    return sorted((f"{stem}{i}" for i in range(n)), key=lambda w: int(jaccard.shingle_hashes(w, 1)[0]))


def test_jaccard_chain_between_two_pivots(spark):
    """The one link between two large groups joins a set near the first pivot with one near the second."""
    core = by_hash("c", 200)
    a, b = {f"a{i}" for i in range(10)}, {f"b{i}" for i in range(10)}
    p0, p1 = {*core} - {*core[-10:]} | a, {*core} - {*core[-20:-10]} | b
    x1, x2 = {*core, "x1"} | a, {*core, "x2"} | b
    groups = [p - {core[100 + i]} for p in (p0, p1) for i in range(13)]
    sets = [p0, p1, x1, x2, *groups]
    assert set(components_by_brute_force(dict(enumerate(sets)), 90).values()) == {0}
    check_sets(spark, sets)


def test_jaccard_versions(spark):
    """Random walks of versions round several bases, in regions of well over 16 sets."""
    rng = random.Random(7)
    sets = []
    for family in range(2):
        base = [f"f{family}w{i}" for i in range(110)]
        heads = [{*base}]
        for step in range(45):
            at = {*rng.choice(heads)}
            for w in rng.sample(sorted(at & {*base}), min(rng.randint(1, 6), len(at & {*base}))):
                at.remove(w)
            at |= {w for w in rng.sample(base, rng.randint(0, 5))} | ({f"n{family}{step}"} if step % 3 == 0 else set())
            heads.append(at)
        sets += heads
    check_sets(spark, sets, 80)


def test_jaccard_far_pivot_keeps_linked_sets(spark):
    """A large set that shares only the region's shingle is a pivot between those of two linked sets."""
    core = by_hash("w", 100)
    x, y = {*core} - {*core[-4:]} | {f"x{i}" for i in range(3)}, {*core} - {*core[-8:]} | {f"y{i}" for i in range(3)}
    wide = {f"q{i}" for i in range(293)}
    groups = [{*core, f"v{i}", f"u{i}"} for i in range(20)]
    others = [wide | {f"o{k}p{i}" for i in range(100)} for k in range(70)]
    sets = [{*core}, x, y, wide | {*core[:7], "one"}, *groups, *others]
    assert components_by_brute_force(dict(enumerate(sets)), 90)[2] == 0
    check_sets(spark, sets)


def test_jaccard_sizes_that_no_link_allows(spark, monkeypatch):
    """Every word is in one set of 20 and one of 200, so early shingles meet by chance; no such pair is asked for."""
    asked, distances = [], jaccard.Comparison.distances
    monkeypatch.setattr(jaccard.Comparison, "distances", lambda self, pairs: asked.append(pairs.count()) or distances(self, pairs))
    check_sets(spark, [{f"w{i}" for i in range(k, k + n)} for n in (20, 200) for k in range(0, 1000, n)])
    assert sum(asked) == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_jaccard_sizes_of_neighbouring_bands(spark, percent):
    """Chains of growing sets, whose links cross the bands of sizes, and sets of the sizes round each band's end."""
    core = by_hash("g", 220)
    chain = [{*core[:n]} for n in range(8, 220, 7)]
    ends = [{f"e{k}w{i}" for i in range(n)} for k in (18, 45, 90, 99, 180) for n in (k, -(-100 * k // percent) - 1, 100 * k // percent, 100 * k // percent + 1)]
    check_sets(spark, [*chain, *ends], percent)


def test_shingle_classes(spark):
    texts = ["a b a b", None, "c " * 9, *documents(20)]
    counts = Counter(int(h) % 64 for t in texts for h in jaccard.shingle_hashes(t, 2))
    got = jaccard.shingle_classes(spark.createDataFrame([(t,) for t in texts], "text string"), 2, 64)
    assert got.tolist() == [max(counts[k], 1).bit_length() - 1 for k in range(64)]


def staged(spark, name):
    return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).glob(f"{name}-*")}


def test_near_duplicates_drop_what_they_no_longer_read(spark, docs, monkeypatch):
    """The sketch of all rows goes before pairs are looked for; at the end one narrow table stays."""
    before, during, build = {n: staged(spark, n) for n in ("sketch", "*")}, [], jaccard.rare_regions
    monkeypatch.setattr(jaccard, "rare_regions", lambda *a: during.append(staged(spark, "sketch") - before["sketch"]) or build(*a))
    rows = jaccard.near_duplicates(docs).count()
    left = staged(spark, "*") - before["*"]
    assert during == [set()] and rows == docs.count() and [n.split("-")[0] for n in left] == ["components"]


def test_keep_good_writes_no_copy(spark, docs):
    before = staged(spark, "quality")
    kept = quality_rules.keep_good(docs)
    assert staged(spark, "quality") == before
    want = {r.doc_id for r in quality_rules.op1(docs).collect() if r.kept}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want and len(want) < docs.count()


def test_one_of_each_keeps_columns(docs):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_pipeline_near_copies(spark):
    """Five words and 0.8: copies with a fiftieth of the words changed, or a sixth more text at the end."""
    rng = random.Random(4)
    texts = []
    for i in range(8):
        text = [f"t{i}w{rng.randrange(500)}" for _ in range(200)]
        changed = [*text]
        for k in (40, 90, 140):
            changed[k] = "changed"
        texts += [" ".join(t) for t in (text, changed, [*text, *(f"t{i}n{k}" for k in range(34))], [*text, *(f"t{i}m{k}" for k in range(70))])]
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == set(components_by_brute_force(sets, 80).values()) and len(kept) == 16


def test_mix_meets_targets(docs):
    got = mixing.op6(docs).collect()
    assert sum(r.size for r in got) == sum(len(words(r.text)) for r in docs.collect())
    sums = {}
    for r in got:
        assert r.taken in {k * r.size for k in range(4)}
        sums.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(v) - t) <= 60 for (_, t), v in sums.items())
    assert abs(sum(t for _, t in sums) - sum(r.size for r in got)) < 1e-6
    assert sorted(got) == sorted(mixing.op6(docs).collect())


def test_shards(docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    got = sharding.op5(docs).collect()
    by_text, slots = {}, {}
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        by_text.setdefault(raw, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_smallest_capacity():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = rng.integers(0, 50, 40)
        cuts = sharding.minimax_cuts(sizes, 5)
        most = max(int(p.sum()) for p in np.split(sizes, cuts))
        assert most == 0 or sharding.cuts_for(most - 1, np.cumsum(sizes), 5) is None or most <= int(sizes.max())


def test_shards_beside_a_hot_group():
    rng = np.random.default_rng(9)
    for parts in (3, 20):
        for hot in (0, 777, 4000, 9999):
            sizes = rng.integers(0, 60, 10_000)
            sizes[hot] = sizes.sum() // (parts - 1)
            cuts = sharding.minimax_cuts(sizes, 40)
            shards = np.array([p.sum() for p in np.split(sizes, cuts)])
            other = np.delete(shards, shards.argmax())
            assert len(shards) == 40 and shards.max() == sizes[hot] and other.max() <= 1.15 * other.min()
    sizes = rng.integers(0, 60, 10_000)
    sizes[[3000, 6000]] = sizes.sum()  # two groups of a third
    other = np.sort([p.sum() for p in np.split(sizes, sharding.minimax_cuts(sizes, 40))])[:-2]
    assert len(other) == 38 and other.max() <= 1.15 * other.min()


def test_shards_of_few_cells():
    rng = np.random.default_rng(8)
    for n in range(60):
        sizes = rng.integers(0, 9, n) ** 3
        cuts = sharding.minimax_cuts(sizes, 7)
        most = max(int(p.sum()) for p in np.split(sizes, cuts))
        assert len(cuts) < 7 and cuts == sorted(cuts) and (most == 0 or sharding.cuts_for(most - 1, np.cumsum(sizes), 7) is None or most == sizes.max())


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    texts = [*ODD[1:], "it's  <|endoftext|> x", "naïve “quotes”\u00a0日本", "tabs\t\t and\n\n lines ", "don't 12½ ²"]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.ids_of(texts, path)] == [
        model.encode(t, add_special_tokens=False).ids for t in texts]
    got = packing.op2(docs).collect()
    bins, pieces = {}, {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 1024
    for r in docs.collect():
        ids = np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        for p in pieces[r.doc_id]:
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
        assert sum(p.length for p in pieces[r.doc_id]) == len(ids)
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 1024 + 1


def test_bound_is_a_bound():
    rng = np.random.default_rng(5)
    for _ in range(50):
        lengths = rng.integers(1, 1025, rng.integers(1, 80))
        assert packing.lower_bound(np.bincount(lengths, minlength=1025)) <= packing.best_fit(lengths)[2]
    assert packing.lower_bound(np.bincount([600] * 7, minlength=1025)) == 7


def test_toxicity_learns(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choices("klmno", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        text = rng.choices(plain, k=40)
        if i % 4 == 0:
            text[rng.randrange(40)] = text[rng.randrange(40)] = rng.choice(["zzinsult", "qqinsult"])
        rows.append((i, " ".join(text) + ".", "s", "", 0))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000 + i, t, None, "", 0) for i, t in enumerate(ODD)]
    got = toxicity.op3(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert held and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert all(0 <= r.score < 0.5 for r in got if r.doc_id >= 1000)


def test_toxicity_beside_clashing_columns(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choices("klmno", k=5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(plain, k=30)) + (" zzinsult zzinsult" if i % 4 == 0 else ""), i, "x", 0.5) for i in range(200)]
    rows += rows[:20] + [(None, None, None, None, None), (300, "word " * 20_000 + "zzinsult zzinsult", 1, "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label_id long, toxic string, raw double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = toxicity.op3(docs, labels).collect()
    assert len(got) == len(rows) and all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_grammar_weighs_clauses():
    s = toxicity.Scorer({"idiot": 2.0})
    one = s.clause(["an", "idiot"])
    assert s.clause(["you", "idiot"]) > one > s.clause(["not", "an", "idiot"]) and s.clause("he said an idiot".split()) < s.clause("he an idiot".split())
    assert s.clause(["kill", "time"]) == 0 < s.clause(["they", "kill"])


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/a?x#y", "http://a.example.com/en/1", "http://x.net/es/1", "http://x.net/de/1", "http://com", "a://b.org?c"]
    got = {r.page_id: r for r in url_filter.op4(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("www.example.com", "/en/a", "www.example.com/en/"), ("a.example.com", "/en/1", "example.com/en/"),
        ("x.net", "/es/1", "net/es/"), ("x.net", "/de/1", None), ("com", "", None), ("b.org", "", None)]
    assert got[3].verdict == "allow" and got[4].verdict == "block" and {r.verdict for r in got.values()} <= {"allow", "block"}


def test_urls_keep_rare_strings(spark):
    """Few rejected URLs beside many different accepted ones: their long strings still tell."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    urls = [f"http://h.com/{''.join(rng.choices(letters, k=60))}" for _ in range(1500)]
    urls += [f"http://h.net/es/{''.join(rng.choices(['qzxkv', 'vjqzw'], k=8))}" for _ in range(12)]
    asked = [f"http://h.org/{'qzxkvvjqzw' * 6}", f"http://h.org/{''.join(rng.choices(letters, k=60))}"]
    rows = list(enumerate([*urls, *asked]))
    got = {r.key: r.score for r in url_filter.judged_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    held = dict(spark.createDataFrame(rows, "id long, url string").selectExpr("id", "pmod(xxhash64(url, 3), 5) = 0").collect())
    kinds = {True: [], False: []}
    for i, u in rows[:-2]:
        if not held[i]:
            kinds[".com" in u].append("\x02" + u[7:])
    counts = {yes: Counter(t[i - d:i + 1] for t in texts for i in range(1, len(t)) for d in range(5) if i >= d) for yes, texts in kinds.items()}
    after = {yes: {} for yes in kinds}
    for yes, c in counts.items():
        for s, n in c.items():
            after[yes].setdefault(s[:-1], []).append(n)

    def p(yes, s):
        below = p(yes, s[1:]) if len(s) > 1 else 1 / 256
        seen = after[yes].get(s[:-1], [])
        seen = seen if len(s) > 1 else [n for x, n in counts[yes].items() if len(x) == 1]
        return (counts[yes][s] + len(seen) * below) / (sum(seen) + len(seen)) if seen else below

    for key in (len(urls), len(urls) + 1):
        t, ratios = "\x02" + rows[key][1][7:], []
        for i in range(1, len(t)):
            s = next((t[i - d:i + 1] for d in range(4, -1, -1) if i >= d and any(t[i - d:i + 1] in c for c in counts.values())), None)
            ratios.append(np.log(p(True, s) / p(False, s)) if s else 0)
        assert abs(got[key] - np.mean(ratios)) < 1e-9


def test_html():
    page = ("<html><head><title>t</title><script>var a='</p>'</script></head><body><nav>Menu</nav><article><h1>Head &amp; more</h1><p>One\n two<br>three"
            "<p>Four <b>bold</b></p><div class='ad'>buy</div><form>send</form></article><div id='comments'>nice</div><footer>end</footer></body></html>")
    assert html_text.main_text(page) == "Head & more One two three Four bold"
    body = "<body><div class='sidebar'>x</div>" + "<p>long text here</p>" * 5 + "<footer>f</footer></body>"
    assert html_text.main_text(body) == " ".join(["long text here"] * 5)
    assert [html_text.main_text(x) for x in (None, "", "<p>", "plain")] == ["", "", "", "plain"]


def test_html_keeps_article_text():
    long, close = "A long paragraph of the article. " * 20, "The closing words of the article. " * 4
    advert = "<div class='ad'><p>Buy</p><p>now</p><p>here</p></div>"
    page = f"<body><div class='menu'><p>a</p><p>b</p><p>c</p></div><div>{f'<p>{long}</p>' * 5}{advert}<p>{close}</p></div>" + (
        f"<div class='related'><p>a</p><p>b</p><p>c</p></div><div><p>{close}</p></div></body>")
    assert html_text.main_text(page) == " ".join([long.strip()] * 5 + [close.strip()])
    page = (f"<article><div class='entry-header'><h1>Title</h1></div><div class='elementor-widget'><p>Short.</p><p>{long}</p></div>"
            f"<div class='post has-sidebar'><p>{close}</p></div><div class='share'><a href='/'>Mail</a> <a href='/'>Post</a></div>"
            f"<div class='widget'><ul><li><a href='/'>More of it</a></li></ul></div><div class='ad'>buy</div></article>")
    assert html_text.main_text(page) == f"Title Short. {long.strip()} {close.strip()}"


LONG = "A long sentence that a reader, an advertiser or the site itself wrote beside the article, of far more than eighty characters. "


@pytest.mark.parametrize("name", ["comments", "comment-list", "ad", "advertisement", "sponsored", "notice", "cookie-notice", "related", "newsletter", "share"])
def test_html_noise_however_long(name):
    text = "The article text. " * 20
    article, want = f"<h1>T</h1><p>{text}</p>", f"T {text.strip()} End."
    for inner in (f"<p>{LONG * 3}</p>", f"<h2>Head</h2><p>{LONG * 9}</p>", f"<div><div>{LONG}</div></div>"):
        noise = f"<div class='{name}'>{inner}</div>"
        assert html_text.main_text(f"<body><article>{article}{noise}<p>End.</p></article></body>") == want
        assert html_text.main_text(f"<body>{noise}<div>{article}<p>End.</p></div>{noise}</body>") == want
        assert html_text.main_text(f"<body><main>{article}<p>End.</p></main>{noise}</body>") == want


def test_html_runs_decide_between_articles():
    teaser = "<nav>x</nav><p>a</p>".join(["<article><p>More</p></article>"] * 2)
    gap = "<nav>a</nav><div class='ad'>b</div><nav>c</nav><div class='ad'>d</div>"
    page = f"<body><article><p>{LONG * 5}</p>{gap}<p>Short.</p></article>{gap}{teaser}</body>"
    assert html_text.main_text(page) == f"{(LONG * 5).strip()} Short."


def test_html_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        lengths = [rng.choice([0, 0, 0, 5]) for _ in range(rng.randint(0, 30))]
        text = [i for i, n in enumerate(lengths) if n]
        want = []  # lines with text fewer than a window apart are one run, which ends where the window is empty
        for i in text:
            if want and i - want[-1][-1] <= html_text.WINDOW:
                want[-1].append(i)
            else:
                want.append([i])
        got = html_text.content_runs(lengths)
        assert [[i for i in range(a, b) if lengths[i]] for a, b in got] == want


def test_pages_keep_repeated_rows_and_clashing_columns(spark):
    long = f"<article>{f'<p>{LONG}</p>' * 400}</article>"
    rows = [(1, "u", long, "clash", 7), (1, "u", long, "clash", 7), (2, None, None, None, None), (None, "u", "<p>x", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.op9(df).collect()), key=str)
    text = " ".join([LONG.strip()] * 400)
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "u", "x", 1)], key=str)


def test_media_round_trip(docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in motion_jpeg.op10(docs).collect():
        raw = (text[r.doc_id] or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    levels = np.random.default_rng(1).integers(0, 256, (5, motion_jpeg.FRAME)).astype(np.uint8)
    levels[3:] = 7
    assert (motion_jpeg.decode_frames(motion_jpeg.encode_frames(levels)) == levels).all()
    assert motion_jpeg.shots(levels) == [(0, 3), (3, 5)]


def test_context_tree(docs):
    got = {r.doc_id: r for r in context_tree.op7(docs).collect()}
    train, total = Counter(), 0
    text = {r.doc_id: r.text for r in docs.collect()}
    for i, t in text.items():
        if zlib.crc32(str(i).encode()) % 10:
            train.update([*words((t or "").lower()), b""])
    n, v = sum(train.values()), len(train)
    for i, t in text.items():
        tokens = [*words((t or "").lower()), b""]
        base = sum(np.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(tokens), sum(train[w] > 0 for w in tokens), n) and abs(g.base_score - base) < 1e-6
        total += g.score - base
        assert g.score < 0


def test_context_tree_sums_to_one():
    text = [b"abracadabra abracadabra\n", b"banana band\n"]
    codes, _ = context_tree.string_codes(text, 3)
    seen, counts = np.unique(codes, return_counts=True)
    context = int(seen[5]) >> 8 << 8
    every = np.unique(np.concatenate([seen, context + np.arange(256)]))
    n = np.array([dict(zip(seen.tolist(), counts.tolist(), strict=True)).get(c, 0) for c in every.tolist()])
    parts = {}
    for pair in np.unique((every >> 8) & 65535):
        mine = ((every >> 8) & 65535) == pair
        for k in range(8):
            top = context_tree.lower_levels(every[mine], n[mine], 3, k)[-1][0]
            for node, *v in zip(top.nodes & 65535, top.zeros, top.ones, top.log_pw, strict=True):
                parts[node] = np.add(parts.get(node, np.zeros(3)), v)
    one, zero = context_tree.upper_levels(np.array(list(parts)), *np.array(list(parts.values())).T)
    mine = ((every >> 8) & 65535) == (context >> 8) & 65535
    p = 10 ** context_tree.code_lengths(every[mine], n[mine], 3, one, zero)
    assert abs(p[(every[mine] >> 8 << 8) == context].sum() - 1) < 1e-9


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert [df.count() for df in (quality_rules.op1(empty), packing.op2(empty), toxicity.op3(empty, labels), url_filter.op4(pages), sharding.op5(empty), mixing.op6(empty),
                                  context_tree.op7(empty), jaccard.op8(empty), html_text.op9(pages), motion_jpeg.op10(empty))] == [0] * 10
