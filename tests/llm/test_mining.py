"""Phrases, spelling variants and nearest neighbours against plain code, on odd rows and on the smallest tables."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagemill.llm import nearest, phrases, queries, spelling

TINY = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.read.parquet(f"{TINY}/documents.parquet")


@pytest.fixture(scope="module", params=["odd", "tiny"])
def docs(request):
    return request.getfixturevalue(request.param)


# ---- phrases


def plain_phrases(rows, min_count, most):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    out = []
    for (lang, *w), a in found.items():
        if any(100 * b >= 80 * a for q, b in found.items() if q[0] == lang and len(q) > len(w) + 1 and any(list(q[i : i + len(w)]) == w for i in range(1, len(q) - len(w) + 1))):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:most]
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(mine)]
    return sorted(ranked)


@pytest.mark.parametrize("one_in", [1, 4, 64])
def test_phrases(docs, one_in):
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = sorted(map(tuple, phrases.phrase_collocations(docs, min_count=4, most=40, one_in=one_in).collect()))
    assert got == plain_phrases(rows, 4, 40) and got


def test_phrases_of_a_filter_that_is_full(tiny, monkeypatch):
    """A bitmap in which everything is found changes no result."""
    want = sorted(map(tuple, phrases.phrase_collocations(tiny, min_count=5).collect()))
    monkeypatch.setattr(phrases, "pair_bitmap", lambda pairs: np.full(phrases.FILTER_BITS // 8, 255, np.uint8))
    monkeypatch.setattr(phrases, "MAX_HELD", 1000)
    assert sorted(map(tuple, phrases.phrase_collocations(tiny, min_count=5).collect())) == want


def test_chunks_own_every_word_once():
    rng = random.Random(3)
    texts = ["", "  \t ", "a b c d e f g h, i j", "x  y\t\tz", "one.two", "The THE the the the the", " ".join(rng.choice("abc") for _ in range(3000))]
    for one_in in (1, 3, 1000):
        of, chunk, owned = phrases.parse([t.encode() for t in texts], phrases._Words(), one_in)
        for i, t in enumerate(texts):
            mine = [(c.decode().split(" "), n) for o, c, n in zip(of, chunk, owned, strict=True) if o == i]
            want = [w for piece in re.split("[.,;:!?\n-\r]", t.translate(LOWER)) for w in re.findall(r"[^\x20\x09]+", piece)]
            assert [w for c, n in mine for w in c[:n]] == want
            assert all(n <= len(c) <= n + phrases.OVERLAP for c, n in mine)
    # The parse depends on content: copies give equal chunks.
    _, a, _ = phrases.parse([b"p q r s t u v w x y z"], phrases._Words(), 2)
    _, b, _ = phrases.parse([b"0 1 2. p q r s t u v w x y z"], phrases._Words(), 2)
    assert set(a) <= set(b)


def test_copies_are_one_chunk_with_its_frequency(spark):
    df = spark.createDataFrame([(i, "one two three four five. " * 3, "en") for i in range(50)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in phrases.chunk_dictionary(df, one_in=10**9).collect()] == [("en", "one two three four five", 5, 150)]


def test_scores_pass_64_bits(spark, monkeypatch):
    """Counts of 10^13 are multiplied exactly."""
    big = 10**13 + 7
    rows = [("en", 1, "a", big + 3), ("en", 1, "b", big + 5), ("en", 2, "a b", big)]
    monkeypatch.setattr(phrases, "count_phrases", lambda d, n, frequent=None: spark.createDataFrame(rows if frequent is None else [], "lang string, size int, phrase string, f long"))
    df = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in phrases.phrase_collocations(df).collect()] == [("en", 1, "a b", big, big + 3, big + 5, 2, 2_000_000 * big // (2 * big + 8))]


def test_no_phrases(none, spark):
    assert phrases.phrase_collocations(none).count() == 0
    assert phrases.phrase_collocations(spark.createDataFrame([(1, None, None), (2, ",,", "")], "doc_id long, text string, lang string")).count() == 0


# ---- spelling


def plain_words(rows, min_size, min_count):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= min_size and c >= min_count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_variants(words, times=5):
    close = collections.defaultdict(set)
    for a in words:
        for b in words:
            if abs(len(a) - len(b)) < 2 and near(a, b):
                close[a].add(b)
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    root = {}
    for w in words:
        r = w
        while form[r] is not None:
            r = form[r]
        root[w] = r
    return sorted((w, form[w] or "", root[w], n, len(close[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def told(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_spelling_variants(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert told(spelling.spelling_variants(docs, min_count=2)) == plain_variants(plain_words(rows, 6, 2))


def random_words(seed, n):
    """Words close to each other: few letters, some beyond ASCII, of every length from 6 on."""
    rng = random.Random(seed)
    words = {}
    for _ in range(n):
        base = "".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 8, 9, 13])))
        words[base] = 5 * 6 ** rng.randrange(6)
        i = rng.randrange(len(base))
        for other in (base[:i] + base[i + 1 :], base[:i] + "z" + base[i + 1 :], base[:i] + "y" + base[i:], base + "x"):
            if len(other) >= 6:
                words.setdefault(other, 5 + rng.randrange(9))
    return words


@pytest.mark.parametrize("max_shared", [10**9, 3, 1])
def test_pairs_are_found_however_many_share_a_chunk(spark, max_shared):
    words = random_words(7, 60)
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    got = sorted((r.a, r.b) for r in spelling.near_pairs(df, max_shared).collect())
    want = sorted((a, b) if (len(a), a) < (len(b), b) else (b, a) for a in words for b in words if a < b and near(a, b))
    assert got == want and len(want) > 200


def test_forms_lead_to_roots(spark):
    """A chain of forms, each five times as frequent, and a tie."""
    words = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx", "abcvwzyx"]
    texts = [(i, " ".join([w] * 5 * 6**i)) for i, w in enumerate(words)]
    texts += [(90, "qqqqqqa " * 5), (91, "qqqqqqb " * 30), (92, "qqqqqqc " * 30)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.word: r for r in spelling.spelling_variants(df).collect()}
    kept = [w for w in words if w in got]
    assert {got[w].root for w in kept} == {kept[-1]} and len(kept) >= 5
    assert got["qqqqqqa"].form in ("qqqqqqb", "qqqqqqc") and told(spelling.spelling_variants(df)) == plain_variants(plain_words(texts, 6, 5))


def test_no_words(none):
    assert spelling.spelling_variants(none).count() == 0


# ---- neighbours


def plain_nearest(rows, asks, k):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        best.setdefault(i, []).append(np.array(v, float))
    out = []
    for q in sorted(i for i in best if asks(i)):
        a = min(best[q], key=lambda v: v.tolist())
        scores = {}
        for i, vs in best.items():
            for b in vs:
                if i != q and len(a) == len(b):
                    scores[i] = max(scores.get(i, -2), float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))))
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]):
            out.append((q, rank + 1, i, round(s, 9)))
    return out


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


def test_nearest_on_the_smallest_table(spark):
    e = spark.read.parquet(f"{TINY}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    assert found(queries.op13_nearest_neighbours(spark, TINY)) == plain_nearest(rows, lambda i: i % 50 == 0, 5)


def odd_vectors(spark):
    rng = np.random.default_rng(4)
    some = [(i, [float(x) for x in rng.standard_normal(16).astype(np.float32)]) for i in range(300)]
    copies = [(1000 + i, some[7][1]) for i in range(200)] + [(50, some[50][1])] * 3 + [(2000, some[0][1]), (2000, some[1][1])]
    twice = [(1500, [2 * x for x in some[7][1]])]
    odd = [(3, None), (4, []), (5, [0.0] * 16), (6, [None] * 16), (7, [float("nan")] + [1.0] * 15), (8, [float("inf")] * 16), (None, some[3][1]), (150, [1.0, 2.0]), (9, [2.0, 1.0]), (10, [3e38] * 16), (11, [1e-38] * 16)]
    return some + copies + twice + odd, spark.createDataFrame(some + copies + twice + odd, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("score", "rank", "query_id", "code", "vector", "q")}).repartition(5)


@pytest.mark.parametrize("block", [nearest.MAX_BLOCK_BYTES, 3 * 8 * 16])
def test_nearest_of_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "MAX_BLOCK_BYTES", block)
    rows, df = odd_vectors(spark)
    asks = lambda i: i % 50 == 0 or i == 7
    want = plain_nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], asks, 5)
    got = found(nearest.nearest(df, (F.col("vec_id") % 50 == 0) | (F.col("vec_id") == 7)))
    assert got == want and len({r[0] for r in got}) > 6


def test_recall_and_reranking(spark):
    """All five nearest of each query on clustered vectors, and few vectors compared exactly."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 96))
    x = (centres[rng.integers(0, 20, 6000)] + 0.8 * rng.standard_normal((6000, 96))).astype(np.float32)
    turn, bits = nearest.rotation(96, 256), 256
    q = nearest.Queries(0, x[:40].astype(float), bits)
    search = nearest.Search(q, 6)
    u = x.astype(float)
    r = (u / np.linalg.norm(u, axis=1, keepdims=True)) @ turn.T
    for at in range(0, 6000, 1500):
        s = slice(at, at + 1500)
        search.add(np.arange(6000)[s], u[s], np.packbits(r[s] > 0, axis=1), np.abs(r[s]).sum(axis=1) / 16)
    exact = (u[:40] / np.linalg.norm(u[:40], axis=1, keepdims=True)) @ (u / np.linalg.norm(u, axis=1, keepdims=True)).T
    hits = sum(len(set(search.ids[i]) & set(np.argsort(-exact[i])[:6])) for i in range(40))
    assert hits >= 0.99 * 240 and search.compared < 0.2 * 40 * 6000


def test_codes_estimate_cosines():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((500, 64)), rng.standard_normal((500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    turn = nearest.rotation(64, 256)
    assert np.allclose(turn.T @ turn, np.eye(64))
    r = a @ turn.T
    fit = np.abs(r).sum(axis=1) / 16
    guess = ((b @ turn.T) @ np.sign(r).T / 16 / fit).T
    error = guess - a @ b.T
    bound = np.sqrt(1 - fit**2) / fit / np.sqrt(255)
    assert abs(error.mean()) < 0.001 and np.mean(np.abs(error) > nearest.SIGMAS * bound[:, None]) < 0.001


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest(none, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert nearest.nearest(one, F.col("vec_id") % 50 == 0).count() == 0
