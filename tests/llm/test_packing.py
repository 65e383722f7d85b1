"""Whitening, collocations and packing against plain versions, on whole tables and on every edge."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from veilframe.llm import collocations, packing, whitening
from veilframe.llm import queries as q

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<double>, n int"


# Whitening


def plain(vectors, most=4):
    """Exact sums, eigenvectors of the covariance of the distinct x."""
    x = np.array([np.floor(256 * np.array(v)) for v in vectors]).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    e, v = np.linalg.eigh((u - s / n).T @ (u - s / n) / n)
    e, v = e[::-1], v[:, ::-1]
    k = int((e[:most] > 1e-12 * e.sum()).sum())
    return n, ((n * x.astype(object) - s) ** 2).sum(1), ((x - s / n) @ v[:, :k]) / np.sqrt(e[:k]), e[:k] / e.sum()


def compare(rows, ids, vectors):
    n, dev, w, part = plain(vectors)
    k, at = w.shape[1], {v: i for i, v in enumerate(ids)}
    assert len(rows) == k * len(ids)
    for c in range(k):
        mine = [r for r in rows if r.component == c + 1]
        assert sorted(r.vec_id for r in mine) == sorted(ids)
        got, want = np.array([r.whitened for r in mine]), np.array([w[at[r.vec_id], c] for r in mine])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
        for r in mine:
            assert r.n == n and r.deviation == dev[at[r.vec_id]] and abs(r.explained - part[c]) < 1e-9 and r.identity_error < 1e-6


def test_whitening_of_a_table(spark):
    rows = q.op11_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    compare(rows, [r.vec_id for r in table], [[float(x) for x in r.embedding] for r in table])


def test_whitening_edges(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.standard_normal(5) * [5, 3, 2, 1, 0.5] + 7], 0) for i in range(300)]
    good += [(1000 + i, good[0][1], 0) for i in range(200)]  # a hot group of copies counts once
    bad = [(2000, None, 0), (2001, [], 0), (2002, [1.0, None, 1.0, 1.0, 1.0], 0), (2003, [float("nan")] * 5, 0), (2004, [float("inf")] + [0.0] * 4, 0), (2005, [1.0] * 4, 0), (2006, [1e30] + [0.0] * 4, 0)]
    df = spark.createDataFrame(good + bad, SCHEMA).repartition(40)
    compare(whitening.whitened(df).collect(), [r[0] for r in good], [r[1] for r in good])
    shape = "vec_id component n deviation whitened explained identity_error".split()
    for few in (bad[:4], good[300:], []):
        out = whitening.whitened(spark.createDataFrame(few, SCHEMA))
        assert out.columns == shape and out.count() == 0
    flat = [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(10)]  # one direction only
    assert {r.component for r in whitening.whitened(spark.createDataFrame(flat, SCHEMA)).collect()} == {1}


def test_merging_keeps_all_dimensions():
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, (4000, 6)) @ rng.integers(-2, 3, (6, 9))
    parts = [whitening.State.of(p) for p in np.split(x, [1, 3, 700, 1500])]
    for order in ([0, 1, 2, 3, 4], [4, 2, 0, 3, 1]):
        s = parts[order[0]]
        for k in order[1:]:
            s = s.merged(parts[k])
        c = x - x.mean(0)
        assert s.n == 4000 and (s.sums == x.sum(0)).all()
        assert np.abs((s.values[:, None] * s.vectors).T @ (s.values[:, None] * s.vectors) - c.T @ c).max() < 1e-6 * (c**2).sum()


def test_whitening_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "STATE_BYTES", 1)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(4)], 0) for i in range(200)]
    compare(whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(13)).collect(), [r[0] for r in rows], [r[1] for r in rows])


def test_deviation_beyond_a_long():
    x, s = np.array([[1 << 30], [3]]), np.array([7])
    assert whitening.deviations(x, 10**6, s).to_pylist() == [None, (3 * 10**6 - 7) ** 2]


# Collocations


def mined(rows, least, top=2000):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    often, around = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}, collections.Counter()
    for (lang, p), v in often.items():
        for i, j in itertools.combinations(range(len(p) + 1), 2):
            if j - i < len(p):
                around[lang, p[i:j]] = max(around[lang, p[i:j]], v)
    found = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if around[lang, p] < a:
            s, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang].append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in found.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


@pytest.mark.parametrize(("least", "slots", "top"), [(20, 2000, 2000), (12, collocations.SLOTS, 50)])
def test_collocations_of_a_table(spark, least, slots, top):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {tuple(r) for r in collocations.mined(df, least=least, slots=slots, top=top).collect()}
    assert got == mined([(r.text, r.lang) for r in df.collect()], least, top) and len(got) > 150


def test_collocation_edges(spark):
    rng = random.Random(5)
    words = ["a", "A", "bé", "c d", "日本", "x" * 300, "\0", "~"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 30))) + rng.choice([".", "\n", "\t", ""]), rng.choice(["en", None, "und", "é"])) for _ in range(200)]
    rows += [(None, "en"), ("", None), ("  \t ", "xx"), ("...", "en"), ("a a a a a a a", "en"), ("to be, or not\tto  be " * 4000, "long"), ("Ä ä Ä ä " * 9, "en")] + [("hot pair here", "hot")] * 100
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, phrase int, words int").repartition(5)
    got = {tuple(r) for r in collocations.mined(df, least=7).collect()}
    assert got == mined(rows, 7) and {r[0] for r in got} >= {"en", "und", "hot", "long"}
    none = collocations.mined(df.limit(0))
    assert none.columns == "lang rank phrase a l r n score".split() and none.count() == 0
    assert collocations.mined(df.select(F_null("text"), "lang")).count() == 0


def F_null(name):
    from pyspark.sql import functions as F

    return F.lit(None).cast("string").alias(name)


def test_perfect_hash():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 63, 5000):
        keys = rng.integers(0, 1 << 63, (n, 2), np.int64).view(np.uint64)
        keys[: n // 2, 0] = 7  # equal halves of keys are told apart
        table = collocations.Slots(keys)
        assert sorted(table.of(keys).tolist()) == list(range(n))
        other = keys.copy()
        other[:, 1] ^= np.uint64(1 << 40)
        assert (table.of(other) == -1).all()


# Packing


@pytest.fixture(scope="module")
def path():
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json")


def check_pieces(rows, docs, path, capacity):
    """Every document whole, in pieces as they should be, every sequence gapless and within the capacity."""
    from tokenizers import Tokenizer

    model, left, bins = Tokenizer.from_file(path), collections.Counter(), collections.defaultdict(list)
    for text in docs:
        ids = [*model.encode(text[1] or "", add_special_tokens=False).ids, 2]
        n = len(ids)
        cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            left[text[0], k, i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes())] += 1
    for r in rows:
        left[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] -= 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert not any(left.values())
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_a_table(spark, path):
    rows = q.op13_packing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    n = check_pieces(rows, [(r.doc_id, r.text) for r in docs], path, 1024)
    assert n <= 1 + -(-sum(r.length for r in rows) // 1024)


ODD = ["", " ", "a  b", "a \n b", "it's we'll 'tis", "x\ny\n\nz", "\n", "a\x1cb c", "<|endoftext|> a b<|endoftext|>", "a\0b c", "é 日本 語　x y", "a᠎b c ᠎ d", "tab\tx y"]
ODD += ["a  b", "\u0085 x y", "12 3４ ² x", "don't\n's x 's", 'a, b. (c) d) e"', "x½. ⅷ, ١! 三.", "a'., b", "é, x́.", ".,", "a ., b", "word " * 3000, "x" * 5000, "\U0001f600 a\U0001f600, b"]


def test_packing_edges(spark, path):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "again"), (3, "again"), (3, "again"), (90, None)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, length int, sequence_id string").repartition(3)
    out = packing.packed(df, path, 2, 64, ids=True)
    rows = out.collect()
    assert out.columns == "doc_id piece start length ids_crc32 ids sequence_id offset".split()
    check_pieces(rows, docs, path, 64)
    every = {r.sequence_id: r for r in packing.sequences(out).collect()}
    assert all(len(r.ids) <= 64 for r in every.values()) and sum(len(r.ids) for r in every.values()) == sum(r.length for r in rows)
    for r in rows:
        assert np.array(every[r.sequence_id].ids[r.offset : r.offset + r.length], "<u4").tobytes() == bytes(r.ids)
    assert packing.packed(df.limit(0), path, 2).count() == 0


def test_coder_forgets_and_agrees(path, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 2000)
    c, rng = packing.Coder(path), random.Random(6)
    for _ in range(60):
        texts = ["".join(rng.choices(["word", " a", " Ünd", "\n", ",", " 12", ".", " x-y", "'s", "(", ")", " ", "é", "\t"], k=rng.randrange(25))) for _ in range(20)] + ODD[:24]
        assert c.encode(texts) == c.whole(texts)


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= items[i]}):
            j = rooms.index(room)
            go(i + 1, [*rooms[:j], room - items[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def used(plan):
    got = collections.Counter()
    for pattern, m in plan.bins:
        assert m > 0 and sum(x * k for x, k in pattern) <= plan.capacity
        for x, k in pattern:
            got[x] += k * m
    return dict(got)


def test_plans_are_best():
    rng, behind = random.Random(7), 0
    for q_ in range(600):
        capacity = rng.choice([10, 20, 37, 100])
        low, high = (1, capacity) if q_ % 2 else (max(1, capacity // 6), capacity // 2)
        count = dict(collections.Counter(rng.randint(low, high) for _ in range(rng.randrange(11))))
        plan = packing.plan(count, capacity)
        want = fewest([x for x, k in count.items() for _ in range(k)], capacity)
        assert used(plan) == count and plan.sequences == want >= packing.least_bins(count, capacity)
        behind += sum(m for _, m in packing.best_fit(count, capacity)) > want
    assert behind  # best fit alone is not enough


def test_plans_do_not_grow_with_documents():
    rng = np.random.default_rng(8)
    for n in (10**4, 10**12):
        h = rng.multinomial(n, rng.dirichlet(np.ones(1024)))
        count = {i + 1: int(v) for i, v in enumerate(h) if v}
        plan = packing.plan(count)
        assert used(plan) == count and plan.sequences <= 1.01 * packing.least_bins(count, 1024) and len(plan.places()) < 20_000
