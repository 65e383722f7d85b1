"""Operators that SQL cannot express, against plain versions written from their definitions."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from test_operators import prose


def test_language_models_are_kneser_ney(spark):
    """Every probability of the sorted arrays equals that of interpolated Kneser-Ney counted in dictionaries."""
    from veilframe.llm import langid

    texts = {"a": ["the cat sat on the mat. The rat! " * 3, "an oak at the tea"], "b": ["la casa en el mar y la sal " * 2, "él está aquí"]}
    grams = {}
    for lang, ts in texts.items():
        raw = [t.encode() for t in ts]
        data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        grams[lang] = np.unique(langid.grams(*langid.coded(data, offs))[0], return_counts=True)
    m = langid.fit(sorted(texts), grams)

    def letters(text):
        out = [0]
        for ch in text.lower():
            k = ord(ch) if ch.isalpha() else 0
            out += [k] if k or out[-1] else []
        return out

    for li, lang in enumerate(sorted(texts)):
        count = {langid.ORDER: Counter()}
        for t in texts[lang]:
            x = [0] * (langid.ORDER - 1) + letters(t)
            for i in range(langid.ORDER, len(x)):
                count[langid.ORDER][tuple(x[i - langid.ORDER + 1 : i + 1])] += 1
        for n in range(langid.ORDER - 1, 0, -1):  # continuation counts
            count[n] = Counter(g[1:] for g in count[n + 1])
        cut = {}
        for n, c in count.items():
            one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            cut[n] = min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5

        def p(g):
            if not g:
                return 1 / langid.LETTERS
            c = count[len(g)]
            same = [v for k, v in c.items() if k[:-1] == g[:-1]]
            if not same:
                return p(g[1:])
            d = cut[len(g)]
            return max(0, c[g] - d) / sum(same) + d * len(same) / sum(same) * p(g[1:])

        rng = np.random.default_rng(4)
        seen = list(count[langid.ORDER])
        some = seen[::3] + [tuple(int(v) for v in rng.choice([0, *map(ord, "aehlnortzé")], langid.ORDER)) for _ in range(200)]
        keys = np.array([sum(v << langid.BITS * (langid.ORDER - 1 - i) for i, v in enumerate(g)) for g in some])
        got = m.position(keys)[:, li]
        assert np.allclose(got, [math.log(p(g)) for g in some], atol=1e-4)


def test_language_scores_are_means_of_log_probabilities(spark):
    from veilframe.llm import langid

    rows = [(i, prose(i, 40), "en") for i in range(40)] + [(100 + i, " ".join(w[::-1] for w in prose(i, 40).split()), "ne") for i in range(40)]
    m = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    m.usual, m.reject = 0.0, 1.0
    test = [(1, prose(900, 9)), (2, prose(901, 3) + " 12 " + prose(902, 2)[::-1]), (3, prose(900, 9))]
    d = spark.createDataFrame([(*r, "x", 1.0, True) for r in test], "i int, text string, lang_pred string, score double, rejected boolean")
    got = {r.i: r for r in langid.predicted(d, m).collect()}
    for i, t in test:
        raw = t.encode()
        code, bounds = langid.coded(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        lp = m.position(langid.grams(code, bounds)[0])
        h, n = -lp.mean(0), int((code > 0).sum())
        e = np.exp(-(h - h.min()) * math.sqrt(n) * m.temperature)
        assert got[i].lang_pred == m.langs[int(h.argmin())] and math.isclose(got[i].score, e.max() / e.sum(), rel_tol=1e-5)
        assert math.isclose(got[i].cross_entropy, h.min(), rel_tol=1e-5) and got[i].rejected == (h.min() * math.sqrt(n) > 1)
    assert got[1].score == got[3].score
    assert langid.predicted(d, m).columns == ["i", "text", "lang_pred", "score", "cross_entropy", "rejected"]


def test_equal_entropies_give_the_first_language(spark):
    from veilframe.llm import langid

    m = langid.train(spark.createDataFrame([(i, prose(i % 20, 40), "b" if i < 20 else "a") for i in range(40)] * 2, "doc_id bigint, text string, lang string"), docs_per=10**6)
    k = m.parts[0].keys[5][:50]
    m = langid.fit(["a", "b"], {x: (k, np.ones(len(k), np.int64)) for x in "ab"})
    got = langid.predicted(spark.createDataFrame([(1, prose(3, 20))], "i int, text string"), m).first()
    assert (got.lang_pred, got.score) == ("a", 0.5)


def _features(text):
    """Coordinates and values of a text, from the definition; hashes of single words are the module's."""
    from veilframe.llm import quality_classifier as q

    raw = (text or "").encode()
    kinds = q.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = max(1, len(words))
    out = Counter()
    for k, (c, at) in enumerate(kinds):
        own = c[at[0] : at[1]].tolist()
        assert len(own) == (1 if k == 0 else len(words) if k % 2 else max(0, len(words) - 1))
        for x, times in Counter(own).items():
            out[k, x] += 1.0 if k == 0 else times * q.SCALE / n
    if len(kinds) > 1:  # equal words have equal coordinates, different words different ones (but for chance, of 2**18)
        one = dict(zip(words, kinds[1][0].tolist(), strict=True))
        assert [one[w] for w in words] == kinds[1][0].tolist() and len(set(one.values())) >= len(one) - 1
    return out


def test_classifier_is_ftrl_and_a_sparse_dot_product(spark):
    import hashlib

    from veilframe.llm import quality_classifier as q

    rows = [(i, prose(i, 3 + i % 9) + (" ok fine fine" if i % 2 else " !! ## JUNK")) for i in range(60)] + [(60, ""), (61, None), (62, "a")]
    d = spark.createDataFrame([(*r, 0.5) for r in [*rows, rows[3]]], "doc_id bigint, text string, score double")
    y = spark.createDataFrame([(i, i % 2) for i in range(0, 63)], "doc_id bigint, y int")
    w = q.train(d, y)
    x = [(_features(t), i % 2) for i, t in [*rows, rows[3]]]
    # order of the rows as train() has it: by label, then digests of what is collected
    flat = [([k for _, k in f], [np.float32(v) for v in f.values()], t) for f, t in x]

    def listed(f):
        kinds = sorted({k for k, _ in f})
        pairs = [(c, v) for k in kinds for (k2, c), v in sorted(f.items()) if k2 == k]
        return np.array([c for c, _ in pairs], np.int32), np.array([v for _, v in pairs], np.float32)

    flat = [(*listed(f), t) for f, t in x]
    flat.sort(key=lambda r: (r[2], hashlib.sha256(r[0]).digest(), hashlib.sha256(r[1]).digest()))
    z, n, b = Counter(), Counter(), 1 << q.BITS

    def weight(i):
        return 0.0 if abs(z[i]) <= q.L1 else -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    rng = np.random.default_rng(7)
    for _ in range(q.EPOCHS):
        for k in rng.permutation(len(flat)):
            idx, val, t = flat[k]
            at = [(int(i), float(v)) for i, v in zip(idx, val, strict=True)] + [(b, 1.0)]
            own = {i: weight(i) for i, _ in at}
            err = 1 / (1 + math.exp(-max(-35, min(35, sum(own[i] * v for i, v in at))))) - t
            for i, v in at:
                g = err * v
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA
                z[i] += g - s * own[i]
                n[i] += g * g
    want = np.zeros(b + 1, np.float32)
    for i in z:
        want[i] = weight(i)
    assert np.allclose(w, want, atol=1e-5)
    out = q.scored(d, w)
    assert out.columns == ["doc_id", "text", "score"]
    for r in out.collect():
        t = float(w[-1]) + sum(float(w[c]) * v for (_, c), v in _features(r.text).items())
        assert math.isclose(r.score, 1 / (1 + math.exp(-t)), rel_tol=1e-4)


def test_classifier_fit_is_bounded(spark, monkeypatch):
    """Rows that share a doc_id don't escape the bound, and texts are whole."""
    from veilframe.llm import quality_classifier as q

    d = spark.range(4000).selectExpr("id % 40 as doc_id", "repeat(concat('w', id, ' '), 400) as text")
    y = spark.range(40).selectExpr("id as doc_id", "int(id % 2) as y")
    seen = []
    own = q.examples
    monkeypatch.setattr(q, "examples", lambda df: seen.append(df) or own(df))
    q.train(d, y, sample=100)
    got = seen[0].selectExpr("count(*) as n", "min(length(text)) as m").first()
    assert 50 <= got.n <= 160 and got.m >= 400 * 3


@pytest.mark.parametrize("part", [8_000_000, 3_000])
def test_classifier_reads_long_texts_to_their_ends(spark, monkeypatch, part):
    """The sign of the label stands behind 60,000 characters; the fit in parts learns it too."""
    from veilframe.llm import quality_classifier as q

    monkeypatch.setattr(q, "PART", part)
    tail = {0: " ##!! JUNK ##!!" * 400, 1: " fine words here" * 400}
    rows = [(i, prose(i, 20) * (1 + 600 * (i < 20)) + tail[i % 2]) for i in range(80)]
    assert len(rows[0][1]) > 60_000
    w = q.train(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, y int"))
    out = {r.doc_id: r.score for r in q.scored(spark.createDataFrame(rows, "doc_id bigint, text string"), w).collect()}
    assert all((out[i] > 0.5) == (i % 2 == 1) for i in range(80))


def test_many_languages_make_a_small_model(spark):
    """Sixty languages of random letters: what they take is linear in the n-grams that each has seen."""
    from veilframe.llm import langid

    rng = np.random.default_rng(6)
    rows = []
    for lang in range(60):
        letters = rng.permutation(list("abcdefghijklmnopqrstuvwxyzäöüßéèñçåøλμνπρσ"))
        rows += [(lang * 100 + i, " ".join("".join(rng.choice(letters[:20], 6)) for _ in range(60)), f"l{lang:02}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    m = langid.train(df)
    assert len(m.langs) == 60 and m.nbytes < 200 << 20
    few = langid.train(df, most=100_000)
    assert len(few.langs) == 60 and 90_000 < sum(len(p.keys[langid.ORDER]) for p in few.parts) <= 100_000
    got = langid.predicted(df.filter("doc_id % 10 = 0").select("doc_id", "text"), m).collect()
    assert sum(r.lang_pred == f"l{r.doc_id // 100:02}" for r in got) > 0.95 * len(got)


def test_every_language_gives_a_row(spark, monkeypatch):
    from veilframe.llm import langid

    monkeypatch.setattr(langid, "TOTAL", 10)
    rows = [(i, "abc def " + chr(0x3B1 + i % 20), f"l{i % 20}") for i in range(400)]
    assert len(langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).langs) == 20


def test_word_counts(spark):
    from veilframe.llm import mixing

    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("ab \t\n\x0b\x0c\ré\u00a0\u3000"), rng.integers(0, 12))) for _ in range(3000)] + [None, "", " ", "  a", "a  ", "a b c d e", "x " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    got = {r.i: r.n for r in df.select("i", mixing.word_count(df.t).alias("n")).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_mix_against_a_plain_plan(spark):
    """taken of every document, from the blocks' and documents' seeded orders."""
    from pyspark.sql import functions as F

    from veilframe.llm import mixing

    rows = [(i, prose(i, 1 + i % 13) if i % 17 else None, "hot" if i % 3 == 0 else f"s{i % 5}" if i % 7 else None) for i in range(700)]
    rows += [(1, "one two three", "hot"), (9001, "", "none")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = mixing.targets(dict(size))
    sizes = mixing.sized(d)
    hot = mixing.plan(sizes)[1]["hot"]
    at = mixing.with_block(sizes, hot, 0).select(
        "doc_id", "source", "size", "_m_block", mixing._salted(3, F.col("_m_key"), F.col("_m_block")).alias("b"), mixing._salted(1, F.col("doc_id")).alias("o")
    )
    taken = Counter()
    docs = sorted(at.collect(), key=lambda r: (str(r.source), r.b, r._m_block, r.o, r.doc_id, r.size))
    for s in size:
        left = round(want[s])
        own = [r for r in docs if r.source == s]
        whole = want[s] // size[s] if size[s] else 0
        left -= int(whole) * size[s]
        for r in own:
            more = min(r.size, max(0, left))
            left -= r.size
            taken[r.doc_id, s, r.size] += int(whole) * r.size + more
    got = Counter()
    for r in mixing.planned_mix(d).collect():
        got[r.doc_id, r.source, r.size] += r.taken
    assert got == taken


def test_shards_follow_the_tree(spark):
    """Every source's draws in every shard are the tree's quotas."""
    from veilframe.llm import mixing

    rows = [(i, prose(i, 2 + i % 5), f"s{i % 4}") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    blocks = mixing.plan(mixing.sized(d), shards=8)[0].collect()
    draws = Counter(r._m_key for r in blocks for _ in r._m_shards)
    names = sorted(draws)
    dealt = Counter((r._m_key, x) for r in blocks for x in r._m_shards)
    group = mixing.split([draws[k] for k in names], 8, 0)  # each source is a group of its own here
    assert {(k, x): int(n) for k, q in zip(names, group, strict=True) for x, n in enumerate(q) if n} == dict(dealt)


def test_equal_word_hashes_link_nothing(spark):
    """Words whose plain polynomial hashes are equal."""
    from veilframe.llm import setsketch

    d = spark.createDataFrame([(1, "a b c d nsrmltyxucwepmti"), (2, "a b c d huwepwpushtawirh"), (3, "A b  C d nsrmltyxucwepmti")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in setsketch.groups(d).collect()}
    assert got == {1: (1, 1, True), 2: (1, 2, True), 3: (1, 1, False)}


def test_exact_sets():
    from veilframe.llm import setsketch

    texts = ["a b c d e f a b c d e", "b c d e f", "a b", "A  b", "a", "", "ab c d e f", "é b c d e f"]
    raw = [t.encode() for t in texts]
    got = setsketch.exact_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = []
    for t in texts:
        w = t.lower().split()
        want.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    assert [len(g) for g in got] == [len(w) for w in want]
    for g, w in zip(got, want, strict=True):
        for h, v in zip(got, want, strict=True):
            assert len(set(g.tolist()) & set(h.tolist())) == len(w & v)


def test_equal_run_hashes_remove_nothing(spark):
    """Texts whose runs have equal polynomial hashes under a base that is no secret."""
    from veilframe.llm import suffix_dedup

    a = "gqnplnlarrtztkotazhufrsfczrzibvccaoayyihidztfcjR8aqIuyJi;mbzwljcffiqfviuwjowkppdajmknzgidixqgtnahamebxfowq"
    b = "gqnplnlarrtztkotazhufrsfczrzibvccaoayyihidztf]lW0et@rwOf7t^xvljcffiqfviuwjowkppdajmknzgidixqgtnahamebxfowq"
    for parts in (1, 2):
        d = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string").repartition(parts)
        assert {r.doc_id: r.n_removed for r in suffix_dedup.cut(d).collect()} == {1: 0, 2: 0}


def test_colliding_hashes_cost_no_byte(spark, monkeypatch):
    """With hashes that collide all the time, bytes still decide what goes."""
    from veilframe.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup.secrets, "randbits", lambda n: 1)  # base 1: every hash is a sum of bytes
    rows = [(i, "".join(chr(97 + x) for x in np.random.default_rng(i % 6).permutation(26)) * 4 + f"{i % 4}" * 9) for i in range(24)]
    first, want = {}, {}
    for i, t in rows:
        b, gone = t.encode(), np.zeros(len(t), bool)
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = True
        want[i] = int(gone.sum())
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert all(r.n_removed <= want[r.doc_id] for r in suffix_dedup.cut(d).collect())
