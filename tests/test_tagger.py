"""The trained recogniser: marks, decoding against brute force, fitting, edges, and its place among the recognisers."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe import queries_tagger as q
from veilframe.operators import spans, tables, tagger

D = "/root/testdata/sf0.01"
ROW = "text string, spans array<struct<start:int,end:int,label:string>>"


@pytest.fixture(scope="module")
def model(spark):
    rows = q.marked_texts(spark, D)
    return tagger.fit(rows.filter("not held_out"))


def test_marked(spark):
    df = spark.createDataFrame([([("Ask ", None), ("Zoë 🙂", "PERSON"), (" in ", None), ("Ål", "GPE")],)], "p array<struct<t:string,l:string>>")
    got = df.select(tagger.marked(F.col("p")).alias("m")).select("m.*").first()
    assert got.text == "Ask Zoë 🙂 in Ål"
    assert [(got.text[s.start : s.end], s.label) for s in got.spans] == [("Zoë 🙂", "PERSON"), ("Ål", "GPE")]


def test_decoding_equals_brute_force(monkeypatch):
    monkeypatch.setattr(tagger, "BLOCK", 2)
    rng, k = np.random.default_rng(1), 5
    for n in (0, 1, 2, 5):
        for _ in range(20):
            emit, step = rng.integers(-3, 4, (n, k)).astype(float), rng.integers(-3, 4, (k + 1, k)) + tagger._forbidden(k)
            score = lambda ts: sum(emit[i, t] + step[ts[i - 1] if i else k, t] for i, t in enumerate(ts))  # noqa: B023, E731
            got = tagger._decoded(lambda i, j: emit[i:j], n, step)  # noqa: B023
            assert score(got) == max(map(score, itertools.product(range(k), repeat=n)))
            assert all(t % 2 or not t or (i and got[i - 1] in (t, t - 1)) for i, t in enumerate(got))


def test_gold_tags():
    places = [(0, 3), (4, 7), (8, 11), (12, 15)]
    assert tagger._gold(places, [(4, 11, "B"), (8, 15, "A")], ("A", "B")).tolist() == [0, 3, 4, 2 - 1]
    assert tagger._gold(places, [(1, 3, "A")], ("A", "B")).tolist() == [0, 0, 0, 0]


def test_held_out_names(spark, model):
    rows = q.marked_texts(spark, D).filter("held_out")
    got = tagger.agreement(rows.withColumn("f", model.recognizer()(F.col("text"))), "spans", "f").collect()
    assert {r.label for r in got} == set(tagger.LABELS)
    for r in got:
        assert r.n_right >= 0.95 * r.n_found and r.n_right >= 0.95 * r.n_marked, r


def test_unseen_sentences(spark):
    """A quarter of the shapes was never learned from: the figures are lower, and told in the README."""
    rows = q.marked_texts(spark, D).withColumn("part", F.expr(f"pmod(doc_id div 5, {len(q.SHAPES)}) % 4"))
    model = tagger.fit(rows.filter("part <> 0"))
    got = tagger.agreement(rows.filter("part = 0").withColumn("f", model.recognizer()(F.col("text"))), "spans", "f")
    r = got.agg(*(F.sum(x).alias(x) for x in ("n_marked", "n_found", "n_right"))).first()
    assert r.n_right >= 0.6 * r.n_found and r.n_right >= 0.6 * r.n_marked


def test_agreement_counts(spark):
    df = spark.createDataFrame([("x", [(0, 1, "A"), (2, 3, "B")], [(0, 1, "A"), (2, 4, "B"), (5, 6, "A")]), ("x", None, None)], "k string, w array<struct<start:int,end:int,label:string>>, g array<struct<start:int,end:int,label:string>>")
    got = {tuple(r) for r in tagger.agreement(df, "w", "g", "k").collect()}
    assert got == {("x", "A", 1, 2, 1), ("x", "B", 1, 1, 0)}


def test_edges(spark, model):
    texts = [(None,), ("",), (" \n",), ("?!",), ("퟿🙂 Æ",), ("I saw Nolan Vireth at Onder Bank tomorrow. " * 5000,)]
    got = [r.f for r in spark.createDataFrame(texts, "text string").select(model.recognizer()(F.col("text")).alias("f")).collect()]
    assert got[0] is None and got[1] == [] and got[2] == []
    text = texts[-1][0]
    assert len(got[-1]) >= 10000 and all(text[s.start : s.end] == s.text for s in got[-1])
    assert all(a.end <= b.start for a, b in itertools.pairwise(got[-1]))


def test_fit_on_edges(spark):
    empty = tagger.fit(spark.createDataFrame([], ROW), epochs=1)
    assert empty.find("Ask Dr. Adams.") == []
    rows = [(None, [(0, 1, "PERSON")]), ("Ask Adams", None), ("Ask Adams", [(4, 9, "COLOUR")]), ("", []), *[("Ask Adams now", [(4, 9, "PERSON")])] * 5]
    few = tagger.fit(spark.createDataFrame(rows, ROW).withColumn("shard", F.lit("x")), epochs=3)
    assert few.find("Ask Adams now") == [(4, 9, "PERSON")]


def test_sample_is_bounded_and_repeatable(spark):
    rows = q.marked_texts(spark, D)
    a, b = (tagger.fit(x, sample=40, epochs=2) for x in (rows, rows.repartition(3).orderBy(F.desc("doc_id"))))
    assert np.array_equal(a.weight, b.weight) and np.array_equal(a.step, b.step) and np.array_equal(a.row, b.row)


def test_as_recognizer_and_table_function(spark, model):
    df = spark.createDataFrame([(1, "I saw Nolan Vireth at Onder Bank tomorrow.")], "id int, payload string")
    found = df.select(F.inline(spans.recognized_spans(F.col("payload"), model.recognizer()))).collect()
    assert {(r.text, r.span_type) for r in found} == {("Nolan Vireth", "person"), ("Onder Bank", "organization"), ("tomorrow", "date")}
    taken = spans.extract(df, "payload", {}, model.recognizer())
    assert {s.text for s in taken.first().u_med} >= {"Nolan Vireth", "Onder Bank"}
    tables.registered(spark, "tagged_spans", lambda: model.find)
    df.createOrReplaceTempView("tagger_payloads")
    rows = spark.sql("select s.* from tagger_payloads, lateral tagged_spans(payload) s").collect()
    assert {(r.text, r.label) for r in rows} == {("Nolan Vireth", "PERSON"), ("Onder Bank", "ORG"), ("tomorrow", "DATE")}


