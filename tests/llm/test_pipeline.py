"""The pipeline's stages on the smallest tables."""

from pathlib import Path

import pytest

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test tables")


def test_stages(spark):
    import corpus_pipeline as p
    from veilframe.llm import setsketch
    from veilframe.session import table

    docs = table(spark, D, "documents")
    cols = docs.columns
    kept = p.quality(spark, docs, D).cache()
    assert kept.columns == cols and 0 < kept.count() < docs.count()
    good = table(spark, D, "labels").filter("quality = 1").join(docs, "doc_id").select("doc_id").distinct()
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count()
    one = p.near_dedup(spark, kept, D).cache()
    assert one.columns == cols
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in setsketch.groups(kept).filter("kept").collect()}
    safe = p.secret_scan(spark, one, D).cache()
    assert safe.columns == cols and safe.count() == one.count()
    assert not [r for r in safe.collect() if r.text and 'token = "' in r.text]
    mix = p.mixture(spark, safe, D).cache()
    assert mix.columns == cols and mix.count() > 0
    out = p.tokens(spark, mix, D)
    assert out.count() == mix.count()
    assert [n for n, _ in p.STAGES][0] == "quality classifier" and len(p.STAGES) == 5


def test_rounds_of_components_have_small_plans(spark, monkeypatch):
    """A round reads its edges four times at most; the driver plans and keeps every reading of near-dedup's rounds."""
    from veilframe.llm import graph

    plans, write = [], graph.checkpointed

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(graph, "checkpointed", noted)
    edges = [(i + 1, i) for i in range(6)] + [(i, 10) for i in range(11, 30)] + [(40, 41), (41, 40), (50, 50)]
    got = dict(graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(7)} | {i: 10 for i in range(10, 30)} | {40: 40, 41: 40}
    assert len(plans) > 2 and max(p.count("LogicalRDD") for p in plans) <= 4


def test_run_against_plain_python(spark, tmp_path):
    import base64
    import hashlib
    import re
    from collections import Counter

    import public_tokenizers
    import tiktoken

    import corpus_pipeline as p
    from test_operators import near, prose
    from veilframe.llm import mixing

    rows = [(i, prose(i, 20 + i % 30) + (f" token={'a1b2c3' * 3} AKIA{'Q' * 16} end" if i % 4 == 0 else ""), "en", f"s{i % 3}") for i in range(80)]
    rows += [(100 + i, rows[i][1] + " more", "en", "s2") for i in range(0, 60, 3)]
    rows += [(200 + i, "!! ## " * 30 + f"bad{i}", "en", "s1") for i in range(40)]
    cols = "doc_id bigint, text string, lang string, source string, n_chars int"
    spark.createDataFrame([(*r, len(r[1])) for r in rows], cols).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 200), 0) for r in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in p.quality(spark, docs, str(tmp_path)).collect()}
    assert 0 < len(good) < len(rows)
    kept = {i: (t, s) for i, t, _, s in rows if i in good}
    groups = near([(i, t) for i, (t, _) in kept.items()])
    kept = {i: x for i, x in kept.items() if groups[i][1] == i}
    assert len(kept) < len(good)
    safe = {i: (re.sub(r"token=[A-Za-z0-9]{12,}|AKIA[A-Z0-9]{14,}", "[secret]", t), s) for i, (t, s) in kept.items()}
    size, words = Counter(), Counter()
    for t, s in safe.values():
        size[s] += len(t.split())
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    for r in p.run(spark, str(tmp_path)).collect():
        ids = [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]
        text, (whole, source) = enc.decode(ids), safe[r.doc_id]
        assert text == whole or whole.startswith(text + " ")
        assert ids == enc.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(r.ids), digest(text.encode()))
        words[source] += len(text.split())
    want = mixing.targets(dict(size))
    assert set(words) == set(want) and all(abs(words[s] - want[s]) <= 1 for s in want)
