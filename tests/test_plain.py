"""ASCII texts in plain Python against the column expressions that other texts go through."""

import pytest
from pyspark.sql import functions as F

from veilframe import constants as c
from veilframe.functions import textfn
from veilframe.operators import abstraction, payload, plain, spans
from veilframe.plans import governor

TEXTS = [
    "", " ", "x", "Hi, I'm Bob Smith. My phone is 585-555-1212, and my zip is and 14623.", "seen at and on, . ,  and in.\tMy x is and y",
    "Bob Smith at 12 ABC St, Rochester, NY on Mar 3rd, 2024 or 2024-01-02 or 1/2/24; 32 years old, age: 45, $1,200.50 for 4 people 7 pm 12:45",
    "You can reach me at a.b@x.com! I want to keep the cost, low. [NAME] [PHONE] quiet table near. bob smith BOB SMITH 5855551212",
    "x_14623 14623_x 14623-1234 123456\r\n10:30 AM\x0b10:30AM 7pmx  and then  , .  is , the hotel\x85", "é 14623 Bob Smith", "Bob Smith " * 40,
]
PROFILE = {"name": "Bob Smith", "phone": " 585-555-1212 ", "address": "12 ABC St, Rochester, NY", "insurance": None}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, "find it") for i, t in enumerate([*TEXTS, None])], "id int, payload string, task string")


def test_spans_and_clean_ups_are_those_of_the_expressions(spark, rows):
    own = {k: F.lit(v).cast("string") for k, v in PROFILE.items()}
    raw = rows.withColumn("raw", F.concat(spans.profile_spans(F.col("payload"), own), spans.pattern_spans(F.col("payload"))))
    want = {r.id: r for r in raw.select("id", spans.resolve(F.col("raw")).alias("s"), textfn.cleaned(F.col("payload")).alias("a"), textfn.cloud_ready(F.col("payload")).alias("b")).collect()}
    got = {r.id: r.all_spans for r in spans.extract(rows, profile=own).collect()}
    for i, t in enumerate([*TEXTS, None]):
        assert got[i] == want[i].s
        if t is not None and t.isascii():
            assert (plain.cleaned(t), plain.cloud_ready(t)) == (want[i].a, want[i].b)
            mine = plain.literals(t, tuple(PROFILE), [v and v.strip() for v in PROFILE.values()]) + plain.patterns(t)
            assert [tuple(s) for s in got[i]] == plain.resolved(mine)


def test_redaction_is_that_of_the_expressions(spark, rows):
    found = payload.redacted(F.col("payload"), found=spans.pattern_spans(F.col("payload")))
    assert all(r.a == r.b for r in rows.select(payload.redacted(F.col("payload")).alias("a"), found.alias("b")).collect())


def test_abstractions_are_those_of_the_expressions(spark):
    kinds = [*c.DIRECT_TYPES, *c.LEXICONS, "preference", "organization", "facility", "noun_phrase", "zip", "other"]
    texts = ["STD", "Oak Grill", "vegan food", "a hospital trip abroad", "aisle seat", "32 years old", "12 Main St, Rochester, NY", "Rochester, NY", "x"]
    d = spark.createDataFrame([(k, t) for k in dict.fromkeys(kinds) for t in texts], "k string, t string").withColumn("kind", abstraction.infer_type(F.col("k"), F.col("t")))
    level = abstraction.level_of(F.col("kind"))
    d = d.select("*", abstraction.by_rule(F.col("kind"), F.col("t"), level).alias("rule"), *(abstraction.validate(F.col("kind"), F.col("t"), s).alias(f"v{s:d}") for s in (False, True)))
    for r in d.collect():
        assert plain.infer_type(r.k, r.t) == r.kind
        assert plain.by_rule(r.kind, r.t, c.LEVELS.get(r.kind, 1)) == r.rule
        assert (plain.validate(r.kind, r.t, False), plain.validate(r.kind, r.t, True)) == (r.v0, r.v1)


def test_rows_wait_only_while_their_texts_are_sent(spark, rows):
    """A function that is sent nothing of most rows takes them all before the views are made: they fill memory, then disk."""
    own = {"name": F.lit("Bob Smith")}
    for df in (spans.extract(rows, profile=own).select("context"), spans.extract(rows, profile=own).select("tagged", "working"), governor.sanitize_with_trace(rows, profile=own).select("task_frame", "cloud_payload")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        sent = [x for x in plan.splitlines() if "ArrowEvalPython" in x]
        assert sent and all("THEN payload" in x for x in sent)


def test_stages_write_a_column_once_where_no_later_one_reads_it(spark, rows, monkeypatch):
    written = []
    kept = governor.through_parquet
    monkeypatch.setattr(governor, "through_parquet", lambda df: written.append(df.columns) or kept(df))
    assert governor.stage_timings(rows, profile={"name": F.lit("Bob Smith")}).first().n == len(TEXTS) + 1
    assert {"context", "tagged", "working"} <= set(written[0]) and not {"context", "tagged", "working"} & {*written[1], *written[2]}
    assert {"decisions", "dropped"} <= set(written[1]) and not {"decisions", "dropped"} & set(written[2]) and "abstractions" in written[2]
