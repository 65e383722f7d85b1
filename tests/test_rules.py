"""Golden values of the rule path."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions import textfn
from veilframe.operators import abstraction, carryover, facts, generate, payload, spans
from veilframe.plans import governor

DENTIST = (
    "Hi, I'm Bob Smith and you can reach me at 585-555-1212 or bob@example.com. I live at 12 ABC St, Rochester, NY. "
    "I have BlueCross Dental Plus. Dinner for 2 people on March 18 at 10:30 AM under $500 near 14623."
)


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize(
    ("rule", "text", "want"),
    [
        (abstraction.rule_date, "March 18", ("in March", "mid-March", "around March 18")),
        (abstraction.rule_date, "Mar 3rd", ("in March", "early-March", "around March 3")),
        (abstraction.rule_date, "2026-03-18", (None, None, None)),
        (abstraction.rule_time, "10:30 AM", ("morning", "10:00–11:00", "around 10 AM")),
        (abstraction.rule_time, "12:15 AM", ("morning", "0:00–1:00", "around 12 AM")),
        (abstraction.rule_time, "13:45", ("afternoon", "13:00–14:00", "around 12 PM")),
        (abstraction.rule_time, "11 PM", ("evening", "23:00–24:00", "around 10 PM")),
        (abstraction.rule_address, "12 ABC St, Rochester, NY", ("NY area", "Rochester, NY", None)),
        (abstraction.rule_address, "Rochester, NY", ("NY area", "Rochester, NY", None)),
        (abstraction.rule_address, "Rochester", ("local area", "Rochester", None)),
        (abstraction.rule_age, "32 years old", ("an adult", "in their 30s", "in the 30–34 age range")),
        (abstraction.rule_age, "75 years old", ("an adult", "in their 70s", "in the 75–79 age range")),
    ],
)
def test_rules(spark, rule, text, want):
    got = tuple(one(spark, rule(F.lit(text), F.lit(level))) for level in (0, 1, 2))
    assert got == want


@pytest.mark.parametrize(("x", "want"), [(0.2, 0.0), (0.25, 0.0), (0.74, 0.5), (0.75, 1.0), (1.3, 1.0), (-1.0, 0.0)])
def test_snap(spark, x, want):
    assert one(spark, facts.snapped(F.lit(x))) == want


def test_strict_age_fails_validation(spark):
    v = lambda strict: one(spark, abstraction.validate(F.lit("age"), F.lit("in their 70s"), strict))
    assert v(True) == "failed:not age-like"
    assert v(False) == "passed"


def test_overlaps(spark):
    rows = [("a", 0, 5, "U_med"), ("b", 3, 20, "U_med"), ("c", 4, 8, "U_loc"), ("d", 21, 25, "U_med")]
    arr = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit("x").alias("span_type"), F.lit("").alias("source"), F.lit(b).alias("bucket"), F.lit("").alias("subsource")) for t, s, e, b in rows))
    assert [s.text for s in one(spark, spans.resolve(arr))] == ["c", "d"]


def test_leakage(spark):
    p = "Bob Smith at 12 ABC St, Rochester, NY is looking for help. STD concern. Patient context: Age: 32, Insurance ID: BC-123456-A9."
    cur = F.array(F.lit("eczema"), F.lit("STD concern"))
    prof = F.create_map(*map(F.lit, ("name", "Bob Smith", "address", "12 ABC St, Rochester, NY", "phone", "585-555-1212", "insurance_id", "BC-123456-A9", "seat_preference", "aisle", "age", "32")))
    known = facts.profile_facts(prof)
    assert one(spark, facts.ratio(facts.leaking(F.lit(p), cur), cur)) == 0.5
    names = F.transform(known, lambda k: k["fact"])
    assert one(spark, F.size(known)) == 5  # an age of two digits is no fact
    assert one(spark, facts.ratio(facts.leaking(F.lit(p), names), names)) == 0.6
    assert one(spark, facts.weighted(F.lit(p), F.concat(known, F.array(F.struct(F.lit("x y z").alias("fact"), F.lit(0.6).alias("weight"), ))))) == pytest.approx(2.6 / 4.5)


def test_leaks_by_grams_equal_broadcast(spark):
    d = spark.createDataFrame([(1, "the quick brown fox jumps over it"), (2, "nothing"), (3, None)], "i int, t string")
    f = spark.createDataFrame([(1, "Quick Brown Fox Jumps"), (2, "fox"), (3, "no"), (4, None), (5, "quick brown fox sits")], "k int, f string")
    want = {(1, 1), (1, 2)}
    for few in (100, 0):
        assert {(r.i, r.k) for r in facts.leaks(d, f, "t", "f", few=few).select("i", "k").collect()} == want


def test_governor_keeps_identifiers_out(spark):
    d = spark.createDataFrame([(1, DENTIST, "dentist"), (2, "", "x"), (3, None, None)], "id int, payload string, task string")
    prof = {"name": F.lit("Bob Smith"), "phone": F.lit("585-555-1212"), "email": F.lit("bob@example.com"), "address": F.lit("12 ABC St, Rochester, NY"), "insurance": F.lit("BlueCross Dental Plus")}
    rows = {r.id: r for r in governor.sanitize_with_trace(d, profile=prof).collect()}
    r = rows[1]
    found = {(s.span_type, s.text) for s in r.all_spans}
    assert {("name", "Bob Smith"), ("phone", "585-555-1212"), ("zip", "14623"), ("money", "$500"), ("time", "10:30 AM"), ("date", "March 18"), ("party_size", "for 2 people")} <= found
    assert all(a.end <= b.start for a, b in zip(r.all_spans, r.all_spans[1:]))
    assert r.context.count("[SPAN]") == len(r.all_spans)
    assert "Bob" not in r.cloud_payload and "585" not in r.cloud_payload and "March 18" in r.cloud_payload
    assert DENTIST[8:17] == "Bob Smith"


def test_find_all_many_matches(spark):
    text = "ab " * 700 + "é ab"
    got = one(spark, textfn.find_all(F.lit(text), "ab"))
    assert [(m.start, m.end) for m in got] == [(3 * i, 3 * i + 2) for i in range(700)] + [(2102, 2104)]


def test_islands(spark):
    d = spark.createDataFrame([(1,)], "id int")
    text = "sore gums and tooth pain. then a cough"
    mk = lambda t: F.struct(F.lit(t).alias("text"), F.lit(text.index(t)).alias("start"), F.lit(text.index(t) + len(t)).alias("end"), F.lit("noun_phrase").alias("span_type"), F.lit("").alias("source"), F.lit("U_med").alias("bucket"), F.lit("").alias("subsource"))
    typed = F.array(*(F.struct(mk(t).alias("span"), F.lit("medical_symptom").alias("kind")) for t in ("sore gums", "tooth pain", "a cough")))
    got = d.select(abstraction.islands(typed, F.lit(text)).alias("v")).first().v
    assert [g.anchor for g in got] == [0, 0, text.index("a cough")]


def test_model_answers(spark):
    assert one(spark, carryover.parsed_decisions(F.lit("1. KEEP\n2. drop\n"), F.lit(2))) == [True, False]
    assert one(spark, carryover.parsed_decisions(F.lit("1. KEEP\n"), F.lit(2))) is None
    assert one(spark, abstraction.numbered_answers(F.lit("2. b\n1) a"), F.lit(2))) == ["a", "b"]
    assert one(spark, abstraction.tidy_answer(F.lit('Output: "a city"'))) == "a city"
    assert one(spark, payload.labelled_query(F.lit('thinking\nCLOUD QUERY: find help\n\nnote'))) == "find help"


def test_coverage(spark):
    v = one(spark, generate.covered(F.lit("Help me."), F.array(F.lit("knee pain")), F.array(F.lit("near school"))))
    assert v == "Help me. I should mention I have been dealing with knee pain. It should be near school."


def test_fake_model(spark):
    from veilframe.operators import models

    d = spark.createDataFrame([(1, "a b"), (2, None)], "id int, p string")
    out = {r.id: r.a for r in models.answered(d, "p", "a", lambda: lambda xs: [x.upper() for x in xs]).collect()}
    assert (out[1].text, out[1].in_tokens) == ("A B", 2)


def test_stream_first_seen(spark, tmp_path):
    from veilframe.streaming.history import first_seen

    src = str(tmp_path / "log")
    spark.sql("select 'u' as user, x as fact, timestamp'2026-01-01 00:00:00' as at from values ('a'), ('a'), ('b') t(x)").write.parquet(src)
    s = spark.readStream.schema("user string, fact string, at timestamp").parquet(src)
    q = first_seen(s).writeStream.format("memory").queryName("seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.fact for r in spark.table("seen").collect()} == {"a", "b"} and spark.table("seen").count() == 2


def test_state_files(spark, tmp_path):
    from veilframe.sources import state

    assert state.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    p = tmp_path / "x.json"
    p.write_bytes('{"name": "Zoë"}'.encode("cp1252"))
    assert state.read_text_json(spark, str(p), "name string").first().name == "Zoë"


def test_many_matches_in_one_text(spark):
    n = 100_000
    found = spark.range(1).select(textfn.find_all(F.expr(f"repeat('ab é', {n})"), "ab").alias("f")).select(F.size("f").alias("n"), F.expr("f[size(f) - 1].start").alias("s")).first()
    assert (found.n, found.s) == (n, 4 * (n - 1))
    found = spark.range(1).select(spans.find_literal(F.expr(f"repeat('xAb é', {n})"), F.lit("aB")).alias("f")).select(F.size("f").alias("n"), F.expr("f[size(f) - 1]").alias("m")).first()
    assert (found.n, found.m.start, found.m.end, found.m.text) == (n, 5 * (n - 1) + 1, 5 * (n - 1) + 3, "Ab")


def test_literals_are_no_patterns(spark):
    got = one(spark, spans.find_literal(F.lit(r"a.b axb A.B \\E a.b"), F.lit("a.b")))
    assert [m.start for m in got] == [0, 8, 15] or [m.text for m in got] == ["a.b", "A.B", "a.b"]
    assert [m.text for m in one(spark, spans.find_literal(F.lit("x \\E. y \\E."), F.lit("\\E.")))] == ["\\E."] * 2


def test_exact_copies_once(spark):
    mk = lambda t, src, sub: F.struct(F.lit(t).alias("text"), F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("x").alias("span_type"), F.lit(src).alias("source"), F.lit("U_med").alias("bucket"), F.lit(sub).alias("subsource"))
    got = one(spark, spans.once(F.array(mk("Ab", "s", "t"), mk("zz", "s", "t"), mk("AB", "s", "t"), mk("ab", "s", "u"))))
    assert [g.text for g in got] == ["AB", "zz", "ab"]


LONG = "find a dentist near the lake who takes new patients on weekends and has parking, please, for two adults and a child"
TALKS = [
    ('REASONING: age helps.\nCLOUD QUERY: "find a dentist"\n\nThis query includes an age.', ("age helps.", "find a dentist")),
    ("Step 1 - Reason: think\nStep 2: CLOUD QUERY: one\nCLOUD QUERY: two words Note: done", ("think", "two words")),
    (f'I wrote a briefing: "{LONG}"', (f'I wrote a briefing: "{LONG}"', LONG)),
    (f'REASONING: all of it.\nHere\'s the query:\n"{LONG}"', ("all of it.", LONG)),
    ("nothing to see", ("nothing to see", None)),
    ("reasoning: a\n\nThis query is long\ncloud query:", ("a", None)),
    ("", ("", None)),
]


@pytest.mark.parametrize(("answer", "want"), TALKS)
def test_parsed_query(spark, answer, want):
    assert tuple(one(spark, payload.parsed_query(F.lit(answer)))) == want


def test_naive_payload(spark):
    own = {"name": F.lit("Bob"), "address": F.lit("1 Main St"), "age": F.lit(32), "insurance": F.lit("Blue"), "insurance_id": F.lit("B-1")}
    said = lambda a: one(spark, payload.naive_payload(F.lit("book a dentist."), own, F.lit("User is free on: Monday"), None if a is None else F.lit(a))).query
    plain = "Bob at 1 Main St is looking for help — Book a dentist. User is free on: Monday. Insurance: Blue.\nPatient context: Age: 32, Insurance ID: B-1."
    assert said(None) == said("hm") == plain
    assert said("CLOUD QUERY: dentist for a 32 year old, blue, b-1, at 1 MAIN ST") == "dentist for a 32 year old, blue, b-1, at 1 MAIN ST"


def test_rewrites(spark):
    long = "please find me a dentist soon"
    for raw, want in ((f"Cleaned message: {long}", long), ("Output: short", "Output: short"), (f"SURE, {long}", long), (f" {long} ", long), (f"Here is the text: {long}", f"the text: {long}")):
        assert one(spark, payload.rewritten(F.lit(raw))) == want
    with pytest.raises(ValueError):
        payload.rewritten(None)


def traces(spark):
    rows = [
        ("tool:get_calendar", "2026-01-02T10:00", "w1", '{"free_slots": ["Mon 9", "Tue 8", "Wed 7"], "busy_slots": []}'),
        ("tool:get_location", "2026-01-03", "w2", "Rochester"),
        ("tool:book_appointment", "2026-01-04", "w3", '{"booked_at": "Lake", "appointment_date": "May 1"}'),
        ("backstory", "2026-01-05", "w4", '{"task": "teeth", "result": "fine"}'),
        ("tool:search", "2026-01-06", "w5", '["a b", "c", "d"]'),
        ("note", "2026-01-07", "w6", "plain"),
    ]
    d = spark.createDataFrame(rows, "source string, gathered_at string, from_workflow string, data string")
    return d.agg(F.collect_list(F.struct(*d.columns)).alias("t"))


def test_enrichment_and_activity(spark):
    d = traces(spark)
    got = d.select(payload.enriched(F.lit("help"), {"name": F.lit("Bob")}, F.col("t")).alias("e"), payload.activity(F.col("t")).alias("a")).first()
    assert got.e == (
        "Task: help\n\n[Source: user_profile]\n  name: Bob\n\n[Source: memory_traces  (residual context from prior workflows)]\n"
        '  [calendar | from: "w1" | 2026-01-02]\n    availability: Mon 9, Tue 8, Wed 7\n    busy:         none\n\n'
        '  [location | from: "w2" | 2026-01-03]\n    Rochester\n\n'
        '  [past booking | from: "w3" | 2026-01-04]\n    booked_at: Lake  date: May 1\n\n'
        '  [backstory | from: "w4" | 2026-01-05]\n    task: teeth\n    result: fine\n\n'
        '  [tool:search | from: "w5" | 2026-01-06]\n    - a b\n    - c\n    - d\n\n'
        '  [note | from: "w6" | 2026-01-07]\n    plain\n'
    )
    assert got.a == [
        "- Calendar: free on Mon 9, Tue 8", '- Location recorded: Rochester (task: "w2")', '- Booked "Lake" for task: "w3"',
        "- Prior visit (teeth): fine", '- Past data from "w5": a b', '- Past data from "w5": c',
    ]
    assert one(spark, payload.preferences(F.lit("INFERRED CONTEXT: x\nINFERRED CONTEXT:\n- likes quiet places"))) == "- likes quiet places"
    assert one(spark, payload.preferences(F.lit("None of these matter at all"))) == ""


def test_json_strings(spark):
    text = '{"a": " two words ", "b": [1, "xy", {"c": "q\\"uote: \\u00e9", "d": null}], "e": {"key": "a:b"}, "f": "k\\\\"}'
    assert one(spark, facts.json_strings(F.lit(text))) == ["two words", 'q"uote: é', "a:b"]
    assert one(spark, facts.json_strings(F.lit("{nope"))) is None and one(spark, facts.json_strings(F.lit('"abc"'))) == ["abc"]


def test_inference_scores(spark):
    rows = [("m", f, s) for f, s in (("name", 0.9), ("name", 0.2), ("dob", 0.0), ("insurance_id", 0.5), ("address", 1.0), ("condition", None))]
    r = facts.inference_scores(spark.createDataFrame(rows, "method string, field string, score double")).first()
    assert (r.name, r.dob, r.insurance_id, r.address, r.age, r.condition) == (0.5, 0.0, 0.5, 1.0, None, 0.0)
    assert (r["mean"], r.direct_ids_mean, r.profile_mean, r.task_mean) == (0.4, 0.3333, 1.0, 0.0)


def test_agent_modes(spark):
    d = spark.createDataFrame([(1, "book a dentist for my tooth pain on March 18")], "id int, task string")
    own = {"name": F.lit("Bob Smith"), "phone": F.lit("585-555-1212"), "address": F.lit("12 ABC St, Rochester, NY")}
    out = {m: governor.run_agent(d, m, profile=own, rewrite=F.lit("Output: a dentist with time in March please")).first() for m in ("naive", "redaction", "rewrite", "governor")}
    assert out["naive"].outbound == out["naive"].payload and "Bob Smith" in out["naive"].outbound
    assert out["rewrite"].outbound == "a dentist with time in March please" and {r.category for r in out.values()} == {"medical"}
    assert "Bob" not in out["governor"].outbound and "March 18" not in out["redaction"].outbound
    with pytest.raises(ValueError):
        governor.run_agent(d, "other")


def test_generated_answers(spark):
    assert one(spark, generate.listed_variants(F.lit('```json\n["a", "b"]\n```'))) == ["a", "b"]
    assert one(spark, generate.listed_variants(F.lit('1. "one"\ntext\n2) two'))) == ["one", "two"]
    assert one(spark, generate.listed_variants(F.lit("[broken"))) == [] and one(spark, generate.listed_variants(F.lit("none"))) == []


def test_numbered_rows(spark):
    from veilframe.session import numbered

    d = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1009).alias("k"))
    assert [r.n for r in sorted(numbered(d, "n", "k").collect(), key=lambda r: r.k)] == list(range(1000))
    assert numbered(d.limit(0), "n", "k").count() == 0


def test_windows_text(spark, tmp_path):
    from veilframe.sources import state

    for raw, want in (('{"name": "“Zoë” €"}'.encode("cp1252"), "“Zoë” €"), (b'{"name": "a\x81\xe9"}', "a\x81é"), ('\ufeff{"name": "é"}'.encode(), "é")):
        p = tmp_path / "y.json"
        p.write_bytes(raw)
        assert state.read_text_json(spark, str(p), "name string").first().name == want
    assert state.providers(spark).filter("category = 'dental'").count() == 3


def _talk(spark):
    return spark.sql("select 1 as id, 'find help' as task, 'I want vegan food. Please reserve seats for 4 people by March 5.' as payload union all select 2, 'find help', null union all select 3, 'find help', ''")


def test_model_asks_for_each_item_where_lines_cannot_be_read(spark):
    factory = lambda: lambda ps: ["KEEP" if "KEEP or DROP" in p else "no lines" if "numbered" in p else "a few.\nmore" for p in ps]
    rows = {r.id: r for r in governor.sanitize_with_model(_talk(spark), factory).collect()}
    said = {a.span.span_type: (a.abstracted_text, a.method) for a in rows[1].abstractions}
    assert said["party_size"] == ("a few", "llm") and {d.reason for d in rows[1].decisions} == {"rule:fallback:keep"}
    assert not rows[3].decisions and not rows[3].abstractions


def test_failing_model_leaves_the_rules(spark):
    def factory():
        def ask(ps):
            raise OSError("gone")

        return ask

    asked = {r.id: r.cloud_payload for r in governor.sanitize_with_model(_talk(spark), factory).collect()}
    assert asked == {r.id: r.cloud_payload for r in governor.sanitize_with_trace(_talk(spark)).collect()}


def test_routed_by_provider(spark):
    from veilframe.operators import models

    d = spark.createDataFrame([(1, "a", "up"), (2, "b", "none"), (3, None, "up"), (4, "d", None)], "id int, p string, by string")
    out = {r.id: r.a for r in models.routed(d, "p", "by", "a", {"up": lambda: lambda xs: [x.upper() for x in xs]}).collect()}
    assert out[1].text == "A" and out[2].text == "[model error: unknown provider]" and out[3].text is None and not out[4].ok
    assert models.routed(d.limit(0), "p", "by", "a", {}).count() == 0


def test_default_recognizer(spark):
    from veilframe.operators.recognizers import default_recognizer

    got = one(spark, default_recognizer(F.lit("See Mr. Lee Wong at Oak Hill Clinic next Monday in Paris, TX. The Italian place is 20 euros.")))
    assert {(x.label, x.text) for x in got if not x.is_chunk} == {("PERSON", "Mr. Lee Wong"), ("ORG", "Oak Hill Clinic"), ("DATE", "next Monday"), ("GPE", "Paris, TX"), ("NORP", "Italian"), ("MONEY", "20 euros")}
    assert one(spark, default_recognizer(F.lit(""))) == [] and one(spark, default_recognizer(F.lit(None).cast("string"))) is None
