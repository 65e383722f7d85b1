"""Runs and reports: backstory by a model, timings, costs, merged state, summaries, slices, bookings."""

import json

from pyspark.sql import functions as F

from veilframe.operators import carryover, facts, generate, models, payload, spans
from veilframe.plans import governor
from veilframe.sources import state

SEED = "seed_id string, domain string, intent string, service_type string, sensitive_info array<string>, domain_sensitive array<string>, general_sensitive array<string>"
S = [("s1", "d", "book", "check-up", ["a", "b"], ["a"], ["b"]), ("s2", "d", "find", "tailor", ["c"], ["c"], [])]


def test_written_backstory(spark):
    seeds = spark.createDataFrame(S, SEED)
    told = generate.written_backstory(seeds, lambda: lambda ps: [" Told: " + p.split("about: ")[1].split("\n")[0] + "\n" for p in ps])
    got = {r.from_workflow: r for r in told.collect()}
    assert got["s1"].data.result == "Told: a" and not got["s1"].fell_back and got["s2"].data.result == "Told: c"
    assert {r.from_workflow: r.gathered_at for r in generate.backstory(seeds).collect()} == {k: r.gathered_at for k, r in got.items()}

    def broken():
        def ask(ps):
            raise OSError("gone")

        return ask

    lost = {r.from_workflow: r for r in generate.written_backstory(seeds, broken).collect()}
    plain = {r.from_workflow: r.data.result for r in generate.backstory(seeds).collect()}
    assert all(r.fell_back and r.data.result == plain[k] for k, r in lost.items())
    assert generate.written_backstory(seeds.limit(0), broken).collect() == []


def test_backstory_without_a_model_keeps_its_columns(spark):
    assert generate.backstory(spark.createDataFrame(S, SEED)).columns == ["source", "gathered_at", "from_workflow", "data"]


def test_answers_have_their_time(spark):
    df = spark.createDataFrame([("a b",), (None,)], "p string")
    got = {r.p: r.x for r in models.answered(df, "p", "x", lambda: lambda ps: ["c"] * len(ps)).collect()}
    assert got["a b"].seconds >= 0 and got["a b"].ok and got[None].seconds is None and got[None].text is None


def test_stage_timings(spark):
    df = spark.createDataFrame([(1, "I am 30 years old. Book a table under $90 on March 3.", "book a table"), (2, None, None)], "id int, payload string, task string")
    t = governor.stage_timings(df)
    r = t.first()
    assert r.n == 2 and abs(r.stage1_s + r.stage2_s + r.stage3b_s - r.total_s) < 1e-9 and r.stage1_s > 0 and r.spans_kept > 0
    share = facts.stage_shares(t).first()
    assert 0 < share.s2_pct + share.s3b_pct < 100
    none = governor.stage_timings(df.limit(0)).first()
    assert none.n == 0 and none.total_s is None and none.tokens is None


def test_costs_leave_nulls_out(spark):
    rows = [("m", "p", 1.0, 10, 4), ("m", "p", None, 20, None), ("m", "q", 3.0, None, None), ("m", None, 5.0, 30, 9)]
    r = facts.costs(spark.createDataFrame(rows, "method string, provider string, latency_s double, token_count int, out_tokens int"), "method").first()
    assert (r.avg_latency_s, r.avg_token_count, r.avg_clm_tokens, r.n_answers) == (3.0, 20.0, {"p": 4.0, "q": None}, 4)


def test_first_tasks(spark):
    df = spark.createDataFrame([(s, i) for i, s in enumerate("aabcacdb")], "seed string, pos int")
    assert [tuple(r) for r in facts.first_tasks(df, "seed", "pos", 2, 1).collect()] == [("b", 2), ("c", 3)]
    assert facts.first_tasks(df, "seed", "pos", 5, 4).collect() == []


def test_merged_state(spark):
    profile = spark.createDataFrame([(1, "Ann", 30), (2, "Bo", None)], "u int, name string, age int")
    told = spark.createDataFrame([(1, "x"), (1, "x"), (3, "y"), (None, "z")], "u int, task string")
    got = sorted(((r.u or 0, r.task or "", r.user_profile and r.user_profile.name, r.contacts) for r in state.merged(profile, told, "u").collect()), key=str)
    assert got == [(0, "z", None, []), (1, "x", "Ann", []), (1, "x", "Ann", []), (2, "", "Bo", []), (3, "y", None, [])]
    assert state.merged(profile.limit(0), told.limit(0), "u").collect() == []


def test_summaries_and_their_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, "naive", "t", "p", "a"), (1, "naive", "t", "q", "b"), (1, "gov", None, "p", None)], "task int, method string, sanitized string, provider string, answer string")
    got = state.task_summaries(rows, ["task"])
    r = got.first()
    assert r.payloads == {"naive": "t", "gov": ""} and r.clm_responses == {"naive": {"p": "a", "q": "b"}, "gov": {"p": None}}
    one = state.task_summaries(rows.filter("provider = 'p'"), ["task"], provider=None).first()
    assert one.clm_responses == {"naive": "a", "gov": None}
    state.write_summary(spark, str(tmp_path / "s"), {"run": "1"}, rows.groupBy("method").count(), got)
    assert spark.read.json(str(tmp_path / "s/aggregates")).count() == 2
    back = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "s/tasks")).collect()]
    assert back[0]["task"] == 1 and back[0]["payloads"]["naive"] == "t"


def test_booked_by_submission(spark):
    forms = spark.createDataFrame([(1, "name"), (1, "phone"), (2, "name")], "id int, field string")
    sent = spark.createDataFrame([(1, "name", "Ann"), (2, "name", "Bo"), (2, "other", "x")], "id int, field string, value string")
    got = {(r.id, r.field, r.value) for r in payload.booked(forms, sent, "id").collect()}
    assert got == {(1, "name", "Ann"), (1, "phone", ""), (2, "name", "Bo")}


def test_kept_payload(spark):
    df = spark.createDataFrame([("I am 30 years old, call 585-555-0101. Book a table under $90.", "book a table")], "payload string, task string")
    done = carryover.carry_over(spans.extract(df, "payload", {"phone": F.lit("585-555-0101")}))
    assert done.select(carryover.kept_payload(done).alias("v")).first().v == "I am 30 years old, call [PHONE]. Book a table under $90."
    done = carryover.carry_over(done.drop("decisions", "kept", "dropped", "task_frame"), verdicts=F.transform("u_med", lambda s: s["span_type"] != "money"))
    text = done.select(carryover.kept_payload(done).alias("v")).first().v
    assert "30 years old" in text and "[PHONE]" in text and "$90" not in text and "585" not in text


def test_unreadable_files_are_told(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 3')
    assert sorted(r.x for r in state.read_json(spark, str(tmp_path), "x int").collect()) == [1, 2]
    bad = state.unreadable(spark, str(tmp_path), "x int").collect()
    assert [(r.path.rsplit("/", 1)[1], r.record) for r in bad] == [("b.json", '{"x": 3')]
    assert state.unreadable(spark, str(tmp_path / "none"), "x int").collect() == []
