"""The governor end to end, method fan-out and evaluation. Every step is narrow but the last means and the history."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe import constants as c
from veilframe.operators import abstraction, carryover, facts, models, payload, spans
from veilframe.session import through_parquet


def sanitize_with_trace(df: DataFrame, text: str = "payload", task: str = "task", profile: dict[str, Column] | None = None, recognizer: spans.Recognizer | None = None, **kw) -> DataFrame:
    """df with spans, decisions, abstractions, binding_table, internal_payload and cloud_payload."""
    df = spans.extract(df, text, profile, recognizer, kw.get("found"))
    df = carryover.carry_over(df, task, kw.get("verdicts"), kw.get("frame"))
    df = abstraction.abstract(df, text, kw.get("answers"), kw.get("strict_age", False))
    return df.withColumn("binding_table", spans.binding_table(F.col("u_loc")))


def sanitize(df: DataFrame, text: str = "payload", task: str = "task", **kw) -> DataFrame:
    return sanitize_with_trace(df, text, task, **kw).select(*df.columns, "cloud_payload")


def by_method(df: DataFrame, text: str = "payload", task: str = "task", profile: dict[str, Column] | None = None, rewrite: Column | None = None) -> DataFrame:
    """A row for each payload and method; all methods of a payload come from one pass over it."""
    done = sanitize_with_trace(df, text, task, profile=profile).withColumn("_redacted", payload.redacted(F.col(text)))
    parts = {"naive": F.col(text), "redaction": F.col("_redacted"), "governor": F.col("cloud_payload")}
    if rewrite is not None:
        parts["rewrite"] = payload.rewritten(rewrite)
    made = F.array(*(F.struct(F.lit(m).alias("method"), parts[m].alias("sanitized")) for m in c.METHODS if m in parts))
    return done.select(*df.columns, F.inline(made))


def scored(rows: DataFrame, current: str, residual: str, text: str = "payload", request: str = "task", profile: str | None = None, history: str | None = None, digits: int | None = None) -> DataFrame:
    """rows of by_method with the leakage metrics of each; ratios by source where the facts of profile and history are given,
    rounded to `digits` a row where given."""
    p = F.col("sanitized")
    shown = lambda x: x if digits is None else F.round(x, digits)
    r = rows.withColumn("leaked_cur", facts.leaking(p, F.col(current))).withColumn("leaked_res", facts.leaking(p, F.col(residual)))
    sources = {k: f for k, f in (("prof", profile), ("hist", history)) if f is not None}
    for k, f in sources.items():
        r = r.withColumn(f"leaked_{k}", facts.leaking(p, F.col(f)))
    return r.withColumns({
        "lr": (F.size("leaked_cur") > 0).cast("int"),
        "lratio": shown(facts.ratio(F.col("leaked_cur"), F.col(current))),
        "rlr": (F.size("leaked_res") > 0).cast("int"),
        "rlratio": shown(facts.ratio(F.col("leaked_res"), F.col(residual), 0.0)),
        "ils": shown(facts.injection(p, F.col(request), F.col(residual))),
        "pr": shown(facts.reduction(F.col(text), p)),
        "tokens": facts.tokens(p),
        **{f"lratio_{k}": shown(facts.ratio(F.col(f"leaked_{k}"), F.col(f))) for k, f in sources.items()},
    })


def run_agent(df: DataFrame, mode: str, task: str = "task", profile: dict[str, Column] | None = None, availability: Column | None = None, answer: Column | None = None, rewrite: Column | None = None) -> DataFrame:
    """One run of the agent in a mode (a method): the naive payload of each task, what leaves the device, the service's
    category and the form's fields that the mode discloses.

    answer and rewrite: a local model's texts, where there are any."""
    if mode not in c.METHODS:
        raise ValueError(f"mode is one of {c.METHODS}")
    own = profile or {}
    made = payload.naive_payload(F.col(task), own, F.lit("") if availability is None else availability, answer)
    df = df.withColumn("_made", made).withColumns({"reasoning": F.col("_made.reasoning"), "payload": F.col("_made.query")}).drop("_made")
    if mode == "governor":
        df = sanitize(df, "payload", task, profile=own).withColumnRenamed("cloud_payload", "outbound")
    else:
        said = {"naive": lambda: F.col("payload"), "redaction": lambda: payload.redacted(F.col("payload")), "rewrite": lambda: payload.rewritten(rewrite)}
        df = df.withColumn("outbound", said[mode]())
    return df.withColumn("mode", F.lit(mode)).withColumn("category", payload.category(F.col(task)))


def sanitize_with_model(df: DataFrame, factory: models.Factory, text: str = "payload", task: str = "task", profile: dict[str, Column] | None = None, recognizer: spans.Recognizer | None = None, strict_age: bool = False) -> DataFrame:
    """sanitize_with_trace with a local model that says what to keep and words what no rule can. Where its answers can't be
    read, the rules decide and the fallback phrases stand in."""
    df = models.decided(spans.extract(df, text, profile, recognizer), task, "_verdicts", factory)
    df = carryover.carry_over(df, task, F.col("_verdicts"))
    df = models.phrased(df, text, "_phrases", factory)
    df = abstraction.abstract(df, text, F.col("_phrases"), strict_age).drop("_verdicts", "_phrases")
    return df.withColumn("binding_table", spans.binding_table(F.col("u_loc")))


def compared(rows: DataFrame, factories: dict[str, models.Factory], text: str = "sanitized") -> DataFrame:
    """rows of by_method times the service's models: what each answers, the tokens of its question and answer, and
    its latency."""
    some = rows.withColumn("provider", F.explode(F.array(*map(F.lit, factories))))
    some = models.routed(some, text, "provider", "_answer", factories)
    return some.select(*rows.columns, "provider", F.col("_answer.text").alias("answer"), F.col("_answer.in_tokens").alias("in_tokens"), F.col("_answer.out_tokens").alias("out_tokens"), F.col("_answer.seconds").alias("latency_s"))


def inference_attack(rows: DataFrame, truth: dict[str, Column], attacker: models.Factory, judge: models.Factory, text: str = "sanitized") -> DataFrame:
    """A row for each of rows and attacked field: what an attacker guesses from the text and a judge's score of it (0 where
    either gave no readable answer)."""
    fields = tuple(truth)
    true = F.create_map(*(x for f, v in truth.items() for x in (F.lit(f), F.coalesce(v.cast("string"), F.lit("unknown")))))
    df = models.answered(rows.withColumn("_ask", models.inference_prompt(F.col(text), fields)), "_ask", "_guess", attacker)
    none = F.expr("cast(map() as map<string,string>)")
    df = df.withColumn("_guess", F.when(F.col("_guess.ok"), facts.json_object(F.col("_guess.text"), "map<string,string>"))).withColumn("_guess", F.coalesce("_guess", none))
    df = df.withColumn("_ask", models.judge_prompt(F.to_json(true), F.to_json(F.col("_guess"))))
    df = models.answered(df, "_ask", "_score", judge)
    df = df.withColumn("_score", F.when(F.col("_score.ok"), facts.json_object(F.col("_score.text"), "map<string,double>")))
    out = df.withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    pick = lambda m: F.try_element_at(m, F.col("field"))
    return out.select(*rows.columns, "field", F.coalesce(pick(F.col("_guess")), F.lit("unknown")).alias("guess"), F.coalesce(pick(F.col("_score")), F.lit(0.0)).alias("score"))


def stage_timings(df: DataFrame, text: str = "payload", task: str = "task", profile: dict[str, Column] | None = None, recognizer: spans.Recognizer | None = None, model: str = "rules", factory: models.Factory | None = None) -> DataFrame:
    """One row of what a payload costs by stage: model, n, stage1_s, stage2_s, stage3b_s, total_s (seconds of the whole job
    over n), spans_kept and tokens (means). For facts.stage_shares.

    Each stage's rows are written and read again, so a stage's time is its own, with that of its files; columns that no later
    stage reads are written by their own stage alone. Without rows the
    means are null. factory: the local model of stages 2 and 3, if any."""
    marks = [time.monotonic()]

    def done(rows: DataFrame) -> DataFrame:
        out = through_parquet(rows)
        marks.append(time.monotonic())
        return out

    found = done(spans.extract(df, text, profile, recognizer)).drop("context", "tagged", "working")
    verdicts = None if factory is None else F.col("_verdicts")
    chosen = done(carryover.carry_over(found if factory is None else models.decided(found, task, "_verdicts", factory), task, verdicts)).drop("decisions", "dropped", "u_loc", "u_med")
    answers = None if factory is None else F.col("_phrases")
    safe = done(abstraction.abstract(chosen if factory is None else models.phrased(chosen, text, "_phrases", factory), text, answers))
    n = F.count(F.lit(1))
    took = [b - a for a, b in zip(marks, marks[1:])]
    per = lambda seconds, name: F.try_divide(F.lit(seconds), n).alias(name)
    stages = [per(t, k) for t, k in zip((*took, sum(took)), ("stage1_s", "stage2_s", "stage3b_s", "total_s"))]
    return safe.agg(F.lit(model).alias("model"), n.alias("n"), *stages, F.avg(F.size("kept")).alias("spans_kept"), F.avg(facts.tokens(F.col("cloud_payload"))).alias("tokens"))
