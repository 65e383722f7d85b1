"""Stage 2: which candidate spans a task needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe import constants as c
from veilframe.functions.textfn import cleaned
from veilframe.operators.spans import filled, placeholder


def task_frame(task: Column, u_med: Column) -> Column:
    """The task, the constraints that its candidates show, and its symptoms."""
    types = F.transform(u_med, lambda s: s["span_type"])
    labels = F.filter(F.array(*(F.when(F.arrays_overlap(types, F.array(*map(F.lit, ts))), label) for ts, label in c.FRAME_LABELS)), lambda x: x.isNotNull())
    part = lambda t: F.exists(F.array(*map(F.lit, c.SYMPTOM_PARTS)), lambda k: F.contains(F.lower(t), k))
    signs = F.transform(F.filter(u_med, lambda s: (s["span_type"] == "noun_phrase") & part(s["text"])), lambda s: s["text"])
    more = lambda head, xs: F.when(F.size(xs) > 0, F.concat(F.lit(head), F.array_join(xs, ", "))).otherwise("")
    return F.concat(F.trim(task), more("; constraints: ", labels), more("; symptoms: ", signs))


def first_line(answer: Column) -> Column:
    """First line of a model's answer that is not blank."""
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return F.coalesce(F.get(lines, 0), F.trim(answer))


def rule_keep(kind: Column) -> Column:
    """Types to drop are listed; unknown ones stay."""
    return ~kind.isin(*c.DROP_TYPES)


def parsed_decisions(answer: Column, n: Column) -> Column:
    """array<boolean> of KEEP and DROP in a model's numbered answer, by order; null if there are not n of them."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"(?im)^\s*\d+[.):]?\s*(KEEP|DROP)\b"), F.lit(1)), lambda x: F.upper(x) == "KEEP")
    return F.when(F.size(found) == n, found)


def decide(u_med: Column, verdicts: Column | None = None, source: str = "rule") -> Column:
    """array<struct<span, kept, reason>>. verdicts: a model's decisions, or null where the rules decide."""

    def one(s: Column, i: Column) -> Column:
        rule = rule_keep(s["span_type"])
        kept, by = rule, F.lit(source)
        if verdicts is not None:
            given = F.get(verdicts, i)
            kept = F.coalesce(given, rule)
            by = F.when(given.isNotNull(), F.lit("llm")).otherwise(F.lit("rule:fallback"))
        hard = ~kept & s["span_type"].isin(*c.HARD_KEEP_TYPES)
        reason = F.when(hard, "rule:hard_keep_scheduling").otherwise(F.concat(by, F.when(kept, ":keep").otherwise(":drop")))
        return F.struct(s.alias("span"), (kept | hard).alias("kept"), reason.alias("reason"))

    return F.transform(u_med, one)


def carry_over(df: DataFrame, task: str = "task", verdicts: Column | None = None, frame: Column | None = None) -> DataFrame:
    """df with decisions, kept, dropped and task_frame. frame overrides the derived one where it is not null."""
    derived = task_frame(F.col(task), F.col("u_med"))
    df = df.withColumn("decisions", decide(F.col("u_med"), verdicts))
    pick = lambda keep: F.transform(F.filter("decisions", lambda d: d["kept"] if keep else ~d["kept"]), lambda d: d["span"])
    return df.withColumns({"kept": pick(True), "dropped": pick(False), "task_frame": derived if frame is None else F.coalesce(frame, derived)})


def kept_payload(df: DataFrame, payload: str = "payload") -> Column:
    """The payload with kept spans as they are, withheld ones as placeholders, dropped ones gone, cleaned up."""
    kept = F.transform("kept", lambda s: s["start"])
    slot = lambda s: F.when(s["bucket"] == "U_loc", placeholder(s)).when(F.array_contains(kept, s["start"]), s["text"]).otherwise("")
    return cleaned(filled(F.col(payload), F.col("all_spans"), slot))
