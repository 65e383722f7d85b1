"""Optional language models: one small interface, used through Arrow batches. Nothing here is needed by the rule path.

Answers count as nondeterministic: each prompt is asked once, and no lambda is merged with the asking."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators import abstraction, carryover

Generate = Callable[[list[str]], list[str]]
"""Prompts to answers; called once a batch, made once a worker by a factory."""


Factory = Callable[[], Generate]
ANSWER = "text string, in_tokens int, out_tokens int, ok boolean, seconds double"


def _asked(generate: Generate, prompts: pd.Series, error: str) -> pd.DataFrame:
    """An answer for each prompt that is not null, by one call. If it fails, each has the error as its text and ok is false.

    seconds: the call's share of each prompt, null where none was asked."""
    out = pd.DataFrame({"text": pd.Series(None, index=prompts.index, dtype=object), "in_tokens": 0, "out_tokens": 0, "ok": False, "seconds": float("nan")})
    some = prompts[prompts.notna()]
    if len(some):
        begun = time.monotonic()
        try:
            texts, ok = list(generate(some.tolist())), True
            if len(texts) != len(some):
                raise ValueError(f"{len(texts)} answers to {len(some)} prompts")
        except Exception as e:  # a model is a remote thing
            texts, ok = [error.format(e)] * len(some), False
        out.loc[some.index, "seconds"] = (time.monotonic() - begun) / len(some)
        out.loc[some.index, "text"] = texts
        out.loc[some.index, "ok"] = ok
        if ok:
            out.loc[some.index, "in_tokens"] = [len(x.split()) for x in some]
            out.loc[some.index, "out_tokens"] = [len((t or "").split()) for t in texts]
    return out


def answered(df: DataFrame, prompt: str, out: str, factory: Factory, error: str = "[model error: {}]") -> DataFrame:
    """df with a struct column: text, in_tokens, out_tokens (white-space words), ok, seconds. A null prompt is not asked and has a null
    text; a failing batch is answered with the error."""

    @F.pandas_udf(ANSWER)
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        generate = factory()
        for s in batches:
            yield _asked(generate, s, error)

    return df.withColumn(out, ask.asNondeterministic()(F.col(prompt)))


def routed(df: DataFrame, prompt: str, provider: str, out: str, factories: dict[str, Factory], error: str = "[model error: {}]") -> DataFrame:
    """As answered, each row by the model of its provider; an unknown provider is answered with the error."""

    @F.pandas_udf(ANSWER)
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        made: dict[str, Generate] = {}

        def unknown(_: list[str]) -> list[str]:
            raise ValueError("unknown provider")

        for prompts, names in batches:
            parts = []
            for name, rows in prompts.groupby(names.fillna("")):
                if name not in made:
                    made[name] = factories[name]() if name in factories else unknown
                parts.append(_asked(made[name], rows, error))
            yield pd.concat(parts).reindex(prompts.index) if parts else _asked(unknown, prompts, error)

    return df.withColumn(out, ask.asNondeterministic()(F.col(prompt), F.col(provider)))


def answered_each(df: DataFrame, prompts: str, out: str, factory: Factory) -> DataFrame:
    """df with array<string>: an answer to each prompt of an array, null where its call failed; null arrays are not asked."""

    @F.pandas_udf("array<string>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generate = factory()

        def one(p: str) -> str | None:
            got = _asked(generate, pd.Series([p]), "").iloc[0]
            return got["text"] if got["ok"] else None

        for s in batches:
            yield s.map(lambda ps: None if ps is None else [one(p) for p in ps])

    return df.withColumn(out, ask.asNondeterministic()(F.col(prompts)))


def unresolved_only(df: DataFrame, needs: Column, prompt: str, out: str, factory: Factory) -> DataFrame:
    """Asks for the rows that need an answer only; the others have null. One pass over df."""
    asked = answered(df.withColumn(prompt, F.when(needs, F.col(prompt))), prompt, out, factory)
    return asked.withColumn(out, F.when(F.col(prompt).isNotNull(), F.col(out)))


def numbered(items: Column) -> Column:
    """A numbered list for a prompt."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def keep_drop_prompt(frame: Column, u_med: Column) -> Column:
    items = F.transform(u_med, lambda s: F.concat(s["text"], F.lit(" ("), s["span_type"], F.lit(")")))
    return F.concat(F.lit("Task: "), frame, F.lit("\nAnswer KEEP or DROP for each item, one a line, numbered.\n"), numbered(items))


def abstraction_prompt(frame: Column, texts: Column, levels: Column) -> Column:
    items = F.transform(F.arrays_zip(texts.alias("t"), levels.alias("l")), lambda x: F.concat(F.lit("replace '"), x["t"], F.lit("' by: "), x["l"]))
    return F.concat(F.lit("Task: "), frame, F.lit("\nGive one general phrase for each item, numbered.\n"), numbered(items))


def item_prompts(frame: Column, texts: Column, levels: Column) -> Column:
    """A prompt for each item, for where the numbered answer can't be read."""
    return F.transform(F.arrays_zip(texts.alias("t"), levels.alias("l")), lambda x: F.concat(F.lit("Task: "), frame, F.lit("\nGive one general phrase.\nreplace '"), x["t"], F.lit("' by: "), x["l"]))


def decided(df: DataFrame, task: str, out: str, factory: Factory) -> DataFrame:
    """df (after extract) with a model's decisions on u_med as array<boolean>; null where it gave no full list."""
    frame = carryover.task_frame(F.col(task), F.col("u_med"))
    df = df.withColumn("_ask", keep_drop_prompt(frame, F.col("u_med")))
    df = unresolved_only(df, F.size("u_med") > 0, "_ask", "_said", factory)
    return df.withColumn(out, carryover.parsed_decisions(F.col("_said.text"), F.size("u_med"))).drop("_ask", "_said")


def phrased(df: DataFrame, payload: str, out: str, factory: Factory) -> DataFrame:
    """df (after carry_over) with a model's phrases, map of span start to text: one call for all that neither a level nor a
    rule settles; where its numbered lines can't be read, a call for each; no entry where that fails too."""
    part = lambda k: F.transform("_open", lambda x: x[k])
    frame = F.col("task_frame")
    df = df.withColumn("_open", abstraction.unsettled(df, payload)).withColumn("_ask", abstraction_prompt(frame, part("text"), part("goal")))
    df = unresolved_only(df, F.size("_open") > 0, "_ask", "_said", factory)
    df = df.withColumn("_all", abstraction.numbered_answers(F.col("_said.text"), F.size("_open")))
    df = df.withColumn("_each", F.when((F.size("_open") > 0) & F.col("_all").isNull(), item_prompts(frame, part("text"), part("goal"))))
    df = answered_each(df, "_each", "_ones", factory)
    first = lambda x: F.nullif(F.regexp_replace(F.trim(F.get(F.split(F.trim(x), "\n"), 0)), "[.,;]+$", ""), F.lit(""))
    texts = F.coalesce("_all", F.transform("_ones", first))
    return df.withColumn(out, F.map_from_arrays(part("start"), texts)).drop("_open", "_ask", "_said", "_all", "_each", "_ones")


def inference_prompt(payload: Column, fields: tuple[str, ...]) -> Column:
    return F.concat(F.lit("From this text guess, as a JSON object with the keys " + ", ".join(fields) + ":\n"), payload)


def judge_prompt(truth: Column, guess: Column) -> Column:
    return F.concat(F.lit("Score 0, 0.5 or 1 how well the guess meets the truth, as a JSON object.\nTruth: "), truth, F.lit("\nGuess: "), guess)
