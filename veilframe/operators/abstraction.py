"""Stage 3: kept spans rewritten to a calibrated level of generality, and the payload put together again.

Two defects of the original semantics are mended by default: slots are filled by position (not by text), and an age keeps
its own decade (`strict_age` gives the fixed phrase instead)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe import constants as c
from veilframe.functions.textfn import any_word, bound, cleaned, cloud_ready, low_words, proper_noun
from veilframe.operators import plain
from veilframe.operators.spans import filled, placeholder


def _sql(x: str | int) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "\\'") + "'"


def _map(entries: dict) -> Column:
    """A literal map, made from one SQL text."""
    return F.expr("map(" + ", ".join(f"{_sql(k)}, " + ("array(" + ", ".join(map(_sql, v)) + ")" if isinstance(v, tuple) else _sql(v)) for k, v in entries.items()) + ")")


def infer_type(kind: Column, text: Column) -> Column:
    """Abstraction type of a span from its type and words.

    The lexicons stand in order of precedence, so a word's rank is that of the first lexicon that has it and a phrase's type
    is that of its least rank."""
    names = list(c.LEXICONS)
    ranks = _map({w: r for r in reversed(range(len(names))) for w in c.LEXICONS[names[r]]})
    trip = names.index("medical_trip")
    place = lambda w: F.when(any_word(w, c.VENUES), "prior_venue").otherwise("prior_provider")

    def phrase(w: Column) -> Column:
        rank = F.coalesce(F.array_min(F.transform(w, lambda x: ranks[x])), F.lit(99))
        both = (rank > trip) & any_word(w, c.MEDICAL_TRIP) & any_word(w, c.LEXICONS["travel_itinerary"])
        proper = F.when(F.lower(F.trim(text)).isin(*c.MEDICAL_ABBREVIATIONS), "medical_condition").otherwise(place(w))
        named = F.expr("array(" + ", ".join(map(_sql, names)) + ")")
        return F.when(both, "medical_trip").when(rank < 99, F.get(named, rank)).when(proper_noun(text), proper).otherwise("generic_detail")

    preference = lambda w: F.when(any_word(w, c.LEXICONS["dietary_preference"]), "dietary_preference").when(any_word(w, c.LEXICONS["seating_preference"]), "seating_preference").otherwise("provider_preference")
    by_words = lambda w: F.when(kind == "preference", preference(w)).when(kind.isin("organization", "facility"), place(w)).when(kind == "noun_phrase", phrase(w)).otherwise("generic_detail")
    return F.coalesce(_map(c.DIRECT_TYPES)[kind], bound(low_words(text), by_words))


def level_of(kind: Column) -> Column:
    return F.coalesce(_map(c.LEVELS)[kind], F.lit(1))


def rule_date(text: Column, level: Column) -> Column:
    month = F.initcap(F.substr(F.regexp_extract(text, c.MONTH, 1), F.lit(1), F.lit(3)))
    names = F.create_map(*(F.lit(x) for n in ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December") for x in (n[:3], n)))
    full = names[month]
    days = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,2})(?:st|nd|rd|th)?\b"), F.lit(1)), lambda d: d.cast("int"))
    least = F.array_min(days)
    part = F.when(least <= 10, "early").when(least <= 20, "mid").otherwise("late")
    plain = F.concat(F.lit("in "), full)
    return F.when(
        month != "",
        F.when(level == 0, plain)
        .when(level == 1, F.when(F.size(days) > 0, F.concat(part, F.lit("-"), full)).otherwise(plain))
        .when(level == 2, F.when(F.size(days) >= 2, F.concat(full, F.lit(" "), F.get(days, 0), F.lit("–"), F.element_at(days, -1))).when(F.size(days) == 1, F.concat(F.lit("around "), full, F.lit(" "), F.get(days, 0))).otherwise(plain)),
    )


def rule_time(text: Column, level: Column) -> Column:
    p = r"\b(\d{1,2})(?::(\d{2}))?\s*(AM|PM|am|pm)\b"
    h, half = F.regexp_extract(text, p, 1), F.upper(F.regexp_extract(text, p, 3))
    bare = F.regexp_extract(text, r"\b(\d{1,2}):(\d{2})\b", 1)
    twelve = h.cast("int")
    hour = F.when(h != "", F.when((half == "PM") & (twelve != 12), twelve + 12).when((half == "AM") & (twelve == 12), 0).otherwise(twelve)).when(bare != "", bare.cast("int"))
    two = F.floor(hour / 2).cast("int") * 2
    clock = F.when(two <= 12, two).otherwise(two - 12)
    shown = F.when(clock == 0, 12).otherwise(clock).cast("string")
    return (
        F.when(level == 0, F.when(hour < 12, "morning").when(hour < 17, "afternoon").when(hour.isNotNull(), "evening"))
        .when(level == 1, F.concat(hour.cast("string"), F.lit(":00–"), (hour + 1).cast("string"), F.lit(":00")))
        .when(level == 2, F.concat(F.lit("around "), shown, F.when(two < 12, " AM").otherwise(" PM")))
    )


def rule_address(text: Column, level: Column) -> Column:
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    last, n = F.element_at(parts, -1), F.size(parts)
    return F.when(level == 0, F.when((n >= 2) & (last != ""), F.concat(last, F.lit(" area"))).otherwise("local area")).when(
        level == 1, F.when(n >= 3, F.concat(F.get(parts, n - 2), F.lit(", "), last)).otherwise(text)
    )


def rule_age(text: Column, level: Column) -> Column:
    age = F.nullif(F.regexp_extract(text, r"\b(\d{1,3})\b", 1), F.lit("")).cast("int")
    five = F.floor(age / 5).cast("int") * 5
    return F.when(
        age.isNotNull(),
        F.when(level == 0, "an adult")
        .when(level == 1, F.concat(F.lit("in their "), (F.floor(age / 10).cast("int") * 10).cast("string"), F.lit("s")))
        .when(level == 2, F.concat(F.lit("in the "), five.cast("string"), F.lit("–"), (five + 4).cast("string"), F.lit(" age range"))),
    )


def rule_phrase(kind: Column, text: Column, level: Column) -> Column:
    return (
        F.when(kind == "date", rule_date(text, level))
        .when(kind == "time", rule_time(text, level))
        .when(kind.isin("address", "location"), rule_address(text, level))
        .when(kind == "zip", F.when(level == 0, "local area").otherwise("nearby area"))
        .when(kind == "age", rule_age(text, level))
    )


def fallback_phrase(kind: Column, level: Column) -> Column:
    found = lambda ps: F.coalesce(F.get(ps, level), F.element_at(ps, -1), F.lit("general context"))
    return bound(_map(c.PHRASES)[kind], found)


def tidy_answer(text: Column) -> Column:
    """A model's phrase without quotes and introductions."""
    intro = r"""(?i)^(?:generalized\s+span\s*[:=]|abstracted?\s*[:=]|the\s+abstraction\s+(?:is|for)\s*[:=]|output\s*[:=]|result\s*[:=]|answer\s*[:=])\s*["']?"""
    bare = lambda t: F.regexp_replace(F.trim(t), r"""^["'\s]+|["'\s]+$""", "")
    return bare(F.regexp_replace(bare(text), intro, ""))


def numbered_answers(answer: Column, n: Column) -> Column:
    """array<string> of a model's numbered lines 1 to n; null unless each number is there."""
    p = r"(?m)^\s*(\d+)[.):]\s*(.+?)\s*$"
    nums, texts = F.regexp_extract_all(answer, F.lit(p), F.lit(1)), F.regexp_extract_all(answer, F.lit(p), F.lit(2))
    by = F.map_from_entries(F.array_distinct(F.transform(nums, lambda x, i: F.struct(x.cast("int").alias("k"), F.get(texts, F.array_position(nums, x).cast("int") - 1).alias("v")))))
    out = F.transform(F.sequence(F.lit(1), n), lambda k: by[k])
    return F.when(F.forall(out, lambda x: x.isNotNull()), out)


def validate(kind: Column, text: Column, strict_age: bool = False) -> Column:
    """'passed' or 'failed:' and the reason."""
    words = low_words(text)
    if not strict_age:  # any decade will do
        words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z0-9]+\b"), F.lit(0)), lambda x: F.when(F.regexp_like(x, F.lit(r"^\d+s$")), "30s").otherwise(x))
    required, prohibited = _map(c.REQUIRED), _map(c.PROHIBITED)

    def check(w: Column) -> Column:
        lacks = F.coalesce(~F.arrays_overlap(w, required[kind]), F.lit(False))
        holds = F.coalesce(F.arrays_overlap(w, prohibited[kind]), F.lit(False))
        return (
            F.when(F.length(F.trim(text)) < 2, "failed:empty output")
            .when(lacks, F.concat(F.lit("failed:not "), kind, F.lit("-like")))
            .when(holds, "failed:contains prohibited terms")
            .when(kind.isin(*c.NO_PROPER_NOUN) & proper_noun(text), "failed:appears to be a proper noun (entity type change)")
            .otherwise("passed")
        )

    return bound(words, check)


def islands(typed: Column, payload: Column) -> Column:
    """typed spans (struct with span and kind, by start) with anchor: the start of the first span of their group. Spans of a
    groupable type belong together while no sentence ends between them."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(F.filter(acc, lambda a: a["kind"] == x["kind"]), -1)
        has = F.exists(acc, lambda a: a["kind"] == x["kind"]) & x["kind"].isin(*c.GROUPED_TYPES)
        between = F.substr(payload, last["span"]["end"] + 1, F.greatest(F.lit(0), x["span"]["start"] - last["span"]["end"]))
        anchor = F.when(has & ~F.regexp_like(between, F.lit("[.!?]")), last["anchor"]).otherwise(x["span"]["start"])
        return F.concat(acc, F.array(F.struct(x["span"].alias("span"), x["kind"].alias("kind"), anchor.alias("anchor"))))

    from veilframe.schemas import SPAN

    return F.aggregate(typed, F.expr(f"cast(array() as array<struct<span:{SPAN},kind:string,anchor:int>>)"), lambda a, x: F.when(F.size(a) == 0, F.array(F.struct(x["span"].alias("span"), x["kind"].alias("kind"), x["span"]["start"].alias("anchor")))).otherwise(step(a, x)))


def typed_spans(kept: Column) -> Column:
    return F.transform(kept, lambda s: F.struct(s.alias("span"), infer_type(s["span_type"], s["text"]).alias("kind")))


def by_rule(kind: Column, text: Column, level: Column) -> Column:
    """The phrase of a span that stands alone, null where only a model or the fallback has one."""
    return F.when(level == 3, text).otherwise(rule_phrase(kind, text, level))


def unsettled(df: DataFrame, payload: str = "payload") -> Column:
    """array<struct<start, text, goal>> of df (after carry_over): groups that neither a level nor a rule settles, with the
    texts of their spans and the level's phrase."""

    def items(groups: Column) -> Column:
        def one(g: Column) -> Column:
            own = F.filter(groups, lambda o: o["anchor"] == g["anchor"])
            level = level_of(g["kind"])
            rule = F.when(F.size(own) == 1, by_rule(g["kind"], g["span"]["text"], level))
            text = F.array_join(F.transform(own, lambda o: o["span"]["text"]), ", ")
            return F.struct(g["span"]["start"].alias("start"), text.alias("text"), fallback_phrase(g["kind"], level).alias("goal"), rule.isNull().alias("open"))

        anchors = F.filter(groups, lambda g: g["anchor"] == g["span"]["start"])
        return F.transform(F.filter(F.transform(anchors, one), lambda x: x["open"]), lambda x: F.struct(x["start"].alias("start"), x["text"].alias("text"), x["goal"].alias("goal")))

    return bound(islands(typed_spans(F.col("kept")), F.col(payload)), items)


def abstract(df: DataFrame, payload: str = "payload", answers: Column | None = None, strict_age: bool = False) -> DataFrame:
    """df (after carry_over) with abstractions, internal_payload and cloud_payload.

    answers: a model's phrases, map of span start to text, used where neither the level nor a rule settles a span."""
    easy = F.lit(None).cast(plain.ABSTRACTED)
    if answers is None:
        easy = plain.abstracted(F.when(plain.ascii_only(F.col(payload)), F.col(payload)), F.col("all_spans"), F.transform("kept", lambda s: s["start"]), strict_age)
    df = df.withColumn("_easy", easy)
    text, kept = (F.when(F.col("_easy.internal").isNull(), F.col(k)) for k in (payload, "kept"))
    df = df.withColumn("_typed", typed_spans(kept)).withColumn("_groups", islands(F.col("_typed"), text))

    def settled(g: Column) -> Column:
        s, kind = g["span"], g["kind"]
        level = level_of(kind)
        alone = F.size(F.filter("_groups", lambda o: o["anchor"] == g["anchor"])) == 1
        rule = F.when(alone, by_rule(kind, s["text"], level))
        said = tidy_answer(answers[s["start"]]) if answers is not None else F.lit(None).cast("string")
        return F.struct(g.alias("g"), level.alias("level"), (alone & (level == 3)).alias("verbatim"), rule.alias("rule"), said.alias("said"), fallback_phrase(kind, level).alias("fallback"))

    def checked(x: Column) -> Column:
        first = F.coalesce(x["rule"], x["said"], x["fallback"])
        check = F.when(x["verbatim"], "n/a").otherwise(validate(x["g"]["kind"], first, strict_age))
        return F.struct(x.alias("x"), first.alias("first"), check.alias("check"))

    def told(y: Column) -> Column:
        x, s = y["x"], y["x"]["g"]["span"]
        failed, anchor = F.startswith(y["check"], F.lit("failed")), y["x"]["g"]["anchor"] == y["x"]["g"]["span"]["start"]
        method = F.when(failed, "rule").when(x["verbatim"], "verbatim").when(x["rule"].isNotNull() | x["said"].isNull(), "rule").otherwise("llm")
        return F.struct(
            s.alias("span"),
            x["g"]["kind"].alias("abstraction_type"),
            x["level"].alias("level"),
            F.when(~anchor, "").when(failed, x["fallback"]).otherwise(y["first"]).alias("abstracted_text"),
            F.when(anchor, method).otherwise("grouped").alias("method"),
            F.when(~anchor, "n/a").when(failed, F.concat(y["check"], F.lit(" → fallback"))).otherwise(y["check"]).alias("validation"),
        )

    steps = F.transform(F.transform(F.transform("_groups", settled), checked), told)
    given = F.zip_with("kept", "_easy.told", lambda s, t: F.struct(s.alias("span"), *(t[k].alias(k) for k in ("abstraction_type", "level", "abstracted_text", "method", "validation"))))
    df = df.withColumn("abstractions", F.when(F.col("_easy.internal").isNotNull(), given).otherwise(steps)).drop("_typed", "_groups")
    texts = F.map_from_arrays(F.transform("abstractions", lambda a: a["span"]["start"]), F.transform("abstractions", lambda a: a["abstracted_text"]))
    df = df.withColumn("_by", texts)
    slot = lambda s: F.when(s["bucket"] == "U_loc", placeholder(s)).otherwise(F.coalesce(F.col("_by")[s["start"]], F.lit("")))
    df = df.withColumn("internal_payload", F.coalesce("_easy.internal", cleaned(filled(text, F.col("all_spans"), slot)))).drop("_by")
    rest = F.when(F.col("_easy.cloud").isNull(), F.col("internal_payload"))
    return df.withColumn("cloud_payload", F.coalesce("_easy.cloud", cloud_ready(rest))).drop("_easy")
