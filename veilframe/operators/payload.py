"""Payloads: enrichment, templates, mandatory context, answers of services, forms; and whole-payload baselines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import constants as c
from veilframe.functions.textfn import bound, cloud_ready
from veilframe.operators import plain
from veilframe.operators.spans import filled, pattern_spans, recognized_spans, resolve_few


_TEXTS = "array<string>"


def _slots(data: Column, key: str) -> Column:
    """Strings of a list in a trace's JSON."""
    return F.coalesce(F.from_json(F.get_json_object(data, f"$.{key}"), _TEXTS), F.expr(f"cast(array() as {_TEXTS})"))


def _is(data: Column, mark: str) -> Column:
    return F.startswith(F.ltrim(data), F.lit(mark))


def enriched(task: Column, profile: dict[str, Column], traces: Column) -> Column:
    """The task with every profile field and every trace (struct source, gathered_at, from_workflow, data as JSON or text)."""
    said = lambda xs: F.when(F.size(xs) > 0, F.array_join(xs, ", ")).otherwise("none")

    def one(t: Column) -> Column:
        d, source = t["data"], t["source"]
        head = lambda name: F.concat(F.lit("  ["), name, F.lit(' | from: "'), t["from_workflow"], F.lit('" | '), F.substr(t["gathered_at"], F.lit(1), F.lit(10)), F.lit("]\n"))
        calendar = F.concat(F.lit("    availability: "), said(_slots(d, "free_slots")), F.lit("\n    busy:         "), said(_slots(d, "busy_slots")))
        booking = F.concat(F.lit("    booked_at: "), F.coalesce(F.get_json_object(d, "$.booked_at"), F.lit("None")), F.lit("  date: "), F.coalesce(F.get_json_object(d, "$.appointment_date"), F.lit("None")))
        items = F.array_join(F.transform(F.from_json(d, _TEXTS), lambda x: F.concat(F.lit("    - "), x)), "\n")
        pairs = F.array_join(F.transform(F.map_entries(F.from_json(d, "map<string,string>")), lambda e: F.concat(F.lit("    "), e["key"], F.lit(": "), e["value"])), "\n")
        other = F.when(_is(d, "["), items).when(_is(d, "{"), pairs).otherwise(F.concat(F.lit("    "), d))
        return (
            F.when((source == "tool:get_calendar") & _is(d, "{"), F.concat(head(F.lit("calendar")), calendar))
            .when(source == "tool:get_location", F.concat(head(F.lit("location")), F.lit("    "), d))
            .when((source == "tool:book_appointment") & _is(d, "{"), F.concat(head(F.lit("past booking")), booking))
            .otherwise(F.concat(head(source), other))
        )

    fields = [F.coalesce(F.concat(F.lit(f"\n  {k}: "), v.cast("string")), F.lit("")) for k, v in profile.items()]
    told = F.array_join(F.transform(traces, lambda t: F.concat(one(t), F.lit("\n"))), "\n")
    tail = F.when(F.size(traces) > 0, F.concat(F.lit("[Source: memory_traces  (residual context from prior workflows)]\n"), told)).otherwise("")
    return F.concat(F.lit("Task: "), task, F.lit("\n\n[Source: user_profile]"), *fields, F.lit("\n\n"), tail)


def activity(traces: Column) -> Column:
    """array<string>: one line a trace of an activity log, two for each listed item; narratives cut to 150, items to 80 characters."""
    none = F.expr(f"cast(array() as {_TEXTS})")

    def one(t: Column) -> Column:
        d, source, flow = t["data"], t["source"], t["from_workflow"]
        free, result = _slots(d, "free_slots"), F.get_json_object(d, "$.result")
        booked = F.concat(F.lit('- Booked "'), F.coalesce(F.get_json_object(d, "$.booked_at"), F.lit("None")), F.lit('" for task: "'), flow, F.lit('"'))
        prior = F.concat(F.lit("- Prior visit ("), F.coalesce(F.get_json_object(d, "$.task"), flow), F.lit("): "), F.substr(result, F.lit(1), F.lit(150)))
        items = F.transform(F.slice(F.from_json(d, _TEXTS), 1, 2), lambda x: F.concat(F.lit('- Past data from "'), flow, F.lit('": '), F.substr(x, F.lit(1), F.lit(80))))
        past = (source == "backstory") | F.startswith(source, F.lit("preloaded:")) | F.startswith(source, F.lit("eval:"))
        return (
            F.when((source == "tool:book_appointment") & _is(d, "{"), F.array(booked))
            .when(source == "tool:get_location", F.array(F.concat(F.lit("- Location recorded: "), d, F.lit(' (task: "'), flow, F.lit('")'))))
            .when(source == "tool:get_calendar", F.when(F.size(free) > 0, F.array(F.concat(F.lit("- Calendar: free on "), F.array_join(F.slice(free, 1, 2), ", ")))).otherwise(none))
            .when(past & _is(d, "{"), F.when(F.coalesce(result, F.lit("")) != "", F.array(prior)).otherwise(none))
            .when(_is(d, "["), items)
            .otherwise(none)
        )

    return F.flatten(F.transform(traces, one))


def template_query(name: Column, address: Column, task: Column, availability: Column, insurance: Column) -> Column:
    """The payload where no model writes one."""
    t = F.rtrim(F.trim(task), F.lit("."))
    t = F.concat(F.upper(F.substr(t, F.lit(1), F.lit(1))), F.substr(t, F.lit(2)))
    return F.concat(F.coalesce(name, F.lit("User")), F.lit(" at "), F.coalesce(address, F.lit("Rochester NY")), F.lit(" is looking for help — "), t, F.lit(". "), availability, F.lit(". Insurance: "), F.coalesce(insurance, F.lit("")), F.lit("."))


def with_context(query: Column, age: Column, address: Column, insurance: Column, insurance_id: Column) -> Column:
    """The query with a line of the profile's fields that it does not hold yet."""
    low = F.lower(query)
    fields = (("Age", age, F.trim(age)), ("Address", address, F.lower(F.trim(address))), ("Insurance", insurance, F.lower(F.trim(insurance))), ("Insurance ID", insurance_id, F.lower(F.trim(insurance_id))))
    lines = F.filter(F.array(*(F.when((F.trim(v) != "") & ~F.contains(low, sought), F.concat(F.lit(f"{k}: "), F.trim(v))) for k, v, sought in fields)), lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, F.concat(F.rtrim(query), F.lit("\nPatient context: "), F.array_join(lines, ", "), F.lit("."))).otherwise(query)


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _unquoted(x: Column) -> Column:
    return _bare(F.btrim(_bare(x), F.lit('"')))


def _before(x: Column, pattern: str) -> Column:
    """A text up to the first match, all of it without one."""
    return _bare(F.regexp_extract(x, rf"(?s)^(.*?)(?:{pattern}|\z)", 1))


def parsed_query(answer: Column) -> Column:
    """struct<reasoning, query> of a model's answer. The query is what follows the last label, up to a blank line and without
    talk about itself; else a quoted briefing of 40 characters, else a quoted text of 100 in the reasoning; else null."""

    label = c.QUERY_LABEL

    def labelled(a: Column) -> Column:
        has = F.regexp_like(a, F.lit(f"(?i){label}"))
        after = _unquoted(F.regexp_extract(a, rf"(?is)^.*{label}(.*)$", 1))
        query = _unquoted(F.regexp_replace(_before(after, r"\n\s*\n"), c.QUERY_TALK, ""))
        return F.struct(a.alias("all"), F.when(has, _bare(F.regexp_extract(a, rf"(?is)^(.*){label}", 1))).otherwise(a).alias("talk"), F.when(has, query).otherwise("").alias("query"))

    def reasoned(x: Column) -> Column:
        talk = F.regexp_replace(x["talk"], r"(?is)^.*?REASONING:", "")
        talk = F.when(F.regexp_like(x["talk"], F.lit("(?i)REASONING:")), _bare(talk)).otherwise(talk)
        talk = _before(_bare(F.regexp_replace(talk, c.REASONING_STEP, "")), r"(?i:\bStep\s*2\b)")
        return F.struct(x["all"].alias("all"), talk.alias("talk"), x["query"].alias("query"), F.regexp_extract(x["all"], c.QUERY_BRIEFING, 1).alias("brief"), F.regexp_extract(talk, c.QUERY_QUOTED, 1).alias("quoted"))

    def settled(x: Column) -> Column:
        none, brief, quoted = x["query"] == "", x["brief"] != "", x["quoted"] != ""
        query = F.when(~none, x["query"]).when(brief, _bare(x["brief"])).when(quoted, _bare(x["quoted"]))
        quote = F.position(F.concat(F.lit('"'), F.substr(_bare(x["quoted"]), F.lit(1), F.lit(30))), x["talk"])
        head = _bare(F.regexp_replace(_bare(F.substr(x["talk"], F.lit(1), F.greatest(F.lit(0), quote - 1))), c.REASONING_INTRO, ""))
        talk = F.when(none & brief, _before(x["talk"], c.REASONING_BRIEFING)).when(none & quoted & (head != ""), head).otherwise(x["talk"])
        talk = _bare(F.regexp_replace(talk, c.REASONING_TAIL, ""))
        return F.struct(F.when(talk == "", x["all"]).otherwise(talk).alias("reasoning"), query.alias("query"))

    return bound(bound(bound(_bare(answer), labelled), reasoned), settled)


def labelled_query(answer: Column) -> Column:
    return parsed_query(answer)["query"]


def preferences(answer: Column) -> Column:
    """A model's list of preferences after its label, '' where it says that there are none."""
    tail = _bare(F.substring_index(answer, c.PREFERENCES_LABEL, -1))
    return F.when((F.length(tail) >= 10) & ~F.startswith(F.lower(tail), F.lit("none")), tail).otherwise("")


def naive_payload(task: Column, profile: dict[str, Column], availability: Column, answer: Column | None = None) -> Column:
    """struct<reasoning, query>: the payload that a local model writes (answer), else the template; then the mandatory fields."""
    field = lambda k: profile.get(k, F.lit(None).cast("string"))
    text = lambda k: F.coalesce(field(k).cast("string"), F.lit(""))
    plain = template_query(field("name"), field("address"), task, availability, field("insurance"))

    def whole(x: Column) -> Column:
        query = F.coalesce(x["query"], plain)
        return F.struct(x["reasoning"].alias("reasoning"), with_context(query, text("age"), text("address"), text("insurance"), text("insurance_id")).alias("query"))

    return bound(parsed_query(F.lit("") if answer is None else F.coalesce(answer, F.lit(""))), whole)


def category(task: Column) -> Column:
    """Service category of the first keyword list of which a member is in the task."""
    low = F.lower(task)
    out = None
    for name, keys in c.CATEGORY_KEYWORDS.items():
        hit = F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(low, k))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def providers(df: DataFrame, key: str, answer: str, most: int = 5) -> DataFrame:
    """key, position, name, address, phone: numbered items of an answer and the first phone and address below each."""
    lines = df.select(key, F.posexplode(F.transform(F.split(answer, "\n"), lambda x: F.trim(x))).alias("n", "line")).filter("line <> ''")
    item = r"^\d+[.)]\s*\*{0,2}(.+?)\*{0,2}\s*$"
    phone = r"(\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4})"
    place = r"(?i)(\d+\s+\w[\w\s]+(?:St|Ave|Rd|Blvd|Dr|Ln|Way|Pkwy|Plaza|Ct|Circle|Sq)[\w\s,]*)"
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("n")
    rows = lines.withColumn("head", F.regexp_like("line", F.lit(item)).cast("int")).withColumn("position", F.sum("head").over(w)).filter("position between 1 and " + str(most))
    found = lambda p: F.when(F.col("head") == 0, F.nullif(F.regexp_extract("line", p, 1), F.lit("")))
    first = lambda col: F.coalesce(F.trim(F.min_by(col, F.when(col.isNotNull(), F.col("n")))), F.lit(""))
    name = F.regexp_replace(F.regexp_extract("line", item, 1), "^[ :-]+|[ :-]+$", "")
    return rows.groupBy(key, "position").agg(F.max(F.when(F.col("head") == 1, name)).alias("name"), first(found(place)).alias("address"), first(found(phone)).alias("phone"))


def form_fields(spark: SparkSession) -> DataFrame:
    """category, field, position, necessary."""
    return spark.createDataFrame([(k, f, i, n) for k, fs in c.FORM_FIELDS.items() for i, (f, n) in enumerate(fs)], "category string, field string, position int, necessary boolean")


def filled_form(forms: DataFrame, profile: DataFrame) -> DataFrame:
    """Fields of a form that the profile (profile_id, field, value) holds."""
    return forms.join(profile, "field")


def booked(forms: DataFrame, submitted: DataFrame, *keys: str) -> DataFrame:
    """Every field of a form with the submitted value, '' where there is none; keys tell apart several submissions."""
    return forms.join(submitted, [*keys, "field"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def over_disclosed(fields: DataFrame) -> DataFrame:
    return fields.filter(~F.col("necessary"))


def first_free_date(slots: Column, default: str = "2026-03-18") -> Column:
    return F.coalesce(F.get(slots, 0), F.lit(default))


def redacted(text: Column, recognizer: Callable[[Column], Column] | None = None, found: Column | None = None) -> Column:
    """Baseline: detected entities removed, the rest made cloud-ready. Detectors are the structured ones and a recogniser;
    found: their spans where they are known already."""
    easy = plain.ascii_only(text) if recognizer is None and found is None else F.lit(False)
    rest = F.when(~easy, text)
    spans = pattern_spans(rest) if found is None else found
    if recognizer is not None:
        spans = F.concat(spans, recognized_spans(text, recognizer))
    return F.coalesce(plain.redacted(F.when(easy, text)), cloud_ready(filled(rest, bound(spans, resolve_few), lambda s: F.lit(""))))


def rewritten(answer: Column | None) -> Column:
    """Baseline: a model's rewrite without its opening where more than 20 characters are left."""
    if answer is None:
        raise ValueError("the rewrite baseline needs a model's answers")
    raw = _bare(answer)
    out = None
    for m in c.REWRITE_MARKERS:
        hit, rest = F.startswith(F.lower(raw), F.lit(m.lower())), _bare(F.substr(raw, F.lit(len(m) + 1)))
        said = F.when(F.length(rest) > 20, rest).otherwise(raw)
        out = F.when(hit, said) if out is None else out.when(hit, said)
    return out.otherwise(raw)
