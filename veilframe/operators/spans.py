"""Stage 1: typed spans of a payload, their conflicts, and views of the payload. One row in, one row out; no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe import constants as c
from veilframe.functions.textfn import bound, find_all
from veilframe.operators import conflicts, plain
from veilframe.schemas import SPANS

FEW = 64  # spans of a text that are compared with each other

Recognizer = Callable[[Column], Column]
"""text -> array<struct<text, start, end, label, is_chunk>>: a pluggable entity recogniser (an expression or a pandas UDF)."""


def _each(found: Column, kind: str, source: str, bucket: str, sub: str) -> Column:
    return F.transform(found, lambda m: _span(m, kind, source, bucket, sub))


def _span(m: Column, kind: Column | str, source: str, bucket: str, sub: str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), kind.alias("span_type"), F.lit(source).alias("source"), F.lit(bucket).alias("bucket"), F.lit(sub).alias("subsource"))


def find_literal(text: Column, value: Column) -> Column:
    """All occurrences of a value in a text, whatever the case. Values are rows, so only texts that hold theirs are searched."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,text:string,group:string>>)")
    quoted = F.concat(F.lit("(?iu)\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when((F.length(value) > 0) & F.contains(F.lower(text), F.lower(value)), find_all(text, quoted)).otherwise(none)


def profile_spans(text: Column, profile: dict[str, Column]) -> Column:
    """Spans of the profile's values: direct identifiers are withheld (U_loc), contextual ones are candidates (U_med)."""
    parts = [F.expr(f"cast(array() as {SPANS})")]
    for field, value in profile.items():
        if field in c.DIRECT_FIELDS or field in c.SOFT_FIELDS:
            kind, bucket = (field, "U_loc") if field in c.DIRECT_FIELDS else (c.SOFT_FIELDS[field], "U_med")
            trimmed = F.trim(value)
            spans = _each(find_literal(text, trimmed), kind, "profile", bucket, field)
            parts.append(F.coalesce(spans, F.expr(f"cast(array() as {SPANS})")))
    return F.concat(*parts)


def pattern_spans(text: Column, only: str | None = None) -> Column:
    """Spans of the structured detectors, in the detectors' order."""
    none = F.expr(f"cast(array() as {SPANS})")

    def one(kind: str, p: str) -> Column:
        found = _each(find_all(text, p), kind, "structured_pattern", "U_med", kind)
        sign = c.DETECTOR_SIGNS.get(p)
        return found if sign is None else F.when(F.contains(text, F.lit(sign)), found).otherwise(none)

    return F.concat(*(one(kind, p) for kind, p in c.DETECTORS if only in (None, kind)))


def keep_chunk(text: Column) -> Column:
    """Whether a noun chunk is a candidate."""
    low = F.lower(text)
    starts = F.lit(False)
    for p in c.BAD_CHUNK_STARTS:
        starts = starts | F.startswith(low, F.lit(p))
    return (F.size(F.split(F.trim(text), r"\s+")) >= 2) & ~low.isin(*c.BAD_CHUNKS) & (~starts | low.isin(*c.GOOD_CHUNKS)) & F.regexp_like(text, F.lit("[A-Za-z]"))


def recognized_spans(text: Column, recognizer: Recognizer) -> Column:
    """Spans of a recogniser: entities by their label's type, chunks that qualify as noun phrases; form labels go."""
    kinds = F.create_map(*(F.lit(x) for kv in c.NER_TYPES.items() for x in kv))
    found = F.filter(recognizer(text), lambda r: F.when(r["is_chunk"], keep_chunk(r["text"])).otherwise(kinds[r["label"]].isNotNull()))
    found = F.filter(found, lambda r: ~F.lower(F.trim(r["text"])).isin(*c.BAD_CHUNKS))

    def typed(r: Column) -> Column:
        low = F.lower(F.trim(r["text"]))
        kind = (
            F.when(r["is_chunk"] | ((r["label"] == "ORG") & low.isin(*c.MEDICAL_ABBREVIATIONS)), "noun_phrase")
            .when((r["label"] == "DATE") & F.regexp_like(r["text"], F.lit(c.DETECTORS[3][1])), "age")
            .otherwise(kinds[r["label"]])
        )
        return _span(r, kind, "recognizer", "U_med", "entity")

    return F.transform(found, typed)


def once(spans: Column) -> Column:
    """Spans without exact copies (texts compared without case): the last of equal ones at the place of the first."""
    keys = F.transform(spans, lambda s: F.struct(*(F.lower(s[k]).alias(k) if k == "text" else s[k].alias(k) for k in ("text", "start", "end", "span_type", "source", "bucket", "subsource"))))

    def picked(k: Column) -> Column:
        last = lambda x: F.get(spans, F.size(k) - F.array_position(F.reverse(k), x).cast("int"))
        return F.when(F.size(F.array_distinct(k)) == F.size(k), spans).otherwise(F.transform(F.array_distinct(k), last))

    return bound(keys, picked)


def resolve(spans: Column, few: int = FEW) -> Column:
    """Greedy conflict resolution: exact copies once, then withheld spans, longer, earlier first; a span that overlaps none
    of those accepted is accepted; the result is in order of start.

    Texts of more than `few` spans go to an ordered structure (n log n), the others stay in the JVM. spans is read twice, so
    where it is much work it should be a column of the table."""
    many = conflicts.resolved(bound(spans, lambda x: F.when(F.size(x) > few, x)))
    return F.coalesce(many, bound(spans, lambda x: F.when(F.size(x) <= few, resolve_few(x))))


def resolve_few(spans: Column) -> Column:
    """The same in the JVM alone, for use inside other expressions: each span is compared with those accepted."""
    ranked = F.transform(
        once(spans),
        lambda s, i: F.struct(F.when(s["bucket"] == "U_loc", 0).otherwise(1).alias("p"), (s["start"] - s["end"]).alias("l"), s["start"].alias("o"), i.alias("i"), s.alias("s")),
    )
    clash = lambda acc, s: F.exists(acc, lambda a: (s["start"] < a["end"]) & (s["end"] > a["start"]))
    accepted = F.aggregate(F.array_sort(ranked), F.expr(f"cast(array() as {SPANS})"), lambda acc, r: F.when(clash(acc, r["s"]), acc).otherwise(F.concat(acc, F.array(r["s"]))))
    order = F.array_sort(F.transform(accepted, lambda s: F.struct(s["start"].alias("o"), s.alias("s"))))
    return F.transform(order, lambda x: x["s"])


def filled(text: Column, spans: Column, slot: Callable[[Column], Column], block: int = FEW) -> Column:
    """text with each of the disjoint, sorted spans replaced by slot(span).

    Many spans are filled `block` at a time, each time in the stretch of text up to the next block's: near linear work."""

    def fold(part: Column, some: Column, base: Column) -> Column:
        zero = F.struct(F.lit("").alias("out"), base.alias("at"))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substr(part, acc["at"] - base + 1, s["start"] - acc["at"])
            return F.struct(F.concat(acc["out"], gap, slot(s)).alias("out"), s["end"].alias("at"))

        return F.aggregate(some, zero, step, lambda a: F.concat(a["out"], F.substr(part, a["at"] - base + 1, F.greatest(F.lit(0), F.length(part) - (a["at"] - base)))))

    def stretch(t: Column, sp: Column, k: Column) -> Column:
        begin = F.when(k == 0, 0).otherwise(F.get(sp, k * block - 1)["end"])
        end = F.when((k + 1) * block < F.size(sp), F.get(sp, (k + 1) * block - 1)["end"]).otherwise(F.length(t))
        part = F.struct(F.substr(t, begin + 1, end - begin).alias("t"), begin.alias("b"))
        return bound(part, lambda x: fold(x["t"], F.slice(sp, k * block + 1, F.lit(block)), x["b"]))

    def whole(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v["s"]) - 1) / block).cast("int"))
        many = F.array_join(F.transform(blocks, lambda k: stretch(v["t"], v["s"], k)), "")
        return F.when(F.size(v["s"]) <= block, fold(v["t"], v["s"], F.lit(0))).otherwise(many)

    return bound(F.struct(text.alias("t"), spans.alias("s")), whole)


def placeholder(s: Column) -> Column:
    return F.concat(F.lit("["), F.upper(s["span_type"]), F.lit("]"))


def extract(df: DataFrame, payload: str = "payload", profile: dict[str, Column] | None = None, recognizer: Recognizer | None = None, found: str | None = None) -> DataFrame:
    """df with all_spans, u_loc, u_med and the views context ([SPAN] slots), tagged and working (only U_loc masked).

    ASCII texts with ASCII values are searched in Arrow batches (`plain`), the others by column expressions.
    found: a column that keeps the structured detectors' spans as they were found."""
    text, own = F.col(payload), profile or {}
    patterns = None if found is None else F.col(found)
    if found is not None:
        df = df.withColumn(found, pattern_spans(text))
    easy = F.coalesce(reduce(lambda a, v: a & F.coalesce(plain.ascii_only(v), F.lit(True)), own.values(), plain.ascii_only(text)), F.lit(False))
    spans = F.when(~easy, F.concat(profile_spans(text, own), pattern_spans(text) if patterns is None else patterns))
    if recognizer is not None:
        spans = F.concat(F.when(easy, F.expr(f"cast(array() as {SPANS})")).otherwise(spans), recognized_spans(text, recognizer))
    # read twice, so that the optimiser keeps the column: it does not find an Arrow function over so large an expression
    rest = F.when(F.size("all_spans") >= 0, F.col("all_spans"))
    df = df.withColumn("all_spans", spans).withColumn("all_spans", plain.spans_of(F.when(easy, text), own, rest))
    df = df.withColumn("u_loc", F.filter("all_spans", lambda s: s["bucket"] == "U_loc")).withColumn("u_med", F.filter("all_spans", lambda s: s["bucket"] == "U_med"))
    tag = lambda s: F.concat(F.lit("["), F.upper(s["bucket"]), F.lit(":"), s["span_type"], F.lit("]"))
    return df.withColumns({
        "context": filled(text, F.col("all_spans"), lambda s: F.lit("[SPAN]")),
        "tagged": filled(text, F.col("all_spans"), tag),
        "working": filled(text, F.col("u_loc"), placeholder),
    })


def records(df: DataFrame, *keys: str, spans: str | Column = "all_spans") -> DataFrame:
    """One row a span. The outer form, as for the inner one the optimiser adds filters that work out the spans again."""
    return df.select(*keys, F.inline_outer(spans)).filter(F.col("start").isNotNull())


def binding_table(spans: Column) -> Column:
    """map of span text to type; the last span of a text wins."""
    return F.aggregate(spans, F.expr("cast(map() as map<string,string>)"), lambda m, s: F.map_concat(F.map_filter(m, lambda k, v: k != s["text"]), F.create_map(s["text"], s["span_type"])))
