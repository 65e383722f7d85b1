"""Queries of the trained recogniser: texts composed of the tables' words, with marks that the composition knows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators import spans, tagger
from veilframe.queries import query
from veilframe.session import spread, table

#: Texts by shape: pieces in braces are marked. Document doc_id has the shape of doc_id / 5 modulo their number.
SHAPES = (
    "Please ask Dr. {PERSON} near {GPE} about {CHUNK} on {DATE}.",
    "{PERSON} and {PERSON2} booked {CHUNK} at {FAC} for {MONEY}.",
    "I moved from {GPE} to {GPE2} and will be back {DATE}!",
    "My appointment at {ORG} is {DATE} at {TIME}; tell {PERSON} please.",
    "Can you help me with this, please? It is about what we said, and no more.",
    "<noise> Meet {PERSON} at {TIME}. <noise>",
    "{ORG} charged {PERSON} {MONEY} for {CHUNK}: why?",
    "As a {NORP} family in {GPE}, we need {CHUNK} by {DATE} near {LOC}.",
    "My name is {PERSON} and I live in {GPE}.",
    "The {NORP} community meets at {FAC} around {TIME}, says {PERSON}.",
    "Could {PERSON} pay {MONEY} to {ORG} before {DATE}?",
    "We hiked along {LOC} with {PERSON} and slept in {GPE}.",
    "I saw {PERSON} and {PERSON2} at {ORG} {DATE}.",
    "Is there {CHUNK} close to {FAC} or {LOC} under {MONEY}?",
    "{DATE} I fly from {FAC} in {GPE}, around {TIME}.",
    "Reserve {CHUNK} for {PERSON} at {TIME}, not above {MONEY}.",
    "Most {NORP} friends of {PERSON} work for {ORG} in {GPE}.",
    "{GPE} is far from {LOC}, so call {ORG} about {CHUNK}.",
    "Since {DATE} the {NORP} patient {PERSON} has had {CHUNK}.",
    "From {TIME} on, {PERSON} waits outside {FAC}.",
    "{MONEY} is what {ORG} wants for {CHUNK} in {GPE}.",
    "Send it to {PERSON}, <noise>, then to {ORG} by {DATE}.",
    "{LOC} was closed {DATE}, as {FAC} was at {TIME}.",
    "Nothing to add: <noise>, and then some more of the same.",
)
_PLACES = {"FAC": ("Hospital", "Airport", "Museum", "Library"), "ORG": ("Clinic", "Bank", "Group", "University"), "LOC": ("River", "Valley", "Lake", "Mountains")}
_DAYS = ("next Tuesday", "tomorrow", "March 12", "last year", "July 3")
_TIMES = ("6:30 PM", "noon", "11:15 AM", "this evening")
_GROUPS = ("American", "Korean", "Catholic", "Italian", "Hindu", "Swiss")
_THINGS = ("chronic knee pain", "quiet table", "small ring", "vegan dinner", "window seat")


def marked_texts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, held_out, text, spans: a text for each document, its names made of the document's own words (of any script)."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    words = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", " "), " "), lambda w: F.length(w).between(3, 14))
    docs = docs.select("doc_id", words.alias("w"))
    word = lambda i: F.coalesce(F.get("w", i), F.lit("casey"))
    name = lambda i: F.initcap(word(i))
    dealt = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.floor(F.col("doc_id") / by), F.lit(len(xs))) + 1).cast("int"))
    money = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("$"), (F.col("doc_id") % 900 + 100).cast("string"))).otherwise(F.concat((F.col("doc_id") % 90 + 10).cast("string"), F.lit(" dollars")))
    pair = F.when(F.col("doc_id") % 2 == 0, F.concat(name(0), F.lit(" "), name(1))).otherwise(name(0))
    made: dict[str, Column] = {
        "PERSON": pair, "PERSON2": F.concat(name(2), F.lit(" "), name(3)), "GPE": name(4), "GPE2": F.concat(name(5), F.lit(" "), name(6)), "CHUNK": dealt(_THINGS, 7),
        "DATE": dealt(_DAYS, 3), "TIME": dealt(_TIMES, 11), "NORP": dealt(_GROUPS, 13), "MONEY": money,
        **{k: F.concat(name(7), F.lit(" "), dealt(v, 17)) for k, v in _PLACES.items()},
    }
    noise = F.lower(F.array_join(F.slice("w", 9, 6), " "))

    def pieces(shape: str) -> Column:
        out = []
        for part in re.findall(r"\{\w+\}|<noise>|[^{}<>]+", shape):
            key = part.strip("{}")
            label = F.lit(key.rstrip("2")) if part[0] == "{" else F.lit(None).cast("string")
            out.append(F.struct((made[key] if part[0] == "{" else noise if part == "<noise>" else F.lit(part)).alias("t"), label.alias("l")))
        return F.array(*out)

    shape = F.pmod(F.floor(F.col("doc_id") / 5), F.lit(len(SHAPES)))
    chosen = F.coalesce(*(F.when(shape == i, pieces(s)) for i, s in enumerate(SHAPES)))
    return docs.select("doc_id", (F.col("doc_id") % 5 == 0).alias("held_out"), tagger.marked(chosen).alias("m")).select("doc_id", "held_out", "m.*")


_COUNTS = ", ".join(f"({i}, '{label}', {n})" for i, s in enumerate(SHAPES) for label, n in ((x, s.count("{" + x)) for x in tagger.LABELS) if n)
BAR = 0.9


@query(f"""select doc_id % 5 = 0 as held_out, label, sum(n)::bigint as n_marked, true as precise, true as complete
 from documents join (values {_COUNTS}) v(shape, label, n) on shape = doc_id // 5 % {len(SHAPES)} group by all""")
def recognizer_quality(spark: SparkSession, d: str) -> DataFrame:
    """A tagger learned from the texts that are not held out, over all of them: whether precision and recall of each label
    reach BAR. What is held out has names that were not learned from, in sentences of the same shapes."""
    rows = marked_texts(spark, d)
    model = tagger.fit(rows.filter("not held_out"))
    found = rows.withColumn("found", model.recognizer()(F.col("text")))
    got = tagger.agreement(found, "spans", "found", "held_out")
    share = lambda n: F.coalesce(F.try_divide("n_right", n), F.lit(0.0)) >= BAR
    return got.select("held_out", "label", "n_marked", share("n_found").alias("precise"), share("n_marked").alias("complete"))


@query()
def recognized_trained(spark: SparkSession, d: str) -> DataFrame:
    """The spans that the trained recogniser adds to the extraction, a row a span."""
    rows = marked_texts(spark, d)
    model = tagger.fit(rows.filter("not held_out"))
    got = rows.select("doc_id", spans.recognized_spans(F.col("text"), model.recognizer()).alias("s")).select("doc_id", F.inline("s"))
    return got.select("doc_id", "span_type", "text", F.col("start").alias("start_at"), F.col("end").alias("end_at"))
