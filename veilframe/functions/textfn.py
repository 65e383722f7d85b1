"""Text functions as column expressions: find-all with offsets, rewriting chains, sentence filters.

Offsets are code points, half-open. Everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once."""
    return F.transform(F.array(value), lambda v: f(v))[0]


def _starts(z: Column) -> Column:
    """Start of each match from array<struct<b, l>>: characters before it since the last one, and its own.

    Matches are folded in blocks, then the blocks: the work stays near linear in texts with very many matches."""

    def inner(at: Column, part: Column) -> Column:
        zero = F.struct(F.expr("cast(array() as array<int>)").alias("out"), at.alias("at"))
        return F.aggregate(part, zero, lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["at"] + x["b"])).alias("out"), (acc["at"] + x["b"] + x["l"]).alias("at")))

    def step(acc: Column, k: Column) -> Column:
        return bound(inner(acc["at"], F.slice(z, k * _BLOCK + 1, F.lit(_BLOCK))), lambda got: F.struct(F.concat(acc["out"], F.array(got["out"])).alias("out"), got["at"].alias("at")))

    zero = F.struct(F.expr("cast(array() as array<array<int>>)").alias("out"), F.lit(0).alias("at"))
    marks = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / _BLOCK).cast("int"))
    return F.when(F.size(z) <= _BLOCK, inner(F.lit(0), z)["out"]).otherwise(F.flatten(F.aggregate(marks, zero, step)["out"]))


def find_all(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """array<struct<start int, end int, text string, group string>> of the matches, leftmost and non-overlapping.

    The texts between the matches come from split with the same pattern, so starts are sums of lengths."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,text:string,group:string>>)")
    p = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(m: Column, g: Column) -> Column:
        sizes = lambda gaps: F.transform(m, lambda x, i: F.struct(F.length(F.get(gaps, i)).alias("b"), F.length(x).alias("l")))
        starts = bound(bound(F.split(text, pattern, -1), sizes), _starts)
        return bound(starts, lambda s: F.transform(m, lambda x, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(x)).alias("end"), x.alias("text"), F.get(g, i).alias("group"))))

    def located(m: Column) -> Column:
        some = bound(F.regexp_extract_all(text, p, F.lit(group)), lambda g: placed(m, g)) if group else placed(m, m)
        return F.when(F.size(m) == 0, none).otherwise(some)

    return bound(F.regexp_extract_all(text, p, F.lit(0)), located)


def rewrite(text: Column, rules: list[tuple[str, str]], passes: int = 1) -> Column:
    """The rules' replacements one after the other, the whole chain `passes` times."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules * passes, text)


def sentences(text: Column) -> Column:
    return F.split(F.trim(text), r"(?<=[.!?])\s+")


def telling(text: Column, stop: tuple[str, ...], brackets: bool) -> Column:
    """The sentences of a text that hold two words of three letters or more outside `stop`, or a bracket where that counts."""

    def has(s: Column) -> Column:
        words = F.filter(F.regexp_extract_all(F.lower(s), F.lit(r"\b[a-zA-Z]{3,}\b"), F.lit(0)), lambda w: ~w.isin(*stop))
        return (F.contains(s, F.lit("[")) | (F.size(words) >= 2)) if brackets else F.size(words) >= 2

    kept = F.filter(F.transform(sentences(text), lambda s: F.trim(s)), lambda s: (F.length(s) > 0) & has(s))
    return F.trim(F.array_join(kept, " "))


def cleaned(text: Column) -> Column:
    """Artefacts of empty slots rewritten, sentences without content dropped."""
    from veilframe import constants as c

    return telling(rewrite(text, c.CLEAN_RULES, 3), c.STOP, True)


def cloud_ready(text: Column) -> Column:
    """Placeholders of direct identifiers and the fragments around them removed."""
    from veilframe import constants as c

    marks = "|".join(rf"\[{f.upper()}\]" for f in c.DIRECT_FIELDS)
    t = F.regexp_replace(text, marks, "")
    for _ in range(3):
        t = F.regexp_replace(rewrite(t, c.CLOUD_RULES), r"^\s+|\s+$", "")
    return telling(t, c.CLOUD_STOP, False)


def low_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z]+\b"), F.lit(0))


def any_word(words: Column, lexicon: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, lexicon))) if lexicon else F.lit(False)


def proper_noun(text: Column) -> Column:
    """Whether a text has purely alphabetic words and all of them begin with a capital."""
    alpha = F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_like(w, F.lit(r"^\p{L}+$")))
    return (F.size(alpha) > 0) & F.forall(alpha, lambda w: F.regexp_like(w, F.lit(r"^\p{Lu}")))
