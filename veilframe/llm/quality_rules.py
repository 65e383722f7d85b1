"""Quality rules, line first: each line is judged by punctuation, navigation, noise and boilerplate rules; failing lines
go; a text that loses too much of itself is rejected.

Besides, some counts over the whole text decide `base_failed`. All of it is column expressions on one row: no shuffle.

Edge cases: null text counts as empty: no words, base_failed, not kept; a text of any length is judged whole; repeated rows
are judged alike; an empty table gives none; further columns stay, whatever their names (a result column takes the place of
one of its name)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.names import unpacked

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8
LOST = 0.5  # share of the words' characters that may go with failing lines
LEAST_WORDS = 20
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "lost")
END = tuple(".!?…:;\"'»”’)")
# Fixed phrases of lines that belong to a site or a licence, not to a text.
BOILERPLATE = (
    "all rights reserved",
    "licensed under the",
    "is licensed under",
    "terms of service",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "we use cookies",
    "accept cookies",
    "sign in to",
    "subscribe to our newsletter",
    "click here to",
    "enable javascript",
)


def line_fails(line: Column) -> Column:
    """Whether a line goes. Empty lines stay."""
    n = F.size(F.split(F.trim(line), GAP))
    noisy = F.regexp_count(line, F.lit(r"[#*$%&<>]{2,}(?=$|[\x20\x09-\x0D])|!!(?=$|[\x20\x09-\x0D])"))
    bars = F.regexp_count(line, F.lit(r"(?:^|[\x20\x09-\x0D])[|»>•](?=$|[\x20\x09-\x0D])"))
    end = F.substring(F.rtrim(line, F.lit(" \t\r\x0b\x0c")), -1, 1)
    low = F.lower(line)
    site = reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in BOILERPLATE))
    stutter = F.regexp_count(line, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+) \1(?![^\x20\x09-\x0D])"))
    return F.regexp_like(line, F.lit(WORD)) & (
        (noisy * 4 >= n) | (bars * 4 >= n) | (~end.isin(*END) & (n < 4)) | site | (stutter * 3 >= n)
    )


def repeated_words(hashes: Column) -> Column:
    """Words inside windows of WINDOW words that occur at least twice, from the windows' hashes."""

    def marked() -> Column:
        s = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return s

    def covered(s: Column) -> Column:
        # array of struct<a (sorted), n>: positions of windows that have an equal neighbour
        dup = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(dup, lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    # one-element arrays bind what is used more than once
    s = F.array(marked())
    p = F.transform(s, covered)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(F.element_at(F.transform(p, total), 1))


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text (without failing
    lines) and lost (share of characters that went)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), t.alias("_t")).withColumn("_w", F.array_remove(F.split("_t", GAP), ""))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_h")
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(F.col("_h"), i + k) for k in range(WINDOW)))),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    d = d.withColumn("n_words", n.cast("bigint")).withColumn("word_chars", F.length(F.array_join("_w", "")).cast("bigint")).withColumn("_x", windows)
    symbols = F.when(F.regexp_like("_t", F.lit(r"[#*$%&|<>]")), F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).otherwise(0)
    d = d.withColumn("_l", F.split("_t", "\n"))
    d = d.withColumn("_r", F.filter("_l", lambda x: F.regexp_like(x, F.lit(WORD)))).withColumn("_k", F.filter("_l", lambda x: ~line_fails(x)))
    d = d.withColumn("n_symbols", symbols.cast("bigint")).withColumn("n_dup_lines", (F.size("_r") - F.size(F.array_distinct("_r"))).cast("bigint"))
    d = d.withColumn("n_repeat_words", repeated_words(F.col("_x")).cast("bigint")).withColumn("clean_text", F.array_join("_k", "\n"))
    left = F.length(F.regexp_replace("clean_text", GAP, ""))
    d = d.withColumn("lost", F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(0.0))
    d = d.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= LOST))
    return d.select(*unpacked(docs.columns, *RESULTS), *RESULTS)
