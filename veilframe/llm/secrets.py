"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over lower-case trigrams is derived: every match must hold the
trigrams of one of the query's terms. Texts are indexed by those trigrams: in each block of documents (dealt by a hash of
the row, so no block is hot) a trigram has the list of the rows that hold it. A rule's candidates are unions of
intersections of such lists; only they are verified with its expression. Rules without mandatory trigrams scan every text.
All of it is DataFrame operations.

Edge cases: null text counts as empty and has no span; texts of any length are scanned whole; repeated rows have one
index entry and each its result; null doc_ids are kept; an empty table gives none; further columns stay, whatever their names
(a result column takes the place of one of its name)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.textfn import find_all
from veilframe.llm.names import unpacked
from veilframe.llm.spanlists import EMPTY, listed, of_kind

BLOCK_DOCS = 2_048  # rows of an index block, about
MOST = 64  # strings that the analysis of an expression follows at once


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # characters that the group must have


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: What follows the header of a private key: all up to its END line or, where that is missing, header fields and base64
#: lines (the last may be short). Line ends may be written as \\n. Possessive: no backtracking in long texts.
_GAP = r"(?:[\x20\x09-\x0D]|\x5C[nr])++"
_KEY_BODY = (
    r"(?:(?:[A-Za-z0-9+/=:,\x20\x09-\x0D]++|\x5C[nr]|-(?!----))*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    rf"|(?:{_GAP}(?:Proc-Type|DEK-Info):[A-Za-z0-9,\x20-]*+)*+"
    rf"(?:(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+)++(?:{_GAP}[A-Za-z0-9+/]{{1,63}}+={{0,2}}+(?![^\x0A\x0D\x5C\x22\x27]))?+)?+)"
)
#: What the method adds: formats of known issuers.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{12,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----" + _KEY_BODY),
    Rule("url_password", r"://[A-Za-z0-9_.-]{1,64}:[^\x20\x09-\x0D/@:]{6,64}@"),
)
RULES = BASE + MORE

Terms = frozenset[frozenset[str]]  # any of the terms; all trigrams of the term
TRUE: Terms = frozenset([frozenset()])


def _simple(terms: Iterable[frozenset[str]]) -> Terms:
    """Without terms that hold another one."""
    ts = set(terms)
    return frozenset(t for t in ts if not any(o < t for o in ts))


def _of(strings: set[str]) -> Terms:
    return _simple(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _both(a: Terms, b: Terms) -> Terms:
    out = _simple(x | y for x in a for y in b)
    return out if len(out) <= MOST else min(a, b, key=len)


def _walk(nodes: list) -> tuple[set[str] | None, Terms]:
    """(all strings that the nodes can match, or None if too many; a query that any match satisfies)."""
    run, query = {""}, TRUE

    def end_run() -> None:
        nonlocal run, query
        query = _both(query, _of(run)) if run and min(map(len, run)) >= 3 else query
        run = {""}

    for op, arg in nodes:
        name, exact, inner = str(op), None, TRUE
        if name == "LITERAL":
            exact = {chr(arg).lower()}
        elif name == "IN":
            parts = {str(o) for o, _ in arg}
            if parts <= {"LITERAL", "RANGE"}:
                n = sum(1 if str(o) == "LITERAL" else a[1] - a[0] + 1 for o, a in arg)
                if n <= 8:
                    exact = {chr(c).lower() for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))}
        elif name == "SUBPATTERN":
            exact, inner = _walk(list(arg[-1]))
        elif name == "BRANCH":
            kids = [_walk(list(b)) for b in arg[1]]
            exact = set().union(*(e for e, _ in kids)) if all(e is not None for e, _ in kids) else None
            inner = _simple(t for _, q in kids for t in q)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            lo, hi, body = arg
            e, q = _walk(list(body))
            if e is not None and (lo, int(hi)) == (0, 1):
                exact = e | {""}
            elif e is not None and lo == hi and len(e) ** lo <= MOST:
                exact = reduce(lambda a, b: {x + y for x in a for y in b}, [e] * lo, {""})
            elif lo:
                inner = q
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            exact = {""}
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
        else:
            end_run()
            if exact is not None:
                run = set(exact)
            else:
                query = _both(query, inner)
    whole = run if query == TRUE else None
    broken = any(str(op) in ("IN", "MAX_REPEAT", "MIN_REPEAT", "ANY", "NOT_LITERAL", "CATEGORY") for op, _ in nodes) and whole is not None
    end = run
    end_run()
    if broken and not _exact(nodes):
        return None, query
    return (end if whole is not None and _exact(nodes) else None), query


def _exact(nodes: list) -> bool:
    """Whether the nodes match finitely many strings that _walk holds in one run."""
    for op, arg in nodes:
        name = str(op)
        if name in ("LITERAL", "AT", "ASSERT", "ASSERT_NOT"):
            continue
        if name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg) and sum(1 if str(o) == "LITERAL" else a[1] - a[0] + 1 for o, a in arg) <= 8:
            continue
        if name == "SUBPATTERN" and _exact(list(arg[-1])):
            continue
        if name == "BRANCH" and all(_exact(list(b)) for b in arg[1]):
            continue
        if name.endswith("REPEAT") and (arg[0] == arg[1] or (arg[0], int(arg[1])) == (0, 1)) and int(arg[1]) <= 8 and _exact(list(arg[2])):
            continue
        return False
    return True


def trigram_query(pattern: str) -> Terms:
    """The query of an expression; TRUE where no trigram is mandatory."""
    return _walk(list(re._parser.parse(pattern)))[1]


def _long(found: Column, least: int) -> Column:
    return F.filter(found, lambda m: F.length(m["group"]) >= least)


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def candidates(docs: DataFrame, rules: dict[str, Terms]) -> DataFrame:
    """_key and _rules (names) of the rows that may match the rules, from the index over docs(doc_id, text)."""
    grams = sorted({g for q in rules.values() for t in q for g in t})
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    # the one-element array lowers a text once; the outer explode keeps the list from being made again for a filter
    held = F.transform(F.array(F.lower("text")), lambda low: F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(low, g)))[0]
    lists = docs.select(_row_key().alias("_key"), F.explode_outer(held).alias("gram")).filter("gram is not null").groupBy(F.pmod("_key", F.lit(blocks)).alias("_block"), "gram").agg(F.collect_set("_key").alias("keys"))
    index = lists.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("post"))
    post = {g: F.coalesce(F.try_element_at("post", F.lit(g)), F.expr("cast(array() as array<bigint>)")) for g in grams}

    def term(t: frozenset[str]) -> Column:
        return reduce(F.array_intersect, (post[g] for g in sorted(t)))

    def rule(q: Terms) -> Column:
        return reduce(F.array_union, (term(t) for t in sorted(q, key=sorted)))

    found = index.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), rule(q).alias("keys")) for k, q in rules.items()))).alias("f"))
    return found.select(F.col("f.rule"), F.explode("f.keys").alias("_key")).groupBy("_key").agg(F.collect_set("rule").alias("_rules"))


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with n_<kind> of the base kinds, and base and spans (sorted arrays of start, rank, end, kind)."""
    return _scanned(docs, rules).select(*unpacked(docs.columns, *_results()), *_results())


def _results() -> list[str]:
    return [*(f"n_{r.kind}" for r in BASE), "base", "spans"]


def _scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same with docs' columns in _doc, and _text."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != TRUE}
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_doc"), F.col("text").alias("_raw"), _row_key().alias("_row"))
    cand = candidates(docs.select("doc_id", "text"), indexed)
    rows = own.join(cand.withColumnRenamed("_key", "_row").hint("shuffle_hash"), "_row", "left").withColumn("_text", F.coalesce(F.col("_raw").cast("string"), F.lit("")))
    by = {}
    for i, r in enumerate(rules):
        found = find_all(F.col("_text"), r.pattern, r.group)
        if r.least:
            found = _long(found, r.least)
        spans = of_kind(found, r.kind, i)
        if r.kind in indexed:
            spans = F.when(F.array_contains(F.col("_rules"), r.kind), spans).otherwise(F.expr(EMPTY))
        by[r.kind] = spans
    rows = rows.select("_doc", "_raw", "_text", *(c.alias(f"_s_{k}") for k, c in by.items()))
    base = [f"_s_{r.kind}" for r in rules if r in BASE]
    return rows.select(
        F.col("_doc").withField("text", F.col("_raw")).alias("_doc"),
        "_text",
        *(F.size(f"_s_{r.kind}").cast("bigint").alias(f"n_{r.kind}") for r in rules if r in BASE),
        F.array_sort(F.concat(*base)).alias("base"),
        F.array_sort(F.concat(*(f"_s_{k}" for k in by))).alias("spans"),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    s = scanned(docs.select("doc_id", "text"))
    return s.select("doc_id", *(f"n_{r.kind}" for r in BASE), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs, each stretch of overlapping or touching spans in text replaced by the mark; n_chars follows where it is a column."""
    s = _scanned(docs)
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(F.col("_text"), acc["at"] + 1, F.greatest(F.lit(0), x["start"] - acc["at"]))
        more = F.when((x["start"] <= acc["at"]) & (acc["at"] > 0), F.lit("")).otherwise(F.concat(gap, F.lit(mark)))
        return F.struct(F.concat(acc["out"], more).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    end = F.aggregate("spans", zero, step)
    new = F.transform(F.array(end), lambda e: F.concat(e["out"], F.substr(F.col("_text"), e["at"] + 1)))[0]
    text = F.when(F.size("spans") == 0, F.col("_doc.text")).otherwise(new)
    cols = {"text": text}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.size("spans") == 0, F.col("_doc.n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return s.select(*(cols[c].alias(c) if c in cols else F.col("_doc").getField(c).alias(c) for c in docs.columns))
