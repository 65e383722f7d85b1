"""Personal data by boosted candidates.

Generators with high recall propose spans, which may overlap; format and context features describe each; gradient-boosted
trees score it; a threshold calibrated for each kind selects. The trees are fitted once a process on labelled examples
that are composed from format templates (a few hundred short strings, fixed seed) and then become one nested CASE
expression, so scoring a candidate stays in the JVM. Spans of the base formats always stay; the trees decide on the rest.

Edge cases: null text counts as empty and has no span; whole texts of any length are searched (texts without a digit and
an at sign skip the generators, which all need one of them); repeated rows have equal results; an empty table gives none;
further columns stay, whatever their names (a result column takes the place of one of its name)."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.textfn import find_all
from veilframe.llm.names import unpacked
from veilframe.llm.spanlists import listed, of_kind

# Base formats. Possessive quantifiers and the look-behind change nothing in what matches; they keep long runs linear.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Generators beyond the base formats, and the kind of what they propose.
MORE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,64}\x20?[\[(.](?:dot|DOT)?[\])]?\x20?[A-Za-z]{2,24}",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![0-9A-Za-z])",
}
ALL = (*KINDS, "ssn", "iban")
# Fixed words that speak for a kind when they stand before a candidate.
CONTEXT = {
    "email": "(?i)mail|contact|write to|reach",
    "ip": "(?i)\\bip\\b|host|server|address|from",
    "card": "(?i)card|visa|credit|payment|account",
    "phone": "(?i)phone|call|tel|fax|mobile|reach",
    "ssn": "(?i)ssn|social|tax",
    "iban": "(?i)iban|bank|transfer|account",
}
AGAINST = "(?i)version|isbn|invoice|order|page|part|serial|lines?\\b|\\$\\s*$|€\\s*$|#\\s*$"
FEATURES = ("n_digits", "n_marks", "groups", "length", "luhn", "context", "against", "kind", "distinct", "paren")
ROUNDS, RATE, PRECISION = 24, 0.4, 0.98


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.pmod(x.cast("int") * 2, F.lit(10)) + F.floor(x.cast("int") / 5).cast("int")))
    return F.pmod(F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(10)) == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def described(text: Column, m: Column, kind: str) -> dict[str, Column]:
    """Features of a candidate m in its text."""
    s, d = m["text"], _digits(m["text"])
    before = F.substr(text, F.greatest(F.lit(1), m["start"] - 29), F.least(m["start"], F.lit(30)))
    return {
        "n_digits": F.length(d),
        "n_marks": F.length(F.regexp_replace(s, "[A-Za-z0-9]", "")),
        "groups": F.size(F.array_remove(F.split(s, "[^A-Za-z0-9]+"), "")),
        "length": F.length(s),
        "luhn": F.when(F.length(d) > 0, luhn(d)).otherwise(False).cast("int"),
        "context": F.regexp_like(before, F.lit(CONTEXT[kind])).cast("int"),
        "against": F.regexp_like(before, F.lit(AGAINST)).cast("int"),
        "kind": F.lit(ALL.index(kind)),
        "distinct": F.size(F.array_remove(F.array_distinct(F.split(d, "")), "")),
        "paren": F.contains(s, F.lit("(")).cast("int"),
    }


def _python_luhn(d: str) -> bool:
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x // 10 + x % 10
    return bool(d) and t % 10 == 0


def _example(rng: random.Random) -> tuple[list[float], int]:
    """Features and label of one composed candidate."""
    kind = rng.choice(ALL)
    yes = rng.random() < 0.5
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        who, host = "ann" + num(rng.randint(0, 3)), "mail" + num(rng.randint(0, 1))
        if yes:
            s = rng.choice(["{}(at){}.com", "{} [at] {} [dot] org", "{} (at) {} (dot) net", "{}[at]{}.org"]).format(who, host)
        else:  # brackets of prose and code
            s = rng.choice(["look(at)page.two", "x [at] y[i]", "a(at)b(c", "meet (at) noon.then", "{}[AT] {}(x"]).format(num(1), num(2))
    elif kind == "ip":
        s = ":".join(rng.choice(["2001", "0db8", "a1f", "0", "ff"]) for _ in range(8)) if yes else ":".join(num(2) for _ in range(8))
    elif kind == "card":
        s = num(16) if rng.random() < 0.6 else " ".join(num(4) for _ in range(4))
        if not yes:
            s = rng.choice([num(rng.choice([13, 14, 18, 19])), "0" * 15 + "1", rng.choice("0123456789") * 16])
    elif kind == "phone":
        s = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(num(3), num(3), num(4)) if yes else rng.choice(["{} {} {}", "{}-{}-{}"]).format(num(2), num(3), num(3))
    elif kind == "ssn":
        s = f"{num(3)}-{num(2)}-{num(4)}" if yes else f"{num(3)} {num(2)} {num(4)}"
    else:
        s = "DE" + num(20) if yes else "AB" + num(10)
    context = int(rng.random() < (0.6 if yes else 0.1))
    against = int(rng.random() < (0.02 if yes else 0.6))
    if kind in ("phone", "ssn", "iban") and not yes and context and not against:
        against = 1
    d = "".join(c for c in s if c.isdigit())
    marks = sum(not c.isalnum() for c in s)
    groups = len("".join(c if c.isalnum() else " " for c in s).split())
    row = [len(d), marks, groups, len(s), int(_python_luhn(d)), context, against, ALL.index(kind), len(set(d)), int("(" in s)]
    return [float(x) for x in row], int(yes)


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Node:
    """A regression tree on gradients g and curvatures h."""
    out = Node(RATE * float(g.sum() / (h.sum() + 1.0)))
    best = (1e-3, -1, 0.0)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, f])[:-1]:
            m = x[:, f] <= cut
            gain = g[m].sum() ** 2 / (h[m].sum() + 1.0) + g[~m].sum() ** 2 / (h[~m].sum() + 1.0) - whole
            if gain > best[0]:
                best = (gain, f, float(cut))
    if best[1] >= 0:
        m = x[:, best[1]] <= best[2]
        out.feature, out.cut = best[1], best[2]
        out.low, out.high = _grow(x[m], g[m], h[m], depth - 1), _grow(x[~m], g[~m], h[~m], depth - 1)
    return out


def _apply(t: Node, row: np.ndarray) -> float:
    while t.feature >= 0:
        t = t.low if row[t.feature] <= t.cut else t.high
    return t.value


@cache
def boosted(n: int = 600, depth: int = 3) -> tuple[tuple[Node, ...], dict[str, float]]:
    """The trees and, for each kind, the least margin above which enough of the calibration examples are right."""
    rng = random.Random(5)
    made = [_example(rng) for _ in range(2 * n)]
    x, y = np.array([r for r, _ in made]), np.array([t for _, t in made], float)
    margin, trees = np.zeros(n), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        t = _grow(x[:n], y[:n] - p, p * (1 - p), depth)
        margin += np.array([_apply(t, r) for r in x[:n]])
        trees.append(t)
    held = np.array([sum(_apply(t, r) for t in trees) for r in x[n:]])
    cuts = {}
    for k, kind in enumerate(ALL):
        m = x[n:, 7] == k
        order = np.sort(held[m])
        cuts[kind] = next((float(c) - 1e-9 for c in order if y[n:][m][held[m] >= c].mean() >= PRECISION), float("inf"))
    return tuple(trees), cuts


def _case(t: Node, of: str) -> str:
    if t.feature < 0:
        return f"double({t.value!r})"
    return f"case when {of}.{FEATURES[t.feature]} <= {t.cut!r} then {_case(t.low, of)} else {_case(t.high, of)} end"


def margin(of: str) -> str:
    """SQL of the sum of the trees over a struct of features."""
    return " + ".join(_case(t, of) for t in boosted()[0])


def scanned(docs: DataFrame) -> DataFrame:
    """docs with base (base spans) and spans (all), sorted arrays of start, rank, end, kind; n_<kind> of the base kinds."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    results = [*(f"n_{k}" for k in KINDS), "base", "spans"]
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), t.alias("_text")).withColumn("_some", F.regexp_like("_text", F.lit(r"[0-9@]|[\[(](?:at|AT)[\])]")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,text:string,group:string>>)")
    gate = lambda c: F.when(F.col("_some"), c).otherwise(none)
    number = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
    digits = lambda m: F.length(_digits(m["text"]))
    ok = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: F.regexp_like(m["text"], F.lit(number)),
        "card": lambda m: digits(m).between(12, 19) & luhn(_digits(m["text"])),
        "phone": lambda m: digits(m).between(9, 15),
    }
    base = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
    d = d.withColumns({f"_b_{k}": gate(F.filter(find_all(F.col("_text"), p), ok[k])) for k, p in base.items()})
    d = d.withColumns({f"_c_{k}": gate(find_all(F.col("_text"), p)) for k, p in MORE.items()})
    cuts = boosted()[1]

    def candidates(k: str) -> Column:
        return F.transform(F.col(f"_c_{k}"), lambda m: F.struct(m.alias("m"), F.struct(*(c.alias(n) for n, c in described(F.col("_text"), m, k).items())).alias("f")))

    d = d.withColumns({f"_f_{k}": candidates(k) for k in MORE})
    chosen = "transform(filter(_f_{k}, r -> {margin} >= double('{cut}')), r -> r.m)"
    d = d.withColumns({f"_m_{k}": F.when(F.size(f"_c_{k}") > 0, F.expr(chosen.format(k=k, margin=margin("r.f"), cut=cuts[k]))).otherwise(none) for k in MORE})
    kept = F.array_sort(F.concat(*(of_kind(F.col(f"_b_{k}"), k, i) for i, k in enumerate(KINDS))))
    added = F.concat(*(of_kind(F.col(f"_m_{k}"), k, ALL.index(k)) for k in MORE))
    d = d.withColumns({f"n_{k}": F.size(f"_b_{k}").cast("bigint") for k in KINDS} | {"_base": kept, "_added": added})
    free = F.filter("_added", lambda a: ~F.exists("_base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return d.withColumn("_spans", F.array_sort(F.concat("_base", F.array_distinct(free)))).select(*unpacked(docs.columns, *results), *(f"n_{k}" for k in KINDS), F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    s = scanned(docs.select("doc_id", "text"))
    return s.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
