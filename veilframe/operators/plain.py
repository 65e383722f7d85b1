"""The rule path over ASCII texts in plain Python, as Arrow functions: spans, clean-ups, abstractions.

In ASCII the detectors and rules mean the same in Java and in Python (re.ASCII), character for character, so these functions
and the column expressions of `spans`, `textfn`, `abstraction` and `payload` are one semantics; other texts go to those. Each
function reads the texts themselves: rows that wait for their answers are held back by the size of what is sent."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from veilframe import constants as c
from veilframe.operators import conflicts
from veilframe.schemas import SPANS

FEW = 64  # spans of a text that are compared with each other
_WS = " \t\n\x0b\f\r"
_FIELDS = ("text", "start", "end", "span_type", "source", "bucket", "subsource")
_SPAN = pa.struct([(k, pa.int32() if k in ("start", "end") else pa.string()) for k in _FIELDS])

Span = tuple[str, int, int, str, str, str, str]


def ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


# ── Spans ────────────────────────────────────────────────────────────────────


def _searched(p: str) -> re.Pattern:
    """The pattern; a leading word boundary before a digit is asserted behind the digit, so that digits alone are tried."""
    return re.compile(re.sub(r"^\\b\\d", r"\\d(?<!\\w.)", p) if re.match(r"\\b\\d(?!\{)", p) else re.sub(r"^\\b\\d\{(\d)(,?)(\d*)\}", _counted, p), re.ASCII)


def _counted(m: re.Match) -> str:
    low, comma, high = int(m[1]), m[2], m[3]
    return rf"\d(?<!\w.)\d{{{low - 1}{comma}{int(high) - 1 if high else ''}}}"


_MONTH = re.compile("|".join(m.lower()[:3] for m in c._MONTHS.replace("(?:", "").replace(")?", "").split("|")))
_DETECTORS = [(kind, _searched(p), c.DETECTOR_SIGNS.get(p)) for kind, p in c.DETECTORS]


def patterns(text: str) -> list[Span]:
    """As spans.pattern_spans."""
    out = []
    for k, (kind, p, sign) in enumerate(_DETECTORS):
        if sign is not None and sign not in text or k == 0 and not _MONTH.search(text.lower()):
            continue
        out += [(m[0], m.start(), m.end(), kind, "structured_pattern", "U_med", kind) for m in p.finditer(text)]
    return out


def literals(text: str, fields: tuple[str, ...], values: list[str | None]) -> list[Span]:
    """As spans.profile_spans, of values without blanks around them."""
    out, low = [], text.lower()
    for field, value in zip(fields, values, strict=True):
        if value:
            kind, bucket = (field, "U_loc") if field in c.DIRECT_FIELDS else (c.SOFT_FIELDS[field], "U_med")
            sought, n = value.lower(), len(value)
            at = low.find(sought)
            while at >= 0:
                out.append((text[at : at + n], at, at + n, kind, "profile", bucket, field))
                at = low.find(sought, at + n)
    return out


def resolved(spans: list[Span]) -> list[Span]:
    """As spans.resolve."""
    once = list({(s[0].lower() if s[0] is not None else None, *s[1:]): s for s in spans}.values())
    if len(once) > FEW:
        return [once[i] for i in conflicts.accepted([s[1] for s in once], [s[2] for s in once], [s[5] == "U_loc" for s in once])]
    taken: list[Span] = []
    for s in sorted(once, key=lambda s: (s[5] != "U_loc", s[1] - s[2], s[1])):
        if not any(s[1] < a[2] and s[2] > a[1] for a in taken):
            taken.append(s)
    return sorted(taken, key=lambda s: s[1])


def _lists(rows: list[list[Span] | None]) -> pa.Array:
    flat = list(zip(*(s for r in rows if r for s in r), strict=True)) or [()] * 7
    cols = [pa.array(v, f.type) for v, f in zip(flat, _SPAN, strict=True)]
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r or ()))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, list(_FIELDS)), mask=pa.array([r is None for r in rows]))


def _given(spans: pa.Array) -> list[list[Span] | None]:
    flat, size = spans.flatten(), spans.value_lengths().to_pylist()
    rows, at, out = list(zip(*(flat.field(k).to_pylist() for k in _FIELDS), strict=True)), 0, []
    for n in size:
        out.append(None if n is None else rows[at : at + n])
        at += n or 0
    return out


def spans_of(text: Column, profile: dict[str, Column], others: Column) -> Column:
    """Resolved spans: those of the profile's values and of the detectors in a text, with others; where the text is null,
    the others alone. Null where both are."""
    fields = tuple(k for k in profile if k in c.DIRECT_FIELDS or k in c.SOFT_FIELDS)

    def run(texts: pa.Array, values: pa.Array, more: pa.Array) -> pa.Array:
        rows: list[list[Span] | None] = []
        for t, vs, o in zip(texts.to_pylist(), values.to_pylist(), _given(more), strict=True):
            found = o if t is None else literals(t, fields, vs) + patterns(t) + (o or [])
            rows.append(None if found is None else resolved(found))
        return _lists(rows)

    values = F.array(*(F.trim(profile[k]) for k in fields)) if fields else F.expr("cast(array() as array<string>)")
    return arrow_udf(run, SPANS)(text, values, others)


# ── Clean-ups ────────────────────────────────────────────────────────────────

_SLOT_ENDS = ("on", "at", "before", "after", "for", "near", "is", "are", "and", "or", "of", "in", "by")
_PUNCT, _SENTENCE, _WORD, _MARKERS = re.compile("[,.]"), re.compile(r"[.!?]\s+", re.A), re.compile(r"\b[a-z]{3,}\b", re.A), re.compile("|".join(rf"\[{f.upper()}\]" for f in c.DIRECT_FIELDS))
_IS_MARK, _IS_AND = re.compile(r"is\s*[,.]", re.A), re.compile(r"is\s+and", re.A)

#: What a text must show (itself, in lower case) for a rule to find anything; rules without an entry are always tried.
_NEEDS = {
    c._MY_IS_AND[0]: lambda t, low: "my" in low and _IS_AND.search(low),
    c._AND[0]: lambda t, low: "and" in t,
    c._IS[0]: lambda t, low: _IS_MARK.search(low),
    c._EMPTY_SLOT[0]: lambda t, low: any(x.rstrip(_WS).endswith(_SLOT_ENDS) for x in _PUNCT.split(low)[:-1]),
    c.CLEAN_RULES[2][0]: lambda t, low: "and" in low and any(x in low for x in ("visited", "seen at", "been to", "tried", "used")),
    c.CLEAN_RULES[3][0]: lambda t, low: _IS_AND.search(low),
    c.CLEAN_RULES[-1][0]: lambda t, low: "i want to keep the cost" in low,
    c.CLOUD_RULES[0][0]: lambda t, low: "hi" in low,
    c.CLOUD_RULES[1][0]: lambda t, low: "ou can reach me" in t,
    c.CLOUD_RULES[2][0]: lambda t, low: "my" in low and _IS_MARK.search(low),
    r" {2,}": lambda t, low: "  " in t,
}


def _compiled(rules: list[tuple[str, str]]) -> list[tuple]:
    return [(re.compile(p, re.ASCII), re.sub(r"\$(\d)", r"\\\1", r), _NEEDS.get(p)) for p, r in rules]


_CLEAN, _CLOUD = _compiled(c.CLEAN_RULES), _compiled(c.CLOUD_RULES)


def _rewritten(t: str, rules: list[tuple], bare: bool) -> str:
    """Three passes; one that changes nothing is the last, as the others would change nothing either."""
    for _ in range(3):
        before, low = t, t.lower()
        for p, r, needs in rules:
            if needs is None or needs(t, low):
                new = p.sub(r, t)
                if new is not t and new != t:
                    t, low = new, new.lower()
        t = t.strip(_WS) if bare else t
        if t == before:
            break
    return t


def _telling(t: str, stop: frozenset[str], brackets: bool) -> str:
    t, at, kept = t.strip(" "), 0, []
    ends = [(m.start() + 1, m.end()) for m in _SENTENCE.finditer(t)]
    for end, following in (*ends, (len(t), 0)):
        s, at = t[at:end].strip(" "), following
        if s:
            if brackets and "[" in s:
                kept.append(s)
                continue
            n = 0
            for m in _WORD.finditer(s.lower()):
                n += m[0] not in stop
                if n == 2:
                    kept.append(s)
                    break
    return " ".join(kept).strip(" ")


_STOP, _CLOUD_STOP = frozenset(c.STOP), frozenset(c.CLOUD_STOP)


def cleaned(t: str) -> str:
    """As textfn.cleaned."""
    return _telling(_rewritten(t, _CLEAN, False), _STOP, True)


def cloud_ready(t: str) -> str:
    """As textfn.cloud_ready."""
    return _telling(_rewritten(_MARKERS.sub("", t), _CLOUD, True), _CLOUD_STOP, False)


def _filled(t: str, spans: list[tuple[int, int]], slots: list[str]) -> str:
    out, at = [], 0
    for (start, end), slot in zip(spans, slots, strict=True):
        out += (t[at:start], slot)
        at = end
    return "".join(out) + t[at:]


def redacted(text: Column) -> Column:
    """As payload.redacted by the structured detectors; null for null."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            spans = [] if t is None else [s[1:3] for s in resolved(patterns(t))]
            out.append(None if t is None else cloud_ready(_filled(t, spans, [""] * len(spans))))
        return pa.array(out, pa.string())

    return arrow_udf(run, "string")(text)


# ── Abstraction ──────────────────────────────────────────────────────────────

_RANKS = {w: r for r, w in reversed([(r, w) for r, k in enumerate(c.LEXICONS) for w in c.LEXICONS[k]])}
_NAMES = list(c.LEXICONS)
_SETS = {k: frozenset(v) for k, v in {**c.LEXICONS, "_venues": c.VENUES, "_trip": c.MEDICAL_TRIP}.items()}
_REQUIRED, _PROHIBITED = ({k: frozenset(v) for k, v in m.items()} for m in (c.REQUIRED, c.PROHIBITED))
_LOW, _LOWER_NUMBERS, _DECADE = re.compile(r"\b[a-z]+\b", re.A), re.compile(r"\b[a-z0-9]+\b", re.A), re.compile(r"\d+s\Z", re.A)
_SPACE, _ALPHA, _AGE = re.compile(r"\s+", re.A), re.compile(r"[A-Za-z]+\Z"), re.compile(r"\b(\d{1,3})\b", re.A)
assert c.LEVELS["date"] == c.LEVELS["time"] == 3  # as they are: rule_date and rule_time have nothing to say
assert all(p.isascii() for ps in c.PHRASES.values() for p in ps)


def _proper(text: str) -> bool:
    alpha = [w for w in _SPACE.split(text.strip(" ")) if _ALPHA.match(w)]
    return bool(alpha) and all("A" <= w[0] <= "Z" for w in alpha)


def infer_type(kind: str, text: str) -> str:
    """As abstraction.infer_type."""
    if kind in c.DIRECT_TYPES:
        return c.DIRECT_TYPES[kind]
    w = set(_LOW.findall(text.lower()))
    place = "prior_venue" if w & _SETS["_venues"] else "prior_provider"
    if kind == "preference":
        return next((k for k in ("dietary_preference", "seating_preference") if w & _SETS[k]), "provider_preference")
    if kind in ("organization", "facility"):
        return place
    if kind != "noun_phrase":
        return "generic_detail"
    rank = min((_RANKS[x] for x in w if x in _RANKS), default=99)
    if rank > _NAMES.index("medical_trip") and w & _SETS["_trip"] and w & _SETS["travel_itinerary"]:
        return "medical_trip"
    if rank < 99:
        return _NAMES[rank]
    if not _proper(text):
        return "generic_detail"
    return "medical_condition" if text.strip(" ").lower() in c.MEDICAL_ABBREVIATIONS else place


def by_rule(kind: str, text: str, level: int) -> str | None:
    """As abstraction.by_rule."""
    if level == 3:
        return text
    if kind in ("address", "location"):
        parts = [x.strip(" ") for x in text.split(",")]
        if level == 0:
            return f"{parts[-1]} area" if len(parts) >= 2 and parts[-1] else "local area"
        return (f"{parts[-2]}, {parts[-1]}" if len(parts) >= 3 else text) if level == 1 else None
    if kind == "zip":
        return "local area" if level == 0 else "nearby area"
    age = _AGE.search(text) if kind == "age" else None
    if age is None:
        return None
    n = int(age[1])
    return ("an adult", f"in their {n // 10 * 10}s", f"in the {n // 5 * 5}–{n // 5 * 5 + 4} age range")[level]


def fallback(kind: str, level: int) -> str:
    """As abstraction.fallback_phrase."""
    ps = c.PHRASES.get(kind)
    return "general context" if not ps else ps[level] if level < len(ps) else ps[-1]


def validate(kind: str, text: str, strict_age: bool) -> str:
    """As abstraction.validate."""
    low = text.lower()
    words = set(_LOW.findall(low)) if strict_age else {"30s" if _DECADE.match(x) else x for x in _LOWER_NUMBERS.findall(low)}
    if len(text.strip(" ")) < 2:
        return "failed:empty output"
    if kind in _REQUIRED and not words & _REQUIRED[kind]:
        return f"failed:not {kind}-like"
    if kind in _PROHIBITED and words & _PROHIBITED[kind]:
        return "failed:contains prohibited terms"
    if kind in c.NO_PROPER_NOUN and _proper(text):
        return "failed:appears to be a proper noun (entity type change)"
    return "passed"


@lru_cache(16_384)
def _told(kind: str, text: str, alone: bool, strict_age: bool) -> tuple[int, str, str, str]:
    """Level, text, method and validation of the first span of a group."""
    level = c.LEVELS.get(kind, 1)
    rule = by_rule(kind, text, level) if alone else None
    first = fallback(kind, level) if rule is None else rule
    if alone and level == 3:
        return level, first, "verbatim", "n/a"
    check = validate(kind, first, strict_age)
    return (level, fallback(kind, level), "rule", f"{check} → fallback") if check.startswith("failed") else (level, first, "rule", check)


_END = re.compile("[.!?]")


def told(text: str, kept: list[tuple[int, int, str, str]], strict_age: bool) -> list[tuple]:
    """Type, level, text, method and validation of each kept span (start, end, type, text), as abstraction.abstract has them."""
    kinds = [infer_type(s[2], s[3]) for s in kept]
    anchors, last = [], {}
    for (start, end, *_), kind in zip(kept, kinds, strict=True):
        before = last.get(kind) if kind in c.GROUPED_TYPES else None
        anchor = start if before is None or _END.search(text, before[0], max(before[0], start)) else before[1]
        last[kind] = (end, anchor)
        anchors.append(anchor)
    size, out = Counter(anchors), []
    for (start, _, _, shown), kind, anchor in zip(kept, kinds, anchors, strict=True):
        got = _told(kind, shown, size[anchor] == 1, strict_age)
        out.append((kind, *got) if anchor == start else (kind, got[0], "", "grouped", "n/a"))
    return out


_TOLD = "array<struct<abstraction_type:string,level:int,abstracted_text:string,method:string,validation:string>>"
ABSTRACTED = f"struct<told:{_TOLD},internal:string,cloud:string>"


def abstracted(text: Column, all_spans: Column, kept: Column, strict_age: bool) -> Column:
    """struct<told, internal, cloud> of a text, its spans and the starts of those kept; null for a null text. cloud is null
    where internal is not ASCII."""

    def run(texts: pa.Array, spans: pa.Array, starts: pa.Array) -> pa.Array:
        flat, sizes, at = spans.flatten(), spans.value_lengths().to_pylist(), 0
        cols = list(zip(*(flat.field(k).to_pylist() for k in ("start", "end", "span_type", "text", "bucket")), strict=True))
        lists, internal, cloud, ends = [], [], [], [0]
        for t, n, own in zip(texts.to_pylist(), sizes, starts.to_pylist(), strict=True):
            mine, at = cols[at : at + (n or 0)], at + (n or 0)
            if t is None or n is None or own is None:
                internal.append(None), cloud.append(None), ends.append(ends[-1])
                continue
            chosen = set(own)
            got = told(t, [s[:4] for s in mine if s[0] in chosen and s[4] != "U_loc"], strict_age)
            by = iter(got)
            slots = [f"[{s[2].upper()}]" if s[4] == "U_loc" else next(by)[2] if s[0] in chosen else "" for s in mine]
            filled = _filled(t, [s[:2] for s in mine], slots)
            internal.append(cleaned(filled) if filled.isascii() else None)
            cloud.append(cloud_ready(internal[-1]) if filled.isascii() else None)
            lists += got
            ends.append(len(lists))
        names = ("abstraction_type", "level", "abstracted_text", "method", "validation")
        cells = list(zip(*lists, strict=True)) or [()] * 5
        rows = pa.StructArray.from_arrays([pa.array(v, pa.int32() if k == "level" else pa.string()) for k, v in zip(names, cells, strict=True)], list(names))
        mask = pa.array([x is None for x in internal])
        made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=mask), pa.array(internal, pa.string()), pa.array(cloud, pa.string())]
        return pa.StructArray.from_arrays(made, ["told", "internal", "cloud"], mask=mask)

    return arrow_udf(run, ABSTRACTED)(text, all_spans, kept)
