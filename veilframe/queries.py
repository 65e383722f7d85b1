"""Queries of the library's operators over the driver's tables, and DuckDB SQL for those that SQL expresses.

Payloads are composed from typed columns by SQL that both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import constants as c
from veilframe.functions import textfn
from veilframe.operators import abstraction, carryover, facts, generate, payload, recognizers, spans, timeline
from veilframe.plans import governor
from veilframe.session import spread, table
from veilframe.sources import state

PHONE = "'585-555-' || lpad(cast(o_orderkey % 10000 as string), 4, '0')"
EMAIL = "'user' || cast(c_custkey as string) || '@example.com'"
ADDRESS = "cast(c_custkey % 900 + 1 as string) || ' Main St, Rochester, ' || n_name"
PAYLOADS = f"""select o_orderkey as id, c_custkey, c_name as name, {PHONE} as phone, {EMAIL} as email, {ADDRESS} as address,
 'book a dinner table' as task, 'BlueCross Plus' as insurance, cast(20 + c_custkey % 60 as string) || ' years old' as age,
 'March ' || cast(o_orderkey % 28 + 1 as string) as day, cast(o_orderkey % 12 + 1 as string) || ':30 PM' as hour,
 'Hi, I''m ' || c_name || ' and you can reach me at ' || {PHONE} || ' or ' || {EMAIL} || '. I live at ' || {ADDRESS} ||
 '. My insurance is BlueCross Plus and I am ' || cast(20 + c_custkey % 60 as string) || ' years old. Please book a quiet table for ' ||
 cast(o_orderkey % 7 + 2 as string) || ' people on March ' || cast(o_orderkey % 28 + 1 as string) || ' at ' ||
 cast(o_orderkey % 12 + 1 as string) || ':30 PM under $' || cast(o_orderkey % 900 + 100 as string) || ' near ' ||
 cast(c_custkey % 90000 + 10000 as string) || '.' as payload
 from {{orders}} join {{customer}} on o_custkey = c_custkey join {{nation}} on c_nationkey = n_nationkey"""
PHRASES = (
    "chronic knee pain", "my prenatal visit", "Grand Hotel", "STD", "Strong Memorial", "a hospital trip abroad", "vegan food",
    "two checked bags", "nonstop route", "quiet corner", "under budget", "weekend appointment", "old blue thing",
)
PHRASE = "case p_partkey % 13 " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(PHRASES)) + " end"
ANSWER = "'1. ' || s_name || chr(10) || '12 Oak Ave, Rochester' || chr(10) || 'call (585) 555-12' || lpad(cast(s_suppkey % 100 as string), 2, '0') || chr(10) || chr(10) || '2) **Clinic ' || cast(s_nationkey as string) || '**'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DUCK = {k: k for k in ("orders", "customer", "nation", "part", "supplier", "documents", "benchmark", "conversations", "lineitem")}


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    names = [k for k in DUCK if "{" + k + "}" in text]
    return spark.sql(text, **{k: spread(table(spark, d, k)) if k == names[0] else table(spark, d, k) for k in names})


def query(oracle: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLE[name or f.__name__] = oracle.replace("{PAYLOADS}", f"({PAYLOADS.format(**DUCK)})").replace("{ANSWER}", ANSWER).replace("{PHRASE}", PHRASE)
        return f

    return add


def payloads(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, PAYLOADS)


def _profile() -> dict:
    return {k: F.col(k) for k in ("name", "phone", "email", "address", "insurance")}


def _q(s: str) -> str:
    return s.replace("'", "''")


# ── Stage 1 ──────────────────────────────────────────────────────────────────


def _extract(kind: str) -> None:
    ps = [p for k, p in c.DETECTORS if k == kind]
    lists = " || ".join(f"regexp_extract_all(payload, '{_q(p)}')" for p in ps)

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = F.transform(spans.pattern_spans(F.col("payload"), kind), lambda s: s["text"])
        return payloads(spark, d).select("id", found.alias("f")).select("id", F.size("f").cast("bigint").alias("n"), F.array_join("f", "|").alias("found"))

    query(f"select id, cast(len(f) as bigint) as n, coalesce(array_to_string(f, '|'), '') as found from (select id, {lists} as f from {{PAYLOADS}})", f"extract_{kind}")(run)


for _kind in ("email", "phone", "date", "money", "time", "zip", "age", "party_size"):
    _extract(_kind)


def _located(p: str, kind: str, k: int, bucket: str = "U_med", gaps: str | None = None, hits: str | None = None) -> str:
    gaps, hits = gaps or f"string_split_regex(payload, '{_q(p)}')", hits or f"regexp_extract_all(payload, '{_q(p)}')"
    return f"""select id, payload, '{kind}' as span_type, '{bucket}' as bucket, {k} as k, i, m[i] as text,
 list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as s
 from (select id, payload, {hits} as m, {gaps} as g, unnest(range(1, len({hits}) + 1)) as i from {{PAYLOADS}})"""


_STRUCTURED = " union all ".join(_located(p, k, i) for i, (k, p) in enumerate(c.DETECTORS, 10))
_PROFILE = " union all ".join(
    _located("", kind, i, bucket, f"string_split(payload, {col})", f"list_transform(range(1, len(string_split(payload, {col}))), lambda x: {col})")
    for i, (col, kind, bucket) in enumerate((("name", "name", "U_loc"), ("phone", "phone", "U_loc"), ("email", "email", "U_loc"), ("address", "address", "U_med"), ("insurance", "insurance_name", "U_med")))
)
def _accepted(found: str) -> str:
    return f"""with recursive found as materialized (select *, s + length(text) as e from ({found})), ranked as materialized (select *, row_number() over (partition by id order by
 case bucket when 'U_loc' then 0 else 1 end, s - e, s, k, i) as r from found),
 walk as (select id, r, [{{'s': s, 'e': e}}] as acc, true as ok, s, e, span_type, bucket, text, payload from ranked where r = 1
 union all select n.id, n.r, case when len(list_filter(w.acc, lambda a: n.s < a.e and n.e > a.s)) = 0 then list_append(w.acc, {{'s': n.s, 'e': n.e}}) else w.acc end,
 len(list_filter(w.acc, lambda a: n.s < a.e and n.e > a.s)) = 0, n.s, n.e, n.span_type, n.bucket, n.text, n.payload
 from walk w join ranked n on n.id = w.id and n.r = w.r + 1), accepted as (select * from walk where ok)"""


_ACCEPTED = _accepted(f"{_PROFILE} union all {_STRUCTURED}")


def _view(slot: str, only: str = "true", accepted: str = _ACCEPTED) -> str:
    return f"""{accepted} select id, string_agg(substring(payload, cast(p + 1 as int), cast(s - p as int)) || {slot}, '' order by s) || substring(any_value(payload), cast(max(e) + 1 as int)) as v
 from (select *, lag(e, 1, 0) over (partition by id order by s) as p from accepted where {only}) group by id"""


@query(f"select id, span_type, cast(s as int) as start_at, cast(s + length(text) as int) as end_at, text from ({_STRUCTURED})")
def span_offsets(spark: SparkSession, d: str) -> DataFrame:
    s = spans.records(payloads(spark, d), "id", spans=spans.pattern_spans(F.col("payload")))
    return s.select("id", "span_type", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "text")


@query(f"{_ACCEPTED} select id, span_type, bucket, cast(s as int) as start_at, cast(e as int) as end_at, text from accepted")
def overlap_resolve(spark: SparkSession, d: str) -> DataFrame:
    s = spans.records(spans.extract(payloads(spark, d), profile=_profile()), "id")
    return s.select("id", "span_type", "bucket", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "text")


@query(f"select id, span_type, bucket, cast(s as int) as start_at, text from ({_PROFILE})")
def profile_match(spark: SparkSession, d: str) -> DataFrame:
    s = spans.records(payloads(spark, d), "id", spans=spans.profile_spans(F.col("payload"), _profile()))
    return s.select("id", "span_type", "bucket", F.col("start").alias("start_at"), "text")


@query(_view("'[SPAN]'"))
def context_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return spans.extract(payloads(spark, d), profile=_profile()).select("id", F.col("context").alias("v"))


@query(_view("'[' || upper(bucket) || ':' || span_type || ']'"))
def tag_payload(spark: SparkSession, d: str) -> DataFrame:
    return spans.extract(payloads(spark, d), profile=_profile()).select("id", F.col("tagged").alias("v"))


@query(_view("'[' || upper(span_type) || ']'", "bucket = 'U_loc'"))
def mask_working(spark: SparkSession, d: str) -> DataFrame:
    return spans.extract(payloads(spark, d), profile=_profile()).select("id", F.col("working").alias("v"))


def _dealt(spark: SparkSession, d: str, values: list[tuple], names: str) -> DataFrame:
    """The parts as id, each with one of the values, dealt by key."""
    rows = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(v, names.split()))) for v in values))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return parts.select("id", F.element_at(rows, (F.col("id") % len(values)).cast("int") + 1).alias("v")).select("id", "v.*")


def _dealt_sql(values: list[tuple], names: str) -> str:
    shown = ", ".join(f"({i}, {', '.join(str(x) if isinstance(x, int) else chr(39) + _q(x) + chr(39) for x in v)})" for i, v in enumerate(values))
    return f"(select p_partkey as id, {', '.join(names.split())} from part join (values {shown}) v(i, {', '.join(names.split())}) on p_partkey % {len(values)} = i)"


# ── Stages 2 and 3 ───────────────────────────────────────────────────────────

_TYPES = tuple(dict.fromkeys((*c.KEEP_TYPES, *c.DROP_TYPES, "age", "phone", "email")))
_TYPE_ROWS = [(t,) for t in _TYPES]


_GONE = "('organization', 'facility', 'person', 'group')"


@query(f"select id, t as span_type, t not in {_GONE} as kept, case when t in {_GONE} then 'rule:drop' else 'rule:keep' end as reason from {_dealt_sql(_TYPE_ROWS, 't')}")
def carryover_rule(spark: SparkSession, d: str) -> DataFrame:
    one = F.array(F.struct(*(F.lit("x").alias(k) if k == "text" else F.lit(0).alias(k) if k in ("start", "end") else F.col("t").alias(k) if k == "span_type" else F.lit("").alias(k) for k in ("text", "start", "end", "span_type", "source", "bucket", "subsource"))))
    rows = _dealt(spark, d, _TYPE_ROWS, "t").select("id", F.inline(carryover.decide(one)))
    return rows.select("id", "span.span_type", "kept", "reason")


@query(f"{_ACCEPTED} select id, 'book a dinner table; constraints: ' || concat_ws(', ', case when bool_or(span_type = 'date') then 'date availability' end, case when bool_or(span_type = 'time') then 'time preference' end, case when bool_or(span_type in ('address', 'location', 'zip')) then 'location' end, case when bool_or(span_type = 'insurance_name') then 'insurance coverage' end, case when bool_or(span_type = 'money') then 'budget limit' end, case when bool_or(span_type = 'party_size') then 'party size' end) as frame from accepted where bucket = 'U_med' group by id")
def task_frame(spark: SparkSession, d: str) -> DataFrame:
    return carryover.carry_over(spans.extract(payloads(spark, d), profile=_profile())).select("id", F.col("task_frame").alias("frame"))


# Expected types, read off the lexicons by hand.
_INFER = (
    "case t when 'chronic knee pain' then 'medical_condition' "
    "when 'my prenatal visit' then 'pregnancy_status' "
    "when 'Grand Hotel' then 'travel_itinerary' "
    "when 'STD' then 'medical_condition' "
    "when 'Strong Memorial' then 'occasion_relationship' "
    "when 'a hospital trip abroad' then 'medical_trip' "
    "when 'vegan food' then 'dietary_preference' "
    "when 'two checked bags' then 'baggage_constraint' "
    "when 'nonstop route' then 'transport_constraint' "
    "when 'quiet corner' then 'restaurant_atmosphere' "
    "when 'under budget' then 'budget_cost' "
    "when 'weekend appointment' then 'service_need' "
    "when 'old blue thing' then 'generic_detail' end"
)


@query(f"select id, t, {_INFER} as kind from (select p_partkey as id, {{PHRASE}} as t from part)")
def infer_type(spark: SparkSession, d: str) -> DataFrame:
    t = _sql(spark, d, f"select p_partkey as id, {PHRASE} as t from {{part}}")
    return t.select("id", "t", abstraction.infer_type(F.lit("noun_phrase"), F.col("t")).alias("kind"))


@query("select id, l as level, case l when 0 then 'in March' when 1 then case when n <= 10 then 'early' when n <= 20 then 'mid' else 'late' end || '-March' when 2 then 'around March ' || n end as v from (select id, cast(substring(day, 7) as int) as n, unnest([0, 1, 2]) as l from {PAYLOADS})")
def rule_date(spark: SparkSession, d: str) -> DataFrame:
    p = payloads(spark, d).select("id", "day", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("level"))
    return p.select("id", "level", abstraction.rule_date(F.col("day"), F.col("level")).alias("v"))


@query("select id, l as level, case l when 0 then case when h < 12 then 'morning' when h < 17 then 'afternoon' else 'evening' end when 1 then h || ':00–' || (h + 1) || ':00' else 'around ' || (case when h // 2 * 2 <= 12 then h // 2 * 2 else h // 2 * 2 - 12 end) || ' PM' end as v from (select id, case when n = 12 then 12 else n + 12 end as h, l from (select id, cast(split_part(hour, ':', 1) as int) as n, unnest([0, 1, 2]) as l from {PAYLOADS}))")
def rule_time(spark: SparkSession, d: str) -> DataFrame:
    p = payloads(spark, d).select("id", "hour", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("level"))
    return p.select("id", "level", abstraction.rule_time(F.col("hour"), F.col("level")).alias("v"))


@query("select id, l as level, case l when 0 then n || ' area' else 'Rochester, ' || n end as v from (select id, trim(split_part(address, ',', 3)) as n, unnest([0, 1]) as l from {PAYLOADS})")
def rule_address(spark: SparkSession, d: str) -> DataFrame:
    p = payloads(spark, d).select("id", "address", F.explode(F.array(F.lit(0), F.lit(1))).alias("level"))
    return p.select("id", "level", abstraction.rule_address(F.col("address"), F.col("level")).alias("v"))


@query("select id, l as level, case l when 0 then 'an adult' when 1 then 'in their ' || (n // 10 * 10) || 's' else 'in the ' || (n // 5 * 5) || '–' || (n // 5 * 5 + 4) || ' age range' end as v from (select id, cast(split_part(age, ' ', 1) as int) as n, unnest([0, 1, 2]) as l from {PAYLOADS})")
def rule_age(spark: SparkSession, d: str) -> DataFrame:
    p = payloads(spark, d).select("id", "age", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("level"))
    return p.select("id", "level", abstraction.rule_age(F.col("age"), F.col("level")).alias("v"))


_PHRASE_ROWS = [(k, i) for k, ps in c.PHRASES.items() for i in range(len(ps))]


@query(f"select id, kind, level, phrase from {_dealt_sql([(k, i, c.PHRASES[k][i]) for k, i in _PHRASE_ROWS], 'kind level phrase')}")
def fallback_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _dealt(spark, d, _PHRASE_ROWS, "kind level").withColumn("phrase", abstraction.fallback_phrase(F.col("kind"), F.col("level")))


# Expected levels, written out.
_LEVEL = """case
 when kind in ('prior_provider', 'prior_venue', 'person') then 0
 when kind in ('age', 'address', 'location', 'zip', 'insurance_name', 'medical_condition', 'medical_symptom', 'care_history', 'medication', 'medical_trip', 'pregnancy_status', 'mental_health_concern', 'travel_purpose', 'child_travel', 'occasion_relationship', 'generic_detail') then 1
 when kind in ('distance_proximity', 'budget_cost', 'party_size', 'provider_preference', 'provider_requirement', 'service_need', 'accessibility_need', 'travel_itinerary', 'transport_constraint', 'baggage_constraint', 'ticket_flexibility', 'dietary_preference', 'allergy', 'restaurant_atmosphere', 'seating_preference') then 2
 when kind in ('date', 'time') then 3
 end"""


_KINDS = [(k,) for k in c.LEVELS]


@query(f"select id, kind, {_LEVEL} as level from {_dealt_sql(_KINDS, 'kind')}")
def level_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _dealt(spark, d, _KINDS, "kind").withColumn("level", abstraction.level_of(F.col("kind")))


def _chain(rules: list[tuple[str, str]], t: str, passes: int, trim: bool = False) -> list[str]:
    out = [t]
    for _ in range(passes):
        out += [f"regexp_replace({{0}}, '{_q(p)}', '{r.replace('$', chr(92))}', 'g')" for p, r in rules] + ["regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"] * trim
    return out


def _steps(rules: list[tuple[str, str]], source: str, start: str, passes: int, trim: bool = False) -> str:
    """Nested subqueries, so that no text of SQL doubles."""
    sql = f"select doc_id, {start} as t from {source}"
    for k in _chain(rules, "t", passes, trim)[1:]:
        sql = f"select doc_id, {k.replace('{0}', 't')} as t from ({sql})"
    return sql


def _sentences(stop: tuple[str, ...], brackets: bool) -> str:
    # whole Unicode words that are ASCII letters only
    words = f"len(list_filter(string_split_regex(lower(x), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') and w not in ({', '.join(repr(s) for s in stop)}))) >= 2"
    keep = f"(contains(x, '[') or {words})" if brackets else words
    split = "string_split(regexp_replace(trim(t), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"trim(array_to_string(list_filter(list_transform({split}, lambda x: trim(x)), lambda x: length(x) > 0 and {keep}), ' '))"


_HOLED = "replace(replace(replace(payload, name, ''), phone, ''), day, '')"


@query(f"select doc_id, {_sentences(c.STOP, True)} as v from ({_steps(c.CLEAN_RULES, '(select id as doc_id, payload, name, phone, day from {PAYLOADS})', _HOLED, 3)})")
def cleanup(spark: SparkSession, d: str) -> DataFrame:
    return payloads(spark, d).select(F.col("id").alias("doc_id"), textfn.cleaned(F.expr(_HOLED)).alias("v"))


@query(f"select doc_id, {_sentences(c.CLOUD_STOP, False)} as v from (select doc_id, text as t from documents)")
def sentence_filter(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select("doc_id", textfn.telling(F.col("text"), c.CLOUD_STOP, False).alias("v"))


_MARKED = "regexp_replace(payload, '\\[(" + "|".join(f.upper() for f in c.DIRECT_FIELDS) + ")\\]', '', 'g')"


@query(f"select doc_id, {_sentences(c.CLOUD_STOP, False)} as v from ({_steps(c.CLOUD_RULES, '(select id as doc_id, payload from {PAYLOADS})', _MARKED, 3, True)})")
def cloud_prepare(spark: SparkSession, d: str) -> DataFrame:
    return payloads(spark, d).select(F.col("id").alias("doc_id"), textfn.cloud_ready(F.col("payload")).alias("v"))


_REDACTED = f"select doc_id as id, {_sentences(c.CLOUD_STOP, False)} as v from ({_steps(c.CLOUD_RULES, '(' + _view(chr(39) * 2, accepted=_accepted(_STRUCTURED)).replace('select id, string_agg', 'select id as doc_id, string_agg') + ')', 'v', 3, True)})"

# What each span of the composed payloads becomes, written out.
_SLOT = """case span_type when 'name' then '[NAME]' when 'phone' then '[PHONE]' when 'email' then '[EMAIL]'
 when 'address' then 'Rochester, ' || trim(split_part(text, ',', 3)) when 'insurance_name' then 'a coverage category' when 'age' then 'in their ' || text[1] || '0s'
 when 'money' then 'an approximate limit' when 'party_size' then 'a group size' when 'zip' then 'nearby area' else text end"""
_INTERNAL = f"select doc_id, {_sentences(c.STOP, True)} as v from ({_steps(c.CLEAN_RULES, '(' + _view(_SLOT).replace('select id, string_agg', 'select id as doc_id, string_agg') + ')', 'v', 3)})"
_UNMARKED = "regexp_replace(v, '\\[(" + "|".join(f.upper() for f in c.DIRECT_FIELDS) + ")\\]', '', 'g')"
_CLOUD = f"select doc_id, {_sentences(c.CLOUD_STOP, False)} as v from ({_steps(c.CLOUD_RULES, 'internal', _UNMARKED, 3, True)})"
_FRAME = "book a dinner table; constraints: date availability, time preference, location, insurance coverage, budget limit, party size"


@query(_REDACTED)
def redact_baseline(spark: SparkSession, d: str) -> DataFrame:
    return payloads(spark, d).select("id", payload.redacted(F.col("payload")).alias("v"))


@query(f"with internal as materialized ({_INTERNAL}) select i.doc_id as id, '{_FRAME}' as task_frame, i.v as internal_payload, c.v as cloud_payload from internal i join ({_CLOUD}) c on i.doc_id = c.doc_id")
def sanitize_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    return governor.sanitize_with_trace(payloads(spark, d), profile=_profile()).select("id", "task_frame", "internal_payload", "cloud_payload")


def _leaking(*fields: str) -> str:
    return " + ".join(f"case when contains(lower(t), lower({f})) then 1 else 0 end" for f in fields)


_WORDS = "len(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> ''))"


@query(f"""with internal as materialized ({_INTERNAL}), out as (select doc_id as id, 'governor' as method, v as t from ({_CLOUD}) union all select id, 'redaction', v from ({_REDACTED}) union all select id, 'naive', payload from {{PAYLOADS}}),
 m as (select o.method, {_leaking("day", "hour")} as cur, {_leaking("name", "phone", "email", "address", "insurance")} as res, {_WORDS.format("payload")} as n, {_WORDS.format("t")} as k from out o join {{PAYLOADS}} p on o.id = p.id)
 select method, round(avg(case when cur > 0 then 1 else 0 end), 4) as lr, round(avg(cur / 2), 4) as lratio, round(avg(case when res > 0 then 1 else 0 end), 4) as rlr, round(avg(res / 5), 4) as rlratio,
 round(avg(res / 5), 4) as ils, round(avg((n - k) / n), 4) as pr, round(avg(k), 4) as tokens from m group by method""")
def method_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = payloads(spark, d).withColumns({"cur": F.array("day", "hour"), "res": F.array("name", "phone", "email", "address", "insurance")})
    s = governor.scored(governor.by_method(p, profile=_profile()), "cur", "res")
    return facts.means(s, ["lr", "lratio", "rlr", "rlratio", "ils", "pr", "tokens"], "method", digits=4)


# ── Facts and metrics ────────────────────────────────────────────────────────


@query("select doc_id, item_id from documents d, benchmark b where length(b.text) >= 3 and contains(lower(d.text), lower(b.text))")
def leak_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs, items = spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "benchmark").select("item_id", F.col("text").alias("fact"))
    return facts.leaks(docs, items, "text", "fact").select("doc_id", "item_id")


@query("select lang, count(*) as n_docs, count(*) filter (k > 0) as n_leaking, sum(k) as n_leaked, count(*) filter (k > 0) / count(*) as lr from (select doc_id, any_value(lang) as lang, sum(case when length(b.text) >= 3 and contains(lower(d.text), lower(b.text)) then 1 else 0 end) as k from documents d, benchmark b group by doc_id) group by lang")
def leak_rate_by_lang(spark: SparkSession, d: str) -> DataFrame:
    k = leak_pairs(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    rows = table(spark, d, "documents").select("doc_id", "lang").join(k, "doc_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    n, leaking = F.count(F.lit(1)), F.count_if(F.col("k") > 0)
    return rows.groupBy("lang").agg(n.alias("n_docs"), leaking.alias("n_leaking"), F.sum("k").alias("n_leaked"), (leaking / n).alias("lr"))


@query("select id, cast(n as int) as n_leaked, n / 4 as ratio from (select id, (case when contains(lower(payload), lower(name)) then 1 else 0 end) + (case when contains(lower(payload), 'window seat') then 1 else 0 end) + (case when contains(lower(payload), lower(day)) then 1 else 0 end) + (case when contains(lower(payload), 'oak ridge') then 1 else 0 end) as n from {PAYLOADS})")
def leak_ratio(spark: SparkSession, d: str) -> DataFrame:
    all_facts = F.array("name", F.lit("window seat"), "day", F.lit("oak ridge"))
    p = payloads(spark, d).withColumn("f", all_facts).withColumn("l", facts.leaking(F.col("payload"), F.col("f")))
    return p.select("id", F.size("l").alias("n_leaked"), facts.ratio(F.col("l"), F.col("f")).alias("ratio"))


@query("select id, (case when contains(lower(payload), lower(name)) then 1 else 0 end + case when contains(lower(payload), lower(phone)) then 1 else 0 end) / 3 as ils from {PAYLOADS}")
def ils(spark: SparkSession, d: str) -> DataFrame:
    p = payloads(spark, d).withColumn("r", F.array("name", "phone", F.lit("table")))
    return p.select("id", facts.injection(F.col("payload"), F.col("task"), F.col("r")).alias("ils"))


@query("select id, (case when contains(lower(payload), k) then 1.0::double else 0.0::double end + 1.0::double + case when id % 3 = 0 then 0.0::double else 0.6::double end + case when id % 2 = 0 then 0.3::double else 0.0::double end) / (1.0::double + 1.0::double + 0.6::double + 0.3::double) as wls from (select *, 'customer#' || lpad(cast(id % 2000 as varchar), 9, '0') as k from {PAYLOADS})")
def wls(spark: SparkSession, d: str) -> DataFrame:
    seat, place = F.when(F.col("id") % 2 == 0, "quiet table").otherwise("aisle seat"), F.when(F.col("id") % 3 == 0, "9 Elm St, Nowhere").otherwise(F.col("address"))
    who = F.concat(F.lit("Customer#"), F.lpad((F.col("id") % 2000).cast("string"), 9, "0"))
    p = payloads(spark, d).withColumn("m", F.create_map(F.lit("name"), who, F.lit("phone"), "phone", F.lit("address"), place, F.lit("seat_preference"), seat))
    return p.select("id", facts.weighted(F.col("payload"), facts.profile_facts(F.col("m"))).alias("wls"))


_FIELD_ROWS = [(f,) for f in (*c.DIRECT_FIELDS, *c.SOFT_FIELDS)]


@query(f"select id, field, case when field in ('address', 'insurance') then 0.6 when field in ('doctor_gender_preference', 'dietary_preference', 'seat_preference') then 0.3 else 1.0 end::double as weight from {_dealt_sql(_FIELD_ROWS, 'field')}")
def fact_tiers(spark: SparkSession, d: str) -> DataFrame:
    return _dealt(spark, d, _FIELD_ROWS, "field").withColumn("weight", facts.weight(F.col("field")))


@query("select id, (n - k) / n as pr from (select id, len(list_filter(string_split_regex(payload, '\\s+'), lambda w: w <> '')) as n, len(list_filter(string_split_regex(task, '\\s+'), lambda w: w <> '')) as k from {PAYLOADS})")
def payload_reduction(spark: SparkSession, d: str) -> DataFrame:
    return payloads(spark, d).select("id", facts.reduction(F.col("payload"), F.col("task")).alias("pr"))


@query("select a.conv_id, a.turn, count(distinct b.text) as n_hist from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn < a.turn group by all")
def history_running_union(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").withColumn("cur", F.array("text"))
    return timeline.history(t, "conv_id", "turn", "cur").select("conv_id", "turn", F.col("n_before").alias("n_hist"))


@query("select id, b as backstory_size, cast(k as int) as abs_leak, case when b = 0 then 0 else k / least(b, 4) end as hist_ls from (select id, b, case when b >= 1 then 1 else 0 end + case when b >= 2 and id % 3 = 0 then 1 else 0 end + case when b >= 4 and id % 7 = 2 then 1 else 0 end as k from (select id, unnest([0, 2, 3, 5]) as b from {PAYLOADS}))")
def hist_ablation(spark: SparkSession, d: str) -> DataFrame:
    some = lambda k, r, x: F.when(F.col("id") % k == r, x).otherwise("zebra crossing")
    p = payloads(spark, d).withColumn("h", F.array(F.col("name"), some(3, 0, F.col("address")), F.lit("no such fact"), some(7, 2, F.lit("quiet table"))))
    return facts.ablation(p, (0, 2, 3, 5), "h", "payload").select("id", "backstory_size", "abs_leak", "hist_ls")


@query("select s_suppkey as id, lower(s_name) || '|clinic ' || s_nationkey as names from supplier")
def parse_candidates(spark: SparkSession, d: str) -> DataFrame:
    a = _sql(spark, d, f"select s_suppkey as id, {ANSWER} as answer from {{supplier}}")
    return a.select("id", F.array_join(facts.candidates(F.col("answer")), "|").alias("names"))


@query("select s_suppkey as id, cast(1 + case when s_suppkey % 2 = 0 then 1 else 0 end as int) as n from supplier")
def match_candidates(spark: SparkSession, d: str) -> DataFrame:
    a = _sql(spark, d, "select s_suppkey as id, array(lower(s_name), 'city dental') as naive, case when s_suppkey % 2 = 0 then array(lower(s_name), 'city dental group') else array('x', 'city dental group') end as m from {supplier}")
    return a.select("id", facts.matched(F.col("naive"), F.col("m")).alias("n"))


@query("select s_suppkey as task, method, 'p' as provider, case when method = 'naive' or s_suppkey % 2 = 0 then 1.0 else 0.5 end::double as urr from supplier, (values ('naive'), ('governor')) v(method)")
def urr_paired(spark: SparkSession, d: str) -> DataFrame:
    own = "array(lower(s_name), 'city dental')"
    calls = _sql(spark, d, f"select s_suppkey as task, 'p' as provider, 0 as call, m.method, case when m.method = 'naive' or s_suppkey % 2 = 0 then {own} else array('city dental') end as candidates from {{supplier}}, (select explode(array('naive', 'governor')) as method) m")
    return facts.retention(calls)


@query("select l_orderkey as id, cast(case when sum(case when l_quantity > 25 then 1 else 0 end) * 2 > count(*) then 1 else 0 end as int) as tsr from lineitem group by 1")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return facts.majority(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") > 25).alias("vote")), "id")


@query("select l_returnflag as method, l_linestatus as field, avg(case when l_quantity / 50 < 0.25 then 0.0 when l_quantity / 50 = 0.25 then 0.0 when l_quantity / 50 < 0.75 then 0.5 else 1.0 end::double) as score from lineitem group by 1, 2")
def ris_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("field"), facts.snapped(F.col("l_quantity") / 50).alias("score"))
    return facts.means(t, ["score"], "method", "field")


@query("select l_returnflag as method, avg(l_quantity) as quantity, avg(l_linenumber) as line from lineitem group by 1")
def dataset_means(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("line"))
    return facts.means(t, ["quantity", "line"], "method")


@query("select method, avg(m) as quantity from (select l_returnflag as method, l_linestatus, avg(l_quantity) as m from lineitem group by 1, 2) group by 1")
def provider_means(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("provider"), F.col("l_quantity").alias("quantity"))
    return facts.provider_means(t, "quantity")


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) where r = 1")
def first_per_seed(spark: SparkSession, d: str) -> DataFrame:
    return facts.first_per_seed(table(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


# ── Payloads, forms, services, generators ────────────────────────────────────

_CATEGORY = "case when t in ('chronic knee pain', 'a hospital trip abroad') then 'medical' when t = 'vegan food' then 'restaurant' else 'general' end"


@query(f"select id, {_CATEGORY} as category from (select p_partkey as id, {{PHRASE}} as t from part)")
def category_infer(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, f"select p_partkey as id, {PHRASE} as t from {{part}}").select("id", payload.category(F.col("t")).alias("category"))


_TEMPLATED = "name || ' at ' || address || ' is looking for help — Book a dinner table. ' || day || '. Insurance: BlueCross Plus.'"


@query(f"select id, v || case when contains(v, '77') then '' else chr(10) || 'Patient context: Age: 77.' end as v from (select id, {_TEMPLATED} as v from {{PAYLOADS}})")
def template_payload(spark: SparkSession, d: str) -> DataFrame:
    q = payload.template_query(F.col("name"), F.col("address"), F.col("task"), F.col("day"), F.col("insurance"))
    return payloads(spark, d).select("id", payload.with_context(q, F.lit("77"), F.col("address"), F.col("insurance"), F.lit("")).alias("v"))


@query("select s_suppkey as id, p as position, case p when 1 then s_name else 'Clinic ' || s_nationkey end as name, case p when 1 then '12 Oak Ave, Rochester' else '' end as address, case p when 1 then '(585) 555-12' || lpad(cast(s_suppkey % 100 as varchar), 2, '0') else '' end as phone from supplier, (values (1::bigint), (2::bigint)) v(p)")
def provider_parse(spark: SparkSession, d: str) -> DataFrame:
    return payload.providers(_sql(spark, d, f"select s_suppkey as id, {ANSWER} as answer from {{supplier}}"), "id", "answer")


_FORMS = "(values " + ", ".join(f"('{k}', '{f}', {i}, {str(n).lower()})" for k, fs in c.FORM_FIELDS.items() for i, (f, n) in enumerate(fs)) + ") v(category, field, position, necessary)"


_OVER = "('medical', 'ssn', 5), ('medical', 'dob', 6), ('dental', 'ssn', 5), ('dental', 'dob', 6), ('restaurant', 'credit_card', 5), ('garage', 'driver_license', 4), ('general', 'ssn', 4)"


@query(f"select id, category, field, position, false as necessary from (values {_OVER}) v(category, field, position) join (select c_custkey as id, case c_custkey % 5 when 0 then 'medical' when 1 then 'dental' when 2 then 'restaurant' when 3 then 'garage' else 'general' end as category from customer) using (category)")
def over_disclosed(spark: SparkSession, d: str) -> DataFrame:
    asked = _sql(spark, d, "select c_custkey as id, case c_custkey % 5 when 0 then 'medical' when 1 then 'dental' when 2 then 'restaurant' when 3 then 'garage' else 'general' end as category from {customer}")
    return asked.join(payload.over_disclosed(payload.form_fields(spark)), "category").select("id", "category", "field", "position", "necessary")


@query(f"select c_custkey as id, category, field, case field when 'name' then c_name else 'x' end as value from {_FORMS}, customer where field in ('name', 'phone')")
def form_join(spark: SparkSession, d: str) -> DataFrame:
    profile = _sql(spark, d, "select c_custkey as id, stack(2, 'name', c_name, 'phone', 'x') as (field, value) from {customer}")
    return payload.filled_form(payload.form_fields(spark), profile).select("id", "category", "field", "value")


@query("select slug, max(s_suppkey) as last from (select 'service-' || (s_suppkey % 10) as slug, s_suppkey from supplier) group by 1")
def service_registry(spark: SparkSession, d: str) -> DataFrame:
    s = _sql(spark, d, "select concat(' Service ', s_suppkey % 10, '!') as name, s_suppkey from {supplier}")
    return state.registry(s, "s_suppkey").select("slug", F.col("s_suppkey").alias("last"))


_SENTENCE = "case " + " ".join(f"when regexp_matches(lower(t), '{_q(p)}') then '" + _q(shape).replace("{}", "' || t || '") + "'" for p, shape in c.CONSTRAINT_SENTENCES) + " end"


@query(f"select id, t, {_SENTENCE} as v from (select p_partkey as id, {{PHRASE}} as t from part)")
def constraint_sentence(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, f"select p_partkey as id, {PHRASE} as t from {{part}}").select("id", "t", generate.constraint_sentence(F.col("t")).alias("v"))


@query("select p_partkey as id, 'Please help. I should mention I have been dealing with ' || {PHRASE} || '.' as v from part")
def coverage_inject(spark: SparkSession, d: str) -> DataFrame:
    t = _sql(spark, d, f"select p_partkey as id, {PHRASE} as t from {{part}}")
    return t.select("id", generate.covered(F.lit("Please help."), F.array("t"), F.expr("cast(array() as array<string>)")).alias("v"))


def _domains(spark: SparkSession, d: str) -> DataFrame:
    pool = lambda n: F.array(*(F.concat(F.lit(f"{n} {i} of "), F.col("n_name")) for i in range(5)))
    cols = ("intent_templates", "service_type", "hard_constraints", "soft_preference", "supporting_context", "general_sensitive_info", "user_goal")
    own = F.create_map(*(x for i in range(3) for x in (F.lit(f"sort{i}"), pool(f"condition{i}"))))
    return table(spark, d, "nation").select(F.col("n_name").alias("domain"), *(pool(k).alias(k) for k in cols), own.alias("domain_sensitive_info"))


@query()
def seed_expand(spark: SparkSession, d: str) -> DataFrame:
    return generate.expanded(generate.seeds(_domains(spark, d), 4), 5)


@query("select n_name as domain, 20::bigint as tasks, 4::bigint as seeds, 0::bigint as uncovered, 20::bigint as fitting from nation")
def seed_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What every expansion must hold: all sensitive items word for word, two of each sort."""
    t = generate.expanded(generate.seeds(_domains(spark, d), 4), 5)
    missing = F.size(F.filter("sensitive_info", lambda x: ~F.contains(F.lower("prompt"), F.lower(x))))
    fits = (F.size(F.array_distinct("domain_sensitive")) == 2) & (F.size(F.array_distinct("general_sensitive")) == 2)
    return t.groupBy("domain").agg(F.count(F.lit(1)).alias("tasks"), F.countDistinct("seed_id").alias("seeds"), F.sum(missing).alias("uncovered"), F.count_if(fits).alias("fitting"))


# ── Model answers, traces and scores ─────────────────────────────────────────

_TALK = """case s_suppkey % 5
 when 0 then 'REASONING: needed.' || chr(10) || 'CLOUD QUERY: "find ' || s_name || '"' || chr(10) || chr(10) || 'This query includes a name.'
 when 1 then 'CLOUD QUERY: first' || chr(10) || 'CLOUD QUERY: ' || s_name || ' Note: private'
 when 2 then 'My briefing: "a place that knows ' || s_name || ' and has time in March"'
 when 3 then 'REASONING: all of it.' || chr(10) || 'Here is the text:' || chr(10) || '"' || repeat('please find ' || s_name || '. ', 5) || '"'
 else 'no query by ' || s_name end"""


@query(f"""select s_suppkey as id,
 case s_suppkey % 5 when 0 then 'find ' || s_name when 1 then s_name when 2 then 'a place that knows ' || s_name || ' and has time in March' when 3 then trim(repeat('please find ' || s_name || '. ', 5)) end as said,
 case s_suppkey % 5 when 0 then 'needed.' when 1 then 'CLOUD QUERY: first' when 3 then 'all of it.' else {_TALK} end as reasoning from supplier""")
def query_parse(spark: SparkSession, d: str) -> DataFrame:
    a = _sql(spark, d, f"select s_suppkey as id, payload_answer as a from (select *, {_TALK} as payload_answer from {{supplier}})").withColumn("p", payload.parsed_query(F.col("a")))
    return a.select("id", F.col("p.query").alias("said"), F.col("p.reasoning").alias("reasoning"))


@query("select id, case when id % 4 = 0 then 'Find me a table in March under budget' when id % 4 = 1 then 'Sure, ok' when id % 4 = 2 then 'the text for ' || name else 'Please help ' || name end as v from {PAYLOADS}")
def rewrite_baseline(spark: SparkSession, d: str) -> DataFrame:
    said = F.expr("case id % 4 when 0 then ' Cleaned message: Find me a table in March under budget' when 1 then 'Sure, ok' when 2 then concat('HERE IS the text for ', name) else concat('Please help ', name) end")
    return payloads(spark, d).select("id", payload.rewritten(said).alias("v"))


_JSON = """'{{"task": "' || c_name || '", "n": ' || cast(c_custkey as string) || ', "data": [{{"place": " ' || n_name || ' ", "ok": true}}, ["ab", "' || c_mktsegment || '"]], "none": null, "colon:": "a: b"}}'"""


@query("select c_custkey as id, c_name || '|' || n_name || '|' || c_mktsegment || '|a: b' as found from customer join nation on c_nationkey = n_nationkey")
def json_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = _sql(spark, d, f"select c_custkey as id, {_JSON} as j from {{customer}} join {{nation}} on c_nationkey = n_nationkey")
    return rows.select("id", F.array_join(facts.json_strings(F.col("j")), "|").alias("found"))


def _traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces of a customer, as JSON or text."""
    return _sql(spark, d, """select c_custkey as id, c_name as name, c_mktsegment as flow, n_name, array(
      named_struct('source', 'tool:get_calendar', 'gathered_at', '2026-01-02T10', 'from_workflow', c_mktsegment, 'data', '{{"free_slots": ["Mon 9", "Tue 8", "Wed 7"], "busy_slots": []}}'),
      named_struct('source', 'tool:get_location', 'gathered_at', '2026-01-03', 'from_workflow', c_mktsegment, 'data', n_name),
      named_struct('source', 'tool:book_appointment', 'gathered_at', '2026-01-04', 'from_workflow', c_mktsegment, 'data', '{{"booked_at": "' || c_name || '", "appointment_date": "May 1"}}'),
      named_struct('source', 'backstory', 'gathered_at', '2026-01-05', 'from_workflow', c_mktsegment, 'data', '{{"task": "teeth", "result": "' || repeat(n_name || ' ', 40) || '"}}'),
      named_struct('source', 'tool:search', 'gathered_at', '2026-01-06', 'from_workflow', c_mktsegment, 'data', '["' || n_name || '", "b", "c"]')) as traces
      from {customer} join {nation} on c_nationkey = n_nationkey""")


@query("""select c_custkey as id, '- Calendar: free on Mon 9, Tue 8' || chr(10) || '- Location recorded: ' || n_name || ' (task: "' || c_mktsegment || '")' || chr(10) || '- Booked "' || c_name || '" for task: "' || c_mktsegment || '"' || chr(10)
 || '- Prior visit (teeth): ' || substring(repeat(n_name || ' ', 40), 1, 150) || chr(10) || '- Past data from "' || c_mktsegment || '": ' || n_name || chr(10) || '- Past data from "' || c_mktsegment || '": b' as log from customer join nation on c_nationkey = n_nationkey""")
def activity_log(spark: SparkSession, d: str) -> DataFrame:
    return _traces(spark, d).select("id", F.array_join(payload.activity(F.col("traces")), "\n").alias("log"))


@query("""select c_custkey as id, 'Task: help' || chr(10) || chr(10) || '[Source: user_profile]' || chr(10) || '  name: ' || c_name || chr(10) || chr(10) || '[Source: memory_traces  (residual context from prior workflows)]' || chr(10)
 || '  [calendar | from: "' || c_mktsegment || '" | 2026-01-02]' || chr(10) || '    availability: Mon 9, Tue 8, Wed 7' || chr(10) || '    busy:         none' || chr(10) || chr(10)
 || '  [location | from: "' || c_mktsegment || '" | 2026-01-03]' || chr(10) || '    ' || n_name || chr(10) || chr(10)
 || '  [past booking | from: "' || c_mktsegment || '" | 2026-01-04]' || chr(10) || '    booked_at: ' || c_name || '  date: May 1' || chr(10) || chr(10)
 || '  [backstory | from: "' || c_mktsegment || '" | 2026-01-05]' || chr(10) || '    task: teeth' || chr(10) || '    result: ' || repeat(n_name || ' ', 40) || chr(10) || chr(10)
 || '  [tool:search | from: "' || c_mktsegment || '" | 2026-01-06]' || chr(10) || '    - ' || n_name || chr(10) || '    - b' || chr(10) || '    - c' || chr(10) as v from customer join nation on c_nationkey = n_nationkey""")
def enrich_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _traces(spark, d).select("id", payload.enriched(F.lit("help"), {"name": F.col("name")}, F.col("traces")).alias("v"))


@query("select id, name || ' at ' || address || ' is looking for help — Book a dinner table. User is free on: ' || day || '. Insurance: ' || insurance || '.' || chr(10) || 'Patient context: Age: ' || age || ', Insurance ID: ' || phone || '.' as v from {PAYLOADS}")
def naive_payload(spark: SparkSession, d: str) -> DataFrame:
    own = {k: F.col(k) for k in ("name", "address", "age", "insurance")} | {"insurance_id": F.col("phone")}
    return payloads(spark, d).select("id", payload.naive_payload(F.col("task"), own, F.concat(F.lit("User is free on: "), "day"))["query"].alias("v"))


@query("""with s as (select l_returnflag as method, ['name', 'dob', 'insurance_id', 'address', 'age', 'insurance', 'condition'][l_linenumber] as field, case when l_quantity / 50 <= 0.25 then 0.0 when l_quantity / 50 < 0.75 then 0.5 else 1.0 end as s from lineitem),
 f as (select method, field, round(avg(s), 4) as m from s group by all), p as (pivot f on field in ('name', 'dob', 'insurance_id', 'address', 'age', 'insurance', 'condition') using max(m) group by method)
 select method, name, dob, insurance_id, address, age, insurance, condition, round((name + dob + insurance_id + address + age + insurance + condition) / 7, 4) as mean,
 round((name + dob + insurance_id) / 3, 4) as direct_ids_mean, round((address + age + insurance) / 3, 4) as profile_mean, round(condition, 4) as task_mean from p""")
def ris_groups(spark: SparkSession, d: str) -> DataFrame:
    fields = F.array(*(F.lit(f) for fs in c.ATTACKED.values() for f in fs))
    return facts.inference_scores(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.element_at(fields, F.col("l_linenumber")).alias("field"), (F.col("l_quantity") / 50).alias("score")))


@query("select id, method, cast(n as int) as chars, case when method = 'short' then (1 - n / length(payload)) * 100 end as saved_pct from (select id, payload, method, case when method = 'naive' then length(payload) else length(name) end as n from {PAYLOADS}, (values ('naive'), ('short')) v(method))")
def char_reduction(spark: SparkSession, d: str) -> DataFrame:
    both = F.array(F.struct(F.lit("naive").alias("method"), F.col("payload").alias("sanitized")), F.struct(F.lit("short").alias("method"), F.col("name").alias("sanitized")))
    return facts.characters_saved(payloads(spark, d).select("id", F.inline(both)), "id").select("id", "method", "chars", "saved_pct")


@query("select id, round((case when id % 2 = 0 then 1 else 0 end + 1) / 3, 4) as lratio_prof, round(case when id % 5 = 0 then 1 else 0 end / 2, 4) as lratio_hist, cast(1 as int) as rlr from {PAYLOADS}")
def source_ratios(spark: SparkSession, d: str) -> DataFrame:
    some = lambda k, x: F.when(F.col("id") % k == 0, x).otherwise("no such fact")
    p = payloads(spark, d).withColumns({"sanitized": F.col("payload"), "prof": F.array(F.col("phone"), some(2, F.col("address")), F.lit("zebra crossing")), "hist": F.array(some(5, F.lit("quiet table")), F.lit("old ruin"))})
    p = p.withColumns({"cur": F.array("day"), "res": facts.ordered_union(F.col("prof"), F.col("hist"))})
    return governor.scored(p, "cur", "res", profile="prof", history="hist", digits=4).select("id", "lratio_prof", "lratio_hist", "rlr")


@query("select s_suppkey as id, case s_suppkey % 3 when 0 then s_name || '|two' when 1 then 'one ' || s_name else '' end as found from supplier")
def variants_parse(spark: SparkSession, d: str) -> DataFrame:
    a = _sql(spark, d, """select s_suppkey as id, case s_suppkey % 3 when 0 then '```json' || chr(10) || '["' || s_name || '", "two"]' || chr(10) || '```' when 1 then 'Sure:' || chr(10) || '1. "one ' || s_name || '"' else 'no' end as a from {supplier}""")
    return a.select("id", F.array_join(generate.listed_variants(F.col("a")), "|").alias("found"))


@query("select 'seed_' || lpad(cast(i as varchar), 4, '0') as seed_id, count(*) as variants, 3::bigint as prompts from range(100) t(i), range(3) v(k) group by 1")
def dataset_numbering(spark: SparkSession, d: str) -> DataFrame:
    return generate.dataset(generate.seeds(_domains(spark, d), 4), 3).groupBy("seed_id").agg(F.count(F.lit(1)).alias("variants"), F.countDistinct("prompt").alias("prompts"))


_PROVIDERS = """(values ('medical', 1.0, 'http://localhost:8000/medical/rochester-general'), ('medical', 1.5, 'http://localhost:8000/medical/elmwood-family'), ('medical', 2.0, 'http://localhost:8000/medical/highland'), ('dental', 0.8, 'http://localhost:8000/dental/bright-smile'), ('dental', 1.2, 'http://localhost:8000/dental/rochester-dental'), ('dental', 2.5, 'http://localhost:8000/dental/lakeview'), ('restaurant', 1.1, 'http://localhost:8000/restaurant/tonys'), ('garage', 1.8, 'http://localhost:8000/garage/quicklube')) v(category, distance_miles, url)"""


@query(f"select id, category, count(*) as n, max(distance_miles)::double as far, min(url) as first from {_PROVIDERS} join (select s_suppkey as id, case s_suppkey % 4 when 0 then 'medical' when 1 then 'dental' when 2 then 'restaurant' else 'garage' end as category from supplier) using (category) group by all")
def static_providers(spark: SparkSession, d: str) -> DataFrame:
    asked = _sql(spark, d, "select s_suppkey as id, case s_suppkey % 4 when 0 then 'medical' when 1 then 'dental' when 2 then 'restaurant' else 'garage' end as category from {supplier}")
    return asked.join(state.providers(spark), "category").groupBy("id", "category").agg(F.count(F.lit(1)).alias("n"), F.max("distance_miles").alias("far"), F.min("url").alias("first"))


@query("select s_suppkey as id, 'KEEP|DROP|' || case when s_suppkey % 2 = 0 then 'KEEP' else 'DROP' end as said, case when s_suppkey % 2 = 0 then 'b|a' else 'none' end as told from supplier")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    a = _sql(spark, d, "select s_suppkey as id, '1. KEEP' || chr(10) || '2) drop' || chr(10) || '3: ' || case when s_suppkey % 2 = 0 then 'keep' else 'Drop' end as a, case when s_suppkey % 2 = 0 then '2. a' || chr(10) || '1) b' else '1. b' end as b from {supplier}")
    kept = F.transform(carryover.parsed_decisions(F.col("a"), F.lit(3)), lambda x: F.when(x, "KEEP").otherwise("DROP"))
    return a.select("id", F.array_join(kept, "|").alias("said"), F.coalesce(F.array_join(abstraction.numbered_answers(F.col("b"), F.lit(2)), "|"), F.lit("none")).alias("told"))


@query("select id, level as l, case when id % 3 = 0 and level = 0 then 'failed:not age-like' when level = 1 then 'failed:empty output' else 'passed' end as v from {PAYLOADS}, (values (0), (1), (2)) v(level)")
def validation(spark: SparkSession, d: str) -> DataFrame:
    p = payloads(spark, d).select("id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("l"))
    text = F.when(F.col("l") == 1, " x").when((F.col("id") % 3 == 0) & (F.col("l") == 0), "a red street").otherwise("an adult in their 70s")
    return p.select("id", "l", abstraction.validate(F.lit("age"), text).alias("v"))


# ── Recognition and models ───────────────────────────────────────────────────

_ENTITIES = """p_partkey as id, 'Please ask Dr. Adams near Boston about chronic knee pain at Mercy Hospital ' || case when p_partkey % 2 = 0 then 'tomorrow' else 'this evening' end || ' for ' || cast(p_partkey % 90 + 10 as string) || ' dollars.' as t"""
_FOUND_IN = "(values ('Dr. Adams', 'person'), ('Boston', 'location'), ('chronic knee pain', 'noun_phrase'), ('Mercy Hospital', 'facility'), ('day', ''), ('money', 'money')) v(k, kind)"


@query(f"""select id, case k when 'day' then case when id % 2 = 0 then 'date' else 'time' end else kind end as span_type, w as text, cast(strpos(t, w) - 1 as int) as start_at
 from (select id, t, k, kind, case k when 'day' then case when id % 2 = 0 then 'tomorrow' else 'this evening' end when 'money' then (id % 90 + 10) || ' dollars' else k end as w from (select {_ENTITIES} from part), {_FOUND_IN})""")
def recognized(spark: SparkSession, d: str) -> DataFrame:
    t = _sql(spark, d, f"select {_ENTITIES} from {{part}}")
    s = spans.records(t, "id", spans=spans.recognized_spans(F.col("t"), recognizers.default_recognizer))
    return s.select("id", "span_type", "text", F.col("start").alias("start_at"))


def _keeper():
    """A stand-in for a local model: keeps what is no sum of money, words items in numbered lines."""

    def one(p: str) -> str:
        items = [x for x in p.split("\n") if x[:1].isdigit()]
        if "KEEP or DROP" in p:
            return "\n".join(f"{i}. {'DROP' if '(money)' in x else 'KEEP'}" for i, x in enumerate(items, 1))
        return "\n".join(f"{i}. some {x.split(' by: ')[1]}" for i, x in enumerate(items, 1)) if items else "a thing"

    return lambda ps: [one(p) for p in ps]


_MODEL = "s_suppkey as id, 'book a table' as task, 'I am 30 years old and want vegan food on March ' || cast(s_suppkey % 28 + 1 as string) || ' under $' || cast(s_suppkey % 90 + 100 as string) || '. Please reserve seats for 4 people.' as payload"


@query("select s_suppkey as id, 'KEEP:age:rule|KEEP:date:verbatim|DROP:money|KEEP:party_size:llm' as trace from supplier")
def model_governor(spark: SparkSession, d: str) -> DataFrame:
    s = governor.sanitize_with_model(_sql(spark, d, f"select {_MODEL} from {{supplier}}"), _keeper)
    methods = F.map_from_arrays(F.transform("abstractions", lambda a: a["span"]["start"]), F.transform("abstractions", lambda a: a["method"]))
    said = s.withColumn("_m", methods).select("id", F.transform("decisions", lambda x: F.when(x["kept"], F.concat(F.lit("KEEP:"), x["span"]["span_type"], F.lit(":"), F.col("_m")[x["span"]["start"]])).otherwise(F.concat(F.lit("DROP:"), x["span"]["span_type"]))).alias("t"))
    return said.select("id", F.array_join("t", "|").alias("trace"))


def _echo(n: int):
    return lambda: lambda ps: [" ".join(p.split()[:n]) for p in ps]


@query("select method, provider, count(*) as n, avg(words)::double as in_tokens, avg(least(words, k))::double as out_tokens from (select method, provider, k, case method when 'naive' then len(string_split(payload, ' ')) else 2 end as words from {PAYLOADS}, (values ('naive'), ('short')) m(method), (values ('big', 9), ('small', 1)) p(provider, k)) group by all")
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    both = F.array(F.struct(F.lit("naive").alias("method"), F.col("payload").alias("sanitized")), F.struct(F.lit("short").alias("method"), F.lit("two words").alias("sanitized")))
    rows = governor.compared(payloads(spark, d).select("id", F.inline(both)), {"big": _echo(9), "small": _echo(1)})
    return rows.groupBy("method", "provider").agg(F.count(F.lit(1)).alias("n"), F.avg("in_tokens").alias("in_tokens"), F.avg("out_tokens").alias("out_tokens"))


def _attacker():
    """Guesses a name where the text says one; says nothing readable otherwise."""

    def one(p: str) -> str:
        name = p.rsplit("I am ", 1)
        return 'Sure: {"name": "' + name[1].rstrip(".") + '"}' if len(name) == 2 else "can't tell"

    return lambda ps: [one(p) for p in ps]


def _judge():
    """1 for an equal name, else 0; half a point for each age, whatever the guess."""
    import json

    def one(p: str) -> str:
        truth, guess = (json.loads(line.split(": ", 1)[1]) for line in p.split("\n")[1:3])
        return json.dumps({"name": float(truth["name"] == guess.get("name")), "age": 0.4})

    return lambda ps: [one(p) for p in ps]


@query("select s_suppkey as id, field, case when field = 'name' and s_suppkey % 2 = 0 then s_name else 'unknown' end as guess, case when field = 'age' then 0.4 when s_suppkey % 2 = 0 then 1.0 else 0.0 end::double as score from supplier, (values ('name'), ('age')) v(field)")
def inference_attack(spark: SparkSession, d: str) -> DataFrame:
    rows = _sql(spark, d, "select s_suppkey as id, s_name as name, case when s_suppkey % 2 = 0 then 'I am ' || s_name || '.' else 'Book a table.' end as sanitized from {supplier}")
    return governor.inference_attack(rows, {"name": F.col("name"), "age": F.lit(30)}, _attacker, _judge).select("id", "field", "guess", "score")


from veilframe import queries_time as queries_time  # noqa: E402  registers its queries here
from veilframe import queries_tagger as queries_tagger  # noqa: E402
from veilframe import queries_runs as queries_runs  # noqa: E402
