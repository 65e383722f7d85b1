"""Queries over runs and their reports: agent runs, timings and costs, merged state, summaries, backstory, bookings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import constants as c
from veilframe.operators import facts, generate, payload
from veilframe.plans import governor
from veilframe.queries import _domains, _profile, payloads, query
from veilframe.session import table
from veilframe.sources import state


@query("""select id, 'naive' as mode, 'restaurant' as category, name || ' at ' || address || ' is looking for help — Book a dinner table. User is free on: ' || day || '. Insurance: ' || insurance || '.' || chr(10) || 'Patient context: Age: ' || age || ', Insurance ID: ' || phone || '.' as outbound from {PAYLOADS}""")
def agent_run(spark: SparkSession, d: str) -> DataFrame:
    own = {k: F.col(k) for k in ("name", "address", "age", "insurance")} | {"insurance_id": F.col("phone")}
    rows = payloads(spark, d).withColumnRenamed("payload", "_given")
    return governor.run_agent(rows, "naive", profile=own, availability=F.concat(F.lit("User is free on: "), "day")).select("id", "mode", "category", "outbound")


@query("select 'rules' as model, count(*) as n, true as timed, true as shares from {PAYLOADS}")
def stage_timings(spark: SparkSession, d: str) -> DataFrame:
    """Timings themselves differ by run: that each stage took time, and that the shares of the later ones are some of 100."""
    t = governor.stage_timings(payloads(spark, d), profile=_profile())
    s = t.join(facts.stage_shares(t).select("model", "s2_pct", "s3b_pct"), "model")
    return s.select("model", "n", ((F.col("stage1_s") > 0) & (F.col("stage2_s") > 0) & (F.col("stage3b_s") > 0)).alias("timed"), (F.col("s2_pct") + F.col("s3b_pct")).between(0, 100).alias("shares"))


_STAGES = "l_returnflag as model, l_quantity as stage1_s, l_linenumber::double as stage2_s, l_suppkey::double as stage3b_s, l_quantity + l_linenumber + l_suppkey as total_s"


@query(f"select model, avg(stage1_s) as stage1_s, avg(stage2_s) as stage2_s, avg(stage3b_s) as stage3b_s, avg(total_s) as total_s, 100 * avg(stage2_s) / avg(total_s) as s2_pct, 100 * avg(stage3b_s) / avg(total_s) as s3b_pct from (select {_STAGES} from lineitem) group by model")
def stage_shares(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("stage1_s"), F.col("l_linenumber").cast("double").alias("stage2_s"), F.col("l_suppkey").cast("double").alias("stage3b_s"))
    return facts.stage_shares(t.withColumn("total_s", F.col("stage1_s") + F.col("stage2_s") + F.col("stage3b_s")))


@query("""select l_returnflag as method, avg(case when l_linenumber > 1 then l_quantity end) as avg_latency_s, avg(l_partkey) as avg_token_count,
 avg(case when l_linestatus = 'O' then l_suppkey end) as clm_o, avg(case when l_linestatus = 'F' then l_suppkey end) as clm_f, count(*) as n_answers from lineitem group by 1""")
def method_costs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("provider"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("latency_s"),
        F.col("l_partkey").alias("token_count"), F.col("l_suppkey").alias("out_tokens"),
    )
    got = facts.costs(t, "method")
    by = lambda p: F.try_element_at("avg_clm_tokens", F.lit(p))
    return got.select("method", "avg_latency_s", "avg_token_count", by("O").alias("clm_o"), by("F").alias("clm_f"), "n_answers")


@query("""select coalesce(e.user_id, c_custkey) as user_id, event_id, c_name as name, case when c_custkey is null then 0 else 1 end as n_contacts
 from events e full join customer on c_custkey = e.user_id""")
def merged_state(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("contacts"))
    back, run = (table(spark, d, "events").select("user_id", "event_id").filter(F.col("event_type") == "error" if b else F.col("event_type") != "error") for b in (True, False))
    got = state.merged(own, state.traces(back, run), "user_id")
    return got.select("user_id", "event_id", F.col("user_profile.name").alias("name"), F.size("contacts").alias("n_contacts"))


@query("""select id, payload as naive, 'two words' as short, 'big:' || phone as naive_big, 'small:' || phone as short_small from {PAYLOADS}""")
def task_summaries(spark: SparkSession, d: str) -> DataFrame:
    both = F.array(*(F.struct(F.lit(m).alias("method"), t.alias("sanitized")) for m, t in (("naive", F.col("payload")), ("short", F.lit("two words")))))
    rows = payloads(spark, d).select("id", "phone", F.inline(both)).withColumn("provider", F.explode(F.array(F.lit("big"), F.lit("small"))))
    got = state.task_summaries(rows.withColumn("answer", F.concat_ws(":", "provider", "phone")), ["id"])
    return got.select("id", F.col("payloads")["naive"].alias("naive"), F.col("payloads")["short"].alias("short"), F.col("clm_responses")["naive"]["big"].alias("naive_big"), F.col("clm_responses")["short"]["small"].alias("short_small"))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) where r = 1 order by o_orderkey limit 40 offset 10")
def task_slice(spark: SparkSession, d: str) -> DataFrame:
    """The slice is the operator: 40 first tasks after the first ten."""
    return facts.first_tasks(table(spark, d, "orders"), "o_custkey", "o_orderkey", 40, 10).select("o_custkey", "o_orderkey")


@query("select n_name as domain, 12::bigint as seeds, 8::bigint as fell_back, 12::bigint as in_time, 12::bigint as told from nation")
def backstory_told(spark: SparkSession, d: str) -> DataFrame:
    """Narratives by a model's answers: of three seeds one is told, one blank and one null; the template stands in for those."""
    s = generate.seeds(_domains(spark, d), 12)
    kind = F.regexp_extract("seed_id", r"(\d+)$", 1).cast("int") % 3
    told = F.concat(F.lit("\nOnce they saw to "), F.array_join("domain_sensitive", ", "), F.lit(". "))
    got = generate.backstory(s.withColumn("k", kind), answer=F.when(kind == 0, told).when(kind == 1, " \n"))
    days = F.date_diff(F.to_date(F.lit("2025-11-01")), F.to_date("gathered_at"))
    fits = F.col("data.result") == F.when(F.col("fell_back"), F.concat(F.lit("Completed: "), F.replace("data.task", F.col("_kind"), F.concat(F.lit("a "), "_kind")))).otherwise(F.concat(F.lit("Once they saw to "), F.array_join("data.domain_sensitive", ", "), F.lit(".")))
    got = got.withColumn("_kind", F.concat(F.lit("service_type"), F.regexp_extract("data.task", r"service_type(.*)$", 1)))
    return got.groupBy(F.col("data.domain").alias("domain")).agg(F.count(F.lit(1)).alias("seeds"), F.count_if("fell_back").alias("fell_back"), F.count_if(days.between(30, 540)).alias("in_time"), F.count_if(fits).alias("told"))


_KEYS = ("ring", "small ring", "red", "widget", "red widget", "small")


@query(f"""with k as (select unnest([{', '.join(f"'{x}'" for x in _KEYS)}]) as v), f as (select p_partkey as id, v from part, k where contains(lower(p_name), v))
 select id, v from f a where not exists (select 1 from f b where b.id = a.id and length(b.v) > length(a.v) and contains(b.v, a.v))""")
def conditions_found(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(facts.conditions(F.col("p_name"), F.array(*map(F.lit, _KEYS)))).alias("v"))


@query("select p_partkey as id, item, contains(lower(p_name || ' ' || p_type), lower(item)) as covered from part, (select unnest(['Ring', 'red', 'ECONOMY', p_brand]) as item, p_partkey as k from part) where k = p_partkey")
def items_covered(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part")
    items = F.array(F.lit("Ring"), F.lit("red"), F.lit("ECONOMY"), F.col("p_brand"))
    return t.select(F.col("p_partkey").alias("id"), F.inline(facts.coverage(F.concat_ws(" ", "p_name", "p_type"), items)))


_CATEGORIES = tuple(c.FORM_FIELDS)
_FIELDS = ", ".join(f"({i}, '{k}', '{f}')" for i, k in enumerate(_CATEGORIES) for f, _ in c.FORM_FIELDS[k])


@query(f"select c_custkey as id, category, field, case field when 'name' then c_name when 'phone' then 'x' else '' end as value from customer join (values {_FIELDS}) v(i, category, field) on i = c_custkey % {len(_CATEGORIES)}")
def form_booked(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.element_at(F.array(*map(F.lit, _CATEGORIES)), (F.col("c_custkey") % len(_CATEGORIES) + 1).cast("int")).alias("category"))
    forms = t.select("id", "category").join(F.broadcast(payload.form_fields(spark)), "category")  # one row a field of a form
    sent = t.select("id", F.inline(F.array(F.struct(F.lit("name").alias("field"), F.col("c_name").alias("value")), F.struct(F.lit("phone").alias("field"), F.lit("x").alias("value")))))
    return payload.booked(forms, sent, "id").select("id", "category", "field", "value")
