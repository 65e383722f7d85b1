"""Fact sets and the leakage and utility metrics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe import constants as c
from veilframe.operators import leakscan


def weight(field: Column) -> Column:
    """Tier weight of a profile field."""
    f = F.lower(field)
    return F.when(f.isin(*c.DIRECT_FIELDS), 1.0).when(f.isin(*c.TIER2_FIELDS), 0.6).otherwise(0.3)


def profile_facts(profile: Column) -> Column:
    """array<struct<fact, weight>> of a map of profile fields; values below three characters are no facts."""
    return F.transform(F.filter(F.map_entries(profile), lambda e: F.length(F.trim(e["value"])) >= 3), lambda e: F.struct(F.trim(e["value"]).alias("fact"), weight(e["key"]).alias("weight")))


def trace_facts(*parts: Column) -> Column:
    """Distinct strings of three characters or more of a trace's fields, first seen first."""
    return F.array_distinct(F.filter(F.transform(F.concat(*parts), lambda x: F.trim(x)), lambda x: F.length(x) >= 3))


def json_strings(text: Column) -> Column:
    """Every string value of a JSON text, at any depth and in its order: trimmed, three characters or more; null where it
    does not parse. Keys are the string literals that a colon follows."""
    literal = r'"(?:[^"\\]|\\.)*+"(?:\s*+:)?+'
    values = F.filter(F.regexp_extract_all(text, F.lit(literal), F.lit(0)), lambda x: ~F.endswith(x, F.lit(":")))
    found = F.transform(values, lambda x: F.trim(F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), 0)))
    return F.when(F.try_parse_json(text).isNotNull(), F.filter(found, lambda x: F.length(x) >= 3))


def ordered_union(*parts: Column) -> Column:
    """Facts of several lists, each once, first seen first."""
    return F.array_distinct(F.concat(*(F.coalesce(p, F.expr("cast(array() as array<string>)")) for p in parts)))


def leaking(payload: Column, facts: Column) -> Column:
    """Facts of three characters or more that the payload holds, whatever the case."""
    low = F.lower(payload)
    return F.transform(F.array(low), lambda p: F.filter(facts, lambda f: (F.length(f) >= 3) & F.contains(p, F.lower(f))))[0]


def leaks(payloads: DataFrame, facts: DataFrame, text: str, fact: str, few: int = 2_000) -> DataFrame:
    """Pairs of a payload and a fact in it, for fact tables of any size; both tables' columns.

    At most `few` facts of 1,000 characters are broadcast (2 MB, checked) and looked for one by one; more of them are the
    business of automata (`leakscan`)."""
    f = facts.withColumn("_f", F.lower(fact)).filter(F.length("_f") >= 3)
    size = f.agg(F.count(F.lit(1)), F.max(F.length("_f"))).first()
    if size[0] <= few and (size[1] or 0) <= 1_000:
        return payloads.withColumn("_p", F.lower(text)).join(F.broadcast(f), F.contains("_p", F.col("_f"))).drop("_p", "_f")
    return leakscan.leaks(payloads, facts, text, fact)


def ratio(leaked: Column, facts: Column, empty: float | None = None) -> Column:
    return F.when(F.size(facts) > 0, F.size(leaked) / F.size(facts)).otherwise(F.lit(empty).cast("double"))


def injection(payload: Column, request: Column, residual: Column) -> Column:
    """Share of residual facts that the payload holds though the request does not."""
    return ratio(F.array_except(leaking(payload, residual), leaking(request, residual)), residual)


def weighted(payload: Column, facts: Column) -> Column:
    """Weight of leaked facts over that of all; facts are array<struct<fact, weight>>."""
    low = F.lower(payload)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["weight"])
    hit = F.filter(facts, lambda f: (F.length(f["fact"]) >= 3) & F.contains(low, F.lower(f["fact"])))
    return F.when(F.size(facts) > 0, total(hit) / total(facts))


def tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def reduction(naive: Column, payload: Column) -> Column:
    n = tokens(naive)
    return F.when(n > 0, (n - tokens(payload)) / n)


def candidates(answer: Column) -> Column:
    """Lower-cased names of an answer's numbered, perhaps bold lines."""
    p = r"^\*{0,2}\d+[.)]\s+\*{0,2}(.+?)\*{0,2}\s*$"
    names = F.transform(F.split(answer, "\n"), lambda x: F.regexp_extract(F.trim(x), p, 1))
    bare = F.transform(names, lambda x: F.lower(F.regexp_replace(x, "^[ :-]+|[ :-]+$", "")))
    return F.filter(bare, lambda x: x != "")


def matched(naive: Column, method: Column) -> Column:
    """Naive names that a method's names match by their first ten characters, either way."""
    head = lambda x: F.substr(x, F.lit(1), F.lit(10))
    return F.size(F.filter(naive, lambda n: (F.trim(head(n)) != "") & F.exists(method, lambda m: F.contains(m, F.trim(head(n))) | F.contains(n, head(m)))))


def retention(calls: DataFrame, keys: tuple[str, ...] = ("task", "provider", "call")) -> DataFrame:
    """task, method, provider, urr: mean share of naive candidates kept over paired calls. calls has method and candidates."""
    naive = calls.filter("method = 'naive'").select(*keys, F.col("candidates").alias("own")).filter("size(own) > 0")
    pairs = calls.join(naive, list(keys))
    one = F.when(F.col("method") == "naive", 1.0).otherwise(matched(F.col("own"), F.col("candidates")) / F.size("own"))
    return pairs.groupBy("task", "method", "provider").agg(F.avg(one).alias("urr"))


def majority(votes: DataFrame, *keys: str) -> DataFrame:
    """1 where a strict majority of the votes that were given is positive; without any, 1."""
    n, yes = F.count("vote"), F.sum(F.col("vote").cast("int"))
    return votes.groupBy(*keys).agg(F.when(n == 0, 1).when(yes * 2 > n, 1).otherwise(0).alias("tsr"))


def snapped(score: Column) -> Column:
    """A score cut to [0, 1] and set to the nearest of 0, 0.5 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(score * 2) / 2))


def conditions(text: Column, keywords: Column) -> Column:
    """Keywords in a text that are not part of a longer one found."""
    found = F.filter(keywords, lambda k: F.contains(F.lower(text), F.lower(k)))
    return F.filter(found, lambda k: ~F.exists(found, lambda o: (F.length(o) > F.length(k)) & F.contains(F.lower(o), F.lower(k))))


def json_object(answer: Column, schema: str) -> Column:
    """The object between an answer's first and last brace."""
    return F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), schema)


def means(results: DataFrame, metrics: list[str], *keys: str, digits: int | None = None) -> DataFrame:
    """Mean of each metric over the rows that have it, rounded to `digits` where given."""
    shown = lambda x: x if digits is None else F.round(x, digits)
    return results.groupBy(*keys).agg(*(shown(F.avg(m)).alias(m) for m in metrics))


def characters_saved(rows: DataFrame, *keys: str, text: str = "sanitized") -> DataFrame:
    """rows (one a key and method) with chars and saved_pct: what a method's text is shorter than the naive one, in percent."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    naive = rows.filter("method = 'naive'").select(*keys, n.alias("_naive"))
    out = rows.withColumn("chars", n).join(naive, list(keys), "left")
    return out.withColumn("saved_pct", F.when((F.col("method") != "naive") & (F.col("_naive") > 0), (1 - F.col("chars") / F.col("_naive")) * 100)).drop("_naive")


def ground_truth(profile: dict[str, Column], condition: Column) -> Column:
    """map of attacked field to its true value, 'unknown' where there is none."""
    truth = {f: condition if f == "condition" else profile.get(f, F.lit(None)) for fs in c.ATTACKED.values() for f in fs}
    return F.create_map(*(x for f, v in truth.items() for x in (F.lit(f), F.coalesce(v.cast("string"), F.lit("unknown")))))


def inference_scores(scores: DataFrame, digits: int = 4) -> DataFrame:
    """method, a column for each attacked field with its mean score, their mean, and the means of the groups' fields.

    scores has method, field and score (not snapped yet)."""
    fields = [f for fs in c.ATTACKED.values() for f in fs]
    own = scores.groupBy("method").pivot("field", fields).agg(F.round(F.avg(snapped(F.coalesce(F.col("score"), F.lit(0.0)))), digits))

    def mean(names: tuple[str, ...] | list[str]) -> Column:
        some = F.filter(F.array(*map(F.col, names)), lambda x: x.isNotNull())
        return F.when(F.size(some) > 0, F.round(F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some), digits))

    groups = [mean(fs).alias(g.replace(" ", "_").lower() + "_mean") for g, fs in c.ATTACKED.items()]
    return own.select("method", *fields, mean(fields).alias("mean"), *groups)


def provider_means(results: DataFrame, metric: str) -> DataFrame:
    """method, metric: the unweighted mean of the providers' means."""
    return results.groupBy("method", "provider").agg(F.avg(metric).alias("_m")).groupBy("method").agg(F.avg("_m").alias(metric))


def ablation(df: DataFrame, sizes: tuple[int, ...], history_col: str, payload: str) -> DataFrame:
    """A row for each size of history: the leak ratio over its first facts, and how many leaked."""
    h = df.withColumn("backstory_size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("_h", F.slice(history_col, F.lit(1), F.col("backstory_size")))
    return h.withColumn("leaked_hist", leaking(F.col(payload), F.col("_h"))).withColumn("hist_ls", ratio(F.col("leaked_hist"), F.col("_h"), 0.0)).withColumn("abs_leak", F.size("leaked_hist")).drop("_h")


def stage_shares(timing: DataFrame) -> DataFrame:
    """Mean seconds of each stage by model and the later stages' share of the total, in percent."""
    m = timing.groupBy("model").agg(*(F.avg(s).alias(s) for s in ("stage1_s", "stage2_s", "stage3b_s", "total_s")))
    return m.withColumns({"s2_pct": 100 * F.col("stage2_s") / F.col("total_s"), "s3b_pct": 100 * F.col("stage3b_s") / F.col("total_s")})


def first_per_seed(tasks: DataFrame, seed: str, position: str) -> DataFrame:
    w = Window.partitionBy(seed).orderBy(position)
    return tasks.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def first_tasks(tasks: DataFrame, seed: str, position: str, n: int, offset: int = 0) -> DataFrame:
    """The first task of each seed, and of these n in order of position after the first `offset`."""
    return first_per_seed(tasks, seed, position).orderBy(position, seed).offset(offset).limit(n)


def costs(results: DataFrame, *keys: str, provider: str = "provider", latency: str = "latency_s", tokens: str = "token_count", answer: str = "out_tokens") -> DataFrame:
    """keys, avg_latency_s, avg_token_count, avg_clm_tokens (a map by provider), n_answers, of rows by task, key and provider.
    Nulls are left out of the means; a provider without any figure has a null one. Null providers have no entry."""
    parts = [x for m in (latency, tokens) for x in (F.sum(m).alias(f"_s_{m}"), F.count(m).alias(f"_n_{m}"))]
    each = results.groupBy(*keys, provider).agg(F.avg(answer).alias("_a"), F.count(F.lit(1)).alias("_n"), *parts)
    mean = lambda m: F.try_divide(F.sum(f"_s_{m}"), F.sum(f"_n_{m}"))
    entries = F.collect_list(F.when(F.col(provider).isNotNull(), F.struct(provider, "_a")))
    return each.groupBy(*keys).agg(mean(latency).alias("avg_latency_s"), mean(tokens).alias("avg_token_count"), F.map_from_entries(entries).alias("avg_clm_tokens"), F.sum("_n").alias("n_answers"))


def coverage(prompt: Column, items: Column) -> Column:
    """array<struct<item, covered>>."""
    return F.transform(items, lambda x: F.struct(x.alias("item"), F.contains(F.lower(prompt), F.lower(x)).alias("covered")))


def rollups(results: DataFrame, dims: list[str], metrics: list[str]) -> DataFrame:
    """Means of the metrics, those that are null left out, for every combination of the dims: dims, level (a bit for each dim
    that is taken together, the first one the highest), n and, for each metric, its mean and n_<metric>."""
    rows = results.select(*dims, *metrics).cube(*dims)
    each = [x for m in metrics for x in (F.avg(m).alias(m), F.count(m).alias(f"n_{m}"))]
    return rows.agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"), *each)


def distinct_sketches(rows: DataFrame, by: list[str], value: str, lg_k: int = 12) -> DataFrame:
    """by, sketch: a HyperLogLog sketch of the distinct values of each group, 2**lg_k registers, to be stored and merged later.
    The relative standard error of an estimate is about 1.04 / sqrt(2**lg_k)."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"))


def merged_counts(sketches: DataFrame, by: list[str], name: str = "n_distinct") -> DataFrame:
    """by, name: estimates for the union of stored sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))
