"""Automata, conflicts, running history, as-of joins, sessions, cubes, sketches and streams against plain versions."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import conflicts, facts, leakscan, spans, timeline
from veilframe.streaming import history

T0 = dt.datetime(2026, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


# Leaks


@pytest.mark.parametrize("shard_bytes", [leakscan.SHARD_BYTES, 400])
def test_automata_equal_brute_force(spark, shard_bytes):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abAB é", k=rng.randrange(1, 5)))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(40))), "x") for i in range(60)] + [(60, None, "x"), (61, "", "x"), (62, "abA bAb", "x"), (62, "abA bAb", "x"), (63, "a" * 50_000, "x")]
    known = [(i, "".join(rng.choices("abAB é", k=rng.randrange(1, 7)))) for i in range(300)] + [(300, None), (301, ""), (302, "ABA"), (303, "aba"), (304, "ab")]
    d = spark.createDataFrame(docs, "i int, t string, k string").repartition(3)
    f = spark.createDataFrame(known, "n int, f string")
    want = collections.Counter((i, n) for i, t, _ in docs for n, x in known if t is not None and x and len(x) >= 3 and x.lower() in t.lower())
    out = leakscan.leaks(d, f, "t", "f", shard_bytes)
    assert out.columns == ["i", "t", "k", "n", "f"]
    assert collections.Counter((r.i, r.n) for r in out.collect()) == want and len(want) > 300
    assert leakscan.leaks(d, f.limit(0), "t", "f").count() == 0 == leakscan.leaks(d.limit(0), f, "t", "f", shard_bytes).count()


def test_leaks_take_either_way(spark):
    d = spark.createDataFrame([(1, "one two three four"), (2, None)], "i int, t string")
    f = spark.createDataFrame([(i, w) for i, w in enumerate(["Two", "three f", "no such", "x" * 2000])], "n int, f string")
    assert {(r.i, r.n) for r in facts.leaks(d, f, "t", "f").collect()} == {(1, 0), (1, 1)}


# Conflicts


def plain_conflicts(start, end, withheld):
    taken = []
    for i in sorted(range(len(start)), key=lambda i: (not withheld[i], start[i] - end[i], start[i], i)):
        if not any(start[i] < end[j] and end[i] > start[j] for j in taken):
            taken.append(i)
    return sorted(taken, key=lambda i: (start[i], i))


@pytest.mark.parametrize("n", [0, 1, 7, 300, 2500])
def test_disjoint_intervals(n):
    rng = random.Random(n)
    for most in (1, 9, 200):
        start = [rng.randrange(n * 3 + 1) for _ in range(n)]
        end, held = [x + rng.randrange(most) for x in start], [rng.random() < 0.2 for _ in start]
        assert conflicts.accepted(start, end, held) == plain_conflicts(start, end, held)


def test_few_and_many_spans_alike(spark):
    rng = random.Random(3)

    def row(n):
        out = []
        for _ in range(n):
            s = rng.randrange(4 * n)
            out.append((rng.choice(["a", "A", "b"]), s, s + rng.randrange(1, 12), rng.choice("xy"), "s", rng.choice(["U_loc", "U_med"]), "t"))
        return out + out[: n // 3]  # exact copies

    df = spark.createDataFrame([(i, row(n)) for i, n in enumerate([0, 1, 5, 40, 90, 150])] + [(9, None)], f"i int, s {spans.SPANS}")
    few, many, both = ({r.i: r.s for r in df.select("i", spans.resolve(F.col("s"), k).alias("s")).collect()} for k in (10_000, -1, 64))
    assert few == many == both and few[9] is None and 0 < len(few[5]) < 150


def test_very_many_spans_in_one_text(spark):
    n = 100_000
    span = f"transform(sequence(1, {n}), i -> named_struct('text', 'T', 'start', cast(pmod(hash(i), 900000) as int), 'end', cast(pmod(hash(i), 900000) + 1 + i % 30 as int), 'span_type', 'x', 'source', 's', 'bucket', if(i % 7 = 0, 'U_loc', 'U_med'), 'subsource', 'y'))"
    out = spark.range(1).select(F.expr(span).alias("s")).select(spans.resolve(F.col("s")).alias("s")).first().s
    assert len(out) > n / 4 and all(a.end <= b.start for a, b in zip(out, out[1:]))


@pytest.mark.parametrize("n", [0, 1, 5, 64, 65, 128, 200])
def test_filled_in_blocks(spark, n):
    rng, text, at, rows, want = random.Random(n), [], 0, [], []
    for i in range(n):
        gap, body = "é" * rng.randrange(4), "日x" * rng.randrange(1, 3)
        rows.append((body, at + len(gap), at + len(gap) + len(body), f"k{i}", "s", "b", "t"))
        text += [gap, body]
        want += [gap, f"<k{i}>"]
        at += len(gap) + len(body)
    df = spark.createDataFrame([("".join(text) + "end", rows)], f"t string, s {spans.SPANS}")
    for block in (64, 3):
        out = df.select(spans.filled(F.col("t"), F.col("s"), lambda s: F.concat(F.lit("<"), s["span_type"], F.lit(">")), block)).first()[0]
        assert out == "".join(want) + "end"


# History


def plain_history(rows):
    out = {}
    for i, (k, o, _) in enumerate(rows):
        before = {x for k2, o2, f in rows if k2 == k and o2 < o for x in f or () if x is not None}
        now = {x for k2, o2, f in rows if k2 == k and o2 == o for x in f or () if x is not None}
        out[i] = (len(before), frozenset(now - before))
    return out


def test_history_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 5 + ["u", "v", None]), rng.randrange(40), rng.choice([None, [], [None], rng.choices("abcdefghijkl", k=3)])) for _ in range(250)]
    df = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "i int, k string, o int, f array<string>, n_new int").repartition(5)
    got = {r.i: (r.n_before, frozenset(r.new_facts)) for r in timeline.history(df, "k", "o", "f").collect()}
    assert got == plain_history(rows)
    assert timeline.history(df.limit(0), "k", "o", "f").count() == 0
    first = timeline.history(spark.createDataFrame([("k", 1, ["b", "a", "b"])], "k string, o int, f array<string>"), "k", "o", "f").first()
    assert first.new_facts == ["b", "a"]


def test_history_of_a_hot_user(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("u").alias("k"), "id", F.array(F.expr("cast(id div 3 as string)"), F.lit("same")).alias("f"))
    out = timeline.history(df, "k", "id", "f")
    r = out.agg(F.sum("n_before").alias("s"), F.max("n_before").alias("m"), F.max(F.size("new_facts")).alias("w"), F.count(F.lit(1)).alias("n")).first()
    assert (r.n, r.m, r.w) == (n, n // 3 + 1 if n % 3 else n // 3 + 1, 2)
    assert r.s == sum((i + 2) // 3 + (i > 0) for i in range(n))


def test_leaked_history(spark):
    rows = spark.createDataFrame([("u", 1, ["a", "b"]), ("u", 2, ["a"]), ("v", 3, ["a"])], "k string, o int, f array<string>")
    pairs = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("v", 3, "a"), ("v", 4, None)], "k string, o int, fact string")
    assert {tuple(r) for r in timeline.leaked_history(pairs, timeline.first_seen(rows, "k", "o", "f"), "k", "o").collect()} == {("u", 2, "a"), ("u", 3, "b")}


# As of


def test_as_of_against_brute_force(spark):
    rng = random.Random(7)
    keys = ["hot"] * 6 + ["u", None]
    left = [(i, rng.choice(keys), rng.choice([None, *range(50)]), "kept") for i in range(150)]
    right = [(rng.choice(keys), rng.choice([None, *range(50)]), rng.choice([None, *range(9)])) for _ in range(120)]
    a = spark.createDataFrame(left, "i int, k string, o int, _side string").repartition(3)
    b = spark.createDataFrame(right, "k string, o int, v int").repartition(4)

    def want(k, o):
        best = [(x, v) for k2, x, v in right if k2 == k and v is not None and (x is None or (o is not None and x <= o))]
        return max(best, key=lambda t: (t[0] is not None, t[0] or 0, t[1]))[1] if best else None

    out = timeline.as_of(a, b, "k", "o", "v")
    assert out.columns == ["i", "k", "o", "_side", "v"]
    assert {r.i: r.v for r in out.collect()} == {i: want(k, o) for i, k, o, _ in left}


# Sessions


def plain_sessions(rows, gap):
    by, out = collections.defaultdict(list), []
    for u, t in rows:
        if u is not None and t is not None:
            by[u].append(t)
    for u, ts in by.items():
        ts.sort()
        some = [ts[0]]
        for t in [*ts[1:], None]:
            if t is None or t - some[-1] > gap:
                out.append((u, some[0], some[-1], len(some)))
                some = []
            some.append(t)
    return sorted(out)


def session_rows(n):
    rng = random.Random(9)
    rows = [(rng.choice(["hot"] * 5 + ["u", "v"]), at(rng.randrange(6000))) for _ in range(n)]
    return rows + rows[:20] + [("w", at(0)), ("w", at(30)), ("w", at(59)), (None, at(1)), ("w", None)]


def test_sessions_against_brute_force(spark):
    rows = session_rows(400)
    df = spark.createDataFrame(rows, "user string, at timestamp").repartition(6)
    got = sorted((r.user, r.session_start, r.session_end, r.n) for r in timeline.sessions(df, "user", "at").collect())
    assert got == plain_sessions(rows, dt.timedelta(minutes=30)) and len(got) > 40


def test_sessions_as_a_stream(spark, tmp_path):
    rows = session_rows(200)
    rows.sort(key=lambda r: r[1] or T0)
    schema = "user string, at timestamp"
    for part in (rows[:120], rows[120:], [("end", at(20_000))]):  # the last row moves the watermark past all others
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        s = history.sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "log")))
        history.drained(s, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("user", "session_start", "session_end", "n").collect())
    assert got == plain_sessions(rows, dt.timedelta(minutes=30))


# Streams with state


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Three runs, rows late and out of order between them: the least times are those of the batch."""
    rng = random.Random(11)
    rows = [(rng.choice(["hot"] * 5 + ["u", None]), rng.choice(["a", "b", "c", "d", None]), at(rng.randrange(900))) for _ in range(150)]
    schema, log = "user string, fact string, at timestamp", str(tmp_path / "log")
    for k in range(3):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(log)
        s = history.first_seen_exact(spark.readStream.schema(schema).parquet(log))
        history.drained(s, str(tmp_path / "out"), str(tmp_path / "state"), "update")
    told = spark.read.parquet(str(tmp_path / "out"))
    want = spark.createDataFrame(rows, schema).filter("fact is not null").groupBy("user", "fact").agg(F.min("at").alias("at"))
    assert {tuple(r) for r in told.groupBy("user", "fact").agg(F.min("at")).collect()} == {tuple(r) for r in want.collect()}
    first = told.filter("not earlier")
    assert first.count() == first.select("user", "fact").distinct().count() == want.count() < told.count()


def test_first_times_go_on_from_their_checkpoint(spark, tmp_path):
    """As above, without a Python step: state is merged in the JVM."""
    rng = random.Random(12)
    rows = [(rng.choice(["hot"] * 5 + ["u", None]), rng.choice(["a", "b", "c", "d", None]), rng.choice([at(rng.randrange(900)), None])) for _ in range(150)]
    schema, log = "user string, fact string, at timestamp", str(tmp_path / "log")
    for k in range(3):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(log)
        s = history.first_times(spark.readStream.schema(schema).parquet(log))
        assert "Pandas" not in s._jdf.queryExecution().analyzed().toString()
        history.drained(s, str(tmp_path / "out"), str(tmp_path / "state"), "update")
    told = spark.read.parquet(str(tmp_path / "out"))
    want = spark.createDataFrame(rows, schema).filter("fact is not null and at is not null").groupBy("user", "fact").agg(F.min("at").alias("at"))
    assert {tuple(r) for r in told.groupBy("user", "fact").agg(F.min("at")).collect()} == {tuple(r) for r in want.collect()}


# Cubes and sketches


def test_cube_leaves_out_nulls(spark):
    rows = [("m1", "d1", 1.0), ("m1", "d1", None), ("m1", "d2", 3.0), ("m2", "d1", None)]
    out = {(r.m, r.d, r.level): (r.n, r.x, r.n_x) for r in facts.rollups(spark.createDataFrame(rows, "m string, d string, x double"), ["m", "d"], ["x"]).collect()}
    assert out[None, None, 3] == (4, 2.0, 2) and out["m1", None, 1] == (3, 2.0, 2) and out["m2", None, 1] == (1, None, 0)
    assert out[None, "d1", 2] == (3, 1.0, 1) and out["m1", "d1", 0] == (2, 1.0, 1) and len(out) == 8


def test_stored_sketches_merge(spark, tmp_path):
    df = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("m"), (F.col("id") % 20_000).cast("string").alias("v"))
    df = df.unionByName(spark.createDataFrame([(1, 1, None)], "day long, m long, v string"))
    facts.distinct_sketches(df, ["day", "m"], "v").write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    for by in (["m"], ["day"], []):
        exact = {tuple(r)[:-1]: r.n for r in df.groupBy(*by).agg(F.count_distinct("v").alias("n")).collect()}
        got = {tuple(r)[:-1]: r.n_distinct for r in facts.merged_counts(stored, by).collect()}
        assert got.keys() == exact.keys() and all(abs(got[k] - n) <= 4 * 1.04 / 64 * n for k, n in exact.items())


# Nested facts, table functions


def leaves(v, path="$"):
    import re

    if isinstance(v, dict):
        for k, x in v.items():
            yield from leaves(x, path + (f".{k}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", k) else "['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']"))
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from leaves(x, f"{path}[{i}]")
    else:
        yield path, "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number", v if isinstance(v, str) else None


def test_nested_facts_have_paths(spark):
    import json

    from veilframe.operators import nested

    texts = ['{"a":{"b":[[1,"xy"],["z\\"q\\u00e9\\n",[[null]]]],"it\'s":"  long fact  ","a b":true,"c\\\\d":"e"},"a2":1.5}', '{"k":"one","k":"last"}', '"alone"', "[]", "{}", '{"x":[]}', "broken {", None, '{"":"empty key"}', "[" * 30 + '"deep"' + "]" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    got = {(r.i, r.path, r.kind, r.value if r.kind == "string" else None) for r in nested.walked(df, "j", "i").collect()}
    want = {(i, *x) for i, t in enumerate(texts) if t and t != "broken {" for x in leaves(json.loads(t))}
    assert got == want and (1, "$.k", "string", "last") in got
    assert {(r.i, r.path, r.fact) for r in nested.facts(df.limit(1), "j", "i").collect()} == {(0, "$.a['it\\'s']", "long fact"), (0, "$.a.b[1][0]", 'z"qé')}


def test_recogniser_in_sql(spark):
    from veilframe.operators import tables

    tables.registered(spark, "caps", tables.by_patterns({"CAP": r"[A-Z]\w+", "NUM": r"\d+"}))
    df = spark.createDataFrame([(1, "é Bob has 12 Cats"), (2, None), (3, "none"), (4, "")], "i int, t string")
    got = [tuple(r) for r in spark.sql("select i, s.* from {d}, lateral caps(t) s order by i, start", d=df).collect()]
    assert got == [(1, 2, 5, "CAP", "Bob"), (1, 10, 12, "NUM", "12"), (1, 13, 17, "CAP", "Cats")]
