"""Ordered work over keys of any size: running history of facts, as-of joins, sessions.

A key's rows may be a third of all rows, so no window holds a key. Rows are sorted by ranges of (key, order) and written with
the number of their range; a window covers what a key has in one range, and what earlier ranges hand on to it comes from a
table of one row a key and range. Nothing is collected into a row but that row's own facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.session import through_parquet

RANGE, PLACE = "_range", "_place"


def ranged(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df sorted by ranges of key and order, with the number of each row's range; written once."""
    return through_parquet(df.repartitionByRange(F.col(key), *map(F.col, order)).sortWithinPartitions(key, *order).withColumn(RANGE, F.spark_partition_id()))


def _within(key: str, *order: str):
    return Window.partitionBy(RANGE, key).orderBy(*order)


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """rows of `ranged` with the sum of value over the key's rows strictly before."""
    parts = rows.groupBy(key, RANGE).agg(F.sum(value).alias("_v"))
    before = Window.partitionBy(key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(key).alias("_k"), F.col(RANGE).alias("_r"), F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_v"))
    own = F.coalesce(F.sum(value).over(_within(key, *order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn(name, own).join(parts, F.col(key).eqNullSafe(F.col("_k")) & (F.col(RANGE) == F.col("_r")))
    return out.withColumn(name, F.col(name) + F.col("_v")).drop("_k", "_r", "_v")


def last_before(rows: DataFrame, key: str, order: list[str], value: str, name: str, strictly: bool = True) -> DataFrame:
    """rows of `ranged` with the last value that isn't null of the key's rows before (strictly, or up to the row itself)."""
    parts = rows.groupBy(key, RANGE).agg(F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v")))).alias("_v"))
    before = Window.partitionBy(key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(key).alias("_k"), F.col(RANGE).alias("_r"), F.last("_v", ignorenulls=True).over(before)["_v"].alias("_v"))
    own = F.last(value, ignorenulls=True).over(_within(key, *order).rowsBetween(Window.unboundedPreceding, -1 if strictly else 0))
    out = rows.withColumn(name, own).join(parts, F.col(key).eqNullSafe(F.col("_k")) & (F.col(RANGE) == F.col("_r")))
    return out.withColumn(name, F.coalesce(name, "_v")).drop("_k", "_r", "_v")


# History of facts


def first_seen(df: DataFrame, key: str, order: str, facts: str) -> DataFrame:
    """key, fact, `order` of its first row, _place there: each fact of a key once. Counted by (key, fact) before it moves."""
    every = df.select(key, order, F.posexplode(F.array_distinct(facts)).alias(PLACE, "fact")).filter("fact is not null")
    return every.groupBy(key, "fact").agg(F.min(F.struct(F.col(order).alias("o"), F.col(PLACE).alias("p"))).alias("_f")).select(key, "fact", F.col("_f.o").alias(order), F.col("_f.p").alias(PLACE))


def history(df: DataFrame, key: str, order: str, facts: str) -> DataFrame:
    """df with n_before, the number of distinct facts of the key's rows of lesser order, and new_facts, those that the key has
    first at this order, in the order of the row. The union of a key's earlier new_facts is its history.

    Rows of one key and order share both. A null key is a key; null facts and null arrays hold nothing."""
    seen = first_seen(df, key, order, facts)
    new = seen.groupBy(key, order).agg(F.array_sort(F.collect_list(F.struct(PLACE, "fact"))).alias("_n"))
    new = new.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.transform("_n", lambda x: x["fact"]).alias("new_facts"))
    steps = df.select(key, order).distinct().join(new, F.col(key).eqNullSafe(F.col("_k")) & F.col(order).eqNullSafe(F.col("_o")), "left")
    none = F.expr("cast(array() as array<string>)")
    steps = ranged(steps.select(key, order, F.coalesce("new_facts", none).alias("new_facts")).withColumn("_c", F.size("new_facts").cast("bigint")), key, order)
    steps = running_sum(steps, key, [order], "_c", "n_before").select(F.col(key).alias("_k"), F.col(order).alias("_o"), "new_facts", "n_before")
    return df.join(steps, F.col(key).eqNullSafe(F.col("_k")) & F.col(order).eqNullSafe(F.col("_o"))).drop("_k", "_o")


def leaked_history(pairs: DataFrame, seen: DataFrame, key: str, order: str, fact: str = "fact") -> DataFrame:
    """Of pairs (key, order, fact; a payload row and a fact that it holds), those whose fact the key had before."""
    s = seen.select(F.col(key).alias("_k"), F.col("fact").alias("_f"), F.col(order).alias("_o"))
    return pairs.join(s, F.col(key).eqNullSafe(F.col("_k")) & (F.col(fact) == F.col("_f"))).filter(F.col("_o") < F.col(order)).drop("_k", "_f", "_o")


# As of a time


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with `value` of the key's last row of right that isn't later; both have key and at. Of rows of right at one time,
    the greatest value counts; null values are no rows. A union and a last value: no range join."""
    r = right.filter(F.col(value).isNotNull()).groupBy(key, at).agg(F.max(value).alias(value))
    rows = r.select(key, at, F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    own = left.select(key, at, F.lit(1).alias("_side"), F.lit(None).cast(r.schema[value].dataType).alias("_value"), F.struct(*left.columns).alias("_row"))
    every = ranged(rows.unionByName(own), key, at, "_side")
    return last_before(every, key, [at, "_side"], "_value", value, strictly=False).filter("_side = 1").select("_row.*", value)


# Sessions


def sessions(df: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """key, session_start, session_end (its last row), n: rows of a key that follow each other within `gap`."""
    rows = df.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.count(F.lit(1)).alias("n"))
    rows = last_before(ranged(rows, key, at), key, [at], at, "_last")
    rows = rows.withColumn("_new", F.when(F.col("_last").isNull() | (F.col(at) > F.col("_last") + F.expr(f"interval {gap}")), 1).otherwise(0).cast("bigint"))
    rows = running_sum(through_parquet(rows), key, [at], "_new", "_s").withColumn("_s", F.col("_s") + F.col("_new"))
    return rows.groupBy(key, "_s").agg(F.min(at).alias("session_start"), F.max(at).alias("session_end"), F.sum("n").alias("n")).drop("_s")
