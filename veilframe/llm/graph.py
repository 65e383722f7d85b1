"""Connected components of edges, and comparing a bucket's members in blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.session import checkpointed


def _twice(*pairs: tuple[str, str]) -> Column:
    """Rows (a, b) for each pair of columns. A union would hold its input's plan once for each pair, and
    unions of unions of it make plans that burden the driver."""
    return F.inline(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs)))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (least node that can be reached) of every node of edges(a, b), both bigint.

    Alternates two steps until nothing changes: every neighbour above a node moves to the least neighbour of the node, then
    every neighbour below does. Each is one pre-aggregated minimum and one join, which Spark can split at a hot node; the
    edges are written to the shared checkpoint folder after each round."""
    e = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(rounds):
        both = e.select(_twice(("a", "b"), ("b", "a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u"))
        moved = small.select(_twice(("b", "m"), ("a", "m")))
        e = checkpointed(moved.filter("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    child = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return child.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def in_blocks(members: DataFrame, bucket: str, node: str, size: int, compare: Callable, schema: str) -> DataFrame:
    """compare() over all pairs of members of each bucket, with no task holding more than about 2 * size of them.

    members has the bucket's number of members in _n. A bucket of more than `size` members is dealt into blocks by a hash
    of the node; every pair of blocks is a group of its own, and a member goes to as many groups as its bucket has blocks.
    compare gets an Arrow table with _block, _i and _j (the group is the pair of blocks _i <= _j) and returns one."""
    k = F.ceil(F.col("_n") / size).cast("int")
    m = members.withColumn("_k", k).withColumn("_block", F.pmod(F.xxhash64(node, F.lit(31)), F.col("_k").cast("bigint")).cast("int"))
    m = m.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    m = m.withColumn("_i", F.least("_block", "_o")).withColumn("_j", F.greatest("_block", "_o")).drop("_k", "_o")
    return m.groupBy(bucket, "_i", "_j").applyInArrow(compare, schema)
