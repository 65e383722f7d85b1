"""Mixing sources to target weights.

Plan: each source's documents are dealt into blocks by a hash of doc_id. Whole passes take every block; the last, partial
pass takes blocks in a seeded permutation until the source's target is met, then documents of one boundary block in a
seeded order, and of the last document its first words. What a source gives is thus a number of block draws. A splitting
tree halves the output shards again and again; at each node the sources' draws are divided between the two sides by one
multivariate hypergeometric draw, so every shard gets an exact quota of draws of each source. A shard's quota is a run of
the source's permuted draws, so shards never share a draw; within a shard rows are ordered by a seeded hash.

Sources are ranked, weighted and given targets as tables, so there may be any number of them. Blocks are dealt by a
source's rows: BLOCKS together, in proportion, and one at least for each source. Fewer than BLOCKS sources thus have more
than one block, which is the bound for what is always broadcast; block metadata is broadcast where it has at most
2 * BLOCKS rows and joined by source and block otherwise. For the tree, runs of sources stand for one source at the
driver (GROUPS of them at most); each run then divides its quotas among its sources by the same draws.

Edge cases: null text has size 0; a null source is a source of its own, last in order; an empty table gives an empty
mix; a source whose documents are all empty has target 0; repeated rows are rows of their own; equal doc_ids share a
block; further columns stay in `mixed`, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from veilframe.llm.bytesview import strings, words
from veilframe.llm.names import unused, without
from veilframe.session import checkpointed

BLOCKS = 65_536  # blocks of all sources of more than one block together, at most
GROUPS = 1_024  # runs of sources that the driver deals to shards, at most
BLOCK_DOCS = 64  # documents in a block, about, while BLOCKS allows it
MOST = 3  # times its size that a source may give
WEIGHTS = (1, 2, 3)  # dealt to the sources in order, repeating


def sized(docs: DataFrame, text: str = "text", size: str = "size", drop_text: bool = True) -> DataFrame:
    """docs with the number of words of each text, and a hash of it that settles ties."""
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != text or not drop_text), word_count(F.col(text)).alias(size), F.xxhash64(text).alias("_m_hash"))


def word_count(text: Column) -> Column:
    """Words of a text: what its separators leave, but for nothing before the first and behind the last."""
    parts = F.split(text.cast("string"), r"[\x20\x09-\x0D]+", -1)
    n = F.transform(F.array(parts), lambda p: F.size(p) - (F.get(p, 0) == "").cast("int") - (F.get(p, F.size(p) - 1) == "").cast("int"))[0]
    return F.coalesce(F.greatest(n, F.lit(0)), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int]) -> dict[str | None, Fraction]:
    """Words that each source is to give: shares by weight, none above MOST times its size, the excess dealt anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    out: dict[str | None, Fraction] = {}
    free, left = order, Fraction(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > MOST * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: Fraction(MOST * sizes[s]) for s in above}
        left -= sum(MOST * sizes[s] for s in above)
        free = [s for s in free if s not in out]
    return out


def split(quotas: list[int] | np.ndarray, shards: int | np.ndarray, seed: int | list[int]) -> np.ndarray:
    """Exact quotas of each source (row) in each shard (column) by a tree of multivariate hypergeometric draws.

    shards is their number, for shards of even size, or the size of each of them."""
    even = isinstance(shards, int)
    sizes = np.zeros(shards, np.int64) if even else np.asarray(shards, np.int64)
    out = np.zeros((len(quotas), len(sizes)), np.int64)
    rng = np.random.default_rng(seed)
    stack = [(0, len(sizes), np.array(quotas, np.int64))]
    while stack:
        lo, hi, q = stack.pop()
        if hi - lo == 1:
            out[:, lo] = q
            continue
        mid, total = (lo + hi) // 2, int(q.sum())
        take = total * (mid - lo) // (hi - lo) if even else int(sizes[lo:mid].sum())
        if total < 10**9:
            left = rng.multivariate_hypergeometric(q, take, method="marginals") if total else q * 0
        else:  # more than numpy draws from: in proportion, rounded so that the sum is exact
            left = np.diff(np.array([0, *(int(c) * take // total for c in np.cumsum(q))], np.int64))
        stack += [(mid, hi, q - left), (lo, mid, left)]
    return out


def _salted(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _key(source: str = "source") -> Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))


def _lit(n: int, digits: int) -> Column:
    return F.lit(Decimal(n)).cast(f"decimal({digits},0)")


def aimed(sizes: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """A row for each source of sizes(source, size), and their number and rows: _m_key, _m_rank, _m_n (rows), source_size
    (words), _m_num and _m_den (its target as a fraction: what `targets` gives)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_m_n"))
    per = checkpointed(per.orderBy(F.col("source").asc_nulls_last()))
    ends, at = {r.p: r["count"] for r in per.groupBy(F.spark_partition_id().alias("p")).count().collect()}, 0
    starts = []
    for p in range(max(ends, default=-1) + 1):
        starts.append(at)
        at += ends.get(p, 0)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # number within the partition
    per = per.withColumn("_m_rank", F.array(*(F.lit(x).cast("bigint") for x in starts or [0]))[F.spark_partition_id()] + row)
    weight = F.array(*map(F.lit, WEIGHTS))[F.pmod("_m_rank", F.lit(len(WEIGHTS))).cast("int")]
    per = checkpointed(per.select(_key().alias("_m_key"), "_m_rank", "_m_n", "source_size", weight.alias("_m_weight")))
    of = per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("source_size", "_m_n", "_m_weight"))).first()
    num, den, capped = of.source_size, max(1, of._m_weight), 0
    most = (F.col("source_size") * MOST).cast("decimal(20,0)")

    def share() -> Column:
        return F.col("_m_weight").cast("decimal(2,0)") * _lit(num, 19)

    while True:  # each round caps the sources above MOST times their size; what is left goes to the others
        above = share() > most * _lit(den, 18)
        r = per.filter(above).agg(F.count(F.lit(1)).alias("n"), F.sum("source_size").alias("size"), F.sum("_m_weight").alias("w")).first()
        if r.n == capped:
            break
        num, den, capped = of.source_size - MOST * r.size, of._m_weight - r.w, r.n
    above = share() > most * _lit(den, 18)
    out = per.withColumns({"_m_num": F.when(above, most).otherwise(share()).cast("decimal(22,0)"), "_m_den": F.when(above, 1).otherwise(F.lit(den)).cast("decimal(18,0)")})
    return out.drop("_m_weight"), {"sources": at, "rows": of._m_n}


def plan(sizes: DataFrame, seed: int = 0, shards: int = 64) -> tuple[DataFrame, dict]:
    """Block draws for sizes(doc_id, source, size): a row a block, and what drawn() needs beside them.

    Columns: _m_key, _m_block, source_size, target, _m_whole (passes that take all of it), _m_part (0 no, 1 whole, 2 boundary
    block), _m_need (words wanted of the boundary block), _m_shards (shard of each draw, in order of the passes)."""
    per, n = aimed(sizes)
    by_rows = F.expr(f"_m_n * {BLOCKS} div {max(1, n['rows'])}")
    k = F.greatest(F.lit(1), F.least(by_rows, F.ceil(F.col("_m_n") / BLOCK_DOCS)))
    hot = per.select("_m_key", k.cast("int").alias("_m_blocks")).filter("_m_blocks > 1")
    sums = with_block(sizes, hot, seed).groupBy("_m_key", "_m_block").agg(F.sum("size").alias("_m_words"))
    size = max(1, -(-n["sources"] // GROUPS))
    want = F.expr("(2 * _m_num + _m_den) div (2 * _m_den)")  # rounded, halves to even
    half = F.expr("(2 * _m_num + _m_den) % (2 * _m_den) = 0")
    told = per.select(
        "_m_key", "_m_rank", F.expr(f"_m_rank div {size}").cast("int").alias("_m_group"), "source_size",
        (F.col("_m_num").cast("double") / F.col("_m_den").cast("double")).alias("target"),
        (want - F.when(half & (want % 2 == 1), 1).otherwise(0)).cast("bigint").alias("_m_want"),
        F.when(F.col("source_size") > 0, F.expr("_m_num div greatest(1, source_size) div _m_den")).otherwise(0).cast("int").alias("_m_whole"),
    )
    at = sums.join(F.broadcast(told) if n["sources"] <= BLOCKS else told, "_m_key")
    order = Window.partitionBy("_m_key").orderBy(_salted(seed + 3, F.col("_m_key"), F.col("_m_block")), "_m_block")
    left = F.col("_m_want") - F.col("_m_whole") * F.col("source_size") - (F.sum("_m_words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m_words"))
    at = at.withColumn("_m_left", left).withColumn("_m_at", F.row_number().over(order))
    at = at.withColumn("_m_part", F.when(F.col("_m_left") <= 0, 0).when(F.col("_m_words") <= F.col("_m_left"), 1).otherwise(2))
    at = at.withColumn("_m_need", F.when(F.col("_m_part") == 2, F.col("_m_left")).otherwise(0))
    at = checkpointed(at.select("_m_key", "_m_block", "_m_rank", "_m_group", "_m_at", "source_size", "target", "_m_whole", "_m_part", "_m_need"))
    draws = at.groupBy("_m_group").agg(F.sum(F.col("_m_whole") + (F.col("_m_part") > 0).cast("int")).alias("draws"), F.count(F.lit(1)).alias("n")).collect()
    draws.sort(key=lambda r: r._m_group)
    quotas = dict(zip((r._m_group for r in draws), split([r.draws for r in draws], shards, seed)))

    def deal(t: pa.Table) -> pa.Table:
        if not len(t):
            return t.append_column("_m_shards", pa.array([], pa.list_(pa.int32())))
        t = t.sort_by([("_m_rank", "ascending"), ("_m_at", "ascending")])
        whole, part, rank = (t.column(c).to_numpy() for c in ("_m_whole", "_m_part", "_m_rank"))
        first = np.flatnonzero(np.diff(rank, prepend=-1))
        times = whole + (part > 0)
        group = t.column("_m_group")[0].as_py()
        cuts = np.cumsum(split(np.add.reduceat(times, first), quotas[group], [seed, group]), axis=1)
        of = np.full((len(t), MOST + 1), -1, np.int32)
        for i, (a, b) in enumerate(zip(first, [*first[1:], len(t)])):
            taken = np.arange(MOST + 1)[:, None] < times[a:b]  # pass by block
            numbers = np.cumsum(taken.ravel()).reshape(taken.shape) - 1
            of[a:b] = np.where(taken, np.searchsorted(cuts[i], numbers, "right"), -1).T
        ends = np.concatenate([[0], np.cumsum(times)]).astype(np.int32)
        return t.append_column("_m_shards", pa.ListArray.from_arrays(pa.array(ends), pa.array(of[of >= 0])))

    shape = T.StructType([*at.schema.fields, T.StructField("_m_shards", T.ArrayType(T.IntegerType()))])
    dealt = at.groupBy("_m_group").applyInArrow(deal, shape).drop("_m_rank", "_m_group", "_m_at")
    return checkpointed(dealt), {"hot": hot, "blocks": sum(r.n for r in draws)}


def with_block(sizes: DataFrame, hot: DataFrame, seed: int) -> DataFrame:
    """sizes with the key of the source and the block of each row. hot has the sources of more than one block."""
    j = sizes.withColumn("_m_key", _key()).join(F.broadcast(hot), "_m_key", "left")
    blocks = F.coalesce("_m_blocks", F.lit(1)).cast("bigint")
    return j.withColumn("_m_block", F.pmod(_salted(seed, F.col("doc_id")), blocks).cast("int")).drop("_m_blocks")


def drawn(sizes: DataFrame, seed: int = 0, shards: int = 64, planned: DataFrame | None = None) -> DataFrame:
    """Rows of sizes (doc_id, source, size and any others) with source_size, target, _m_whole (times taken whole), _m_extra
    (words taken in the partial pass, perhaps fewer than size) and _m_shards (shard of each draw)."""
    blocks, facts = plan(sizes if planned is None else planned, seed, shards)
    at = with_block(sizes, facts["hot"], seed)
    at = at.join(F.broadcast(blocks) if facts["blocks"] <= 2 * BLOCKS else blocks, ["_m_key", "_m_block"])
    plain = at.filter("_m_part < 2").withColumn("_m_extra", F.when(F.col("_m_part") == 1, F.col("size")).otherwise(0).cast("bigint"))
    w = Window.partitionBy("_m_key", "_m_block").orderBy(_salted(seed + 1, F.col("doc_id")), "doc_id", "size", "_m_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = at.filter("_m_part = 2").withColumn("_m_sum", F.sum("size").over(w))
    edge = edge.withColumn("_m_extra", F.greatest(F.lit(0), F.least("size", F.col("_m_need") - (F.col("_m_sum") - F.col("size")))).cast("bigint")).drop("_m_sum")
    return plain.unionByName(edge)


def planned_mix(docs: DataFrame, seed: int = 0, shards: int = 64) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted), shards (those
    that its draws go to, in order of the passes, comma-joined)."""
    rows = drawn(checkpointed(sized(docs.select("doc_id", "source", "text"))), seed, shards)
    whole = F.size("_m_shards") - (F.col("_m_part") > 0).cast("int")  # draws that the tree dealt, but for the partial pass
    taken = whole * F.col("size") + F.col("_m_extra")
    into = F.array_join(F.when((F.col("_m_part") == 2) & (F.col("_m_extra") == 0), F.slice("_m_shards", F.lit(1), F.col("_m_whole"))).otherwise(F.col("_m_shards")), ",")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), into.alias("shards"))


def _cut(df: DataFrame) -> DataFrame:
    """Texts of which fewer words than they have are taken, cut after the last of them."""
    names = df.columns
    i, j = names.index("text"), names.index("_m_extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = strings(b.column(i))
            _, ends, first = words(data, offs)
            raw, out = data.tobytes(), []
            for k, n in enumerate(b.column(j).to_pylist()):
                out.append(raw[offs[k] : ends[first[k] + n - 1] if n else offs[k]].decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if x == i else b.column(x) for x in range(len(names))], names)

    return df.mapInArrow(run, df.schema)


def mixed(docs: DataFrame, seed: int = 0, shards: int = 64, shard: str = "_m_shard", order: str = "_m_order") -> DataFrame:
    """The mix itself: docs' columns with the taken texts, a row for each draw, and columns `shard` and `order` (a seeded shuffle
    within the shard; they take the place of columns of their names). Each partition is a shard, its rows in that order. A text that is cut gets its new n_chars where docs has that column."""
    sizes = checkpointed(sized(docs.select("doc_id", "source", "text")))
    docs = without(docs, shard, order)
    clash = [k for k in docs.columns if k.lower() in ("size", "source_size", "target") or k.lower().startswith("_m_")]
    own = dict(zip(clash, unused(docs, *(f"kept{i}" for i in range(len(clash)))), strict=True))  # columns of those names are kept aside
    rows = drawn(sized(docs.withColumnsRenamed(own), drop_text=False), seed, shards, sizes)
    full = rows.withColumn("_m_pass", F.explode(F.sequence(F.lit(0), F.size("_m_shards") - 1))).filter("size(_m_shards) > 0")
    partial = (F.col("_m_pass") >= F.col("_m_whole")) & (F.col("_m_extra") < F.col("size"))
    cut = _cut(full.filter(partial & (F.col("_m_extra") > 0)))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    out = full.filter(~partial).unionByName(cut)
    out = out.select(
        *(F.col(own[k]).alias(k) if k in own else F.col(k) for k in docs.columns),
        F.col("_m_shards")[F.col("_m_pass")].alias(shard),
        _salted(seed + 2, F.col("doc_id"), F.col("_m_pass")).alias(order),
    )
    return out.repartitionById(shards, F.col(shard)).sortWithinPartitions(order)
