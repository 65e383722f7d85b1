"""Leaking facts for fact tables of any size: an Aho-Corasick automaton a shard of facts, run over the texts.

Facts are dealt to shards by hash so that a shard has about SHARD_BYTES of rows; each is collected by itself, its automaton
is built once at the driver and sent to the executors, and one narrow pass over the texts finds every fact that a text
holds, whatever their number or length. A text is read once a shard and never leaves its row; no parts of it become rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_BYTES = 8 << 20  # of fact rows, as JSON, that an automaton is built from, about
PAIRS = 4_096  # result rows of a batch, about


def automaton(facts: list[str]):
    """Values of a match are the numbers of the facts that are equal to it."""
    import ahocorasick

    at: dict[str, list[int]] = {}
    for i, f in enumerate(facts):
        at.setdefault(f, []).append(i)
    out = ahocorasick.Automaton()
    for f, rows in at.items():
        out.add_word(f, rows)
    if at:
        out.make_automaton()
    return out


def leaks(payloads: DataFrame, facts: DataFrame, text: str, fact: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pairs of a payload and a fact of three characters or more in it, whatever the case; both tables' columns.

    Null texts and facts pair with nothing; equal facts and repeated payloads are rows of their own."""
    f = facts.withColumn("_f", F.lower(fact)).filter(F.length("_f") >= 3)
    size = f.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    p = payloads.withColumn("_p", F.lower(text))
    out = None
    for s in range(shards):
        mine = f.filter(F.pmod(F.xxhash64("_f"), F.lit(shards)) == s) if shards > 1 else f
        found = _scan(p, mine.toArrow(), payloads.schema, facts.schema)
        out = found if out is None else out.unionByName(found) if len(set(found.columns)) == len(found.columns) else out.union(found)
    return out


def _scan(p: DataFrame, facts: pa.Table, left: T.StructType, right: T.StructType) -> DataFrame:
    own = facts.drop_columns(["_f"]).combine_chunks()
    rows = own.to_batches()[0] if len(own) else None
    shared = p.sparkSession.sparkContext.broadcast((automaton(facts.column("_f").to_pylist()), rows))
    names = [*left.names, *right.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, rows = shared.value
        if rows is None:
            return
        for b in batches:
            at, of = [], []
            for i, t in enumerate(b.column(len(left.names)).to_pylist()):
                if t:
                    hit = {id(v): v for _, v in search.iter(t)}
                    for v in hit.values():
                        at += [i] * len(v)
                        of += v
                if len(at) >= PAIRS:
                    yield _pairs(b, rows, at, of, names)
                    at, of = [], []
            if at:
                yield _pairs(b, rows, at, of, names)

    return p.mapInArrow(run, T.StructType([*left.fields, *right.fields]))


def _pairs(b: pa.RecordBatch, rows: pa.RecordBatch, at: list[int], of: list[int], names: list[str]) -> pa.RecordBatch:
    i, j = pa.array(np.array(at, np.int64)), pa.array(np.array(of, np.int64))
    return pa.RecordBatch.from_arrays([*(c.take(i) for c in b.columns[:-1]), *(c.take(j) for c in rows.columns)], names)
