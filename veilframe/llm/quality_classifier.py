"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text are its words and pairs of neighbouring words, the same of the words' shapes (runs of lower case,
upper case, digits, letters beyond ASCII, and other characters as they are), words equal to the one before, and the order
of magnitude of its length. Each is hashed to one of 2**BITS coordinates; its value is its share of the text's words, so
a score is a sparse dot product and long texts need no special case.

The fit uses about SAMPLE labelled rows at most (those with the least hash of doc_id), each with its whole text. Their
coordinates are written once, in parts of PART together, and the driver holds one part at a time; every text is scored, whole.

Edge cases: null and empty texts have the length feature only and are scored; labels whose quality is null are not used;
a document with several labels, or several rows of one doc_id, are a training row each; without any labelled row all scores
are 0.5; repeated rows are scored alike; a result column takes the place of an input column of its name; further columns stay."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.bytesview import chunks, mix, powers, strings, sums, word_hashes, words
from veilframe.llm.names import without
from veilframe.session import through_parquet

BITS = 18
SAMPLE = 8_000  # labelled rows that the fit uses at most
PART = 8_000_000  # coordinates of training rows that the driver holds at once, about
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.3, 1.0, 0.002, 0.001
SCALE = 20.0  # of the shares

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's classes, runs of a class counted once."""
    c = _CLASS[data]
    keep = np.empty(len(c), bool)
    keep[0] = True
    np.not_equal(c[1:], c[:-1], out=keep[1:])
    keep[starts] = True
    rank = np.cumsum(keep)  # position in the shortened text
    up, down = powers(len(data) + 2)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.where(keep, (c.astype(np.uint64) + np.uint64(1)) * up[rank], np.uint64(0)), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[rank[starts]] + np.uint64(17))


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coordinates, bounds of each text in them) by kind of feature."""
    mask = np.uint64((1 << BITS) - 1)
    starts, ends, first = words(data, offsets)
    n = np.diff(first)
    size = mix(np.log2(n + 1).astype(np.uint64) + np.uint64(1 << 40)) & mask
    out = [(size.astype(np.int64), np.arange(len(n) + 1))]
    if not len(starts):
        return out
    for k, h in enumerate((word_hashes(data, starts, ends), _shapes(data, starts, ends))):
        out.append(((mix(h + np.uint64(k)) & mask).astype(np.int64), first))
        pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(k + 2)
        pair = np.where(h[:-1] == h[1:], np.uint64(99 + k), pair) if k == 0 else pair
        inner = np.ones(len(pair), bool)
        cuts = first[1:-1]
        inner[cuts[(cuts > 0) & (cuts < len(h))] - 1] = False
        at = np.concatenate([[0], np.cumsum(inner)])
        out.append(((mix(pair[inner]) & mask).astype(np.int64), at[np.minimum(first, len(pair))]))
    return out


def examples(labelled: DataFrame) -> DataFrame:
    """y, coordinates, values of each labelled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = strings(b.column(0))
            for i, j in chunks(offs):
                kinds = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                n = np.maximum(1, np.diff(kinds[1][1])) if len(kinds) > 1 else np.ones(j - i)
                idx, val = [], []
                for r in range(j - i):
                    parts = [np.unique(c[at[r] : at[r + 1]], return_counts=True) for c, at in kinds]
                    v = [np.ones(len(parts[0][0]))] + [p[1] * (SCALE / n[r]) for p in parts[1:]]
                    idx.append(np.concatenate([p[0] for p in parts]).astype(np.int32))
                    val.append(np.concatenate(v).astype(np.float32))
                cols = [b.column(1).slice(i, j - i), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(cols, ["y", "idx", "val"])

    return labelled.select(F.col("text").cast("string"), F.col("y").cast("int")).mapInArrow(run, "y int, idx array<int>, val array<float>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights (the last one is the bias) from labels(doc_id, y); both tables may have other columns.

    At most `sample` label rows are taken, and about as many of the rows that join them (documents may share a doc_id): what
    is broadcast and collected has a fixed bound."""
    chosen = labels.filter("y is not null and doc_id is not null").select("doc_id", "y")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = docs.select("doc_id").join(F.broadcast(chosen), "doc_id").count()
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    if rows > sample:
        joined = joined.filter(F.pmod(F.xxhash64("doc_id", "y", F.xxhash64("text")), F.lit(rows)) < sample)
    every = through_parquet(examples(joined.select("text", "y")))
    parts = -(-(every.agg(F.sum(F.size("idx"))).first()[0] or 0) // PART)
    part = F.pmod(F.xxhash64("idx", "val", "y"), F.lit(max(1, parts)))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rng, b = np.random.default_rng(7), 1 << BITS
    for epoch in range(EPOCHS if parts else 0):
        for p in range(parts):
            if parts > 1 or not epoch:
                t = every.filter(part == p).toArrow()
                y = t.column("y").to_numpy()
                # views of the collected lists; the last coordinate is the bias
                idx, val = ([x.values.to_numpy() for x in t.column(k)] for k in ("idx", "val"))
                order = sorted(range(len(t)), key=lambda k: (int(y[k]), hashlib.sha256(idx[k]).digest(), hashlib.sha256(val[k]).digest()))
            for k in rng.permutation(len(order)):
                i, x = idx[order[k]], val[order[k]]
                w, wb = weights(i), float(weights(np.array([b]))[0])
                err = 1 / (1 + np.exp(-np.clip(w @ x + wb, -35, 35))) - y[order[k]]
                g = err * x
                s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
                z[i] += g - s * w  # coordinates that two kinds share get one of their updates
                n[i] += g * g
                z[b] += err - (np.sqrt(n[b] + err * err) - np.sqrt(n[b])) / ALPHA * wb
                n[b] += err * err
    return weights(slice(None)).astype(np.float32)


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = []
    for i, j in chunks(offsets):
        kinds = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n = np.maximum(1, np.diff(kinds[1][1])) if len(kinds) > 1 else 1
        t = weights[-1] + weights[kinds[0][0]].astype(float)
        for c, at in kinds[1:]:
            t += sums(weights[c].astype(float), at) * SCALE / n
        out.append(1 / (1 + np.exp(-np.clip(t, -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def scored(docs: DataFrame, weights: np.ndarray, score: str = "score") -> DataFrame:
    """docs with the score of each text. Narrow; the weights (1 MB) go to the executors once."""
    docs = without(docs, score)
    names, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(weights)
    i = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(*strings(b.column(i)), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
