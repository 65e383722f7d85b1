"""A trained entity recogniser: a linear-chain tagger (averaged structured perceptron, Viterbi), fitted by Spark on marked texts.

Fitting mixes parameters: each shard of a bounded sample learns for an epoch from the common weights, Spark sums what the
shards learned, and the mean is where the next epoch starts. The model is the mean of the averaged weights of all epochs.
Scoring is one narrow pass in Arrow batches. A text is tagged as a whole; its scores are made in blocks of words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe import constants as c
from veilframe.session import through_parquet

SAMPLE = 4000  #: marked texts that are learned from, those of the least hashes
SHARDS = 4
EPOCHS = 6
BUCKETS = 1 << 17  #: of hashed features; a model has at most BUCKETS x tags weights
BLOCK = 4096  #: words whose scores are in memory at once
GRAIN = float(1 << 20)  #: averaged weights are multiples of 1 / GRAIN, so that sums do not depend on their order
CHUNK = "CHUNK"
LABELS = (*c.NER_TYPES, CHUNK)
FOUND = "array<struct<text:string,start:int,end:int,label:string,is_chunk:boolean>>"
MARKS = "array<struct<start:int,end:int,label:string>>"

_WORD = re.compile(r"\w+|[^\w\s]")
_RUNS = (re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A-Z]+"), re.compile(r"\d+"))


def marked(pieces: Column) -> Column:
    """struct<text, spans> of array<struct<t, l>>: the pieces joined, and where those with a label stand (code points)."""
    whole = F.array_join(F.transform(pieces, lambda p: p["t"]), "")
    before = lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda n, p: n + F.length(p["t"]))
    placed = F.transform(pieces, lambda p, i: F.struct(before(i).alias("start"), (before(i) + F.length(p["t"])).alias("end"), p["l"].alias("label")))
    return F.struct(whole.alias("text"), F.filter(placed, lambda s: s["label"].isNotNull()).alias("spans"))


def _shape(word: str) -> str:
    for run, sign in zip(_RUNS, ("A", "a", "0")):
        word = run.sub(sign, word)
    return word[:6]


def _features(words: list[str]) -> np.ndarray:
    """Buckets of each word's features: the word, its shape, ends and neighbours."""
    low = ["<2>", "<1>", *(w.lower() for w in words), "<1>", "<2>"]
    shape = ["", "", *map(_shape, words), "", ""]
    rows = []
    for i in range(2, len(words) + 2):
        own, prev, after = low[i], low[i - 1], low[i + 1]
        told = (
            "b", f"w{own}", f"s{shape[i]}", f"e{own[-3:]}", f"p{own[:3]}", f"l{prev}", f"r{after}", f"L{low[i - 2]}|{prev}", f"R{after}|{low[i + 2]}",
            f"x{shape[i - 1]}|{shape[i]}", f"y{shape[i]}|{shape[i + 1]}", f"z{prev}|{shape[i]}", f"q{shape[i]}|{after}",
        )
        rows.append([zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in told])
    return np.asarray(rows, dtype=np.int64) if rows else np.zeros((0, 1), dtype=np.int64)


def _tags(labels: tuple[str, ...]) -> list[str]:
    return ["O", *(f"{p}-{x}" for x in labels for p in "BI")]


def _forbidden(n: int) -> np.ndarray:
    """-inf where a tag can't follow one: the inside of a label follows its beginning or inside. The last row is the start."""
    out = np.zeros((n + 1, n))
    for inside in range(2, n, 2):
        out[:, inside] = -np.inf
        out[[inside - 1, inside], inside] = 0
    return out


def _decoded(emit: Callable[[int, int], np.ndarray], n: int, step: np.ndarray) -> np.ndarray:
    """The best tags of n words; emit(i, j) has the scores of words i to j, step those of pairs of tags. Ties to the first tag."""
    k = step.shape[1]
    back, at, every = np.zeros((n, k), dtype=np.int16), None, np.arange(k)
    for i in range(0, n, BLOCK):
        for j, row in enumerate(emit(i, min(n, i + BLOCK)), i):
            if at is None:
                at = step[k] + row
            else:
                reached = at[:, None] + step[:k]
                back[j] = reached.argmax(axis=0)
                at = reached[back[j], every] + row
    out = np.zeros(n, dtype=np.int64)
    if n:
        out[-1] = at.argmax()
        for j in range(n - 1, 0, -1):
            out[j - 1] = back[j, out[j]]
    return out


@dataclass(frozen=True)
class Tagger:
    """A fitted model: weights of the features and tag pairs that have any. find(text) gives (start, end, label)."""

    labels: tuple[str, ...]
    row: np.ndarray
    weight: np.ndarray
    step: np.ndarray

    def find(self, text: str) -> list[tuple[int, int, str]]:
        places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        features = _features([text[a:b] for a, b in places])
        tags = _decoded(lambda i, j: self.weight[self.row[features[i:j]]].sum(axis=1), len(places), self.step)
        out: list[tuple[int, int, str]] = []
        for (start, end), t in zip(places, tags):
            if t and t % 2 == 0:
                out[-1] = (out[-1][0], end, out[-1][2])
            elif t:
                out.append((start, end, self.labels[(t - 1) // 2]))
        return out

    def recognizer(self) -> Callable[[Column], Column]:
        """A recogniser for spans.extract: null gives null, a text without words an empty array."""
        model = self

        @F.pandas_udf(FOUND)
        def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.map(lambda t: None if t is None else [{"text": t[a:b], "start": a, "end": b, "label": x, "is_chunk": x == CHUNK} for a, b, x in model.find(t)])

        return lambda text: tag(text)


def _gold(places: list[tuple[int, int]], spans: list[tuple[int, int, str]], labels: tuple[str, ...]) -> np.ndarray:
    """Tags of words by the spans that hold them; of spans that overlap the first one counts."""
    out, at = np.zeros(len(places), dtype=np.int64), 0
    for start, end, label in sorted(spans):
        first = True
        while at < len(places) and places[at][0] < end:
            if places[at][0] >= start and places[at][1] <= end:
                out[at] = 2 * labels.index(label) + (1 if first else 2)
                first = False
            at += 1
    return out


def _epoch(labels: tuple[str, ...], known: pd.DataFrame, epoch: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What one shard learns in one epoch: bucket, tag, w (where it ends), a (its average). Buckets from BUCKETS on are tags."""

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        k = 2 * len(labels) + 1
        w = np.zeros((BUCKETS + k + 1, k))
        w[known.bucket.to_numpy(dtype=np.int64), known.tag.to_numpy(dtype=np.int64)] = known.w.to_numpy()
        drift, barred, seen = np.zeros_like(w), _forbidden(k), 0
        rows = rows.sort_values("text", kind="stable").reset_index(drop=True)
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            text, marks = rows.text[r], rows.spans[r]
            places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
            spans = [(s["start"], s["end"], s["label"]) for s in (marks if marks is not None else ()) if s["label"] in labels]
            gold, features = _gold(places, spans, labels), _features([text[a:b] for a, b in places])
            told = _decoded(lambda i, j: w[features[i:j]].sum(axis=1), len(places), w[BUCKETS:] + barred)  # noqa: B023
            if (told != gold).any():
                for tags, by in ((gold, 1.0), (told, -1.0)):
                    pairs = BUCKETS + np.concatenate(([k], tags[:-1])), tags
                    for m, size in ((w, by), (drift, by * seen)):
                        np.add.at(m, (features, tags[:, None]), size)
                        np.add.at(m, pairs, size)
            seen += 1
        a = np.floor((w - drift / max(seen, 1)) * GRAIN) / GRAIN
        bucket, tag = np.nonzero((w != 0) | (a != 0))
        return pd.DataFrame({"bucket": bucket.astype("int32"), "tag": tag.astype("int32"), "w": w[bucket, tag], "a": a[bucket, tag]})

    return learn


def fit(rows: DataFrame, text: str = "text", spans: str = "spans", labels: tuple[str, ...] = LABELS, sample: int = SAMPLE, epochs: int = EPOCHS, shards: int = SHARDS) -> Tagger:
    """A tagger learned from texts with marked spans (start, end in code points, label).

    Of the texts that are not null, the `sample` of least hash are learned from, so reruns agree. Spans of other labels are
    not learned, parts of words neither. Without texts the model finds nothing. The driver sees sums of weights only, at most
    BUCKETS x tags of them."""
    got = rows.select(F.col(text).alias("text"), F.col(spans).cast(MARKS).alias("spans")).filter("text is not null")
    order = [F.xxhash64("text"), F.col("text"), F.to_json("spans")]
    got = got.orderBy(*order).limit(sample)
    # Dealt in turn, so that a text told many times is learned in every shard; the window holds the sample only.
    got = through_parquet(got.withColumn("shard", F.row_number().over(Window.orderBy(*order)) % shards))
    n = got.select("shard").distinct().count()
    known = pd.DataFrame({"bucket": [], "tag": [], "w": [], "a": []})
    k, total = 2 * len(labels) + 1, None
    for epoch in range(epochs):
        learned = got.groupBy("shard").applyInPandas(_epoch(labels, known[["bucket", "tag", "w"]], epoch), "bucket int, tag int, w double, a double")
        known = learned.groupBy("bucket", "tag").agg((F.sum("w") / max(n, 1)).alias("w"), (F.sum("a") / max(n, 1)).alias("a")).toPandas()
        part = known.set_index(["bucket", "tag"]).a
        total = part if total is None else total.add(part, fill_value=0.0)
    total = total[total != 0].reset_index().sort_values(["bucket", "tag"])
    bucket, tag, a = (total[x].to_numpy() for x in ("bucket", "tag", "a"))
    bucket, tag = bucket.astype(np.int64), tag.astype(np.int64)
    step, steps = _forbidden(k), bucket >= BUCKETS
    step[bucket[steps] - BUCKETS, tag[steps]] += a[steps] / epochs
    used = np.unique(bucket[~steps])
    row, weight = np.zeros(BUCKETS, dtype=np.int32), np.zeros((len(used) + 1, k), dtype=np.float32)
    row[used] = np.arange(1, len(used) + 1)
    weight[row[bucket[~steps]], tag[~steps]] = a[~steps] / epochs
    return Tagger(labels, row, weight, step)


def agreement(rows: DataFrame, want: str, got: str, *by: str) -> DataFrame:
    """by, label, n_marked, n_found, n_right: spans of `got` (a recogniser's) that equal one of `want` in place and label.
    Ratios of the three are precision and recall. One shuffle of counts."""
    bare = lambda x: F.coalesce(F.transform(x, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))), F.expr(f"cast(array() as {MARKS})"))
    both = rows.select(*by, bare(F.col(want)).alias("_w"), bare(F.col(got)).alias("_g"))
    each = lambda xs, kind: F.transform(xs, lambda s: F.struct(s["label"].alias("label"), F.lit(kind).alias("kind")))
    signs = F.concat(each(F.col("_w"), 0), each(F.col("_g"), 1), each(F.array_intersect("_w", "_g"), 2))
    count = lambda kind, name: F.count_if(F.col("kind") == kind).alias(name)
    return both.select(*by, F.inline(signs)).groupBy(*by, "label").agg(count(0, "n_marked"), count(1, "n_found"), count(2, "n_right"))
