"""Language ID by interpolated Kneser-Ney character models, one a language.

Texts become letters of 12 bits (lower-cased; code points from 4096 on folded into the upper quarter) with one 0 between
runs of letters. An n-gram of five letters is thus a 60-bit key. For each language and order the n-grams that it has seen
stand in a sorted array of keys beside one of their interpolated log-probabilities; contexts stand beside their back-off
weights in the same way, so a model takes what its n-grams take, whatever the number of languages. The distinct n-grams of
some texts cost each language one binary search, and another for each shorter order where it hasn't seen the longer one. The
language of least cross-entropy a letter wins; the score is a softmax of the cross-entropies whose temperature is fitted on
documents left out of the counts. `rejected` is true where the cross-entropy strays from theirs, in proportion to the root of
the letters, further than all but REJECTED of them.

The fit is bounded by rows, which are counted whole: DOCS documents a language and TOTAL together, about, those with the
least hashes (the least of each language always), and HELD documents for calibration. Of more than MOST distinct n-grams
those with the least counts are left out (for memory; not met by a few dozen languages). Discounts are estimated from the counts of counts, by language and order. Every
text is scored, whole.

Edge cases: null, empty and letterless texts are `und` with score 0; languages are the non-null values of the training
rows; with none of them everything is `und`; equal entropies give the first language by name; repeated rows are scored
alike; a result column takes the place of an input column of its name; further columns stay."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.bytesview import chunks, strings, sums
from veilframe.llm.names import without
from veilframe.session import through_parquet

ORDER, BITS = 5, 12
DOCS = 2_500  # training documents a language
TOTAL = 20_000  # training documents of all languages, and one a language at least
HELD = 400  # documents that calibration uses
MOST = 24_000_000  # n-grams of full order in all models together
AT_ONCE = 4_000_000  # n-grams that the driver collects at once, about
REJECTED = 0.005  # share of known texts that may be rejected
LETTERS = 2_000  # size of the uniform model below the unigrams


def _letters() -> np.ndarray:
    out = np.zeros(0x110000, np.int16)
    for cp in range(len(out)):
        if unicodedata.category(chr(cp))[0] == "L":
            low = chr(cp).lower()
            k = ord(low) if len(low) == 1 else cp
            out[cp] = k if k < 0xC00 else 0xC00 + k % 0x400
    return out


_table: list[np.ndarray] = []


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, a 0 between runs of letters and one at each text's start; bounds of the texts in them."""
    if not _table:
        _table.append(_letters())
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = heads[offsets]
    code = _table[0][cp].astype(np.int64)
    keep = np.empty(len(code), bool)
    if len(code):
        keep[0] = True
        np.not_equal(code[1:] | code[:-1], 0, out=keep[1:])
        keep[at[:-1][at[1:] > at[:-1]]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    out, bounds = code[keep], kept[at]
    # a 0 in front of each text
    n = np.diff(bounds)
    ahead = np.zeros(len(out) + len(n), np.int64)
    slot = np.arange(len(out)) + np.repeat(np.arange(1, len(n) + 1), n)
    ahead[slot] = out
    return ahead, bounds + np.arange(len(bounds))


def grams(code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the n-gram that ends at each letter but a text's first 0, zeros before a text; bounds of the texts in them."""
    key = code.copy()
    pos = np.arange(len(code)) - np.repeat(bounds[:-1], np.diff(bounds))
    for k in range(1, ORDER):
        prev = np.zeros_like(code)
        prev[k:] = code[:-k]
        prev[pos < k] = 0
        key |= prev << (BITS * k)
    ok = pos > 0
    return key[ok], np.concatenate([[0], np.cumsum(ok)])[bounds]


@dataclass
class Language:
    """One model: by order, sorted n-grams with their log-probabilities, and contexts with their back-off weights."""

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    weight: list[np.ndarray]

    def position(self, key: np.ndarray) -> np.ndarray:
        """Log-probability of the last letter of each n-gram of full order; fast where keys are sorted."""
        lp, rest = np.zeros(len(key)), np.arange(len(key))
        for order in range(ORDER, 0, -1):
            k = key[rest] & ((1 << (BITS * order)) - 1)
            at, hit = _found(self.keys[order], k)
            lp[rest[hit]] += self.logp[order][at[hit]]
            rest, k = rest[~hit], k[~hit]
            at, seen = _found(self.contexts[order], k >> BITS)
            lp[rest[seen]] += self.weight[order][at[seen]]
        lp[rest] -= np.log(LETTERS)
        return lp


def _found(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in the sorted array, and whether it stands there."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return at, known[at] == keys


@dataclass
class Model:
    langs: list[str]
    parts: list[Language]
    temperature: float = 1.0
    usual: float = 0.0  # cross-entropy of texts in a known language
    reject: float = np.inf  # times the root of the letters: what a text may have above it

    def rejects(self, least: np.ndarray, letters: np.ndarray) -> np.ndarray:
        return (least - self.usual) * np.sqrt(np.maximum(letters, 1)) > self.reject

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for p in self.parts for x in (p.keys, p.logp, p.contexts, p.weight) for a in x)

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a letter (texts x languages) and number of letters."""
        out, letters = [np.zeros((0, len(self.langs)))], [np.zeros(0, np.int64)]
        for i, j in chunks(offsets):
            code, bounds = coded(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            key, at = grams(code, bounds)
            key, which = np.unique(key, return_inverse=True)
            n = np.maximum(1, np.diff(at))
            out.append(np.stack([-sums(p.position(key)[which], at) / n for p in self.parts], 1))
            letters.append(np.diff(np.concatenate([[0], np.cumsum(code > 0)])[bounds]))
        return np.concatenate(out), np.concatenate(letters)

    def position(self, key: np.ndarray) -> np.ndarray:
        """Log-probabilities (n-grams x languages)."""
        return np.stack([p.position(key) for p in self.parts], 1)


def discount(c: np.ndarray) -> float:
    """Absolute discount from the numbers of n-grams counted once and twice."""
    once, twice = int((c == 1).sum()), int((c == 2).sum())
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def fit_one(k: np.ndarray, c: np.ndarray) -> Language:
    """The model of one language from its n-grams of full order (sorted) and their counts."""
    none = np.zeros(0, np.int64)
    counted = [(none, none)] * (ORDER + 1)  # n-grams and counts by order (continuation counts below the full one)
    for order in range(ORDER, 0, -1):
        counted[order] = k, c
        k, c = np.unique(k & ((1 << (BITS * (order - 1))) - 1), return_counts=True)
    m = Language(*([none] * (ORDER + 1) for _ in range(4)))
    for order in range(1, ORDER + 1):
        k, c = counted[order]
        d = discount(c)
        ctx, first, kinds = np.unique(k >> BITS, return_index=True, return_counts=True)
        total = np.add.reduceat(c, first) if len(c) else c
        lam = d * kinds / total
        here = np.repeat(np.arange(len(ctx)), kinds)
        if order == 1:
            below = np.full(len(k), 1 / LETTERS)
        else:  # a suffix of a known n-gram is known
            below = np.exp(m.logp[order - 1][np.searchsorted(m.keys[order - 1], k & ((1 << (BITS * (order - 1))) - 1))].astype(float))
        m.keys[order], m.contexts[order] = k, ctx
        m.logp[order] = np.log(np.maximum(c - d, 0) / total[here] + lam[here] * below).astype(np.float32)
        m.weight[order] = np.log(lam).astype(np.float32)
    return m


def fit(langs: list[str], counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    return Model(langs, [fit_one(*counted[x]) for x in langs])


def _hash(seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed)), F.lit(1 << 30))


def train(docs: DataFrame, docs_per: int = DOCS, held_docs: int = HELD, most: int = MOST) -> Model | None:
    """From rows docs(doc_id, text, lang); rows without text or language are left out.

    One row in eight is left out of the counts, for calibration on held_docs of them at most; a language whose sampled rows
    that leaves without a counted letter is counted on all of them. Above `most` distinct n-grams those of the least counts go
    (1,000 and more are alike), and of those at the limit a share that a hash chooses."""
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    rows = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), F.min(_hash(11)).alias("_least"))
    langs = rows.count()
    per = max(1, min(docs_per, TOTAL // max(1, langs)))
    of = docs.join(F.broadcast(rows) if langs <= 10_000 else rows, "lang")
    few = of.filter((_hash(11) < per / F.col("_n") * (1 << 30)) | (_hash(11) == F.col("_least")))
    few = few.select("doc_id", "text", "lang", (F.pmod(_hash(12), F.lit(8)) == 0).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple, list] = {}
        for b in batches:
            who = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            for one in set(who):
                data, offs = strings(b.column(0).filter(pa.array([w == one for w in who])))
                for i, j in chunks(offs):
                    key, _ = grams(*coded(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                    parts.setdefault(one, []).append(np.unique(key, return_counts=True))
                if len(parts[one]) > 64:
                    parts[one] = [_together(parts[one])]
        for (lang, held), p in parts.items():
            key, n = _together(p)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array([held] * len(key)), pa.array(key), pa.array(n)], ["lang", "held", "k", "n"])

    found = few.select("text", "lang", "held").mapInArrow(run, "lang string, held boolean, k bigint, n bigint")
    got = through_parquet(found.groupBy("lang", "k").agg(F.coalesce(F.sum(F.when(~F.col("held"), F.col("n"))), F.lit(0)).alias("n"), F.sum("n").alias("every")))
    per_lang = got.groupBy("lang").agg(F.sum(F.when(F.col("k") > 0, F.col("n")).otherwise(0)).alias("own"), F.count(F.lit(1)).alias("kinds")).collect()
    rest = sorted(r.lang for r in per_lang if not r.own)
    if rest:
        got = got.withColumn("n", F.when(F.col("lang").isin(rest), F.col("every")).otherwise(F.col("n")))
    got = got.filter("n > 0").select("lang", "k", "n")
    if sum(r.kinds for r in per_lang) > most:
        room, times = most, F.least("n", F.lit(1000))
        for r in sorted(got.groupBy(times.alias("n")).count().collect(), reverse=True):
            if r["count"] > room:  # of those counted so often a share has room, chosen by hash
                chosen = F.pmod(F.xxhash64("lang", "k"), F.lit(1 << 30)) < int(room / r["count"] * 0.99 * (1 << 30))
                got = got.filter((times > r.n) | ((times == r.n) & chosen))
                break
            room -= r["count"]
    parts: dict[str, Language] = {}
    for some in _groups({r.lang: r.kinds for r in per_lang}):
        t = got.filter(F.col("lang").isin(some)).toArrow()
        t = t.set_column(0, "lang", t.column("lang").combine_chunks().dictionary_encode()).combine_chunks()
        lang = t.column("lang").combine_chunks()
        code, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
        k, n = t.column("k").to_numpy(), t.column("n").to_numpy()
        for x, name in enumerate(names):
            mine = np.flatnonzero(code == x)
            mine = mine[np.argsort(k[mine])]
            parts[name] = fit_one(k[mine], n[mine])
    if not parts:
        return None
    m = Model(sorted(parts), [parts[x] for x in sorted(parts)])
    held = few.filter(F.col("held") & ~F.col("lang").isin(rest))
    calibrate(m, held.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(held_docs).select("text", "lang").toPandas())
    return m


def _together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)


def _groups(sizes: dict[str, int], most: int = AT_ONCE) -> list[list[str]]:
    """Names in runs of `most` together, about; a larger one stands alone."""
    out: list[list[str]] = []
    held = most + 1
    for name in sorted(sizes):
        if held + sizes[name] > most:
            out.append([])
            held = 0
        out[-1].append(name)
        held += sizes[name]
    return out


def confidence(h: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    """Share of the best language, from cross-entropies and numbers of letters."""
    z = -(h - h.min(1, keepdims=True)) * np.sqrt(np.maximum(n, 1))[:, None] * temperature
    e = np.exp(z)
    return e.max(1) / e.sum(1)


def calibrate(m: Model, held: pd.DataFrame) -> None:
    """Temperature of least log loss and the rejection threshold, on documents that were not counted."""
    if held.empty:
        return
    raw = [t.encode() for t in held["text"]]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    h, n = m.entropies(data, offs)
    own = np.array([m.langs.index(x) if x in m.langs else -1 for x in held["lang"]])
    ok = (n > 0) & (own >= 0)
    if not ok.any():
        return
    h, n, own = h[ok], n[ok], own[ok]
    right = h.argmin(1) == own

    def loss(t: float) -> float:
        p = np.clip(confidence(h, n, t), 1e-6, 1 - 1e-6)
        return float(-np.log(np.where(right, p, 1 - p)).mean())

    m.temperature = min((0.1, 0.2, 0.4, 0.7, 1.0, 1.5, 2.0, 3.0), key=loss)
    least = h.min(1)
    m.usual = float(np.average(least, weights=n))
    m.reject = float(np.quantile((least - m.usual) * np.sqrt(n), 1 - REJECTED))


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected. Narrow; the model (bounded by the sample) is sent once."""
    docs = without(docs, "lang_pred", "score", "cross_entropy", "rejected")
    names, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)
    i = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if m is None:
                und = ["und"] * len(b)
                extra = [pa.array(und), pa.array([0.0] * len(b)), pa.nulls(len(b), pa.float64()), pa.array([True] * len(b))]
            else:
                h, n = m.entropies(*strings(b.column(i)))
                none = n == 0
                pred = np.where(none, "und", np.array(m.langs, object)[h.argmin(1)])
                least = h.min(1)
                extra = [pa.array(pred, pa.string()), pa.array(np.where(none, 0.0, confidence(h, n, m.temperature))), pa.array(least, mask=none), pa.array(none | m.rejects(least, n))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*names, "lang_pred", "score", "cross_entropy", "rejected"])

    more = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("rejected", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in more)]))
