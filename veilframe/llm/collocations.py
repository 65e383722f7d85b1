"""Phrase collocations: phrases of 2 to 5 words that occur often, scored against the parts that they fall into.

Every n-gram has a key of 128 bits: of each distinct word a keyed hash, multiplied by odd numbers that depend on its place,
summed, and one for the language added. The key is drawn for the job. Passes, narrow but for sums of arrays:

1. Filters by Apriori: for orders 1, 2 and 3 to 5 mappers count keys in hashed buckets, at places where all shorter filters
   hold; a bucket's counts stop at `least`. An n-gram that is frequent has a frequent bucket, and so have all of its parts.
   After the first filter texts are read once more, and what may be in a phrase is written as numbered words, by language;
   the other passes read that.
2. Candidates: the distinct n-grams that pass all filters, with their words. So that not every task hands out the same ones,
   a task hands out one in the root of the tasks, chosen by hash; then tasks hand out those that nobody did.
3. Counts: a minimal perfect hash (levels of bits with ranks, some 4 bits a key) over SLOTS candidates at a time; a slot's
   stored key must equal the n-gram's. Mappers bincount slots into an array. More candidates take more passes, not more memory.
4. Cuts: the parts of a frequent phrase are frequent, so both counts of each cut are read by slot.

Arrays are summed in a tree: mappers hand out segments, about the root of the tasks sum theirs, one task a segment the rest.
What the driver sees and broadcasts is bounded: filters of 2**MOST_BITS bits and the keys and counts of SLOTS candidates.
Scores are worked out in whole numbers of any size.

Edge cases: null texts are empty; a null language is `und`, as is that name; words are bytes between the separators, so
other white space is part of a word; repeated rows count again; texts of any length are read whole; overlapping occurrences
count; ties go by count, then the phrase's bytes; an empty table gives no rows; further columns do not matter."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.bytesview import chunks, mix, strings
from veilframe.session import through_parquet

LONGEST = 5  # words of a phrase
LEVELS = ((1,), (2,), (3, 4, 5))  # orders that share a filter
LEAST_BITS, MOST_BITS = 24, 27  # of the number of a filter's buckets, which grows with the characters of the input
CHARS = 64  # characters a bucket, about, within those bounds
SEGMENT = 1 << 16  # bytes of an array that travel together
SLOTS = 1 << 20  # candidates that are counted in one pass
ONE_IN = 32  # candidates of which a task hands out one at least
CHUNK = 1 << 21  # bytes of text that are worked on at once, about
PER_TASK = 50_000  # phrases that one task ranks, about

GAP = -1
_STREAM = "lang string, n bigint, vocabulary binary, which binary"
_KIND = np.zeros(256, np.uint8)  # 0 word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]], _KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Hashing:
    """Keys of n-grams as two columns of 64 bits, under the key of a job."""

    def __init__(self, key: bytes):
        self.key = key
        raw = hashlib.shake_256(b"places" + key).digest(16 * LONGEST)
        self.odd = np.frombuffer(raw, np.uint64).reshape(LONGEST, 2) | np.uint64(1)

    def of(self, items: list[bytes], what: bytes = b"w") -> np.ndarray:
        raw = b"".join(hashlib.blake2b(x, digest_size=16, key=self.key, person=what).digest() for x in items)
        return np.frombuffer(raw, np.uint64).reshape(-1, 2)

    def keys(self, lang: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Keys of phrases of one length: lang (phrases x 2), words (phrases x length x 2)."""
        return lang + (words * self.odd[None, : words.shape[1]]).sum(1)


@dataclass
class Words:
    """Words of one language; n-grams span none that is GAP."""

    lang: str
    vocabulary: list[bytes]
    which: np.ndarray  # index of each word in it, or GAP
    hashes: np.ndarray  # of the vocabulary
    n: int  # words in the texts that this comes from

    @classmethod
    def of(cls, texts: pa.Array, langs: pa.Array, hashing: Hashing) -> Iterator[Words]:
        """The words of a batch of texts, a gap after each piece."""
        data, offs = strings(texts)
        names = langs.fill_null("und").dictionary_encode()
        every, of_row = names.dictionary.to_pylist(), names.indices.to_numpy()
        for i, j in chunks(offs, CHUNK):
            part, at = _LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
            kind = _KIND[part]
            inside = kind == 0
            head = inside.copy()
            head[1:] &= ~inside[:-1]
            full = at[:-1][np.diff(at) > 0]
            head[full] = inside[full]
            starts = np.flatnonzero(head)
            if not len(starts):
                continue
            row = np.searchsorted(at, starts, "right") - 1
            piece = np.searchsorted(np.flatnonzero(kind == 2), starts) + row  # grows from piece to piece, and from text to text
            size = np.add.reduceat(inside, starts, dtype=np.int32)
            text = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(part[inside])])
            words = text.dictionary_encode()
            vocabulary, which = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
            hashes, lang = hashing.of(vocabulary), of_row[i:j][row]
            for k in np.unique(lang).tolist():
                mine = np.flatnonzero(lang == k)
                ends = np.flatnonzero(np.diff(piece[mine])) + 1
                yield cls(every[k], vocabulary, np.insert(which[mine], ends, GAP), hashes, len(mine))

    @classmethod
    def read(cls, b: pa.RecordBatch, hashing: Hashing) -> Iterator[Words]:
        """From rows that `row` has made."""
        for lang, words, which in zip(*(b.column(c).to_pylist() for c in ("lang", "vocabulary", "which")), strict=True):
            vocabulary = words.split(b" ") if which else []
            kind = np.uint16 if len(vocabulary) < 1 << 16 else np.uint32
            yield cls(lang, vocabulary, np.frombuffer(which, kind).astype(np.int64) - 1, hashing.of(vocabulary), 0)

    def row(self, keep: np.ndarray) -> tuple[str, int, bytes, bytes]:
        """lang, n, vocabulary and which as bytes, of the words of the vocabulary that are to be kept; runs of others are a gap."""
        keep = np.append(keep, False)  # the last one is for GAP
        which = np.where(keep[self.which], self.which, GAP)
        which = which[(which != GAP) | (np.append(GAP, which[:-1]) != GAP)]
        seen = np.unique(which[which != GAP])
        new = np.zeros(len(keep), np.int64)
        new[seen] = np.arange(1, len(seen) + 1)
        kind = np.uint16 if len(seen) < 1 << 16 else np.uint32
        return self.lang, self.n, b" ".join(self.vocabulary[k] for k in seen.tolist()), new[which].astype(kind).tobytes()

    def phrases(self, hashing: Hashing, filters: dict[int, Filter], orders: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(order, places, keys) of the n-grams whose parts and, where there is a filter for their order, they themselves pass."""
        alive = self.which != GAP
        key = np.tile(hashing.of([self.lang.encode()], b"lang"), (len(alive), 1))
        for order in range(1, orders + 1):
            if order > 1:
                alive[:-1] &= alive[1:]
                alive[-1:] = False
            at = np.flatnonzero(alive)
            key[at] += self.hashes[self.which[at + order - 1]] * hashing.odd[order - 1]
            got = key[at]
            if order in filters:
                ok = filters[order].has(got)
                alive[at[~ok]] = False
                at, got = at[ok], got[ok]
            yield order, at, got


@dataclass
class Filter:
    bits: int
    packed: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        b = buckets(keys, self.bits)
        return (self.packed[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1


def buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys[:, 0] >> np.uint64(64 - bits)).astype(np.int64)


class Slots:
    """A minimal perfect hash of distinct keys with the keys by slot.

    Level by level, keys that meet no other one in a table of twice as many bits as keys set their bit; the others go on to
    the next level. A key's slot is the number of bits set before its own."""

    def __init__(self, keys: np.ndarray):
        left, self.levels, base = np.arange(len(keys)), [], 0
        slot = np.zeros(len(keys), np.int64)
        while len(left):
            size = 64 * (1 + len(left) // 32)
            h = self._at(keys[left], len(self.levels), size)
            alone = np.bincount(h, minlength=size)[h] == 1
            bits = np.zeros(size, bool)
            bits[h[alone]] = True
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            ranks = base + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
            self.levels.append((size, words, ranks))
            slot[left[alone]] = self._rank(words, ranks, h[alone])
            base += int(alone.sum())
            left = left[~alone]
        self.keys = np.empty_like(keys)
        self.keys[slot] = keys

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys[:, 0] ^ mix(keys[:, 1] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64)))) % np.uint64(size)).astype(np.int64)

    @staticmethod
    def _rank(words: np.ndarray, ranks: np.ndarray, h: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (h & 63).astype(np.uint64)) - np.uint64(1)
        return ranks[h >> 6] + np.bitwise_count(words[h >> 6] & below)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the key stored there is another one."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            h = self._at(keys[left], level, size)
            hit = (words[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[hit]] = self._rank(words, ranks, h[hit])
            left = left[~hit]
            if not len(left):
                break
        known = out >= 0
        out[known] = np.where((self.keys[out[known]] == keys[known]).all(1), out[known], -1)
        return out


# Sums of arrays


def summed(docs: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind: str, most: int | None, then: Callable[[np.ndarray], np.ndarray], done: str) -> dict[int, np.ndarray]:
    """then(sums) by segment, of the arrays that count() makes from each partition of docs; sums stop at `most`, if given.

    Two levels of sums: a task adds about as many arrays as the root of their number."""
    fan = max(1, int(np.ceil(np.sqrt(docs.rdd.getNumPartitions()))))
    each = SEGMENT // np.dtype(kind).itemsize

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        whole, branch = count(batches), TaskContext.get().partitionId() % fan
        for k in range(0, len(whole), each):
            if whole[k : k + each].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // each], pa.int32()), pa.array([branch], pa.int32()), pa.array([whole[k : k + each].tobytes()])], ["segment", "branch", "part"])

    def total(t: pa.Table) -> np.ndarray:
        parts = t.column("part").to_pylist()
        out = np.zeros(len(parts[0]) // np.dtype(kind).itemsize if parts else 0, np.int64)
        for p in parts:
            out += np.frombuffer(p, kind)
        return (out if most is None else np.minimum(out, most)).astype(kind)

    def row(t: pa.Table, a: np.ndarray) -> pa.Table:
        return pa.table([pa.array(t.column(c)[:1], pa.int32()) for c in ("segment", "branch")] + [pa.array([a.tobytes()] * min(1, len(t)), pa.binary())], ["segment", "branch", "part"])

    shape = "segment int, branch int, part binary"
    first = docs.mapInArrow(local, shape).groupBy("segment", "branch").applyInArrow(lambda t: row(t, total(t)), shape)
    last = first.groupBy("segment").applyInArrow(lambda t: row(t, then(total(t))), shape)
    return {r.segment: np.frombuffer(bytes(r.part), done) for r in last.collect()}


def _chunks(batches: Iterator[pa.RecordBatch], hashing: Hashing) -> Iterator[Words]:
    """Words of texts (columns text, lang) or of what `_stream` has written."""
    for b in batches:
        yield from Words.read(b, hashing) if "which" in b.schema.names else Words.of(b.column(0), b.column(1), hashing)


def _filter(docs: DataFrame, hashing: Hashing, filters: dict[int, Filter], orders: tuple[int, ...], bits: int, least: int) -> Filter:
    """Buckets of n-grams of these orders that are counted `least` times or more."""
    kind, shared = ("uint8" if least < 256 else "uint32"), docs.sparkSession.sparkContext.broadcast(filters)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out, held, size = np.zeros(1 << bits, kind), [], 0

        def add() -> None:
            b, n = np.unique(np.concatenate(held), return_counts=True)
            out[b] = np.minimum(out[b].astype(np.int64) + n, least)

        for w in _chunks(batches, hashing):
            for order, _, keys in w.phrases(hashing, shared.value, max(orders)):
                if order in orders:
                    held.append(buckets(keys, bits).astype(np.int32))
                    size += len(keys)
            if size > 1 << 21:
                add()
                held, size = [], 0
        if held:
            add()
        return out

    packed = np.zeros(1 << (bits - 3), np.uint8)
    each = SEGMENT // np.dtype(kind).itemsize // 8
    for k, part in summed(docs, count, kind, least, lambda a: np.packbits(a >= least), "uint8").items():
        packed[k * each : k * each + len(part)] = part
    return Filter(bits, packed)


def _stream(docs: DataFrame, hashing: Hashing, filters: dict[int, Filter]) -> DataFrame:
    """Rows of numbered words that pass the filter of order 1, written once."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _chunks(batches, hashing):
            keys = hashing.of([w.lang.encode()], b"lang") + w.hashes * hashing.odd[0]
            cols = zip(w.row(shared.value[1].has(keys)), (pa.string(), pa.int64(), pa.binary(), pa.binary()))
            yield _batch([pa.array([v], t) for v, t in cols], ["lang", "n", "vocabulary", "which"])

    return through_parquet(docs.mapInArrow(run, _STREAM))


_CANDIDATE = "a bigint, b bigint, lang string, words int, phrase string"


def _handed_out(stream: DataFrame, hashing: Hashing, filters: dict[int, Filter], mine: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """The distinct n-grams that pass, of those the ones for which mine(keys, task) holds."""
    shared = stream.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, task = np.zeros((0, 2), np.uint64), TaskContext.get().partitionId()
        for w in _chunks(batches, hashing):
            got = [(np.full(len(at), order), at, keys) for order, at, keys in w.phrases(hashing, shared.value)]
            order, at, keys = (np.concatenate(x) for x in zip(*got))
            ok = mine(keys, task)
            order, at, keys = order[ok], at[ok], keys[ok]
            held = len(seen)
            seen, first = _unique(np.concatenate([seen, keys]))
            new = first[first >= held] - held
            which = w.which.tolist()
            phrase = [b" ".join([w.vocabulary[v] for v in which[i : i + n]]) for i, n in zip(at[new].tolist(), order[new].tolist())]
            lanes = keys[new].view(np.int64)
            cols = [pa.array(lanes[:, 0]), pa.array(lanes[:, 1]), pa.array([w.lang] * len(new), pa.string()), pa.array(order[new].astype(np.int32)), pa.array(phrase, pa.binary()).cast(pa.string())]
            yield _batch(cols, ["a", "b", "lang", "words", "phrase"])

    return stream.mapInArrow(run, _CANDIDATE).distinct()


def _candidates(stream: DataFrame, hashing: Hashing, filters: dict[int, Filter], slots: int) -> DataFrame:
    """The distinct n-grams that pass all filters."""
    tasks, sc = stream.rdd.getNumPartitions(), stream.sparkSession.sparkContext
    one_in = np.uint64(min(ONE_IN, max(1, round(tasks**0.5))))

    def chosen(keys: np.ndarray, task: int) -> np.ndarray:
        return mix(keys[:, 0] ^ mix(np.uint64([task + 1]))) % one_in == 0

    every = through_parquet(_handed_out(stream, hashing, filters, chosen))
    if one_in == 1:
        return every
    shards, out = max(1, -(-every.count() // slots)), every
    for s in range(shards):
        known = sc.broadcast(Slots(_lanes(_shard(every, s, shards).select("a", "b").toArrow())))

        def left(keys: np.ndarray, task: int, s: int = s, known=known) -> np.ndarray:
            ok = keys[:, 0].view(np.int64) % shards == s
            ok[ok] = known.value.of(keys[ok]) < 0
            return ok

        out = out.unionByName(through_parquet(_handed_out(stream, hashing, filters, left)))
    return out


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the first place of each."""
    order = np.lexsort((np.arange(len(keys)), keys[:, 1], keys[:, 0]))
    ahead = np.ones(len(keys), bool)
    ahead[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
    first = order[ahead]
    return keys[first], first


def _batch(cols: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(cols, names)


def _lanes(t: pa.Table) -> np.ndarray:
    """Keys in columns a and b."""
    return np.stack([t.column(c).to_numpy() for c in ("a", "b")], 1).view(np.uint64)


def _shard(df: DataFrame, shard: int, shards: int) -> DataFrame:
    return df.filter(F.pmod("a", F.lit(shards)) == shard) if shards > 1 else df


def counted(stream: DataFrame, candidates: DataFrame, n: int, hashing: Hashing, filters: dict[int, Filter], slots: int = SLOTS) -> DataFrame:
    """candidates (n rows) with their exact counts f; `slots` of them, about, in each pass over the words."""
    sc, shards, out = stream.sparkSession.sparkContext, max(1, -(-n // slots)), []
    for s in range(shards):
        mine = _shard(candidates, s, shards)
        table = Slots(_lanes(mine.select("a", "b").toArrow()))
        shared = sc.broadcast((table, filters))
        size = len(table.keys)

        def count(batches: Iterator[pa.RecordBatch], shared=shared, size=size) -> np.ndarray:
            table, filters = shared.value
            total = np.zeros(size, np.int64)
            for w in _chunks(batches, hashing):
                for _, _, keys in w.phrases(hashing, filters):
                    at = table.of(keys)
                    total += np.bincount(at[at >= 0], minlength=size)
            return total

        got, each = np.zeros(size, np.int64), SEGMENT // 8
        for k, part in summed(stream, count, "int64", None, lambda a: a, "int64").items():
            got[k * each : k * each + len(part)] = part
        read = sc.broadcast((table, got))

        def run(batches: Iterator[pa.RecordBatch], read=read) -> Iterator[pa.RecordBatch]:
            table, got = read.value
            for b in batches:
                f = got[table.of(_lanes(pa.Table.from_batches([b])))]
                yield _batch([*b.columns, pa.array(f)], [*b.schema.names, "f"])

        out.append(mine.mapInArrow(run, f"{_CANDIDATE}, f bigint"))
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return through_parquet(every)


def _part_keys(b: pa.RecordBatch, hashing: Hashing) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """For each length of phrases and each cut of it: their rows, the words in front, keys of both parts."""
    count = b.column(b.schema.get_field_index("words")).to_numpy()
    phrase = b.column(b.schema.get_field_index("phrase"))
    lang = hashing.of([x.encode() for x in b.column(b.schema.get_field_index("lang")).to_pylist()], b"lang")
    for n in np.unique(count).tolist():
        rows = np.flatnonzero(count == n)
        words = [w for p in phrase.take(pa.array(rows)).to_pylist() for w in p.encode().split(b" ")]
        h = hashing.of(words).reshape(len(rows), n, 2)
        for k in range(1, n):
            yield rows, k, hashing.keys(lang[rows], h[:, :k]), hashing.keys(lang[rows], h[:, k:])


def with_cuts(phrases: DataFrame, often: DataFrame, n: int, hashing: Hashing, slots: int = SLOTS) -> DataFrame:
    """phrases with ls and rs: counts of the parts of each cut, read by slot from often(a, b, f), n rows, `slots` at a time."""
    sc, shards, out = phrases.sparkSession.sparkContext, max(1, -(-n // slots)), phrases
    for s in range(shards):
        t = _shard(often, s, shards).select("a", "b", "f").toArrow()
        table = Slots(_lanes(t))
        f = np.zeros(len(t) + 1, np.int64)  # the last one is for no slot
        f[table.of(_lanes(t))] = t.column("f").to_numpy()
        shared = sc.broadcast((table, f))
        names = out.columns if s else [*out.columns, "ls", "rs"]

        def run(batches: Iterator[pa.RecordBatch], shared=shared, s=s, names=names) -> Iterator[pa.RecordBatch]:
            table, f = shared.value
            for b in batches:
                n = b.column(b.schema.get_field_index("words")).to_numpy()
                both = np.zeros((2, len(b), LONGEST - 1), np.int64)
                for rows, k, *keys in _part_keys(b, hashing):
                    for side in (0, 1):
                        both[side, rows, k - 1] = f[table.of(keys[side])]
                if s:
                    for side, c in enumerate(("ls", "rs")):
                        old = b.column(b.schema.get_field_index(c)).flatten().to_numpy()
                        both[side][np.arange(LONGEST - 1)[None, :] < n[:, None] - 1] += old
                ends = pa.array(np.concatenate([[0], np.cumsum(n - 1)]), pa.int32())
                flat = [pa.ListArray.from_arrays(ends, pa.array(x[np.arange(LONGEST - 1)[None, :] < n[:, None] - 1])) for x in both]
                own = [c for c, x in zip(b.columns, b.schema.names) if x not in ("ls", "rs")]
                yield _batch([*own, *flat], names)

        kinds = [f"{x.name} {x.dataType.simpleString()}" for x in phrases.schema.fields]
        out = out.mapInArrow(run, ", ".join([*kinds, "ls array<bigint>", "rs array<bigint>"]))
        out = through_parquet(out) if shards > 1 else out
    return out


def _scored(phrases: DataFrame) -> DataFrame:
    """l, r and score of the cut that scores least; exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, n, ls, rs = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("a", "n", "ls", "rs"))
            best = [min((1000 * a * m // (x * y), k) for k, (x, y) in enumerate(zip(left, right))) for a, m, left, right in zip(f, n, ls, rs)]
            cols = [b.column(b.schema.get_field_index(c)) for c in ("lang", "words", "phrase", "a", "n")]
            extra = [[x[k] for x, (_, k) in zip(side, best)] for side in (ls, rs)] + [[s for s, _ in best]]
            yield _batch([*cols, *(pa.array(x, pa.int64()) for x in extra)], ["lang", "words", "phrase", "a", "n", "l", "r", "score"])

    return phrases.mapInArrow(run, "lang string, words int, phrase string, a bigint, n bigint, l bigint, r bigint, score bigint")


def mined(docs: DataFrame, least: int = 100, top: int = 2_000, percent: int = 100, text: str = "text", lang: str = "lang", slots: int = SLOTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    A phrase of a occurrences goes where a longer one around it has percent % of them or more. Each longer one is reached by
    adding words one by one, and what lies between occurs no less often, so phrases of one more word tell."""
    spark, hashing = docs.sparkSession, Hashing(secrets.token_bytes(16))
    docs = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (chars // CHARS).bit_length()))
    filters: dict[int, Filter] = {}
    for orders in LEVELS:
        filters |= dict.fromkeys(orders, _filter(docs, hashing, filters, orders, bits, least))
        docs = _stream(docs, hashing, filters) if 1 in orders else docs
    candidates = _candidates(docs, hashing, filters, slots)
    n = candidates.count()
    often = counted(docs, candidates, n, hashing, filters, slots).filter(F.col("f") >= least)
    found = often.filter("words > 1")
    sums = docs.groupBy("lang").agg(F.sum("n").alias("n")).withColumnRenamed("lang", "_l")
    parts = with_cuts(found.select("lang", "words", "phrase", F.col("f").alias("a")), often, often.count(), hashing, slots)
    scored = _scored(parts.join(sums, F.col("lang") == F.col("_l")).drop("_l"))
    less_last, less_first = F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substr(phrase, instr(phrase, ' ') + 1)")
    around = found.filter("words > 2").select("lang", F.explode(F.array(less_last, less_first)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = scored.join(around, ["lang", "phrase"], "left").filter(F.col("f").isNull() | (100 * F.col("f") < percent * F.col("a")))
    kept = through_parquet(kept.select("lang", "phrase", "a", "l", "r", "n", "score"))
    salts = max(1, kept.count() // PER_TASK)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).filter(F.col("_r") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return first.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
