"""Best-fit packing of tokenized documents into sequences, by bin completion.

A document is its token ids and one end id. One longer than a sequence is cut from the end into whole sequences, so its
first piece may be shorter; others stay whole. How pieces are packed depends on their lengths alone, so the plan is made
for the histogram of lengths (as many numbers as a sequence has tokens, whatever the number of documents) and its bins are
patterns with a number of times: `plan` starts from best-fit decreasing, then a branch and bound goes over fillings of
the bin of the largest length that is left. Fillings that another one dominates (a length in place of others of no greater
sum) are not tried, a branch ends where its waste exceeds what a better plan may waste, and a plan that meets the lower
bound ends the search. Otherwise NODES fillings end it, with the best plan so far: a bound on time, never on documents.

Pieces are then numbered by length and a hash (sorted by ranges), and the k-th piece of a length takes the k-th place that
the plan has for it: a lookup in a table of places, whose size depends on the length of a sequence alone.

Edge cases: null and empty texts are the end id alone, one token; texts of any length are encoded whole; repeated rows and
null doc_ids are documents of their own; ties are settled by hash, then doc_id and piece; an empty table gives no rows;
further columns do not matter."""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.bytesview import strings
from veilframe.session import numbered, through_parquet

CAPACITY = 1_024
NODES = 20_000  # fillings that the search tries
WIDTH = 6  # fillings of one bin that it tries at most
SLAB = 1 << 22  # characters that are encoded at once, about
CACHE_BYTES = 160 << 20  # of ids of known stretches in a worker's memory, about
ENTRY = 190  # bytes that a cache entry takes beside its characters and ids


# Token ids

_ENDS, _DOUBLE = (" ", "\n"), ("  ", "\n\n", " \n", "\n ")
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
_MARK = np.array([chr(i) in ".,;:!?#*$%&\"()" for i in range(256)])


class Coder:
    """Ids by a tokenizer file, kept for stretches of text.

    The byte-level pattern puts a single space to what follows it and a single line end by itself, and no match goes on from
    a letter or digit to punctuation. Texts are cut there, so no match spans two stretches. Texts with other white space, or with the string of an added token, are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.other = re.compile("[\\0\u180e\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        self.line = self.whole(["\n"])[0]
        self.known: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.known, self.held = {"": b"", "\n": self.line}, 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def uneasy(self, t: str) -> bool:
        """Whether a text has white space other than single spaces and line ends between other characters, or an added token."""
        return t[:1] in _ENDS or t[-1:] in _ENDS or any(x in t for x in _DOUBLE) or any(a in t for a in self.added) or self.other(t) is not None

    def learn(self, new: list[str]) -> None:
        """Ids of stretches, all in one call: a line end between two of them is a token by itself, which no stretch has."""
        ids = np.array(self.model.encode_batch_fast(["\n".join(new)], add_special_tokens=False)[0].ids, "<u4")
        cut = np.flatnonzero(ids == int.from_bytes(self.line, "little"))
        flat, starts, ends = ids.tobytes(), (4 * np.append(0, cut + 1)).tolist(), (4 * np.append(cut, len(ids))).tolist()
        self.known.update(zip(new, map(flat.__getitem__, map(slice, starts, ends)), strict=True))
        self.held += ENTRY * len(new) + sum(map(len, new)) + len(flat)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        whole = [self.uneasy(t) for t in texts]
        rest = iter(self.whole([t for t, w in zip(texts, whole) if w]))
        easy = iter(self._stretches([t.encode() for t, w in zip(texts, whole) if not w]))
        return [next(rest) if w else next(easy) for w in whole]

    def _stretches(self, texts: list[bytes]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self.forget()
        raw, offs = b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        if not raw:
            return [b""] * len(texts)
        data = np.frombuffer(raw, np.uint8)
        line = data == 10
        first = line | (data == 32)
        first[1:] |= line[:-1] | (_MARK[data[1:]] & _ALNUM[data[:-1]])
        first[offs[:-1][offs[1:] > offs[:-1]]] = True
        at = np.flatnonzero(first)
        each = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
        keys, kind = each.dictionary.to_numpy(zero_copy_only=False).tolist(), each.indices.to_numpy()
        if new := [k for k in keys if k not in self.known]:
            self.learn(new)
        coded = list(map(self.known.__getitem__, keys))
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat, begin = np.frombuffer(b"".join(coded), "<u4"), np.cumsum(size) - size
        n = size[kind]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin[kind] - (ends - n), n) + np.arange(ends[-1])].tobytes()
        cut = (4 * np.concatenate([[0], ends])[np.searchsorted(at, offs)]).tolist()
        return [ids[i:j] for i, j in zip(cut, cut[1:])]


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def pieces(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32 and, with ids, the ids (binary, 4 bytes each). Narrow."""
    shape = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, last = coder(path), np.array([end], "<u4").tobytes()
        for b in batches:
            size = np.diff(strings(b.column(1))[1])
            group = np.cumsum(size) // SLAB
            for g in np.split(np.arange(len(b)), np.flatnonzero(np.diff(group)) + 1):
                if not len(g):
                    continue
                rows = b.slice(g[0], len(g))
                got: list[list] = [[], [], [], [], [], []]
                for doc, coded in zip(rows.column(0).to_pylist(), c.encode([t or "" for t in rows.column(1).to_pylist()])):
                    coded += last
                    n = len(coded) // 4
                    cut = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (i, j) in enumerate(zip(cut, cut[1:])):
                        part = coded[4 * i : 4 * j]
                        for col, v in zip(got, (doc, k, i, j - i, zlib.crc32(part), part)):
                            col.append(v)
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary()][: 5 + ids]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, shape)


# The plan, from the histogram of lengths

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it), lengths falling


@dataclass
class Plan:
    capacity: int
    bins: list[tuple[Pattern, int]] = field(default_factory=list)  # patterns and how often each is used

    @property
    def sequences(self) -> int:
        return sum(m for _, m in self.bins)

    def places(self) -> np.ndarray:
        """Rows (length, first rank, ranks, bins, first sequence, offset) by length and rank: of the pieces of a length, those
        from the first rank on go to the bins in turn, the next round of them behind the one before."""
        out, rank, at = [], defaultdict(int), 0
        for pattern, m in self.bins:
            offset = 0
            for length, k in pattern:
                out.append((length, rank[length], m * k, m, at, offset))
                rank[length] += m * k
                offset += length * k
            at += m
        return np.array(sorted(out), np.int64).reshape(-1, 6)


def least_bins(count: dict[int, int], capacity: int) -> int:
    """A lower bound: for each threshold t up to half, lengths above capacity - t stand alone and the rest of at least t can
    only use what room lengths above half leave."""
    lengths = np.array(sorted(count), np.int64)
    number = np.array([count[x] for x in lengths.tolist()], object)
    best = -(-int((lengths.astype(object) * number).sum()) // capacity) if len(lengths) else 0
    for t in [x for x in lengths.tolist() if 2 * x <= capacity]:
        alone = int(number[lengths > capacity - t].sum())
        mid = (lengths > capacity // 2) & (lengths <= capacity - t)
        low = (lengths >= t) & (lengths <= capacity // 2)
        room = capacity * int(number[mid].sum()) - int((lengths[mid].astype(object) * number[mid]).sum())
        over = int((lengths[low].astype(object) * number[low]).sum()) - room
        best = max(best, alone + int(number[mid].sum()) + max(0, -(-over // capacity)))
    return best


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing for a histogram: lengths fall, and each piece goes to the fullest bin that has room for it.

    A bin of room g that is the fullest with room takes g // length pieces in a row, so equal bins are filled together."""
    open_: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)  # by room
    for length in sorted(count, reverse=True):
        left = count[length]
        for room in sorted(g for g in open_ if g >= length):
            each, same = room // length, open_.pop(room)
            for i, (pattern, m) in enumerate(same):
                full = min(m, left // each)
                part = left - full * each if full < m else 0
                for k, times in ((each, full), (part, 1 if part else 0), (0, m - full - (1 if part else 0))):
                    if times:
                        open_[room - k * length].append((pattern + ((length, k),) if k else pattern, times))
                left -= full * each + part
                if not left:
                    open_[room] += same[i + 1 :]
                    break
            if not left:
                break
        each = capacity // length
        for k, times in ((each, left // each), (left % each, 1)):
            if k and times:
                open_[capacity - k * length].append((((length, k),), times))
    return [x for same in open_.values() for x in same]


def fillings(room: int, lengths: list[int], count: dict[int, int], waste: int, most: int, steps: list[int]) -> list[Pattern]:
    """Undominated ways to fill `room` from the lengths (falling), least waste first, `most` at most; each wastes `waste` at
    most. steps[0] is what the search may still spend."""
    found: list[tuple[int, Pattern]] = []
    low = lengths[-1] if lengths else 0

    def go(i: int, room: int, chosen: Pattern) -> None:
        if len(found) >= most or steps[0] <= 0:
            return
        steps[0] -= 1
        while i < len(lengths) and lengths[i] > room:
            i += 1
        if i == len(lengths):
            if room <= waste:
                found.append((room, chosen))
            return
        for j in range(i, len(lengths)):
            x = lengths[j]
            if room >= x and (rest := count[x]):
                for k in range(min(rest, room // x), 0, -1):
                    # what follows is shorter than x: a remainder that x would still fit is dominated by one more x
                    if k < min(rest, room // x) and j + 1 == len(lengths):
                        continue
                    go(j + 1, room - k * x, (*chosen, (x, k)))
                    if found and found[-1][0] == 0 and len(found[-1][1]) == len(chosen) + 1 and k == 1 and room == x:
                        return  # one length fills the room: it dominates all that could follow
            if len(found) >= most or steps[0] <= 0:
                return
        if room < low and room <= waste:
            found.append((room, chosen))

    go(0, room, ())
    kept: list[tuple[int, Pattern]] = []
    for w, p in sorted(set(found), key=lambda f: (f[0], [-x for x, _ in f[1]])):
        if not any(dominates(q, p) for _, q in kept):
            kept.append((w, p))
    return [p for _, p in kept]


def dominates(a: Pattern, b: Pattern) -> bool:
    """Whether b's lengths can be dealt to a's so that none of a's holds more than its length: a is then no worse than b.
    Dealt greedily, longest first, so true is always right."""
    rooms = [x for x, k in a for _ in range(k)]
    for x in (x for x, k in b for _ in range(k)):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if not fits:
            return False
        rooms[min(fits, key=rooms.__getitem__)] -= x
    return True


def plan(count: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH) -> Plan:
    """The plan of fewest sequences that the search finds for count[length]; `sequences` of it equal the lower bound, or no
    plan has fewer, unless `nodes` ended the search."""
    count = {k: v for k, v in count.items() if v}
    whole = count.pop(capacity, 0)
    done = [(((capacity, 1),), whole)] if whole else []
    best, bound = best_fit(count, capacity), least_bins(count, capacity)
    used, total, steps = sum(m for _, m in best), sum(k * v for k, v in count.items()), [nodes * 20]
    # one frame a bin: what is left before it, waste and bins so far, choices that are still to be tried
    stack = [[count, 0, 0, None, []]]
    while stack and used > bound and nodes > 0 and steps[0] > 0:
        left, waste, bins, choices, taken = stack[-1]
        allowed = (used - 1) * capacity - total  # waste of a better plan
        if choices is None:
            lengths = sorted(left, reverse=True)
            if not lengths:
                if bins < used:
                    used, best = bins, [x for f in stack for x in f[4]]
                stack.pop()
                continue
            first = lengths[0]
            after = {**left, first: left[first] - 1}
            after = {k: v for k, v in after.items() if v}
            rest = sorted(after, reverse=True)
            ways = fillings(capacity - first, rest, after, allowed - waste, width, steps) or ([()] if capacity - first <= allowed - waste and not any(x <= capacity - first for x in rest) else [])
            choices = []
            for way in ways:
                pattern: Pattern = _with(way, first)
                times = min(left[x] // k for x, k in pattern)
                choices += [(pattern, t) for t in dict.fromkeys((times, 1))]
            stack[-1][3] = choices = choices[::-1]
        if not choices:
            stack.pop()
            continue
        pattern, times = choices.pop()
        nodes -= 1
        lost = waste + times * (capacity - sum(x * k for x, k in pattern))
        if lost > allowed or bins + times >= used:
            continue
        nxt = {x: v - times * dict(pattern).get(x, 0) for x, v in left.items()}
        stack[-1][4] = [(pattern, times)]
        stack.append([{k: v for k, v in nxt.items() if v}, lost, bins + times, None, []])
    return Plan(capacity, done + best)


def _with(way: Pattern, first: int) -> Pattern:
    return ((first, way[0][1] + 1), *way[1:]) if way and way[0][0] == first else ((first, 1), *way)


# Places of the pieces


def packed(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """The pieces of docs(doc_id, text) with sequence_id and offset. The pieces are written once, without texts."""
    every = through_parquet(pieces(docs, path, end, capacity, ids))
    count = {r.length: r["count"] for r in every.groupBy("length").count().collect()}  # `capacity` rows at most
    found = plan(count, capacity)
    places = found.places()
    sizes = sorted(count)
    before = dict(zip(sizes, np.cumsum([0, *(count[s] for s in sizes)]).tolist()))  # pieces shorter than each length
    first = places[:, 1] + np.array([before[x] for x in places[:, 0].tolist()], np.int64)
    order = np.argsort(first)
    shared = docs.sparkSession.sparkContext.broadcast((first[order], places[order]))
    rows = numbered(every.withColumn("_at", F.xxhash64("doc_id", "piece", "ids_crc32")), "_n", "length", "_at", "doc_id", "piece").drop("_at")
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, places = shared.value
        for b in batches:
            n = b.column(len(names)).to_numpy()
            at = np.searchsorted(first, n, "right") - 1
            rank = n - first[at]
            length, _, _, bins, seq, offset = places[at].T
            extra = [pa.array(seq + rank % np.maximum(1, bins)), pa.array(offset + rank // np.maximum(1, bins) * length)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *extra], [*names, "sequence_id", "offset"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{shape}, sequence_id bigint, offset bigint")


def sequences(pieces_: DataFrame) -> DataFrame:
    """The sequences themselves, from packed(ids=True): sequence_id, ids (array<int>), doc_ids (of its pieces, in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(x), "<i4") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), b.column(2)], ["sequence_id", "ids", "doc_ids"])

    parts = pieces_.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return parts.select("sequence_id", "p.ids", "p.doc_id").mapInArrow(run, "sequence_id bigint, ids array<int>, doc_ids array<bigint>")
