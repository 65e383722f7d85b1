"""Byte-level BPE: texts to token ids and back, with the ranks of a public vocabulary file.

A text is cut by the vocabulary's pattern; each match is merged on its own. Over the byte positions of a match stands a
segment tree whose leaves hold (rank of the pair that starts here, position); an inner node holds the least of its
children, so the root is the leftmost pair of minimum rank. A merge writes three leaves (the pair that grew, the one
before it, the one that vanished) and repairs their paths: logarithmic work a merge. Many distinct matches of one batch
are merged side by side, one tree a row of a matrix; long matches use the same tree in an array of their own.

Memory: texts are encoded in slabs of about SLAB characters, cut where no match can cross; ids of matches are cached up to
CACHE_BYTES a worker, checked before every slab. One match of n bytes takes some 60 n bytes while it is merged.

Edge cases: null or empty text gives no ids; a match that is a token as a whole is that token; text of any length is
encoded whole; repeated rows give repeated results; further columns of the input do not matter."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

NONE = np.int64(1) << 40  # above any (rank, position)
SHIFT = 12  # positions of a short match take fewer bits
SHORT = 64  # longest match in bytes that goes into a matrix
SLAB = 1 << 18  # characters that are encoded at once, about
CACHE_BYTES = 48 << 20  # of ids of known matches and stretches in a worker's memory, about
ENTRY = 220  # bytes that a cache entry takes beside its characters and ids: two objects and its place in the table


class Vocabulary:
    """Ranks by token bytes, with tables for merging and decoding."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.cut = regex.compile(pattern).findall
        top = max(self.rank.values()) + 1
        by = [b""] * top
        for t, r in self.rank.items():
            by[r] = t
        self.start = np.zeros(top + 1, np.int64)
        np.cumsum([len(t) for t in by], out=self.start[1:])
        self.bytes = np.frombuffer(b"".join(by), np.uint8)
        self.single = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self.pair = {}
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    self.pair[a << 20 | b] = r
        keys = np.array(sorted(self.pair), np.int64)
        self.keys, self.ranks = np.append(keys, np.iinfo(np.int64).max), np.array([self.pair[k] for k in keys.tolist()] + [0], np.int64)
        self.known: dict[str, bytes] = {}  # ids by match
        self.spaced: dict[str, bytes] = {}  # ids by stretch between single spaces
        self.held = 0  # bytes of both, about
        self.safe = regex.compile(r"(?<=\S) (?=\S)").search
        self.uneasy = regex.compile(r"\s | \s|^ | $").search

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or NONE."""
        k = a << 20 | b
        at = np.searchsorted(self.keys, k)
        return np.where(self.keys[at] == k, self.ranks[at] << SHIFT, NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of short matches, all in one matrix of trees of equal size."""
        lens = np.array([len(p) for p in pieces])
        n, size = len(pieces), 1 << int(lens.max() - 1).bit_length()
        raw = np.zeros((n, size), np.uint8)
        raw[np.arange(size)[None, :] < lens[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.single[raw]
        nxt = np.tile(np.arange(1, size + 1), (n, 1))
        prv = np.tile(np.arange(-1, size - 1), (n, 1))
        live = np.arange(size)[None, :] < lens[:, None]
        tree = np.full((n, 2 * size), NONE, np.int64)
        pairs = live[:, 1:]
        r = self._pairs(ids[:, :-1][pairs], ids[:, 1:][pairs])
        leaves = tree[:, size : 2 * size - 1]
        leaves[pairs] = r
        leaves += np.where(leaves < NONE, np.arange(size - 1), 0)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])

        def put(rows: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
            k = pos + size
            tree[rows, k] = value
            while size > 1:
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
                if k[0] == 1:
                    break

        rows = np.arange(n)
        while True:
            root = tree[rows, 1]
            rows, root = rows[root < NONE], root[root < NONE]
            if not len(rows):
                break
            p, rank = root & ((1 << SHIFT) - 1), root >> SHIFT
            gone = nxt[rows, p]
            after = nxt[rows, gone]
            ids[rows, p] = rank
            live[rows, gone] = False
            nxt[rows, p] = after
            put(rows, gone, np.full(len(rows), NONE))
            inside = after < lens[rows]
            value = np.full(len(rows), NONE)
            i, pi, ai = rows[inside], p[inside], after[inside]
            prv[i, ai] = pi
            v = self._pairs(rank[inside], ids[i, ai])
            value[inside] = np.where(v < NONE, v + pi, NONE)
            put(rows, p, value)
            has = prv[rows, p] >= 0
            if has.any():
                i, pi = rows[has], p[has]
                b = prv[i, pi]
                v = self._pairs(ids[i, b], rank[has])
                put(i, b, np.where(v < NONE, v + b, NONE))
        flat, ends = ids[live].astype("<u4").tobytes(), np.cumsum(live.sum(1)).tolist()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_long(self, piece: bytes) -> bytes:
        """The same tree for one match of any length, in arrays of machine integers."""
        n = len(piece)
        size, top = 1 << max(1, (n - 1).bit_length()), 1 << 62
        ids, nxt, prv = array("i", self.single[np.frombuffer(piece, np.uint8)].tolist()), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        tree, get = array("q", [top]) * (2 * size), self.pair.get

        def value(a: int) -> int:
            b = nxt[a]
            r = get(ids[a] << 20 | ids[b]) if b < n else None
            return top if r is None else r << 40 | a

        for a in range(n - 1):
            tree[size + a] = value(a)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(a: int, v: int) -> None:
            k = a + size
            tree[k] = v
            while k > 1:
                k >>= 1
                v = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == v:
                    break
                tree[k] = v

        while (root := tree[1]) < top:
            p = root & ((1 << 40) - 1)
            gone = nxt[p]
            ids[p], ids[gone], nxt[p] = root >> 40, -1, nxt[gone]
            if nxt[p] < n:
                prv[nxt[p]] = p
            put(gone, top)
            put(p, value(p))
            if prv[p] >= 0:
                put(prv[p], value(prv[p]))
        left = np.frombuffer(ids, np.int32)
        return left[left >= 0].astype("<u4").tobytes()

    def learn(self, new: set[str]) -> None:
        """Ids of all matches in new go into the worker's cache."""
        short: dict[int, list[tuple[str, bytes]]] = {}
        for s in new:
            p = s.encode()
            if (r := self.rank.get(p)) is not None:
                self.known[s] = r.to_bytes(4, "little")
            elif len(p) > SHORT:
                self.known[s] = self.merge_long(p)
            else:
                short.setdefault((len(p) - 1).bit_length(), []).append((s, p))
        for group in short.values():
            for i in range(0, len(group), 8192):
                part = group[i : i + 8192]
                for (s, _), ids in zip(part, self.merge_many([p for _, p in part]), strict=True):
                    self.known[s] = ids

    def slabs(self, text: str) -> Iterator[str]:
        """A text in parts of about SLAB characters, each but the first beginning with a lone space: no match spans two."""
        at = 0
        while len(text) - at > SLAB:
            found = self.safe(text, at + SLAB)
            if found is None:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        No match holds a single space anywhere but at its start, so a text whose spaces all stand alone between other
        characters falls into stretches that begin with their space, and equal stretches give equal ids."""
        if self.held > CACHE_BYTES:
            self.known, self.spaced, self.held = {}, {}, 0
        plain = [None if self.uneasy(t) else t.replace(" ", "\0 ").split("\0") if "\0" not in t else None for t in texts]
        new = list(set().union(*(x for x in plain if x)).difference(self.spaced))
        cut = [self.cut(t) for t in new]
        rest = [self.cut(t) if x is None else () for t, x in zip(texts, plain, strict=True)]
        fresh = set().union(*cut, *rest).difference(self.known)
        self.learn(fresh)
        get = self.known.__getitem__
        self.held += sum(ENTRY + len(t) + len(get(t)) for t in fresh)
        for t, c in zip(new, cut, strict=True):
            self.spaced[t] = ids = b"".join(map(get, c))
            self.held += ENTRY + len(t) + len(ids)
        whole = self.spaced.__getitem__
        return [b"".join(map(get, r)) if x is None else b"".join(map(whole, x)) for x, r in zip(plain, rest, strict=True)]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The same, slab by slab: short texts share a slab, long ones have several."""
        some: list[str] = []
        size = 0
        for t in texts:
            if len(t) > SLAB:
                yield from self.encode(some)
                some, size = [], 0
                yield b"".join(self.encode([part])[0] for part in self.slabs(t))
                continue
            some.append(t)
            size += len(t)
            if size >= SLAB:
                yield from self.encode(some)
                some, size = [], 0
        yield from self.encode(some)

    def decode(self, ids: bytes) -> Iterator[bytes]:
        """The bytes of the ids, in parts."""
        every = np.frombuffer(ids, "<u4")
        for k in range(0, len(every), 1 << 15):
            t = every[k : k + (1 << 15)].astype(np.int64)
            lens = self.start[t + 1] - self.start[t]
            ends = np.cumsum(lens)
            at = np.repeat(self.start[t] - (ends - lens), lens)
            at += np.arange(len(at))
            yield self.bytes[at].tobytes()


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Vocabulary(path, pattern)
    return _loaded[path, pattern]


def tokenized(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """One row a row of docs: key, n_tokens, ids_sha256, decoded_sha256 and, with ids, the ids (binary, 4 bytes each).

    Narrow: no shuffle. Memory: about 1 MB of text at a time beside the vocabulary and a bounded cache."""
    shape = f"{key} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids

    def digest(parts: Iterator[bytes]) -> str:
        h = hashlib.sha256()
        for part in parts:
            h.update(part)
        return h.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            keys, texts, i = batch.column(0), batch.column(1), 0
            while i < len(texts):
                j, part, size = i, [], 0
                while j < len(texts) and size < 1_000_000:
                    part.append(texts[j].as_py() or "")
                    size += len(part[-1])
                    j += 1
                coded = list(v.encode_all(part))
                back = [digest(v.decode(c)) for c in coded]
                cols = [keys.slice(i, j - i), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in coded]), pa.array(back)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(coded, pa.binary())] * ids, names)
                i = j

    return docs.select(docs[key].cast("bigint").alias(key), docs[text].cast("string").alias(text)).mapInArrow(run, shape)
