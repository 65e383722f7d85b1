"""MinHash near-dedup with SetSketch registers.

A text's set is its distinct shingles of five lower-cased words. Words are hashed to 128 bits under a key drawn for the job,
and so are shingles; texts whose sets have equal 128-bit sums are one class. Each of M registers keeps the least of an
exponential variate over the set, on an exponential scale (base B) and cut to 16 bits; registers of a union are maxima of
registers. Bands of registers put classes into buckets; in a bucket every class is paired with two pivots, so a large group
of copies gives links in proportion to its size. Only classes of one bucket that are still in different components are then
compared with each other, in blocks. Every pair is first estimated from both sketches at once (the likelihood of how many
registers are equal, above and below), and what may reach the threshold is verified on the words themselves: texts are
compared by the numbers that their words have in one dictionary, no hash has a say in it. A pair of similarity 0.75 shares
no band with probability 5e-6.

A pivot's partners are dealt into blocks of about BLOCK by their hash, and the pivot goes to each block once, so neither a
pivot nor a bucket is a task of its own.

Edge cases: null text, or none with a word: empty set, linked with nothing, its own component; fewer than five words: the
whole sequence is the one shingle; texts of any length are used whole; repeated rows and equal texts are one class; rows
that share a doc_id count as one document; null doc_ids are linked with nothing; further columns do not matter."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.bytesview import SEPARATOR, chunks, mix, strings, words
from veilframe.llm.graph import components, in_blocks
from veilframe.session import through_parquet

SHINGLE = 5
THRESHOLD = (75, 100)
M, ROWS = 128, 4  # registers; registers of a band
B, A, TOP = 1.001, 20.0, (1 << 16) - 1
MARGIN = 0.2  # below the threshold: what an estimate may miss it by (five standard deviations)
BLOCK = 256  # classes of a bucket, or partners of a pivot, that are compared at once
GROUP_WORDS = 1 << 19  # shingles of the texts that one group verifies, about
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.random.default_rng(2024).integers(1 << 62, dtype=np.uint64, size=M) * np.uint64(2) + np.uint64(1)


def numbered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of every word in a dictionary of these texts' lower-cased words, the dictionary, and the texts' first words."""
    low = _LOWER[data]
    starts, ends, first = words(low, offsets)
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    every = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(low[~SEPARATOR[low]])])
    coded = every.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, first


def shingles(data: np.ndarray, offsets: np.ndarray, key: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text as 128-bit hashes: two arrays, in order of the first."""
    ids, known, first = numbered(data, offsets)
    own = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16, key=key).digest() for w in known.to_pylist()), np.uint64).reshape(-1, 2)
    lanes = []
    for lane, by in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
        h = own[ids, lane]
        many = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            many = many * np.uint64(by) + h[k : k + len(many)]
        lanes.append((h, mix(many), np.uint64(by)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            x, y = (many[a : b - SHINGLE + 1] for _, many, _ in lanes)
            u, at = np.unique(x, return_index=True)
            if len(np.unique(y)) == len(u):
                out.append((u, y[at]))
            else:  # different shingles of one half-hash
                both = np.unique(np.stack([x, y], 1), axis=0)
                out.append((both[:, 0], both[:, 1]))
        else:
            one = []
            for h, _, by in lanes:
                x = np.full(min(1, b - a), b - a, np.uint64)
                for w in h[a:b]:
                    x = x * by + w
                one.append(mix(x))
            out.append((one[0], one[1]))
    return out


def exact_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Distinct shingles of each text as numbers that are equal just where the shingles' words are."""
    ids, known, first = numbered(data, offsets)
    n, ids = max(0, len(ids) - SHINGLE + 1), ids.astype(np.int64)
    width = max(1, len(known)).bit_length()
    cur, bits = ids[:n], width
    for k in range(1, SHINGLE):
        if bits + width > 62:
            known_, cur = np.unique(cur, return_inverse=True)
            bits = max(1, len(known_)).bit_length()
        cur, bits = cur << width | ids[k : k + n], bits + width
    few: dict[tuple, int] = {}
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(cur[a : b - SHINGLE + 1]))
        else:
            out.append(np.full(min(1, b - a), -1 - few.setdefault(tuple(ids[a:b].tolist()), len(few)), np.int64))
    return out


def alike(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sets of distinct numbers reach the threshold."""
    least, of = THRESHOLD
    if of * min(len(p), len(q)) < least * max(len(p), len(q)):
        return False
    common = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
    return of * common >= least * (len(p) + len(q) - common)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """M registers of each set that is not empty (uint16)."""
    out = np.zeros((len(sets), M), np.uint16)
    if not sets:
        return out
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    for i, f in enumerate(_FACTORS):
        least = np.minimum.reduceat(flat * f, at)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / A
        out[:, i] = np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, TOP)
    return out


def _bands(band: np.ndarray) -> np.ndarray:
    """Bucket of each band (texts x bands x rows)."""
    key = np.broadcast_to(np.arange(band.shape[1], dtype=np.uint64), band.shape[:2]).copy()
    for k in range(band.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + band[:, :, k].astype(np.uint64))
    return key.view(np.int64)


def estimated(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely similarity of each pair of sketches, the sets' sizes being known."""
    above, below = (ra > rb).sum(1), (ra < rb).sum(1)
    same = ra.shape[1] - above - below
    u = (na / (na + nb))[:, None]
    j = np.minimum(na, nb) / np.maximum(na, nb)
    grid = np.linspace(0, 1, 101)[None, :] * j[:, None]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log(np.maximum(1e-12, 1 - np.clip(x, 1e-9, 1) * (B - 1) / B)) / np.log(B)

    # shares of the union that only one set holds
    pa_, pb_ = p(u - (1 - u) * grid), p((1 - u) - u * grid)
    like = above[:, None] * np.log(pa_) + below[:, None] * np.log(pb_) + same[:, None] * np.log(np.maximum(1e-12, 1 - pa_ - pb_))
    return grid[np.arange(len(grid)), like.argmax(1)]


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n, s1, s2 (a 128-bit hash of the set under a key of this call), regs (binary) and bands of each row; null regs
    and bands for empty sets."""
    secret = secrets.token_bytes(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = strings(b.column(1))
            for i, j in chunks(offs):
                sets = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], secret)
                n = np.array([len(s) for s, _ in sets])
                full = [s for s, _ in sets if len(s)]
                regs = registers(full)
                s1, s2 = (np.array([mix(s[k]).sum() for s in sets], np.uint64) for k in (0, 1))
                band = regs.reshape(len(full), M // ROWS, ROWS)
                key = _bands(band)
                r, k, at = [None] * len(sets), [None] * len(sets), np.flatnonzero(n).tolist()
                for x, row in enumerate(at):
                    r[row], k[row] = regs[x].tobytes(), key[x]
                cols = [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(r, pa.binary()), pa.array(k, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "s1", "s2", "regs", "bands"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, regs binary, bands array<bigint>")


def _regs(col: pa.Array) -> np.ndarray:
    data, offs = col.buffers()[2], col.buffers()[1]
    o = np.frombuffer(offs, np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]].view(np.uint16).reshape(-1, M) if len(col) else np.zeros((0, M), np.uint16)


def _dealt(pairs: DataFrame, attached: DataFrame, weight: int) -> DataFrame:
    """Rows (grp, p, k, c, node, n, and what else attached(node, n, ...) has) of every block of pairs(p, node, k, c): its
    partners once each and its pivot once. Blocks are put into groups that hold about `weight` shingles."""
    blocks = pairs.select("p", "k", "c").distinct().withColumn("node", F.col("p"))
    rows = pairs.unionByName(blocks).join(attached, "node")
    size = pairs.join(attached.select("node", "n"), "node").agg(F.sum("n")).first()[0] or 0
    return rows.withColumn("grp", F.pmod(F.xxhash64("p", "k", "c"), F.lit(max(1, -(-size // weight)))))


def _blocks(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Row of the pivot and rows of the partners of each block."""
    p, k, c, node = (t.column(x).to_numpy() for x in ("p", "k", "c", "node"))
    o = np.lexsort((node != p, c, k, p))  # the pivot first
    cut = np.flatnonzero(np.append(True, (p[o][1:] != p[o][:-1]) | (k[o][1:] != k[o][:-1]) | (c[o][1:] != c[o][:-1])))
    for a, b in zip(cut, [*cut[1:], len(o)], strict=True):
        yield int(o[a]), o[a + 1 : b]


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of pairs(p, node, k, c) whose estimate from the sketches may reach the threshold."""
    least = THRESHOLD[0] / THRESHOLD[1] - MARGIN

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        regs, n, keep = _regs(t.column("regs").combine_chunks() if isinstance(t.column("regs"), pa.ChunkedArray) else t.column("regs")), t.column("n").to_numpy().astype(float), np.zeros(len(t), bool)
        for x, ys in _blocks(t):
            for i in range(0, len(ys), 2048):
                y = ys[i : i + 2048]
                keep[y] = estimated(np.broadcast_to(regs[x], (len(y), M)), regs[y], np.full(len(y), n[x]), n[y]) >= least
        return t.filter(pa.array(keep)).select(["p", "node", "k", "c"])

    return _dealt(pairs, classes.select("node", "n", "regs"), 64 * GROUP_WORDS).groupBy("grp").applyInArrow(run, "p bigint, node bigint, k int, c int")


def _texts(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the classes in nodes(node). Texts are read again for these only."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("string").alias("text"))
    return own.join(nodes.hint("shuffle_hash"), "node", "semi").dropDuplicates(["node", "text"])


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of those of pairs(p, node, k, c) whose sets reach the threshold."""
    nodes = pairs.select("node").unionByName(pairs.select(F.col("p").alias("node"))).distinct()
    held = classes.select("node", "n").join(_texts(nodes, docs), "node")

    def run(t: pa.Table) -> pa.Table:
        t, out = t.combine_chunks(), []
        p, node = t.column("p").to_numpy(), t.column("node").to_numpy()
        data, offs = strings(t.column("text"))
        for x, ys in _blocks(t):
            rows = np.append(x, ys)
            sets = exact_sets(np.concatenate([data[offs[r] : offs[r + 1]] for r in rows]), np.concatenate([[0], np.cumsum(offs[rows + 1] - offs[rows])]))
            out += [(int(max(p[x], node[y])), int(min(p[x], node[y]))) for y, s in zip(ys.tolist(), sets[1:], strict=True) if alike(sets[0], s)]
        return pa.table({"a": pa.array([r[0] for r in out], pa.int64()), "b": pa.array([r[1] for r in out], pa.int64())})

    return _dealt(pairs, held, GROUP_WORDS).groupBy("grp").applyInArrow(run, "a bigint, b bigint").distinct()


def _pairs(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For one pair of blocks of a bucket: a member and those of the other block, of other components, with which it may
    reach the threshold and whose first common band this bucket is."""
    node, comp, n, block = (t.column(c).to_numpy() for c in ("node", "component", "n", "_block"))
    regs = _regs(t.column("regs").combine_chunks() if isinstance(t.column("regs"), pa.ChunkedArray) else t.column("regs"))
    band = regs.reshape(len(regs), M // ROWS, ROWS)
    keys, bucket = _bands(band), t.column("bucket")[0].as_py()
    i, j = t.column("_i")[0].as_py(), t.column("_j")[0].as_py()
    left, right = (np.flatnonzero(block == i), np.flatnonzero(block == j))
    least, of = THRESHOLD
    for x in left:
        y = right[(comp[right] != comp[x]) & ((node[right] > node[x]) if i == j else True)]
        y = y[of * np.minimum(n[y], n[x]) >= least * np.maximum(n[y], n[x])]
        if len(y):
            first = (band[y] == band[x]).all(2).argmax(1)
            y = y[keys[x, first] == bucket]
        if len(y):
            y = y[estimated(np.broadcast_to(regs[x], (len(y), M)), regs[y], np.full(len(y), float(n[x])), n[y].astype(float)) >= least / of - MARGIN]
        if len(y):
            yield int(x), y


def _across(t: pa.Table) -> pa.Table:
    """The members of one pair of blocks that have such a partner."""
    t = t.combine_chunks()
    some = np.zeros(len(t), bool)
    for x, y in _pairs(t):
        some[x] = True
        some[y] = True
    return t.select(["bucket", "_i", "_j", "_block", "node"]).filter(pa.array(some))


def _settled(t: pa.Table) -> pa.Table:
    """Links between the members of one pair of blocks, verified on their words; enough of them to join components."""
    t = t.combine_chunks()
    node, sets = t.column("node").to_numpy(), exact_sets(*strings(t.column("text")))
    up = {c: c for c in t.column("component").to_pylist()}
    comp = t.column("component").to_pylist()

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    out = []
    for x, ys in _pairs(t):
        for y in ys.tolist():
            p, q = root(comp[x]), root(comp[y])
            if p != q and alike(sets[x], sets[y]):
                out.append((max(node[x], node[y]), min(node[x], node[y])))
                up[max(p, q)] = min(p, q)
    return pa.table({"a": pa.array([r[0] for r in out], pa.int64()), "b": pa.array([r[1] for r in out], pa.int64())})


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of docs(doc_id, text)."""
    every = through_parquet(sketched(docs))
    rows = every.select("doc_id", "n", "s1", "s2")
    held = every.filter("n > 0 and doc_id is not null")
    classes = through_parquet(held.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")))
    member = classes.select("node", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("p1")).filter("_n > 1")
    at = through_parquet(member.join(shared, "bucket").select("bucket", "node", "_n", "p1"))
    # the class that shares bands with most others stands at the middle of its copies
    middle = at.groupBy("node").agg(F.sum("_n").alias("w"))
    second = at.join(middle, "node").groupBy("bucket").agg(F.max(F.struct("w", (-F.col("node")).alias("m"))).alias("best")).select("bucket", (-F.col("best.m")).alias("p2"))
    star = at.select("node", F.col("p1").alias("p"), "_n").unionByName(at.join(second, "bucket").select("node", F.col("p2").alias("p"), "_n")).filter("node <> p")
    pairs = star.groupBy("p", "node").agg(F.ceil(F.max("_n") / BLOCK).cast("int").alias("k"))
    pairs = pairs.withColumn("c", F.pmod(F.xxhash64("node", F.lit(32)), F.col("k").cast("bigint")).cast("int"))
    slim = classes.select("node", "n", "regs")
    links = through_parquet(_verified(through_parquet(_promising(through_parquet(pairs), slim)), slim, docs))
    comp = components(links)
    # buckets in which more than one component is left
    named = at.join(comp, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("_n")).filter("lo <> hi").select("bucket", "_n")
    left = named.join(mixed, "bucket").join(slim, "node").select("bucket", "node", "component", "n", "regs", "_n")
    some = through_parquet(in_blocks(left, "bucket", "node", BLOCK, _across, "bucket bigint, _i int, _j int, _block int, node bigint"))
    if not some.isEmpty():
        texts = _texts(some.select("node").distinct(), docs)
        who = slim.join(comp, "node", "left").select("node", "n", "regs", F.coalesce("component", "node").alias("component"))
        units = some.join(who.join(texts, "node"), "node")
        more = units.groupBy("bucket", "_i", "_j").applyInArrow(_settled, "a bigint, b bigint").distinct()
        links = through_parquet(links.unionByName(more))
        comp = components(links)
    final = classes.select("s1", "s2", "node").join(comp, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("c"))
    linked = rows.filter("n > 0 and doc_id is not null").join(final, ["s1", "s2"]).select("doc_id", "n", "c")
    alone = rows.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("c"))
    out = linked.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("c"), F.lit(True)).alias("kept"))
