"""Embedding near-dedup by E8 lattice hashing.

Each of TABLES tables projects the unit vectors of one label to eight dimensions by a random orthonormal map, shifts and
scales them and decodes to the nearest point of the lattice E8. A vector's home is its nearest point; it also visits the
nearest points after small steps towards the neighbouring cells. Two vectors meet in a table if one's home is among the
other's visits. Only rows that meet are compared, by cosine in double precision.

Equal vectors of a label are one class. In a bucket members are compared in blocks by matrix products, so a large group
costs products but emits no pairs: a block gives each class the number of vectors linked to it and the edges of a spanning
forest. A pair that meets in several buckets counts in the first one only, which both sides' keys tell.

Edge cases: a null label, a null or empty vector, one of norm zero, or one with a null or non-finite component links with
nothing; repeated rows link with each other as equal vectors; rows of one vec_id count as vectors of their own but share
a result node; vectors of different length are never compared; further columns do not matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.bytesview import mix
from veilframe.llm.graph import components, in_blocks
from veilframe.session import checkpointed

LEAST = 0.98
TABLES = 6
VISITS = 12  # lattice points that a vector visits in a table beside its home, at most
SCALE = 2.2  # lattice units of a unit vector's projection, times the root of its dimension over 8
STEP = 0.45  # of the probing steps, in lattice units
BLOCK = 512


def e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 to each row, times two (so that all coordinates are integers)."""

    def d8(v: np.ndarray) -> np.ndarray:
        r = np.rint(v)
        odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
        if len(odd):
            gap = v[odd] - r[odd]
            k = np.abs(gap).argmax(1)
            r[odd, k] += np.where(gap[np.arange(len(odd)), k] >= 0, 1, -1)
        return r

    whole, half = d8(x), d8(x - 0.5) + 0.5
    near = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.rint(2 * np.where(near[:, None], whole, half)).astype(np.int64)


def _maps(dim: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, table])
    q, _ = np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))
    return q[:dim], rng.uniform(0, 2, 8)


def keys(unit: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home (n x TABLES) and visited keys (n x TABLES x (1 + VISITS), home first, repeated where fewer) as int64."""
    n, dim = unit.shape
    home, seen = np.zeros((n, TABLES), np.int64), np.zeros((n, TABLES, 1 + VISITS), np.int64)
    for t in range(TABLES):
        q, shift = _maps(dim, t)
        x = unit @ q * (SCALE * np.sqrt(dim / 8)) + shift
        base = e8(x)
        points = [base]
        gap = x - base / 2
        order = np.argsort(-np.abs(gap), axis=1)
        rows = np.arange(n)
        for k in range(VISITS):
            y = x.copy()
            if k < 6:  # further along one of the coordinates that stray most
                c = order[:, k]
                y[rows, c] += STEP * np.where(gap[rows, c] >= 0, 1, -1)
            else:  # along two of them at once
                a, b = [(0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (2, 3)][k - 6]
                for c in (order[:, a], order[:, b]):
                    y[rows, c] += STEP * np.where(gap[rows, c] >= 0, 1, -1)
            points.append(e8(y))
        for k, p in enumerate(points):
            h = salt + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64)
            for c in range(8):
                h = mix(h ^ p[:, c].astype(np.uint64)) + np.uint64(c)
            seen[:, t, k] = h.view(np.int64)
        home[:, t] = seen[:, t, 0]
    return home, seen


def _vectors(col: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) if v is not None else np.zeros(0) for v in (x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in col)]


def prepared(rows: DataFrame) -> DataFrame:
    """vec_id, label, vec (unit vector as bytes of doubles; null if it links with nothing) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v, ok in zip(_vectors(b.column(2)), b.column(1).is_valid().to_pylist(), strict=True):
                norm = np.sqrt((v * v).sum()) if len(v) and np.isfinite(v).all() else 0.0
                if len(v) and norm == 0.0 and np.isfinite(v).all() and v.any():
                    v = v / np.abs(v).max()  # components so small that their squares vanish
                    norm = np.sqrt((v * v).sum())
                elif np.isinf(norm):
                    v = v / np.abs(v).max()
                    norm = np.sqrt((v * v).sum())
                out.append((v / norm).tobytes() if ok and norm > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])

    cols = rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return cols.mapInArrow(run, "vec_id bigint, label string, vec binary")


def _placed(classes: DataFrame) -> DataFrame:
    """A row for each bucket that a class is at home in or visits: bucket, home, and the class with its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 512):
                x = b.slice(i, 512)
                raw = x.column(3).to_pylist()
                by: dict[int, list[int]] = {}
                for k, v in enumerate(raw):
                    by.setdefault(len(v), []).append(k)
                for size, at in by.items():
                    unit = np.frombuffer(b"".join(raw[k] for k in at), np.float64).reshape(len(at), size // 8)
                    salt = mix(x.column(2).take(pa.array(at)).to_numpy().view(np.uint64) + np.uint64(size))
                    _, seen = keys(unit, salt)
                    part = x.take(pa.array(at))
                    flat = [np.unique(s) for s in seen.reshape(len(at), -1)]
                    homes = seen[:, :, 0]
                    cols = [part.column(0), part.column(1), part.column(3), pa.array([h.tobytes() for h in homes], pa.binary()), pa.array([s.tobytes() for s in seen], pa.binary()), pa.array(flat, pa.list_(pa.int64())), pa.array([np.isin(f, h) for f, h in zip(flat, homes, strict=True)], pa.list_(pa.bool_()))]
                    yield pa.RecordBatch.from_arrays(cols, ["node", "copies", "vec", "homes", "seen", "buckets", "own"])

    kept = classes.select("node", "copies", F.xxhash64("label").alias("h"), "vec")
    return kept.mapInArrow(run, "node bigint, copies bigint, vec binary, homes binary, seen binary, buckets array<bigint>, own array<boolean>")


def _compared(t: pa.Table) -> pa.Table:
    """Links counted, and a spanning forest of them, for one pair of blocks of one bucket."""
    t = t.combine_chunks()
    node, copies, block, own = (t.column(c).to_numpy() for c in ("node", "copies", "_block", "own"))
    bucket, i, j = t.column("bucket")[0].as_py(), t.column("_i")[0].as_py(), t.column("_j")[0].as_py()
    vec = np.stack([np.frombuffer(v, np.float64) for v in t.column("vec").to_pylist()])
    homes = np.stack([np.frombuffer(v, np.int64) for v in t.column("homes").to_pylist()])
    seen = np.stack([np.frombuffer(v, np.int64).reshape(TABLES, -1) for v in t.column("seen").to_pylist()])
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    near = vec[left] @ vec[right].T >= LEAST - 1e-9
    near &= own[left][:, None] | own[right][None, :]
    if i == j:
        near &= node[left][:, None] < node[right][None, :]
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    keep = []
    for s in range(0, len(a), 20_000):  # exact cosine, and whether this is the first bucket in which the pair meets
        x, y = a[s : s + 20_000], b[s : s + 20_000]
        ok = np.einsum("ij,ij->i", vec[x], vec[y]) >= LEAST
        meets = np.concatenate([np.where((seen[y] == homes[x][:, :, None]).any(2), homes[x], np.iinfo(np.int64).max), np.where((seen[x] == homes[y][:, :, None]).any(2), homes[y], np.iinfo(np.int64).max)], 1)
        keep.append(ok & (meets.min(1) == bucket))
    m = np.concatenate(keep) if keep else np.zeros(0, bool)
    a, b = a[m], b[m]
    links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node)) if len(a) else np.zeros(len(node))
    up = np.arange(len(node))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    forest = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            lo, hi = (x, y) if node[x] < node[y] else (y, x)
            up[hi] = lo
            forest.append((node[hi], node[lo]))
    some = np.flatnonzero(links)
    out = [(int(node[k]), int(node[k]), int(links[k])) for k in some] + [(int(x), int(y), 0) for x, y in forest]
    return pa.table({k: pa.array([r[c] for r in out], pa.int64()) for c, k in enumerate("abn")})


def groups(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a row of rows(vec_id, label, embedding)."""
    every = checkpointed(prepared(rows).withColumn("vh", F.sha2("vec", 256)))
    held = every.filter("vec is not null and vec_id is not null")
    classes = held.groupBy("label", "vh").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    classes = checkpointed(classes)
    placed = checkpointed(_placed(classes))
    member = placed.select("node", F.explode(F.arrays_zip("buckets", "own")).alias("z")).select("node", F.col("z.buckets").alias("bucket"), F.col("z.own").alias("own"))
    full = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.max("own").alias("any")).filter("_n > 1 and any").select("bucket", "_n")
    at = member.join(full, "bucket").join(placed.select("node", "copies", "vec", "homes", "seen"), "node")
    found = checkpointed(in_blocks(at, "bucket", "node", BLOCK, _compared, "a bigint, b bigint, n bigint"))
    comp = components(found.filter("a <> b").select("a", "b"))
    counts = found.filter("a = b").groupBy("a").agg(F.sum("n").alias("far"))
    named = classes.select("label", "vh", "node", "copies").join(comp, "node", "left").join(counts, F.col("node") == F.col("a"), "left")
    named = named.select("label", "vh", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = held.select("vec_id", "label", "vh").join(named, ["label", "vh"]).select("vec_id", "n_links", "component_id")
    alone = every.filter("vec is null or vec_id is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
