"""Overlap conflicts of the spans of one text by an ordered structure of disjoint intervals: n log n a text.

Texts of few spans are resolved by column expressions (`spans.resolve`); this Arrow function takes the others."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from veilframe.schemas import SPANS

_BLOCK = 512
_KEY = ("text", "start", "end", "span_type", "source", "bucket", "subsource")


class Disjoint:
    """Disjoint half-open intervals in order, in blocks of about _BLOCK."""

    def __init__(self) -> None:
        self.blocks: list[list[tuple[int, int]]] = [[]]
        self.heads: list[tuple[int, int]] = []  # first interval of each block but the first

    def add(self, start: int, end: int) -> bool:
        """Adds an interval unless it overlaps one that is there; whether it was added."""
        k = bisect_left(self.heads, (end, -1))
        block = self.blocks[k]
        i = bisect_left(block, (end, -1))
        before = block[i - 1] if i else self.blocks[k - 1][-1] if k else None
        if before is not None and before[1] > start:
            return False
        at = (start, end)
        k = bisect_left(self.heads, (start, end + 1))
        block = self.blocks[k]
        insort(block, at)
        if len(block) > 2 * _BLOCK:
            self.blocks[k : k + 1] = [block[:_BLOCK], block[_BLOCK:]]
            self.heads.insert(k, block[_BLOCK])
        return True


def accepted(start: list[int], end: list[int], withheld: list[bool]) -> list[int]:
    """Places of the spans that are accepted, in order of start: withheld ones first, then longer, then earlier ones."""
    order = sorted(range(len(start)), key=lambda i: (not withheld[i], start[i] - end[i], start[i], i))
    taken = Disjoint()
    return sorted((i for i in order if taken.add(start[i], end[i])), key=lambda i: (start[i], i))


def _once(rows: pa.StructArray) -> list[int]:
    """Places of the spans without exact copies (texts compared without case): the last of equal ones, where the first is."""
    cols = [rows.field(k).to_pylist() for k in _KEY]
    cols[0] = [x if x is None else x.lower() for x in cols[0]]
    at: dict[tuple, int] = {}
    for i, key in enumerate(zip(*cols)):
        at[key] = i
    return list(at.values())


def _resolved(spans: pa.Array) -> pa.Array:
    flat, size = spans.flatten(), np.diff(spans.offsets.to_numpy())
    size[spans.is_null().to_numpy(zero_copy_only=False)] = 0
    starts, ends, bucket = (flat.field(k) for k in ("start", "end", "bucket"))
    keep, lens, base = [], [], 0
    for n in size.tolist():
        if n:
            once = _once(flat.slice(base, n))
            s, e, w = ([v[i] for i in once] for v in (starts.slice(base, n).to_pylist(), ends.slice(base, n).to_pylist(), bucket.slice(base, n).to_pylist()))
            got = accepted(s, e, [x == "U_loc" for x in w])
            keep += [base + once[i] for i in got]
            lens.append(len(got))
        else:
            lens.append(0)
        base += n
    offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, flat.take(pa.array(np.array(keep, np.int64))), mask=spans.is_null())


def resolved(spans: Column) -> Column:
    return arrow_udf(_resolved, SPANS)(spans)
