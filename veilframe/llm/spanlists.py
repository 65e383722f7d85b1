"""Lists of found spans as text, in the form that the scans return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)"


def of_kind(found: Column, kind: str, rank: int) -> Column:
    """Spans of one kind, in a form that sorts by start, then rank of the kind."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
