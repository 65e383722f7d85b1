"""Column names that clash with none of a table's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores after it as far as df has a column of that name (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names: results take their place."""
    low = {n.lower() for n in names}
    return df.select(*(df[f"`{c}`"] for c in df.columns if c.lower() not in low)) if low & {c.lower() for c in df.columns} else df


def unpacked(names: list[str], *out: str) -> list[Column]:
    """Columns of the struct _doc, which holds all of a table's, but for those that results take the place of."""
    low = {n.lower() for n in out}
    return [F.col("_doc").getField(c).alias(c) for c in names if c.lower() not in low]
