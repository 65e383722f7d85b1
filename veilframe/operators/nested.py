"""Facts of nested JSON with their paths: a walk over VARIANT values, level by level.

Each level explodes the objects and arrays of the one before (one narrow step, written as it is done); a walk has as many
levels as the deepest text. Paths are $.key and [position]; a key that isn't a plain name stands as ['key']."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.session import through_parquet

_DUPLICATES = "spark.sql.variant.allowDuplicateKeys"


def walked(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, path, kind, value of every leaf of each JSON text: kind is string, number, boolean or null, value its text.

    Of equal keys of an object the last counts. A text that does not parse, or is null, has no rows; empty objects and arrays
    have no leaves; a scalar text is a leaf at $."""
    spark = df.sparkSession
    before = spark.conf.get(_DUPLICATES, "false")
    spark.conf.set(_DUPLICATES, "true")
    try:
        level = through_parquet(df.select(*keys, F.lit("$").alias("path"), F.try_parse_json(text).alias("_v")).filter("_v is not null"))
    finally:
        spark.conf.set(_DUPLICATES, before)
    out = None
    while True:
        level = level.withColumn("_k", F.schema_of_variant("_v"))
        inner = F.col("_k").startswith("OBJECT") | F.col("_k").startswith("ARRAY")
        kind = F.when(F.col("_k") == "STRING", "string").when(F.col("_k") == "BOOLEAN", "boolean").when(F.col("_k") == "VOID", "null").otherwise("number")
        leaves = level.filter(~inner).select(*keys, "path", kind.alias("kind"), F.col("_v").cast("string").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        name = F.regexp_replace(F.regexp_replace("e.key", r"\\", r"\\\\"), "'", r"\\'")
        step = F.when(F.col("e.key").isNull(), F.concat(F.lit("["), F.col("e.pos"), F.lit("]"))).when(F.rlike("e.key", F.lit(r"^[A-Za-z_][A-Za-z0-9_]*$")), F.concat(F.lit("."), "e.key")).otherwise(F.concat(F.lit("['"), name, F.lit("']")))
        nested = level.filter(inner).alias("l").lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).alias("e"))
        level = through_parquet(nested.select(*(F.col(f"l.{k}") for k in keys), F.concat("l.path", step).alias("path"), F.col("e.value").alias("_v")))
        if level.isEmpty():
            return out


def facts(df: DataFrame, text: str, *keys: str, least: int = 3) -> DataFrame:
    """keys, path, fact: the string leaves of `least` characters or more, without white space around."""
    fact = F.regexp_replace("value", r"^\s+|\s+$", "")
    return walked(df, text, *keys).filter((F.col("kind") == "string") & (F.length(fact) >= least)).select(*keys, "path", fact.alias("fact"))
