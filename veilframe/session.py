"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset, on one machine (tests), a temporary folder stands in."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(given or os.path.join(tempfile.gettempdir(), f"veilframe-{os.getuid()}-ckpt"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder; its lineage ends there, and it survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def through_parquet(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again. The shuffle files of the writing go at once."""
    spark, free = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(free, "false")
    spark.conf.set(free, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(free, before)
    return spark.read.parquet(path)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a column of row numbers from 0 in an order. Sorted by ranges, so no task holds all rows; what the driver sees
    is the number of rows of each partition."""
    rows = checkpointed(df.orderBy(*order))
    count = {r.p: r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    starts, at = [], 0
    for p in range(max(count, default=-1) + 1):
        starts.append(at)
        at += count.get(p, 0)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(name, F.array(*(F.lit(x).cast("bigint") for x in starts or [0]))[F.spark_partition_id()] + within)


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores where it has fewer partitions than those: small files before heavy narrow work. Larger
    tables stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
