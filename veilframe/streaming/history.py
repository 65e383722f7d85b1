"""The append log as a stream: facts that a user's log shows for the first time, sessions, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = 16  # states of one user: facts are dealt to them by hash, so a hot user's log is no one task's


def first_seen(log: DataFrame, user: str = "user", fact: str = "fact", at: str = "at", late: str = "1 day") -> DataFrame:
    """user, fact, at: each fact once a user within the watermark. Union of sets is commutative, so late rows are safe.

    State is bounded by the watermark; the shuffle is by user and fact, so no user is hot."""
    return log.select(user, fact, at).withWatermark(at, late).dropDuplicatesWithinWatermark([user, fact])


def windowed_counts(log: DataFrame, at: str = "at", key: str = "event_type", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return log.withWatermark(at, late).groupBy(F.window(at, length), key).agg(F.count(F.lit(1)).alias("n"))


def sessions(log: DataFrame, user: str = "user", at: str = "at", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user, session_start, session_end (last row), n, as `timeline.sessions` has them; a session is told when the watermark
    has passed it, rows later than that are dropped by it."""
    s = log.filter(F.col(user).isNotNull()).withWatermark(at, late).groupBy(F.col(user), F.session_window(at, gap).alias("_w"))
    return s.agg(F.max(at).alias("session_end"), F.count(F.lit(1)).alias("n")).select(user, F.col("_w.start").alias("session_start"), "session_end", "n")


class _FirstSeen(StatefulProcessor):
    """For each key the time at which it showed each fact first, for as long as the state lives."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "fact string", "at timestamp", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for part in rows:
            told = []
            for fact, at in part.groupby("fact")["at"].min().items():
                old = self.seen.getValue((fact,)) if self.seen.containsKey((fact,)) else None
                if old is None or at < pd.Timestamp(old[0]):
                    self.seen.updateValue((fact,), (at.to_pydatetime(),))
                    told.append((key[0], fact, at, old is not None))
            yield pd.DataFrame(told, columns=["user", "fact", "at", "earlier"])

    def close(self) -> None:
        pass


def first_times(log: DataFrame, user: str = "user", fact: str = "fact", at: str = "at") -> DataFrame:
    """user (of its own type), fact, at: the first time of each fact of a user so far, told anew with each batch that shows the fact; the least
    `at` told is that of the batch, in whatever order rows came. For the update mode.

    State: one time a user and fact, kept for good and merged in the JVM; the shuffle is by user and fact, so no user is hot.
    Rows without fact or time hold nothing; a null user is a user. `first_seen_exact` tells changes alone, at the price of
    a Python state access a fact."""
    rows = log.select(F.col(user).alias("user"), F.col(fact).cast("string").alias("fact"), F.col(at).alias("at")).filter("fact is not null and at is not null")
    return rows.groupBy("user", "fact").agg(F.min("at").alias("at"))


def first_seen_exact(log: DataFrame, user: str = "user", fact: str = "fact", at: str = "at", ttl_ms: int | None = None) -> DataFrame:
    """user, fact, at, earlier: a row for each fact that is new to a user, and one more (earlier = true) whenever a late row
    moves its first time back. The least `at` of a user and fact is thus what the batch has, in whatever order rows came.

    State: RocksDB, one time a user and fact, kept `ttl_ms` after its last change (None: for good). Start the stream inside
    `rocks(spark)`. Rows without fact or time hold nothing; a null user is a user."""
    rows = log.select(F.col(user).cast("string").alias("user"), F.col(fact).cast("string").alias("fact"), F.col(at).alias("at")).filter("fact is not null and at is not null")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("fact"), F.lit(PARTS)))
    return rows.groupBy("user", "_part").transformWithStateInPandas(_FirstSeen(ttl_ms), "user string, fact string, at timestamp, earlier boolean", "Update", "ProcessingTime" if ttl_ms else "None")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what its source has now and appends the rows as Parquet; a later call goes on from the checkpoint."""
    with rocks(stream.sparkSession):
        writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
        if mode == "update":  # files only append: each batch of updates is a file of its own
            writer = writer.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{path}/batch={k}"))
        else:
            writer = writer.format("parquet").option("path", path)
        query = writer.start()
        query.awaitTermination()
