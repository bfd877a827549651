"""Keyed state in streams: the first row of each run of a key, with counters, released by timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN = "first_us long, first_id long, last_us long, n long"


def _close_ms(last_us: int, quiet_us: int) -> int:
    """The watermark, in milliseconds, from which no row can join a run any more."""
    return (last_us + quiet_us) // 1000 + 1


class Runs(StatefulProcessor):
    """Rows of a key that are at most ``quiet`` apart are one run. State is a key's open runs, of which late rows may join two into one. A key has one timer, for the run that closes first: when it fires, all runs that the watermark has passed are released and forgotten."""

    def __init__(self, quiet_us: int):
        self.quiet = quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.runs = handle, handle.getListState("runs", RUN)

    def _next(self, runs) -> int | None:
        return min((_close_ms(r[2], self.quiet) for r in runs), default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_ = [list(r) for r in self.runs.get()]
        before = self._next(open_)
        for batch in rows:
            open_ += [[t, i, t, 1] for t, i in zip(batch["us"].tolist(), batch["id"].tolist(), strict=True)]
        merged: list[list[int]] = []
        for r in sorted(open_):
            if merged and r[0] - merged[-1][2] <= self.quiet:
                merged[-1][2], merged[-1][3] = max(merged[-1][2], r[2]), merged[-1][3] + r[3]
            else:
                merged.append(r)
        after = self._next(merged)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        self.runs.put([tuple(r) for r in merged])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = [tuple(r) for r in self.runs.get()]
        done = [r for r in held if _close_ms(r[2], self.quiet) <= at]
        rest = [r for r in held if _close_ms(r[2], self.quiet) > at]
        if rest:
            self.runs.put(rest)
            self.handle.registerTimer(self._next(rest))
        else:
            self.runs.clear()
        if done:
            yield pd.DataFrame([(*key, *r) for r in done], columns=["key", *[f.split()[0] for f in RUN.split(", ")]])

    def close(self) -> None:
        pass


def first_of_runs(rows: DataFrame, key: str, time: str, id_col: str, quiet_seconds: int, late: str = "1 hour") -> DataFrame:
    """key, first_ts, first_id, last_ts, n of each run of a key (rows at most quiet_seconds apart), once it is closed.

    On a stream a run is closed when the watermark, ``late`` behind the latest
    time, has passed its last row by more than quiet_seconds; rows behind the
    watermark are dropped. A table gives what the stream gives that has read it in
    an order without late rows: runs that the last watermark closes. Rows that
    repeat count each; of equal times the smaller id is the first. Null keys are a key; null times and ids are left out.
    """
    kind = rows.schema[key].dataType.simpleString()
    us = F.unix_micros(F.col(time).cast("timestamp"))
    good = rows.where(F.col(time).isNotNull() & F.col(id_col).isNotNull())
    if rows.isStreaming:
        src = good.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("ts"), us.alias("us"), F.col(id_col).cast("long").alias("id")).withWatermark("ts", late)
        found = src.groupBy("key").transformWithStateInPandas(Runs(quiet_seconds * 1_000_000), f"key {kind}, {RUN}", "Append", "EventTime")
    else:
        found = _runs_of_table(good.select(F.col(key).alias("key"), us.alias("us"), F.col(id_col).cast("long").alias("id")), quiet_seconds * 1_000_000, late)
    ts = lambda c: F.timestamp_micros(c)
    return found.select(F.col("key").alias(key), ts("first_us").alias("first_ts"), "first_id", ts("last_us").alias("last_ts"), "n")


def _runs_of_table(rows: DataFrame, quiet: int, late: str) -> DataFrame:
    by_time = Window.partitionBy("key").orderBy("us", "id")
    fresh = F.coalesce(F.col("us") - F.lag("us").over(by_time) > quiet, F.lit(True)).cast("int")
    numbered = rows.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("key", "run").agg(F.min("us").alias("first_us"), F.min_by("id", F.struct("us", "id")).alias("first_id"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"))
    seen = rows.agg(F.max("us").alias("us")).select((F.floor(F.col("us") / 1000) - F.unix_millis(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.expr(f"INTERVAL {late}"))).alias("mark"))
    return runs.crossJoin(F.broadcast(seen)).where(F.floor((F.col("last_us") + quiet) / 1000) + 1 <= F.col("mark")).select("key", "first_us", "first_id", "last_us", "n")  # one row


@contextmanager
def rocks(spark: SparkSession):
    """The state store that keyed state with timers needs, while a stream is started and run."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)
