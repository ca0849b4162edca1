"""Streaming jobs: each takes a streaming DataFrame and returns one; ``drain`` runs it over what has arrived and stops.

Late rows are dropped by the watermark, and windows come out once the watermark has passed their end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from terrane.operators import classify, rules
from terrane.session import shared_dir, ship


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of ``path``, a folder or a single file, as a stream in the order in which they arrived.

    Written as a pattern, since the file source takes single files only so.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, name: str, mode: str = "append", rocks: bool = False, base: str | None = None) -> DataFrame:
    """Runs ``stream`` into Parquet in the shared folder until all input is handled, and returns what it wrote. ``rocks``: state is
    kept in RocksDB (the session's own setting is put back). With the same ``base`` a restarted run goes on where the last stopped."""
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    setting, before = "spark.sql.streaming.stateStore.providerClass", None
    if rocks:
        before = spark.conf.get(setting)
        spark.conf.set(setting, ROCKS)
    try:
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if rocks:
            spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def windowed(events: DataFrame, scope: str, measure: str, delay: str, size: str, slide: str | None = None) -> DataFrame:
    """(scope, start, observed): sums of ``measure`` per scope (both SQL expressions) and window of ``events`` (ts, ...), tumbling without ``slide``."""
    per = events.withWatermark("ts", delay).groupBy(F.window("ts", size, slide), F.expr(scope).alias("scope")).agg(F.sum(F.expr(measure)).alias("observed"))
    return per.select("scope", F.col("window.start").cast("timestamp_ntz").alias("start"), "observed")


def sessions(events: DataFrame, scope: str, delay: str, gap: str) -> DataFrame:
    """(scope, start, end, n): runs of events of a scope that are at most ``gap`` apart."""
    per = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), F.expr(scope).alias("scope")).agg(F.count("*").alias("n"))
    return per.select("scope", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def kept(stream: DataFrame, name: str, work: Callable[[DataFrame], DataFrame], base: str | None = None) -> DataFrame:
    """Runs ``work`` on each micro-batch and returns all that it made so far. Each batch writes a part of its own, which a batch
    that is run again overwrites; with the same ``base`` folder a restarted run goes on where the last one stopped."""
    base = base or f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema: list[StructType] = []

    def write(batch: DataFrame, number: int) -> None:
        out = work(batch)
        schema[:] = [out.schema]
        out.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    if not schema:  # nothing new: what earlier runs wrote, if any
        schema.append(work(spark.createDataFrame([], stream.schema)).schema)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema[0])
    return spark.read.schema(schema[0]).parquet(f"{base}/out")


def classified(stores: DataFrame, fences: DataFrame, suppliers: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Arriving stores (store_id, x, y, direct, ...) with their dealers, upstream and kind, found by containment in ``fences`` batch by batch."""

    def work(batch: DataFrame) -> DataFrame:
        known = classify.with_upstream(classify.store_dealers(batch, fences), suppliers)
        return known.withColumn("kind", classify.kind(F.col("dealers"), F.col("direct"), F.col("upstream")))

    return kept(stores, name, work, base)


#: Parts that a changelog may have before they are folded into one.
PARTS = 8


def changelog(log: DataFrame, name: str, base: str | None = None, parts: int = PARTS) -> DataFrame:
    """(unit_id, owner, seq): the last writer of each unit in a stream (unit_id, seq, owner).

    Each micro-batch writes the last writers among its own rows. Once ``parts`` parts stand beside the state, the batch folds
    them and its own into a new state, named by its number, which a batch that is run again overwrites; so a read meets
    one state and a few parts, and the cost of folding is spread over the batches. Parts up to a state's number count no more.
    """
    spark = log.sparkSession
    base = base or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    latest = F.max_by(F.struct("owner", "seq"), F.struct("seq", "owner")).alias("s")
    last = lambda df: df.groupBy("unit_id").agg(latest).select("unit_id", "s.owner", "s.seq")
    rows = log.select("unit_id", "owner", "seq")

    def write(batch: DataFrame, number: int) -> None:
        state, own = _standing(spark, base, number - 1)
        if len(own) < parts:
            last(batch).write.mode("overwrite").parquet(f"{base}/part={number}")
        else:
            last(_read(spark, rows, base, state, own).unionByName(batch)).write.mode("overwrite").parquet(f"{base}/state={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return last(_read(spark, rows, base, *_standing(spark, base)))


def _standing(spark: SparkSession, base: str, upto: int | None = None) -> tuple[int | None, list[int]]:
    """Number of the latest finished state below ``base``, and those of the finished parts after it, up to a batch number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"state": [], "part": []}
    for status in files.listStatus(path) if files.exists(path) else []:
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")) and (upto is None or int(number) <= upto):
            found[kind].append(int(number))
    state = max(found["state"], default=None)
    return state, sorted(k for k in found["part"] if state is None or k > state)


def _read(spark: SparkSession, like: DataFrame, base: str, state: int | None, parts: list[int]) -> DataFrame:
    paths = [f"{base}/state={state}"] * (state is not None) + [f"{base}/part={k}" for k in parts]
    return spark.read.schema(like.schema).parquet(*paths) if paths else spark.createDataFrame([], like.schema)


class TriggerStates(StatefulProcessor):
    """A scope's state under a trigger as a value, cleared by a timer once the scope has been idle.

    Periods are days; a row of period n carries its event time ``at``, which rises with n. The timer stands at the scope's last event
    time plus the trigger's idle periods and one: once the watermark has passed it the state is gone, and a later row starts
    afresh, as it would by the trigger's own rule.
    """

    def __init__(self, trigger: rules.Trigger):
        self.trigger = trigger

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "state long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values("n")
        state, last = self.kept.get() if self.kept.exists() else (0, None)
        state, last, out = self.trigger.fold(state, last, zip(own["n"].tolist(), own["gap"].tolist(), own["level"].tolist(), own["confidence"].tolist(), strict=True))
        self.kept.update((int(state), int(last)))
        if self.trigger.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(own["at"].max().timestamp() * 1000) + (self.trigger.idle + 1) * DAY_MS)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["scope", "n", "decision", "reason"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass


#: Milliseconds of a period.
DAY_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def triggered(gaps: DataFrame, trigger: rules.Trigger, delay: str = "1 day") -> DataFrame:
    """(scope, n, decision, reason) of a stream (scope, n, at, gap, level, confidence): periods in a row and cooldown are kept as
    state of each scope, in RocksDB. Rows of a scope must arrive in order of n from batch to batch; within a batch they are
    put in order. Equal to rules.fold_cooldown over the same rows.

    The session needs RocksDB's state store while the stream runs; :func:`drain` with ``rocks`` sees to that.
    """
    ship(gaps.sparkSession)
    keyed = gaps.withWatermark("at", delay).groupBy("scope")
    return keyed.transformWithStateInPandas(TriggerStates(trigger), rules.DECISIONS, "append", "EventTime")
