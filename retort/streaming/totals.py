"""Running totals for each skill, kept in keyed state.

Events are keyed by skill and by a hash of their id, so that a busy skill's state lies in as many tasks as there are shards, and every copy of an event meets the
same state. The state of a key is its totals, and the ids that were counted, by the hour of their event, for a time to live: an event that comes late counts,
one that comes again within that time does not. A timer marks a key's totals as idle when nothing has come for a while. Every change is a row with the
key's totals and a version; the newest rows of all shards add up to the skill's totals.

Numbers are whole (microseconds, items), so sums do not depend on the order of events. State is kept by RocksDB (see session); a query that
starts again from its checkpoint goes on where it stopped, and writes a batch that was under way again in the same place.

Defined cases: a null skill is the empty one; events without an id, or with a null time, are counted each, under a bucket of their own; null values count as 0 microseconds.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOTALS = "skill string, shard int, version long, idle boolean, calls long, successes long, total_us long, items long"
HOUR = 3_600


def session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application whose streaming state is kept by RocksDB, in as many stores as there are partitions."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", partitions or spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


class RunningTotals(StatefulProcessor):
    def __init__(self, keep_ms: int, quiet_ms: int):
        self.keep_ms, self.quiet_ms = keep_ms, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "version long, calls long, successes long, total_us long, items long")
        self.counted = handle.getMapState("counted", "hour long", "ids array<bigint>", self.keep_ms)
        self.timer = handle.getValueState("timer", "at long")

    def _new(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The rows whose ids were not counted before; their ids are kept."""
        named = rows["event_id"].notna() & rows["hour"].notna()
        out = [rows[~named]]
        for hour, own in rows[named].drop_duplicates("event_id").groupby("hour"):
            key = (int(hour),)
            before = np.array(self.counted.getValue(key)[0] if self.counted.containsKey(key) else [], np.int64)
            own = own[~np.isin(own["event_id"].to_numpy(np.int64), before)]
            if len(own):
                self.counted.updateValue(key, (np.concatenate((before, own["event_id"].to_numpy(np.int64))).tolist(),))
                out.append(own)
        return pd.concat(out)

    def _row(self, key, totals, idle: bool) -> pd.DataFrame:
        return pd.DataFrame([[key[0], int(key[1]), totals[0], idle, *totals[1:]]], columns=[c.split()[0] for c in TOTALS.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = self._new(pd.concat(list(rows)))
        version, *sums = self.totals.get() if self.totals.exists() else (0,) * 5
        new = (len(own), int(own["success"].sum()), int(own["us"].sum()), int(own["items"].sum()))
        totals = (version + 1, *(a + b for a, b in zip(sums, new, strict=True)))
        self.totals.update(totals)
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.handle.registerTimer(at)
        self.timer.update((at,))
        yield self._row(key, totals, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        version, *sums = self.totals.get()
        self.totals.update((version + 1, *sums))
        yield self._row(key, (version + 1, *sums), True)

    def close(self) -> None:
        pass


def running_totals(events: DataFrame, shards: int = 8, keep_ms: int = 24 * HOUR * 1000, quiet_ms: int = 60_000) -> DataFrame:
    """TOTALS of a stream of (event_id, ts, skill, success, us, items), read in a session as above."""
    own = events.select(
        F.coalesce("skill", F.lit("")).alias("skill"), F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("int").alias("shard"), F.col("event_id").cast("long"), F.floor(F.unix_timestamp("ts") / HOUR).cast("long").alias("hour"),
        F.coalesce("success", F.lit(False)).alias("success"), F.coalesce(F.col("us").cast("long"), F.lit(0)).alias("us"), F.coalesce(F.col("items").cast("long"), F.lit(0)).alias("items"),
    )
    return own.groupBy("skill", "shard").transformWithStateInPandas(RunningTotals(keep_ms, quiet_ms), TOTALS, "Update", "ProcessingTime")


def from_events(events: DataFrame) -> DataFrame:
    """The table events as the input of running_totals."""
    return events.select("event_id", "ts", F.col("event_type").alias("skill"), (F.col("event_type") != "error").alias("success"), F.round(F.col("value") * 1000).cast("long").alias("us"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(1)).alias("items"))


def start(totals: DataFrame, path: str, checkpoint: str):
    """The query that writes each batch of totals as a table of its own under path; a batch that is written again replaces itself."""
    return totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()


def drained(query, seconds: float = 600) -> None:
    """Waits until the query has read all that there is, and stops it. With timers on a query never ends by itself: it has read all when a batch without
    rows follows one with rows."""
    end, rows = time.monotonic() + seconds, False
    while query.isActive and time.monotonic() < end:
        last = query.lastProgress
        rows = rows or any(p["numInputRows"] for p in query.recentProgress)
        if rows and last and not last["numInputRows"]:
            query.stop()
            return
        time.sleep(0.2)
    failed = query.exception()
    query.stop()
    raise failed or TimeoutError(f"not read within {seconds} s")


def merged(spark: SparkSession, path: str) -> DataFrame:
    """Totals by skill from what was written: each key's newest row, added up over shards; idle where all of them are."""
    newest = spark.read.schema(TOTALS).option("recursiveFileLookup", True).parquet(path)
    newest = newest.withColumn("k", F.row_number().over(Window.partitionBy("skill", "shard").orderBy(F.desc("version")))).where("k = 1")
    return newest.groupBy("skill").agg(*[F.sum(c).alias(c) for c in ("calls", "successes", "total_us", "items")], F.min("idle").alias("idle"))
