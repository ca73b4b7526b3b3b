"""Usage metrics over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import from_events, skill_stats

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Skill statistics by tumbling window; events later than the watermark are left out in a stream."""
    own = from_events(events)
    own = own.withWatermark("ts", late) if own.isStreaming else own
    out = skill_stats(own, [F.window("ts", width).alias("w"), "skill"])
    return out.select(F.col("w.start").alias("window_start"), *[c for c in out.columns if c != "w"])


def emit(batch: DataFrame, path: str) -> None:
    """A sink for foreachBatch: appends the batch's rows as JSON lines."""
    batch.write.mode("append").json(path)
