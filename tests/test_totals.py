"""Running totals in keyed state: late and repeated events, restarts, timers, time to live."""

import glob
import time

import pytest
from pyspark.sql import functions as F

from retort.streaming import totals, usage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own(spark):
    return totals.session(spark, 3)


def stream(own, path):
    return totals.from_events(own.readStream.schema(usage.EVENTS).option("maxFilesPerTrigger", 2).parquet(path))


def run(own, path, out, wait=None, **how):
    query = totals.start(totals.running_totals(stream(own, path), **how), f"{out}/totals", f"{out}/checkpoint")
    end = time.time() + 40
    while wait and time.time() < end and not (glob.glob(f"{out}/totals/*/*.parquet") and wait()):
        time.sleep(1)
    totals.drained(query, 90)


def rows(df):
    return sorted((r["skill"], r["calls"], r["successes"], r["total_us"], r["items"]) for r in df.collect())


def batch(events):
    e = totals.from_events(events).withColumn("skill", F.coalesce("skill", F.lit("")))
    once = e.where("event_id is not null").dropDuplicates(["event_id"]).unionByName(e.where("event_id is null"))
    return rows(once.groupBy("skill").agg(F.count("*").alias("calls"), F.sum(F.coalesce("success", F.lit(False)).cast("long")).alias("successes"), F.sum(F.coalesce("us", F.lit(0))).alias("total_us"), F.sum("items").alias("items")))


def test_restart_with_late_and_repeated_events(spark, own, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    later, early = events.where("event_id >= 400"), events.where("event_id < 400")
    odd = spark.createDataFrame([(None, None, 1, "click", 2.5, None), (None, None, 1, "click", 2.5, None), (5_000, None, 1, None, None, '{"k": 3}')], usage.EVENTS)
    put = lambda df: df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(later)
    put(later.where("event_id % 3 = 0"))
    run(own, f"{tmp_path}/in", tmp_path, shards=3)
    assert rows(totals.merged(spark, f"{tmp_path}/totals")) == batch(later)
    # stopped; late events, and events that were counted before the stop
    put(early)
    put(events.where("event_id % 5 = 0"))
    put(odd)
    run(own, f"{tmp_path}/in", tmp_path, shards=3)
    assert rows(totals.merged(spark, f"{tmp_path}/totals")) == batch(events.unionByName(odd.withColumn("user_id", F.col("user_id").cast("long"))))
    written = spark.read.schema(totals.TOTALS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/totals")
    assert written.groupBy("skill", "shard", "version").count().where("count > 1").count() == 0  # no change was written twice
    assert written.select("shard").distinct().count() == 3


def test_idle_keys_are_marked(spark, own, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").where("event_id < 40").coalesce(1).write.parquet(f"{tmp_path}/in")
    idle = lambda: totals.merged(spark, f"{tmp_path}/totals").where("idle").count() == 5
    run(own, f"{tmp_path}/in", tmp_path, wait=idle, shards=1, quiet_ms=2_000)
    assert idle() and rows(totals.merged(spark, f"{tmp_path}/totals")) == batch(spark.read.parquet(f"{tmp_path}/in"))


def test_ids_are_forgotten_after_their_time(spark, own, tmp_path):
    some = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 30").coalesce(1)
    some.write.mode("append").parquet(f"{tmp_path}/in")
    run(own, f"{tmp_path}/in", tmp_path, shards=1, keep_ms=1)
    some.write.mode("append").parquet(f"{tmp_path}/in")
    run(own, f"{tmp_path}/in", tmp_path, shards=1, keep_ms=1)
    assert [2 * c for _, c, *_ in batch(some)] == [r[1] for r in rows(totals.merged(spark, f"{tmp_path}/totals"))]
