"""Evaluation and usage metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def regression(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """r2, mae, rmse and n over rows whose prediction and label are numbers; NaN where there is nothing to measure."""
    by = by or []
    own = df.where(F.col(prediction).isNotNull() & ~F.isnan(prediction) & F.col(label).isNotNull() & ~F.isnan(label))
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    # the spread is summed around each group's mean, which a first pass finds
    mean = own.groupBy(*by).agg(F.avg(y).alias("__mean"))
    met = own.join(F.broadcast(mean), by) if by and mean.limit(10_001).count() <= 10_000 else own.join(mean, by) if by else own.join(F.broadcast(mean))
    sums = met.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum((y - p) ** 2).alias("res"), F.sum((y - F.col("__mean")) ** 2).alias("tot"), F.avg(F.abs(y - p)).alias("mae"))
    nan = F.lit(NAN)
    return sums.select(*by, F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).otherwise(nan).alias("r2"), F.coalesce("mae", nan).alias("mae"), F.when(F.col("n") > 0, F.sqrt(F.col("res") / F.col("n"))).otherwise(nan).alias("rmse"), "n")


def regression_pooled(df: DataFrame, labels: list[str], predictions: list[str]) -> DataFrame:
    """r2, mae, rmse and n of several tasks together: rows without one of the predictions are left out, each task's spread is around its own
    mean, and errors are pooled over all cells; n counts rows."""
    own = df
    for p in predictions:
        own = own.where(F.col(p).isNotNull() & ~F.isnan(p))
    means = own.agg(*[F.avg(c).alias(f"__{i}") for i, c in enumerate(labels)])
    met = own.join(F.broadcast(means))
    cells = list(zip(labels, predictions, strict=True))
    res = sum(((F.col(y) - F.col(p)) ** 2 for y, p in cells), F.lit(0.0))
    tot = sum(((F.col(y) - F.col(f"__{i}")) ** 2 for i, y in enumerate(labels)), F.lit(0.0))
    err = sum((F.abs(F.col(y) - F.col(p)) for y, p in cells), F.lit(0.0))
    s = met.agg(F.count(F.lit(1)).alias("n"), F.sum(res).alias("res"), F.sum(tot).alias("tot"), F.sum(err).alias("err"))
    nan, k = F.lit(NAN), len(labels)
    return s.select(F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).otherwise(nan).alias("r2"), F.when(F.col("n") > 0, F.col("err") / (F.col("n") * k)).otherwise(nan).alias("mae"), F.when(F.col("n") > 0, F.sqrt(F.col("res") / (F.col("n") * k))).otherwise(nan).alias("rmse"), "n")


def uncertainty(df: DataFrame, key: str = "mol_id", value: str = "prediction") -> DataFrame:
    """Mean and population deviation of repeated predictions."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def _stats(success: Column, ms: Column, items: Column) -> list[Column]:
    calls, ok, total, n = F.count(F.lit(1)), F.count_if(success), F.sum(ms), F.sum(items)
    return [
        calls.alias("calls"), ok.alias("successes"), (calls - ok).alias("failures"), total.alias("total_ms"), n.alias("items"), (ok / calls).alias("success_rate"),
        (total / calls).alias("avg_ms"), F.when(total > 0, n / (total / 1000.0)).otherwise(F.lit(0.0)).alias("throughput"),
    ]


def skill_stats(events: DataFrame, by: list[Column | str]) -> DataFrame:
    """Calls, successes, time and items of (success, duration_ms, batch_size) events by the given columns."""
    return events.groupBy(*by).agg(*_stats(F.col("success"), F.col("duration_ms"), F.col("batch_size")))


def from_events(events: DataFrame) -> DataFrame:
    """The table events as usage events: the type is the skill, errors fail, value is the time, the props' k the items."""
    return events.select(
        F.col("event_type").alias("skill"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("duration_ms"),
        F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(1)).alias("batch_size"), "ts",
    )
