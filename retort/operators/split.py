"""Train, validation and test assignment, and folds."""

from __future__ import annotations

import random
import uuid
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import scaffold
from ..tables import shared_folder, stored


def with_scaffold(df: DataFrame, smiles: str = "smiles", generic: bool = False) -> DataFrame:
    """df with scaffold; invalid text is a group of its own, named by the text."""
    own = df.select(smiles).distinct().withColumn("scaffold", F.coalesce(scaffold(smiles, generic), F.col(smiles)))
    return df.join(own, smiles, "left").select(*[df[c] for c in df.columns], "scaffold")


def scaffold_groups(df: DataFrame, key: str = "scaffold", order: str = "mol_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("first"))


def scaffold_split(df: DataFrame, train: float = 0.8, val: float = 0.1, key: str = "scaffold", order: str = "mol_id", seed: int | None = None) -> DataFrame:
    """df with split. Groups go, largest first (ties by first member), whole to train until it has int(n * train) rows, then to val
    until it has int(n * val), then to test. seed is accepted and has no effect: the split is deterministic.

    Sizes are counted first: only groups of one size are ranked together."""
    groups = scaffold_groups(df, key, order)
    n = df.count()
    n_train, n_val = int(n * train), int(n * val)
    counts = groups.groupBy("size").agg((F.count(F.lit(1)) * F.col("size")).alias("rows"))  # a row for each distinct size
    larger = counts.select(F.col("size").alias("of_size"), F.coalesce(F.sum("rows").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("larger"))
    ranked = groups.join(larger, F.col("size") == F.col("of_size")).drop("of_size")
    g = ranked.withColumn("before", F.col("larger") + F.col("size") * (F.row_number().over(Window.partitionBy("size").orderBy("first")) - 1)).drop("larger")
    g = g.withColumn("in_train", F.col("before") < n_train)
    total = g.agg(F.coalesce(F.sum(F.when(F.col("in_train"), F.col("size"))), F.lit(0))).first()[0]
    g = g.withColumn("split", F.when(F.col("in_train"), "train").when(F.col("before") - total < n_val, "val").otherwise("test"))
    return df.join(g.select(key, "split"), key).select(*[df[c] for c in df.columns], "split")


#: Places of a shuffle that become rows at once.
PIECE = 1_000_000


def permutation(n: int, seed: int) -> np.ndarray:
    """Python's own shuffle of n places, 8 bytes each."""
    out = array("q", range(n))
    random.Random(seed).shuffle(out)
    return np.frombuffer(out, np.int64) if n else np.zeros(0, np.int64)


def _dealt(spark: SparkSession, n: int, k: int, seed: int) -> DataFrame:
    """(pos, fold): place i of the shuffle goes to fold i modulo k. More than a piece goes to the shared folder piece by piece."""
    places = permutation(n, seed)
    rows = lambda at: pd.DataFrame({"pos": places[at : at + PIECE], "fold": (np.arange(at, min(n, at + PIECE)) % k).astype(np.int32)})
    if n <= PIECE:
        return spark.createDataFrame(rows(0), "pos long, fold int")
    path = f"{shared_folder(spark)}/folds-{uuid.uuid4().hex}"
    for at in range(0, n, PIECE):
        spark.createDataFrame(rows(at), "pos long, fold int").write.mode("append").parquet(path)
    return spark.read.schema("pos long, fold int").parquet(path)


def kfold(df: DataFrame, k: int = 5, seed: int = 42, order: str = "mol_id") -> DataFrame:
    """df with pos (0-based place by order) and fold: place i of a seeded shuffle of all places goes to fold i modulo k.

    The shuffle is Python's own generator, as results must equal it; its n places are an array on the driver, 8 bytes each."""
    n = df.count()
    if k < 2 or n < k:
        raise ValueError("k must be at least 2 and at most the number of rows")
    return numbered(df, order).join(_dealt(df.sparkSession, n, k, seed), "pos").select(*df.columns, "pos", "fold")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with pos, each row's 0-based place by order, a column of any type that sorts: range partitions are sorted and stored, and each one's count
    is added to the places within the next ones."""
    spark = df.sparkSession
    own = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    own = stored(own.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    before, rows = 0, []
    for r in own.groupBy("__part").count().orderBy("__part").collect():  # a row for each partition
        rows.append((r["__part"], before))
        before += r["count"]
    starts = spark.createDataFrame(rows or [(0, 0)], "__part int, __before long")
    return own.join(F.broadcast(starts), "__part").withColumn("pos", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def scaffold_kfold(df: DataFrame, k: int = 5, seed: int = 42, key: str = "scaffold", order: str = "mol_id") -> DataFrame:
    """df with fold: groups, in order of first member, are shuffled; place i goes to fold i modulo k."""
    groups = scaffold_groups(df, key, order)
    n = groups.count()
    if k < 2:
        raise ValueError("k must be at least 2")
    own = numbered(groups, "first").join(_dealt(df.sparkSession, n, k, seed), "pos").select(key, "fold")
    return df.join(own, key).select(*[df[c] for c in df.columns], "fold")


def occurrence(df: DataFrame, key: str = "smiles", order: str = "mol_id") -> DataFrame:
    """df with occurrence, the 0-based number of a repeated key."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
