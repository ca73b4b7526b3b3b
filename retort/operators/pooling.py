"""Pooling of token vectors: the mean over the tokens that a mask keeps.

Vectors come a row each, (key, vector, mask). Each task adds up the vectors of a key batch by batch in numpy; Spark adds up what is left, a row for each key and batch, so that a key
of any number of tokens never meets in one task.

Defined cases: a null mask or vector leaves the token out; a key without kept tokens has a null mean; vectors of different lengths are an error; NaN stays NaN.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sums(width: int):
    def run(batches):
        for b in batches:
            coded = b.column(0).dictionary_encode(null_encoding="encode")
            n, of = len(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
            vectors, kept = b.column(1), b.column(2).fill_null(0).to_numpy(zero_copy_only=False) != 0
            there = np.asarray(vectors.is_valid()) & kept
            lengths = np.asarray(vectors.value_lengths().fill_null(-1))[there]
            if (lengths != width).any():
                raise ValueError(f"vectors of {sorted(set(lengths.tolist()))} numbers where {width} were expected")
            own = vectors.filter(pa.array(there)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total = np.zeros((n, width))
            np.add.at(total, of[there], own)
            count = np.bincount(of[there], minlength=n)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(count, pa.int64())], names=["key", "total", "n"])

    return run


def masked_mean(tokens: DataFrame, width: int, key: str = "key", vector: str = "vector", mask: str = "mask") -> DataFrame:
    """(key, n, mean): how many tokens a key's mask keeps, and the mean of their vectors of width numbers."""
    own = tokens.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.col(mask).cast("int").alias("mask"))
    parts = own.mapInArrow(_sums(width), f"key {own.schema['key'].dataType.simpleString()}, total array<double>, n long")
    summed = parts.groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(width)])
    return summed.select(F.col("key").alias(key), "n", F.when(F.col("n") > 0, F.array(*[F.col(f"s{i}") / F.col("n") for i in range(width)])).alias("mean"))
