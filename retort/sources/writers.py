"""Writers: Parquet of both layouts, SDF, TSV and SMILES splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import molblock


def word_bytes(fp: Column) -> Column:
    """Packed little-endian bytes of words."""
    pairs = lambda w: F.array_join(F.reverse(F.filter(F.split(F.regexp_replace(F.lpad(F.hex(w), 16, "0"), "(..)", "$1,"), ","), lambda x: x != "")), "")
    return F.unhex(F.array_join(F.transform(fp, pairs), ""))


def bit_bytes(fp: Column) -> Column:
    """A byte for each bit."""

    def run(rows: pa.Array) -> pa.Array:
        n = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        words = rows.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(n * 64))).astype(np.int32)
        out = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.unpackbits(words.view(np.uint8), bitorder="little"))])
        return pc.if_else(rows.is_valid(), out, pa.scalar(None, pa.binary()))

    return F.arrow_udf(run, T.BinaryType())(fp)


def dataset_columns(df: DataFrame) -> DataFrame:
    """df (smiles, fp and others) in the dataset layout."""
    if "fp" not in df.columns:
        return df
    return df.withColumns({"fingerprints": bit_bytes(F.col("fp")), "fp_nbits": (F.size("fp") * 64).cast("int")}).drop("fp")


def record_columns(df: DataFrame) -> DataFrame:
    """df (smiles, parsed, mw, logp, heavy_atoms, fp) in the record layout."""
    return df.select("smiles", F.coalesce(F.size("parsed.z"), F.lit(0)).cast("int").alias("n_atoms"), F.coalesce(F.size("parsed.src"), F.lit(0)).cast("int").alias("n_bonds"), F.col("mw").cast("float").alias("mw"), F.col("logp").cast("float").alias("logp"), F.col("heavy_atoms").cast("int").alias("heavy_atoms"), word_bytes(F.col("fp")).alias("fingerprint"))


def parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    df.write.option("compression", compression).parquet(path)


def sdf_text(df: DataFrame, props: list[str] | None = None, smiles: str = "smiles") -> DataFrame:
    """(value): SDF records without their end mark; invalid text is an empty record."""
    props = [c for c in df.columns if c != smiles] if props is None else props
    block = F.coalesce(molblock(smiles), F.lit("\n  retort\n\n  0  0  0  0  0  0  0  0  0  0999 V2000\nM  END"))
    tags = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"> <{c}>\n"), F.col(c).cast("string"), F.lit("\n\n"))).otherwise(F.lit("")) for c in props]
    return df.select(F.concat(block, F.lit("\n"), *tags).alias("value"))


def sdf(df: DataFrame, path: str, props: list[str] | None = None, smiles: str = "smiles") -> None:
    sdf_text(df, props, smiles).write.option("lineSep", "$$$$\n").text(path)


def screen_tsv(df: DataFrame, path: str) -> None:
    """rank, smiles, similarity with four decimals."""
    df.select("rank", "smiles", F.format_string("%.4f", "similarity").alias("similarity")).orderBy("rank").write.option("sep", "\t").option("header", True).csv(path)


def tsv(df: DataFrame, path: str) -> None:
    plain = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*plain).write.option("sep", "\t").option("header", True).csv(path)


def splits(df: DataFrame, path: str) -> None:
    """A folder of SMILES text for each split."""
    df.select("split", F.col("smiles").alias("value")).write.partitionBy("split").text(path)
