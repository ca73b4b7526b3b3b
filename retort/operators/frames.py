"""Molecule tables as a whole: places, columns, and what must be there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..sources.readers import labels_of
from .similarity import on_bits
from .split import numbered


def take(df: DataFrame, index: int, order: str = "mol_id") -> DataFrame:
    """The row at a place by order; negative places count from the end; IndexError beyond."""
    n = df.count()
    if not -n <= index < n:
        raise IndexError(f"index {index} out of range for {n} rows")
    return numbered(df, order).where(F.col("pos") == index % n).drop("pos")


def subset(df: DataFrame, places: list[int], order: str = "mol_id") -> DataFrame:
    """The rows at the places, once for each time that a place is named, with at, the number in the list."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(places)), "at long, pos long")
    return numbered(df, order).join(F.broadcast(wanted), "pos").drop("pos")


def to_dataframe(df: DataFrame) -> DataFrame:
    """smiles, descriptors, labels and metadata; fingerprints are left out."""
    first = [c for c in ("smiles", "mw", "logp", "heavy_atoms", *labels_of(df)) if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in (*first, "fp", "fingerprints", "fp_nbits", "parsed")])


def require(df: DataFrame, what: str) -> list[str]:
    """The columns of fingerprints, descriptors or labels; ValueError if df has none."""
    there = {"fingerprints": [c for c in ("fp",) if c in df.columns], "descriptors": [c for c in ("mw", "logp", "heavy_atoms") if c in df.columns], "labels": labels_of(df)}[what]
    if not there:
        raise ValueError(f"the table has no {what}")
    return there


def add_fingerprints(df: DataFrame, kind: str = "ecfp4", nbits: int = 2048, radius: int = 2, backend: str = "rust", prefix: str = "fp", expand_cols: bool = False, smiles: str = "smiles") -> DataFrame:
    """df with the fingerprint's words in the column prefix, or with a column of 0 or 1 for each bit (prefix_0, prefix_1, ...)."""
    fp = columns.fingerprint(smiles, {"rdkit": "rdkit_path"}.get(kind.lower(), kind.lower()), radius, nbits, backend)
    if not expand_cols:
        return df.withColumn(prefix, fp)
    n = 167 if kind.lower() == "maccs" else nbits
    own = df.select(F.struct(*df.columns).alias("row"), fp.alias("words"))
    own = own.select("row", on_bits(F.col("words"), n).alias("bits"))
    return own.select("row.*", *[F.array_contains("bits", i).cast("int").alias(f"{prefix}_{i}") for i in range(n)])
