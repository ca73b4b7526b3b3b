"""Readers: SMILES lists, SDF, FASTA, Parquet of both layouts, and records of compound services."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import WORDS, from_molblock

MAX_SMILES, MAX_BLOCK, MAX_PROTEIN = 10_000, 1_024_000, 100_000
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def checked_path(path: str, suffixes: tuple[str, ...] = ()) -> str:
    if "\0" in path:
        raise ValueError("a path may not hold NUL")
    if suffixes and not path.lower().endswith(suffixes):
        raise ValueError(f"{path} must end with one of {suffixes}")
    return path


def smiles_file(spark: SparkSession, path: str, first_token: bool = False) -> DataFrame:
    """(smiles) of the lines that are not blank."""
    line = F.trim("value")
    own = spark.read.text(path).select((F.split(line, r"\s+")[0] if first_token else line).alias("smiles"))
    return own.where(F.length("smiles") > 0)


def from_list(spark: SparkSession, smiles: list[str], labels: list[float] | None = None) -> DataFrame:
    """(mol_id, smiles[, label]) of a list in the driver's memory."""
    if labels is not None and len(labels) != len(smiles):
        raise ValueError("labels and smiles differ in length")
    rows = [(i, s) if labels is None else (i, s, labels[i]) for i, s in enumerate(smiles)]
    return spark.createDataFrame(rows, "mol_id long, smiles string" + ("" if labels is None else ", label double"))


def sdf(spark: SparkSession, path: str) -> DataFrame:
    """(smiles, block, props): a row for each readable record of SDF files, plain or gzip."""
    raw = spark.read.option("lineSep", "$$$$\n").text(path).where(F.length(F.trim("value")) > 0)
    return sdf_records(raw.select(F.regexp_replace("value", "\r", "").alias("record")))


def sdf_records(df: DataFrame) -> DataFrame:
    end = F.locate("M  END", F.col("record"))
    own = df.where(end > 0).select(F.substr("record", F.lit(1), end + 5).alias("block"), F.substr("record", end + 6).alias("tail"))

    def props(tails: pd.Series) -> pd.Series:
        return pd.Series([{k: v.strip("\n") for k, v in re.findall(r"^>.*?<([^>]*)>.*\n((?:.*\S.*\n?)*)", t or "", re.M)} for t in tails])

    own = own.select("block", F.pandas_udf(props, T.MapType(T.StringType(), T.StringType()))("tail").alias("props"))
    return own.withColumn("smiles", from_molblock("block")).where("smiles is not null").select("smiles", "block", "props")


def with_props(df: DataFrame) -> DataFrame:
    """df of sdf() with a column for each property of any record; missing ones are empty text. The names pass through the driver."""
    names = [r[0] for r in df.select(F.explode(F.map_keys("props"))).distinct().orderBy("col").collect()]
    return df.select("smiles", *[F.coalesce(F.col("props")[n], F.lit("")).alias(n) for n in names])


def fasta(spark: SparkSession, path: str) -> DataFrame:
    return fasta_records(spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>|\r", "").alias("record")))


def fasta_records(df: DataFrame) -> DataFrame:
    """(name, sequence) of valid records: lines after the header joined in capitals, comment lines skipped."""
    lines = F.split("record", "\n")
    body = F.filter(F.slice(lines, 2, 1 << 30), lambda x: ~F.startswith(F.trim(x), F.lit(";")))
    own = df.select(F.trim(lines[0]).alias("name"), F.upper(F.regexp_replace(F.array_join(body, ""), r"\s", "")).alias("sequence"))
    return own.where((F.length("name") > 0) & valid_protein("sequence"))


def fasta_string(spark: SparkSession, text: str) -> DataFrame:
    """Records of a FASTA text; what stands before the first header is left out."""
    start = text.find(">")
    rows = [(r,) for r in re.split(r"\n>", text[start + 1 :])] if start >= 0 else []
    return fasta_records(spark.createDataFrame(rows, "record string"))


def valid_protein(c: str) -> Column:
    return F.col(c).rlike(f"^[{RESIDUES}]+$") & (F.length(c) <= MAX_PROTEIN)


def valid_smiles(c: str) -> Column:
    return F.col(c).isNotNull() & (F.length(c) <= MAX_SMILES)


def dataset_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The dataset layout, by names; fingerprints of a byte for each bit become words under fp."""
    df = spark.read.parquet(checked_path(path, (".parquet", ".pq", "/")) if path.endswith((".parquet", ".pq")) else path)
    return df.withColumn("fp", bytes_to_words("fingerprints")) if "fingerprints" in df.columns else df


def labels_of(df: DataFrame) -> list[str]:
    """label, or label_0, label_1, ... in order."""
    many = sorted((int(m[1]), c) for c in df.columns if (m := re.fullmatch(r"label_(\d+)", c)))
    return ["label"] if "label" in df.columns else [c for _, c in many]


RECORD = T.StructType([
    T.StructField("smiles", T.StringType()), T.StructField("n_atoms", T.IntegerType()), T.StructField("n_bonds", T.IntegerType()), T.StructField("mw", T.FloatType()),
    T.StructField("logp", T.FloatType()), T.StructField("heavy_atoms", T.IntegerType()), T.StructField("fingerprint", T.BinaryType()),
])


def record_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The record layout: fingerprints of 256 packed bytes, which may be null."""
    return spark.read.schema(RECORD).parquet(path)


def bytes_to_words(c: Column | str) -> Column:
    """Words of a binary column with a byte for each bit; bytes beyond the last whole word are left out."""

    def run(rows: pa.Array) -> pa.Array:
        if not len(rows):
            return pa.array([], pa.list_(pa.int64()))
        own = rows.cast(pa.binary()).fill_null(b"")
        at = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]
        data, size = np.frombuffer(own.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], np.diff(at)
        if (size % 64).any():
            data = data[np.arange(len(data)) - np.repeat(at[:-1] - at[0], size) < np.repeat(size // 64 * 64, size)]
        words = np.packbits(data & 15 == 1, bitorder="little").view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size // 64))), pa.int32()), pa.array(words), mask=rows.is_null())

    return F.arrow_udf(run, WORDS)(c)


# Records of compound services, from their JSON text.


def chembl_records(df: DataFrame, json: str = "json") -> DataFrame:
    get = lambda path: F.get_json_object(json, path)
    number = lambda path, kind: F.coalesce(get(path).try_cast(kind), F.lit(0).cast(kind))
    p = "$.molecule_properties."
    return df.select(
        F.coalesce(get("$.molecule_chembl_id"), F.lit("")).alias("chembl_id"), F.coalesce(get("$.molecule_structures.canonical_smiles"), F.lit("")).alias("smiles"), F.coalesce(get("$.pref_name"), F.lit("")).alias("name"),
        number(p + "full_mwt", "double").alias("mw"), number(p + "alogp", "double").alias("logp"), number(p + "hba", "int").alias("hba"), number(p + "hbd", "int").alias("hbd"),
        number(p + "psa", "double").alias("tpsa"), number(p + "num_ro5_violations", "int").alias("ro5_violations"),
    )


def chembl_search(df: DataFrame, json: str = "json") -> DataFrame:
    """Records of search answers: their list of molecules."""
    own = df.select(F.explode(F.from_json(F.get_json_object(json, "$.molecules"), "array<string>")).alias("json"))
    return chembl_records(own)


def chembl_activities(df: DataFrame, json: str = "json") -> DataFrame:
    """Records of activity answers: their list of activities; a value that is no number is null."""
    one = "array<struct<molecule_chembl_id: string, canonical_smiles: string, standard_value: string, standard_units: string, assay_chembl_id: string>>"
    own = df.select(F.inline(F.from_json(F.get_json_object(json, "$.activities"), one)))
    return own.withColumn("standard_value", F.col("standard_value").try_cast("double"))


def chembl_smiles(ids: DataFrame, records: DataFrame) -> DataFrame:
    """(chembl_id, smiles) of the asked ids (column chembl_id) among chembl_records(); ids without a record or structure are left out."""
    return ids.select("chembl_id").distinct().join(records.where(F.length("smiles") > 0).select("chembl_id", "smiles"), "chembl_id")


# The well-known subsets.
ZINC_SUBSETS = ["Drug-Like", "Lead-Like", "Fragment-Like", "Lugs", "Goldilocks", "Big-n-Greasy"]


def zinc_tranche(spark: SparkSession, path: str, max_mols: int = 1000) -> DataFrame:
    """(smiles): the first words of a tranche file's first max_mols lines that are not blank. The cap is the search's own."""
    own = smiles_file(spark, path, first_token=True).withColumn("at", F.monotonically_increasing_id())
    return own.orderBy("at").limit(max_mols).select("smiles")


def zinc_records(df: DataFrame, json: str = "json") -> DataFrame:
    get = lambda path: F.get_json_object(json, path)
    return df.select(F.coalesce(get("$.zinc_id"), F.lit("")).alias("zinc_id"), F.coalesce(get("$.smiles"), F.lit("")).alias("smiles"), F.coalesce(get("$.mwt").try_cast("double"), F.lit(0.0)).alias("mw"), F.coalesce(get("$.logp").try_cast("double"), F.lit(0.0)).alias("logp"))


def zinc_sample(df: DataFrame, low: float, high: float, n: int) -> DataFrame:
    return df.where(F.col("mw").between(low, high)).orderBy("zinc_id").limit(n)


def bindingdb(df: DataFrame, target: str, max_records: int = 1000, order: list[str] | None = None) -> DataFrame:
    """Records whose target matches, whatever its case; df: Drug, Target, optional Target_ID, Y. The cap is the search's own."""
    c = "Target_ID" if "Target_ID" in df.columns else "Target"
    own = df.where(F.col(c).rlike(f"(?i){target}"))
    own = own.orderBy(*(order or [x for x in ("Drug", "Target", "Y") if x in df.columns])).limit(max_records)
    return own.select(F.col("Drug").alias("smiles"), F.col("Target").alias("target_sequence"), F.col("Y").cast("double").alias("affinity"), F.lit("Kd").alias("affinity_type"), F.col(c).alias("target_name"))


def dataset(records: DataFrame, label: str | None = None, pic50: bool = False) -> DataFrame:
    """Records as a molecule table: rows without SMILES are left out; label from a column, as pIC50 of nM where asked."""
    from ..operators.descriptors import pic50 as log

    own = records.where(F.length("smiles") > 0)
    return own if label is None else own.withColumn("label", log(label) if pic50 else F.col(label).cast("double"))


def tdc_splits(df: DataFrame, method: str = "scaffold", seed: int = 42, train: float = 0.7, valid: float = 0.1) -> dict[str, DataFrame]:
    """train, valid and test of a benchmark table (Drug, Y and perhaps Target, Target_ID). A column split is used as it is; else molecules are split
    by scaffold, or at random by a seeded hash of the row."""
    from ..operators import split

    if method not in ("scaffold", "random"):
        raise ValueError(f"unknown split method {method!r}")
    if "split" in df.columns:
        own = df
    elif method == "random":
        part = F.pmod(F.xxhash64(*[c for c in df.columns], F.lit(seed)), F.lit(1_000_000)) / 1_000_000
        own = df.withColumn("split", F.when(part < train, "train").when(part < train + valid, "valid").otherwise("test"))
    else:
        named = split.with_scaffold(df.withColumn("smiles", F.col("Drug")))
        own = split.scaffold_split(named, train, valid, order="smiles").withColumn("split", F.when(F.col("split") == "val", "valid").otherwise(F.col("split"))).drop("smiles", "scaffold")
    return {k: own.where(F.col("split") == k).drop("split") for k in ("train", "valid", "test")}


def tdc_molecules(frame: DataFrame, name: str, split: str, log_transform: bool = True) -> DataFrame:
    """A split as a molecule table: labels other than 0 and 1 are values in nM and become pIC50 where asked; name, split and target go along."""
    from ..operators.descriptors import pic50 as log

    y = F.col("Y").cast("double")
    values = log_transform and bool(frame.where(~y.isin(0.0, 1.0)).limit(1).count())
    more = {"Target": "protein_sequence", "Target_ID": "target_id"}
    return frame.select(
        F.col("Drug").alias("smiles"), (log(y) if values else y).alias("label"), F.lit(name).alias("tdc_dataset"), F.lit(split).alias("tdc_split"), *[F.col(c).alias(n) for c, n in more.items() if c in frame.columns]
    )


def from_pandas(spark: SparkSession, pdf: pd.DataFrame, smiles: str = "smiles", label: str | None = None) -> DataFrame:
    df = spark.createDataFrame(pdf).withColumnRenamed(smiles, "smiles")
    return df.withColumnRenamed(label, "label") if label else df
