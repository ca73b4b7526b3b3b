"""Reaction enumeration and comparisons over sets of molecules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns, transforms
from ..functions.molecule import SmilesError, parse_full
from ..tables import stored

#: Partners of a bimolecular reaction that go to the tasks at once.
PARTNERS = 10_000


def enumerate_products(df: DataFrame, smarts: str, max_products: int = 1000, smiles: str = "smiles") -> DataFrame:
    """(product): sorted distinct products of all molecules, the first max_products."""
    return df.select(smiles).distinct().select(F.explode(columns.react(smiles, smarts)).alias("product")).distinct().orderBy("product").limit(max_products)


def enumerate_pairs(a: DataFrame, b: DataFrame, smarts: str, max_products: int = 1000, smiles: str = "smiles") -> DataFrame:
    """Products of every pair. The partners of b go to the tasks in blocks of at most PARTNERS texts, so a large b is met block by block; only molecules that
    the reaction's patterns match are paired at all."""
    left, right = transforms.reaction(smarts)[0]
    fit = lambda df, name, p: df.where(columns.fits(smiles, p)).select(F.col(smiles).alias(name)).distinct()
    x, y = stored(fit(a, "a", left), "reactants"), stored(fit(b, "b", right), "partners")
    blocks = max(1, -(-y.count() // PARTNERS))
    out = None
    for block in range(blocks):
        part = y if blocks == 1 else y.where(F.pmod(F.xxhash64("b"), F.lit(blocks)) == block)
        one = x.join(F.broadcast(part)).select(F.explode(columns.react_pair("a", "b", smarts)).alias("product")).distinct()
        out = one if out is None else out.unionByName(one)
    return out.distinct().orderBy("product").limit(max_products)


def find_mcs(df: DataFrame, group: str, smiles: str = "smiles", most: int = 64) -> DataFrame:
    """(group, mcs, n): the common substructure of each group's distinct valid molecules. A group below two molecules, or beyond
    most of them, stops the query: the search is for small series."""

    def common(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mols = []
        for s in pdf[smiles]:
            try:
                mols.append(parse_full(s))
            except SmilesError:
                continue
        if len(mols) < 2:
            raise ValueError("at least two valid molecules are needed")
        return pd.DataFrame({group: [key[0]], "mcs": [transforms.mcs_smarts(mols)], "n": [len(mols)]})

    own = df.where(F.col(smiles).isNotNull()).select(group, smiles).distinct()
    sizes = own.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    fit = own.join(sizes, group).withColumn(smiles, F.when(F.col("__n") <= most, F.col(smiles)).otherwise(F.raise_error(F.lit("group is too large")))).drop("__n")
    kind = T.StructType([own.schema[group], T.StructField("mcs", T.StringType()), T.StructField("n", T.LongType())])
    return fit.groupBy(group).applyInPandas(common, kind)


def rgroup_decompose(df: DataFrame, core: str, smiles: str = "smiles") -> DataFrame:
    return df.withColumn("rgroups", columns.rgroups(smiles, core))
