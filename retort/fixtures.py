"""The molecule table of the queries: a fixed pool of SMILES dealt over the rows of ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread

# The SMILES pool, by 0-based pool_id.
POOL = [
    "CCO", "c1ccccc1", "CC(=O)O", "c1cccnc1", "CC(C)O", "CCCO", "CCCCO", "CCc1ccccc1", "Cc1ccccc1", "c1ccc(O)cc1",
    "CC(=O)Oc1ccccc1C(=O)O", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "CC(=O)Nc1ccc(O)cc1", "OC(=O)c1ccccc1O", "CC(C)Cc1ccc(cc1)C(C)C(=O)O",
    "c1ccc2c(c1)cc1ccc3cccc4ccc2c1c34", "O=C(O)c1ccc(N)cc1", "CC1=C2C(=O)c3ccccc3C2(CC1=O)O", "Nc1ccc(cc1)S(N)(=O)=O", "[Na+].OC(=O)c1ccccc1",
    "c1ccc2ccccc2c1", "CN1CCC[C@H]1c2cccnc2", "CC12CCC3C(C1CCC2O)CCC4=CC(=O)CCC34C", "c1ccc(cc1)C(=O)O", "C1CCCCC1", "c1ccncc1", "CC(=O)N", "CC(N)C(=O)O",
    "c1ccc(nc1)N", "COc1ccc(cc1OC)C2CC(=O)c3ccc(OC)c(OC)c3C2", "c1ccccc1C(=O)O", "c1ccccc1C(=O)N", "c1ccc(F)cc1", "c1ccc(Cl)cc1", "c1ccc(Br)cc1",
    "c1ccc(N)cc1", "C1=CC=CC=C1", "C#C", "N[C@H](C)C(=O)O", "INVALID_SMILES",
]
# Drawings, the compound that each one shows, and the substance whose tautomer it is, all by hand.
FORMS = [
    ("C[C@H]1CC[C@H](O)CC1", "trans-4-methylcyclohexanol", "trans-4-methylcyclohexanol"), ("O[C@H]1CC[C@H](C)CC1", "trans-4-methylcyclohexanol", "trans-4-methylcyclohexanol"),
    ("C[C@@H]1CC[C@@H](O)CC1", "trans-4-methylcyclohexanol", "trans-4-methylcyclohexanol"), ("C[C@H]1CC[C@@H](O)CC1", "cis-4-methylcyclohexanol", "cis-4-methylcyclohexanol"),
    ("O[C@@H]1CC[C@H](C)CC1", "cis-4-methylcyclohexanol", "cis-4-methylcyclohexanol"), ("CC1CCC(O)CC1", "4-methylcyclohexanol", "4-methylcyclohexanol"),
    ("C[C@H]1CCCCC1", "methylcyclohexane", "methylcyclohexane"), ("CC1CCCCC1", "methylcyclohexane", "methylcyclohexane"), ("N[C@@H](C)C(=O)O", "L-alanine", "L-alanine"), ("C[C@H](N)C(=O)O", "L-alanine", "L-alanine"),
    ("N[C@H](C)C(=O)O", "D-alanine", "D-alanine"), ("F/C=C/F", "E-difluoroethene", "E-difluoroethene"), ("F\\C=C\\F", "E-difluoroethene", "E-difluoroethene"), ("F/C=C\\F", "Z-difluoroethene", "Z-difluoroethene"),
    ("CC(=O)C", "acetone", "acetone"), ("CC(O)=C", "propen-2-ol", "acetone"), ("CC(=O)CC(C)=O", "pentane-2,4-dione", "pentane-2,4-dione"), ("CC(O)=CC(C)=O", "4-hydroxypent-3-en-2-one", "pentane-2,4-dione"),
    ("Oc1ccncc1", "4-hydroxypyridine", "4-pyridone"), ("O=c1cc[nH]cc1", "4-pyridone", "4-pyridone"), ("O=C1C=CNC=C1", "4-pyridone", "4-pyridone"), ("Oc1ccccn1", "2-hydroxypyridine", "2-pyridone"), ("O=C1C=CC=CN1", "2-pyridone", "2-pyridone"),
    ("CC(=O)NC", "N-methylacetamide", "N-methylacetamide"), ("CC(O)=NC", "N-methylethanimidic acid", "N-methylacetamide"), ("Cc1c[nH]cn1", "4-methyl-1H-imidazole", "methylimidazole"), ("Cc1cnc[nH]1", "5-methyl-1H-imidazole", "methylimidazole"),
    ("CN1C=CN=C1", "1-methylimidazole", "1-methylimidazole"), ("CC(=N)NC1CC1", "N-cyclopropylacetamidine", "cyclopropylacetamidine"), ("CC(N)=NC1CC1", "N'-cyclopropylacetamidine", "cyclopropylacetamidine"),
    ("Oc1ccnc(O)n1", "pyrimidine-2,4-diol", "uracil"), ("O=c1cc[nH]c(=O)[nH]1", "uracil", "uracil"), ("Oc1ccccc1", "phenol", "phenol"), ("O=C1CCCCC1", "cyclohexanone", "cyclohexanone"), ("OC1=CCCCC1", "cyclohexen-1-ol", "cyclohexanone"),
    ("c1ccc2[nH]ncc2c1", "1H-indazole", "indazole"), ("c1ccc2n[nH]cc2c1", "2H-indazole", "indazole"), ("SC1=NCCN1", "4,5-dihydroimidazole-2-thiol", "imidazolidine-2-thione"), ("S=C1NCCN1", "imidazolidine-2-thione", "imidazolidine-2-thione"),
    ("Nc1ccccn1", "2-aminopyridine", "2-aminopyridine"), ("N=C1C=CC=CN1", "pyridin-2-imine", "2-aminopyridine"),
]
VALID_POOL = [s for s in POOL if s != "INVALID_SMILES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(POOL)), "pool_id long, smiles string")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mol_id, pool_id, smiles, label), a row for each part."""
    part = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mol_id"), F.col("p_retailprice").alias("label")))
    # the pool has a fixed 40 rows
    return part.withColumn("pool_id", F.pmod("mol_id", F.lit(len(POOL)))).join(F.broadcast(pool(spark)), "pool_id").select("mol_id", "pool_id", "smiles", "label")


def distinct_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library with a chain of C, N and O behind each molecule that spells its number to base 3, so that no two valid ones are equal."""
    return library(spark, sf_dir).withColumn("smiles", F.concat("smiles", F.translate(F.conv("mol_id", 10, 3), "012", "CNO")))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mol_id, form_id, smiles): a drawing of FORMS for each part."""
    drawn = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(FORMS)], "form_id long, smiles string")
    part = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("mol_id"), F.pmod("p_partkey", F.lit(len(FORMS))).alias("form_id"))
    return part.join(F.broadcast(drawn), "form_id").select("mol_id", "form_id", "smiles")  # a fixed number of rows


def pool_sql() -> str:
    return "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(POOL)) + ")"
