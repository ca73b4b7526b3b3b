"""Matched molecular pairs: cut, then join molecules that share a core."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import canonical, cuts
from ..tables import stored

#: Members of a core that one block of it holds, about; pairs that one task meets, about; tasks at most.
CORE_BLOCK, TASK_PAIRS, MOST_TASKS = 256, 1 << 22, 1 << 13


def fragments(df: DataFrame, max_cut_bonds: int = 1, radius: int = 3, smiles: str = "smiles") -> DataFrame:
    """(mol, core, variable, environment) of the distinct valid molecules, by canonical SMILES."""
    if max_cut_bonds not in (1, 2):
        raise ValueError("max_cut_bonds must be 1 or 2")
    own = df.select(smiles).distinct().select(canonical(smiles).alias("mol")).where("mol is not null").distinct()
    return own.withColumn("cut", F.explode(cuts("mol", max_cut_bonds, radius))).select("mol", "cut.*")


def pairs(frags: DataFrame) -> DataFrame:
    """Ordered pairs of molecules with one core and different variables. The environment is that of the core's first molecule.

    The members of a core with more than CORE_BLOCK are dealt over blocks by a hash, and each two blocks meet once. Few rows make many pairs, so the tasks are as many as the pairs ask for."""
    own = stored(frags, "fragments")
    cores = own.groupBy("core").agg(F.min_by("environment", "mol").alias("environment"), F.count(F.lit(1)).alias("n"))
    met = int(cores.agg(F.sum(F.col("n").cast("double") ** 2)).first()[0] or 0) // 2
    tasks = min(MOST_TASKS, max(own.sparkSession.sparkContext.defaultParallelism, met // TASK_PAIRS))
    own = own.drop("environment").join(cores.select("core", "environment", F.ceil(F.col("n") / CORE_BLOCK).alias("blocks")), "core")
    own = own.withColumn("block", F.pmod(F.xxhash64("mol"), F.col("blocks")))
    x = own.select("core", "environment", F.col("block").alias("part"), F.col("mol").alias("mol_x"), F.col("variable").alias("smiles_x"))
    y = own.select("core", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("part"), "block", F.col("mol").alias("mol_y"), F.col("variable").alias("smiles_y"))
    # within a block both orders of a pair meet, and one is kept
    both = y.repartition(tasks, "core", "part").join(x.repartition(tasks, "core", "part").hint("merge"), ["core", "part"])
    both = both.where("smiles_x <> smiles_y and if(block = part, mol_x < mol_y, mol_x <> mol_y)").withColumn("kept", F.col("mol_x") < F.col("mol_y"))
    a, b = (F.when(F.col("kept"), F.col(f"{c}_x")).otherwise(F.col(f"{c}_y")) for c in ("mol", "smiles")), (F.when(F.col("kept"), F.col(f"{c}_y")).otherwise(F.col(f"{c}_x")) for c in ("mol", "smiles"))
    (mol_a, smiles_a), (mol_b, smiles_b) = a, b
    return both.select(mol_a.alias("mol_a"), mol_b.alias("mol_b"), smiles_a.alias("smiles_a"), smiles_b.alias("smiles_b"), "core", F.concat(smiles_a, F.lit(">>"), smiles_b).alias("transform"), "environment")


def mmpa(df: DataFrame, max_cut_bonds: int = 1, radius: int = 3, smiles: str = "smiles") -> DataFrame:
    return pairs(fragments(df, max_cut_bonds, radius, smiles))
