"""Additive descriptors of the compat reading, thresholds and rules, in built-in functions.

Masses and increments are summed as integers and divided once, so results do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..functions.elements import LOGP_CENTI, MASS_MILLI


def _sum(table: dict[int, int], other) -> Column:
    known = F.create_map(*[F.lit(x) for z, v in table.items() for x in (z, v)])
    return F.aggregate(F.transform("parsed.z", lambda z: F.coalesce(F.element_at(known, z), other(z)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)


def builtin(df: DataFrame) -> DataFrame:
    """df (with the column parsed) with mw (without hydrogens), logp and heavy_atoms; zeros for invalid text."""
    zero = lambda c: F.when(F.col("parsed.ok"), c).otherwise(F.lit(0))
    return df.withColumns({
        "mw": zero(_sum(MASS_MILLI, lambda z: z * 2000)) / F.lit(1000.0),
        "logp": zero(_sum(LOGP_CENTI, lambda z: F.lit(0))) / F.lit(100.0),
        "heavy_atoms": zero(F.size("parsed.z")).cast("int"),
    })


def full(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """df with mw, logp and tpsa of the full reading; invalid text stops the query."""
    d = columns.descriptors(smiles, ["MolWt", "MolLogP", "TPSA"])
    own = df.withColumn("__d", d)
    check = lambda c: F.when(F.isnan(f"__d.{c}"), F.raise_error(F.lit("invalid SMILES"))).otherwise(F.col(f"__d.{c}"))
    return own.withColumns({"mw": check("MolWt"), "logp": check("MolLogP"), "tpsa": check("TPSA")}).drop("__d")


def named(df: DataFrame, names: list[str] | None = None, preset: str | None = "lipinski", smiles: str = "smiles") -> DataFrame:
    """df with a column for each descriptor. A preset, the default too, wins over names: give None for the names to count."""
    chosen = columns.chosen_descriptors(names, preset)
    own = df.withColumn("__d", columns.descriptors(smiles, chosen))
    return own.select(*df.columns, *[F.col(f"__d.{n}").alias(n) for n in chosen])


def pic50(nanomolar: Column | str) -> Column:
    c = F.col(nanomolar) if isinstance(nanomolar, str) else nanomolar
    return -F.log10(F.greatest(c * 1e-9, F.lit(1e-15)))


def rule_of_five(mw: str = "mw", logp: str = "logp") -> Column:
    return (F.col(mw) <= 500) & (F.col(logp) <= 5)


def rule_flags(df: DataFrame) -> DataFrame:
    """df with lipinski_pass, veber_pass, egan_pass from mw, logp, hbd, hba, rot_bonds, tpsa."""
    c = F.col
    return df.withColumns({
        "lipinski_pass": (c("mw") <= 500) & (c("logp") <= 5) & (c("hbd") <= 5) & (c("hba") <= 10),
        "veber_pass": (c("rot_bonds") <= 10) & (c("tpsa") <= 140),
        "egan_pass": (c("logp") <= 5.88) & (c("tpsa") <= 131.6),
    })


def admet(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """df with the rule-based profile: descriptors, rules, alerts, druglike, parse_error. Rules are decided before values are rounded."""
    names = {"mw": "MolWt", "logp": "MolLogP", "hbd": "NumHDonors", "hba": "NumHAcceptors", "tpsa": "TPSA", "rot_bonds": "NumRotatableBonds", "rings": "RingCount", "heavy_atoms": "HeavyAtomCount"}
    own = df.withColumn("__d", columns.descriptors(smiles, list(names.values())))
    own = own.withColumn("parse_error", F.isnan("__d.MolWt")).withColumns({k: F.when(F.col("parse_error"), F.lit(0.0)).otherwise(F.col(f"__d.{v}")) for k, v in names.items()})
    own = rule_flags(own).withColumns({k: F.coalesce(columns.alerts(smiles, w), F.array().cast("array<string>")) for k, w in (("pains_alerts", "PAINS"), ("brenk_alerts", "BRENK"))})
    ok = ~F.col("parse_error")
    own = own.withColumns({k: ok & F.col(k) for k in ("lipinski_pass", "veber_pass", "egan_pass")})
    own = own.withColumn("druglike", F.col("lipinski_pass") & F.col("veber_pass") & (F.size("pains_alerts") == 0))
    rounded = {"mw": F.round("mw", 2), "logp": F.round("logp", 3), "tpsa": F.round("tpsa", 2), **{k: F.col(k).cast("int") for k in ("hbd", "hba", "rot_bonds", "rings", "heavy_atoms")}}
    return own.withColumns(rounded).withColumns({"n_pains": F.size("pains_alerts"), "n_brenk": F.size("brenk_alerts")}).drop("__d")


def filter_by_smarts(df: DataFrame, smarts: str, invert: bool = False, smiles: str = "smiles") -> DataFrame:
    """Rows that hold the pattern, or with invert those that do not; invalid text is in neither."""
    return df.where(columns.matches(smiles, smarts) != F.lit(invert))


def transformed(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """df with smiles standardised; text that is not a molecule is left as it is."""
    return df.withColumn(smiles, F.coalesce(columns.standardize(smiles), F.col(smiles)))
