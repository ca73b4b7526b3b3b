"""Graph tables and arrays of parsed molecules, in built-in functions over the parsed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import parse
from ..functions.elements import MASS_MILLI_GRAPH

LABELS = {6: "C", 7: "N", 8: "O", 9: "F", 15: "P", 16: "S", 17: "Cl", 35: "Br", 53: "I"}
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def with_parsed(df: DataFrame, smiles: str = "smiles", mode: str = "compat") -> DataFrame:
    return df.withColumn("parsed", parse(smiles, mode))


def atoms(df: DataFrame, key: str = "mol_id") -> DataFrame:
    """A row for each atom of df's column parsed."""
    p = "parsed"
    zipped = F.arrays_zip(*[F.col(f"{p}.{c}").alias(c) for c in ("z", "aromatic", "charge", "num_hs", "degree", "in_ring", "hybridization", "chirality")])
    own = df.where(f"{p}.ok").select(key, F.posexplode(zipped).alias("idx", "a"))
    return own.select(key, "idx", F.col("a.z").alias("atomic_num"), F.col("a.aromatic").alias("is_aromatic"), *[F.col(f"a.{c}").alias(n) for c, n in (("charge", "formal_charge"), ("num_hs", "num_hs"), ("degree", "degree"), ("in_ring", "in_ring"), ("hybridization", "hybridization"), ("chirality", "chirality"))])


def bonds(df: DataFrame, key: str = "mol_id") -> DataFrame:
    """A row for each bond: bond_idx, src, dst, bond (1 single, 2 double, 3 triple, 4 aromatic)."""
    zipped = F.arrays_zip(*[F.col(f"parsed.{c}").alias(c) for c in ("src", "dst", "bond")])
    return df.where("parsed.ok").select(key, F.posexplode(zipped).alias("bond_idx", "b")).select(key, "bond_idx", "b.src", "b.dst", "b.bond")


def node_features() -> Column:
    """(atoms, 9) floats: number, aromatic, charge, hydrogens, degree, ring, hybridization, chirality, mass / 100."""
    masses = F.create_map(*[F.lit(x) for z, w in MASS_MILLI_GRAPH.items() for x in (z, w)])

    def row(a):
        mass = F.coalesce(F.element_at(masses, a["z"]), a["z"] * 1000) / F.lit(100_000.0)
        flags = [a["z"], a["aromatic"].cast("int"), a["charge"], a["num_hs"], a["degree"], a["in_ring"].cast("int"), a["hybridization"], a["chirality"]]
        return F.array(*[x.cast("float") for x in (*flags, mass)])

    return F.transform(F.arrays_zip(*[F.col(f"parsed.{c}").alias(c) for c in ("z", "aromatic", "charge", "num_hs", "degree", "in_ring", "hybridization", "chirality")]), row)


def edge_index() -> Column:
    """(2, edges) longs, both directions of each bond in turn."""
    p = F.arrays_zip(F.col("parsed.src").alias("src"), F.col("parsed.dst").alias("dst"))
    ways = lambda a, b: F.flatten(F.transform(p, lambda x: F.array(x[a].cast("long"), x[b].cast("long"))))
    return F.array(ways("src", "dst"), ways("dst", "src"))


def edge_attr() -> Column:
    """(edges, 4) floats, one of single, double, triple, aromatic."""
    one = lambda b: F.array(*[(b == k).cast("float") for k in (1, 2, 3, 4)])
    return F.flatten(F.transform(F.col("parsed.bond"), lambda b: F.array(one(b), one(b))))


def graph_arrays(df: DataFrame, smiles: str = "smiles", label: list[str] | None = None) -> DataFrame:
    """df's valid rows with x, edge_index, edge_attr and y (an array of the label columns)."""
    own = with_parsed(df, smiles).where("parsed.ok")
    own = own.withColumn("x", node_features()).withColumn("edge_index", edge_index()).withColumn("edge_attr", edge_attr())
    return (own.withColumn("y", F.array(*[F.col(c).cast("float") for c in label])) if label else own).drop("parsed")


def hetero_nodes(df: DataFrame, key: str = "mol_id") -> DataFrame:
    """Atoms with their element label and their number among the molecule's atoms of that label."""
    labels = F.create_map(*[F.lit(x) for z, s in LABELS.items() for x in (z, s)])
    own = atoms(df, key).withColumn("node_type", F.coalesce(F.element_at(labels, F.col("atomic_num")), F.lit("other")))
    return own.withColumn("local_idx", F.row_number().over(Window.partitionBy(key, "node_type").orderBy("idx")) - 1)


def hetero_edges(df: DataFrame, key: str = "mol_id") -> DataFrame:
    """Both directions of each bond between typed nodes, with local numbers."""
    nodes = hetero_nodes(df, key).select(key, "idx", "node_type", "local_idx")
    b = bonds(df, key)
    ways = b.select(key, "bond_idx", F.lit(0).alias("way"), "src", "dst", "bond").unionByName(b.select(key, "bond_idx", F.lit(1).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "bond"))
    s = nodes.select(key, F.col("idx").alias("src"), F.col("node_type").alias("src_type"), F.col("local_idx").alias("src_local"))
    d = nodes.select(key, F.col("idx").alias("dst"), F.col("node_type").alias("dst_type"), F.col("local_idx").alias("dst_local"))
    return ways.join(s, [key, "src"]).join(d, [key, "dst"]).select(key, "bond_idx", "way", "src_type", "dst_type", "src_local", "dst_local", "bond")


def residue_graph(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """x (residues, 20) and edge_index: each residue to the next, then all of these reversed."""
    letters = F.split(F.col(sequence), "")
    letters = F.filter(letters, lambda c: c != "")
    n = F.length(sequence)
    ahead = F.when(n > 1, F.sequence(F.lit(0).cast("long"), (n - 2).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    behind = F.transform(ahead, lambda i: i + 1)
    return df.withColumn("x", F.transform(letters, lambda c: F.array(*[(c == r).cast("float") for r in RESIDUES]))).withColumn("edge_index", F.array(F.concat(ahead, behind), F.concat(behind, ahead)))


def padded_onehot(df: DataFrame, sequence: str = "sequence", most: int = 1000) -> DataFrame:
    """onehot (20, L): rows are residues; L is the longest of df's sequences, cut at most."""
    longest = df.agg(F.least(F.max(F.length(sequence)), F.lit(most))).first()[0] or 0
    cut = F.upper(F.substring(sequence, 1, most))
    row = lambda r: F.transform(F.sequence(F.lit(1), F.lit(max(1, longest))), lambda i: (F.substring(cut, i, F.lit(1)) == r).cast("float"))
    return df.withColumn("onehot", F.array(*[row(r) for r in RESIDUES]))
