"""Facades for small inputs: lists in, plain dictionaries out. Each runs the library's DataFrame operators."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import columns
from .operators import descriptors as d
from .operators import reactions, similarity, split
from .sources.readers import from_list


def _spark() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def _queries(smiles: list[str], nbits: int = 2048):
    return from_list(_spark(), smiles).select(F.col("mol_id").alias("query_id"), columns.fingerprint("smiles", nbits=nbits).alias("fp"))


def _library(smiles: list[str], nbits: int = 2048):
    return from_list(_spark(), smiles).withColumn("fp", columns.fingerprint("smiles", nbits=nbits))


def featurize(smiles: list[str], kind: str = "ecfp4", nbits: int = 2048, radius: int = 2) -> dict:
    own = from_list(_spark(), smiles).withColumn("fp", columns.fingerprint("smiles", kind, radius, nbits))
    rows = own.withColumn("bits", similarity.on_bits(F.col("fp"), 192 if kind == "maccs" else nbits)).orderBy("mol_id").collect()
    return {"n_molecules": len(rows), "nbits": nbits, "on_bits": [r["bits"] for r in rows]}


def descriptors(smiles: list[str], names: list[str] | None = None, preset: str | None = None) -> dict:
    chosen = columns.chosen_descriptors(names, preset)
    rows = d.named(from_list(_spark(), smiles), chosen, None).orderBy("mol_id").collect()
    return {"names": chosen, "values": [[r[n] for n in chosen] for r in rows]}


def similar(queries: list[str], library: list[str], top_k: int = 10) -> list[dict]:
    """For each query its most similar library molecules, similarity with four decimals."""
    found = similarity.top_k(similarity.pairs(_queries(queries), _library(library)), top_k).orderBy("query_id", "rank").collect()
    return [{"query": q, "hits": [{"smiles": library[r["mol_id"]], "similarity": r["sim"]} for r in found if r["query_id"] == i]} for i, q in enumerate(queries)]


def screen(queries: list[str], library: list[str], threshold: float = 0.3, top_k: int = 50) -> dict:
    found = similarity.pairs(_queries(queries), _library(library))
    counts = similarity.screen_counts(found, threshold).first()
    best = similarity.screen(found, threshold, top_k).collect()
    return {"n_screened": counts["n_screened"], "n_hits": counts["n_hits"], "hits": [{"query": queries[r["query_id"]], "smiles": library[r["mol_id"]], "similarity": r["sim"]} for r in best]}


def shape(points: list[list[list[float]]], masses: list[list[float]]) -> list[dict]:
    """Shape descriptors of given coordinates."""
    df = _spark().createDataFrame(list(enumerate(zip(points, masses, strict=True))), "at long, c struct<xyz: array<array<double>>, m: array<double>>")
    rows = df.select("at", columns.shape_descriptors(F.col("c.xyz"), F.col("c.m")).alias("d")).orderBy("at").collect()
    return [r["d"].asDict() for r in rows]


def predict(model, smiles: list[str]) -> list[float | None]:
    """Predictions of an endpoint model; None for texts that are no molecules."""
    rows = model.predict(from_list(_spark(), smiles)).orderBy("mol_id").collect()
    return [None if r["prediction"] != r["prediction"] else r["prediction"] for r in rows]


def smarts(smiles: list[str], pattern: str, mode: str = "filter", invert: bool = False) -> dict:
    df = from_list(_spark(), smiles)
    if mode == "filter":
        hits = [r["smiles"] for r in d.filter_by_smarts(df, pattern, invert).orderBy("mol_id").collect()]
        return {"n_input": len(smiles), "n_matched": len(hits), "smiles": hits}
    if mode == "matches":
        rows = df.withColumn("m", columns.substructures("smiles", pattern)).orderBy("mol_id").collect()
        return {"matches": {r["smiles"]: r["m"] or [] for r in rows}}
    raise ValueError(f"unknown mode {mode!r}")


def scaffold(smiles: list[str], mode: str = "murcko", train: float = 0.8, val: float = 0.1) -> dict:
    df = from_list(_spark(), smiles)
    if mode in ("murcko", "generic"):
        rows = df.withColumn("s", columns.scaffold("smiles", mode == "generic")).orderBy("mol_id").collect()
        return {"scaffolds": [r["s"] for r in rows]}
    if mode == "cluster":
        key = F.when(F.col("s").isNull(), "__invalid__").when(F.col("s") == "", "__acyclic__").otherwise(F.col("s"))
        rows = df.withColumn("s", columns.scaffold("smiles")).groupBy(key.alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("mol_id", "smiles"))), lambda x: x["smiles"]).alias("members")).collect()
        return {"n_clusters": len(rows), "clusters": {r["key"]: r["members"] for r in rows}}
    if mode == "split":
        rows = split.scaffold_split(split.with_scaffold(df), train, val).orderBy("mol_id").collect()
        return {k: [r["smiles"] for r in rows if r["split"] == k] for k in ("train", "val", "test")}
    raise ValueError(f"unknown mode {mode!r}")


def reaction(smiles: list[str], pattern: str, mode: str = "unimolecular", partners: list[str] | None = None, max_products: int = 1000) -> dict:
    df = from_list(_spark(), smiles)
    if mode == "unimolecular":
        rows = df.withColumn("p", columns.react("smiles", pattern)).orderBy("mol_id").collect()
        return {"products": {r["smiles"]: r["p"] or [] for r in rows}}
    if mode == "bimolecular":
        out = reactions.enumerate_pairs(df, from_list(_spark(), partners or []), pattern, max_products)
    elif mode == "enumerate":
        out = reactions.enumerate_products(df, pattern, max_products)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return {"products": [r["product"] for r in out.collect()]}
