"""python -m retort.cli: featurize, screen, benchmark, admet-screen, scaffold-split."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .fixtures import VALID_POOL
from .functions import columns
from .operators import descriptors, similarity, split
from .sources import readers, writers


def _numbered(df):
    """mol_id in the order that the files are read."""
    return df.withColumn("__at", F.monotonically_increasing_id()).transform(split.numbered, "__at").withColumnRenamed("pos", "mol_id").drop("__at")


def featurize(spark, a) -> None:
    began = time.perf_counter()
    out = a.output or a.input.rsplit(".", 1)[0] + "_fps.parquet"
    readers.smiles_file(spark, a.input).withColumn("fp", columns.fingerprint("smiles", nbits=a.nbits)).write.parquet(out)
    n = spark.read.parquet(out).count()
    print(f"{n} molecules, {n / (time.perf_counter() - began):.0f} a second, in {out}")


def screen(spark, a) -> None:
    queries = _numbered(readers.smiles_file(spark, a.query, True)).select(F.col("mol_id").alias("query_id"), columns.fingerprint("smiles", nbits=a.nbits).alias("fp"))
    library = _numbered(readers.smiles_file(spark, a.library, True)).withColumn("fp", columns.fingerprint("smiles", nbits=a.nbits))
    best = similarity.screen_best(similarity.pairs(queries, library, a.nbits), a.top_k).join(library.select("mol_id", "smiles"), "mol_id")
    if a.output:
        writers.screen_tsv(best, a.output)
    else:
        for r in best.orderBy("rank").collect():  # top_k rows
            print(f"{r['rank']}\t{r['smiles']}\t{r['similarity']:.4f}")


def benchmark(spark, a) -> None:
    pool = spark.createDataFrame(list(enumerate(VALID_POOL)), "k long, smiles string")
    df = spark.range(a.n).withColumn("k", F.col("id") % len(VALID_POOL)).join(F.broadcast(pool), "k").cache()
    df.count()
    best = float("inf")
    for _ in range(a.repeats):
        began = time.perf_counter()
        df.select(columns.fingerprint("smiles")).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - began)
    print(f"fingerprints: {a.n / best:.0f} molecules a second")


def admet_screen(spark, a) -> None:
    out = descriptors.admet(readers.smiles_file(spark, a.input)).cache()
    writers.tsv(out, a.output or a.input.rsplit(".", 1)[0] + "_admet")
    print(f"Drug-like: {out.where('druglike').count()} / {out.count()}")


def scaffold_split(spark, a) -> None:
    own = split.with_scaffold(_numbered(readers.smiles_file(spark, a.input)))
    writers.splits(split.scaffold_split(own, a.train, a.val, seed=a.seed), a.output or a.input.rsplit(".", 1)[0] + "_splits")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="retort")
    sub = p.add_subparsers(dest="command", required=True)
    for f, args in (
        (featurize, [("input", {}), ("--output", {}), ("--nbits", {"type": int, "default": 2048})]),
        (screen, [("query", {}), ("library", {}), ("--output", {}), ("--top-k", {"type": int, "default": 100}), ("--nbits", {"type": int, "default": 2048})]),
        (benchmark, [("--n", {"type": int, "default": 1000}), ("--repeats", {"type": int, "default": 3})]),
        (admet_screen, [("input", {}), ("--output", {})]),
        (scaffold_split, [("input", {}), ("--output", {}), ("--train", {"type": float, "default": 0.8}), ("--val", {"type": float, "default": 0.1}), ("--seed", {"type": int, "default": 42})]),
    ):
        one = sub.add_parser(f.__name__.replace("_", "-"))
        one.set_defaults(run=f)
        for name, how in args:
            one.add_argument(name, **how)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
