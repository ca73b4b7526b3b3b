"""Distance-threshold clustering and diverse picks. Molecules with equal fingerprints are one class throughout, and are met once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored
from .similarity_index import near_pairs

#: Farthest molecules that picks are drawn from at once.
POOL = 1024


def classes(mols: DataFrame) -> DataFrame:
    """(mol_id, fp, size): of the molecules (mol_id, fp) with equal fingerprints the last one, and how many they are."""
    return mols.where("fp is not null").groupBy("fp").agg(F.max("mol_id").alias("mol_id"), F.count(F.lit(1)).alias("size"))


def neighbours(mols: DataFrame, cutoff: float = 0.4, nbits: int = 2048) -> DataFrame:
    """(a, b, sim), a <> b, of molecules (mol_id, fp) within the Tanimoto distance; mols are classes, or few."""
    found = near_pairs(mols.select(F.col("mol_id").alias("query_id"), "fp"), mols, nbits, max(1e-9, 1 - cutoff - 1e-9))
    return found.where((F.col("query_id") != F.col("mol_id")) & (1 - F.col("sim") <= cutoff)).select(F.col("query_id").alias("a"), F.col("mol_id").alias("b"), "sim")


def butina(mols: DataFrame, cutoff: float = 0.4, nbits: int = 2048) -> DataFrame:
    """(mol_id, cluster_id) of molecules (mol_id, valid, fp); -1 for invalid ones.

    Molecules are centres in the order of their neighbour counts, then mol_id, both descending; a centre takes its unassigned
    neighbours. Of a class the last molecule stands for all: it comes first, and what takes it takes the others. In rounds, a class is a centre if all
    of its neighbours before it are taken, and is taken if a centre is among them: the result is that of going one by one. Clusters
    are numbered by size, then in the order of their centres."""
    valid = mols.where("valid")
    own = stored(classes(valid), "classes")
    links = stored(neighbours(own, cutoff, nbits).select("a", "b"), "neighbours")
    sizes = own.select(F.col("mol_id").alias("b"), F.col("size").alias("b_size"))
    near = links.join(sizes, "b").groupBy("a").agg(F.sum("b_size").alias("near"))
    counts = own.select(F.col("mol_id").alias("a"), "size").join(near, "a", "left").select("a", "size", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n"))
    counts = stored(counts, "counts")
    # links from each class to the neighbours that come before it
    other = counts.select(F.col("a").alias("b"), F.col("n").alias("m"))
    before = stored(links.join(counts, "a").join(other, "b").where("m > n or m = n and b > a").select("a", "b"), "before")
    state = stored(counts.select("a", F.lit(0).alias("s")), "state")  # 0 open, 1 centre, 2 taken
    while state.where("s = 0").limit(1).count():
        seen = before.join(state.where("s = 0").select("a"), "a").join(state.select(F.col("a").alias("b"), F.col("s").alias("t")), "b")
        facts = seen.groupBy("a").agg(F.max((F.col("t") == 1).cast("int")).alias("by_centre"), F.max((F.col("t") == 0).cast("int")).alias("open"))
        state = stored(state.join(facts, "a", "left").select("a", F.when(F.col("s") != 0, F.col("s")).when(F.col("by_centre") == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0).alias("s")), "state")
    centres = state.where("s = 1").join(counts, "a").select(F.col("a").alias("centre"), F.col("n").alias("centre_n"))
    first = before.join(centres, before["b"] == centres["centre"]).groupBy("a").agg(F.max(F.struct("centre_n", "centre")).alias("c")).select(F.col("a").alias("rep"), F.col("c.centre").alias("centre"), F.col("c.centre_n").alias("centre_n"))
    taken = first.unionByName(centres.select(F.col("centre").alias("rep"), "centre", "centre_n")).join(counts.select(F.col("a").alias("rep"), "size"), "rep")
    clusters = stored(taken.groupBy("centre", "centre_n").agg(F.sum("size").alias("members")), "clusters")
    ids = numbered_by(clusters, F.col("members"), [F.desc("members"), F.desc("centre_n"), F.desc("centre")]).select("centre", F.col("pos").alias("cluster_id"))
    named = taken.join(ids, "centre").select(F.col("rep").alias("mol_id"), "cluster_id").join(own, "mol_id").select("fp", "cluster_id")
    of = valid.select("mol_id", "fp").join(named, "fp").select("mol_id", "cluster_id")
    return mols.select("mol_id").join(of, "mol_id", "left").select("mol_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def numbered_by(df: DataFrame, size, order: list) -> DataFrame:
    """df with pos, its place in an order that starts with size, largest first. Rows are counted by size (a row for each distinct size reaches a
    window); only rows of one size are ranked together."""
    own = df.withColumn("__size", size)
    counts = own.groupBy("__size").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy(F.desc("__size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__size", "__before")
    w = Window.partitionBy("__size").orderBy(*order)
    return own.join(before, "__size").withColumn("pos", F.col("__before") + F.row_number().over(w) - 1).drop("__size", "__before")


def nearer(state: DataFrame, picks: np.ndarray) -> DataFrame:
    """The state (mol_id, fp, d) with each distance to the nearest pick, where one of the new picks (rows of words) is nearer."""
    sent = state.sparkSession.sparkContext.broadcast(picks)
    kind = f"mol_id {state.schema['mol_id'].dataType.simpleString()}, fp array<bigint>, d double"

    def run(batches):
        for b in batches:
            own = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(b.num_rows, -1)
            d = b.column(2).to_numpy().copy()
            for pick in sent.value:
                d = np.minimum(d, _distance(own, pick))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], names=["mol_id", "fp", "d"])

    return state.select("mol_id", "fp", "d").mapInArrow(run, kind)


def _distance(own: np.ndarray, pick: np.ndarray) -> np.ndarray:
    inter, union = np.bitwise_count(own & pick).sum(1), np.bitwise_count(own | pick).sum(1)
    return np.where((own == pick).all(1), 0.0, 1 - np.divide(inter, union, out=np.zeros(len(own)), where=union > 0))


def diversity_pick(mols: DataFrame, n: int, seed: int = 0, nbits: int = 2048) -> DataFrame:
    """(pick, mol_id) of molecules (mol_id, fp): the first is number seed modulo count; each next one has the largest distance to
    its nearest pick, the smallest mol_id at ties.

    A pass over the distinct fingerprints, of which the smallest mol_id stands for all while their distance is above 0, brings all distances up to date. The POOL
    farthest go to the driver, and picks are drawn from them as long as the best one's distance, brought up to date within the pool, is above that
    of all others: their distances can only have fallen since the pass. When no distance is above 0, the smallest of the molecules that are left follow."""
    spark = mols.sparkSession
    total = mols.count()
    n = min(n, total)
    kind = f"pick int, mol_id {mols.schema['mol_id'].dataType.simpleString()}"
    if not n:
        return spark.createDataFrame([], kind)
    from .split import numbered

    words = lambda fp: np.array(fp, np.int64).view(np.uint64)
    first = numbered(mols.select("mol_id", "fp"), "mol_id").where(F.col("pos") == seed % total).select("mol_id", "fp").first()
    state = mols.groupBy("fp").agg(F.min("mol_id").alias("mol_id")).select("mol_id", "fp", F.lit(2.0).alias("d"))
    picks, new = [first["mol_id"]], [words(first["fp"])]
    while len(picks) < n:
        state = stored(nearer(state, np.array(new)), "picks")
        pool = state.orderBy(F.desc("d"), "mol_id").limit(POOL + 1).collect()
        beyond = pool.pop()["d"] if len(pool) > POOL else -1.0
        ids, bits, d = [r["mol_id"] for r in pool], np.array([words(r["fp"]) for r in pool]), np.array([r["d"] for r in pool])
        new = []
        while len(picks) < n:
            best = min(np.flatnonzero(d == d.max()), key=ids.__getitem__)
            if d[best] == 0 or new and d[best] <= beyond:
                break
            picks.append(ids[best])
            new.append(bits[best])
            d = np.minimum(d, _distance(bits, bits[best]))
        if not new:  # all distances are 0
            taken = spark.createDataFrame([(x,) for x in picks], f"mol_id {mols.schema['mol_id'].dataType.simpleString()}")
            picks += [r["mol_id"] for r in mols.join(taken, "mol_id", "left_anti").orderBy("mol_id").limit(n - len(picks)).select("mol_id").collect()]
            break
    return spark.createDataFrame(list(enumerate(picks)), kind)
