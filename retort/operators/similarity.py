"""Tanimoto similarity of fingerprints, top-k searches and screens."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fingerprint

#: Query rows that are broadcast at once (256 bytes each at 2048 bits); more are met block by block.
QUERY_BLOCK = 1 << 14
#: Pairs whose words are compared at once, or that are found before they become rows.
PAIR_STEP = 1 << 18
#: Rows whose bits are unpacked at once; bits whose common number is first bounded, not counted.
STEP, FREQUENT = 1 << 12, 64
_SLACK = 1e-9


def popcount(fp: Column | str) -> Column:
    fp = F.col(fp) if isinstance(fp, str) else fp
    return F.aggregate(fp, F.lit(0).cast("int"), lambda a, w: a + F.bit_count(w))


def shared(a: Column, b: Column) -> Column:
    """Bits set in both."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, n: s + n)


def on_bits(fp: Column, nbits: int) -> Column:
    """The numbers of the set bits."""
    bit = lambda i: F.call_function("shiftrightunsigned", F.element_at(fp, (F.floor(i / 64) + 1).cast("int")), (i % 64).cast("int"))
    return F.filter(F.sequence(F.lit(0), F.lit(nbits - 1)), lambda i: bit(i).bitwiseAND(F.lit(1)) == 1)


def with_fingerprint(df: DataFrame, smiles: str = "smiles", fp: str = "fp", **how) -> DataFrame:
    """df with the fingerprint column, made once for each distinct SMILES."""
    own = df.select(smiles).distinct().withColumn(fp, fingerprint(smiles, **how))
    return df.join(own, smiles, "left").select(*[df[c] for c in df.columns], fp)


def tanimoto(inter: Column, pa: Column, pb: Column) -> Column:
    union = pa + pb - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def _matrix(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that hold a fingerprint of so many words, and these as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == words)
    own = column.take(pa.array(there))
    return there, own.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)


def _met(own: np.ndarray, n: np.ndarray, q: np.ndarray, q_n: np.ndarray):
    """(rows, queries, inter, union, sim) of all pairs, in steps."""
    step = max(1, PAIR_STEP // max(1, len(q)))
    for at in range(0, len(n), step):
        inter = np.zeros((len(own[at : at + step]), len(q)), np.int32)
        for w in range(q.shape[1]):
            inter += np.bitwise_count(own[at : at + step, w, None] & q[None, :, w])
        union = n[at : at + step, None] + q_n[None, :] - inter
        sim = np.divide(inter, union, out=np.zeros(inter.shape), where=union > 0)
        i, j = np.indices(inter.shape).reshape(2, -1)
        yield i + at, j, inter.ravel(), union.ravel(), sim.ravel()


def unpacked(m: np.ndarray) -> np.ndarray:
    """A byte for each bit of rows of words."""
    return np.unpackbits(np.ascontiguousarray(m).view(np.uint8), axis=1, bitorder="little")


class _Columns:
    """Fingerprints as a column of bytes for each bit, sorted by number of bits. Another one's common bits with all of them are the sum of the columns of its bits. Where
    that leaves few, only rarer bits are added up: of the FREQUENT most frequent ones two fingerprints share at most as many as either has."""

    def __init__(self, m: np.ndarray, n: np.ndarray):
        self.order = np.argsort(n, kind="stable")
        self.m, self.n = m[self.order], n[self.order]
        on = unpacked(self.m)
        counts = on.sum(0, dtype=np.int64)
        self.place = np.full(len(counts), -1)  # of a bit's column; bits that no row has need none
        there = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        self.place[there] = np.arange(len(there))
        self.columns = np.ascontiguousarray(on[:, there].T).astype(np.uint8 if not len(n) or n.max() < 256 else np.uint16)
        self.upper = self.columns[:FREQUENT].sum(0, dtype=self.columns.dtype)

    def met(self, m: np.ndarray, n: np.ndarray, threshold: float):
        """(rows of m, own rows, inter, union, sim) of the pairs at a threshold above 0, in steps."""
        kind, skipped, seen, left, parts, size = self.columns.dtype, FREQUENT, 0, 0, [], 0
        order = np.argsort(n, kind="stable")
        order, need_of = order[np.searchsorted(n[order], 1) :], -1
        for at in range(0, len(order), STEP):
            chosen = order[at : at + STEP]
            which, bits = np.nonzero(unpacked(m[chosen]))
            places, starts = self.place[bits], np.searchsorted(which, np.arange(len(chosen) + 1))
            for k, i in enumerate(chosen):
                a_n = int(n[i])
                if a_n != need_of:
                    need_of = a_n
                    # fewer or more bits than these cannot reach the threshold
                    a, b = np.searchsorted(self.n, math.ceil(a_n * threshold - _SLACK)), np.searchsorted(self.n, math.floor(a_n / threshold + _SLACK), "right")
                    need = np.ceil(threshold * (a_n + self.n[a:b]) / (1 + threshold) - _SLACK)
                    need = np.minimum(need, np.iinfo(kind).max).astype(kind)
                if a >= b:
                    continue
                own = places[starts[k] : starts[k + 1]]
                own = own[own >= 0]
                if skipped:
                    total = np.minimum(self.upper[a:b], kind.type(np.count_nonzero(own < skipped)))
                else:
                    total = np.zeros(b - a, kind)
                for c in own[own >= skipped].tolist():
                    np.add(total, self.columns[c, a:b], out=total)
                j = np.flatnonzero(total >= need) + a
                seen, left = seen + b - a, left + len(j)
                if skipped and seen > PAIR_STEP and left * 32 > seen:
                    skipped = 0
                if not len(j):
                    continue
                inter = np.bitwise_count(self.m[j] & m[i]).sum(1, dtype=np.int32) if skipped else total[j - a].astype(np.int32)
                union = a_n + self.n[j] - inter
                sim = inter / union
                hit = np.flatnonzero(sim >= threshold)
                parts.append((np.full(len(hit), i), self.order[j[hit]], inter[hit], union[hit], sim[hit]))
                size += len(hit)
                if size >= PAIR_STEP:
                    yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                    parts, size = [], 0
        if size:
            yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class _Best:
    """Each query's k best pairs so far, ties by molecule."""

    def __init__(self, k: int, queries: int):
        self.k, self.least, self.parts, self.size = k, np.full(queries, -1.0), [], 0

    def add(self, j, mol, inter, union, sim) -> None:
        own = np.flatnonzero(sim >= self.least[j])
        self.parts.append([x[own] for x in (j, mol, inter, union, sim)])
        self.size += len(own)
        if self.size > 4 * PAIR_STEP:
            self.rows()

    def rows(self) -> list[np.ndarray]:
        if not self.parts:
            return [np.zeros(0, t) for t in (np.int64, object, np.int32, np.int32, float)]
        columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        j, mol, sim = columns[0], columns[1], columns[4]
        order = np.lexsort((np.unique(mol, return_inverse=True)[1], -sim, j))
        first = np.flatnonzero(np.concatenate(([True], np.diff(j[order]) != 0)))[: len(order)]
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        last = order[rank == self.k - 1]
        self.least[j[last]] = sim[last]
        self.parts, self.size = [[x[order[rank < self.k]] for x in columns]], int((rank < self.k).sum())
        return self.parts[0]


def pairs(queries: DataFrame, library: DataFrame, nbits: int = 2048, threshold: float = 0.0, k: int | None = None) -> DataFrame:
    """(query_id, mol_id, inter, union_n, sim) of all pairs with sim >= threshold. queries: (query_id, fp); library: (mol_id, fp). With k,
    a task keeps only each query's k best of its rows, ties by mol_id, so that little is left to rank. A side without a fingerprint has no pairs.

    The queries go to the tasks in blocks of QUERY_BLOCK; the library is read where it is, and its bits are compared in numpy, batch by
    batch: at a threshold the smaller side's rows one by one with the other side's columns of bits, sorted by their number, so that only fitting numbers are met."""
    spark, words = queries.sparkSession, nbits // 64
    wanted = queries.select("query_id", "fp").where("fp is not null")
    total = wanted.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    mol_type = library.select("mol_id").limit(0).toArrow().schema.field("mol_id").type
    lib = library.select("mol_id", "fp").where("fp is not null")
    q_type, m_type = wanted.schema["query_id"].dataType, lib.schema["mol_id"].dataType
    kind = f"query_id {q_type.simpleString()}, mol_id {m_type.simpleString()}, inter int, union_n int, sim double"
    if blocks > 1:
        from ..tables import stored

        wanted = stored(wanted.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries")
    out = None
    for block in range(blocks):
        t = (wanted if blocks == 1 else wanted.where(F.col("block") == block)).select("query_id", "fp").toArrow()
        at, q = _matrix(t.column("fp"), words)
        q_n = np.bitwise_count(q).sum(1).astype(np.int32)
        order = np.argsort(q_n, kind="stable")
        own = spark.sparkContext.broadcast((t.column("query_id").combine_chunks().take(pa.array(at[order])), q[order], q_n[order]))

        def run(batches, own=own):
            ids, q, q_n = own.value
            best, dense = _Best(k, len(q)) if k else None, None
            for batch in batches:
                there, m = _matrix(batch.column(1), words)
                n = np.bitwise_count(m).sum(1).astype(np.int32)
                mols = batch.column(0).take(pa.array(there))
                if threshold <= 0:
                    found_pairs = _met(m, n, q, q_n)
                elif len(q) < len(m):
                    found_pairs = ((rows, j, *found) for j, rows, *found in _Columns(m, n).met(q, q_n, threshold))
                else:
                    dense = dense or _Columns(q, q_n)
                    found_pairs = dense.met(m, n, threshold)
                for rows, j, *found in found_pairs:
                    if best:
                        best.add(j, mols.to_numpy(zero_copy_only=False)[rows], *found)
                    else:
                        yield made(ids.take(pa.array(j)), mols.take(pa.array(rows)), *found)
            if best:
                j, mol, *found = best.rows()
                yield made(ids.take(pa.array(j)), pa.array(mol, mol_type), *found)

        def made(query, mol, inter, union, sim):
            columns = [query, mol, pa.array(inter, pa.int32()), pa.array(union, pa.int32()), pa.array(sim, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=["query_id", "mol_id", "inter", "union_n", "sim"])

        one = lib.mapInArrow(run, kind)
        out = one if out is None else out.unionByName(one)
    return out


def check_widths(query: DataFrame, library: DataFrame) -> None:
    """Both sides' fingerprints must have the same number of words."""
    a, b = (x.agg(F.min(F.size("fp")), F.max(F.size("fp"))).first() for x in (query, library))
    if None not in (*a, *b) and len({*a, *b}) > 1:
        raise ValueError("query and library fingerprints differ in bits")


def top_k(found: DataFrame, k: int = 10) -> DataFrame:
    """Each query's k most similar; ties by mol_id; sim with four decimals."""
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "mol_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("sim", F.round("sim", 4))


def screen(found: DataFrame, threshold: float = 0.3, k: int = 50) -> DataFrame:
    """The k best pairs at or above the threshold over all queries, by the rounded score, then query and molecule."""
    return found.where(F.col("sim") >= threshold).withColumn("sim", F.round("sim", 4)).orderBy(F.desc("sim"), "query_id", "mol_id").limit(k)


def screen_counts(found: DataFrame, threshold: float = 0.3) -> DataFrame:
    return found.agg(F.count_distinct("mol_id").alias("n_screened"), F.count_if(F.col("sim") >= threshold).alias("n_hits"))


def screen_best(found: DataFrame, k: int = 100) -> DataFrame:
    """Each molecule's best similarity over the queries; the k best molecules, ranked from 1; ties: the larger mol_id first."""
    best = found.groupBy("mol_id").agg(F.max("sim").alias("similarity")).orderBy(F.desc("similarity"), F.desc("mol_id")).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), F.desc("mol_id"))))
