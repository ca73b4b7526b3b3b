"""Tanimoto join at a threshold by an inverted index, exact.

Bits are ordered rarest first. Two fingerprints of a and b bits that reach the threshold t share at least t (a + b) / (1 + t) bits, so their first
`depth` common bits lie among the first bits of both: of a's n bits the first n - need + depth. Each such combination of `depth` bits is a key, under
which fingerprints are indexed and looked up, within a band of bit counts that can reach the threshold at all. A pair that meets under several keys
counts under one: that of its first common bits. Pairs that may reach the threshold with fewer than `depth` common bits
(fingerprints of a few bits) meet under all of their common bits.

Deeper keys are more, and their lists shorter: the depth with the fewest rows in all (index, lookups and meetings, counted from the key counts of both
sides) is taken. Keys join in Spark, where a frequent key's list can be split; bits are compared in numpy after the join, batch by batch. Nothing but the number of each bit's
fingerprints (nbits numbers) goes through the driver. Where fingerprints are so alike that the index has more rows than comparing is worth, near_pairs compares directly.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import _matrix, pairs, unpacked

MOST_DEPTH = 3
#: Bands of bit counts are at least so wide; rows whose bits are unpacked at once; keys that are made at once.
LEAST_RATIO, STEP, PIECE = 1.1, 1 << 12, 1 << 15
#: All pairs up to this many are compared directly, which is faster there and gives the same rows; so many of them take about as long as one row of the index.
#: Rows of each side that the number of index rows is estimated from.
FEW_PAIRS, PAIRS_A_ROW, SAMPLE = 1 << 32, 500, 1 << 11
_SLACK = 1e-9
#: A key is a band, then bits; the number of bits stands above.
_KIND_AT = 61


def bit_counts(fps: DataFrame, nbits: int) -> np.ndarray:
    """How many fingerprints (column fp) have each bit."""
    words = nbits // 64

    def run(batches):
        total = np.zeros(nbits, np.int64)
        for b in batches:
            _, m = _matrix(b.column(0), words)
            for at in range(0, len(m), STEP):
                total += unpacked(m[at : at + STEP]).sum(0, dtype=np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["bit", "n"])

    out = np.zeros(nbits, np.int64)
    for bit, n in fps.select("fp").where("fp is not null").mapInArrow(run, "bit int, n long").groupBy("bit").agg(F.sum("n")).collect():
        out[bit] = n
    return out


class Plan:
    """What keys a fingerprint of n bits has; picklable, for the tasks."""

    def __init__(self, counts: np.ndarray, nbits: int, threshold: float, depth: int):
        self.order = np.argsort(counts, kind="stable")  # rarest first
        self.nbits, self.t, self.depth = nbits, threshold, depth
        ratio = max(1 / threshold, LEAST_RATIO)
        lows = [1]
        while lows[-1] <= nbits:
            lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * ratio)))
        self.lows = np.array(lows)
        if len(lows) * nbits**depth >= 1 << _KIND_AT:
            raise ValueError("too many bits for the keys")

    def band(self, n):
        return np.searchsorted(self.lows, n, "right") - 1

    def need(self, a: int, b: int) -> int:
        """Bits that fingerprints of a and b bits share at least."""
        return max(1, math.ceil(self.t * (a + b) / (1 + self.t) - _SLACK))

    def ways(self, n: int, query: bool) -> list[tuple[int, int, int]]:
        """(bits of a key, how many first bits they are chosen from, band) of a fingerprint of n bits."""
        if not n:
            return []
        low, high = max(1, math.ceil(self.t * n - _SLACK)), min(self.nbits, math.floor(n / self.t + _SLACK))
        bands = range(int(self.band(low)), int(self.band(high)) + 1) if query else [int(self.band(n))]
        out = []
        for band in bands:
            need = self.need(n, max(low, int(self.lows[band])) if query else low)
            for k in range(1, self.depth + 1):
                if k == self.depth or need <= k:
                    out.append((k, max(0, min(n, n - need + k)), band))
        return out

    def entries(self, m: np.ndarray, query: bool):
        """The rows of a matrix of words with their bits reordered, and an iterator over (rows, keys) of at most about PIECE keys."""
        on = unpacked(m)[:, self.order]
        return np.ascontiguousarray(np.packbits(on, axis=1, bitorder="little")), self._keys(on, query)

    def _keys(self, on: np.ndarray, query: bool):
        n = on.sum(1, dtype=np.int64)
        places = np.nonzero(on)[1]
        starts = np.concatenate(([0], np.cumsum(n)))
        for size in np.unique(n):
            same = np.flatnonzero(n == size)
            for k, first, band in self.ways(int(size), query):
                if first < k:
                    continue
                chosen = np.array(list(itertools.combinations(range(first), k)), np.int64)
                step = max(1, PIECE // len(chosen))
                for at in range(0, len(same), step):
                    own = same[at : at + step]
                    key = np.full((len(own), len(chosen)), band, np.int64)
                    for column in chosen.T:
                        key = key * self.nbits + places[starts[own][:, None] + column]
                    yield np.repeat(own, len(chosen)), key.ravel() | k << _KIND_AT


def _entries(side: DataFrame, plan, query: bool, bits: bool) -> DataFrame:
    """(key), or (key, id, fp) with the reordered bits, of a side (id, fp)."""
    words = plan.value.nbits // 64
    kind = side.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            there, m = _matrix(b.column(1), words)
            ids = b.column(0).take(pa.array(there))
            for at in range(0, len(m), STEP):
                packed, found = plan.value.entries(m[at : at + STEP], query)
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(packed)]).cast(pa.binary())
                for rows, keys in found:
                    if bits:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), ids.take(pa.array(rows + at)), flat.take(pa.array(rows))], names=["key", "id", "fp"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    return side.mapInArrow(run, f"key long, id {kind}, fp binary" if bits else "key long")


def meetings(queries: DataFrame, library: DataFrame, plan) -> tuple[int, int]:
    """Index rows and lookups, and how many rows meet."""
    a = _entries(queries, plan, True, False).groupBy("key").agg(F.count("*").alias("a"))
    b = _entries(library, plan, False, False).groupBy("key").agg(F.count("*").alias("b"))
    # keys of one side only count as rows but meet nothing
    r = a.join(b, "key", "full").agg(F.sum("a"), F.sum("b"), F.sum(F.col("a") * F.col("b"))).first()
    return int((r[0] or 0) + (r[1] or 0)), int(r[2] or 0)


def chosen_plan(queries: DataFrame, library: DataFrame, nbits: int, threshold: float, depth: int | None = None):
    """The broadcast Plan. Deeper keys are tried while they may pay: their own rows are known from the bit counts' numbers, their meetings are counted."""
    spark = library.sparkSession
    counts = bit_counts(library, nbits)
    if depth:
        return spark.sparkContext.broadcast(Plan(counts, nbits, threshold, depth))
    sizes = [(int(r[0]), int(r[1]), int(r[2])) for r in queries.select(_popcount("fp").alias("n"), F.lit(1).alias("q")).union(library.select(_popcount("fp"), F.lit(0))).where("n is not null").groupBy("n").agg(F.sum("q"), F.sum(1 - F.col("q"))).collect()]
    best, least = None, None
    for d in range(1, MOST_DEPTH + 1):
        plan = Plan(counts, nbits, threshold, d)
        own = sum(math.comb(first, k) * (q if query else m) for n, q, m in sizes for query in (True, False) for k, first, _ in plan.ways(n, query))
        if least is not None and own >= least:
            continue
        plan = spark.sparkContext.broadcast(plan)
        rows, met = meetings(queries, library, plan)
        if least is None or rows + met < least:
            best, least = plan, rows + met
    return best


def _popcount(fp: str):
    return F.aggregate(fp, F.lit(0).cast("int"), lambda a, w: a + F.bit_count(w))


def met(queries: DataFrame, library: DataFrame, plan) -> DataFrame:
    """The rows that meet: (key, query_id, a, mol_id, b), a and b the bits of both."""
    q = _entries(queries, plan, True, True).select("key", F.col("id").alias("query_id"), F.col("fp").alias("a"))
    m = _entries(library, plan, False, True).select("key", F.col("id").alias("mol_id"), F.col("fp").alias("b"))
    # the sizes that Spark guesses for the sides know nothing of the keys of a row: neither side may be broadcast
    return q.join(m.hint("merge"), "key")


def indexed_pairs(queries: DataFrame, library: DataFrame, nbits: int = 2048, threshold: float = 0.6, depth: int | None = None) -> DataFrame:
    """The rows of similarity.pairs at a threshold above 0. queries: (query_id, fp); library: (mol_id, fp).

    Null fingerprints, and those of another width, have no pairs; fingerprints without bits have similarity 0 and so none; equal rows give a pair each."""
    if threshold <= 0:
        raise ValueError("the index needs a threshold above 0")
    queries, library = queries.select(F.col("query_id").alias("id"), "fp").where("fp is not null"), library.select(F.col("mol_id").alias("id"), "fp").where("fp is not null")
    if threshold > 1:
        threshold = 1 + _SLACK  # no pair
    plan = chosen_plan(queries, library, nbits, min(1.0, threshold), depth)
    kinds = queries.schema["id"].dataType.simpleString(), library.schema["id"].dataType.simpleString()

    def compared(batches):
        p = plan.value
        for batch in batches:
            key = batch.column(0).to_numpy()
            a, b = (_bits(batch.column(i), nbits // 8) for i in (2, 4))
            both = a & b
            inter = np.bitwise_count(both).sum(1).astype(np.int64)
            union = np.bitwise_count(a | b).sum(1).astype(np.int64)
            sim = np.divide(inter, union, out=np.zeros(len(inter)), where=union > 0)
            own = np.flatnonzero(sim >= threshold)
            kind, last = key[own] >> _KIND_AT, (key[own] & ((1 << _KIND_AT) - 1)) % nbits
            before = _up_to(both[own], last)
            own = own[(before == kind) & ((kind == p.depth) | (inter[own] == kind))]
            at = pa.array(own)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(3).take(at), pa.array(inter[own], pa.int32()), pa.array(union[own], pa.int32()), pa.array(sim[own])], names=["query_id", "mol_id", "inter", "union_n", "sim"])

    return met(queries, library, plan).select("key", "query_id", "a", "mol_id", "b").mapInArrow(compared, f"query_id {kinds[0]}, mol_id {kinds[1]}, inter int, union_n int, sim double")


def near_pairs(queries: DataFrame, library: DataFrame, nbits: int = 2048, threshold: float = 0.6) -> DataFrame:
    """similarity.pairs at a threshold above 0, by the index where the sides are large and few enough rows meet in it."""
    few = threshold <= 0 or threshold > 1 or (n := queries.count()) * (m := library.count()) <= FEW_PAIRS
    return (pairs if few or not pays(queries, library, n, m, nbits, threshold) else indexed_pairs)(queries, library, nbits, threshold)


def pays(queries: DataFrame, library: DataFrame, n: int, m: int, nbits: int, threshold: float) -> bool:
    """Whether the index has fewer rows, at the best depth, than a PAIRS_A_ROW-th of the pairs of n queries and m others with fitting numbers of bits. Only this choice rests on a sample."""

    def sampled(df: DataFrame, seed: int) -> np.ndarray:
        t = df.select("fp").where("fp is not null").orderBy(F.xxhash64("fp", F.lit(seed))).limit(SAMPLE).toArrow()
        return _matrix(t.column("fp"), nbits // 64)[1]

    q, x = sampled(queries, 1), sampled(library, 2)  # rows of both sides may not be drawn together
    if not len(q) or not len(x):
        return False
    counts = bit_counts(library, nbits)
    a, b = (np.bitwise_count(y).sum(1, dtype=np.int64) for y in (q, x))
    fitting = ((np.minimum.outer(a, b) >= threshold * np.maximum.outer(a, b) - _SLACK) & (np.minimum.outer(a, b) > 0)).mean()
    least = math.inf
    for d in range(1, MOST_DEPTH + 1):
        plan = Plan(counts, nbits, threshold, d)
        own, met = 0.0, 0.0
        first = {}
        for side, bits, size, share in ((True, q, a, n / len(q)), (False, x, b, m / len(x))):
            on = unpacked(bits)[:, plan.order]
            upto = np.cumsum(on, axis=1, dtype=np.int32)
            ways = [plan.ways(int(v), side) for v in size]
            own += share * sum(math.comb(f, k) for w in ways for k, f, _ in w)
            for band in {band for w in ways for k, _, band in w if k == d}:
                f = np.array([next((f for k, f, at in w if k == d and at == band), 0) for w in ways])
                first[side, band] = (on * (upto <= f[:, None])).astype(np.float32)
        for _, band in [key for key in first if key[0] and (False, key[1]) in first]:
            both = np.rint(first[True, band] @ first[False, band].T).astype(np.int64)
            met += np.array([math.comb(c, d) for c in range(int(both.max()) + 1)], float)[both].sum()
        least = min(least, own + met * (n / len(q)) * (m / len(x)))
    return bool(least * PAIRS_A_ROW < fitting * n * m)


def _bits(column: pa.Array, width: int) -> np.ndarray:
    """Rows of bytes of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)


def _up_to(both: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Bits of each row up to and with a place."""
    place = np.arange(both.shape[1])[None, :] * 8
    keep = np.clip(last[:, None] + 1 - place, 0, 8)
    return np.bitwise_count(both & ((1 << keep) - 1).astype(np.uint8)).sum(1).astype(np.int64)
