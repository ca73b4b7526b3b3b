"""The indexed Tanimoto join against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.operators import cluster, similarity, similarity_index

NBITS = 512


def fingerprints(n, seed, bits=(1, 40), families=60):
    """Families of fingerprints that differ in a few bits; frequent and rare bits."""
    order = np.random.default_rng(0).permutation(NBITS)
    p = 1 / np.arange(1, NBITS + 1) ** 0.8
    p /= p.sum()
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        own = np.random.default_rng(1000 + i % families)
        on = set(order[own.choice(NBITS, own.integers(*bits), p=p, replace=False)].tolist())
        on ^= set(rng.integers(0, NBITS, rng.integers(0, 5)).tolist())
        row = np.zeros(NBITS, np.uint8)
        row[list(on)] = 1
        out.append(np.packbits(row, bitorder="little").view(np.int64).tolist())
    return out


@pytest.fixture(scope="module")
def sides(spark):
    empty, narrow = [0] * (NBITS // 64), [5]
    first = fingerprints(260, 1)
    library = spark.createDataFrame([(f"m{i}", x) for i, x in enumerate([*first, first[3], first[3], empty, None, narrow])], "mol_id string, fp array<bigint>").cache()
    queries = spark.createDataFrame(list(enumerate([*fingerprints(70, 2), first[3], [1] + empty[1:], [3] + empty[1:], empty, None])), "query_id long, fp array<bigint>").cache()
    return queries, library


@pytest.mark.parametrize("threshold,depths", [(0.25, (1, 2)), (0.4, (1, 2)), (0.6, (2, 3, None)), (0.8, (1, 3)), (0.9, (2,)), (1.0, (1, 2, 3)), (1.1, (1,))])
def test_equals_all_pairs(sides, threshold, depths):
    queries, library = sides
    want = sorted(map(tuple, similarity.pairs(queries, library.where(F.size("fp") > 1), NBITS, threshold).collect()))
    assert threshold > 1 or len(want) > 10
    for d in depths:
        assert sorted(map(tuple, similarity_index.indexed_pairs(queries, library, NBITS, threshold, d).collect())) == want


def test_needs_a_threshold(sides):
    with pytest.raises(ValueError):
        similarity_index.indexed_pairs(*sides, NBITS, 0.0)


def test_meeting_rows_grow_with_the_library(spark):
    """Four times the distinct fingerprints, families of the same size: all pairs grow 16-fold, what meets less than 6-fold."""
    met = []
    for n in (1500, 6000):
        df = spark.createDataFrame(list(enumerate(fingerprints(n, 4, (20, 40), families=n // 5))), "id long, fp array<bigint>").cache()
        plan = similarity_index.chosen_plan(df, df, NBITS, 0.8)
        rows, meet = similarity_index.meetings(df, df, plan)
        assert meet == similarity_index.met(df.withColumnRenamed("id", "id"), df, plan).count()
        met.append(rows + meet)
    assert met[1] < 6 * met[0]


def test_small_and_large_sides_agree(spark, sides, monkeypatch):
    library = sides[1].where(F.size("fp") > 1).select(F.monotonically_increasing_id().alias("mol_id"), "fp")
    plain = sorted(map(tuple, cluster.neighbours(library, 0.4, NBITS).collect()))
    monkeypatch.setattr(similarity_index, "FEW_PAIRS", 0)
    assert sorted(map(tuple, cluster.neighbours(library, 0.4, NBITS).collect())) == plain and plain


def plain_picks(fps, n, seed):
    """One after the other, each the farthest from its nearest pick."""
    ids = sorted(fps)
    bits = {i: {64 * k + b for k, w in enumerate(fps[i]) for b in range(64) if w >> b & 1} for i in ids}
    gap = lambda a, b: 0.0 if bits[a] == bits[b] else 1 - (len(bits[a] & bits[b]) / len(bits[a] | bits[b]) if bits[a] | bits[b] else 0.0)
    picks = [ids[seed % len(ids)]]
    d = {i: gap(i, picks[0]) for i in ids}
    while len(picks) < min(n, len(ids)):
        best = min((i for i in ids if i not in picks), key=lambda i: (-d[i], i))
        picks.append(best)
        d = {i: min(d[i], gap(i, best)) for i in ids}
    return picks


@pytest.mark.parametrize("pool,most", [(1024, 4), (40, 20)])
def test_picks_are_drawn_several_at_a_pass(spark, monkeypatch, pool, most):
    monkeypatch.setattr(cluster, "POOL", pool)
    passes, nearer = [], cluster.nearer
    monkeypatch.setattr(cluster, "nearer", lambda *a: passes.append(1) or nearer(*a))
    fps = dict(enumerate(fingerprints(300, 8)))
    fps |= {1000: fps[0], 1001: [0] * (NBITS // 64)}
    df = spark.createDataFrame(list(fps.items()), "mol_id long, fp array<bigint>")
    got = [r["mol_id"] for r in cluster.diversity_pick(df, 80, 7, NBITS).orderBy("pick").collect()]
    assert got == plain_picks(fps, 80, 7) and len(passes) <= most


def test_picks_beyond_the_distinct_fingerprints(spark):
    fps = {f"m{i:02}": f for i, f in enumerate([*fingerprints(4, 3), *fingerprints(4, 3)])}
    df = spark.createDataFrame(list(fps.items()), "mol_id string, fp array<bigint>")
    for n in (3, 6, 8, 20):
        assert [r["mol_id"] for r in cluster.diversity_pick(df, n, 1, NBITS).orderBy("pick").collect()] == plain_picks(fps, n, 1)


def test_keys_are_not_broadcast(spark, sides):
    """A few small rows have many keys with their bits, which would all go through the driver."""
    queries, library = (df.select(F.col(c).alias("id"), "fp").where("fp is not null") for df, c in zip(sides, ("query_id", "mol_id"), strict=True))
    plan = spark.sparkContext.broadcast(similarity_index.Plan(similarity_index.bit_counts(library, NBITS), NBITS, 0.6, 2))
    found = similarity_index.met(queries.limit(3), library, plan)
    found.count()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few,frequent", [(5, 64), (5, 0), (400, 64), (400, 8)])
def test_pairs_at_a_threshold_equal_plain_sets(spark, monkeypatch, few, frequent):
    """Few queries and many, bits bounded first or all counted, more bits than a byte counts."""
    monkeypatch.setattr(similarity, "FREQUENT", frequent)
    own = [*fingerprints(200, 5), *fingerprints(60, 6, (250, 330), families=9), [0] * (NBITS // 64)]
    bits = [{64 * k + b for k, w in enumerate(f) for b in range(64) if w >> b & 1} for f in own]
    picked = list(range(0, len(own), max(1, len(own) // few)))
    want = sorted((i, j, len(bits[i] & bits[j]), len(bits[i] | bits[j])) for i in picked for j in range(len(own)) if bits[i] | bits[j] and len(bits[i] & bits[j]) / len(bits[i] | bits[j]) >= 0.5)
    df = spark.createDataFrame(list(enumerate(own)), "mol_id long, fp array<bigint>").coalesce(1)
    q = df.where(F.col("mol_id").isin(picked)).select(F.col("mol_id").alias("query_id"), "fp")
    assert max(map(len, bits)) > 255 and sorted(tuple(r)[:4] for r in similarity.pairs(q, df, NBITS, 0.5).collect()) == want and len(want) > len(picked)


def test_the_index_pays_for_unlike_fingerprints_only(spark):
    """A large library of fingerprints without anything in common; fingerprints that all share most of their bits."""
    rng = np.random.default_rng(2)
    rows = [np.packbits(np.isin(np.arange(NBITS), rng.choice(NBITS, 30, replace=False)), bitorder="little").view(np.int64).tolist() for _ in range(1000)]
    sparse, other = (spark.createDataFrame(list(enumerate(x)), "query_id long, fp array<bigint>").cache() for x in (rows[:500], rows[500:]))
    base = fingerprints(1, 9, (100, 101))[0]
    alike = spark.createDataFrame([(i, [a ^ (1 << (i * 7 + k) % 60) for k, a in enumerate(base)]) for i in range(500)], "query_id long, fp array<bigint>").cache()
    n = 1 << 20
    assert similarity_index.pays(sparse, other, n, n, NBITS, 0.9) and not similarity_index.pays(alike, alike, n, n, NBITS, 0.6)
