"""Source divergence, conversation prefixes and shards: against SQL, and against plain versions on small rows of numbers."""

import bisect
import collections
import hashlib
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retort.llm import common, divergence, prefix_trie, sharding
from retort.llm.queries import ORACLES, QUERIES

NAMES = ["op11_source_divergence", "op12_prefix_trie", "op13_sharding"]


def by_sql(d, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{d}/{t}.parquet{'' if 'sf0' in d else '/*.parquet'}')")
    return con.sql(ORACLES[name]).df()


def rows(df):
    c = sorted(df.columns)
    plain = lambda v: str(int(v)) if isinstance(v, (int, float)) else str(v)  # noqa: E731  no column has fractions
    return collections.Counter(tuple(map(plain, r)) for r in df[c].astype(object).where(df[c].notna(), None).values.tolist())


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_match_sql(spark, odd_dir, name):
    assert rows(QUERIES[name](spark, odd_dir).toPandas()) == rows(by_sql(odd_dir, name))


@pytest.mark.parametrize("name", NAMES)
def test_tables_match_sql(spark, name):
    d = "/root/testdata/sf0.001"
    assert rows(QUERIES[name](spark, d).toPandas()) == rows(by_sql(d, name))


# Shards.


def known(sums, wide=1):
    """PrefixSums that knows every wide-th sum; asked, it tells the smallest and largest of two bins."""
    at = sorted({0, *sums[::wide], sums[-1]})

    def ask(stretches):
        for i, (a, b) in enumerate(stretches):
            inside = [s for s in sums if a < s < b]
            half = (a + b) // 2
            for part in ([s for s in inside if s <= half], [s for s in inside if s > half]):
                if part:
                    yield i, part[0], part[-1], len(part)

    more = [bisect.bisect_left(sums, b) > bisect.bisect_right(sums, a) for a, b in zip(at, at[1:])]
    return sharding.PrefixSums(at, more, ask)


def plain_capacity(sizes, shards):
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    best = list(sums)
    for _ in range(shards - 1):
        best = [min(max(best[i], sums[j] - sums[i]) for i in range(j + 1)) for j in range(len(sums))]
    return best[-1]


@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(2, 6), st.integers(1, 15))
@settings(max_examples=200, deadline=None)
def test_capacity_is_smallest_and_cuts_keep_it(sizes, shards, wide):
    sums = []
    for s in sizes:
        sums.append((sums[-1] if sums else 0) + s)
    p = known(sums, wide)
    capacity = sharding.smallest_capacity(p, max(sizes), shards)
    assert capacity == plain_capacity(sizes, shards)
    cuts = [0, *sharding.even_cuts(p, capacity, shards), sums[-1]]
    assert set(cuts) <= {0, *sums} and all(0 <= b - a <= capacity for a, b in zip(cuts, cuts[1:]))


def test_stretches_are_asked_for_a_few_times():
    rng = random.Random(2)
    sums = []
    for _ in range(100_000):
        sums.append((sums[-1] if sums else 0) + rng.randint(1, 5_000))
    p = known(sums, 2_000)
    asked = []
    ask = p.ask
    p.ask = lambda stretches: asked.append(len(stretches)) or ask(stretches)
    capacity = sharding.smallest_capacity(p, 5_000, 16)
    assert 0 <= capacity - sums[-1] / 16 <= 5_000 and len(asked) <= 40 and max(asked) <= sharding.MOST_STRETCHES  # by halves; by 1,024 bins a few queries do


@pytest.mark.parametrize("bins", [1, 3, 1 << 10])
def test_shards_with_few_bins(spark, monkeypatch, bins):
    monkeypatch.setattr(sharding, "BINS", bins)
    monkeypatch.setattr(sharding, "PART_BITS", 4)
    rng = random.Random(bins)
    texts = ["hot " * 200] * 150 + [f"text {i} " * rng.randint(0, 30) for i in range(250)] + ["same"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), sharding.digest(F.col("text")).alias("key"), "text")
    out = sharding.shard(df, 7, order=("doc_id",)).collect()
    shards = collections.defaultdict(list)
    where = collections.defaultdict(set)
    for r in out:
        shards[r["shard"]].append(r)
        where[r["text"]].add(r["shard"])
    assert sorted(r["doc_id"] for r in out) == list(range(len(texts))) and all(len(s) == 1 for s in where.values())
    for own in shards.values():
        assert [r["slot"] for r in sorted(own, key=lambda r: (r["doc_id"], r["key"]))] == list(range(len(own)))
    size = {t: texts.count(t) * (len(t) + 1) for t in set(texts)}
    rest = [s for t, s in sorted(size.items(), key=lambda x: hashlib.sha256(x[0].encode()).digest()) if "hot" not in t]
    most = plain_capacity(rest, 6)
    assert [r["shard"] for r in out if "hot" in r["text"]] == [0] * 150
    assert max(sum(r["size"] for r in own) for k, own in shards.items() if k) == most


def test_groups_over_an_even_share():
    assert sharding.oversized([50, 30, 5, 5, 5, 5], 100, 4) == 2  # 50 of 100 for 4, 30 of 50 for 3, not 5 of 20 for 2
    assert sharding.oversized([10, 10, 10], 30, 3) == 0
    assert sharding.oversized([7], 7, 3) == 1
    assert sharding.oversized([9, 9], 18, 1) == 0


# Conversations.


def plain_trie(conversations):
    """conversations: {id: [(role, text)]}. {(depth, path): row}."""
    members = collections.defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in members if len(p) == len(path) + 1 and p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        ends = ",".join(str(c) for c in sorted(own) if len(conversations[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        out[len(path), path] = (min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return collections.Counter(out.values())


@pytest.mark.parametrize("chunk", [1, 2, 5, 256])
def test_trie_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rng = random.Random(chunk)
    pool = [[("u", f"{k}-{rng.randint(0, 2)}é") for k in range(rng.randint(1, 14))] for _ in range(6)]
    talks = {c: pool[rng.randrange(6)][: rng.randint(1, 14)] + [("a", f"own {rng.randint(0, 3)}")] * rng.randint(0, 3) for c in range(-4, 60)}
    talks |= {100 + k: [("u", f"long {i}") for i in range(k)] for k in range(1, 24)}
    turns = prefix_trie.read_turns(spark.createDataFrame([(c, i, r, t) for c, own in talks.items() for i, (r, t) in enumerate(own)], "conv_id long, turn long, role string, text string"))
    got = prefix_trie.trie(*prefix_trie.own_turns(turns)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_trie(talks)


def test_rebuilding(spark, odd_dir):
    turns = prefix_trie.read_turns(spark.read.parquet(f"{odd_dir}/conversations.parquet"))
    got, lengths = prefix_trie.rebuilt_turns(turns)
    own = collections.defaultdict(list)
    for c, t, digest, n in sorted(map(tuple, turns.collect()), key=lambda r: (r[0], r[1] is not None, r[1] or 0, bytes(r[2]))):
        own[c].append((bytes(digest), n))
    want = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        family = c - (abs(c) % 5) * (1 if c > 0 else -1)
        want[c] = own.get(family, [])[:h] + own[c][h:]
    found = collections.defaultdict(dict)
    for r in got.collect():
        assert r["length"] == len(want[r["conv_id"]])
        found[r["conv_id"]][r["place"]] = (bytes(r["digest"]), r["bytes"])
    assert {c: [x[i] for i in range(len(x))] for c, x in found.items()} == {c: x for c, x in want.items() if x}
    assert {r["conv_id"]: r["length"] for r in lengths.collect()} == {c: len(x) for c, x in want.items()}


# Divergence.


def test_terms_of_long_texts_are_counted_in_pieces(spark, monkeypatch):
    assert "".join(divergence.pieces("ab cd efgh ij", 3)) == "ab cd efgh ij" and "".join(divergence.pieces("abcdefgh", 3)) == "abcdefgh"
    rng = random.Random(1)
    docs = [(rng.choice(("a", "b")), rng.choice("xyz"), " ".join(rng.choice(("Alpha", "béta", "gamma7delta", "É", "x\x00y")) for _ in range(rng.randint(0, 400)))) for _ in range(60)]
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    whole = rows(divergence.divergence(df).toPandas())
    small = divergence._schema(divergence._COUNTS)
    old, divergence.STEP = divergence.STEP, 50
    try:
        batch = df.toArrow().to_batches()
        got, want = collections.Counter(), collections.Counter()
        for r in (x for b in divergence._count_batches(batch) for x in b.to_pylist()):
            got[r["lang"], r["source"], r["term"], "n"] += r["n"]
            got[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
    finally:
        divergence.STEP = old
    for r in (x for b in divergence._count_batches(df.toArrow().to_batches()) for x in b.to_pylist()):
        want[r["lang"], r["source"], r["term"], "n"] += r["n"]
        want[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
    assert got == want and small.names == ["lang", "source", "term", "n", "docs"] and whole
