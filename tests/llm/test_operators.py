"""Each operator against a plain version, on small and odd tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retort.llm import common, decontaminate, jaccard_join, language_id, language_model, licenses, line_dedup, order_minhash, packing, personal_data, quality
from retort.llm.queries import ORACLES, QUERIES

from .conftest import prose

SPACES = r"[\x20\x09-\x0D]+"
SF = "/root/testdata/sf0.001"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return [w for w in re.split(SPACES, low(t)) if w]


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


def by_duckdb(d, sql):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet/*.parquet'" if "odd" in d else f"create view documents as select * from '{d}/documents.parquet'")
    return con.sql(sql).df()


def same(a, b):
    c = sorted(a.columns)
    assert c == sorted(b.columns)
    norm = lambda x: sorted(map(str, x[c].astype(object).where(x[c].notna(), None).values.tolist()))
    assert norm(a) == norm(b)


def test_license_scan_matches_sql(spark):
    same(QUERIES["op4_license_scan"](spark, SF).toPandas(), by_duckdb(SF, ORACLES["op4_license_scan"]))


def plain_licenses(text):
    """Sentences, identifiers and rules by plain Python."""
    known = dict(licenses.known_sentences())
    flat = re.sub(r"\s+", " ", text or "")
    readings = (re.sub(r"([.!?;:])\s+", r"\1\n", flat).split("\n"), re.sub(r"(?<!dentifier)([.!?;:])\s+", r"\1\n", text or "").split("\n"))
    found = [[known[n] for x in parts if (n := licenses.normal(x)) in known] for parts in readings]
    best = found[0] if len(found[0]) > len(found[1]) else found[1]
    hits = set()
    for ids, (licence, need) in itertools.product(found, licenses.RULES):
        rest = iter(ids)
        if all(n in rest for n in need):
            hits.add(licence)
    return len(best), ",".join(best), ",".join(sorted(h for h in hits if licenses.BEATEN_BY.get(h) not in hits))


def test_license_rules(spark):
    text = lambda *ids: "\n".join(s for i in ids for s in [next(s for n, s in licenses.SENTENCES if n == i)])
    mit = text("mit-grant", "mit-notice", "as-is-mit")
    cases = [
        (mit, "MIT"), (mit.replace(" of ", " of\n"), "MIT"), (text("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"), (text("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
        (text("bsd-binary", "bsd-source", "bsd-grant"), ""), ("no end mark\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), (None, ""), ("SPDX-License-Identifier: MIT\ncode", "MIT"), ("I like the license", ""),
        ("so it is. This is free and unencumbered software released into the\npublic\ndomain.", "Unlicense"), ("This is free and unencumbered software released into the public  domain.", "Unlicense"),
        (text("zlib-as-is", "zlib-liable", "zlib-grant"), "Zlib"), (text("lgpl-terms", "lgpl-2-1-later"), "LGPL-2.1-or-later"), (text("bsl-grant", "bsl-notice"), "BSL-1.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"), ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        ("Released under the GPLv3. Distributed under the EPL 2.0.", "EPL-2.0,GPL-3.0"), (text("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"), "BSD-4-Clause"),
    ]
    rows = [(i, t) for i, (t, _) in enumerate(cases)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (t, want) in enumerate(cases):
        assert got[i]["licenses"] == want, t
        assert tuple(got[i])[2:] == plain_licenses(t)
    known = licenses.known_sentences()
    assert len(known) > 1000 and all(any(h in k for h in licenses.HINTS) for k, _ in known)


def test_license_scan_on_odd_rows(spark, odd_dir, odd_rows):
    """Repeated rows, nulls, and columns with the names that the steps use."""
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    names = {"lang": "row", "source": "hint", "n_chars": "licenses", "node": "ids", "key": "a", "held_out": "found"}
    for old, new in names.items():
        docs = docs.withColumnRenamed(old, new)
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 8, "Licensed under the MIT License.").otherwise(F.col("text")))
    out = licenses.scan(docs)
    assert out.columns == ["doc_id", "text", "row", "hint", "ids", "a", "found", "n_sentences", "sentence_ids", "licenses"]
    rows = out.collect()
    assert len(rows) == len(odd_rows) and all((r["licenses"] == "MIT") == (r["doc_id"] == 8) for r in rows)


def plain_line_dedup(rows):
    holders = collections.defaultdict(list)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: low(x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    for i, lines in split:
        for k in {key(x) for x in lines}:
            holders[k].append(i)
    out = []
    for i, lines in split:
        stay = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and i is not None and i < max(h for h in holders[key(x)] if h is not None))]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def test_line_dedup(spark, odd_dir, odd_rows):
    got = [tuple(r) for r in QUERIES["op7_line_dedup"](spark, odd_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(plain_line_dedup(odd_rows), key=str)
    assert sum(r[2] for r in got) == 10
    same(QUERIES["op7_line_dedup"](spark, SF).toPandas(), by_duckdb(SF, ORACLES["op7_line_dedup"]))


def test_line_index_is_reversible(spark):
    line, other = "a line that many of the documents have in common", "another line that comes and goes with some documents"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}" + (f"\n{other}" if i > 4 else "")) for i in range(8)], "doc_id long, text string")
    more = spark.createDataFrame([(100, f"{line}\n{other}"), (101, other), (7, f"  {line.upper()}")], "doc_id long, text string")
    rows = lambda df: sorted((bytes(r[0]), *r[1:]) for r in df.collect())

    def probed(index, keys):
        """Which keys the filters let through, and how many keys they hold."""
        shards = {r["shard"]: line_dedup.CuckooFilter.from_bytes(bytes(r["filter"])) for r in index.filters.collect()}
        of = lambda k: int.from_bytes(k[:4], "big") % index.shards
        return {k for k in keys if of(k) in shards and shards[of(k)].contains(line_dedup.halves([k]))[0]}, sum(r["n_keys"] for r in index.filters.collect())

    one = line_dedup.LineIndex.empty(spark).insert(docs)
    both = one.insert(more)
    whole = line_dedup.LineIndex.empty(spark).insert(docs.unionByName(more))
    assert rows(both.counts) == rows(whole.counts) and rows(both.refs) == rows(whole.refs)
    assert sorted((r["n_docs"], r["last_doc"]) for r in both.counts.collect()) == [(5, 101), (10, 100)]
    keys = {bytes(r["key"]) for r in both.counts.collect()}
    assert probed(both, keys) == (keys, 2) and probed(one, keys)[1] == 1
    back = both.delete(spark.createDataFrame([(100,), (101,)], "doc_id long"))
    assert sorted((r["n_docs"], r["last_doc"]) for r in back.counts.collect()) == [(3, 7), (9, 7)] and probed(back, keys)[1] == 1
    assert rows(one.insert(more.where("doc_id = 7")).counts) == rows(back.counts)
    none = back.delete(docs.select("doc_id"))
    assert not none.counts.count() and not none.refs.count() and probed(none, keys) == (set(), 0)
    again = none.insert(docs)
    assert rows(again.counts) == rows(one.counts) and probed(again, keys)[1] == 1
    kept = lambda index: rows(line_dedup.dedup_lines(docs, index=index).select(F.encode("line_dedup.kept", "utf-8"), "doc_id"))
    assert kept(again) == kept(one) != kept(both)


def test_full_shards_grow(spark, monkeypatch):
    line = lambda i: f"line number {i} that all the documents of this table have"
    docs = lambda a, b: spark.createDataFrame([(d, "\n".join(map(line, range(a, b)))) for d in range(5)], "doc_id long, text string")
    index = line_dedup.LineIndex.empty(spark).insert(docs(0, 40)).insert(docs(40, 400))
    keys = line_dedup.halves([bytes(r["key"]) for r in index.counts.collect()])
    f = line_dedup.CuckooFilter.from_bytes(bytes(index.filters.first()["filter"]))
    assert index.filters.count() == 1 and len(keys) == 400 and f.contains(keys).all()
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 50)
    assert index.insert(docs(400, 500)).filters.count() == 10


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    own, other = rng.integers(0, 1 << 63, (3000, 2), dtype=np.uint64), rng.integers(0, 1 << 63, (3000, 2), dtype=np.uint64)
    f = line_dedup.CuckooFilter.sized(3000)
    assert f.insert(own) and f.contains(own).all() and f.contains(other).mean() < 0.01
    f.delete(own[:1500])
    assert f.contains(own[1500:]).all() and f.contains(own[:1500]).mean() < 0.02
    assert (line_dedup.CuckooFilter.from_bytes(f.to_bytes()).slots == f.slots).all()


def plain_components(rows):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
            up[find(a)] = find(b)
    low_ = collections.defaultdict(list)
    for x in range(len(rows)):
        low_[find(x)].append(rows[x][0])
    return sorted([(rows[x][0], len(sets[x]), min((i for i in low_[find(x)] if i is not None), default=None)) for x in range(len(rows))], key=str)


def test_jaccard_join(spark, odd_dir, odd_rows):
    got = sorted([tuple(r) for r in QUERIES["op10_jaccard_join"](spark, odd_dir).select("doc_id", "n_shingles", "component_id").collect()], key=str)
    assert got == plain_components(odd_rows)


@pytest.mark.parametrize("block", (jaccard_join.LIST_BLOCK, 3))
def test_jaccard_join_of_chains(spark, monkeypatch, block):
    """Groups of edited copies, some linked only through others, and a passage that all texts share; also with lists of many blocks."""
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", block)
    rng = random.Random(3)
    rows, passage = [], prose(rng, 25)
    for g in range(6):
        own = prose(rng, rng.choice((30, 60, 150))).split()
        for _ in range(14):
            own = list(own)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = f"w{rng.randint(0, 99)}"
            rows.append((len(rows) * 7 % 1000, " ".join(own) + (" " + passage if g % 2 else "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in jaccard_join.jaccard_components(docs).collect()], key=str)
    assert got == plain_components(rows)
    assert len({r[2] for r in got}) < len(rows)


def test_jaccard_join_through_a_row_without_id(spark, tmp_path):
    text = lambda mark, a: " ".join(f"{mark}{i}" for i in range(a, a + 180))
    rows = [(1, text("x", 0)), (None, text("x", 18)), (2, text("x", 36)), (3, text("y", 0)), (4, text("y", 36))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in QUERIES["op10_jaccard_join"](spark, str(tmp_path)).collect()}
    assert got[1] == got[2] == 1 and (got[3], got[4]) == (3, 4)


def test_divide_skip():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lists = [np.sort(rng.choice(30, rng.integers(0, 25), replace=False)) for _ in range(rng.integers(1, 40))]
        need = rng.integers(1, 25, 30)
        ends = np.cumsum([len(x) for x in lists])
        owners = np.concatenate(lists)
        count = np.bincount(owners, minlength=30)
        assert sorted(jaccard_join.divide_skip(owners, ends - [len(x) for x in lists], ends, need)) == sorted(np.flatnonzero(count >= need))


def test_shingle_index():
    rng = np.random.default_rng(3)
    for _ in range(40):
        pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(1, 120))) for _ in range(rng.integers(1, 30))]
        query = np.unique(rng.choice(pool, rng.integers(1, 120)))
        want = [k for k, s in enumerate(sets) if 100 * (i := len(np.intersect1d(s, query))) >= 80 * (len(s) + len(query) - i)]
        assert sorted(jaccard_join.ShingleIndex(sets).search(query, 80)) == want


def test_parity_bits_never_overrate():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    sets = sorted((np.unique(rng.choice(pool, rng.integers(1, 500))) for _ in range(60)), key=len)
    bitmaps = jaccard_join.Bitmaps(pa.array([jaccard_join.parity_bits(s) for s in sets], pa.binary()))
    i, j = (np.array(x) for x in zip(*itertools.combinations(range(60), 2), strict=True))
    found = bitmaps.fewest_differences(i, j)
    assert (found <= [len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]).all() and (found > 0).sum() > 600


def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination(spark, odd_dir):
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in QUERIES["op3_decontamination"](spark, odd_dir).collect()}
    assert got == {(60, 0): 0, (61, 0): 1}


def test_decontamination_against_alignment(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randint(4, 30))) for k in range(8)]
    rows = []
    for k, item in items:
        for edits in (0, 1, 2, 4, 8):
            t = list(item)
            for _ in range(edits):
                p = rng.randrange(len(t))
                t[p : p + 1] = rng.choice((["x"], [], [t[p], "q"]))
            rows.append((len(rows), f"{prose(rng, 20)} {''.join(t)} {prose(rng, 10)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for (d, t), (k, item) in itertools.product(rows, items):
        edits = fewest_edits(item, " ".join(t.split()))
        if edits <= decontaminate.budget(len(item)):
            want[d, k] = edits
    assert got == want and len(want) > 20


def test_packing_round_trip(spark, odd_dir, odd_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = QUERIES["op8_packing"](spark, odd_dir).toPandas()
    want = collections.Counter()
    for i, text in odd_rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids)] += 1
        own = rows[(rows["doc_id"] == i) & (rows["doc_tokens"] == len(ids))] if i is not None else rows[rows["doc_id"].isna()]
        assert own["length"].sum() % len(ids) == 0 and len(own)
        for r in own.itertuples():
            if i not in (22, 53):
                assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert rows["length"].sum() == sum(n * c for (_, n), c in want.items())
    sizes = rows.groupby("sequence_id")["length"].sum()
    assert all(s == 2048 or s & (s - 1) == 0 for s in sizes)
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id")["length"].cumsum() - rows["length"] == rows["offset"]).all()


def test_word_tokenizer_on_odd_words():
    import public_tokenizers

    w = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for s in ["", "Don't stop!!! (now)...", "É À ñ, ü.", "áb Å... İx", "<|endoftext|> <|ENDOFTEXT|> x<|endoftext|>.", "tab\tvt\x0bff\x0c nb sp 　 x", "12 3.4, 5", "日本語。テスト!", "x_y-z'll we'd.", "…. ,. a., b?!"]:
        assert np.frombuffer(w.encode([s.encode()])[0], np.uint32).tolist() == w.tokenizer.encode(s, add_special_tokens=False).ids, s


def test_hilbert_neighbours():
    bits = 3
    cells = np.array(list(itertools.product(range(1 << bits), repeat=2)))
    order = cells[np.argsort(packing.hilbert_index(cells, bits))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    cells = np.array(list(itertools.product(range(4), repeat=4)))
    order = cells[np.argsort(packing.hilbert_index(cells, 2))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_lm_base_scores(spark, odd_dir, odd_rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter(w for i, t in odd_rows if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 4)) for i, t in odd_rows), key=str)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in QUERIES["op6_lm_scoring"](spark, odd_dir).collect()), key=str)
    assert got == want


class PlainTree:
    """The suffix tree by dictionaries: numbers of symbols, counts by context, states grown from the root."""

    def __init__(self, texts_, classes, own, least=language_model.LEAST_COUNT, gain=language_model.GAIN):
        self.classes, self.own = classes, own
        self.hash = lambda w: int(language_model.END_TOKEN) if w is None else int(common.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0])
        self.c = collections.Counter(w for t in texts_ for w in [*words(t), None])
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        rank = sorted(self.c, key=lambda w: (-self.c[w], signed(self.hash(w))))
        self.number = {w: k + 1 for k, w in enumerate(rank[:own])}
        self.weight = collections.Counter()
        for w in rank[own:]:
            self.weight[self.of(w)] += self.c[w] + 1
        total = sum(self.c.values()) + len(self.c) + classes
        self.q = lambda s: (self.weight[s] + 1 if s > own else (self.c[rank[s - 1]] if s <= len(rank) else 0) + 1) / total
        self.n = [collections.defaultdict(collections.Counter) for _ in range(3)]
        for t in texts_:
            ids = self.ids(t)
            for k in range(2, len(ids)):
                for d in (1, 2):
                    self.n[d][tuple(ids[k - d : k])][ids[k]] += 1
        self.states = set()
        for d in (1, 2):
            for c, own_ in self.n[d].items():
                sum_ = sum(own_.values())
                kl = sum(k * math.log(k / sum_ / self.p(c[1:], s)) for s, k in own_.items())
                if sum_ >= least and kl >= gain * len(own_) and (d == 1 or c[1:] in self.states):
                    self.states.add(c)

    def of(self, w):
        return self.number.get(w) or self.own + 1 + self.hash(w) % self.classes

    def ids(self, t):
        return [0, 0, *map(self.of, [*words(t), None])]

    def p(self, c, s):
        if not c:
            return self.q(s)
        if c not in self.states:
            return self.p(c[1:], s)
        n = self.n[len(c)][c]
        return (n[s] + len(n) * self.p(c[1:], s)) / (sum(n.values()) + len(n))

    def score(self, t):
        ids = self.ids(t)
        within = [math.log10((self.c[w] + 1) / (self.weight[self.of(w)] + 1)) for w in [*words(t), None] if self.of(w) > self.own]
        return sum(math.log10(self.p(tuple(ids[k - 2 : k]), ids[k])) for k in range(2, len(ids))) + sum(within)


@pytest.mark.parametrize(("classes", "own", "buckets", "most"), ((4096, 61439, 4, 1 << 20), (4, 12, 1, 1 << 20), (8, 20, 40, 30)))
def test_lm_scores_against_a_plain_tree(spark, monkeypatch, classes, own, buckets, most):
    """Also with classes of words, with words and pairs that are dealt over many buckets, and with words that meet their counts in a join."""
    monkeypatch.setattr(language_model, "BUCKETS_A_PARTITION", buckets)
    monkeypatch.setattr(language_model, "MOST_WORDS", most)
    rng = random.Random(2)
    rows = [(i, prose(rng, 60) if i % 5 else "qxz jjk unseen \u00e9 " + prose(rng, 9)) for i in range(40)] + [(90, None), (91, ""), (92, "the the of " * 30)]
    rows += [(100 + i, rows[1][1]) for i in range(4)]
    docs = spark.createDataFrame([(i, t, i % 5 > 0) for i, t in rows], "doc_id long, text string, learn boolean")
    tree = PlainTree([t for i, t in rows if i % 5], classes, own)
    assert {len(c) for c in tree.states} == {1, 2}
    got = {r["doc_id"]: r["score"] for r in language_model.score_texts(docs, classes=classes, own_words=own).collect()}
    for i, t in rows:
        assert abs(got[i] - tree.score(t)) < 1e-6, i
    for c in [(), *list(tree.states)[:20]]:
        assert abs(sum(tree.p(c, s) for s in range(1, own + 1 + classes) if s > own or s <= len(tree.c)) - 1) < 1e-9


def test_lm_beats_the_unigram_base_on_held_out_texts(spark):
    df = QUERIES["op6_lm_scoring"](spark, "/root/testdata/sf0.01").toPandas()
    held = df[df["held_out"]]
    assert held["score"].sum() > 0.95 * held["base_score"].sum() and df["score"].sum() > df["base_score"].sum()
    assert held["score"].sum() > held["base_score"].sum()


def test_states_grow_with_the_corpus(spark):
    """A context that is there three times of 60,000 is a state."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, f"{prose(rng, 20_000)} qzvxk wwq qzvxk wwq", True) for i in range(3)] + [(9, "qzvxk wwq", False), (10, "wwq qzvxk", False)], "doc_id long, text string, learn boolean")
    got = {r["doc_id"]: r for r in language_model.score_texts(docs).collect()}
    assert got[9]["score"] > got[10]["score"] + 0.5 and abs(got[9]["base_score"] - got[10]["base_score"]) < 1e-9


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = (prose(random.Random(1), 3000) + " " + "x" * 900 + " end").encode()
    whole = common.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    monkeypatch.setattr(common, "STEP_BYTES", 256)
    monkeypatch.setattr(common.pieces, "__defaults__", (256,))
    parts = common.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_order_minhash(spark, odd_dir, odd_rows):
    got = {}
    for r in QUERIES["op5_order_minhash"](spark, odd_dir).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(odd_rows)
    order = sorted([(i, t or "") for i, t in odd_rows if i is not None], key=lambda x: (-x[0], x[1]))
    for k, (i, t) in enumerate(order):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + order[(k + 1) % len(order)][1][:cut]
        assert any(r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() for r in got[i]), i
    assert got[50][0]["fingerprint"] == got[51][0]["fingerprint"] != got[52][0]["fingerprint"]
    assert got[51][0]["near_next"] == 1.0 and got[21][0]["near_next"] > 0.9 and got[7][0]["fingerprint"] == ""


def test_order_minhash_minds_order(spark):
    rng = random.Random(6)
    a, b = prose(rng, 400).split(), prose(rng, 400).split()
    one, two = " ".join(a + b), " ".join(b + a)
    df = spark.createDataFrame([(one, two, " ".join(a + b[:-20]))], "x string, y string, z string")
    for c in "xyz":
        df = order_minhash.with_fingerprint(df, c, f"f{c}")
    r = df.select(order_minhash.likeness("fx", "fy").alias("turned"), order_minhash.likeness("fx", "fz").alias("cut")).first()
    assert r["cut"] > 0.85 > 0.7 > r["turned"]


def test_order_minhash_likeness_falls_with_edits(spark):
    """Words replaced at growing rates, blocks moved, and another text: means over ten texts."""
    rng = random.Random(1)
    rates, rows = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4), []
    for _ in range(10):
        own = prose(rng, 400).split()
        for rate in rates:
            x = list(own)
            for k in rng.sample(range(len(x)), int(rate * len(x))):
                x[k] = f"zz{rng.randint(0, 999)}"
            rows.append((rate, " ".join(own), " ".join(x)))
        rows.append((2.0, " ".join(own), " ".join(own[200:] + own[:200])))
        rows.append((9.0, " ".join(own), prose(rng, 400)))
    df = spark.createDataFrame(rows, "kind double, a string, b string")
    df = order_minhash.with_fingerprint(order_minhash.with_fingerprint(df, "a", "fa"), "b", "fb")
    mean = {r["kind"]: r["m"] for r in df.groupBy("kind").agg(F.avg(order_minhash.likeness("fa", "fb")).alias("m")).collect()}
    assert [mean[r] for r in rates] == sorted((mean[r] for r in rates), reverse=True)
    assert mean[0.0] == 1 and mean[0.02] > 0.7 > mean[0.05] > 0.45 and mean[0.4] < 0.08 and mean[9.0] < 0.05 and mean[2.0] < 0.95


def test_long_texts_are_read_in_stretches(monkeypatch):
    text = prose(random.Random(4), 900)
    column = pa.array([text, "short one", ""], pa.large_string())
    net = language_id.ByteNet(["a", "b"])
    whole = packing.trigram_histograms(column), language_id.predictor(net).func(column.to_pandas())
    for module in (packing, language_id):
        monkeypatch.setattr(module, "STEP_BYTES", 512)
    monkeypatch.setattr(common.texts, "__defaults__", (512,))
    parts = packing.trigram_histograms(column), language_id.predictor(net).func(column.to_pandas())
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1]["score"], parts[1]["score"]) and (whole[1]["lang_pred"] == parts[1]["lang_pred"]).all()


def plain_spans(t):
    out = []
    kinds = ("email", "ip", "card", "phone")
    pats = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, p in enumerate(pats):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(d) <= 19 and personal_data.luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, e, k in sorted(out, key=lambda x: (x[0], x[2])))


def test_base_spans_against_patterns():
    rng = random.Random(4)
    bits = ["a", "b@", "@", ".", "c.d", "1", "23", "255", "4111111111111111", " ", "-", "+", "(", ")", "é", "x@y.z", "1.2.3.4", "\n", "+12 345 678 90", "0000", "%_"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert personal_data.joined(personal_data.base_spans(t)) == plain_spans(t), t


def test_personal_data(spark, odd_dir, odd_rows):
    rows = QUERIES["op2_personal_data"](spark, odd_dir).collect()
    assert len(rows) == len(odd_rows)
    texts = {i: t for i, t in odd_rows}
    for r in rows:
        if r["doc_id"] not in (22, 53, None):
            base = plain_spans(texts[r["doc_id"]] or "")
            assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
            assert set(base.split(",")) <= set(r["spans"].split(","))
    own = next(r for r in rows if r["doc_id"] == 62)
    assert (own["n_email"], own["n_ip"], own["n_card"], own["n_phone"]) == (1, 0, 1, 1)


def test_semi_markov_model_on_unseen_sentences():
    model = personal_data.fitted()
    right = wrong = there = 0
    for tokens, gold in personal_data.made_sentences(200, 77):
        found = {(s, e, k) for s, e, k, p in model.decode(tokens) if p >= personal_data.LEAST_PROBABILITY}
        right, wrong, there = right + len(found & gold), wrong + len(found - gold), there + len(gold)
    assert wrong <= 0.03 * right and right >= 0.55 * there
    t = "please contact anna at mailhost dot com or use 1234 and 2024-05-17 today"
    assert [(t[s:e], k) for s, e, k in personal_data.added_spans(model, t, [])] in ([("anna at mailhost dot com", 0)], [])


def test_spans_beside_a_base_span_at_the_ends_of_a_text():
    model = personal_data.fitted()
    for t, own in (("card 4111 1111 1111 1111 call 555-123-4567", "555-123-4567"), ("call 555-123-4567 card 4111 1111 1111 1111", "555-123-4567")):
        base = personal_data.base_spans(t)
        assert [k for _, _, k in base] == [2]
        assert [(t[s:e], k) for s, e, k in personal_data.added_spans(model, t, base)] == [(own, 3)]


def test_spelled_addresses():
    model = personal_data.fitted()
    names = ("user [AT] host [DOT] org", "rosa (at) lore.de", f"anna at {'x' * 50} dot com", "anna (AT) mailhost (DOT) com")
    for own in names:
        t = f"the list of names\n{own}\nis meant to be read at home or at work by all of us"
        assert [(t[s:e], k) for s, e, k in personal_data.added_spans(model, t, personal_data.base_spans(t))] == [(own, 0)], own


def test_secrets_and_account_numbers(spark):
    model = personal_data.fitted()
    for t, want in (
        ('TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!', [("9233A8ECF7C5B09FE5949719B6B82BC439E9329B", 4)]),
        ("see commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 of it", []),
        ("to iban DE89 3704 0044 0532 0130 00 by friday", [("DE89 3704 0044 0532 0130 00", 5)]),
        ("write to jane dot doe at example dot com today", [("jane dot doe at example dot com", 0)]),
        ("at home. at work and at sea", []),
    ):
        assert [(t[s:e], k) for s, e, k in personal_data.added_spans(model, t, personal_data.base_spans(t))] == want, t
    texts_ = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op2_personal_data"](spark, "/root/testdata/sf0.01").collect()
    there = {r["doc_id"]: len(re.findall(r'(?i)token = "[0-9a-f]{40}"', texts_[r["doc_id"]])) for r in rows}
    assert sum(there.values()) > 10 and all(r["n_secret"] == there[r["doc_id"]] for r in rows)
    assert all(r["n_spans"] == len([x for x in r["spans"].split(",") if x]) for r in rows)


def test_language_id(spark):
    df = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    truth = duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").df()
    both = df.merge(truth)
    held = both[both["held_out"]]
    assert len(both) == 1000 and (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_language_id_on_odd_rows(spark, odd_dir):
    rows = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, odd_dir).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (3, 7, 8, 9))
    assert rows[20]["lang_pred"] in ("en", "fr") and rows[None]["held_out"] is False


def test_quality(spark, odd_dir, odd_rows):
    df = QUERIES["op9_quality"](spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("select * from '/root/testdata/sf0.01/labels.parquet'").df()
    held = df[df["held_out"]].merge(labels)
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    rows = QUERIES["op9_quality"](spark, odd_dir).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= quality.THRESHOLD) for r in rows)


def test_quality_learns_from_positives_alone(spark):
    """Bad labels change nothing, and the estimated prior is near the share of good texts."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    net, prior = quality.train(docs, labels)
    other, prior_ = quality.train(docs, labels.where("quality = 1"))
    assert prior == prior_ and (net.p[0] == other.p[0]).all()
    assert abs(prior - labels.agg({"quality": "avg"}).first()[0]) < 0.08


def test_quality_forward_and_risk_against_plain_sums():
    rng = np.random.default_rng(1)
    pos, unl = rng.normal(1, 1, (60, 5)).astype(np.float32), np.concatenate((rng.normal(1, 1, (60, 5)), rng.normal(-1, 1, (60, 5)))).astype(np.float32)
    net = quality.PuNet(5).fit(pos, unl, 0.5, 30)
    for x in unl[:10]:
        z = [(a - m) / s for a, m, s in zip(x, net.mean, net.scale, strict=True)]
        hidden = [max(0.0, sum(a * w for a, w in zip(z, net.p[0][:, k], strict=True)) + net.p[1][k]) for k in range(quality.HIDDEN)]
        assert abs(sum(h * w for h, w in zip(hidden, net.p[2], strict=True)) + net.p[3][0] - net.raw(x[None])[0]) < 1e-3
    assert net.raw(unl[:60]).mean() > net.raw(unl[60:]).mean() + 1
    assert abs(quality.estimated_prior(pos, unl) - 0.5) < 0.2
    assert abs(net.curve(unl, 0.4).score(unl).mean() - 0.4) < 1e-3
    assert quality.best_bin(np.array([2.0, 3.0]), np.array([1.0, 1.0, 2.0, 3.0])) == 0.5


def test_language_network_against_plain_sums():
    """Embedding, filters of several widths, largest answer and softmax, one number at a time."""
    net = language_id.ByteNet(["a", "b", "c"])
    text = np.zeros((1, language_id.WINDOW), np.uint8)
    text[0, :40] = np.frombuffer(b"the quick brown fox jumps over the lazy ", np.uint8)
    e, top = net.p["embed"], []
    for k, width in enumerate(w for w in language_id.WIDTHS for _ in range(language_id.FILTERS)):
        f = net.p["filters"][:, k].reshape(language_id.SPAN, language_id.EMBED)
        answers = [sum(float(e[text[0, i + j]] @ f[j]) for j in range(width)) for i in range(language_id.WINDOW - language_id.SPAN + 1)]
        top.append(max(0.0, max(answers) + net.p["bias"][k]))
    s = np.array(top) @ net.p["out"] + net.p["out_bias"]
    want = s - np.log(np.exp(s).sum())
    assert np.abs(net.log_probabilities(text)[0] - want).max() < 1e-4


def test_text_steps_split_nothing():
    column = pa.array(["ab c", None, "", "dé f", "x" * 5000])
    for step in (1, 6, 1 << 20):
        seen = [(first + k, data[o[k] : o[k + 1]].tobytes().decode()) for first, data, o in common.texts(column, step) for k in range(len(o) - 1)]
        assert seen == [(0, "ab c"), (1, ""), (2, ""), (3, "dé f"), (4, "x" * 5000)]
    hashes, rows = common.word_hashes(np.frombuffer("The the THE té".encode(), np.uint8), np.array([0, 7, 15]))
    assert rows.tolist() == [0, 2, 4] and len({int(x) for x in hashes[:3]}) == 1


def test_windows_cover_the_text():
    data = np.frombuffer(("ab" * 300).encode(), np.uint8)
    x, rows, have = language_id.windows(data, np.array([0, 0, 500, 600]))
    assert rows.tolist() == [1, 1, 2] and have.tolist() == [256, 244, 100] and x.shape == (3, 256)
