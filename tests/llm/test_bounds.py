"""Work and memory on texts and groups that repeat themselves, and on tables of any size."""

import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retort.llm import decontaminate, jaccard_join, packing
from retort.llm.common import prefix_hashes


def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def found(item, text, q=decontaminate.Q, error=decontaminate.ERROR):
    data = np.frombuffer(text, np.uint8)
    return decontaminate.find(decontaminate.Items([(0, item)], q, error), data, prefix_hashes(data), 0)


@pytest.mark.parametrize("item", [b"ab cd " * 50, b"ab cd " * 25 + b"xyzzy " + b"ab cd " * 25, b"ab cd " * 30 + b"q" + b"ab cd " * 20])
def test_item_in_a_megabyte_that_repeats(item):
    item = item.strip()
    text = b"ab cd " * 170_000
    found(item, text[:600])
    tracemalloc.start()
    began = time.time()
    out = found(item, text)
    assert time.time() - began < 5 * 3 and tracemalloc.get_traced_memory()[1] < 200e6  # tracing takes its time too
    tracemalloc.stop()
    assert out[0][0] == fewest_edits(item, text[:900])


def test_windows_and_pieces_find_what_one_look_finds(monkeypatch):
    rng = random.Random(4)
    for _ in range(60):
        unit = bytes(rng.choice(b"abc ") for _ in range(rng.randint(2, 9)))
        item = bytearray(unit * 12)[: rng.randint(40, 90)]
        for _ in range(rng.randint(0, 3)):
            item[rng.randrange(len(item))] = ord("z")
        text = unit * rng.randint(5, 40) + bytes(rng.choice(b"abcz ") for _ in range(rng.randint(0, 60))) + bytes(item) * rng.randint(0, 2) + unit * 9
        plain = found(bytes(item), text)
        monkeypatch.setattr(decontaminate, "ENTRIES", 50)
        monkeypatch.setattr(decontaminate, "WINDOW", 64)
        assert {k: e for k, (e, _) in found(bytes(item), text).items()} == {k: e for k, (e, _) in plain.items()}
        monkeypatch.undo()
        most = decontaminate.budget(len(item))
        edits = fewest_edits(bytes(item), text)
        assert (edits <= most) == bool(plain) and (not plain or plain[0][0] == edits)


@pytest.mark.parametrize("rows", [20_001, 10**8, 10**11, 10**14])
def test_a_sample_for_any_number_of_rows(spark, rows):
    """Of 200,000 rows as many are taken as of a table of so many rows; with a repeated or missing doc_id too."""
    df = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    want = packing.SAMPLE / rows * 200_000
    got = df.where(packing.sampled(rows)).count()
    assert want - 6 * want**0.5 - 1 <= got <= want + 6 * want**0.5 + 1


def test_packing_ranges_when_ids_repeat(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "SAMPLE", 300)
    rng = random.Random(3)
    docs = spark.createDataFrame([(1, " ".join(rng.choice(("red", "blue", "green", "über", "x7")) + str(rng.randint(0, 99)) for _ in range(20))) for _ in range(1500)], "doc_id long, text string")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert out.select(F.shiftright("sequence_id", 40)).distinct().count() == 4


def near_copies(n, words):
    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 62, words)
    sets = []
    for _ in range(n):
        own = base.copy()
        own[rng.integers(0, words, max(1, words // 100))] = rng.integers(1, 1 << 62, max(1, words // 100))
        sets.append(np.unique(own).astype(np.uint64))
    return sorted(sets, key=len)


def table(sets, labels=None):
    bits = [jaccard_join.parity_bits(s) for s in sets]
    n = len(sets)
    return pa.table({
        "list": pa.array([1] * n), "one": pa.array([0] * n), "two": pa.array([0] * n), "part": pa.array([0] * n), "size": pa.array([len(s) for s in sets], pa.int32()),
        "node": pa.array(range(n)), "label": pa.array(labels or range(n)), "bits": pa.array(bits, pa.binary()),
    })


@pytest.mark.parametrize("which", ["first", "last"])
def test_a_list_of_near_copies_is_read_in_proportion_to_its_members(which):
    compared = jaccard_join.Compared()
    out = [b for b in jaccard_join.met(table(near_copies(2000, 100)), which, 80, compared)]
    assert sum(b.num_rows for b in out) == 1999 and compared.pairs < 2000 * 8


def test_long_near_copies_are_compared_in_little_memory():
    rows = table(near_copies(600, 9000))
    tracemalloc.start()
    compared = jaccard_join.Compared()
    out = sum(b.num_rows for b in jaccard_join.met(rows, "all", 80, compared))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out == 600 * 599 // 2 == compared.pairs and peak < 100e6


@pytest.mark.parametrize("which", ["first", "last", "all"])
def test_pairs_of_a_list_against_plain_comparison(which):
    rng = random.Random(9)
    for _ in range(20):
        sets = near_copies(rng.randint(2, 40), rng.randint(5, 60)) + near_copies(rng.randint(0, 20), rng.randint(5, 400))
        sets.sort(key=len)
        labels = [rng.randrange(4) for _ in sets]
        want = {}
        for j in range(len(sets)):
            for i in range(j):
                a, b = len(sets[i]), len(sets[j])
                if labels[i] != labels[j] and 100 * a >= 80 * b and jaccard_join.Bitmaps(pa.array([jaccard_join.parity_bits(sets[i]), jaccard_join.parity_bits(sets[j])], pa.binary())).fewest_differences(np.array([0]), np.array([1]))[0] <= a + b + 2 * (-80 * (a + b) // 180):
                    want.setdefault(j, []).append(i)
        want = {(i, j) for j, own in want.items() for i in (own if which == "all" else own[:1] if which == "first" else own[-1:])}
        got = {(i, j) for b in jaccard_join.met(table(sets, labels), which, 80, jaccard_join.Compared()) for i, j in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        assert got == want


class _Counting:
    """A tokenizer that counts the words that go through it."""

    def __init__(self, own):
        self.own, self.words = own, 0

    def encode(self, text, **more):
        self.words += len(text.split())
        return self.own.encode(text, **more)

    def encode_batch_fast(self, texts_, **more):
        self.words += sum(len(t.split()) for t in texts_)
        return self.own.encode_batch_fast(texts_, **more)


def test_word_tokenizer_learns_words_once():
    rng = np.random.default_rng(5)
    syllables = np.array(["an", "de", "the", "ing", "é", "tion", "sch", "ou", "ra", "mi"])
    words = sorted({"".join(w) for w in syllables[rng.integers(0, 10, (220_000, 7))]})
    texts_ = [" ".join(words[at : at + 500]).encode() for at in range(0, len(words), 500)]
    w = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    w.tokenizer = counted = _Counting(w.tokenizer)
    first = [x for at in range(0, len(texts_), 50) for x in w.encode(texts_[at : at + 50])]
    again = [x for at in range(0, len(texts_), 50) for x in w.encode(texts_[at : at + 50])]
    assert first == again and len(words) > 200_000
    assert counted.words <= len(words)
    assert all(np.frombuffer(first[k], "<u4").tolist() == counted.own.encode(texts_[k].decode(), add_special_tokens=False).ids for k in range(0, len(texts_), 40))


@pytest.mark.parametrize("kept, step, collide", [(600_000, 1 << 20, False), (20, 64, False), (600_000, 1 << 20, True)])
def test_word_tokenizer_at_its_bounds(monkeypatch, kept, step, collide):
    monkeypatch.setattr(packing, "KEPT_WORDS", kept, raising=False)
    monkeypatch.setattr(packing, "ENCODED_BYTES", step, raising=False)
    if collide:
        monkeypatch.setattr(packing, "stretch", lambda h, a, b: np.zeros(len(a), np.uint64), raising=False)
    w = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(7)
    bits = ["a", "B", "é", "É", ".", ",", "!", " ", "\n", "<|", "<|endoftext|>", "'s", "12", "日本", "Σς", "İ", "-", "\t", "x", " ab", " cd. "]
    texts_ = ["!!! abc", "abc", "?", "", "abc <|endoftext|> ABC.", "...", *("".join(rng.choice(bits, rng.integers(0, 60))) for _ in range(300))]
    for at in range(0, len(texts_), 3):
        for t, got in zip(texts_[at : at + 3], w.encode([t.encode() for t in texts_[at : at + 3]]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids, t
    long = " ".join(texts_)
    assert np.frombuffer(w.encode([long.encode()])[0], "<u4").tolist() == w.tokenizer.encode(long, add_special_tokens=False).ids
