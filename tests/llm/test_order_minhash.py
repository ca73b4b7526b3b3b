"""Fingerprints and likeness of op5 against a plain version."""

import hashlib
import re
import struct

import pytest
import xxhash

from retort.llm import order_minhash as om
from retort.llm.queries import QUERIES


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(*values, seed=42):
    """Spark's hash of several values: text by its bytes, longs by 8, (n,) by 4 bytes."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64(raw, seed).intdigest()
    return signed(seed)


def plain_fingerprint(text):
    """{slot: hash of the tuple}: k-mers of words, numbered where they repeat, the two smallest of each slot in text order."""
    words = [chained(w) for w in re.findall(rf"[^\x20\x09-\x0D]{{1,{om.PIECE}}}", text)]
    kmers = [chained(*words[i : i + om.K]) >> om.PLACE_BITS for i in range(max(len(words) - om.K, 0) + 1)] if words else []
    seen, slots = {}, {}
    for place, k in enumerate(kmers):
        n = seen[k] = seen.get(k, -1) + 1
        h = k if not n else chained(k, (n,)) >> om.PLACE_BITS
        slots.setdefault(h >> (64 - om.PLACE_BITS - om.SLOT_BITS), []).append((h, place))
    out = {}
    for slot, own in slots.items():
        two = sorted(sorted(own)[:2], key=lambda x: x[1])
        out[slot] = chained(slot, *(h for h, _ in two))
    return out


def likeness(a, b):
    filled = len({*a, *b})
    return 1.0 if not filled else len(set(a.values()) & set(b.values())) / filled


def check(spark, d, docs):
    docs = sorted(((i, t or "") for i, t in docs if i is not None), key=lambda r: (-r[0], r[1]))
    got = {}
    for r in QUERIES["op5_order_minhash"](spark, d).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        f, e, n = plain_fingerprint(text), plain_fingerprint(edited), plain_fingerprint(after)
        shown = lambda x: "".join(f"{x[s] % (1 << 64):016X}" for s in sorted(x))
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(f), shown(e), likeness(f, e), likeness(f, n))
        assert want in [(r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got[i]]


def test_on_tables(spark):
    d = "/root/testdata/sf0.001"
    check(spark, d, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])


def test_texts_that_repeat(spark, tmp_path):
    texts = ["a b c " * 50, "a b c d " * 30 + "a b c", "x", "", None, "x y", "long" * 40 + " é ü 漢字 " * 9, "one two three four five six seven", "seven six five four three two one"]
    docs = [(3 * i + 1, t) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(spark, str(tmp_path), docs)


@pytest.mark.parametrize("share,least,most", [(0.0, 1.0, 1.0), (0.05, 0.3, 0.9), (0.5, 0.0, 0.1)])
def test_likeness_falls_with_edits(share, least, most):
    import random

    rng = random.Random(3)
    words = [f"w{rng.randint(0, 400)}" for _ in range(500)]
    other = [f"v{rng.randint(0, 400)}" if rng.random() < share else w for w in words]
    assert least <= likeness(plain_fingerprint(" ".join(words)), plain_fingerprint(" ".join(other))) <= most
