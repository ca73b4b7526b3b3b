"""Line deduplication over an index that documents enter and leave: exact reference counts of line keys, with sharded cuckoo filters before them.

A line's key is its text with ASCII white space stripped and A-Z lower-cased; only keys of at least ``min_chars``
code points count. The index keeps a reference (key, doc_id) for each document that holds a key, each key's exact count of references with its largest
doc_id, and filters of the keys whose count reaches ``min_docs``. Inserting documents adds to the counts of their keys, deleting takes
them back exactly; only the keys that become or cease to be frequent move in or out of the filters, whose other shards keep their bytes.
A shard that fills up is built anew from the exact table.

Deduplication probes the filters where texts are read, so that only lines that may be frequent are moved; the exact table then decides. Filters
of up to BROADCAST_KEYS keys (2.5 bytes each) go to every task. Beyond that they would have to be moved to the lines, or the lines to them, which is
the same shuffle as meeting the exact table: then all lines meet it.

Defined cases: a null text is an empty one, that is one empty line; every row counts as a document of its own, also
where a doc_id repeats (all rows of the largest doc_id keep their lines); an empty table gives an empty result; a row without
doc_id counts as a document and keeps its lines; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, small_batches, stored, table

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys in one filter shard at most, on average; and frequent keys up to which filters or the exact table are broadcast.
SHARD_KEYS, BROADCAST_KEYS = 1 << 15, 1 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """A 16-byte digest of the line's key, or None if the key is too short to count."""
    if len(line) < min_chars:
        return None
    key = line.strip().lower()  # of bytes: ASCII only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """16-bit fingerprints in buckets of four; the two buckets of a key are each other's partner by the fingerprint."""

    WAYS, KICKS = 4, 500

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.slots = np.zeros((buckets, self.WAYS), np.uint16) if slots is None else slots

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / cls.WAYS / 0.8)))))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        slots = np.frombuffer(data, np.uint16).reshape(-1, cls.WAYS)
        return cls(len(slots), slots)

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: (n, 2) uint64, the digest's halves."""
        mark = (keys[:, 0] >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        one = (keys[:, 1] & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, one, self._partner(one, mark)

    def _partner(self, place, mark):
        return place ^ ((mark.astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if some key found no place; the filter has then to be built anew with more buckets."""
        rng = np.random.default_rng(7)
        for mark, one, two in zip(*self._places(keys), strict=True):
            for place in (one, two):
                if len(free := np.flatnonzero(self.slots[place] == 0)):
                    self.slots[place, free[0]] = mark
                    break
            else:
                for _ in range(self.KICKS):
                    way = rng.integers(self.WAYS)
                    mark, self.slots[place, way] = self.slots[place, way], mark
                    place = self._partner(place, mark)
                    if len(free := np.flatnonzero(self.slots[place] == 0)):
                        self.slots[place, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Only for keys that were inserted."""
        for mark, one, two in zip(*self._places(keys), strict=True):
            for place in (one, two):
                if len(found := np.flatnonzero(self.slots[place] == mark)):
                    self.slots[place, found[0]] = 0
                    break


def halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The exact table: a row (key, doc_id) for each key that a document holds."""
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])

    def run(batches):
        for batch in batches:
            keys, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = {k for line in (text or b"").split(b"\n") if (k := line_key(line, min_chars))}
                keys += own
                ids += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(run), "key binary, doc_id long")


def _shard(shards: int):
    """By the digest's first bytes."""
    return F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), F.lit(shards))


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, n_keys, filter) over the column key; a shard holds about SHARD_KEYS keys, as digests spread evenly."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        own, size = halves(list(pdf["key"])), len(pdf)
        while not (f := CuckooFilter.sized(size)).insert(own):
            size *= 2
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n_keys": [len(pdf)], "filter": [f.to_bytes()]})

    return keys.select("key", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard long, n_keys long, filter binary")


def update_filters(filters: DataFrame, gone: DataFrame, come: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """Filters after keys left (gone) and entered (come) the frequent ones, which are now keys; untouched shards keep their bytes. A shard in which a key finds no
    place is built anew from keys."""
    moves = gone.select("key", F.lit(-1).alias("move")).unionByName(come.select("key", F.lit(1).alias("move"))).withColumn("shard", _shard(shards))

    def apply(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = int((old if len(old) else new)["shard"].iloc[0])
        out, into = (list(new.loc[new["move"] == m, "key"]) for m in (-1, 1))
        f = CuckooFilter.from_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter.sized(max(64, len(into)))
        f = CuckooFilter(f.buckets, f.slots.copy())
        n = int(old["n_keys"].iloc[0]) if len(old) else 0
        if out:
            f.delete(halves(out))
        full = bool(into) and not f.insert(halves(into))
        return pd.DataFrame({"shard": [shard], "n_keys": [n - len(out) + len(into)], "filter": [None if full else f.to_bytes()]})

    moved = stored(filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(apply, "shard long, n_keys long, filter binary"), "filters")
    full = [r["shard"] for r in moved.where("filter is null").select("shard").collect()]  # a number for each shard
    if not full:
        return moved
    return moved.where("filter is not null").unionByName(build_filters(keys.where(_shard(shards).isin(full)), shards))


class LineIndex:
    """References (key, doc_id), counts (key, n_docs, last_doc) and filters (shard, n_keys, filter), all stored tables. Inserting and deleting give
    a new index; this one stays as it is."""

    def __init__(self, refs: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.refs, self.counts, self.filters, self.shards, self.min_chars, self.min_docs = refs, counts, filters, shards, min_chars, min_docs

    @classmethod
    def empty(cls, spark: SparkSession, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        none = lambda kind: spark.createDataFrame([], kind)
        return cls(none("key binary, doc_id long"), none("key binary, n_docs long, last_doc long"), none("shard long, n_keys long, filter binary"), 1, min_chars, min_docs)

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        new = stored(references(docs, self.min_chars), "line-references")
        more = new.groupBy("key").agg(F.count(F.lit(1)).alias("more"), F.max("doc_id").alias("new_last"))
        counts = self.counts.join(more, "key", "full").select("key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "new_last").alias("last_doc"))
        return self._with(self.refs.unionByName(new), counts)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of doc_ids: what was inserted is taken back exactly."""
        gone = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        keys = self.refs.join(gone, "doc_id", "left_semi").select("key").distinct()
        refs = stored(self.refs.join(gone, "doc_id", "left_anti").select("key", "doc_id"), "line-references")
        left = refs.join(keys, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        return self._with(refs, self.counts.join(keys, "key", "left_anti").unionByName(left))

    def _with(self, refs: DataFrame, counts: DataFrame) -> LineIndex:
        counts = stored(counts, "line-counts")
        new = LineIndex(refs, counts, self.filters, self.shards, self.min_chars, self.min_docs)
        now, before = new.frequent().select("key"), self.frequent().select("key")
        wanted = max(1, -(-now.count() // SHARD_KEYS))
        if wanted > 2 * self.shards and self.filters.limit(1).count():
            new.shards, new.filters = wanted, stored(build_filters(now, wanted), "filters")
            return new
        new.shards = self.shards if self.filters.limit(1).count() else wanted
        gone, come = before.join(now, "key", "left_anti"), now.join(before, "key", "left_anti")
        new.filters = update_filters(self.filters, gone, come, now, new.shards)
        return new


def _candidates(docs: DataFrame, filters: dict[int, bytes], shards: int, min_chars: int) -> DataFrame:
    """(key, doc_id) of the lines that the filters let through."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])

    def run(batches):
        loaded = {s: CuckooFilter.from_bytes(f) for s, f in shared.value.items()}
        for batch in batches:
            keys, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for k in {k for line in (text or b"").split(b"\n") if (k := line_key(line, min_chars))}:
                    keys.append(k)
                    ids.append(doc)
            pairs = halves(keys)
            of = np.frombuffer(b"".join(keys), ">u4").reshape(-1, 4)[:, 0].astype(np.int64) % shards
            hit = np.zeros(len(keys), bool)
            for s in np.unique(of):
                if s in loaded:
                    own = np.flatnonzero(of == s)
                    hit[own] = loaded[s].contains(pairs[own])
            at = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at], pa.binary()), pa.array([ids[i] for i in at], pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(run), "key binary, doc_id long")


KEPT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])


def _kept(min_chars: int):
    @F.pandas_udf(KEPT)
    def keep(text: pd.Series, drop: pd.Series) -> pd.DataFrame:
        n, dropped, kept = [], [], []
        for t, d in zip(text, drop, strict=True):
            lines = (t or "").split("\n")
            stay = lines
            if d is not None and len(d):
                d = set(d)
                stay = [x for x in lines if len(x) < min_chars or line_key(x.encode(), min_chars) not in d]
            n.append(len(lines))
            dropped.append(len(lines) - len(stay))
            kept.append("\n".join(stay))
        return pd.DataFrame({"n_lines": n, "n_dropped": dropped, "kept": kept})

    return keep


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, index: LineIndex | None = None, out: str = "line_dedup") -> DataFrame:
    """docs with the struct column out (n_lines, n_dropped, kept), which replaces one of that name: lines whose key is in at least min_docs
    documents of the index stay only in the largest doc_id. Without an index docs are inserted into an empty one."""
    small_batches(docs.sparkSession)
    if index is None:
        index = LineIndex.empty(docs.sparkSession, min_chars, min_docs).insert(docs)
    n = index.frequent().count()
    if n <= BROADCAST_KEYS:
        filters = {r["shard"]: bytes(r["filter"]) for r in index.filters.toLocalIterator()}
        lines = _candidates(docs, filters, index.shards, index.min_chars)
    else:
        lines = references(docs, index.min_chars)
    exact = index.frequent().select("key", "last_doc")
    drops = lines.join(F.broadcast(exact) if n <= BROADCAST_KEYS // 4 else exact, "key").where("doc_id < last_doc")
    drops = drops.groupBy("doc_id").agg(F.collect_set("key").alias("drop_keys")).withColumnRenamed("doc_id", "drop_doc")
    joined = docs.join(drops, docs["doc_id"] == drops["drop_doc"], "left")
    return joined.select(*[docs[c] for c in docs.columns if c != out], _kept(index.min_chars)(docs["text"].cast("string"), drops["drop_keys"]).alias(out))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("line_dedup.kept").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, n, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)
), hot AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.n, l.line, coalesce(l.doc_id < h.last_doc, false) AS dropped FROM lines l LEFT JOIN hot h ON l.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
