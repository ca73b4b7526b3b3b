"""Benchmark decontamination by q-gram lemma filtering.

Items and documents are compared as UTF-8 bytes with A-Z lower-cased and ASCII white space collapsed to one blank. An
item of m bytes may be found with up to k = floor(error * m) edits, and no more than (m - q) / q, so that the lemma's
bound m - q + 1 - k * q on shared q-grams stays positive. For every document the q-grams shared with each item are counted in
overlapping bands of diagonals (document position minus item position), each band 2k + 1 wide at least; a band that reaches the bound
is a region, and a banded alignment of the item with it decides. An item shorter than q bytes is found as a whole word
sequence, without edits. Items without text find nothing.

Documents are only read: no row moves between tasks. Items are sent to the tasks in blocks of at most BLOCK_GRAMS
q-grams; more items than one block are met block by block.

Defined cases: null or empty texts are matched by nothing; documents that repeat give their rows each; items that
repeat are matched each; rows without doc_id or item_id are matched too; empty tables give an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, freed, lower, prefix_hashes, small_batches, stretch, table, texts

Q, ERROR = 12, 0.06
#: q-grams of items that are sent to the tasks at once (24 bytes each and a 4 MB bitmap).
BLOCK_GRAMS = 1 << 21
_BITS = 22
#: Pairs of a place of the text and a place of an item that are multiplied out at once; bytes of a window of a text with more of them.
ENTRIES, WINDOW = 1 << 20, 1 << 14


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased rows with white space collapsed and stripped."""
    blank = SPACE[data]
    keep = ~blank
    start = np.zeros(len(data) + 1, bool)
    start[offsets] = True
    # a blank stays if the byte before is solid and of the same row, and a solid byte of the row follows
    after = np.flatnonzero(keep & ~start[:-1] & np.concatenate(([False], blank[:-1])))
    single = np.zeros(len(data), bool)
    single[after - 1] = True
    solid_before = np.concatenate(([0], np.cumsum(keep)))
    row = np.searchsorted(offsets, after - 1, "right") - 1
    single[after - 1] = solid_before[after - 1] > solid_before[offsets[row]]
    out = lower(data)
    out[blank] = 32
    kept = keep | single
    return out[kept], np.concatenate(([0], np.cumsum(kept)))[offsets]


def budget(m: int, q: int = Q, error: float = ERROR) -> int:
    return max(0, min(int(error * m), (m - q) // q))


class Items:
    """The q-grams of a block of items, sorted, with the items and positions that hold them."""

    def __init__(self, items: list[tuple[int, bytes]], q: int, error: float):
        self.q, self.ids, self.bytes = q, [i for i, _ in items], [t for _, t in items]
        self.short = [k for k, t in enumerate(self.bytes) if 0 < len(t) < q]
        data = np.frombuffer(b"".join(self.bytes), np.uint8)
        ends = np.cumsum([0] + [len(t) for t in self.bytes])
        h = prefix_hashes(data)
        at = [np.arange(len(t) - q + 1) for t in self.bytes if len(t) >= q]
        own = [np.full(len(t) - q + 1, k) for k, t in enumerate(self.bytes) if len(t) >= q]
        at, own = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, own))
        codes = stretch(h, ends[own] + at, ends[own] + at + q)
        order = np.argsort(codes, kind="stable")
        self.item, self.at = own[order], at[order]
        self.codes, self.first, self.count = np.unique(codes[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.codes >> np.uint64(64 - _BITS)] = True
        self.size = np.array([len(t) for t in self.bytes], np.int64)
        self.k = np.array([budget(len(t), q, error) for t in self.bytes], np.int64)
        self.bound = self.size - q + 1 - self.k * q


def banded(item: np.ndarray, text: np.ndarray, diagonal: int, width: int, most: int) -> tuple[int, int]:
    """The fewest edits that turn item into some stretch of text near the diagonal, and where the stretch ends; most + 1 if more."""
    offsets = np.arange(-width, width + 1)
    # cost[d]: item[:i] against text ending before column i + diagonal + d, free to start anywhere
    columns = diagonal + offsets
    far = most + 1
    cost = np.where((columns >= 0) & (columns <= len(text)), 0, far)
    for i in range(1, len(item) + 1):
        columns = i + diagonal + offsets
        inside = (columns >= 1) & (columns <= len(text))
        other = text[np.clip(columns - 1, 0, max(0, len(text) - 1))] if len(text) else np.zeros(len(columns), np.uint8)
        new = np.where(inside, cost + (other != item[i - 1]), far)
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)  # the item's byte is left out
        new = np.where((columns >= 0) & (columns <= len(text)), new, far)
        new = np.minimum.accumulate(new - offsets) + offsets  # bytes of the text are left out
        cost = np.minimum(np.where((columns >= 0) & (columns <= len(text)), new, far), far)
        if cost.min() >= far:
            return far, -1
    best = int(cost.argmin())
    return int(cost[best]), int(len(item) + diagonal + offsets[best])


def shared_grams(items: Items, text: np.ndarray, h: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text whose q-gram is one of the items', and its number there."""
    at = np.arange(base, base + len(text) - items.q + 1)
    codes = stretch(h, at, at + items.q)
    where = np.flatnonzero(items.seen[codes >> np.uint64(64 - _BITS)])
    slot = np.minimum(np.searchsorted(items.codes, codes[where]), len(items.codes) - 1)
    same = items.codes[slot] == codes[where]
    return where[same], slot[same]


def unique_rows(*columns: np.ndarray) -> list[np.ndarray]:
    """The distinct rows of columns of small numbers from 0, sorted."""
    sizes = [int(c.max()) + 1 if len(c) else 1 for c in columns]
    if math.prod(sizes) < 1 << 62:
        key = columns[0].astype(np.int64)
        for c, size in zip(columns[1:], sizes[1:], strict=True):
            key = key * size + c
        key, out = np.unique(key), []
        for size in sizes[:0:-1]:
            key, last = np.divmod(key, size)
            out.append(last)
        return [key, *out[::-1]]
    return list(np.unique(np.stack(columns, 1), axis=0).T)


def full_bands(items: Items, where: np.ndarray, slot: np.ndarray):
    """(item, band, how many of the item's q-grams the band shares) of the bands that reach the item's bound. Shared places are
    multiplied out ENTRIES at a time; a q-gram of the item counts once in a band, however often the band holds it."""
    times = items.count[slot]
    ends = np.cumsum(times)
    kept, at = [np.zeros(0, np.int64)] * 3, 0
    while at < len(where):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENTRIES, "right")))
        own = times[at:to]
        step = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        entry = np.repeat(items.first[slot[at:to]], own) + step
        item = items.item[entry]
        diagonal = np.repeat(where[at:to], own) - items.at[entry]
        # bands of width 4k + 2 that overlap by half hold any 2k + 1 neighbouring diagonals; band numbers are made positive
        half = 2 * items.k[item] + 1
        band = diagonal // half + items.size[item] // half + 2
        new = [np.concatenate((item, item)), np.concatenate((band, band - 1)), np.concatenate((items.at[entry],) * 2)]
        kept = unique_rows(*(np.concatenate((a, b)) for a, b in zip(kept, new, strict=True)))
        at = to
    item, band, _ = kept
    if not len(item):
        return
    first = np.flatnonzero(np.concatenate(([True], (np.diff(item) != 0) | (np.diff(band) != 0))))
    count = np.diff(np.concatenate((first, [len(item)])))
    own = count >= items.bound[item[first]]
    for k, b, c in zip(item[first][own].tolist(), band[first][own].tolist(), count[own].tolist(), strict=True):
        yield k, b - int(items.size[k]) // (2 * int(items.k[k]) + 1) - 2, c


def find(items: Items, text: np.ndarray, h: np.ndarray, base: int) -> dict[int, tuple[int, int]]:
    """{item: (edits, end)} for one normalised text, whose bytes start at base of the buffer that h belongs to."""
    out: dict[int, tuple[int, int]] = {}
    if len(text) >= items.q and len(items.codes):
        where, slot = shared_grams(items, text, h, base)
        if len(where) and int(items.count[slot].sum()) > ENTRIES and len(text) > 2 * (wide := window(items)):
            _find_in_windows(items, text, h, base, wide, out)
        elif len(where):
            _find_in(items, text, where, slot, out)
    for k in items.short:
        blank = b" " + text.tobytes() + b" "
        if (found := blank.find(b" " + items.bytes[k] + b" ")) >= 0:
            out[k] = (0, found + len(items.bytes[k]))
    return out


def _find_in(items: Items, text: np.ndarray, where: np.ndarray, slot: np.ndarray, out: dict[int, tuple[int, int]]) -> None:
    known = set()  # stretches that were aligned with an item before
    for k, b, count in full_bands(items, where, slot):
        most = min(int(items.k[k]), out[k][0] - 1 if k in out else int(items.k[k]))
        # fewer edits than found so far leave more q-grams whole
        if most < 0 or count < int(items.size[k]) - items.q + 1 - most * items.q:
            continue
        width = 2 * int(items.k[k]) + 1
        first, last = b * width - most, b * width + 2 * width + most + int(items.size[k])
        if first >= 0 and last <= len(text):
            stretch_ = (k, most, text[first:last].tobytes())
            if stretch_ in known:
                continue
            known.add(stretch_)
        edits, end = banded(np.frombuffer(items.bytes[k], np.uint8), text, b * width + width, width + most, most)
        if edits <= most:
            out[k] = (edits, end)


def window(items: Items) -> int:
    """Bytes of a stretch of text that holds any item with its edits, and more."""
    return max(WINDOW, 4 * int((items.size + items.k).max()))


def _find_in_windows(items: Items, text: np.ndarray, h: np.ndarray, base: int, wide: int, out: dict[int, tuple[int, int]]) -> None:
    """A text that shares very many q-grams with items repeats itself: it is read in windows that overlap by the longest item's length,
    and windows with the same bytes are read once."""
    step, known = wide - int((items.size + items.k).max()) - 1, {}
    for at in range(0, len(text), step):
        own = text[at : at + wide]
        if len(own) < items.q:
            break
        name = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
        if name in known:
            continue  # the same items, with as many edits, further on
        known[name] = found = {}
        _find_in(items, own, *shared_grams(items, own, h, base + at), found)
        for k, (edits, end) in found.items():
            if k not in out or edits < out[k][0]:
                out[k] = (edits, at + end)


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, error: float = ERROR) -> DataFrame:
    """(doc_id, item_id, edits, end_byte): each item found in each document, with its fewest edits; end_byte in the normalised text."""
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item_text")).where("item_text is not null")
    grams = bench.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    blocks = max(1, -(-4 * grams // (3 * BLOCK_GRAMS)))
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("end_byte", pa.int64())])
    out = None
    for block in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == block).orderBy("item_id", "item_text").collect()
        flat, ends = normalise(np.frombuffer(b"".join(r["item_text"].encode() for r in rows), np.uint8), np.cumsum([0] + [len(r["item_text"].encode()) for r in rows]))
        shared = spark.sparkContext.broadcast([(r["item_id"], flat[a:b].tobytes()) for r, a, b in zip(rows, ends, ends[1:], strict=False)])

        def run(batches, shared=shared):
            items = Items(shared.value, q, error)
            for batch in batches:
                docs_, rows_ = batch.column(0).to_pylist(), []
                for first, data, offsets in texts(batch.column(1)):
                    data, offsets = normalise(data, offsets)
                    h = prefix_hashes(data)
                    for k in range(len(offsets) - 1):
                        for item, (edits, end) in find(items, data[offsets[k] : offsets[k + 1]], h, int(offsets[k])).items():
                            rows_.append((docs_[first + k], items.ids[item], edits, end))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_, strict=True) if rows_ else [[]] * 4, schema, strict=True)], schema=schema)

        one = own.mapInArrow(freed(run), "doc_id long, item_id long, edits int, end_byte long")
        out = one if out is None else out.unionByName(one)
    return out


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
