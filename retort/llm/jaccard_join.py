"""N-gram Jaccard join: all documents whose sets of word shingles reach a Jaccard similarity, as components.

Inverted lists are kept of the first shingles of each set: any pair that reaches the threshold t shares one of them, if a set's first
n - ceil(t * n) + 1 shingles in one common order are looked at; frequent shingles come last in that order. Where a list is
read, its members' sizes and parity bitmaps rule out the pairs with too many differences; this bound is exact, so what leaves
the lists is in proportion to the links. A list of more than LIST_BLOCK members is read block by block.

What is left is decided by T-occurrence search with DivideSkip: the sets that a query set meets are indexed by shingle; the query's
inverted lists are divided into long and short ones, the short ones are merged with a heap, and sets that occur often enough there are
looked up in the long ones by binary search; those that reach the required overlap are linked.

Large groups are met in rounds, as only components are wanted: each member of a list first meets the first member before it that it may link
with, then the last such member of another component, then all members of other components. So no link between two components is left out. In
the first two rounds a member is compared until a partner is found, and a large list's blocks meet its first block only; in the last one
members of a list's largest component aren't compared with each other. So comparisons and rows within a group of near copies stay in proportion to its size.

Equal sets are one node throughout. Nodes are told apart by a 63-bit hash of the set with its size, shingles by 64-bit
hashes.

Defined cases: null or empty text and text without words give the empty set, which links with nothing; a text of
fewer words than a shingle has its whole word sequence as its one shingle; rows that repeat are equal sets; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, mix, partitions, small_batches, stored, table, texts, word_hashes

WORDS, PERCENT = 5, 80
#: The shingles that come last in the order: those met at least FREQUENT times by the counts below, the most frequent
#: 2^20 at most (16 MB). A count leaves out what a run of COUNTED shingles holds only once. This orders the shingles, no more.
FREQUENT, MOST_FREQUENT, COUNTED = 8, 1 << 20, 1 << 19
#: Candidate sets that one query meets in one block.
BLOCK = 256
#: Bits of a set's parity bitmap; and rows (16 bytes each) up to which a table of documents to read again is broadcast.
LEAST_BITS, MOST_BITS, BROADCAST_ROWS = 512, 32768, 1 << 20
#: Members of a list that one task reads together; and bytes of bitmaps that are compared at once.
LIST_BLOCK, STEP_BYTES, STRAYS = 2048, 1 << 22, 1 << 24
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, words: int = WORDS):
    """Yields (row, sorted distinct 64-bit shingles) for each row with words."""
    for first, data, offsets in texts(column):
        hashes, rows = word_hashes(data, offsets)
        n = len(hashes)
        if n >= words:
            rolled = hashes[: n - words + 1] * _FACTORS[0]
            for j in range(1, words):
                rolled = mix(rolled) + hashes[j : n - words + 1 + j] * _FACTORS[j]
            rolled = mix(rolled)
        for k in range(len(rows) - 1):
            a, b = rows[k], rows[k + 1]
            if b - a >= words:
                yield first + k, np.unique(rolled[a : b - words + 1])
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for h in hashes[a:b]:
                    one = mix(one * _FACTORS[63] + h)
                yield first + k, one


def signature(own: np.ndarray) -> int:
    return int(mix(np.array([mix(own).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))[0] >> np.uint64(1))


def first_shingles(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def document_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, node): the set size and the set's node, null for the empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64())])

    def run(batches):
        for batch in batches:
            n, node = [0] * batch.num_rows, [None] * batch.num_rows
            for i, own in shingle_sets(batch.column(1), words):
                n[i], node[i] = len(own), signature(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(run), "doc_id long, n_shingles long, node long")


def frequent_shingles(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that come last in the order, sorted, and their counts; at most MOST_FREQUENT."""
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def counted(parts):
        own, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(own[n > 1]), pa.array(n[n > 1], pa.int64())], schema=schema)

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for _, own in shingle_sets(batch.column(0), words):
                parts.append(own)
                size += len(own)
                if size >= COUNTED:
                    yield counted(parts)
                    parts, size = [], 0
        if parts:
            yield counted(parts)

    counts = docs.select(F.col("text").cast("string")).mapInArrow(freed(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    counts = stored(counts, "shingle-counts")
    sizes = sorted((r["size"], r["shingles"]) for r in counts.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count(F.lit(1)).alias("shingles")).collect())
    while sizes and sum(n for _, n in sizes) > MOST_FREQUENT:
        sizes.pop(0)
    if not sizes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counts.where(F.floor(F.log2("n")) >= sizes[0][0]).toArrow()
    shingles, n = top.column("shingle").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def postings(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(shingle, size, node): the first shingles of each set in the common order, rare ones first, then by hash."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))
    schema = pa.schema([("shingle", pa.int64()), ("size", pa.int32()), ("node", pa.int64())])

    def run(batches):
        often, counts = shared.value
        met: set[int] = set()  # equal sets of one task are sent once
        for batch in batches:
            parts, sizes, nodes = [], [], []
            for _, own in shingle_sets(batch.column(0), words):
                if (node := signature(own)) in met:
                    continue
                if len(met) < 1 << 16:
                    met.add(node)
                rank = np.zeros(len(own), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    rank = np.where(often[at] == own, counts[at], 0)
                take = first_shingles(len(own), percent)
                parts.append(own[np.argsort(rank, kind="stable")[:take]])
                sizes.append(len(own))
                nodes.append(node)
            if parts:
                n = np.array([len(p) for p in parts])
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(parts)), pa.array(np.repeat(np.array(sizes, np.int32), n)), pa.array(np.repeat(np.array(nodes, np.int64), n))], schema=schema)

    return docs.select(F.col("text").cast("string")).mapInArrow(freed(run), "shingle long, size int, node long")


def shared_lists(posted: DataFrame) -> DataFrame:
    """(list, node, place): lists of at least two nodes, and each node's place in its list by size. Of lists with the same members one
    is kept: near copies share most of theirs."""
    schema = pa.schema([("list", pa.int64()), ("more", pa.int64()), ("start", pa.int32()), ("nodes", pa.list_(pa.int64()))])

    def run(batches):
        shingle, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            shingle, node = (np.concatenate((x, batch.column(c).to_numpy())) for x, c in ((shingle, 0), (node, 2)))
            # the last list may go on
            open_ = int(np.searchsorted(shingle, shingle[-1])) if len(shingle) else 0
            yield sent(shingle[:open_], node[:open_])
            shingle, node = shingle[open_:], node[open_:]
        yield sent(shingle, node)

    def sent(shingle, node):
        new = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])))[: len(shingle)]
        shingle, node = shingle[new], node[new]
        first = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))[: len(shingle)]
        length = np.diff(np.append(first, len(shingle)))
        keep = np.repeat(length > 1, length)
        shingle, node = shingle[keep], node[keep]
        place = (np.arange(len(keep)) - np.repeat(first, length))[keep]
        length = np.repeat(length, length)[keep]
        first = np.flatnonzero(place % LIST_BLOCK == 0)  # long lists are several rows
        if not len(first):
            return pa.RecordBatch.from_pylist([], schema=schema)
        members = node.view(np.uint64)
        of = np.stack([np.add.reduceat(mix(members ^ np.uint64(salt)), first) for salt in (0, 0x5DEECE66D)]).view(np.int64)
        long = length[first] > LIST_BLOCK
        one, two = np.where(long, shingle[first], of[0]), np.where(long, -1, of[1])
        nodes = pa.ListArray.from_arrays(pa.array(np.append(first, len(node)).astype(np.int32)), pa.array(node))
        return pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(place[first].astype(np.int32)), nodes], schema=schema)

    n = partitions(posted.sparkSession)
    rows = posted.repartition(n, "shingle").sortWithinPartitions("shingle", "size", "node").mapInArrow(freed(run), "list long, more long, start int, nodes array<long>")
    return rows.dropDuplicates(["list", "more", "start"]).select("list", "start", F.posexplode("nodes").alias("pos", "node")).select("list", "node", (F.col("start") + F.col("pos")).alias("place"))


def divide_skip(owners: np.ndarray, starts: np.ndarray, ends: np.ndarray, need: np.ndarray, skew: float = 0.01) -> np.ndarray:
    """The ids i that occur in at least need[i] of the lists, need[i] >= 1. List k is owners[starts[k]:ends[k]], sorted."""
    length = ends - starts
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    least = int(need.min()) if len(need) else 1
    if len(order) < least:
        return np.zeros(0, np.int64)
    n_long = min(least - 1, int(least / (skew * np.log2(max(2, int(length[order[-1]]))) + 1)))
    short, long = order[: len(order) - n_long], order[len(order) - n_long :]
    heap = [(int(owners[starts[k]]), int(starts[k]), int(ends[k])) for k in short]
    heapq.heapify(heap)
    ids, counts = [], []
    while heap:
        top, n = heap[0][0], 0
        while heap and heap[0][0] == top:
            _, at, end = heap[0]
            n += 1
            if at + 1 < end:
                heapq.heapreplace(heap, (int(owners[at + 1]), at + 1, end))
            else:
                heapq.heappop(heap)
        if n >= need[top] - n_long:
            ids.append(top)
            counts.append(n)
    found, n = np.array(ids, np.int64), np.array(counts, np.int64)
    low, high = np.repeat(starts[long], len(found)), np.repeat(ends[long], len(found))
    wanted, end = np.tile(found, len(long)), high
    while (low < high).any():  # all binary searches in step
        middle = (low + high) // 2
        less = (low < high) & (owners[np.minimum(middle, len(owners) - 1)] < wanted)
        low, high = np.where(less, middle + 1, low), np.where(less | (low >= high), high, middle)
    hit = (low < end) & (owners[np.minimum(low, len(owners) - 1)] == wanted)
    n = n + hit.reshape(len(long), len(found)).sum(0)
    return found[n >= need[found]] if len(found) else found


class ShingleIndex:
    """Inverted lists of a block of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        values, self.owners = values[order], owners[order]
        self.first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        self.keys, self.ends = values[self.first], np.append(self.first[1:], len(values))

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """The sets that link with the query set. 100 * i >= p * (a + b - i) for an overlap of i."""
        need = np.maximum(1, -(-percent * (self.sizes + len(query)) // (100 + percent)))
        need = np.where(need <= np.minimum(self.sizes, len(query)), need, len(query) + 1)
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        return divide_skip(self.owners, self.first[at], self.ends[at], need)


def parity_bits(own: np.ndarray) -> bytes:
    """The parity of the number of shingles that fall on each bit; three to six bits for each shingle. Two sets differ in at least as many
    shingles as their bits, folded to the same length, differ."""
    n = min(MOST_BITS, max(LEAST_BITS, 4 << int(np.ceil(np.log2(max(1.0, 0.75 * len(own)))))))
    return np.packbits((np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8), bitorder="little").tobytes()


class Bitmaps:
    """The parity bitmaps of many sets, a matrix of 64-bit words for each length, and the same folded once."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)
        self.length, self.at, self.whole, self.folded = np.diff(offsets), np.zeros(len(column), np.int64), {}, {}
        for size in np.unique(self.length):
            rows = np.flatnonzero(self.length == size)
            self.at[rows] = np.arange(len(rows))
            m = data[offsets[rows][:, None] + np.arange(size)]
            self.whole[int(size)] = m.view(np.uint64)
            self.folded[int(size)] = np.ascontiguousarray(m[:, : size // 2] ^ m[:, size // 2 :]).view(np.uint64) if size > LEAST_BITS // 8 else None

    def fewest_differences(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of sets whose bitmaps are equally long, or those of j twice as long as those of i."""
        out = np.zeros(len(i), np.int64)
        for size in self.whole:
            own = np.flatnonzero(self.length[i] == size)
            for m, part in ((self.whole[size], own[self.length[j[own]] == size]), (self.folded.get(2 * size), own[self.length[j[own]] == 2 * size])):
                if len(part):
                    out[part] = np.bitwise_count(self.whole[size][self.at[i[part]]] ^ m[self.at[j[part]]]).sum(1)
        return out


def list_rows(lists: DataFrame, bits: DataFrame, labels: DataFrame | None, which: str = "all") -> DataFrame:
    """(list, one, two, part, size, node, label, bits) of the lists whose members are not all in one component. Lists of several blocks are dealt as pairs of
    blocks (one, two), with no more rows than are needed: where a member needs but one partner, each block meets the first one; where all are wanted, the
    members of the list's largest component need not meet each other, and the others are dealt into blocks of their own, numbered from STRAYS."""
    own = lists
    if labels is None:
        own = own.withColumn("label", F.col("node"))
    else:
        own = own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        own = stored(own, "labelled-lists")
        own = own.join(own.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("list"), "list", "left_semi")
    own = own.withColumn("part", (F.col("place") / LIST_BLOCK).cast("int"))
    blocks = lists.where(F.col("place") >= LIST_BLOCK).groupBy("list").agg((F.max("place") / LIST_BLOCK).cast("int").alias("last"))
    own = own.join(blocks, "list", "left")
    one = own.where("last is null").select("list", F.lit(0).alias("one"), F.lit(0).alias("two"), "part", "node", "label")
    many = own.where("last is not null")
    if which != "all":
        partners = F.when(F.col("part") == 0, F.sequence(F.lit(0), F.col("last"))).otherwise(F.array("part"))
        many = many.withColumn("two", F.explode(partners)).select("list", F.lit(0).alias("one"), "two", "part", "node", "label")
    else:
        tops = many.groupBy("list", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("list").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
        tops = tops.select("list", F.col("top.label").alias("top"), F.ceil((F.col("n") - F.col("top.n")) * 2 / LIST_BLOCK).cast("int").alias("strays"))
        many = many.join(tops, "list")
        stay = many.where("label = top").withColumn("two", F.explode(F.expr(f"sequence({STRAYS}, {STRAYS} + strays - 1)"))).select("list", F.col("part").alias("one"), "two", "part", "node", "label")
        stray = many.where("label <> top").withColumn("part", (F.pmod(F.xxhash64("node"), F.col("strays")) + STRAYS).cast("int"))
        # a block of strays meets the blocks of those that stay, and the blocks of strays
        groups = F.expr(f"concat(transform(sequence(0, last), k -> struct(k as one, part as two)), transform(sequence({STRAYS}, {STRAYS} + strays - 1), k -> struct(least(k, part) as one, greatest(k, part) as two)))")
        stray = stray.withColumn("g", F.explode(groups)).select("list", "g.one", "g.two", "part", "node", "label")
        many = stray.unionByName(stay)
    return one.unionByName(many).join(bits, "node").select("list", "one", "two", "part", "size", "node", "label", "bits")


class Compared:
    """Counts the pairs whose bitmaps were compared."""

    pairs = 0


def met(t: pa.Table, which: str, percent: int, compared: Compared):
    """Batches of (query, node) for the rows of some lists, sorted by list and size: the pairs of two components that sizes and bitmaps do not rule
    out, or of each row the first or last of its pairs only. Then a row is compared until one pair is found, with few rows at first."""
    schema = pa.schema([("query", pa.int64()), ("node", pa.int64())])
    list_, one, two, part, size, node, label = (t.column(i).to_numpy() for i in range(7))
    size = size.astype(np.int64)
    new = (list_[1:] != list_[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    group = np.concatenate(([0], np.cumsum(new))) << 32
    start = np.searchsorted(group + size, group - (-percent * size // 100))
    bitmaps = Bitmaps(t.column(7).combine_chunks())

    def fitting(rows: np.ndarray, low: np.ndarray, n: np.ndarray):
        """The pairs of each row with n rows from low on, of other components and not ruled out; so many at once as STEP_BYTES of bitmaps allow."""
        ends = np.cumsum(n * bitmaps.length[rows])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_BYTES, "right")))
            own = n[at:to]
            j = np.repeat(rows[at:to], own)
            i = np.repeat(low[at:to] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            # in a pair of blocks a block's own pairs belong to another task; where each block meets the first one, only that one's do
            apart = (part[i] != part[j]) if which == "all" else (part[i] != one[j]) | (part[j] != one[j])
            keep = (label[i] != label[j]) & ((one[j] == two[j]) | apart)
            i, j = i[keep], j[keep]
            compared.pairs += len(i)
            both = size[i] + size[j]
            # an overlap of o needs 100 * o >= percent * (a + b - o); the sets then differ in a + b - 2 * o shingles
            keep = bitmaps.fewest_differences(i, j) <= both + 2 * (-percent * both // (100 + percent))
            yield i[keep], j[keep]
            at = to

    rows = np.arange(len(size))
    rows = rows[rows > start]
    if which == "all":
        for i, j in fitting(rows, start[rows], rows - start[rows]):
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], schema=schema)
        return
    done, width = np.zeros(len(size), np.int64), 2
    while len(rows):
        n = np.minimum(width, rows - start[rows] - done[rows])
        low = start[rows] + done[rows] if which == "first" else rows - done[rows] - n
        open_ = np.ones(len(size), bool)
        for i, j in fitting(rows, low, n):
            if len(j):
                edge = np.flatnonzero(np.concatenate(([True], j[1:] != j[:-1])) if which == "first" else np.concatenate((j[1:] != j[:-1], [True])))
                open_[j[edge]] = False
                yield pa.RecordBatch.from_arrays([pa.array(node[i[edge]]), pa.array(node[j[edge]])], schema=schema)
        done[rows] += n
        rows = rows[open_[rows] & (done[rows] < rows - start[rows])]
        width *= 2


def may_link(rows: DataFrame, which: str, percent: int) -> DataFrame:
    """(query, node) of members of one list and two components that sizes and bitmaps do not rule out: of each node with members before it in the
    order of sizes, the first or the last of these, or all."""

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            keys = [t.column(i).to_numpy() for i in range(3)]
            done = int(np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))[-1]) + 1 if any((k != k[-1]).any() for k in keys) else 0
            if done:
                yield from met(t.slice(0, done).combine_chunks(), which, percent, Compared())
            rest = t.slice(done).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from met(rest, which, percent, Compared())

    n = partitions(rows.sparkSession)
    dealt = rows.repartition(n, "list", "one", "two").sortWithinPartitions("list", "one", "two", "size", "node")
    return dealt.mapInArrow(freed(run), "query long, node long").distinct()


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (query, node) of pairs that reach the similarity; in blocks of about BLOCK nodes a query."""
    schema = pa.schema([("query", pa.int64()), ("node", pa.int64())])
    n = partitions(pairs.sparkSession)
    blocks = pairs.groupBy("query").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, "query").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    members = dealt.join(sets, "node").select("query", "block", F.lit(1).alias("role"), "node", "shingles")
    queries = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    queries = queries.join(sets.withColumnRenamed("node", "query"), "query").select("query", "block", F.lit(0).alias("role"), F.col("query").alias("node"), "shingles")

    def run(batches):
        query, block, own, nodes, sets_ = None, None, None, [], []

        def decided():
            hits = ShingleIndex(sets_).search(own, percent) if sets_ else []
            return pa.RecordBatch.from_arrays([pa.array([query] * len(hits), pa.int64()), pa.array([nodes[i] for i in hits], pa.int64())], schema=schema)

        for batch in batches:
            q, b, role, node = (batch.column(i).to_numpy() for i in range(4))
            lists = batch.column(4)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for i in range(len(q)):
                shingles = values[offsets[i] : offsets[i + 1]]
                if role[i] == 0:
                    if query is not None:
                        yield decided()
                    query, block, own, nodes, sets_ = int(q[i]), int(b[i]), shingles, [], []
                else:
                    assert (q[i], b[i]) == (query, block)
                    nodes.append(int(node[i]))
                    sets_.append(shingles)
        if query is not None:
            yield decided()

    both = queries.unionByName(members).repartition(n, "query", "block").sortWithinPartitions("query", "block", "role")
    return both.mapInArrow(freed(run), "query long, node long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (a, b): the label is the smallest node of the connected component. Large-star
    and small-star steps in turn; each node's links then shrink to one, and no step gathers a node's links in a row."""
    own = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("e"))
        new = stored(small.select(F.col("e.b").alias("a"), F.col("e.low").alias("b")).where("a <> b").distinct(), "edges")
        if not own.exceptAll(new).limit(1).count() and not new.exceptAll(own).limit(1).count():
            break
        own = new
    return own.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(own.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def node_documents(docs: DataFrame, doc_sets: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, text) of the given nodes, the text of one document of each; where no row of a node has a doc_id, it is found by its signature."""
    one = stored(doc_sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("one_doc")), "node-documents")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = own.join(F.broadcast(one) if one.count() <= BROADCAST_ROWS else one, own["doc_id"] == one["one_doc"]).select("node", "text")

    def run(batches):
        for batch in batches:
            found = [(int(signature(s)), i) for i, s in shingle_sets(batch.column(0), words)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), batch.column(0).take(pa.array([i for _, i in found], pa.int64()))], names=["node", "text"])

    unnamed = own.where("doc_id is null").select("text").mapInArrow(freed(run), "node long, text string")
    return named.unionByName(unnamed.join(one.where("one_doc is null").select("node"), "node", "left_semi").dropDuplicates(["node"]))


def node_bits(texts_: DataFrame, words: int) -> DataFrame:
    """(node, size, bits) of (node, text)."""
    schema = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("bits", pa.binary())])

    def run(batches):
        for batch in batches:
            node = batch.column(0).to_numpy()
            got = [(int(node[i]), len(s), parity_bits(s)) for i, s in shingle_sets(batch.column(1), words) if signature(s) == node[i]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True) if got else [[]] * 3, schema, strict=True)], schema=schema)

    return texts_.mapInArrow(freed(run), "node long, size int, bits binary").dropDuplicates(["node"])


def node_sets(texts_: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of (node, text)."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            node = batch.column(0).to_numpy()
            got = [(int(node[i]), s) for i, s in shingle_sets(batch.column(1), words) if signature(s) == node[i]]
            flat = np.concatenate([s for _, s in got]).view(np.int64) if got else np.zeros(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(s) for _, s in got]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=schema)

    return texts_.mapInArrow(freed(run), "node long, shingles array<long>")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id that links lead to."""
    small_batches(docs.sparkSession)
    doc_sets = stored(document_sets(docs, words), "document-sets")
    lists = stored(shared_lists(postings(docs, words, percent)), "shared-lists")
    bits = stored(node_bits(node_documents(docs, doc_sets, lists.select("node"), words), words), "node-bits")
    labels = None
    for which in ("first", "last", "all"):
        pairs = stored(may_link(list_rows(lists, bits, labels, which), which, percent), "pairs")
        if not pairs.limit(1).count():
            break
        nodes = pairs.select("node").unionByName(pairs.select(F.col("query").alias("node")))
        sets = stored(node_sets(node_documents(docs, doc_sets, nodes, words), words), "node-sets")
        edges = linked(pairs, sets, percent).select(F.col("query").alias("a"), F.col("node").alias("b"))
        if labels is not None:
            edges = edges.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = stored(components(edges), "labels")
    own = doc_sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low_doc"))
    if labels is None:
        own = own.select("node", F.col("low_doc").alias("component_id"))
    else:
        own = own.join(labels, "node", "left").select("node", "low_doc", F.coalesce("label", "node").alias("label"))
        low = own.groupBy("label").agg(F.min("low_doc").alias("component_id"))
        own = own.join(low, "label").select("node", "component_id")
    out = doc_sets.join(own, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS own FROM split
), grams AS (SELECT doc_id, unnest(own) AS gram FROM sets
), shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * n >= 80 * (len(a.own) + len(b.own) - n)
), ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, w.y FROM reach r JOIN ways w ON w.x = r.other)
SELECT s.doc_id, len(s.own) AS n_shingles, min(r.other) AS component_id FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.own
"""
