"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the words of a text with A-Z lower-cased, then one end symbol. A symbol's number is its own for the most
frequent words (OWN at most) and one of CLASSES hash classes for all others, so that a position's context and symbol fit one
long; within a class a word has the share of its count, and all words that training has not seen are one further word.

The tree grows from the root: a context (the last word; then the last two) is a state if its suffix is one, training holds it LEAST_COUNT
times at least, and its next symbols diverge from its suffix's prediction: count * KL divergence of at least GAIN nats for each
distinct next symbol. A state's distribution is smoothed with its suffix's by as many pseudo-counts as it has distinct
next symbols (Witten-Bell), down to the root's add-one unigrams. Each symbol is scored by the longest state that its past
ends with. The number of states follows the corpus: nothing but these tests limits it.

Jobs: words are counted exactly; then every position of every text (context, symbol, row) goes to the bucket of
its last context word, where that part of the tree is built from the training positions and scores all positions; sums a row come
back. Last words and word pairs that are too frequent for one bucket are dealt over several, to which their
next-symbol counts, summed before by themselves, are sent along.

The unigram base score counts words and one end token a text. Counts of the MOST_WORDS most frequent words go to every task;
the others' meet their words in a join. Words are told apart by 64-bit hashes.

Defined cases: null text is an empty one; an empty text is its end token; rows that repeat are counted and scored each;
without training texts every token has base probability 1 / (V + 1) with V = 0 and the tree is its root; an empty table gives an
empty result; other columns, whatever their names, are not read. docs is read several times and must give the same rows each time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket, mix, partitions, small_batches, stored, table, texts, word_hashes

LEAST_COUNT, GAIN = 2, 0.5
#: Bits of a symbol's number; number 0 is what stands before a text, then come OWN words and CLASSES classes.
BITS, CLASSES = 16, 1 << 12
MOST_WORDS = 1 << 20
#: Distinct codes that a task counts before it sends them; rows whose sums it holds.
HELD = 1 << 18
BUCKETS_A_PARTITION = 4
END_TOKEN = np.uint64(0x454E44)
_W, _MASK = np.uint64(BITS), np.uint64((1 << BITS) - 1)


class _Counts:
    """Sums counts of codes until they are many."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, codes: np.ndarray, n: np.ndarray | None = None) -> bool:
        """True when it is time to send."""
        self.parts.append(np.unique(codes, return_counts=True) if n is None else (codes, n))
        self.size += len(self.parts[-1][0])
        if self.size > 2 * HELD:
            self.merge()
        return self.size > HELD

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        codes, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(codes)
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
        codes, n = codes[first], np.add.reduceat(n, first) if len(first) else n
        self.parts, self.size = [(codes, n)], len(codes)
        return codes, n

    def sent(self, schema: pa.Schema) -> pa.RecordBatch:
        codes, n = self.merge()
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], schema=schema)


_COUNTED = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def _counted(docs: DataFrame, codes_of) -> DataFrame:
    """(code, n) of codes_of(data, offsets) over all texts, summed in the tasks first."""

    def run(batches):
        held = _Counts()
        for batch in batches:
            for _, data, offsets in texts(batch.column(0)):
                if held.add(codes_of(data, offsets)):
                    yield held.sent(_COUNTED)
        yield held.sent(_COUNTED)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' words, each row's end token behind them, and the rows' offsets."""
    hashes, rows = word_hashes(data, offsets)
    return np.insert(hashes, rows[1:], END_TOKEN), rows + np.arange(len(rows))


def vocabulary(training: DataFrame) -> DataFrame:
    """(code, n): words and end tokens by hash."""
    return _counted(training, lambda data, offsets: _tokens(data, offsets)[0])


class Symbols:
    """The numbers of words, the root's probabilities, and the share of words within classes."""

    def __init__(self, words: DataFrame, classes: int = CLASSES, own: int = (1 << BITS) - CLASSES - 1):
        """words: the stored table of vocabulary(); classes: a power of two."""
        self.classes, self.own = classes, own
        self.total, self.distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        bins = sorted((r["bin"], r["words"]) for r in words.groupBy(F.floor(16 * F.log2("n")).alias("bin")).agg(F.count(F.lit(1)).alias("words")).collect())
        while bins and sum(n for _, n in bins) > MOST_WORDS:
            bins.pop(0)
        often = words.where(F.floor(16 * F.log2("n")) >= bins[0][0]).toArrow() if bins else None
        code = often.column("code").to_numpy() if bins else np.zeros(0, np.int64)
        n = often.column("n").to_numpy() if bins else np.zeros(0, np.int64)
        rank = np.lexsort((code, -n))
        number = np.empty(len(code), np.int64)
        number[rank] = np.arange(len(code))
        self.least = int(n.min()) if len(n) else 0  # words from here on are known in every task
        # class sums of the words that have no number of their own
        classed = words
        if len(code) > own:
            last_n, last = int(n[rank[own - 1]]), int(code[rank[own - 1]])
            classed = words.where((F.col("n") < last_n) | (F.col("n") == last_n) & (F.col("code") > last))
        elif len(code):
            classed = words.where(F.col("n") < self.least)
        sums = classed.groupBy(F.pmod("code", F.lit(classes)).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
        self.weight = np.ones(classes)  # counts plus one for each word, and one for the unknown word
        of_class = np.zeros(classes, np.int64)
        for r in sums:
            self.weight[r["c"]] += r["n"] + r["words"]
            of_class[r["c"]] = r["n"]
        order = np.argsort(code.view(np.uint64))
        self.codes, self.n = code.view(np.uint64)[order], n[order]
        number = number[order]
        self.numbers = np.where(number < own, number + 1, own + 1 + (self.codes % np.uint64(classes)).astype(np.int64)).astype(np.uint16)
        self.count = np.zeros(own + 1 + classes, np.int64)  # positions of each number
        self.count[1 + np.arange(min(own, len(n)))] = n[rank[:own]]
        self.count[own + 1 :] = of_class
        root = self.count + 1.0
        root[own + 1 :] = self.weight
        self.root = root / (self.total + self.distinct + classes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, count or 0, whether the count is known here) of each word."""
        own, back = np.unique(hashes, return_inverse=True)
        classed = (self.own + 1 + (own % np.uint64(self.classes)).astype(np.int64)).astype(np.uint16)
        if not len(self.codes):
            return classed[back], np.zeros(len(back), np.int64), np.zeros(len(back), bool)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        return np.where(known, self.numbers[at], classed)[back], np.where(known, self.n[at], 0)[back], known[back]

    def grams(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol the numbers of the two before it and its own, and the rows' offsets."""
        hashes, rows = _tokens(data, offsets)
        number = self.find(hashes)[0].astype(np.uint64)
        one = np.concatenate(([0], number[:-1])).astype(np.uint64)
        one[rows[:-1]] = 0
        two = np.concatenate(([0], one[:-1])).astype(np.uint64)
        two[rows[:-1]] = 0
        return (two << (_W + _W)) | (one << _W) | number, rows


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, back = np.unique(keys, return_inverse=True)
    return own, np.bincount(back, n, len(own))


def _level(codes: np.ndarray, n: np.ndarray, up: np.ndarray, allowed: np.ndarray, least: float, gain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of the sorted codes whose contexts are codes >> BITS, given their suffix's; the contexts, and which of them are states."""
    context, back = np.unique(codes >> _W, return_inverse=True)
    total, distinct = np.bincount(back, n, len(context)), np.bincount(back, n > 0, len(context))
    seen = n > 0
    kl = np.bincount(back[seen], n[seen] * np.log(n[seen] / total[back[seen]] / up[seen]), len(context))
    state = (total >= least) & (kl >= gain * distinct) & (total > 0)
    state &= np.bincount(back, allowed, len(context)) > 0
    s = state[back]
    p = np.where(s, (n + distinct[back] * up) / np.maximum(1, total + distinct)[back], up)
    return p, context, state


def scored_codes(codes: np.ndarray, n: np.ndarray, root: np.ndarray, parents=None, least: float = LEAST_COUNT, gain: float = GAIN) -> np.ndarray:
    """The probability of each of the sorted distinct codes by its longest state. n: training counts, those of all codes of the bucket's last words but
    for the ones in parents: {1: (codes of two numbers, n), 2: (codes of three, n)}, whose counts are these instead."""
    low = np.uint64((1 << 2 * BITS) - 1)
    pairs, n1 = _sums(codes & low, n)
    all_codes, n2 = codes, n.astype(float)
    if parents and len(parents[2][0]):
        hot = np.isin(codes >> _W, np.unique(parents[2][0] >> _W))
        all_codes, n2 = _sums(np.concatenate((codes, parents[2][0])), np.concatenate((np.where(hot, 0, n), parents[2][1])))
    if parents and len(parents[1][0]):
        hot = np.isin(pairs >> _W, np.unique(parents[1][0] >> _W))
        pairs, n1 = _sums(np.concatenate((pairs, parents[1][0])), np.concatenate((np.where(hot, 0, n1), parents[1][1])))
    extra = np.setdiff1d(all_codes & low, pairs)
    if len(extra):
        pairs, n1 = _sums(np.concatenate((pairs, extra)), np.concatenate((n1, np.zeros(len(extra)))))
    p1, words, states = _level(pairs, n1, root[(pairs & _MASK).astype(np.int64)], np.ones(len(pairs), bool), least, gain)
    at = np.searchsorted(pairs, all_codes & low)
    grown = states[np.searchsorted(words, (all_codes & low) >> _W)]
    p2, _, _ = _level(all_codes, n2, p1[at], grown, least, gain)
    return p2[np.searchsorted(all_codes, codes)]


class Dealing:
    """The buckets of last words and word pairs. hot_words: {number: buckets}, hot_pairs: {pair code: buckets}."""

    def __init__(self, buckets: int, hot_words: dict[int, int], hot_pairs: dict[int, int]):
        self.buckets = buckets
        self.words, self.pairs = hot_words, hot_pairs
        self._over = np.ones(1 << BITS, np.int64)
        for w, n in hot_words.items():
            self._over[w] = n
        self._pairs = np.array(sorted(hot_pairs), np.uint64)
        self._pair_over = np.array([hot_pairs[p] for p in sorted(hot_pairs)], np.int64)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (mix(key) % np.uint64(self.buckets)).astype(np.int64)

    def place(self, codes: np.ndarray, turn: int) -> np.ndarray:
        pair = codes >> _W
        word, before = pair & _MASK, pair >> _W
        out = self._home(word + np.uint64(1 << 40))
        over = self._over[word.astype(np.int64)]
        far = over > 1
        out[far] += (mix(before[far]) % over[far].astype(np.uint64)).astype(np.int64)
        if len(self._pairs):
            at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
            hot = np.flatnonzero(self._pairs[at] == pair)
            out[hot] = self._home(pair[hot]) + turn % self._pair_over[at[hot]]
        return out % self.buckets

    def homes(self) -> tuple[list[tuple[int, list[int]]], list[tuple[int, list[int]]]]:
        """(word, its buckets) and (pair, its buckets): where their counts are needed."""
        home = lambda key, n: {int(x) % self.buckets for x in self._home(np.array([key], np.uint64))[0] + np.arange(n)}
        of_pairs = {p: home(p, n) for p, n in self.pairs.items()}
        of_words = {w: home(w + (1 << 40), n) for w, n in self.words.items()}
        for p, b in of_pairs.items():
            of_words[p & ((1 << BITS) - 1)] |= b
        return [(w, sorted(b)) for w, b in of_words.items()], [(p, sorted(b)) for p, b in of_pairs.items()]


def _dealt(training: DataFrame, symbols, buckets: int, positions: int, starts: int) -> tuple[Dealing, DataFrame]:
    """The dealing, and (bucket, kind, code, n): the counts that last words and pairs of several buckets need there. Kind 1: pairs of
    numbers, kind 2: triples."""
    spark = training.sparkSession
    most = max(1.0, 2 * positions / buckets)
    over = lambda n: int(min(buckets, -(-n * buckets // max(1, positions))))
    count = symbols.value.count.copy()
    count[0] = starts
    hot_words = {int(w): over(int(count[w])) for w in np.flatnonzero(count > most)}
    flag = np.zeros(1 << BITS, bool)
    flag[list(hot_words)] = True

    def pair_codes(data, offsets):
        own = symbols.value.grams(data, offsets)[0]
        return own[flag[((own >> _W) & _MASK).astype(np.int64)]] & np.uint64((1 << 2 * BITS) - 1)

    none = spark.createDataFrame([], "bucket int, kind int, code long, n long")
    if not hot_words:
        return Dealing(buckets, {}, {}), none
    one = stored(_counted(training, pair_codes), "hot-words")
    # a pair that is hot has hot words on both sides, or stands at a text's start
    pairs = {int(r["code"]): over(int(r["n"])) for r in one.where(F.col("n") > most).collect() if int(r["code"]) & 0xFFFF in hot_words}
    if count[0] > most:
        pairs[0] = over(int(count[0]))
    hot_pairs = np.array(sorted(pairs), np.uint64)

    def triple_codes(data, offsets):
        own = symbols.value.grams(data, offsets)[0]
        return own[np.isin(own >> _W, hot_pairs)]

    dealing = Dealing(buckets, hot_words, pairs)
    of_words, of_pairs = dealing.homes()
    sent = none
    for kind, counts, homes in ((1, one, of_words), (2, stored(_counted(training, triple_codes), "hot-pairs") if pairs else None, of_pairs)):
        if homes:
            where = F.broadcast(spark.createDataFrame(homes, "context long, homes array<int>"))
            own = counts.withColumn("context", F.shiftrightunsigned("code", BITS)).join(where, "context")
            sent = sent.unionByName(own.select(F.explode("homes").alias("bucket"), F.lit(kind).alias("kind"), "code", "n"))
    return dealing, sent


def _positions(own: DataFrame, symbols, dealing: Dealing) -> DataFrame:
    """(bucket, kind 0, first, data): the positions of a step of texts that go to a bucket. data: 6 bytes of code, then 2 bytes each of
    the row behind the first one, whose lowest bit tells held-out rows."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("code", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

    def run(batches):
        turn = 0
        for batch in batches:
            ids, learn = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for first, data, offsets in texts(batch.column(1)):
                codes, rows = symbols.value.grams(data, offsets)
                row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
                for a in range(0, len(rows) - 1, 1 << 15):  # a row's number has 15 bits
                    part = slice(int(rows[a]), int(rows[min(len(rows) - 1, a + (1 << 15))]))
                    own, r = codes[part], row[part] - a
                    turn += 1
                    place = dealing.place(own, turn)
                    order = np.argsort(place, kind="stable")
                    place, own, r = place[order], own[order], r[order]
                    mark = (r * 2 + ~learn[first + a + r]).astype("<u2")
                    cuts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))
                    six = own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 3 * BITS // 8]
                    blobs = [six[x:y].tobytes() + mark[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
                    n = len(blobs)
                    columns = [pa.array(place[cuts[:-1]].astype(np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, ids[first + a])), pa.nulls(n, pa.int64()), pa.array(blobs, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return own.select("row", "text", "learn").mapInArrow(run, "bucket int, kind int, code long, n long, data binary")


def _row_scores(dealt: DataFrame, symbols, least: float, gain: float) -> DataFrame:
    """(first, data): sums of log10 probabilities of a row's positions in one task, for each step of texts 2 bytes of the row behind the first one
    and 8 of the sum; dealt is sorted by bucket, the sent counts first."""
    schema = pa.schema([("first", pa.int64()), ("data", pa.binary())])
    size = 3 * BITS // 8 + 2

    def run(batches):
        root, bucket_, parents, blobs, held, firsts = symbols.value.root, None, {1: [], 2: []}, [], [], set()

        def ended():
            known = {k: tuple(np.concatenate(x) for x in zip(*v, strict=True)) if v else (np.zeros(0, np.uint64), np.zeros(0)) for k, v in parents.items()}
            codes, rows, learn = [], [], []
            for first, blob in blobs:
                n = len(blob) // size
                raw = np.frombuffer(blob, np.uint8)
                code = np.zeros((n, 8), np.uint8)
                code[:, : size - 2] = raw[: n * (size - 2)].reshape(n, size - 2)
                mark = raw[n * (size - 2) :].view("<u2").astype(np.int64)
                codes.append(code.view("<u8")[:, 0])
                rows.append(first + (mark >> 1))
                learn.append(mark & 1 == 0)
            if codes:
                codes, rows, learn = np.concatenate(codes), np.concatenate(rows), np.concatenate(learn)
                own, back = np.unique(codes, return_inverse=True)
                log = np.log10(scored_codes(own, np.bincount(back, learn, len(own)), root, known, least, gain))
                held.append(_sums(rows, log[back]))
            parents[1], parents[2] = [], []
            firsts.update(first for first, _ in blobs)
            blobs.clear()

        def sent():
            rows, sums = _sums(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else (np.zeros(0, np.int64), np.zeros(0))
            steps = np.array(sorted(firsts), np.int64)
            cuts = np.append(np.searchsorted(rows, steps), len(rows))
            blobs_ = [(rows[a:b] - f).astype("<u2").tobytes() + sums[a:b].astype("<f8").tobytes() for f, a, b in zip(steps, cuts, cuts[1:], strict=False)]
            held.clear()
            firsts.clear()
            return pa.RecordBatch.from_arrays([pa.array(steps), pa.array(blobs_, pa.binary())], schema=schema)

        for batch in batches:
            b, kind, code, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for i in np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])))) if len(b) else ():
                if b[i] != bucket_:
                    ended()
                    bucket_ = b[i]
                    if sum(len(r) for r, _ in held) > 4 * HELD:
                        yield sent()
                same = np.flatnonzero((b[i:] != b[i]) | (kind[i:] != kind[i]))
                to = i + int(same[0]) if len(same) else len(b)
                if kind[i]:
                    parents[int(kind[i])].append((code[i:to].astype(np.int64).view(np.uint64), n[i:to].astype(np.float64)))
                else:
                    blobs.extend(zip(code[i:to].tolist(), batch.column(4).slice(i, to - i).to_pylist(), strict=True))
        ended()
        yield sent()

    return dealt.mapInArrow(run, "first long, data binary")


def _summed(parts: DataFrame) -> DataFrame:
    """(row, tree): the sums of all tasks."""
    schema = pa.schema([("row", pa.int64()), ("tree", pa.float64())])

    def run(batches):
        first, sums = None, np.zeros(1 << 15)
        there = np.zeros(1 << 15, bool)

        def sent():
            rows = np.flatnonzero(there)
            return pa.RecordBatch.from_arrays([pa.array(rows + (first or 0)), pa.array(sums[rows])], schema=schema)

        for batch in batches:
            for f, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if f != first:
                    yield sent()
                    first = f
                    sums[:], there[:] = 0.0, False
                n = len(data) // 10
                rows = np.frombuffer(data, "<u2", n).astype(np.int64)
                sums[rows] += np.frombuffer(data, "<f8", n, 2 * n)
                there[rows] = True
        yield sent()

    return parts.repartition(partitions(parts.sparkSession), "first").sortWithinPartitions("first").mapInArrow(run, "row long, tree double")


def score_texts(docs: DataFrame, learn: str = "learn", least: float = LEAST_COUNT, gain: float = GAIN, classes: int = CLASSES, own_words: int = (1 << BITS) - CLASSES - 1) -> DataFrame:
    """docs' columns other than text, with n_tokens, n_known, train_tokens, base_score and score. learn names the boolean column of rows to
    learn from."""
    spark = docs.sparkSession
    small_batches(spark)
    training = docs.where(F.col(learn)).select("text")
    words = stored(vocabulary(training), "model-words")
    model = Symbols(words, classes, own_words)
    symbols = spark.sparkContext.broadcast(model)
    buckets = BUCKETS_A_PARTITION * partitions(spark)
    starts = int(training.count())
    dealing, sent = _dealt(training, symbols, buckets, model.total, starts)
    rest = [c for c in docs.columns if c != "text"]
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"), F.coalesce(F.col(learn), F.lit(False)).alias("learn"), F.struct(*rest).alias("own"))
    both = _positions(own, symbols, dealing).unionByName(sent.withColumn("data", F.lit(None).cast("binary")))
    both = both.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", F.desc("kind"))
    trees = stored(_summed(_row_scores(both, symbols, least, gain)), "tree-scores")
    schema = pa.schema([("row", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("within", pa.float64()), ("rare", pa.list_(pa.int64()))])
    kind = own.schema["own"].dataType.simpleString()

    def run(batches):
        model = symbols.value
        base_sum, weight = np.log10(model.total + model.distinct + 1), np.log10(np.concatenate((np.ones(model.own + 1), model.weight)))
        for batch in batches:
            out = {k: [np.zeros(0, t)] for k, t in (("n_tokens", np.int64), ("known", np.int64), ("base", float), ("within", float), ("rare", np.uint64), ("sizes", np.int64))}
            for _, data, offsets in texts(batch.column(1)):
                hashes, rows = _tokens(data, offsets)
                number, n, found = model.find(hashes)
                log, classed = np.log10(n + 1.0), number > model.own
                out["n_tokens"].append(np.diff(rows))
                out["known"].append(np.add.reduceat(found.astype(np.int64), rows[:-1]))
                out["base"].append(np.add.reduceat(log - base_sum, rows[:-1]))
                out["within"].append(np.add.reduceat(np.where(classed, log, 0.0) - weight[number], rows[:-1]))
                out["rare"].append(hashes[~found])
                out["sizes"].append(np.add.reduceat((~found).astype(np.int64), rows[:-1]))
            cat = {k: np.concatenate(v) for k, v in out.items()}
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(cat["sizes"]))).astype(np.int32)), pa.array(cat["rare"].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), *[pa.array(cat[k]) for k in ("n_tokens", "known", "base", "within")], rare], names=["own", *schema.names])

    counted = stored(own.select("row", "text", "own").mapInArrow(run, f"own {kind}, row long, n_tokens long, known long, base double, within double, rare array<long>"), "counted")
    few = words.where(F.col("n") < model.least) if model.least else words.limit(0)
    rare = counted.select("row", F.explode("rare").alias("code")).join(few, "code").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("rare"), F.count(F.lit(1)).alias("rare_known"))
    all_ = counted.drop("rare").join(trees, "row").join(rare, "row", "left")
    more = F.coalesce("rare", F.lit(0.0))
    return all_.select(
        "own.*", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("tree") + F.col("within") + more).alias("score"),
    )


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (bucket(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    return score_texts(docs.withColumn("learn", ~F.col("held_out"))).drop("learn")
