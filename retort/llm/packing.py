"""Packing along a space-filling curve.

A document's vector is its histogram of hashed byte trigrams, projected to DIMS dimensions by a fixed random matrix and
cut into cells; the cell's Hilbert index, followed by bits of a hash of doc_id, is the document's curve key. Documents
are range-sorted by that key and packed one after another into sequences of ``length`` tokens, cut where a sequence is
full, so that neighbours on the curve share sequences. What a partition has left over at its end goes into sequences
whose lengths are falling powers of two, which need no padding either.

The partitions' bounds are quantiles of the keys of a sample of about SAMPLE documents chosen by a hash; they even out
the partitions' sizes and decide nothing else. Equal documents have equal cells and are spread by the hash bits.

Defined cases: null text is empty; an empty document is its end token alone; rows that repeat, or have no doc_id, are packed each; an
empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, STEP_BYTES, freed, lower, partitions, pieces, prefix_hashes, small_batches, stretch, table, texts, words

LENGTH, END_ID = 2048, 1
DIMS, CELL_BITS, SAMPLE = 4, 8, 20_000
#: Parts of words whose ids a Python worker keeps (about 50 bytes each), and how many are encoded at once (about 1 KB each meanwhile).
KEPT_WORDS, LEARNT_WORDS = 600_000, 2048
#: Bytes of text whose distinct words are encoded together.
ENCODED_BYTES = 1 << 20
_HASHED = 256
_PROJECTION = np.random.default_rng(11).standard_normal((_HASHED, DIMS)).astype(np.float32)
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?|#$%&*()")] = True
_LETTER[65:91] = _LETTER[97:123] = True


def trigram_histograms(column: pa.Array, cells: int = _HASHED) -> np.ndarray:
    """(rows, cells) counts of hashed byte trigrams of whole texts; cells is a power of two."""
    out = np.zeros((len(column), cells), np.float32)
    shift = np.uint32(32 - cells.bit_length() + 1)

    def codes(data: np.ndarray) -> np.ndarray:
        x = data.astype(np.uint32)
        code = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
        code ^= code >> np.uint32(15)
        return (code * np.uint32(0x2C1B3C6D)) >> shift

    for first, data, offsets in texts(column):
        if len(offsets) == 2 and len(data) > STEP_BYTES:  # a long text is read stretch by stretch
            for at in range(0, len(data) - 2, STEP_BYTES):
                out[first] += np.bincount(codes(data[at : at + STEP_BYTES + 2]), minlength=cells)
            continue
        code = codes(data) if len(data) > 2 else None
        for k in range(len(offsets) - 1):
            if offsets[k + 1] - offsets[k] >= 3:
                out[first + k] = np.bincount(code[offsets[k] : offsets[k + 1] - 2], minlength=cells)
    return out


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells, (n, dims) of numbers below 2^bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations of each level, coarse to fine
        low = q - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_cells(column: pa.Array) -> np.ndarray:
    v = np.sqrt(trigram_histograms(column))
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    z = v @ _PROJECTION
    return np.clip((1 / (1 + np.exp(-1.7 * z)) * (1 << CELL_BITS)).astype(np.int64), 0, (1 << CELL_BITS) - 1)


@F.pandas_udf(T.LongType())
def curve_place(text: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(curve_cells(pa.array(text, pa.large_string())), CELL_BITS))


def curve_key(text, doc_id):
    """The Hilbert index, then 30 bits of a hash of doc_id."""
    return F.shiftleft(curve_place(text), 30).bitwiseOR(F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(1 << 30)))


def word_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The parts of all rows' words and each row's first part: words end at ASCII white space, the punctuation that ends a word after an ASCII letter is a part
    of its own. A-Z are lower-cased but in rows that hold `<|`."""
    starts, ends, rows = words(data, offsets)
    folded = lower(data)
    for k in np.unique(np.searchsorted(offsets, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right") - 1):
        folded[offsets[k] : offsets[k + 1]] = data[offsets[k] : offsets[k + 1]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    at = np.flatnonzero(_MARK[data[ends - 1]])
    other = np.concatenate([[-1], np.flatnonzero(~_MARK[data])])  # a word's punctuation begins behind its last other byte
    last = other[np.searchsorted(other, ends[at]) - 1]
    cut = (last >= starts[at]) & _LETTER[data[last]]
    at, last = at[cut], last[cut]
    bounds = np.insert(bounds, at + 1, bounds[at] + last + 1 - starts[at])
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(folded[~SPACE[data]])])
    return parts, rows + np.searchsorted(at, rows)


class WordTokenizer:
    """Token ids of whole texts through the tokenizer file, each distinct word encoded once while it is kept.

    Texts are cut at ASCII white space, which no token of this file crosses, and before the punctuation that ends a
    word after an ASCII letter, where the file's own splitting cuts as well; a text's ids are its parts' ids in turn.
    ASCII capitals are folded first, as the file does, but where a text may hold a special token. Arrow numbers the
    distinct parts of a step and puts their ids in the texts' order; Python sees new parts only."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # the tokens that end a piece of the file's splitting
        self.last[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True
        # the parts that are kept, their ids, and whether they were met since others were last forgotten; their hashes in order, and whose they are
        self.known, self.known_ids, self.met = pa.array([], pa.large_binary()), pa.array([], pa.large_binary()), np.zeros(0, bool)
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def encode(self, texts_: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        return self.ids(np.frombuffer(b"".join(texts_), np.uint8), np.cumsum([0] + [len(t) for t in texts_]))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """As encode, of the rows of a buffer. A row longer than a step is read piece by piece."""
        if len(offsets) == 2 and len(data) > ENCODED_BYTES:
            return [b"".join(self._ids(x, np.array([0, len(x)]))[0] for x in pieces(data, ENCODED_BYTES))]
        return self._ids(data, offsets)

    def _ids(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        parts, rows = word_parts(data, offsets)
        if not len(parts):
            return [b""] * (len(offsets) - 1)
        numbered = parts.dictionary_encode()
        of = self._places(numbered.dictionary)
        ids = self.known_ids.take(pa.array(of[numbered.indices.to_numpy()]))
        ends = (np.frombuffer(ids.buffers()[1], np.int64)[rows]).tolist()
        raw = ids.buffers()[2].to_pybytes()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _places(self, distinct: pa.Array) -> np.ndarray:
        """Where the parts stand among those that are kept; new ones are learnt. Beyond KEPT_WORDS, those not met lately are forgotten. Hashes find parts, bytes decide."""
        bounds = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
        hashes = stretch(prefix_hashes(np.frombuffer(distinct.buffers()[2], np.uint8)[: bounds[-1]]), bounds[:-1], bounds[1:])
        of = np.full(len(distinct), -1)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            at = self.place[at[hit]]
            same = pc.equal(distinct.take(pa.array(hit)), self.known.take(pa.array(at))).to_numpy(zero_copy_only=False)
            of[hit[same]] = at[same]
        new, old = np.flatnonzero(of < 0), of[of >= 0]
        self.met[old] = True
        if len(self.known) + len(new) > KEPT_WORDS:
            if np.count_nonzero(self.met) > KEPT_WORDS // 2:
                self.met[:] = False
                self.met[old] = True
            stay, own = np.flatnonzero(self.met), self.met[self.place]
            of[of >= 0] = np.searchsorted(stay, old)
            self.hashes, self.place = self.hashes[own], np.searchsorted(stay, self.place[own])
            self.known, self.known_ids, self.met = self.known.take(pa.array(stay)), self.known_ids.take(pa.array(stay)), np.zeros(len(stay), bool)
        if len(new):
            of[new] = np.arange(len(self.known), len(self.known) + len(new))
            words_ = distinct.take(pa.array(new))
            self.known, self.known_ids = pa.concat_arrays([self.known, words_]), pa.concat_arrays([self.known_ids, self._learn(words_.to_pylist())])
            self.met = np.concatenate([self.met, np.ones(len(new), bool)])
            new = new[np.argsort(hashes[new])]
            at = np.searchsorted(self.hashes, hashes[new])
            self.hashes, self.place = np.insert(self.hashes, at, hashes[new]), np.insert(self.place, at, of[new])
        return of

    def _learn(self, words_: list[bytes]) -> pa.Array:
        """The ids of each of these parts."""
        out: list[bytes] = [b""] * len(words_)
        letters = [w.decode("utf-8", "replace").isalpha() for w in words_]
        for kind, how in ((True, self._of_letters), (False, self._of_any)):
            own = [k for k, x in enumerate(letters) if x == kind]
            for at in range(0, len(own), LEARNT_WORDS):
                part = own[at : at + LEARNT_WORDS]
                for k, ids in zip(part, how([words_[k] for k in part]), strict=True):
                    out[k] = ids
        return pa.array(out, pa.large_binary())

    def _of_letters(self, words_: list[bytes]) -> list[bytes]:
        """Words of letters go through the file as one text, without places: the file takes each for one piece, whose last token is one of those that end a
        piece. Where it cuts further, there are more of these than words."""
        e = self.tokenizer.encode_batch_fast([b" ".join(words_).decode()], add_special_tokens=False)[0]
        ids = np.array(e.ids, "<u4")
        ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
        if len(ends) != len(words_):
            return self._of_any(words_)
        raw, ends = ids.tobytes(), [0, *ends.tolist()]
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _of_any(self, words_: list[bytes]) -> list[bytes]:
        """Words go through the file as one text, whose tokens' places say where words end; words that may hold a special token go alone."""
        plain = [w.decode("utf-8", "replace") for w in words_]
        if not any("<|" in w for w in plain):
            e = self.tokenizer.encode(" ".join(plain), add_special_tokens=False)
            ids, starts = np.array(e.ids, "<u4"), np.cumsum([0] + [len(w) + 1 for w in plain])
            of = np.searchsorted(starts, np.array([o[0] for o in e.offsets], np.int64), "right") - 1
            if not (np.diff(of) < 0).any():
                ends = (4 * np.searchsorted(of, np.arange(len(plain) + 1))).tolist()
                raw = ids.tobytes()
                return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]


_tokenizers: dict[str, WordTokenizer] = {}  # a Python worker keeps its tokenizer from task to task


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class _Open:
    """The pieces that wait for their sequence to fill."""

    def __init__(self, length: int):
        self.length, self.pieces, self.total, self.sequence, self.rows = length, [], 0, 0, []

    def add(self, doc: int, ids: bytes) -> None:
        n = len(ids) // 4
        self.pieces.append((doc, 0, memoryview(ids), n))
        self.total += n
        while self.total >= self.length:
            self.cut(self.length)

    def cut(self, size: int) -> None:
        at, rest = 0, []
        for doc, start, ids, n in self.pieces:
            take = min(len(ids) // 4, size - at)
            if take:
                self.rows.append((doc, start, take, zlib.crc32(ids[: 4 * take]), n, self.sequence, at))
                at += take
            if take < len(ids) // 4:
                rest.append((doc, start + take, ids[4 * take :], n))
        self.pieces, self.total, self.sequence = rest, self.total - size, self.sequence + 1

    def end(self) -> None:
        while self.total:
            self.cut(1 << (self.total.bit_length() - 1))


def sampled(rows: int):
    """Whether a row is of the sample: about SAMPLE of so many rows, by a hash of doc_id and text; some for any number of rows."""
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(8)), F.lit(1 << 53)) < F.lit(max(1, (SAMPLE << 53) // rows))


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, rows = partitions(spark), own.count()
    sample = own if rows <= SAMPLE else own.where(sampled(rows))
    bounds = sample.select(curve_key(F.col("text"), F.col("doc_id")).cast("double").alias("key")).approxQuantile("key", [i / n for i in range(1, n)], 1 / (8 * n))
    bounds = np.unique(np.array(bounds, np.float64))

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy().astype(np.float64), "right").astype(np.int32))

    dealt = own.withColumn("key", curve_key(F.col("text"), F.col("doc_id"))).withColumn("part", place("key"))
    dealt = dealt.repartitionById(n, "part").sortWithinPartitions("part", "key", "doc_id")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(c, pa.int64()) for c in names])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        t, part, open_ = tokenizer(tokenizer_path), None, _Open(length)

        def taken():
            nonlocal open_
            rows_, open_.rows = open_.rows, []
            cols = dict(zip(names, zip(*rows_, strict=True), strict=True)) if rows_ else {c: [] for c in names}
            cols["sequence_id"] = [((part or 0) << 40) + s for s in cols["sequence_id"]]
            return pa.RecordBatch.from_arrays([pa.array(cols[c], pa.int64()) for c in names], schema=schema)

        for batch in batches:
            ids, parts = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            for first, data, offsets in texts(batch.column(1), ENCODED_BYTES):
                for k, e in enumerate(t.ids(data, offsets)):
                    if parts[first + k] != part:
                        if part is not None:
                            open_.end()
                            yield taken()
                        part, open_ = int(parts[first + k]), _Open(length)
                    open_.add(ids[first + k], e + end)
                yield taken()
        open_.end()
        yield taken()

    return dealt.select("doc_id", "text", "part").mapInArrow(freed(run), ", ".join(f"{c} long" for c in names))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
