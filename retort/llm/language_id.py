"""Language identification by a byte convolutional network, trained in numpy.

A window is WINDOW bytes of the text with A-Z lower-cased. Its bytes are embedded; filters of several widths slide over
it; each filter's largest answer in the window is kept; a softmax layer reads these. A text's prediction is the mean of its windows' log
probabilities, weighted by their bytes; all windows of the whole text are read, in batches of fixed size.

The network is fitted on the driver to about SAMPLE labelled texts, an equal share for each language (LEAST_SHARE at least, so that no
label is left out however many there are), chosen by a hash of doc_id, and at most WINDOWS windows of each; that bound follows the number
of languages, not the table.

Defined cases: a text that is null or has no letter is ``und`` with score 0; if no labelled text exists every text is
``und``; rows that repeat are predicted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, bucket, lower, small_batches, table, texts

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4, 5), 12, 8
SAMPLE, WINDOWS, EPOCHS, LEAST_SHARE = 2400, 2, 12, 8
#: Windows that are read at once.
BATCH = 256
SPAN = max(WIDTHS)


class ByteNet:
    def __init__(self, labels: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        n = FILTERS * len(WIDTHS)
        # a filter of width w has zeros behind its first w bytes, so that all widths are one product
        self.mask = np.repeat([[1.0 if j < w else 0.0 for j in range(SPAN)] for w in WIDTHS for _ in range(FILTERS)], EMBED, axis=1).T.astype(np.float32)
        self.p = {
            "embed": rng.standard_normal((256, EMBED)).astype(np.float32) * 0.5,
            "filters": (rng.standard_normal((SPAN * EMBED, n)) * 0.2).astype(np.float32) * self.mask,
            "bias": np.zeros(n, np.float32),
            "out": (rng.standard_normal((n, len(labels))) * 0.2).astype(np.float32),
            "out_bias": np.zeros(len(labels), np.float32),
        }

    def _patches(self, x: np.ndarray) -> np.ndarray:
        """(windows, places, SPAN * EMBED)"""
        e = self.p["embed"][x]
        view = np.lib.stride_tricks.sliding_window_view(e, SPAN, axis=1)  # windows, places, EMBED, SPAN
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(x), -1, SPAN * EMBED)

    def pooled(self, x: np.ndarray):
        z = self._patches(x) @ self.p["filters"]
        return z

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        top = self.pooled(x).max(1) + self.p["bias"]
        s = np.maximum(top, 0) @ self.p["out"] + self.p["out_bias"]
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 4) -> ByteNet:
        rng, m, v, t = np.random.default_rng(seed), {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for _ in range(epochs):
            for own in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                bx = x[own].copy()
                # part of the windows are cut short, as the last windows of texts are
                cut = rng.integers(24, WINDOW, len(own))
                short = rng.random(len(own)) < 0.35
                bx[short] = np.where(np.arange(WINDOW) < cut[short, None], bx[short], 0)
                patches = self._patches(bx)
                z = patches @ self.p["filters"]
                at = z.argmax(1)  # windows, filters
                top = np.take_along_axis(z, at[:, None, :], 1)[:, 0] + self.p["bias"]
                a = np.maximum(top, 0)
                s = a @ self.p["out"] + self.p["out_bias"]
                q = np.exp(s - s.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[np.arange(len(own)), y[own]] -= 1
                q /= len(own)
                da = (q @ self.p["out"].T) * (top > 0)
                picked = patches[np.arange(len(own))[:, None], at]  # windows, filters, SPAN * EMBED
                g = {"out": a.T @ q, "out_bias": q.sum(0), "bias": da.sum(0), "filters": np.einsum("nf,nfk->kf", da, picked) * self.mask}
                dp = (da[:, :, None] * self.p["filters"].T[None]).reshape(-1, EMBED)
                where = bx[np.arange(len(own))[:, None, None], at[:, :, None] + np.arange(SPAN)].reshape(-1)
                g["embed"] = np.stack([np.bincount(where, dp[:, j], 256) for j in range(EMBED)], 1).astype(np.float32)
                t += 1
                for k, grad in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.p[k] -= (0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all rows as (n, WINDOW) bytes padded with 0, the row of each, and its number of bytes."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][rows] + place * WINDOW
    have = np.minimum(WINDOW, offsets[1:][rows] - start)
    padded = np.concatenate((lower(data), np.zeros(WINDOW, np.uint8)))
    out = padded[start[:, None] + np.arange(WINDOW)] if len(start) else np.zeros((0, WINDOW), np.uint8)
    out[np.arange(WINDOW) >= have[:, None]] = 0
    return out, rows, have


def train(docs: DataFrame, label: str = "lang") -> ByteNet | None:
    """A network fitted to the labelled rows of docs (columns doc_id, text and label); None without labels."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    own = own.where("label is not null and text rlike '\\\\p{L}'")
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = max(LEAST_SHARE, SAMPLE // len(counts))
    part = 1_000_000_000
    take = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(part, 1 + part * share // n))])
    sample = own.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(part)) < F.coalesce(take[F.col("label")], F.lit(0))).select("label", "doc_id", "text")
    long_ = F.length("text")
    # WINDOWS stretches of a text, evenly apart
    starts = [F.floor(F.greatest(F.lit(0), long_ - WINDOW) * i / max(1, WINDOWS - 1)).cast("int") + 1 for i in range(WINDOWS)]
    rows = sample.select("label", "doc_id", F.array(*[F.substr("text", s, F.lit(WINDOW)) for s in starts]).alias("parts")).distinct().toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")]).to_pylist()
    labels = sorted(counts)
    parts = [(p.encode()[:WINDOW], labels.index(r["label"])) for r in rows for p in dict.fromkeys(r["parts"])]
    if not parts:
        return None
    x = np.zeros((len(parts), WINDOW), np.uint8)
    for i, (p, _) in enumerate(parts):
        x[i, : len(p)] = lower(np.frombuffer(p, np.uint8))
    return ByteNet(labels).fit(x, np.array([k for _, k in parts]))


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predictor(net: ByteNet | None):
    """A column function: text to the struct (lang_pred, score)."""

    @F.pandas_udf(PREDICTED)
    def predict(text: pd.Series) -> pd.DataFrame:
        column = pa.array(text, pa.large_string())
        pred, score = np.full(len(text), "und", object), np.zeros(len(text))
        if net is None:
            return pd.DataFrame({"lang_pred": pred, "score": score})
        for first, data, offsets in texts(column):
            sums = np.zeros((len(offsets) - 1, len(net.labels)))
            # a text longer than a step is read stretch by stretch, each a number of whole windows
            steps = [(data, offsets)] if len(offsets) > 2 else ((part := data[at : at + STEP_BYTES], np.array([0, len(part)])) for at in range(0, len(data), STEP_BYTES))
            for own, ends in steps:
                x, rows, have = windows(own, ends)
                for at in range(0, len(x), BATCH):
                    part = slice(at, at + BATCH)
                    np.add.at(sums, rows[part], net.log_probabilities(x[part]) * have[part, None])
            sums /= np.maximum(1, np.diff(offsets))[:, None]
            p = np.exp(sums - sums.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            pred[first : first + len(best)] = np.array(net.labels, object)[best]
            score[first : first + len(best)] = p[np.arange(len(best)), best]
        return pd.DataFrame({"lang_pred": pred, "score": score})

    return predict


def identify(docs: DataFrame, net: ByteNet | None, out: str = "language") -> DataFrame:
    """docs with the struct column out (lang_pred, score), which replaces one of that name; ``und`` and 0 for texts without a letter."""
    small_batches(docs.sparkSession)
    text = docs["text"].cast("string")
    nothing = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    found = F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), predictor(net)(text)).otherwise(nothing)
    return docs.select(*[docs[c] for c in docs.columns if c != out], found.alias(out))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket(F.col("doc_id"), 4) == 2
    net = train(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")
