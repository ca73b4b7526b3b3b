"""A quality classifier by positive-unlabelled learning.

Trusted positives are texts labelled good; a sample of all training texts is unlabelled web text. Labels of bad texts are not used at all. With the
class prior p a small network g is fitted to the non-negative risk  p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])  with the
sigmoid loss l: where the second part falls below zero, its gradient is reversed.

The prior is estimated from positives and unlabelled texts: of the scores that networks fitted to one half of each give the other half, the least ratio
of the shares of unlabelled and of positive texts above a threshold (the best bin, with a bound for its error), for ROUNDS networks in turn. The
score is a logistic curve of g whose slope follows the spread of unlabelled texts and whose place is where their mean score is the prior.

Features of a whole text: the square roots of the shares of its byte values and hashed byte trigrams, its length, word
length, and the share of its lines and words that repeat. They are computed where the text is read; the driver gets the features
of about POSITIVES + UNLABELLED texts, chosen by a hash of doc_id, one text an id: a bound that does not grow with the table.

Defined cases: null text is an empty one and is scored as such; without positive labels the score is 0.5; rows that repeat are scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket, small_batches, table, texts, word_hashes
from .packing import trigram_histograms

POSITIVES, UNLABELLED = 1500, 3000
HIDDEN, EPOCHS, STEP, THRESHOLD = 24, 60, 0.005, 0.7
ROUNDS, ROUND_EPOCHS, LEAST_SHARE, SLOPE = 3, 40, 0.1, 2.0
TRIGRAMS = 256


def features(column: pa.Array) -> np.ndarray:
    tri = trigram_histograms(column, TRIGRAMS)
    tri = np.sqrt(tri / np.maximum(1, tri.sum(1, keepdims=True)))
    byte, other = np.zeros((len(column), 256), np.float32), np.zeros((len(column), 5), np.float32)
    for first, data, offsets in texts(column):
        hashes, rows = word_hashes(data, offsets)
        for k in range(len(offsets) - 1):
            own = data[offsets[k] : offsets[k + 1]]
            n, w = len(own), hashes[rows[k] : rows[k + 1]]
            if not n:
                continue
            byte[first + k] = np.bincount(own, minlength=256) / n
            lines = own.tobytes().split(b"\n")
            other[first + k] = (np.log1p(n) / 10, n / max(1, len(w)) / 20, 1 - len(np.unique(w)) / max(1, len(w)), 1 - len(set(lines)) / len(lines), n / len(lines) / 1000)
    return np.concatenate((np.sqrt(byte), tri, np.minimum(other, 2)), 1)


class PuNet:
    def __init__(self, size: int, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(size, np.float32), np.ones(size, np.float32)
        self.p = [rng.standard_normal((size, HIDDEN)).astype(np.float32) / np.sqrt(size), np.zeros(HIDDEN, np.float32), rng.standard_normal(HIDDEN).astype(np.float32) / np.sqrt(HIDDEN), np.zeros(1, np.float32)]
        self.slope, self.shift = 1.0, 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = (x - self.mean) / self.scale
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3][0]

    def fit(self, pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 10) -> PuNet:
        self.mean, self.scale = unl.mean(0), unl.std(0) + 0.02
        pos, unl = (pos - self.mean) / self.scale, (unl - self.mean) / self.scale
        rng, m, v, t = np.random.default_rng(seed), [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        parts = max(1, len(unl) // 128)
        for _ in range(epochs):
            deals = zip(np.array_split(rng.permutation(len(pos)), parts), np.array_split(rng.permutation(len(unl)), parts), strict=True)
            for a, b in deals:
                if not len(a):
                    a = rng.integers(0, len(pos), 1)
                x = np.concatenate((pos[a], unl[b]))
                h = np.maximum(x @ self.p[0] + self.p[1], 0)
                g = h @ self.p[2] + self.p[3][0]
                s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # l(-g) = s, l(g) = 1 - s
                ds = s * (1 - s)
                n_a, n_b = len(a), len(b)
                negative = s[n_a:].mean() - prior * s[:n_a].mean()
                of_negative = np.concatenate((-prior * ds[:n_a] / n_a, ds[n_a:] / n_b))
                of_positive = np.concatenate((-prior * ds[:n_a] / n_a, np.zeros(n_b)))
                dg = (of_positive + of_negative if negative >= 0 else -of_negative).astype(np.float32)
                dh = np.outer(dg, self.p[2]) * (h > 0)
                t += 1
                for i, grad in enumerate((x.T @ dh + 1e-4 * self.p[0], dh.sum(0), h.T @ dg, np.array([dg.sum()]))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    self.p[i] -= (STEP * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def curve(self, unl: np.ndarray, prior: float) -> PuNet:
        """Sets the logistic curve so that the unlabelled texts' mean score is the prior."""
        g = self.raw(unl)
        self.slope = SLOPE / (float(g.std()) + 1e-9)
        low, high = -1e6, 1e6
        for _ in range(100):
            self.shift = (low + high) / 2
            low, high = (self.shift, high) if self.score(unl).mean() < prior else (low, self.shift)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def best_bin(pos: np.ndarray, unl: np.ndarray, least: float = LEAST_SHARE) -> float:
    """The share of positives among unlabelled scores: the least ratio of the shares above a threshold, among thresholds that at least a share of
    positives reach; the bin is chosen by an upper bound of the ratio."""
    cut = np.unique(pos)
    above = lambda x: 1 - np.searchsorted(np.sort(x), cut) / len(x)
    of_pos, of_unl = above(pos), above(unl)
    slack = sum(np.sqrt(np.log(40) / 2 / len(x)) for x in (pos, unl))
    bound = np.where(of_pos >= least, (of_unl + slack) / of_pos, np.inf)
    i = int(bound.argmin())
    return float(min(1.0, of_unl[i] / of_pos[i]))


def estimated_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The class prior by networks that are fitted to halves and asked about the other halves."""
    prior, halves = 0.5, [(x[::2], x[1::2]) for x in (pos, unl)]
    if min(len(x) for pair in halves for x in pair) < 2:
        return prior
    for _ in range(ROUNDS):
        found = []
        for own, other in ((0, 1), (1, 0)):
            net = PuNet(pos.shape[1]).fit(halves[0][own], halves[1][own], prior, ROUND_EPOCHS)
            found.append(best_bin(net.raw(halves[0][other]), net.raw(halves[1][other])))
        prior = float(np.clip(np.mean(found), 0.02, 0.98))
    return prior


def _features_column(text: pd.Series) -> pd.Series:
    return pd.Series(list(features(pa.array(text, pa.large_string()))))


def train(docs: DataFrame, labels: DataFrame) -> tuple[PuNet | None, float]:
    """(network, class prior) from docs (doc_id, text) and labels (doc_id, quality), training rows only."""
    # texts do not move: rows are chosen by id, and the few that are chosen go to the texts
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("label_doc")).distinct()
    rows = own.join(good, own["doc_id"] == good["label_doc"], "left").select("doc_id", F.col("label_doc").isNotNull().alias("good"))
    n, n_good = rows.agg(F.count(F.lit(1)), F.count_if("good")).first()
    if not n_good:
        return None, 0.5
    part = 1_000_000_000
    chance = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(part))
    picks = rows.select("doc_id", (F.col("good") & (chance(1) < part * POSITIVES // n_good + 1)).alias("pos"), (chance(2) < part * UNLABELLED // n + 1).alias("unl"))
    few = picks.where("pos or unl").distinct().withColumnRenamed("doc_id", "picked_doc")
    of = F.pandas_udf(_features_column, T.ArrayType(T.FloatType()))
    texts_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = texts_.join(F.broadcast(few), texts_["doc_id"] == few["picked_doc"]).groupBy("doc_id", "pos", "unl").agg(F.min("text").alias("text"))
    picked = met.select("doc_id", "pos", "unl", of("text").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    x = np.stack(list(picked["x"])) if len(picked) else np.zeros((0, 256 + TRIGRAMS + 5), np.float32)
    pos, unl = x[picked["pos"].to_numpy(bool)], x[picked["unl"].to_numpy(bool)]
    if not len(pos) or not len(unl):
        return None, 0.5
    prior = estimated_prior(pos, unl)
    return PuNet(x.shape[1]).fit(pos, unl, prior).curve(unl, prior), prior


def scorer(net: PuNet | None, prior: float):
    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        if net is None:
            return pd.Series(np.full(len(text), prior))
        return pd.Series(net.score(features(pa.array(text, pa.large_string()))).astype(np.float64))

    return score


def op9_quality(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    training = bucket(F.col("doc_id"), 4) != 2
    net, prior = train(docs.where(training), labels.where(training))
    out = docs.select("doc_id", (~training).alias("held_out"), scorer(net, prior)(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
