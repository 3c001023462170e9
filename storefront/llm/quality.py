"""Quality classifier: hashed word n-gram logistic regression (operator 7).

A document's features are the hashed unigrams and bigrams of its lower-cased
words, and the unigrams, bigrams and trigrams of its words' shapes (upper and
lower case, digits and signs, runs shortened; a word that repeats the one
before has a shape of its own). Their counts, divided by the root of the
document's length, meet one weight vector in a sparse dot product. The weights
come from follow-the-regularised-leader updates, example by example, on a
bounded sample of labelled documents (``per_class`` rows of each class,
weighted to the true class shares); every document is scored over its whole
text in Arrow batches.

Cases: null and empty texts have no features and get the score of the bias;
without any labelled rows every score is 0.5; repeated rows are scored alike;
a null doc_id is scored too; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storefront.llm.common import bounded_batches, pieces, raw_texts, remainder, table
from storefront.llm.sampling import class_sample

BITS = 18
MEMO_WORDS = 200_000
_RUNS = re.compile(r"(X)X+|(x)x+|(9)9+|([^Xx9])\4+")
_M = 0x9E3779B1


def word_shape(word: str) -> str:
    """Letters as X and x, digits as 9, signs as they are; runs of one sign doubled at most."""
    raw = "".join("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    return _RUNS.sub(lambda m: (m[1] or m[2] or m[3] or m[4] * 2), raw)


class _Words(dict):
    """word -> (hash of the lower-cased word) << 32 | hash of its shape."""

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word.lower()) << 32 | zlib.crc32(word_shape(word.decode("utf-8", "replace")).encode())
        self[word] = value
        return value


_words = _Words()


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed feature of every n-gram occurrence of all texts, the text it
    belongs to, and the number of words of each text."""
    if len(_words) > MEMO_WORDS:
        _words.clear()
    split = [t.split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    both = np.fromiter((v for ws in split for v in map(_words.__getitem__, ws)), np.uint64, int(n.sum()))
    doc = np.repeat(np.arange(len(texts)), n)
    low, shape = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
    again = np.zeros(len(low), bool)
    again[1:] = (low[1:] == low[:-1]) & (doc[1:] == doc[:-1])
    shape = np.where(again, np.uint32(0x5A3E), shape)
    keys, owners = [], []

    def add(kind: int, columns: list[np.ndarray], owner: np.ndarray) -> None:
        h = np.full(len(owner), kind * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
        for c in columns:
            h = (h ^ c) * np.uint32(_M)
            h ^= h >> np.uint32(15)
        keys.append(h >> np.uint32(32 - bits))
        owners.append(owner)

    add(1, [low], doc)
    add(2, [shape], doc)
    two = doc[1:] == doc[:-1]
    add(3, [low[:-1][two], low[1:][two]], doc[1:][two])
    add(4, [shape[:-1][two], shape[1:][two]], doc[1:][two])
    three = doc[2:] == doc[:-2]
    add(5, [shape[:-2][three], shape[1:-1][three], shape[2:][three]], doc[2:][three])
    return np.concatenate(keys), np.concatenate(owners), n


class FTRL:
    """Logistic regression by follow-the-regularised-leader (proximal) updates."""

    def __init__(self, bits: int = BITS, alpha: float = 0.15, beta: float = 1.0, l1: float = 0.3, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last one is the bias
        self.bias_at = 1 << bits

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))
        return free

    def update(self, at: np.ndarray, x: np.ndarray, y: float, weight: float) -> None:
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30))) - y) * weight * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def train(texts: list[bytes], labels: list[int], weights: list[float], epochs: int = 4, seed: int = 5) -> np.ndarray:
    """Weight vector; its last entry is the bias."""
    model, rng, examples = FTRL(), np.random.default_rng(seed), []
    for t in texts:
        keys, _, n = features([t])
        at, counts = np.unique(keys.astype(np.int64), return_counts=True)
        examples.append((np.append(at, model.bias_at), np.append(counts / np.sqrt(max(1, n[0])), 1.0)))
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            model.update(*examples[i], labels[i], weights[i])
    return model.weights().astype(np.float32)


def score_texts(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    keys, owner, n = features(texts)
    dots = np.bincount(owner, weights[keys], len(texts)) / np.sqrt(np.maximum(1, n)) + weights[-1]
    return 1.0 / (1.0 + np.exp(-np.clip(dots, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> np.ndarray:
    """Train on ``docs`` (doc_id, text) with ``labels`` (doc_id, label)."""
    rows, share = class_sample(docs, labels, {0: per_class, 1: per_class})
    texts = [(r["text"] or "").encode() for r in rows]
    return train(texts, [r["label"] for r in rows], [min(4.0, share[r["label"]] / min(share.values())) for r in rows])


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (probability of label 1)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(weights)  # 2 ** BITS floats

    def run(batches):
        for batch in pieces(batches, "text", 4 << 20):
            scores = score_texts(raw_texts(batch, "text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, score double")


def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    weights = fit_quality(docs.filter(remainder("doc_id", 5) != 0), labels)
    return score_quality(docs, weights).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
