"""Toxic spans by a linear-chain conditional random field (operator 3).

Tokens are white-space words. Only documents carry labels, so training tokens
get theirs from them: in a toxic document, a token is toxic if its word, or a
prefix of it, is far more frequent in toxic than in clean sample documents and
not so by chance (a binomial test over all words and prefixes of the sample);
every token of a clean document is clean. The field learns from words,
prefixes, suffixes and neighbours of those tokens. Forward-backward marginals
of every token of a whole text add up to the document's features (expected
number of toxic tokens, two largest marginals), which a logistic curve fitted
on the sample's document labels turns into the score; tokens with a marginal of
at least one half are the offending spans.

The sample is at most TOXIC_SAMPLE toxic and CLEAN_SAMPLE clean documents, of
which the field itself is trained on CRF_SAMPLE each; every document is scored
whole, in Arrow batches.

Cases: null and empty texts have no tokens and the lowest score; without
labelled rows of both classes nothing is learned and every score is 0; repeated
rows are scored alike; a null doc_id is scored too; extra columns are ignored
(``drop_toxic`` keeps them).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storefront.llm import crf
from storefront.llm.common import bounded_batches, pieces, raw_texts, remainder, table
from storefront.llm.sampling import class_sample

BITS = 18
DIM = 1 << BITS
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4)
MEMO_WORDS = 250_000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bounds of the training sample, in documents.
TOXIC_SAMPLE, CLEAN_SAMPLE, CRF_SAMPLE = 1200, 3000, 500
#: Least ratio of document rates, toxic to clean, for a tell-tale word or prefix,
#: and the chance that any of the sample's stems passes without being one.
RATIO, CHANCE = 20.0, 0.01
#: Marginals below this are noise and don't add up to toxicity in long texts.
NOISE = 0.1


def core(word: bytes) -> bytes:
    return word.lower().strip(PUNCTUATION)


def _hash(kind: bytes, value: bytes) -> int:
    return zlib.crc32(value, zlib.crc32(kind)) * 0x9E3779B1 >> 7 & (DIM - 1)


def word_features(word: bytes) -> list[int]:
    """Hashed features of one token without its neighbours; DIM is none."""
    c = core(word)
    out = [_hash(b"w", c)]
    out += [_hash(b"p%d" % n, c[:n]) if len(c) >= n else DIM for n in PREFIXES]
    out += [_hash(b"s%d" % n, c[-n:]) if len(c) >= n else DIM for n in SUFFIXES]
    return out


def _stems(word: bytes) -> list[bytes]:
    """The word and those of its prefixes that can be tell-tale."""
    c = core(word)
    return [b"=" + c, *(c[:n] for n in (4, 5, 6) if len(c) >= n)] if len(c) >= 3 else []


@dataclass
class ToxicityModel:
    weights: np.ndarray   # DIM + 1; the last one is 0
    trans: np.ndarray
    curve: np.ndarray     # logistic weights of the document features


class _Memo:
    """word -> row of (own score, score as predecessor, score as successor)."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.rows = weights, {}
        self.values = np.zeros((1024, 3))

    def lookup(self, words: list[list[bytes]]) -> np.ndarray:
        rows = self.rows
        if len(rows) > MEMO_WORDS:
            rows.clear()
        new = {w for ws in words for w in ws} - rows.keys()
        need = len(rows) + len(new)
        if need > len(self.values):
            self.values = np.concatenate([self.values, np.zeros((max(need, 2 * len(self.values)) - len(self.values), 3))])
        w, start = self.weights, len(rows)
        fresh = np.fromiter((f for x in new for f in (*word_features(x), _hash(b"<", core(x)), _hash(b">", core(x)))),
                            np.int64).reshape(len(new), -1)
        if len(new):
            self.values[start:need, 0] = w[fresh[:, :-2]].sum(axis=1)
            self.values[start:need, 1], self.values[start:need, 2] = w[fresh[:, -2]], w[fresh[:, -1]]
            rows.update(zip(new, range(start, need)))
        return np.fromiter((i for ws in words for i in map(rows.__getitem__, ws)), np.int64, sum(map(len, words)))


def token_marginals(texts: list[bytes], model: ToxicityModel, memo: _Memo) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of all tokens, end to end, and the number of tokens of each text."""
    words = [t.split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    at = memo.lookup(words)
    first = np.zeros(len(at), bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    scores = memo.values[at, 0].copy()
    if len(at) > 1:
        inner = ~first[1:]
        scores[1:][inner] += memo.values[at[:-1], 1][inner]
        scores[:-1][inner] += memo.values[at[1:], 2][inner]
    return crf.marginals(scores, first, model.trans), n


def document_features(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per document: 1, log of the expected toxic tokens, two largest marginals."""
    doc = np.repeat(np.arange(len(n)), n)
    total = np.bincount(doc, np.where(p >= NOISE, p, 0.0), len(n))
    top, second = np.zeros(len(n)), np.zeros(len(n))
    np.maximum.at(top, doc, p)
    is_top = p == top[doc]
    at_top = np.flatnonzero(is_top)
    rest = p.copy()
    rest[at_top[np.unique(doc[at_top], return_index=True)[1]]] = 0.0
    np.maximum.at(second, doc, rest)
    return np.stack([np.ones(len(n)), np.log(total + 0.1), top, second], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - l2 * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + (l2 + 1e-6) * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return w


def _distinct_documents(texts: list[bytes]) -> list[int]:
    """Indexes of texts, near copies of an earlier one left out: they would
    make chance words look tell-tale."""
    seen, out = set(), []
    for i, t in enumerate(texts):
        words = t.lower().split()
        grams = [b" ".join(words[j:j + 4]) for j in range(max(1, len(words) - 3))]
        keys = {(k, min(zlib.crc32(g, k) for g in grams)) for k in (1, 2, 3)}
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def tell_tale_stems(toxic: list[bytes], clean: list[bytes]) -> set[bytes]:
    """Words and prefixes far more frequent in toxic than in clean documents."""
    def counts(texts):
        c = Counter()
        for t in texts:
            c.update({s for w in set(t.split()) for s in _stems(w)})
        return c
    bad, good = counts(toxic), counts(clean)
    q = sum(bad.values()) / max(1, sum(bad.values()) + sum(good.values()))
    level = CHANCE / max(1, len(bad))

    def tail(k: int, n: int) -> float:
        return sum(math.comb(n, i) * q ** i * (1 - q) ** (n - i) for i in range(k, n + 1))

    return {s for s, k in bad.items() if k >= 3
            and (k / len(toxic)) >= RATIO * ((good[s] + 0.25) / max(1, len(clean))) and tail(k, k + good[s]) <= level}


def train_model(texts: list[bytes], labels: list[int], share: dict) -> ToxicityModel | None:
    keep = _distinct_documents(texts)
    toxic, clean = ([texts[i] for i in keep if labels[i] == want] for want in (1, 0))
    if not toxic or not clean:
        return None
    stems = tell_tale_stems(toxic, clean)
    known, own, around, tell_tale = {}, [], [], []
    tokens, first, tags = [], [], []
    for y, group in ((1, toxic), (0, clean)):
        used = 0
        for t in group:
            words = t.split()
            for w in words:
                if w not in known:
                    known[w] = len(own)
                    own.append(word_features(w))
                    around.append((_hash(b"<", core(w)), _hash(b">", core(w))))
                    tell_tale.append(any(s in stems for s in _stems(w)))
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            tag = np.fromiter((y == 1 and tell_tale[i] for i in at), bool, len(at))
            if not words or (y == 1 and not tag.any()):
                continue  # nothing is known about which of its tokens are toxic
            tokens.append(at)
            tags.append(tag)
            first.append(np.arange(len(at)) == 0)
            used += 1
            if used == CRF_SAMPLE:
                break
    if not tokens:
        return None
    at, begins = np.concatenate(tokens), np.concatenate(first)
    context = np.array(around, np.int32)
    before, after = np.full(len(at), DIM, np.int32), np.full(len(at), DIM, np.int32)
    inner = ~begins[1:]
    before[1:][inner] = context[at[:-1], 0][inner]
    after[:-1][inner] = context[at[1:], 1][inner]
    rows = np.column_stack([np.array(own, np.int32)[at], before, after])
    w, trans = crf.train(rows, begins, np.concatenate(tags).astype(float), DIM)
    model = ToxicityModel(w, trans, np.zeros(4))
    memo, x = _Memo(w), []
    for i in range(0, len(texts), 200):
        x.append(document_features(*token_marginals(texts[i:i + 200], model, memo)))
    weight = np.array([min(8.0, share[y] / min(share.values())) for y in labels])
    model.curve = _logistic(np.concatenate(x), np.array(labels, float), weight)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    """Train on ``docs`` (doc_id, text) with ``labels`` (doc_id, label)."""
    rows, share = class_sample(docs, labels, {0: CLEAN_SAMPLE, 1: TOXIC_SAMPLE})
    return train_model([(r["text"] or "").encode() for r in rows], [r["label"] for r in rows], share) if len(share) == 2 else None


def _spans(text: bytes, p: np.ndarray) -> list[dict]:
    out = []
    for i, m in enumerate(_WORD.finditer(text)):
        if p[i] >= 0.5:
            start = len(text[:m.start()].decode("utf-8", "replace"))
            out.append({"start": start, "length": len(m[0].decode("utf-8", "replace")), "score": float(p[i])})
    return out


def _scored(batches, model: ToxicityModel | None):
    """Batches with the scores and spans of their rows."""
    memo = None
    for batch in pieces(batches, "text", 2 << 20):
        texts = raw_texts(batch, "text")
        if model is None:
            scores, spans = np.zeros(len(texts)), [[]] * len(texts)
        else:
            memo = memo or _Memo(model.weights)
            p, n = token_marginals(texts, model, memo)
            x = document_features(p, n)
            scores = 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))
            ends = np.cumsum(n)
            spans = [_spans(t, p[e - k:e]) if x[i, 2] >= 0.5 else [] for i, (t, e, k) in enumerate(zip(texts, ends, n))]
        yield batch, scores, spans


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, spans (offending tokens:
    start and length in code points, marginal)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(model)  # DIM + 9 numbers

    def run(batches):
        for batch, scores, spans in _scored(batches, shared.value):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, SPANS)],
                                             names=["doc_id", "score", "spans"])

    return src.mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,length:long,score:double>>")


def _fitted(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    return fit_toxicity(docs.select("doc_id", "text").filter(remainder("doc_id", 5) != 0),
                        labels.select("doc_id", F.col("toxic").alias("label")))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose own score is below ``limit``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_fitted(docs, labels))

    def run(batches):
        for batch, scores, _ in _scored(batches, shared.value):
            yield batch.filter(pa.array(scores < limit))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, _fitted(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
