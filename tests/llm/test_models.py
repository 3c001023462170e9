"""CRF, GRU, FTRL and class-based model: exact inner parts, held-out accuracy, edge cases."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storefront.llm import class_lm, crf, gru, language_id, quality, toxicity
from storefront.llm.common import remainder


def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 9):
        s, trans = rng.normal(0, 2, 2 * n), rng.normal(0, 1, (2, 2))
        first = np.zeros(2 * n, bool)
        first[[0, n]] = True
        want = []
        for part in (s[:n], s[n:]):
            total, on = 0.0, np.zeros(n)
            for y in itertools.product((0, 1), repeat=n):
                w = math.exp(sum(v for v, l_ in zip(part, y) if l_) + sum(trans[a, b] for a, b in zip(y, y[1:])))
                total += w
                on += w * np.array(y)
            want.extend(on / total)
        assert np.allclose(crf.marginals(s, first, trans), want)


def test_crf_learns_words_and_transitions():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 50, 4000)
    first = np.arange(4000) % 40 == 0
    labels = (words < 3).astype(float)
    w, _ = crf.train(words[:, None], first, labels, 50)
    assert w[:3].min() > w[3:50].max()


def test_gru_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.new_network(3, 4, 1).items()}
    x, y = rng.integers(60, 70, (7, 5)), rng.integers(0, 3, 5)
    x[5:, 0] = gru.PAD
    w = gru.LETTER_BYTES[x].astype(float)
    _, g = gru.loss_gradients(p, x, y, w)
    for k in p:
        for _ in range(4):
            i = (int(rng.integers(60, 70)), int(rng.integers(0, p[k].shape[1]))) if k[1:2] == "W" else tuple(
                int(rng.integers(0, s)) for s in p[k].shape)
            a, b = ({n: v.copy() for n, v in p.items()} for _ in range(2))
            a[k][i] += 1e-3
            b[k][i] -= 1e-3
            slope = (gru.loss_gradients(a, x, y, w)[0] - gru.loss_gradients(b, x, y, w)[0]) / 2e-3
            assert abs(slope - g[k][i]) < 1e-4


def _likelihood(g, cls):
    k = cls.max() + 1
    n = np.zeros((k, k))
    np.add.at(n, (cls[:, None].repeat(len(cls), 1), cls[None, :].repeat(len(cls), 0)), g)
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return f(n) - f(n.sum(axis=0)) - f(n.sum(axis=1))


def test_exchange_never_lowers_the_likelihood_and_finds_classes():
    rng = np.random.default_rng(2)
    true = np.concatenate([[0], 1 + np.arange(30) % 3])
    g = rng.poisson(np.where((true[:, None] % 3 + 1) == true[None, :], 40, 1)).astype(float)
    start = class_lm.exchange_clusters(g, 4, sweeps=0)
    done = class_lm.exchange_clusters(g, 4, sweeps=8)
    assert _likelihood(g, done) > _likelihood(g, start)
    assert len({(a, b) for a, b in zip(true[1:], done[1:])}) == 3


def test_class_gains_are_those_of_the_likelihood():
    rng = np.random.default_rng(0)
    n, r, l_, own = rng.integers(0, 9, (5, 5)).astype(float), rng.integers(0, 5, 5).astype(float), rng.integers(0, 5, 5).astype(float), 2.0
    want = []
    for k in range(1, 5):
        g = n.copy()
        g[k, :] += r
        g[:, k] += l_
        g[k, k] += own
        want.append(_likelihood(g, np.arange(5)))
    gain = class_lm._class_gains(n, r, l_, own)
    assert gain[0] == -np.inf and np.allclose(gain[1:] - gain[1], np.array(want) - want[0])


@pytest.mark.parametrize("seed", [300, 591, 1192, 1383])
def test_exchange_ends(seed):
    """Units that went round between classes for ever, with gains that were not those of the likelihood."""
    rng = np.random.default_rng(seed)
    size, classes = int(rng.integers(8, 40)), int(rng.integers(3, 9))
    g = rng.poisson(rng.gamma(0.3, [1, 3, 10][seed % 3], (size, size))).astype(float)
    done = class_lm.exchange_clusters(g, classes, sweeps=40)
    a, b = np.nonzero(g)
    assert (class_lm.exchange(size, a, b, g[a, b], classes, sweeps=1, start=done) == done).all()
    assert (class_lm.exchange_clusters(g, classes) == done).all()


@pytest.fixture(scope="module")
def docs01(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")


def test_class_lm_counts_and_base_score(spark, docs01, monkeypatch):
    monkeypatch.setattr(class_lm, "FREQUENT", 3000)  # so that many words take the join
    rows = docs01.collect()
    train = docs01.filter(remainder("doc_id", 10) != 0)
    got = {r.doc_id: r for r in class_lm.score_texts(docs01, train).collect()}
    words = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in rows}
    c = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    total, distinct = sum(c.values()), len(c)
    better = 0
    for d, ws in words.items():
        r = got[d]
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)
        better += r.score > base
    assert better > 0.9 * len(words)


def test_class_lm_probabilities_sum_to_one(spark, docs01):
    train = docs01.filter(remainder("doc_id", 10) != 0)
    vocab = class_lm.vocabulary(class_lm._source(train)).cache()
    m = class_lm.fit(class_lm._source(train), vocab)
    assert np.allclose((10.0 ** m.trans).sum(axis=1), 1.0)
    left = 10.0 ** m.emit
    shared = np.bincount([m.units.unit(r.word, r.suffix) for r in vocab.collect()],
                         [1.0 if r.word in m.units.top else r.c + class_lm.DELTA for r in vocab.collect()], m.units.n)
    shared[class_lm.END] = 1.0
    is_shared = np.ones(m.units.n, bool)
    is_shared[[class_lm.END, *m.units.top.values()]] = False
    shared[is_shared] += class_lm.DELTA  # the unknown word of a shared unit
    assert np.allclose(np.bincount(m.cls, left * shared, class_lm.CLASSES)[np.unique(m.cls)], 1.0, atol=0.02)


def test_class_lm_edge_cases(edge, empty):
    scored = class_lm.score_texts(edge, edge.filter("doc_id < 12")).collect()
    assert len(scored) == edge.count()
    blank = [r for r in scored if r.doc_id in (1, 2, 3)]
    assert {(r.n_tokens, r.n_known) for r in blank} == {(1, 1)}
    twins = [(r.base_score, r.score, r.n_known) for r in scored if r.doc_id == 11]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert class_lm.score_texts(empty, empty).count() == 0
    none = class_lm.score_texts(edge, empty)
    assert none.filter("base_score = 0 and score = 0 and n_known = 0").count() == edge.count()


def _accuracy(scored, labels, limit):
    rows = scored.join(labels, "doc_id").collect()
    return sum((r.score >= limit) == (r.label == 1) for r in rows) / len(rows)


def test_quality_held_out(spark, docs01):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    w = quality.fit_quality(docs01.filter(remainder("doc_id", 5) != 0), labels)
    assert _accuracy(quality.score_quality(docs01.filter(remainder("doc_id", 5) == 0), w), labels, 0.3) > 0.95


def test_toxicity_held_out_and_spans(spark, docs01):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit_toxicity(docs01.filter(remainder("doc_id", 5) != 0), labels)
    scored = toxicity.score_toxicity(docs01, model)
    assert _accuracy(scored.filter(remainder("doc_id", 5) == 0), labels, 0.5) > 0.9
    words = Counter(r.w.lower().strip(".,") for r in scored.join(docs01, "doc_id").select(F.explode(F.expr(
        "transform(spans, s -> substring(text, s.start + 1, s.length))")).alias("w")).collect())
    assert {w for w, _ in words.most_common(6)} <= {"stupid", "disgusting", "clown", "trash", "moron", "worthless", "scum",
                                                   "pathetic", "idiot", "loser"}


def test_language_held_out(docs01):
    model = language_id.fit_languages(docs01.filter(remainder("doc_id", 4) != 2), per_language=60, rounds=150)
    rows = language_id.identify(docs01.filter(remainder("doc_id", 4) == 2), model).join(docs01, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifier_edge_cases(spark, edge, empty, marks):
    for column, fit, score in (("quality", quality.fit_quality, quality.score_quality), ("toxic", toxicity.fit_toxicity, toxicity.score_toxicity)):
        labels = marks.select("doc_id", F.col(column).alias("label"))
        for model in (fit(edge, labels), fit(empty, labels.limit(0))):
            rows = score(edge, model).collect()
            assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
            assert score(empty, model).count() == 0
    kept = toxicity.drop_toxic(edge, marks.limit(0))
    assert kept.columns == edge.columns and kept.count() == edge.count()


def test_language_edge_cases(edge, empty):
    model = language_id.fit_languages(edge, per_language=5, rounds=3)
    rows = language_id.identify(edge, model).collect()
    assert len(rows) == edge.count()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 3, 16)} == {("und", 0.0)}
    assert all(r.lang_pred == "en" for r in rows if r.doc_id == 17)
    assert language_id.fit_languages(empty) is None
    assert {r.lang_pred for r in language_id.identify(edge, None).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_every_word_has_a_class_of_its_own(spark):
    """Words far below the most frequent ones get their class from their neighbours, not from their suffix."""
    rng = np.random.default_rng(5)
    left, right = [f"a{i}x" for i in range(3000)], [f"b{i}x" for i in range(3000)]  # 6000 words, one suffix pattern
    rows = [(d, " ".join(w for _ in range(30) for w in (left[min(2999, int(rng.pareto(0.5) * 20))], right[min(2999, int(rng.pareto(0.5) * 20))])))
            for d in range(1500)]
    docs = class_lm._source(spark.createDataFrame(rows, "doc_id long, text string"))
    vocab = class_lm.vocabulary(docs).cache()
    model, classed = class_lm._fitted(docs, vocab)
    got = {r.word: r.cls for r in classed.collect()}
    assert len(got) == vocab.count() > class_lm.EXCHANGE
    assert model.bigrams.sum() == model.total
    seen = [(got[k], side) for side, words in enumerate((left, right)) for w in words if (k := class_lm.word_key(w.encode())) in got]
    votes = Counter(seen)
    fits = sum(max(votes[c, 0], votes[c, 1]) for c in {c for c, _ in votes})
    assert fits > 0.95 * len(seen)


def test_class_lm_scores_do_not_depend_on_the_words_a_task_knows(docs01, monkeypatch):
    docs = docs01.limit(200)
    want = {r.doc_id: r.score for r in class_lm.score_texts(docs, docs).collect()}
    monkeypatch.setattr(class_lm, "FREQUENT", 500)
    got = {r.doc_id: r.score for r in class_lm.score_texts(docs.filter(remainder("doc_id", 3) != 0), docs).collect()}
    # Fewer suffixes get a unit, which changes the classes' additive shares a little.
    assert got and all(math.isclose(s, want[d], rel_tol=1e-2) for d, s in got.items())


def test_every_language_is_learned(spark):
    """More than 64 languages, one of them with long documents only."""
    rng = np.random.default_rng(4)
    names = [f"l{i:02d}" for i in range(70)]
    rows = [(n * 10 + k, " ".join(chr(0x4E00 + 60 * n + int(j)) for j in rng.integers(0, 20, 40)), name)
            for n, name in enumerate(names) for k in range(6 if n < 69 else 2)]
    rows += [(9000 + k, " ".join(["ƕƕ"] * 20_000), "long") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.language_sample(docs, per_language=4)
    assert {r.lang for r in sample} == {*names, "long"}
    assert max(len(r.text) for r in sample) == language_id.MAX_TRAIN_CHARS
    assert max(Counter(r.lang for r in sample).values()) == 4
    names, net = language_id.fit_languages(docs, per_language=4, rounds=300)
    assert len(names) == 71 and len(net["o"]) == 71
    found = language_id.identify(docs, (names, net)).join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in found) > 0.8 * len(found)


def test_exchange_holds_bounded_bigrams_on_the_driver(spark, docs01, monkeypatch):
    """However many words are exchanged, the driver holds the bigrams among EXCHANGE of them."""
    monkeypatch.setattr(class_lm, "EXCHANGE", 400)
    sizes = []
    exchange = class_lm.exchange
    monkeypatch.setattr(class_lm, "exchange", lambda size, *a, **kw: (sizes.append(size), exchange(size, *a, **kw))[1])
    train = class_lm._source(docs01)
    class_lm.fit(train, class_lm.vocabulary(train).cache())
    assert sizes and max(sizes) <= 401


def test_exchange_in_rounds_ends_where_no_unit_moves(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "EXCHANGE", 12)
    rng = np.random.default_rng(7)
    g = rng.integers(0, 9, (60, 60)) * (rng.random((60, 60)) < 0.4)
    g[33], g[:, 33] = 0, 0  # a unit without bigrams
    a, b = np.nonzero(g)
    rows = [(int(x), int(y), int(g[x, y])) for x, y in zip(a, b)]
    pairs = spark.createDataFrame(rows, "a long, b long, n long").repartition(3)
    cls, n = class_lm._exchanged(pairs, 60, np.arange(13), 6)
    v = g[a, b].astype(float)
    assert cls[class_lm.END] == 0 and (cls[1:] > 0).all()
    assert (n == np.bincount(cls[a] * 6 + cls[b], v, 36).reshape(6, 6)).all()
    assert (class_lm.exchange(60, a, b, v, 6, sweeps=1, start=cls) == cls).all()


class _Value:
    def __init__(self, value):
        self.value = value


def test_class_lm_tokens_are_the_words_of_each_text():
    texts = [None, "", " ", "a", " a b\t", "\x1c\x85 x\x0b\x0cy\tz\nA\rB\x00", "\u00c9 \u00e9\xa0w a", "x" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for part in (batch, batch.slice(4), batch.slice(0, 0)):
        words, at, n = class_lm._tokens(part)
        want = [[*(t or "").encode().lower().split(), None] for t in part.column(0).to_pylist()]
        assert n.tolist() == [len(w) for w in want]
        assert [words[i] if i >= 0 else None for i in at] == [w for ws in want for w in ws]
        assert len(set(words)) == len(words) and b"" not in words
        assert class_lm._suffixes(words).tolist() == [class_lm.suffix_key(w) for w in words]


def test_class_lm_contexts_are_one_row_per_word():
    """A word's neighbours come as one list; a row for each of them was most of the work."""
    keys = np.sort(np.array([class_lm.word_key(w) for w in (b"k", b"m")]))
    cls = np.array([0, 1, 2]) if keys[0] == class_lm.word_key(b"k") else np.array([0, 2, 1])
    batch = pa.RecordBatch.from_arrays([pa.array(["k r m r", "r s k", None, "s"])], names=["text"])
    rows = [r for b in class_lm._contexts(_Value((keys, cls, 3)))(iter([batch])) for r in b.to_pylist()]
    near = {r["word"]: sorted(r["near"]) for r in rows if r["near"] is not None}
    r, s = class_lm.word_key(b"r"), class_lm.word_key(b"s")
    assert len([r for r in rows if r["near"] is not None]) == 2
    assert near == {r: [0, 1, 2, 3, 5], s: [0, 3, 4]}
    assert [(x["word"], x["other"], x["n"]) for x in rows if x["near"] is None] == [(r, s, 1)]


def test_sorted_batches_are_cut_between_words():
    rng = np.random.default_rng(3)
    for _ in range(50):
        words = np.sort(rng.integers(0, 8, int(rng.integers(1, 30))))
        cuts = np.sort(rng.integers(0, len(words) + 1, 4))
        batches = [pa.RecordBatch.from_arrays([pa.array(w)], names=["word"]) for w in np.split(words, cuts)]
        parts = [t["word"].to_pylist() for t in class_lm._whole(iter(batches))]
        assert [w for p in parts for w in p] == words.tolist()
        assert sum(len(set(p)) for p in parts) == len(set(words.tolist()))


def test_gains_of_many_units_are_those_of_each():
    rng = np.random.default_rng(1)
    for _ in range(30):
        classes, size = int(rng.integers(3, 8)), int(rng.integers(5, 30))
        g = (rng.integers(0, 5, (size, size)) * (rng.random((size, size)) < 0.5)).astype(float)
        cls = np.concatenate([[0], rng.integers(1, classes, size - 1)])
        cls[1 + rng.integers(0, size - 1)] = -1
        has = cls >= 0
        n = np.zeros((classes, classes))
        a, b = np.nonzero(g * has[:, None] * has)
        np.add.at(n, (cls[a], cls[b]), g[a, b])
        others = g - np.diag(np.diag(g))
        member = np.eye(classes)[cls] * has[:, None]
        r, l_, own = others @ member, others.T @ member, np.where(has, np.diag(g), 0.0)
        got = class_lm._units_gains(n, cls[1:], r[1:], l_[1:], own[1:])
        for u in range(1, size):
            left = n.copy()
            if has[u]:
                left[cls[u], :] -= r[u]
                left[:, cls[u]] -= l_[u]
                left[cls[u], cls[u]] -= own[u]
            want = class_lm._class_gains(left, r[u], l_[u], own[u])
            assert got[u - 1][0] == -np.inf and np.allclose(got[u - 1][1:], want[1:], atol=1e-7)


def test_class_lm_rows_of_one_document_are_scored_alike(spark, monkeypatch):
    """Rare words are joined by row: ids may be null or repeat, with the same text or another."""
    monkeypatch.setattr(class_lm, "FREQUENT", 2)
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "d c"), (None, "a b c d"), (None, "a zz"), (2, None), (3, "b b a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = class_lm.score_texts(docs, docs).collect()
    c = Counter(w for _, t in rows for w in [*(t or "").split(), None])
    total, distinct = sum(c.values()), len(c)
    base = sorted(round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in [*(t or "").split(), None]), 6) for _, t in rows)
    assert sorted(round(r.base_score, 6) for r in got) == base
    assert sorted((r.doc_id or 0, r.n_known) for r in got) == sorted((d or 0, len((t or "").split()) + 1) for d, t in rows)
    assert len({r.score for r in got if r.n_tokens == 5}) == 1
