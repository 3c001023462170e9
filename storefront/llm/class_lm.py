"""Brown class-based n-gram scoring (operator 4).

Every word of the training vocabulary belongs to a class of its own choosing.
Exchange clustering moves the EXCHANGE or sqrt(tokens) most frequent words
(whichever is more) between classes while the class bigram likelihood grows,
until no word moves: first the EXCHANGE most frequent, then, in rounds, as many
of those that Spark finds to gain most. Every other word then joins the class that its own
neighbours make most likely, in one distributed pass. The number of classes is
CLASSES or the fourth root of the vocabulary, whichever is more. A token's
probability is P(class | class before) * P(word | class), smoothed at each
level. Only words that training never saw go by their last two code points:
each suffix has the additive share of one word in the class that holds most of
its words.

Counts come from every training document and are pre-aggregated in the tasks,
where a batch's texts are split in Arrow and only its distinct words are Python
objects. The driver holds bounded tables: at most FREQUENT words with counts and
classes, as many suffixes, the classes of the exchanged words, and the bigrams
among EXCHANGE words. Words below the frequent ones are scored by a distributed
join of their tokens with the vocabulary. Words are told apart by 64-bit keys.

Cases: null text is the empty text, which is one end token; without training
documents the base and score of every token is that of the uniform unknown
token (0); rows with one doc_id but different texts are separate rows; repeated
rows are scored alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storefront.llm.common import bounded_batches, pieces, remainder, table, written

FREQUENT = 300_000
#: Least number of exchanged words (as many are exchanged on the driver) and of
#: classes; both grow with the corpus.
EXCHANGE, CLASSES = 2000, 48
END, OTHER = 0, 1
DELTA = 0.1
FLUSH_WORDS = 2_000_000
FLUSH_PAIRS = 2_000_000


def word_key(word: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(word)
    return x - (1 << 64) if x >> 63 else x


def _keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def suffix_key(word: bytes) -> int:
    """The last two code points as one number."""
    tail = word[-8:].decode("utf-8", "ignore")[-2:]
    return (ord(tail[-2]) << 21 if len(tail) > 1 else 0) | (ord(tail[-1]) if tail else 0)


def _suffixes(words: list[bytes]) -> np.ndarray:
    """``suffix_key`` of every word."""
    data, size = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size)
    last, second = data[ends - 1].astype(np.int64), data[ends - 2].astype(np.int64)
    out = second << 21 | last
    for i in np.flatnonzero((size < 2) | (last > 127) | (second > 127)).tolist():
        out[i] = suffix_key(words[i])
    return out


def _source(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _tokens(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of the batch's texts, the index of every token among
    them (-1: the end that follows each text), and the tokens of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
    found, n = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words, index = found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy().astype(np.int64)
    if b"" in words:  # before the first word, after the last, or alone
        blank = words.index(b"")
        kept = index != blank
        n = np.bincount(np.repeat(np.arange(len(n)), n)[kept], minlength=len(n))
        index = index[kept] - (index[kept] > blank)
        del words[blank]
    n = n + 1
    at = np.full(int(n.sum()), -1, np.int64)
    inner = np.ones(len(at), bool)
    inner[np.cumsum(n) - 1] = False
    at[inner] = index
    return words, at, n


def _among(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of every key among the sorted ``words``, or -1."""
    if not len(words):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
    return np.where(words[at] == keys, at, -1)


def _word_counts(batches):
    held, size = [], 0

    def out():
        word, suffix, n = (np.concatenate(x) for x in zip(*held))
        word, first, at = np.unique(word, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(word), pa.array(suffix[first]), pa.array(np.bincount(at, n).astype(np.int64))], names=["word", "suffix", "n"])

    for batch in pieces(batches, "text"):
        words, at, _ = _tokens(batch)
        held.append((_keys(words), _suffixes(words), np.bincount(at[at >= 0], minlength=len(words))))
        size += len(words)
        if size >= FLUSH_WORDS:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def vocabulary(train: DataFrame) -> DataFrame:
    """(word, suffix, c) of all words of the training documents."""
    rows = train.mapInArrow(_word_counts, "word long, suffix long, n long")
    return rows.groupBy("word").agg(F.max("suffix").alias("suffix"), F.sum("n").alias("c"))


@dataclass
class Units:
    """word -> unit tables and what scoring needs of the frequent words. Units:
    END, OTHER, the frequent words in the order of their keys, the suffixes."""
    words: np.ndarray         # sorted keys of the frequent words
    counts: np.ndarray        # their counts
    suffixes: dict[int, int]  # suffix key -> unit of its unseen words

    @property
    def n(self) -> int:
        return 2 + len(self.words) + len(self.suffixes)

    @cached_property
    def top(self) -> dict[int, int]:
        return {k: 2 + i for i, k in enumerate(self.words.tolist())}

    def unit(self, key: int, suffix: int) -> int:
        return self.top[key] if key in self.top else self.suffixes.get(suffix, OTHER)


def _summed(codes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their counts."""
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def _bigrams(shared):
    """Bigrams (a, b, n) of exchanged words: 0 is the end, 1 + i the i-th key."""
    def run(batches):
        keys = shared.value
        size = len(keys) + 1
        codes, counts, held = [], [], 0

        def out():
            code, n = _summed(codes, counts)
            return pa.RecordBatch.from_arrays([pa.array(code // size), pa.array(code % size), pa.array(n)], names=["a", "b", "n"])

        for batch in pieces(batches, "text", 4 << 20):
            words, at, _ = _tokens(batch)
            unit = _among(keys, _keys(words)) + 1
            u = np.append(np.where(unit > 0, unit, -1), 0)[at]
            before = np.concatenate([[0], u[:-1]])  # every text follows an end
            both = (u >= 0) & (before >= 0)
            code, n = np.unique(before[both] * size + u[both], return_counts=True)
            codes.append(code)
            counts.append(n)
            held += len(code)
            if held > FLUSH_PAIRS:
                yield out()
                codes, counts, held = [], [], 0
        if held:
            yield out()
    return run


def _contexts(shared):
    """Neighbours of every word that was not exchanged: rows (word, near) list
    the classes before it, and the number of classes plus the classes after it,
    one by one; rows (word, other, n) count the words after it that were not
    exchanged either."""
    def run(batches):
        keys, cls, classes = shared.value
        held, size = [], 0

        def out():
            word, code, a, b, m = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(word)
            word, code = word[order], code[order]
            cuts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            near = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(word)).astype(np.int32)), pa.array(code))
            alone = pa.nulls(len(cuts), pa.int64())
            return [pa.RecordBatch.from_arrays([pa.array(word[cuts]), near, alone, alone], names=["word", "near", "other", "n"]),
                    pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), near.type), pa.array(b), pa.array(m)], names=["word", "near", "other", "n"])]

        for batch in pieces(batches, "text", 4 << 20):
            words, at, _ = _tokens(batch)
            key = _keys(words)
            unit = _among(keys, key) + 1
            c = np.append(np.where(unit > 0, cls[unit], -1), 0)[at]
            tail = np.flatnonzero(c < 0)
            before, after = np.where(tail > 0, c[tail - 1], 0), c[tail + 1]  # an end follows the last word
            pair, m = np.unique(at[tail[after < 0]] * len(words) + at[tail[after < 0] + 1], return_counts=True)
            a, b = np.divmod(pair, max(1, len(words)))
            held.append((key[at[np.concatenate([tail[before >= 0], tail[after >= 0]])]],
                         np.concatenate([before[before >= 0], classes + after[after >= 0]]).astype(np.int32), key[a], key[b], m))
            size += len(held[-1][0]) + len(a)
            if size > FLUSH_PAIRS:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()
    return run


def _f(x):
    return x * np.log(np.maximum(x, 1e-300))


def _bigram_gains(n: np.ndarray, code: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(entries, classes): growth of the bigram terms if a class gets ``v``
    bigrams with the class before, ``code``, or after, ``code`` - classes."""
    table = np.concatenate([n, n.T])[code]
    return _f(table + v[:, None]) - _f(table)


def _margin_gains(rows: np.ndarray, cols: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    return (_f(rows) - _f(rows + after[:, None])) + (_f(cols) - _f(cols + before[:, None]))


def _tolerance(n: np.ndarray) -> float:
    total = n.sum()
    return max(1e-9, 1e-13 * float(_f(total))) if total else 1.0


def _class_gains(n: np.ndarray, r: np.ndarray, l_: np.ndarray, self_n: float) -> np.ndarray:
    """Growth of the likelihood of class bigrams ``n`` if a unit outside joins
    each class (the end's: never): ``r`` bigrams from it to the classes, ``l_``
    from them to it, ``self_n`` of its own. The sums of the classes before and
    after it hold these bigrams whichever class it joins."""
    rows, cols = n.sum(axis=1) + l_, n.sum(axis=0) + r
    after, before = np.flatnonzero(r), np.flatnonzero(l_)
    x, y = n[:, after], n[before, :]
    gain = (_f(x + r[after]) - _f(x)).sum(axis=1) + (_f(y + l_[before, None]) - _f(y)).sum(axis=0)
    diag = np.diag(n)
    gain += _f(diag + r + l_ + self_n) - _f(diag + r) - _f(diag + l_) + _f(diag)
    gain -= _f(rows + (r.sum() + self_n)) - _f(rows) + _f(cols + (l_.sum() + self_n)) - _f(cols)
    gain[0] = -np.inf
    return gain


def exchange(size: int, a: np.ndarray, b: np.ndarray, v: np.ndarray, classes: int, sweeps: int | None = None,
             start: np.ndarray | None = None, n: np.ndarray | None = None, rest: np.ndarray | None = None) -> np.ndarray:
    """Class of every unit, from unit bigram counts (a, b, v); unit END keeps
    class 0. Each unit in turn moves to the class that makes the class bigram
    likelihood largest, until a sweep moves none (or ``sweeps`` are done).

    With ``start``, their classes now, these are units of a larger set: ``n``
    are the class bigrams of all (changed in place), and ``rest`` (units, 2,
    classes) counts the bigrams from each unit to the classes of the others,
    which stay, and from these to it."""
    out_g, in_g = np.bincount(a, v, size), np.bincount(b, v, size)
    if rest is not None:
        out_g, in_g = out_g + rest[:, 0].sum(axis=1), in_g + rest[:, 1].sum(axis=1)
    order = np.argsort(-in_g, kind="stable")
    if start is None:
        cls = np.zeros(size, np.int64)
        cls[order] = 1 + np.arange(size) % max(1, classes - 1)
        cls[END] = 0
    else:
        cls = start.copy()
    own = np.bincount(a[a == b], v[a == b], size)
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    to, to_n, frm, frm_n = b[by_a], v[by_a], a[by_b], v[by_b]
    to_at = np.searchsorted(a[by_a], np.arange(size + 1))
    frm_at = np.searchsorted(b[by_b], np.arange(size + 1))
    if n is None:
        n = np.bincount(cls[a] * classes + cls[b], v, classes * classes).reshape(classes, classes).astype(float)
    tolerance = _tolerance(n)
    done = 0
    while sweeps is None or done < sweeps:
        moved = 0
        for w in order:
            if w == END or in_g[w] + out_g[w] == 0:
                continue
            i, j, k, m = to_at[w], to_at[w + 1], frm_at[w], frm_at[w + 1]
            r = np.bincount(cls[to[i:j]], to_n[i:j], classes)      # from w to each class
            l_ = np.bincount(cls[frm[k:m]], frm_n[k:m], classes)  # from each class to w
            c, self_n = cls[w], own[w]
            if rest is not None:
                r, l_ = r + rest[w, 0], l_ + rest[w, 1]
            r[c] -= self_n
            l_[c] -= self_n
            n[c, :] -= r
            n[:, c] -= l_
            n[c, c] -= self_n
            gain = _class_gains(n, r, l_, self_n)
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + tolerance:
                best = c
            n[best, :] += r
            n[:, best] += l_
            n[best, best] += self_n
            cls[w] = best
            moved += best != c
        done += 1
        if moved == 0:
            break
    return cls


def exchange_clusters(g: np.ndarray, classes: int = CLASSES, sweeps: int | None = None) -> np.ndarray:
    """``exchange`` of a matrix of unit bigram counts."""
    a, b = np.nonzero(g)
    return exchange(len(g), a, b, g[a, b].astype(float), classes, sweeps)


def _inside(shared):
    """Bigrams of the chosen units."""
    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield batch.filter(pa.array(shared.value[a] & shared.value[b]))
    return run


def _class_bigrams(shared):
    """Class bigrams (a, b, n) of the bigrams of units that have a class."""
    def run(batches):
        cls, classes = shared.value
        n = np.zeros(classes * classes, np.int64)
        for batch in batches:
            a, b, v = (batch.column(i).to_numpy() for i in range(3))
            known = (cls[a] >= 0) & (cls[b] >= 0)
            np.add.at(n, cls[a[known]] * classes + cls[b[known]], v[known])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at // classes), pa.array(at % classes), pa.array(n[at])], names=["a", "b", "n"])
    return run


def _without(table: np.ndarray, unit: np.ndarray, code: np.ndarray, v: np.ndarray, cls: np.ndarray, others: np.ndarray,
             own: np.ndarray) -> np.ndarray:
    """(entries, classes): bigrams of every class with the class ``code``, once
    the entry's ``unit`` has left its class ``cls``. It has ``v`` bigrams with
    ``code``, ``own`` with itself and ``others`` on its other side."""
    left, c = table[code].copy(), cls[unit]
    at = np.flatnonzero(c >= 0)
    left[at, c[at]] -= v[at]
    at = at[code[at] == c[at]]
    left[at] -= others[unit[at]]
    left[at, c[at]] -= own[unit[at]]
    return left


def _units_gains(n: np.ndarray, cls: np.ndarray, r: np.ndarray, l_: np.ndarray, own: np.ndarray) -> np.ndarray:
    """``_class_gains`` of many units, all in ``n`` still but those of class -1."""
    size, classes = r.shape
    gain = np.zeros((size, classes))
    for table, v, others in ((n.T, r, l_), (n, l_, r)):
        at, code = np.nonzero(v)
        left = _without(table, at, code, v[at, code], cls, others, own)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
        if len(first):
            gain[at[first]] += np.add.reduceat(_f(left + v[at, code][:, None]) - _f(left), first, axis=0)
    here = np.flatnonzero(cls >= 0)
    c = cls[here]
    diag = np.tile(np.diag(n), (size, 1))
    rows, cols = np.tile(n.sum(axis=1), (size, 1)), np.tile(n.sum(axis=0), (size, 1))
    out, into = r.sum(axis=1) + own, l_.sum(axis=1) + own
    diag[here, c] -= r[here, c] + l_[here, c] + own[here]
    rows[here, c] -= out[here]
    cols[here, c] -= into[here]
    rows[cls < 0] += l_[cls < 0]
    cols[cls < 0] += r[cls < 0]
    gain += _f(diag + r + l_ + own[:, None]) - _f(diag + r) - _f(diag + l_) + _f(diag)
    gain -= _f(rows + out[:, None]) - _f(rows) + _f(cols + into[:, None]) - _f(cols)
    gain[:, 0] = -np.inf
    return gain


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, other unit, side (0: after, 1: before) and count of the bigrams
    listed in the second column."""
    lists = batch.column(1)
    entry = lists.flatten()
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    code, v = entry.field(0).to_numpy(), entry.field(1).to_numpy()
    return row, code >> 1, code & 1, v


def _moves(shared):
    """(unit, best, gain) of the units that another class suits better, all
    other units staying; units without a class always move."""
    def run(batches):
        cls, n, tolerance = shared.value
        classes = len(n)
        for whole in batches:
            for first in range(0, whole.num_rows, 100):
                batch = whole.slice(first, 100)
                units, size = batch.column(0).to_numpy(), batch.num_rows
                row, other, side, v = _entries(batch)
                c, is_self = cls[units], other == units[row]
                own = np.where(c >= 0, np.bincount(row, v * (is_self & (side == 0)), size), 0.0)
                known = ~is_self & (cls[other] >= 0)
                at = (side * size + row)[known] * classes + cls[other[known]]
                r, l_ = np.bincount(at, v[known], 2 * size * classes).reshape(2, size, classes)
                gain = _units_gains(n, c, r, l_, own)
                best = gain.argmax(axis=1)
                now = gain[np.arange(size), np.maximum(c, 1)]
                more = gain[np.arange(size), best] - now
                out = (c < 0) | (more > tolerance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(units[out]), pa.array(best[out]), pa.array(np.where(c < 0, 0.0, more)[out])], names=["unit", "best", "gain"])
    return run


def _around(shared):
    """(unit, around, inside) of the chosen units: their bigrams with the
    classes of all units that are not chosen, after and before; and other unit
    and count, one after the other, of those from it to chosen units, and from
    the end (-1) to it."""
    def run(batches):
        cls, chosen, classes = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(chosen[batch.column(0).to_numpy()]))
            rows = batch.num_rows
            row, other, side, v = _entries(batch)
            stays = ~chosen[other]
            found = np.bincount(((row * 2 + side) * classes + cls[other])[stays], v[stays], rows * 2 * classes).astype(np.int64)
            around = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * 2 * classes), pa.array(found))
            kept = ~stays & ((side == 0) | (other == END))
            pair = np.column_stack([np.where(side[kept] == 0, other[kept], -1), v[kept]]).reshape(-1)
            cuts = np.concatenate([[0], 2 * np.cumsum(np.bincount(row[kept], minlength=rows))]).astype(np.int32)
            inside = pa.ListArray.from_arrays(pa.array(cuts), pa.array(pair.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), around, inside], names=["unit", "around", "inside"])
    return run


def _exchanged(pairs: DataFrame, size: int, core: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of every unit, and the class bigrams, from the unit bigrams
    ``pairs`` (a, b, n). The ``core`` units, a bounded number, are exchanged
    first. Every other unit then joins the class that suits it best, and rounds
    follow: on Spark every unit finds whether it would move, and the EXCHANGE
    units that gain most are exchanged while the others stay; until no unit
    moves. The driver holds the bigrams among as many units, no more."""
    sc = pairs.sparkSession.sparkContext

    def ordered(block, a, b, v):
        """Bigrams of a block's units, which are numbered in their order."""
        a, b = np.searchsorted(block, a), np.searchsorted(block, b)
        order = np.lexsort((b, a))
        return a[order], b[order], v[order].astype(float)

    def mask(block):
        chosen = np.zeros(size, bool)
        chosen[block] = True
        return chosen

    def counted():
        found = (pairs.mapInArrow(_class_bigrams(sc.broadcast((cls, classes))), "a long, b long, n long")
                 .groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow())
        n = np.zeros((classes, classes))
        n[found["a"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
        return n

    core = np.sort(core)
    chosen = mask(core)
    rows = pairs.mapInArrow(_inside(sc.broadcast(chosen)), "a long, b long, n long").toArrow()
    cls = np.full(size, -1, np.int64)
    cls[core] = exchange(len(core), *ordered(core, *(rows[c].to_numpy() for c in ("a", "b", "n"))), classes)
    n = counted()
    if chosen.all():
        return cls, n
    ends = (pairs.filter(F.col("a") != END).select(F.col("a").alias("unit"), (F.col("b") * 2).alias("code"), "n")
            .union(pairs.filter(F.col("b") != END).select("b", F.col("a") * 2 + 1, "n")))
    near = written(ends.groupBy("unit").agg(F.collect_list(F.struct("code", "n")).alias("near")), "neighbours")

    def moves():
        found = near.mapInArrow(_moves(sc.broadcast((cls, n, _tolerance(n)))), "unit long, best long, gain double").toArrow()
        unit, best, gain = (found[c].to_numpy() for c in ("unit", "best", "gain"))
        order = np.lexsort((unit, -gain))
        return unit[order], best[order]

    unit, best = moves()
    new = cls[unit] < 0
    cls[unit[new]] = best[new]
    cls[cls < 0] = 1  # units without any bigram
    n = counted()
    while len(movers := moves()[0]):
        block = np.sort(np.concatenate([[END], movers[:EXCHANGE]]))
        rows = near.mapInArrow(_around(sc.broadcast((cls, mask(block), classes))), "unit long, around array<long>, inside array<long>").toArrow()
        unit, inside = rows["unit"].to_numpy(), rows["inside"].combine_chunks()
        rest = np.zeros((len(block), 2, classes))
        rest[np.searchsorted(block, unit)] = rows["around"].combine_chunks().flatten().to_numpy().reshape(-1, 2, classes)
        other, v = inside.flatten().to_numpy().reshape(-1, 2).T
        unit = np.repeat(unit, pc.list_value_length(inside).to_numpy() // 2)
        a, b, v = ordered(block, np.where(other < 0, END, unit), np.where(other < 0, unit, other), v)
        cls[block] = exchange(len(block), a, b, v, classes, start=cls[block], n=n, rest=rest)
    return cls, n


def _whole(batches):
    """The rows of batches sorted by their first column, cut between its values."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        first = int(np.searchsorted(key, key[-1]))
        if first or (held and held[-1].column(0)[0] != batch.column(0)[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, first)]).combine_chunks()
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _assigned(shared):
    """Rows (word, cls) of the best class of every word, given its neighbours,
    and rows (a, b, n) of the class bigrams that come with it."""
    def run(batches):
        n, classes = shared.value, len(shared.value)
        rows, cols, width = n.sum(axis=1), n.sum(axis=0), 2 * len(shared.value)
        come = np.zeros(classes * classes, np.int64)
        for table in _whole(batches):
            lists = table["near"].combine_chunks()
            word = table["word"].to_numpy()
            new = np.concatenate([[True], word[1:] != word[:-1]])
            words, number = word[new], np.repeat(np.cumsum(new) - 1, pc.list_value_length(lists).to_numpy())
            entry, count = np.unique(number * width + lists.flatten().to_numpy(), return_counts=True)
            cuts = np.searchsorted(entry, np.arange(len(words) + 1) * width)
            best = np.zeros(len(words), np.int64)
            for i in range(0, len(words), 2000):
                j = min(len(words), i + 2000)
                owner, code, v = entry[cuts[i]:cuts[j]] // width - i, entry[cuts[i]:cuts[j]] % width, count[cuts[i]:cuts[j]]
                kinds, at = np.unique(v * width + code, return_inverse=True)
                gains = _bigram_gains(n, kinds % width, (kinds // width).astype(float))
                gain = np.add.reduceat(gains[at], cuts[i:j] - cuts[i], axis=0)
                is_after = code >= classes
                gain += _margin_gains(rows, cols, np.bincount(owner, v * is_after, j - i), np.bincount(owner, v * ~is_after, j - i))
                gain[:, 0] = -np.inf
                best[i:j] = cls = gain.argmax(axis=1)
                own = cls[owner]
                a, b = np.where(is_after, own, code), np.where(is_after, code - classes, own)
                come += np.bincount(a * classes + b, v, len(come)).astype(np.int64)
            none = pa.nulls(len(words), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(best.astype(np.int32)), none, none, none.cast(pa.int64())],
                                             names=["word", "cls", "a", "b", "n"])
        pair = np.flatnonzero(come)
        none = pa.nulls(len(pair), pa.int32())
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none, pa.array((pair // classes).astype(np.int32)),
                                          pa.array((pair % classes).astype(np.int32)), pa.array(come[pair])], names=["word", "cls", "a", "b", "n"])
    return run


@dataclass
class ClassModel:
    units: Units
    cls: np.ndarray       # class of a unit
    trans: np.ndarray     # log10 P(class | class before)
    emit: np.ndarray      # log10 P(unit | class); of suffixes and OTHER, without the DELTA of their one word
    in_class: np.ndarray  # smoothed tokens of a class
    bigrams: np.ndarray   # class bigrams of all training tokens
    total: int            # N
    distinct: int         # V


def fit(train: DataFrame, vocab: DataFrame) -> ClassModel:
    """Classes and probabilities from all training documents."""
    return _fitted(train, vocab)[0]


def _fitted(train: DataFrame, vocab: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model, and (word, suffix, c, cls) of the whole vocabulary."""
    spark = train.sparkSession
    ends = train.count()
    stats = vocab.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(stats["n"] or 0) + ends, int(stats["v"] or 0)
    # The exchanged words: ties at the least count go by key.
    size = max(EXCHANGE, math.isqrt(total))
    classes = max(CLASSES, round(distinct ** 0.25))
    chosen = vocab.orderBy(F.desc("c"), "word").limit(size).select("word").toArrow()["word"].to_numpy()
    keys = np.sort(chosen.astype(np.int64))
    shared = spark.sparkContext.broadcast(keys)
    pairs = train.mapInArrow(_bigrams(shared), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    core = np.concatenate([[END], 1 + np.searchsorted(keys, chosen[:EXCHANGE])])
    cls, n = _exchanged(written(pairs, "bigrams"), len(keys) + 1, core, classes)

    # All other words, by their own neighbours.
    context = train.mapInArrow(_contexts(spark.sparkContext.broadcast((keys, cls, classes))), "word long, near array<int>, other long, n long")
    context = written(context, "contexts")
    known = context.filter("other is null").select("word", "near").repartition("word").sortWithinPartitions("word")
    best = written(known.mapInArrow(_assigned(spark.sparkContext.broadcast(n)), "word long, cls int, a int, b int, n long"), "assigned")
    own = best.filter("word is not null").select("word", "cls")
    for r in best.filter("word is null").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        n[r["a"], r["b"]] += r["n"]
    # Words that only met words that were not exchanged go where most others went.
    most = own.groupBy("cls").agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("v"), "cls").first()
    rest = most["cls"] if most else 1
    moved = spark.createDataFrame(pa.table({"word": pa.array(keys, pa.int64()), "cls": pa.array(cls[1:].astype(np.int32))}))
    classed = vocab.join(own.union(moved), "word", "left").select("word", "suffix", "c", F.coalesce("cls", F.lit(rest)).alias("cls"))
    classed = written(classed, "classes")
    tails = context.filter("other is not null").select("word", "other", "n")
    left, right = (classed.select(F.col("word").alias(w), F.col("cls").alias(c)) for w, c in (("word", "a"), ("other", "b")))
    for r in tails.join(left, "word").join(right, "other").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        n[r["a"], r["b"]] += r["n"]

    # The least count that at most FREQUENT words reach.
    steps = vocab.groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("c")).collect()
    least, have = None, 0
    for row in steps:
        if have + row["v"] > FREQUENT:
            break
        least, have = row["c"], have + row["v"]
    frequent = classed.filter(F.col("c") >= F.lit(least)) if least is not None else classed.limit(0)
    frequent = frequent.select("word", "c", "cls").toArrow().to_pandas().sort_values("word")
    most = F.max(F.struct("v", "cls")).alias("most")
    ends_in = (classed.groupBy("suffix", "cls").agg(F.count(F.lit(1)).alias("v")).groupBy("suffix").agg(most, F.sum("v").alias("v"))
               .orderBy(F.desc("v"), "suffix").limit(FREQUENT).select("suffix", "most.cls").collect())
    start = 2 + len(frequent)
    units = Units(frequent.word.to_numpy(np.int64), frequent.c.to_numpy(np.float64), {r["suffix"]: start + i for i, r in enumerate(ends_in)})
    unit_cls = np.concatenate([[0, rest], frequent.cls.to_numpy(np.int64), np.array([r["cls"] for r in ends_in], np.int64)]).astype(np.int64)

    in_class = np.zeros(classes)
    for r in classed.groupBy("cls").agg((F.sum("c") + F.count(F.lit(1)) * F.lit(DELTA)).alias("n")).collect():
        in_class[r["cls"]] = r["n"]
    in_class[0] = ends + DELTA
    unseen = np.r_[OTHER, start:units.n]
    in_class += DELTA * np.bincount(unit_cls[unseen], minlength=classes)
    count = np.ones(units.n)
    count[END] = ends + DELTA
    count[2:start] = units.counts + DELTA
    emit = np.log10(count / in_class[unit_cls])

    share = (n.sum(axis=0) + 0.5) / (n.sum() + 0.5 * classes)
    trans = (n + 2.0 * share[None, :]) / (n.sum(axis=1, keepdims=True) + 2.0)
    return ClassModel(units, unit_cls, np.log10(trans), emit, in_class, n, total, distinct + (ends > 0)), classed


RARE = pa.struct([("word", pa.int64()), ("at", pa.int64()), ("unit", pa.int32()), ("before", pa.int32()), ("after", pa.int32())])
SCORED = ("doc_id long, n_tokens long, known long, logs double, model double, "
          "rare array<struct<word:long,at:long,unit:int,before:int,after:int>>")


def _score(shared, ends: int):
    """Scores of the tokens whose words are frequent; the others are listed in
    ``rare`` with the classes around them (-1: a rare word as well)."""
    def run(batches):
        m: ClassModel = shared.value
        counts = np.log10(m.units.counts + DELTA)
        for batch in pieces(batches, "text", 4 << 20):
            words, index, n = _tokens(batch)
            key = _keys(words)
            at = _among(m.units.words, key)
            unit, scarce = at + 2, at < 0
            unit[scarce] = [m.units.suffixes.get(suffix_key(words[i]), OTHER) for i in np.flatnonzero(scarce).tolist()]
            logs = np.zeros(len(words) + 1)  # the end's at last, where the index -1 finds it
            logs[:-1][~scarce] = counts[at[~scarce]]
            logs[-1] = np.log10(ends + DELTA)
            unit, scarce = np.append(unit, END), np.append(scarce, False)
            doc = np.repeat(np.arange(len(n)), n)
            u, is_rare, logc = unit[index], scarce[index], logs[index]
            c = m.cls[unit][index]
            before, after = np.concatenate([[0], c[:-1]]), np.concatenate([c[1:], [0]])
            rare_before, rare_after = np.concatenate([[False], is_rare[:-1]]), np.concatenate([is_rare[1:], [False]])
            token = np.where(is_rare, 0.0, m.emit[unit][index] + np.where(rare_before, 0.0, m.trans[before, c]))
            model = np.bincount(doc, token, len(n))
            known = np.bincount(doc, (~is_rare) & ((index >= 0) | (ends > 0)), len(n)).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, is_rare, len(n)))]).astype(np.int32)
            i = np.flatnonzero(is_rare)
            values = pa.StructArray.from_arrays(
                [pa.array(key[index[i]], pa.int64()), pa.array(i, pa.int64()), pa.array(u[i].astype(np.int32)),
                 pa.array(np.where(rare_before[i], -1, before[i]).astype(np.int32)),
                 pa.array(np.where(rare_after[i], -1, after[i]).astype(np.int32))], fields=list(RARE))
            rare = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(known),
                 pa.array(np.bincount(doc, logc, len(n))), pa.array(model), rare],
                names=["doc_id", "n_tokens", "known", "logs", "model", "rare"])
    return run


def _rare_sums(shared):
    """What the rare tokens of a row add to its sums."""
    def run(batches):
        m: ClassModel = shared.value
        for table in _whole(batches):
            row, at, unit, before, after, c, cls = (x.combine_chunks().fill_null(-1).to_numpy().astype(np.int64) for x in table.columns)
            order = np.lexsort((at, row))
            row, unit, before, after, c, cls = (x[order] for x in (row, unit, before, after, c, cls))
            new = np.concatenate([[True], row[1:] != row[:-1]])
            doc, size = np.cumsum(new) - 1, int(new.sum())
            seen = c >= 0
            cls = np.where(seen, cls, m.cls[unit])
            logc = np.log10(np.where(seen, c, 0) + DELTA)
            before = np.where(before < 0, np.concatenate([[0], cls[:-1]]), before)
            score = m.trans[before, cls] + logc - np.log10(m.in_class[cls]) + np.where(after < 0, 0.0, m.trans[cls, after])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[new]), pa.array(np.bincount(doc, logc, size)), pa.array(np.bincount(doc, score, size)),
                 pa.array(np.bincount(doc, seen, size).astype(np.int64))], names=["row", "more", "fit", "found"])
    return run


def score_texts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens,
    base_score, score, perplexity; learned from ``train`` (doc_id, text)."""
    src, train = _source(docs), _source(train)
    vocab = written(vocabulary(train), "vocabulary")
    model, classed = _fitted(train, vocab)
    ends = model.total - int(vocab.agg(F.sum("c")).first()[0] or 0)
    if model.total == 0:
        zero = F.lit(0.0)
        return src.select("doc_id", (F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")) + 1)
                          .cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"),
                          zero.alias("base_score"), zero.alias("score"), F.lit(1.0).alias("perplexity"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = written(src.mapInArrow(_score(shared, ends), SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")

    # Words below the frequent ones: their counts and classes come by a join.
    rare = scored.select("row", F.inline("rare"))
    seen = rare.join(classed.select("word", "c", "cls"), "word", "left").select("row", "at", "unit", "before", "after", "c", "cls")
    seen = seen.repartition("row").sortWithinPartitions("row")
    extra = seen.mapInArrow(_rare_sums(shared), "row long, more double, fit double, found long")
    out = scored.drop("rare").join(extra, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    share = float(np.log10(model.total + DELTA * (model.distinct + 1)))
    score = F.col("model") + F.coalesce("fit", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
                      F.lit(model.total).cast("long").alias("train_tokens"),
                      (F.col("logs") + more - F.col("n_tokens") * F.lit(share)).alias("base_score"), score.alias("score"),
                      F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))


def op4_class_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, docs.filter(remainder("doc_id", 10) != 0))
    return scored.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")
