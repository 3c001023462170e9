"""Phrase collocation mining with double-array tries (operator 13).

A first pass over the texts counts words. Those that are frequent enough are the
alphabet; a second pass writes the texts as their numbers, -1 where a piece ends
or any other word stands, and leaves out what cannot be part of a phrase. Then
level by level: the frequent phrases so far are broadcast as double-array tries,
and numpy advances the states of all text positions of a task at once. A phrase
of k words is an Apriori-safe candidate where its first k - 1 words and its last
k - 1 words are frequent phrases; tasks add up (state, next word) pairs and Spark
adds up tasks, so that only pairs that reach the least count get into the next
trie. A last pass over the numbers counts: all positions advance through the
finished tries, the accepting states of each level are binned (``bincount``) and
the shards' bins are summed block by block.

A trie holds at most ``MAX_PHRASES`` phrases, a contiguous range of the sorted
ones with their own prefixes; beyond that there are several, each with its own
pass. The alphabet is the one array every task of the second pass holds: at most
n / min_count numbers, the 64-bit hashes of the words with their language. Two
words with one hash would be found by the word count, which takes another seed
then. Everything else, texts, counts, phrases, cuts and ranks, is a Spark table.

Scores are exact: products are decimals of 38 digits, divided whole.

Cases: null text is empty, null language is ``und`` and one with a literal
``und``; repeated rows and ids count each; a text without words gives nothing;
ties of scores go by count, then by phrase in UTF-8 byte order, ties of cuts to
the shortest first part; empty tables give an empty result; extra columns are
ignored; a very long text is one array of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storefront.llm.common import bounded_batches, pieces, raw_texts, table, written
from storefront.llm.double_array import DoubleArray

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: A shorter candidate goes if a longer one has this share of its count, in percent.
COVER_PERCENT = 100
#: Phrases of one broadcast trie: about 50 MB of arrays.
MAX_PHRASES = 1_000_000
#: Distinct words, or (state, word) pairs, a task adds up before it hands them on.
WORDS_HELD, PAIRS_HELD = 300_000, 1_000_000
#: Phrases of a block of bins; ways in which the shards of a block are summed first.
BLOCK, SHARDS_AT_ONCE = 1 << 15, 32
#: Words of a row of numbered text (it ends with a piece), and bytes of an Arrow batch of them.
CHUNK, BATCH_BYTES = 4096, 2 << 20
_MARKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * 9 + b" abcdefghijklmnopqrstuvwxyz")
BREAK = b"\n"


def words_and_breaks(text: bytes) -> list[bytes]:
    """Lower-cased words of a text, BREAK where a piece ends, and empty strings to be skipped."""
    return text.translate(_MARKS).replace(b"\n", b" \n ").split(b" ")


def symbol_of(lang: str, word: bytes, seed: int) -> int:
    """The 64-bit number of a word of a language; never the break's zero."""
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, seed) or 1


class _Numbers(dict):
    """word -> row of the task's word table; row 0 is the break, row 1 to be skipped."""

    def __init__(self, lang: str, note):
        super().__init__({BREAK: 0, b"": 1})
        self.lang, self.note = lang, note

    def __missing__(self, word: bytes) -> int:
        row = self[word] = self.note(self.lang, word)
        return row


class _Words:
    """The words a task has met: rows of a table, 0 for a break, 1 to be skipped."""

    def __init__(self, seed: int):
        self.seed = seed
        self.clear()

    def clear(self) -> None:
        self.langs, self.words, self.symbols = ["", ""], [b"", b""], [0, 0]
        self.numbers: dict[str, _Numbers] = {}

    def note(self, lang: str, word: bytes) -> int:
        self.langs.append(lang)
        self.words.append(word)
        self.symbols.append(symbol_of(lang, word, self.seed))
        return len(self.words) - 1

    def rows_of(self, batch: pa.RecordBatch) -> np.ndarray:
        """Rows of all words of a batch's texts, each text ended by a break."""
        flat = []
        for lang, text in zip(batch.column(1).to_pylist(), raw_texts(batch, "text")):
            lang = "und" if lang is None else lang
            if lang not in self.numbers:
                self.numbers[lang] = _Numbers(lang, self.note)
            flat += map(self.numbers[lang].__getitem__, words_and_breaks(text))
            flat.append(0)
        at = np.array(flat, np.int64)
        return at[at != 1]


def _counted(seed: int):
    """lang, word, symbol and count of the words of a task's texts, handed on now and then."""
    def run(batches):
        held, counts = _Words(seed), np.zeros(0, np.int64)

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(held.langs[2:], pa.string()), pa.array(held.words[2:], pa.binary()).cast(pa.string()),
                 pa.array(np.array(held.symbols[2:], np.uint64).view(np.int64)), pa.array(counts[2:])],
                names=["lang", "word", "symbol", "count"])

        for batch in pieces(batches, "text", 1 << 20):
            found = np.bincount(held.rows_of(batch), minlength=len(held.words))
            found[:len(counts)] += counts
            counts = found
            if len(held.words) > WORDS_HELD:
                yield rows()
                held.clear()
                counts = np.zeros(0, np.int64)
        if len(counts) > 2:
            yield rows()
    return run


def _numbered(sent, seed: int):
    """The texts as positions in the sorted alphabet, in rows that end with -1."""
    def run(batches):
        alphabet = sent.value
        held, codes = _Words(seed), np.full(2, -1, np.int32)
        for batch in pieces(batches, "text", 1 << 20):
            at = held.rows_of(batch)
            new = np.array(held.symbols[len(codes):], np.uint64)
            if len(new):
                place = np.minimum(np.searchsorted(alphabet, new), max(len(alphabet) - 1, 0))
                known = alphabet[place] == new if len(alphabet) else np.zeros(len(new), bool)
                codes = np.concatenate([codes, np.where(known, place, -1).astype(np.int32)])
            yield pa.RecordBatch.from_arrays([_cut(_phrases_only(codes[at]))], names=["chunk"])
            if len(held.words) > WORDS_HELD:
                held.clear()
                codes = np.full(2, -1, np.int32)
    return run


def _phrases_only(codes: np.ndarray) -> np.ndarray:
    """Without words that have no known neighbour, and one -1 after each run of words."""
    none = np.full(1, -1, np.int32)
    codes = np.concatenate([none, codes, none])
    known = codes >= 0
    paired = np.zeros(len(codes), bool)
    paired[1:-1] = known[1:-1] & (known[:-2] | known[2:])
    after = np.concatenate([[False], paired[:-1]]) & ~paired
    return np.where(paired, codes, -1)[paired | after].astype(np.int32)


def _cut(codes: np.ndarray) -> pa.Array:
    """Rows of CHUNK numbers or a little more, each ending with -1: no run of words is cut."""
    breaks = np.flatnonzero(codes < 0) + 1
    ends = [0]
    while ends[-1] < len(codes):
        ends.append(int(breaks[min(np.searchsorted(breaks, ends[-1] + CHUNK), len(breaks) - 1)]))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.array(ends, np.int32) * np.int32(4)), pa.py_buffer(codes)])


def count_words(src: DataFrame) -> tuple[DataFrame, int]:
    """(words, seed): lang, word, symbol and count of every word; the seed of the symbols, which are distinct."""
    seed = 0
    while True:
        found = src.mapInArrow(_counted(seed), "lang string, word string, symbol long, count long")
        words = written(found.groupBy("lang", "word", "symbol").agg(F.sum("count").alias("count")), "phrase-words")
        if words.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return words, seed
        seed += 1


class _Trie:
    """One broadcast trie; its phrases are numbered over all tries from ``offset``."""

    def __init__(self, trie: DoubleArray, offset: int):
        self.trie, self.offset = trie, offset
        self.count = int(trie.accepts.sum())

    def numbers(self, states: np.ndarray) -> np.ndarray:
        """The phrases' numbers of accepting states."""
        return self.offset + np.searchsorted(np.flatnonzero(self.trie.accepts), states)

    def levels(self, codes: np.ndarray, depth: int):
        """(positions, states) of all positions whose next k words are a path, for k = 1 to depth."""
        pos, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for k in range(depth):
            inside = pos + k < len(codes)
            pos, state = pos[inside], state[inside]
            state = self.trie.advance(state, codes[pos + k])
            live = state >= 0
            pos, state = pos[live], state[live]
            yield pos, state


class _Sums:
    """Sums by 64-bit keys, merged now and then to bound memory."""

    def __init__(self):
        self.parts: list = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        found = np.unique(keys, return_counts=True)
        self.parts.append(found)
        self.held += len(found[0])
        if self.held > 2 * PAIRS_HELD:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in self.parts)])
        counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in self.parts)])
        distinct, at = np.unique(keys, return_inverse=True)
        added = np.zeros(len(distinct), np.int64)
        np.add.at(added, at, counts)
        self.parts, self.held = [(distinct, added)], len(distinct)
        return distinct, added


def _chunks(batches):
    """The numbers of all rows of a batch, end to end."""
    for batch in batches:
        if batch.num_rows:
            rows = batch.column(0).cast(pa.binary())
            ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset:rows.offset + len(rows) + 1]
            yield np.frombuffer(rows.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(np.int32).astype(np.int64)


def _extensions(sent, k: int, check_rest: bool):
    """Occurrences of Apriori-safe candidates of k words as (state of the first k - 1, code of the last)."""
    def run(batches):
        own = sent.value
        sums = _Sums()

        def rows():
            keys, counts = sums.merge()
            sums.__init__()
            return pa.RecordBatch.from_arrays([pa.array(own.numbers(keys >> 32)), pa.array(keys & 0xFFFFFFFF), pa.array(counts)],
                                              names=["head", "last", "count"])

        for codes in _chunks(batches):
            for pos, state in own.levels(codes, k - 1):
                pass
            accepted = own.trie.accepts[state]
            if check_rest:  # the trie knows all frequent phrases: the rest must be one too
                ends = np.zeros(len(codes) + 1, bool)
                ends[pos[accepted]] = True
                accepted &= ends[pos + 1]
            pos, state = pos[accepted], state[accepted]
            inside = pos + k - 1 < len(codes)
            pos, state = pos[inside], state[inside]
            last = codes[pos + k - 1]
            known = last >= 0
            sums.add(state[known] << 32 | last[known])
            if sums.held > PAIRS_HELD and sums.merge() and sums.held > PAIRS_HELD:
                yield rows()
        if sums.held:
            yield rows()
    return run


def _accepted(sent, depth: int):
    """Bins of the accepting states over all positions of a task and the levels
    from two words on, in blocks of BLOCK numbers."""
    def run(batches):
        own = sent.value
        bins = np.zeros(len(own.trie.check), np.int64)
        for codes in _chunks(batches):
            for k, (_, state) in enumerate(own.levels(codes, depth), 1):
                if k > 1:
                    bins += np.bincount(state, minlength=len(bins))
        if bins.any():
            bins = bins[own.trie.accepts]
            for at in range(0, len(bins), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([own.offset + at], pa.int64()), pa.array([bins[at:at + BLOCK].tobytes()], pa.binary())],
                                                 names=["block", "bins"])
    return run


def _added(batches):
    """One row per block: the sum of its bins. Rows come sorted by block."""
    block, total = None, None
    for batch in batches:
        for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            bins = np.frombuffer(raw, np.int64)
            if at != block:
                if block is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "bins"])
                block, total = at, bins.copy()
            else:
                total += bins
    if block is not None:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "bins"])


def _spread(batches):
    """(number, count) of the bins that are not empty."""
    for batch in batches:
        for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            bins = np.frombuffer(raw, np.int64)
            found = np.flatnonzero(bins)
            yield pa.RecordBatch.from_arrays([pa.array(at + found), pa.array(bins[found])], names=["number", "count"])


def _summed(shards: DataFrame) -> DataFrame:
    """The shards' bins summed block by block, first SHARDS_AT_ONCE ways."""
    schema = "block long, bins binary"
    part = shards.withColumn("way", F.spark_partition_id() % SHARDS_AT_ONCE).repartition("block", "way")
    part = part.sortWithinPartitions("block").select("block", "bins").mapInArrow(_added, schema)
    whole = part.repartition("block").sortWithinPartitions("block").mapInArrow(_added, schema)
    return whole.mapInArrow(_spread, "number long, count long")


def _numbers_of(tries):
    """The number of each phrase: from the one trie that accepts it."""
    def run(batches):
        for batch in batches:
            codes = _matrix(batch.column(1))
            number = np.full(len(codes), -1, np.int64)
            for sent in tries:
                own = sent.value
                at = own.trie.walk(codes)
                mine = (at >= 0) & own.trie.accepts[np.maximum(at, 0)]
                number[mine] = own.numbers(at[mine])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number)], names=["phrase", "codes", "number"])
    return run


def _matrix(codes: pa.Array) -> np.ndarray:
    """Lists of codes as a matrix padded with -1."""
    offsets = np.asarray(codes.offsets)
    sizes = np.diff(offsets)
    out = np.full((len(sizes), int(sizes.max()) if len(sizes) else 0), -1, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = codes.flatten().to_numpy()
    return out


def _send(spark, found: list[np.ndarray], symbols: int, most: int) -> list:
    """Broadcast the tries of all phrases of ``found`` (matrices of codes)."""
    width = max((m.shape[1] for m in found), default=1)
    rows = np.concatenate([np.full((0, width), -1, np.int64), *(np.pad(m, ((0, 0), (0, width - m.shape[1])), constant_values=-1) for m in found)])
    rows = rows[np.lexsort(rows.T[::-1])]
    sent, offset = [], 0
    for at in range(0, len(rows), most):
        trie = DoubleArray(rows[at:at + most], symbols)
        own = _Trie(trie, offset)
        sent.append(spark.sparkContext.broadcast(own))
        offset += own.count
    return sent


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, max_phrases: int = MAX_PHRASES) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, phrase, codes and count of all phrases of 1 to
    ``max_words`` words found at least ``min_count`` times in a language, and
    lang, n: the words of each language."""
    spark = docs.sparkSession
    bounded_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    src = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    words, seed = count_words(src)
    totals = words.groupBy("lang").agg(F.sum("count").alias("n"))
    alphabet_rows = words.filter(F.col("count") >= min_count)
    # At most n / min_count numbers of 8 bytes: the alphabet.
    alphabet = np.sort(alphabet_rows.select("symbol").toArrow().column(0).to_numpy().view(np.uint64))
    code_of = spark.createDataFrame(pa.table({"symbol": pa.array(alphabet.view(np.int64)), "code": pa.array(np.arange(len(alphabet)))}))
    letters = written(alphabet_rows.join(code_of, "symbol").select("lang", "word", "code", "count"), "phrase-alphabet")
    chunks = written(src.mapInArrow(_numbered(spark.sparkContext.broadcast(alphabet), seed), "chunk binary"), "phrase-texts")
    level = letters.select("lang", F.col("word").alias("phrase"), F.array("code").alias("codes"))
    levels, found = [level], [np.arange(len(alphabet), dtype=np.int64)[:, None]]
    tries = _send(spark, found, len(alphabet), max_phrases)
    for k in range(2, max_words + 1):
        if not len(found[-1]):
            break
        hits = _union([chunks.mapInArrow(_extensions(t, k, len(tries) == 1), "head long, last long, count long") for t in tries])
        kept = hits.groupBy("head", "last").agg(F.sum("count").alias("count")).filter(F.col("count") >= min_count)
        kept = written(kept.select("head", "last"), f"phrase-kept-{k}")
        heads = level.select(F.struct("lang", "phrase").alias("phrase"), "codes").mapInArrow(
            _numbers_of(tries), "phrase struct<lang:string,phrase:string>, codes array<long>, number long")
        nexts = letters.select(F.col("code").alias("last"), "word")
        level = (kept.join(heads, F.col("head") == F.col("number")).join(nexts, "last")
                 .select("phrase.lang", F.concat_ws(" ", "phrase.phrase", "word").alias("phrase"),
                         F.concat("codes", F.array("last")).alias("codes")))
        level = written(level, f"phrase-level-{k}")
        levels.append(level)
        found.append(_matrix(level.select("codes").toArrow().column(0).combine_chunks()).reshape(-1, k))
        for t in tries:
            t.unpersist()
        tries = _send(spark, found, len(alphabet), max_phrases)
    # Words are counted already; the last pass counts the phrases.
    alone = letters.select("lang", F.col("word").alias("phrase"), F.array("code").alias("codes"), "count")
    if len(levels) == 1:
        return written(alone, "phrases"), written(totals, "phrase-totals")
    every = _union(levels[1:]).select(F.struct("lang", "phrase").alias("phrase"), "codes").mapInArrow(
        _numbers_of(tries), "phrase struct<lang:string,phrase:string>, codes array<long>, number long")
    counted = _summed(_union([chunks.mapInArrow(_accepted(t, len(found)), "block long, bins binary") for t in tries]))
    phrases = alone.unionByName(every.join(counted, "number").select("phrase.lang", "phrase.phrase", "codes", "count"))
    return written(phrases, "phrases"), written(totals, "phrase-totals")


def scored_phrases(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Every phrase of two or more words by its lowest-scoring cut: lang,
    phrase, codes, a, l, r, n, score."""
    cands = phrases.filter(F.size("codes") > 1).withColumnRenamed("count", "a")
    cuts = cands.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("codes") - 1)))
    cuts = cuts.select("lang", "phrase", "codes", "a", "k", F.slice("codes", F.lit(1), F.col("k")).alias("first"),
                       F.slice("codes", F.col("k") + 1, F.size("codes") - F.col("k")).alias("rest"))
    firsts = phrases.select(F.col("codes").alias("first"), F.col("count").alias("l"))
    rests = phrases.select(F.col("codes").alias("rest"), F.col("count").alias("r"))
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (whole("a") * whole("n")), whole("l") * whole("r"))
    cut = cuts.join(firsts, "first").join(rests, "rest").join(totals, "lang").withColumn("score", score)
    least = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "codes")).alias("x"))
    return least.select("lang", "phrase", "x.codes", "x.a", "x.l", "x.r", "x.n", "x.score")


def uncovered(scored: DataFrame, percent: int = COVER_PERCENT) -> DataFrame:
    """Without the phrases that lie inside a longer one with ``percent`` or more of their count."""
    size = F.size("codes")
    parts = (scored.filter(size > 2).withColumn("w", F.explode(F.sequence(F.lit(2), size - 1)))
             .withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("w") + 1)))
             .select(F.slice("codes", F.col("at"), F.col("w")).alias("codes"), F.col("a").alias("longer")))
    most = parts.groupBy("codes").agg(F.max("longer").alias("longer"))
    return scored.join(most, "codes", "left").filter((100 * F.coalesce("longer", F.lit(0))) < percent * F.col("a")).drop("longer")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 percent: int = COVER_PERCENT, max_phrases: int = MAX_PHRASES) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = frequent_phrases(docs, min_count, max_words, max_phrases)
    kept = uncovered(written(scored_phrases(phrases, totals), "phrase-scores"), percent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda x: x <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
    FROM worded, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
found AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
split AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM found),
cuts AS (
    SELECT s.lang, s.k, s.phrase, s.a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS rest
    FROM split s, (SELECT unnest(range(1, 5)) AS j) WHERE j < s.k),
scored AS (
    SELECT c.lang, c.k, c.phrase, c.a, c.j, h.a AS l, r.a AS r, n,
           ((1000::HUGEINT * c.a * n) // (h.a::HUGEINT * r.a))::BIGINT AS score
    FROM cuts c JOIN found h ON h.lang = c.lang AND h.phrase = c.head
    JOIN found r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
parts AS (
    SELECT s.lang, s.a, array_to_string(ws[i:i + w - 1], ' ') AS part
    FROM split s, (SELECT unnest(range(2, 5)) AS w), (SELECT unnest(range(1, 5)) AS i) WHERE w < s.k AND i + w - 1 <= s.k),
cover AS (SELECT lang, part, max(a) AS longer FROM parts GROUP BY ALL),
kept AS (
    SELECT l.* FROM least l LEFT JOIN cover c ON c.lang = l.lang AND c.part = l.phrase
    WHERE 100 * coalesce(longer, 0) < 100 * l.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
