"""Byte-level BPE encoding and decoding with segment trees (operator 9).

A text is cut into the matches of a tokenizer's pattern. A match that is a
token itself is done; the others are merged: a segment tree over the byte
positions holds, at each node, the smallest (pair rank, position) below it, so
its root is the leftmost pair of least rank. A merge joins that pair and then
updates the leaves of the merged node, of the node it swallowed and of the live
neighbour before it, each in a logarithmic number of steps. Short matches of
one size are merged in lockstep as rows of numpy matrices; long ones use one
plain tree each. Both follow the same rule.

The vocabulary file is a parameter and is read on the executors, once per
Python worker; it is never trained, copied or broadcast.

Cases: null text is the empty text with no ids; special-token strings are
ordinary text; a null id list decodes to the empty byte string; repeated rows
are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import itertools
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storefront.llm.common import bounded_batches, pieces

NONE = np.int64(1) << 62
#: Above this many byte positions a match gets a tree of its own.
LOCKSTEP_LIMIT = 256
LOCKSTEP_ROWS = 8192
#: Chunks remembered per worker; the memory is emptied when it is full.
MEMO_CHUNKS = 600_000
#: Texts are cut at single spaces between two non-space characters. Under PATTERN
#: no match reaches over such a place, so chunks can be encoded on their own.
_CHUNK = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, without the spaces between them."""
    plain = text.split(" ")
    if "" in plain or "\n " in text or " \n" in text or _OTHER_SPACE.search(text):
        return _CHUNK.split(text)
    return plain


def take(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start:start + size] of all given parts, end to end."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - ends + size, size) + np.arange(total)]


class _Chunks(dict):
    """chunk -> row; a new chunk gets the next row and is noted."""

    def __init__(self, rows: itertools.count, new: list):
        self.next_row, self.note = rows.__next__, new.append

    def __missing__(self, chunk: str) -> int:
        row = self[chunk] = self.next_row()
        self.note(chunk)
        return row


class PairTable:
    """(left id, right id) -> id of the joined token, in an open-addressing
    table that numpy probes for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        self.as_dict = dict(zip(keys, values))
        self.bits = max(8, (4 * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int64)
        left, vals = np.array(keys, np.int64), np.array(values, np.int64)
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] == -1
            first = np.zeros(len(left), bool)
            first[np.unique(slot[free], return_index=True)[1]] = True
            put = np.flatnonzero(free)[first[:free.sum()]]
            self.keys[slot[put]], self.values[slot[put]] = left[put], vals[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, vals, slot = left[rest], vals[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where they don't join."""
        key = a << 20 | b
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], NONE)
        open_ = np.flatnonzero((there != key) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


class ByteBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.cuts = pattern == default_pattern()  # other patterns may match over a space
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = PairTable(self.ranks)
        self.whole = {}  # tokens that are valid text, by that text
        for token, rank in self.ranks.items():
            with contextlib.suppress(UnicodeDecodeError):
                self.whole[token.decode()] = rank
        self._forget()

    def _forget(self) -> None:
        """Empty the memory of chunks: rows of the flat array of their ids."""
        rows = itertools.count()
        self.new_heads, self.new_tails = [], []
        self.heads, self.tails = _Chunks(rows, self.new_heads), _Chunks(rows, self.new_tails)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    # one match --------------------------------------------------------------
    def merge_one(self, match: bytes) -> list[int]:
        """Merge one match with a segment tree of its own."""
        n, find = len(match), self.pairs.as_dict
        if n == 1:
            return [self.ranks[match]]
        width = 1 << (n - 1).bit_length()
        none = (1 << 62, 0)
        tree = [none] * (2 * width)
        ids = [int(self.bytes[b]) for b in match]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(i: int) -> tuple[int, int]:
            j = after[i]
            rank = find.get(ids[i] << 20 | ids[j]) if j < n else None
            return none if rank is None else (rank, i)

        def put(i: int, value: tuple[int, int]) -> None:
            at = width + i
            tree[at] = value
            at >>= 1
            while at:
                tree[at] = min(tree[2 * at], tree[2 * at + 1])
                at >>= 1

        for i in range(n):
            tree[width + i] = leaf(i)
        for at in range(width - 1, 0, -1):
            tree[at] = min(tree[2 * at], tree[2 * at + 1])
        while tree[1] is not none and tree[1][0] < none[0]:
            rank, i = tree[1]
            j = after[i]
            ids[i], after[i] = rank, after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    # many matches of one size ----------------------------------------------
    def merge_rows(self, matches: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge matches of at most ``width`` (a power of two) bytes in
        lockstep: their ids end to end, and how many each has."""
        n = len(matches)
        sizes = np.fromiter(map(len, matches), np.int64, n)
        flat = np.frombuffer(b"".join(m.ljust(width, b"\0") for m in matches), np.uint8).reshape(n, width)
        ids = self.bytes[flat]
        place = np.arange(width)
        live = place[None, :] < sizes[:, None]
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, np.int64)
        paired = np.flatnonzero((place[None, :] + 1 < sizes[:, None]).ravel())
        row, col = paired // width, paired % width
        ranks = self.pairs.find(ids[row, col], ids[row, col + 1])
        tree[row, width + col] = np.where(ranks == NONE, NONE, ranks * width + col)
        low = width
        while low > 1:
            half = low // 2
            tree[:, half:low] = np.minimum(tree[:, low:2 * low:2], tree[:, low + 1:2 * low:2])
            low = half

        def put(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> None:
            at = width + cols
            tree[rows, at] = values
            at = at >> 1
            while at[0]:
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
                at = at >> 1

        def leaves(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
            nxt = after[rows, cols]
            ok = nxt < sizes[rows]
            ranks = self.pairs.find(ids[rows, cols], ids[rows, np.where(ok, nxt, 0)])
            return np.where(ok & (ranks != NONE), ranks * width + cols, NONE)

        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            root = tree[rows, 1]
            i = root % width
            j = after[rows, i]
            ids[rows, i] = root // width
            live[rows, j] = False
            k = after[rows, j]
            after[rows, i] = k
            has = k < sizes[rows]
            before[rows[has], k[has]] = i[has]
            put(rows, j, np.full(len(rows), NONE))
            put(rows, i, leaves(rows, i))
            p = before[rows, i]
            has = p >= 0
            if has.any():
                put(rows[has], p[has], leaves(rows[has], p[has]))
            rows = rows[tree[rows, 1] != NONE]
        return ids[live].astype(np.int32), live.sum(axis=1)

    def merge(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct matches: a flat array, and each match's start and size in it."""
        n = len(matches)
        rank = np.fromiter(map(self.whole.get, matches, itertools.repeat(-1)), np.int64, n)
        start, size, parts, used = np.arange(n), np.ones(n, np.int64), [rank.astype(np.int32)], n
        by_width: dict[int, list] = {}
        for i in np.flatnonzero(rank < 0).tolist():
            m = matches[i].encode()
            by_width.setdefault(1 << (len(m) - 1).bit_length(), []).append((i, m))
        for width, group in by_width.items():
            step = max(64, LOCKSTEP_ROWS * 16 // width) if width <= LOCKSTEP_LIMIT else 1
            for at in range(0, len(group), step):
                where, found = zip(*group[at:at + step])
                if width <= LOCKSTEP_LIMIT:
                    ids, counts = self.merge_rows(found, width)
                else:
                    ids = np.array(self.merge_one(found[0]), np.int32)
                    counts = np.array([len(ids)])
                start[list(where)] = used + np.cumsum(counts) - counts
                size[list(where)] = counts
                parts.append(ids)
                used += len(ids)
        return np.concatenate(parts), start, size

    # texts --------------------------------------------------------------------
    def _learn(self) -> None:
        """Find the ids of the chunks met for the first time."""
        find = self.pattern.findall
        # Rows were given out in the order of first sight, heads before tails.
        cut = [find(c) for c in self.new_heads] + [find(" " + c) for c in self.new_tails]
        self.new_heads.clear()
        self.new_tails.clear()
        if not cut:
            return
        known: dict[str, int] = {}
        at = np.fromiter((known.setdefault(m, len(known)) for ms in cut for m in ms), np.int64)
        flat, start, size = self.merge(list(known))
        owner = np.repeat(np.arange(len(cut)), np.fromiter(map(len, cut), np.int64, len(cut)))
        sizes = np.bincount(owner, size[at], len(cut)).astype(np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, take(flat, start[at], size[at])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the offsets of each text in them."""
        if len(self.size) > MEMO_CHUNKS:
            self._forget()
        cut = [chunks_of(t) for t in texts] if self.cuts else [[t] for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        first = np.cumsum(counts) - counts
        tracked = gc.isenabled()
        gc.disable()  # many small objects, none of them cyclic
        try:
            rows = np.empty(int(counts.sum()), np.int64)
            inner = np.ones(len(rows), bool)
            inner[first] = False
            rows[first] = np.fromiter((self.heads[c[0]] for c in cut), np.int64, len(cut))
            rows[inner] = np.fromiter(map(self.tails.__getitem__, chain.from_iterable(c[1:] for c in cut)), np.int64,
                                      len(rows) - len(cut))
            self._learn()
        finally:
            if tracked:
                gc.enable()
        size = self.size[rows]
        offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(size, first) if len(cut) else [])]).astype(np.int64)
        return take(self.flat, self.start[rows], size), offsets

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def bpe(path: str | None, pattern: str | None) -> ByteBPE:
    return ByteBPE(path or default_path(), pattern or default_pattern())


def encode(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """One row per row of ``docs``: the key column and ``ids`` (array<int>).
    ``path``: a rank file every executor can open; None takes the public one."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(key_col).alias(key_col), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        coder = bpe(path, pattern)
        for batch in pieces(batches, "text", 6 << 20):
            ids, offsets = coder.encode([t or "" for t in batch.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key_col, "ids"])

    return src.mapInArrow(run, f"`{key_col}` {src.schema[key_col].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", path: str | None = None,
               pattern: str | None = None) -> DataFrame:
    """``decode(encode(..))`` in one pass: the key column, ``ids`` and
    ``decoded``. A task has one Python worker with one coder, whose memory of
    chunks ends with the task."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(key_col).alias(key_col), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        coder = bpe(path, pattern)
        try:
            for batch in pieces(batches, "text", 2 << 20):
                ids, offsets = coder.encode([t or "" for t in batch.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                texts = [coder.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.binary())], names=[key_col, "ids", "decoded"])
        finally:
            coder._forget()

    return src.mapInArrow(run, f"`{key_col}` {src.schema[key_col].dataType.simpleString()}, ids array<int>, decoded binary")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``decoded`` (binary) to a table with an ``ids`` column."""
    bounded_batches(encoded.sparkSession)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = encoded.columns.index("ids")

    def run(batches):
        coder = bpe(path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                out = [coder.decode(x) if x else b"" for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def op9_byte_bpe(spark, sf_dir):
    from storefront.llm.common import table
    coded = decode(encode(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
