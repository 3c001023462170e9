"""Cross-tokenizer alignment with token-byte incidence matrices (operator 12).

Two tokenizers cut the same bytes in two ways. A's incidence matrix has a row
per token and a one in each byte it covers; so has B's. Their product A x B^T,
formed row by row (Gustavson) on hand-built CSR arrays, has an entry where two
tokens share bytes, its value being how many: the overlap links. Byte offsets
where tokens of both end cut the tokens into groups; the product of the
token-group incidence matrices links all tokens of one group. A batch of
documents is one block-diagonal product.

Texts are cut at single spaces between two other characters; no token of a
byte-level vocabulary with the usual pattern, or of a piece vocabulary that
splits at white space, reaches over such a place, so a chunk (with its space) has
the same tokens everywhere and is encoded once as long as a worker remembers it.

A link's id pair is counted over the whole corpus. Each document keeps its
distinct pairs with their multiplicity, tasks and partial aggregates add them
up, and the counts come back by joins: the most frequent pairs, at most
``FREQUENT_PAIRS`` of them by a threshold taken from a histogram of the counts,
as a broadcast side, all others by a shuffle join. Which way a pair comes back
doesn't change its count.

The vocabulary files are parameters, read on the executors once per worker.

Cases: texts that are null, empty or that a tokenizer doesn't give back byte for
byte (joined A or B bytes differ from the space and the text) have no tokens:
zeros and an empty digest; special-token strings are plain text; rows are told
apart by a key of their own, so repeated rows and ids are separate rows; empty
tables give an empty result; extra columns are ignored; a very long text is one
product of linear size.
"""

from __future__ import annotations

import itertools
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storefront.llm.byte_bpe import _Chunks, chunks_of, take
from storefront.llm.common import bounded_batches, pieces, table, written

#: Id pairs broadcast with their counts (8-byte key, 8-byte count, one flag each).
FREQUENT_PAIRS = 1_000_000
#: Bytes of text aligned as one block-diagonal product.
PIECE_BYTES = 1 << 20
#: Chunks a worker remembers; the memory is emptied when it is full.
MEMO_CHUNKS = 250_000


# sparse matrices -------------------------------------------------------------
@dataclass
class CSR:
    """A sparse matrix: row r has columns indices[indptr[r]:indptr[r + 1]]."""
    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))


def spans(ends: np.ndarray, columns: int) -> CSR:
    """Incidence of consecutive spans: row r covers columns ends[r - 1] up to ends[r]."""
    indptr = np.concatenate([[0], ends]).astype(np.int64)
    return CSR(indptr, np.arange(columns, dtype=np.int64), np.ones(columns, np.int64), columns)


def transpose(m: CSR) -> CSR:
    order = np.argsort(m.indices, kind="stable")
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.columns))]).astype(np.int64)
    return CSR(indptr, m.row_of()[order], m.values[order], m.rows)


def product_size(a: CSR, b: CSR) -> np.ndarray:
    """Symbolic step: partial products in each row of a x b."""
    size = np.diff(b.indptr)[a.indices]
    total = np.concatenate([[0], np.cumsum(size)])
    return total[a.indptr[1:]] - total[a.indptr[:-1]]


def product(a: CSR, b: CSR) -> CSR:
    """a x b by Gustavson's rule: row r is the sum of the rows of b that row r
    of a selects, equal columns added up; columns come out sorted."""
    size = np.diff(b.indptr)[a.indices]
    total = int(size.sum())
    ends = np.cumsum(size)
    at = np.repeat(b.indptr[a.indices] - ends + size, size) + np.arange(total)
    row, col = np.repeat(a.row_of(), size), b.indices[at]
    value = np.repeat(a.values, size) * b.values[at]
    key = row * b.columns + col
    if total and (key[1:] < key[:-1]).any():  # spans come out in order already
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, np.int64)
    row, col = key[first] // max(b.columns, 1), key[first] % max(b.columns, 1)
    added = np.add.reduceat(value, first) if total else value
    return CSR(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=a.rows))]).astype(np.int64), col, added, b.columns)


def group_incidence(ends: np.ndarray, cuts: np.ndarray) -> CSR:
    """Token-group incidence: token r lies in the group that its last byte lies in."""
    group = np.searchsorted(cuts, ends, side="left")
    return CSR(np.arange(len(ends) + 1, dtype=np.int64), group, np.ones(len(ends), np.int64), len(cuts))


# tokenizers ------------------------------------------------------------------
def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class TokenBytes:
    """Bytes of all token ids in one flat array."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens) or b"\0", np.uint8)
        self.count = len(tokens)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return take(self.flat, self.start[ids], self.size[ids])


class _Memory:
    """Token ids of chunks, end to end, by the chunk's row."""

    def __init__(self):
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: list[list[int]]) -> np.ndarray:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(size.sum()))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        return flat.astype(np.int64)

    def of(self, rows: np.ndarray) -> np.ndarray:
        return take(self.flat, self.start[rows], self.size[rows]).astype(np.int64)


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = TokenBytes([bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t in entries])
        self.b_bytes = TokenBytes([
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())])

        numbers = range(max(self.a_bytes.count, self.b_bytes.count))
        self.decimals = TokenBytes([b"%d," % i for i in numbers])
        self._forget()

    def _forget(self) -> None:
        self.new: list[str] = []
        self.rows = _Chunks(itertools.count(), self.new)
        self.memory_a, self.memory_b, self.exact = _Memory(), _Memory(), np.zeros(0, bool)

    def _learn(self) -> None:
        """Encode the chunks met for the first time, each after a space, and
        note which of them both tokenizers give back byte for byte."""
        if not self.new:
            return
        a = self.memory_a.add([e.ids for e in self.a.encode_batch_fast([" " + c for c in self.new], add_special_tokens=False)])
        b = self.memory_b.add(self.b.encode(self.new, num_threads=1))
        wanted = [b" " + c.encode() for c in self.new]
        n = len(wanted)
        exact = np.ones(n, bool)
        for ids, of, size in ((a, self.a_bytes, self.memory_a.size[-n:]), (b, self.b_bytes, self.memory_b.size[-n:])):
            owner = np.repeat(np.arange(n), size)
            ends = np.cumsum(np.bincount(owner, of.size[ids], n).astype(np.int64)).tolist()
            joined = of.joined(ids).tobytes()
            exact &= np.fromiter((joined[x:y] == w for x, y, w in zip([0, *ends], ends, wanted)), bool, n)
        self.exact = np.concatenate([self.exact, exact])
        self.new.clear()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's and B's ids of all texts, end to end, and how many each text has;
        none for a text that is empty or not given back byte for byte."""
        if len(self.exact) > MEMO_CHUNKS:
            self._forget()
        cut = [chunks_of(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        rows = np.fromiter(map(self.rows.__getitem__, itertools.chain.from_iterable(cut)), np.int64, int(counts.sum()))
        self._learn()
        doc = np.repeat(np.arange(len(cut)), counts)
        odd = np.unique(doc[~self.exact[rows]])
        wrong = [d for d in odd.tolist() if not self._gives_back(texts[d], rows[doc == d])]
        if wrong:
            stays = ~np.isin(doc, wrong)
            rows, doc = rows[stays], doc[stays]
        n_a, n_b = (np.bincount(doc, m.size[rows], len(cut)).astype(np.int64) for m in (self.memory_a, self.memory_b))
        return self.memory_a.of(rows), self.memory_b.of(rows), n_a, n_b

    def _gives_back(self, text: str, rows: np.ndarray) -> bool:
        want = b" " + text.encode()
        return all(of.joined(memory.of(rows)).tobytes() == want for of, memory in ((self.a_bytes, self.memory_a), (self.b_bytes, self.memory_b)))


@lru_cache(maxsize=1)
def aligner(a_path: str | None, b_path: str | None) -> Aligner:
    import public_tokenizers
    return Aligner(a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model"))


@dataclass
class Alignment:
    """The alignment of a batch of documents, as one block-diagonal product."""
    ids_a: np.ndarray       # token ids of all documents, end to end
    ids_b: np.ndarray
    doc_a: np.ndarray       # document of each token
    doc_b: np.ndarray
    links: CSR              # A tokens x B tokens, value: shared bytes
    groups_a: CSR           # A tokens x groups
    groups_b: CSR
    group_doc: np.ndarray   # document of each group

    def group_links(self) -> CSR:
        """A tokens x B tokens of one group each; quadratic in a group's size."""
        return product(self.groups_a, transpose(self.groups_b))

    def group_link_counts(self) -> np.ndarray:
        """Links of each A token in ``group_links``, from the symbolic step alone."""
        return product_size(self.groups_a, transpose(self.groups_b))


def align(coder: Aligner, texts: list[str]) -> Alignment:
    """Align texts; a text that is empty or not given back byte for byte has no tokens."""
    ids_a, ids_b, n_a, n_b = coder.encode(texts)
    doc_a, doc_b = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
    ends_a, ends_b = np.cumsum(coder.a_bytes.size[ids_a]), np.cumsum(coder.b_bytes.size[ids_b])
    total = int(ends_a[-1]) if len(ends_a) else 0
    links = product(spans(ends_a, total), transpose(spans(ends_b, total)))
    both = np.zeros(total + 1, bool)
    both[ends_b] = True
    cuts = ends_a[both[ends_a]]
    groups_a, groups_b = group_incidence(ends_a, cuts), group_incidence(ends_b, cuts)
    group_doc = doc_a[np.searchsorted(ends_a, cuts, side="left")]
    return Alignment(ids_a, ids_b, doc_a, doc_b, links, groups_a, groups_b, group_doc)


def group_text(coder: Aligner, found: Alignment, docs: int) -> pa.Array:
    """Per document its groups as ``a1,a2|b1;a3|b2,b3`` (decimal ids, in order):
    the tokens put into that order, their decimals joined, and every comma that
    ends a side, a group or a document replaced or left out."""
    ga, gb, groups = found.groups_a.indices, found.groups_b.indices, len(found.group_doc)
    numbers = np.arange(groups)
    at_a = np.arange(len(ga)) + np.searchsorted(gb, numbers)[ga]
    at_b = np.arange(len(gb)) + np.searchsorted(ga, numbers, side="right")[gb]
    n = len(ga) + len(gb)
    ids, ending, doc = np.empty(n, np.int64), np.full(n, ord(","), np.uint8), np.empty(n, np.int64)
    ids[at_a], ids[at_b] = found.ids_a, found.ids_b
    doc[at_a], doc[at_b] = found.doc_a, found.doc_b
    ending[at_a[np.diff(ga, append=-1) != 0]] = ord("|")
    ending[at_b[np.diff(gb, append=-1) != 0]] = ord(";")
    flat, size = coder.decimals.joined(ids).copy(), coder.decimals.size[ids]
    ends = np.cumsum(size)
    flat[ends - 1] = ending
    stays = np.ones(len(flat), bool)
    stays[ends[np.diff(doc, append=-1) != 0] - 1] = False  # nothing after a document's last group
    sizes = np.bincount(doc, size, docs).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes - 1, 0))])
    return pa.StringArray.from_buffers(docs, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat[stays]))


def _aligned(a_path: str | None, b_path: str | None):
    def run(batches):
        coder = aligner(a_path, b_path)
        for batch in pieces(batches, "text", PIECE_BYTES):
            n = batch.num_rows
            found = align(coder, [t or "" for t in batch.column(1).to_pylist()])
            link_a = found.links.row_of()
            doc = found.doc_a[link_a]
            # Distinct (document, A id, B id) with the number of links.
            pair = found.ids_a[link_a] * coder.b_bytes.count + found.ids_b[found.links.indices]
            order = np.lexsort((pair, doc))
            doc, pair = doc[order], pair[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])) if len(doc) else doc
            times = np.diff(np.append(first, len(doc)))
            offsets = np.searchsorted(doc[first], np.arange(n + 1))
            pairs = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pair[first]), pa.array(times, pa.int64()))
            count = lambda where: pa.array(np.bincount(where, minlength=n)[:n], pa.int64())
            shared = np.bincount(found.doc_a, found.group_link_counts(), n).astype(np.int64) if len(found.doc_a) else np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), count(found.doc_a), count(found.doc_b), count(found.group_doc), count(found.doc_a[link_a]),
                 pa.array(shared), group_text(coder, found, n), pairs],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links", "groups", "pairs"])
    return run


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links,
    n_group_links (pairs of tokens that share a group), groups (text) and pairs
    (map of A id * B's vocabulary size + B id -> links)."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_aligned(a_path, b_path), "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                                    "n_group_links long, groups string, pairs map<long,long>")


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least power of two t such that at most ``most`` rows of ``counts`` have count >= t."""
    held = {r.e: r.n for r in counts.groupBy(F.floor(F.log2("count")).alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, t = 0, 64
    for e in range(63, -1, -1):
        total += held.get(e, 0)
        if total > most:
            break
        t = e
    return 1 << t if t < 63 else (1 << 63) - 1


def link_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """Corpus-wide links of each id pair: pair, count, best (the highest of its B id)."""
    counts = written(aligned.select(F.explode("pairs").alias("pair", "times")).groupBy("pair").agg(F.sum("times").alias("count")), "align-pairs")
    tops = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("count").alias("top"))
    scored = counts.join(tops, F.col("pair") % b_size == F.col("b"))
    return written(scored.select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "align-counts")


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """``alignments`` without pairs, but with a digest of the groups, n_best
    (links whose pair is its B id's most frequent, ties included) and count_sum
    (corpus counts summed over the links)."""
    b_size = aligner(a_path, b_path).b_bytes.count
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    base = alignments(docs, a_path, b_path).withColumn("groups_sha256", digest).drop("groups")
    base = written(base.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = link_counts(base, b_size)
    least = frequent_from(counts, frequent)
    common, rare = counts.filter(F.col("count") >= least), counts.filter(F.col("count") < least)
    rows = base.select("row", F.explode("pairs").alias("pair", "times"))
    near = rows.join(F.broadcast(common), "pair", "left")  # at most ``frequent`` rows, counted above
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    far = rows.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(rare, "pair")
    per_row = (near.filter("count is not null").groupBy("row").agg(*sums)
               .unionByName(far.groupBy("row").agg(*sums)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    out = base.drop("pairs").join(per_row, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
                      F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256", "n_group_links")


def op12_align(spark, sf_dir):
    return align_documents(table(spark, sf_dir, "documents"))
