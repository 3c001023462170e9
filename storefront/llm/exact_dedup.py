"""Exact dedup by deterministic block naming (operator 5).

Every text is lower-cased (A-Z only) and cut into fixed-size byte blocks. The
distinct blocks are sorted and numbered: a block's name is its rank, so two
blocks have one name exactly when they are equal. Names of adjacent blocks are
then paired, the distinct pairs are sorted and numbered the same way, and so on
until every document is down to one name. A document's identity is (number of
rounds, last name); equal identities mean equal texts, with no hash involved in
the decision: block contents are compared in full, and 64-bit keys only route
them. Keys under which different contents meet are found and told apart by a
second sort column.

Cases: null text is the empty text; the empty text has one empty block; rows
with one doc_id but different texts are separate rows; repeated rows count as
copies; a null doc_id takes part in its group but is never the kept one unless
all ids of the group are null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storefront.llm.common import bounded_batches, dense_names, pieces, raw_texts, same, written

BLOCK_BYTES = 2048


def _blocks(text: bytes, size: int) -> list[bytes]:
    return [text[i:i + size] for i in range(0, len(text), size)] or [b""]


def _key(data: bytes, bits: int = 64) -> int:
    """Routing key of a block; equal keys of different blocks are told apart later."""
    x = xxhash.xxh3_64_intdigest(data) >> (64 - bits)
    return x - (1 << 64) if x >= 1 << 63 else x


def _contents(size: int, bits: int):
    def run(batches):
        for batch in pieces(batches, "text"):
            found = {b for t in raw_texts(batch, "text") for b in _blocks(t.lower(), size)}
            keys = [_key(b, bits) for b in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(list(found), pa.binary())],
                                             names=["h", "block"])
    return run


def _documents(size: int, bits: int):
    def run(batches):
        for batch in pieces(batches, "text"):
            th, sha, hs = [], [], []
            for t in raw_texts(batch, "text"):
                t = t.lower()
                th.append(_key(t))
                sha.append(hashlib.sha256(t).hexdigest())
                hs.append([_key(b, bits) for b in _blocks(t, size)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(th, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(hs, pa.list_(pa.int64()))], names=["doc_id", "th", "text_sha256", "hs"])
    return run


def _block_rows(size: int, bits: int):
    """(doc_id, th, pos, h, block) of the blocks themselves."""
    def run(batches):
        for batch in pieces(batches, "text"):
            ids = batch.column(0).to_pylist()
            rows = [(i, _key(t), p, _key(b, bits), b)
                    for i, t in zip(ids, map(bytes.lower, raw_texts(batch, "text")))
                    for p, b in enumerate(_blocks(t, size))]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())],
                names=["doc_id", "th", "pos", "h", "block"])
    return run


def text_identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, th, text_sha256, rounds, name.
    (rounds, name) is equal exactly for equal lower-cased texts, whatever the
    number of bits of the routing keys."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    # Distinct block contents per routing key: contents cross the network once.
    distinct = src.mapInArrow(_contents(block_bytes, key_bits), "h long, block binary").groupBy("h", "block").agg(F.lit(1).alias("x"))
    keys = written(distinct.groupBy("h").agg(F.count("x").alias("contents")), "block-keys")
    per_doc = written(src.mapInArrow(_documents(block_bytes, key_bits),
                                     "doc_id long, th long, text_sha256 string, hs array<long>"), "block-docs")
    blocks = (per_doc.select("doc_id", "th", F.size("hs").alias("nb"), F.posexplode("hs").alias("pos", "h"))
              .dropDuplicates(["doc_id", "th", "pos"]))

    met = keys.filter("contents > 1").select("h")
    if met.isEmpty():
        names = dense_names(keys.select("h"), ["h"], "block-names")
        level = blocks.join(names, "h").select("doc_id", "th", "nb", F.col("pos").cast("long").alias("pos"), "name")
    else:
        # Different contents under one key: number the contents of such a key too.
        own = src.mapInArrow(_block_rows(block_bytes, key_bits), "doc_id long, th long, pos long, h long, block binary")
        own = own.join(met, "h", "left_semi").dropDuplicates(["doc_id", "th", "pos"])
        tied = (own.select("h", "block").distinct()
                .withColumn("tie", F.row_number().over(Window.partitionBy("h").orderBy("block")).cast("long")))
        tied = written(tied, "block-ties")
        every = keys.filter("contents = 1").select("h", F.lit(0).cast("long").alias("tie")).union(tied.select("h", "tie"))
        names = dense_names(every, ["h", "tie"], "block-names")
        ties = own.join(tied, ["h", "block"]).select("doc_id", "th", "pos", "tie")
        level = (blocks.join(ties, same(blocks, ties, ["doc_id", "th", "pos"]), "left")
                 .select(blocks["doc_id"], blocks["th"], "nb", blocks["pos"].cast("long").alias("pos"), "h",
                         F.coalesce("tie", F.lit(0)).alias("tie"))
                 .join(names, ["h", "tie"]).select("doc_id", "th", "nb", "pos", "name"))

    level = written(level, "level-0")
    done = [level.filter("nb = 1").select("doc_id", "th", F.lit(0).alias("rounds"), "name")]
    most = per_doc.agg(F.max(F.size("hs")).alias("m")).first()["m"] or 1
    rounds = 0
    while most > 1:
        rounds += 1
        most = (most + 1) // 2
        left, right = F.col("pos") % 2 == 0, F.col("pos") % 2 == 1
        pairs = (level.filter("nb > 1")
                 .groupBy("doc_id", "th", F.shiftright("pos", 1).alias("pos"))
                 .agg(F.max("nb").alias("nb"), F.max(F.when(left, F.col("name"))).alias("a"),
                      F.coalesce(F.max(F.when(right, F.col("name"))), F.lit(-1)).alias("b")))
        pairs = written(pairs, f"pairs-{rounds}")
        names = dense_names(pairs.select("a", "b").distinct(), ["a", "b"], f"pair-names-{rounds}")
        level = written(pairs.join(names, ["a", "b"])
                        .select("doc_id", "th", ((F.col("nb") + 1) / 2).cast("int").alias("nb"), "pos", "name"),
                        f"level-{rounds}")
        done.append(level.filter("nb = 1").select("doc_id", "th", F.lit(rounds).alias("rounds"), "name"))
    ids = done[0]
    for d in done[1:]:
        ids = ids.unionByName(d)
    rows = per_doc.select("doc_id", "th", "text_sha256")
    return rows.join(ids, same(rows, ids, ["doc_id", "th"])).select(rows["doc_id"], rows["th"], "text_sha256",
                                                                    "rounds", "name")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (the largest doc_id with
    that text), group_size, kept, text_sha256, rounds, name."""
    ids = written(text_identities(docs, block_bytes, key_bits), "identities")
    # Written, so that both sides of the join are shuffles and a large group can be split.
    groups = written(ids.groupBy("rounds", "name").agg(F.max("doc_id").alias("keep_id"),
                                                       F.count(F.lit(1)).alias("group_size")), "groups")
    return (ids.join(groups, ["rounds", "name"])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256", "rounds", "name"))


def op5_exact_dedup(spark, sf_dir):
    from storefront.llm.common import table
    return (exact_duplicates(table(spark, sf_dir, "documents"))
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
