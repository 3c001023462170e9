"""SimHash near-dedup by segment popcounts (operator 11).

A document's fingerprint has 64 bits: a bit is set if it is set in over half the
hashes of its shingles, repeats included. Documents with one fingerprint are one
node, so groups of exact copies never spread. Nodes at DISTANCE or fewer
differing bits are linked.

Embedding: a fingerprint becomes the vector of the bit counts of its 16 segments
of 4 bits. The Manhattan distance of two vectors never exceeds the Hamming
distance of their fingerprints, so a grid range-join over the vectors finds every
link: each node goes to the grid cell of its own vector and to the cells one
step away (33 at most), and two vectors at Manhattan distance 2 or less meet in a
cell at most one step from both. Cells with one node are dropped.

Verification is exact and emits no pairs of a cell: in a shared cell a node names
the points of that cell at Hamming distance 1 or less from itself (itself, or one
bit of the stepped segment flipped: 4 at most). Two fingerprints are at distance
2 or less exactly if they name a common point, and a point is named by at most
65 fingerprints. Each point links its members to its least one; a last filter
compares the bits. All tables are linear in the number of distinct fingerprints.

Cases: null and wordless texts have fingerprint zero, linked like any other;
fewer words than a shingle: the whole sequence is the one shingle; repeated rows
and rows with one doc_id are separate rows of the result; a null doc_id is never
a component's id unless all its ids are null; an empty table gives an empty
result; extra columns are ignored; very long texts are hashed in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storefront.llm.common import bounded_batches, pieces, raw_texts, table, written
from storefront.llm.components import components

SHINGLE, SEED = 3, 42
SEGMENTS, SEGMENT_BITS = 16, 4
#: Two steps of one bit: what meeting points one bit away decide.
DISTANCE = 2
#: Shingles hashed at a time; bounds the memory of very long texts.
BLOCK = 1 << 16


def bit_votes(words: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each bit (highest first), and how many shingles there are."""
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    if not words:
        return votes, 0
    width = min(shingle, len(words))
    count = len(words) - width + 1
    for at in range(0, count, BLOCK):
        part = words[at:at + BLOCK + width - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(part) - width + 1
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1:].tolist())])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return votes, count


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number."""
    votes, count = bit_votes(text.lower().split(), shingle)
    return int.from_bytes(np.packbits(2 * votes > count).tobytes(), "big")


def _fingerprint_rows(shingle: int):
    def run(batches):
        for batch in pieces(batches, "text", 4 << 20):
            found = np.array([fingerprint(t, shingle) for t in raw_texts(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])
    return run


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 4-bit segments, each in its own 4 bits (uint64 in and out)."""
    m1, m2 = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333)
    one, two = np.uint64(1), np.uint64(2)
    x = fps - ((fps >> one) & m1)
    return (x & m2) + ((x >> two) & m2)


def _grid_rows(batches):
    """(cell, fp): the cell of each fingerprint's vector and those one step away."""
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        own = segment_counts(fps)
        cells, who = [own], [fps]
        for s in range(SEGMENTS):
            step, count = np.uint64(1 << 4 * s), (own >> np.uint64(4 * s)) & np.uint64(15)
            up, down = count < SEGMENT_BITS, count > 0
            cells += [own[up] + step, own[down] - step]
            who += [fps[up], fps[down]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (cells, who)], names=["cell", "fp"])


def _meeting_points(batches):
    """(point, fp): the points of a cell at most one bit away from a fingerprint in it."""
    for batch in batches:
        cell, fps = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        own = segment_counts(fps)
        at_home = cell == own
        points, who = [fps[at_home]], [fps[at_home]]
        for s in range(SEGMENTS):
            step = np.uint64(1 << 4 * s)
            up, down = cell == own + step, cell == own - step
            for b in range(SEGMENT_BITS):
                bit = np.uint64(1 << (4 * s + b))
                flips = (up & (fps & bit == 0)) | (down & (fps & bit != 0))
                points.append(fps[flips] ^ bit)
                who.append(fps[flips])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (points, who)], names=["point", "fp"])


def close_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct 64-bit ``fp`` values of ``fps``: every
    pair at distance DISTANCE or less is joined by a chain of them, and each link is such a pair."""
    grid = fps.select("fp").mapInArrow(_grid_rows, "cell long, fp long")
    shared = grid.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell")
    members = grid.join(written(shared, "simhash-cells"), "cell", "left_semi")
    points = written(members.select("cell", "fp").mapInArrow(_meeting_points, "point long, fp long"), "simhash-points")
    met = points.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a")).filter("n > 1").select("point", "a")
    links = points.join(met, "point").filter("fp != a").select("a", F.col("fp").alias("b")).distinct()
    return links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (64 bits as a long), component_id
    (least doc_id reachable over links, the own one included)."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = written(src.mapInArrow(_fingerprint_rows(shingle), "doc_id long, fp long"), "simhash")
    nodes = written(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    comps = written(components(written(close_links(nodes), "simhash-links"), "simhash-components"), "simhash-comps")
    labelled = nodes.join(comps, nodes["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    tops = labelled.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = written(labelled.join(tops, "comp").select("fp", "component_id"), "simhash-ids")
    return base.join(ids, "fp").select("doc_id", "fp", "component_id")


def op11_simhash(spark, sf_dir):
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
