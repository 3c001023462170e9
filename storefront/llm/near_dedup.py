"""MinHash near-dedup on SetSketch registers (operator 1).

Documents with one word sequence are one node, so groups of copies never
spread. Each node's shingle set gets a SetSketch; bands of register values are
the candidate buckets. Candidate pairs are first estimated jointly by maximum
likelihood from both sketches, then confirmed on the full shingle sets.

A bucket never emits all its pairs. First every member meets the bucket's
leader, its member with the most neighbours in all its buckets: in a group of
near copies of one text, the copies next to that text. Confirmed links are
closed to components, and only buckets that still hold several components go on.

Their members are dealt anew by their rarest shingles (prefix filter): two
linked sets share so many shingles that, with all shingles in one order, rare
ones first, they also share one of their first few, at places that leave enough
to share after it. This is exact. A copy that is too far from its group has its
own shingles first and meets nobody, so a group whose copies are not linked
makes no pairs. Within a shingle, members outside its largest component meet,
in rounds of growing size, every member of another component. Each remaining
pair is tested in some round unless its two sides were joined before, so no link
that matters is lost and nothing is capped. Buckets, shingles, pairs, links and
components stay distributed.

At the default 24 bands of 4 registers a pair at similarity 0.8 shares no
bucket with probability 3e-6, and falls below the estimate's margin (5 standard
deviations) with probability 1e-6 at most; shingles are 64-bit keys.

Cases: null and wordless texts have empty sets and are linked with nothing;
fewer words than a shingle: the whole sequence is the one shingle; rows with
one doc_id but different texts are separate rows; a null doc_id is linked but
never the component's id unless all its ids are null; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storefront.llm.common import bounded_batches, pieces, raw_texts, written
from storefront.llm.components import components
from storefront.llm.setsketch import joint_estimate, shingle_set, sketches, word_digest, words_of

REGISTERS, BAND = 96, 4
PERCENT = 80
#: Leaders of a shingle in the first round after the stars; rounds grow by GROWTH.
FIRST_LEADERS, GROWTH = 64, 16


def _sketch_rows(shingle: int, registers: int):
    def run(batches):
        for batch in pieces(batches, "text", 4 << 20):
            sigs, sets = [], []
            for t in raw_texts(batch, "text"):
                words = words_of(t)
                sigs.append(word_digest(words))
                sets.append(shingle_set(words, shingle))
            found = sketches(sets, registers)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sigs, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([row.tobytes() for row in found], pa.binary())],
                names=["doc_id", "row", "node", "n_shingles", "sketch"])
    return run


def _estimated(margin: float, percent: int):
    """Keep pairs whose estimate and sizes leave the threshold within reach."""
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            ok = joint_estimate(a, b, n_a.astype(float), n_b.astype(float)) >= percent / 100 - margin
            ok &= 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))],
                                             names=["a", "b"])
    return run


def _confirmed(shingle: int, percent: int):
    """Keep pairs with 100 * |intersection| >= percent * |union| on full sets."""
    def run(batches):
        memo: dict[bytes, np.ndarray] = {}

        def full_set(node: bytes, text: bytes) -> np.ndarray:
            if node not in memo:
                if len(memo) >= 64:
                    memo.clear()
                memo[node] = shingle_set(words_of(text), shingle)
            return memo[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = (batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
            ok = []
            for x, y, tx, ty in zip(a, b, ta, tb):
                sx, sy = full_set(x, tx), full_set(y, ty)
                both = len(np.intersect1d(sx, sy, assume_unique=True))
                ok.append(100 * both >= percent * (len(sx) + len(sy) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])
    return run


class _Verifier:
    """Confirms candidate pairs (a, b) of nodes."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, shingle: int, percent: int, margin: float):
        self.nodes, self.texts = nodes, texts
        self.estimate = _estimated(margin, percent)
        self.confirm = _confirmed(shingle, percent)

    def links(self, pairs: DataFrame, label: str) -> DataFrame:
        a = self.nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
        b = self.nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
        close = (pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb", "na", "nb")
                 .mapInArrow(self.estimate, "a binary, b binary"))
        close = written(close, f"{label}-close")
        ta = self.texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        tb = self.texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        full = close.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
        return written(full.mapInArrow(self.confirm, "a binary, b binary"), f"{label}-links")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT, registers: int = REGISTERS,
                    band: int = BAND, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least
    doc_id reachable over links, the own one included), kept, group (the
    component's node, equal within a component), and ``row``, if given: a
    column of 64-bit row keys that is passed on."""
    spark = docs.sparkSession
    bounded_batches(spark)
    margin = 5.0 * (percent / 100 * (1 - percent / 100) / registers) ** 0.5
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      (F.col(row) if row else F.lit(0)).cast("long").alias("row"))
    base = written(src.mapInArrow(_sketch_rows(shingle, registers),
                                  "doc_id long, row long, node binary, n_shingles long, sketch binary"), "sketches")
    nodes = written(base.filter("n_shingles > 0").groupBy("node")
                    .agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("x"))
                    .select("node", "x.doc_id", "x.n_shingles", "x.sketch"), "nodes")

    width = 2 * band
    bands = F.transform(F.sequence(F.lit(0), F.lit(registers // band - 1)),
                        lambda i: F.xxhash64(i, F.substr(F.col("sketch"), i * width + 1, F.lit(width))))
    rows = nodes.select("node", F.explode(bands).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(rows.join(shared, "bucket"), "members")

    # One text for every node that shares a bucket.
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("doc_id").alias("_id")), "node")
    text_rows = src.join(wanted, src["doc_id"].eqNullSafe(wanted["_id"])).select("node", "text")
    texts = written(text_rows.mapInArrow(_own_texts, "node binary, text string").dropDuplicates(["node"])
                    .withColumn("id", F.monotonically_increasing_id()), "texts")
    verifier = _Verifier(nodes, texts, shingle, percent, margin)

    near = members.groupBy("node").agg(F.sum("n").alias("near"))
    leaders = (members.select("bucket", "node").join(near, "node").groupBy("bucket")
               .agg(F.max(F.struct("near", "node")).alias("most")).select("bucket", F.col("most.node").alias("leader")))
    stars = (members.select("bucket", "node").join(leaders, "bucket").filter("node != leader")
             .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    comps = written(components(verifier.links(stars, "star"), "star-components"), "comps")

    # Members of buckets that still hold several components, by their rarest shingles.
    labelled = _with_component(members.select("bucket", "node"), comps)
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high")
    open_nodes = labelled.join(mixed.select("bucket"), "bucket", "left_semi").select("node").distinct()
    firsts = written(_first_shingles(texts.join(open_nodes, "node", "left_semi"), shingle, percent), "firsts")
    per_comp = _with_component(firsts, comps).groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = (per_comp.groupBy("shingle").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"))
             .filter("comps > 1").select("shingle", F.col("most.comp").alias("main"), (F.col("n") - F.col("most.n")).alias("outside")))
    rest = _with_component(firsts, comps).join(mixed, "shingle").select(
        "shingle", "node", "size", "place", (F.col("comp") != F.col("main")).alias("out"), "outside",
        (F.abs(F.xxhash64("node", F.lit(7)) % F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("at"))
    rest = written(rest, "rest")
    most = rest.agg(F.max("outside")).first()[0] or 0
    tested = 0.0  # leaders per shingle tested so far
    while tested < most:
        reach = float(FIRST_LEADERS) if tested == 0 else tested * GROWTH
        now = _with_component(rest, comps)
        share = F.col("at") * F.col("outside")
        x = now.filter(F.col("out") & (share >= F.lit(tested)) & (share < F.lit(reach))).alias("x")
        y = now.alias("y")
        # What the two can share from this shingle on.
        both = 1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
        within = (100 + percent) * both >= percent * (F.col("x.size") + F.col("y.size"))
        pairs = (x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.comp") != F.col("y.comp")) & within)
                 .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
        new = verifier.links(pairs, f"round-{reach:g}")
        if not new.isEmpty():
            comps = written(_joined(comps, new), "comps")
        tested = reach

    rows = base.select("doc_id", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    # Wordless rows are on their own: their group is their id.
    labelled = rows.join(comps, "node", "left").select(
        "doc_id", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "node")).alias("group"))
    labelled = written(labelled, "labelled")
    least = labelled.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min("doc_id").alias("least_id"))
    least = written(least, "least")
    done = labelled.join(least, "group", "left")
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    return done.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.col("doc_id").eqNullSafe(component).alias("kept"), "group", *([F.col("row").alias(row)] if row else []))


def _with_component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` after more ``links``: their components are the nodes to close."""
    ends = [_with_component(links.select("a", "b", F.col(c).alias("node")), comps).select("a", "b", F.col("comp").alias(f"c{c}"))
            for c in ("a", "b")]
    moved = written(components(ends[0].join(ends[1], ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "moved")
    to = moved.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return (comps.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
            .union(moved.join(comps, "node", "left_anti").select("node", "comp")))


def _shingle_rows(shingle: int):
    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            sets = [shingle_set(words_of(t), shingle) for t in raw_texts(batch, "text")]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))],
                names=["id", "size", "shingle"])
    return run


def _first_shingles(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, size, shingle, place): the first size - least + 1 shingles of each
    set of ``texts`` (id, node, text), the order being by number of sets, then
    key; ``least`` is the least number of shingles that a linked set shares.
    ``place`` counts from 1. Shingles of one set only link nothing: they are
    counted but left out."""
    rows = texts.select("id", "text").mapInArrow(_shingle_rows(shingle), "id long, size long, shingle long")
    rows = rows.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).filter("sets > 1")
    sets = (rows.groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("sets", "shingle"))).alias("shared"))
            .withColumn("own", F.col("size") - F.size("shared"))
            .withColumn("first", F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - F.col("own")).filter("first > 0"))
    first = sets.select("id", "size", "own", F.posexplode(F.slice("shared", F.lit(1), F.col("first").cast("int"))).alias("at", "s"))
    return (first.select("id", "size", F.col("s.shingle").alias("shingle"), (F.col("own") + F.col("at") + 1).alias("place"))
            .join(texts.select("id", "node"), "id").drop("id"))


def _own_texts(batches):
    """Of (node, text) rows, those whose text has that node's word sequence."""
    for whole in batches:
        for batch in pieces([whole], "text"):
            ok = [word_digest(words_of(t)) == n for n, t in zip(batch.column(0).to_pylist(), raw_texts(batch, "text"))]
            yield batch.filter(pa.array(ok, pa.bool_()))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: every wordless row, and one
    row of each component, the one with the least doc_id (a null one last).
    Rows are told apart by a key of their own that is written first."""
    keyed = written(docs.withColumn("_row_key", F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed, shingle, percent, row="_row_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_row_key"))
    stays = (found.filter("group is not null").groupBy("group").agg(first.alias("first")).select("first._row_key")
             .unionByName(found.filter("group is null").select("_row_key")))
    return keyed.join(stays, "_row_key", "left_semi").select(*docs.columns)


def op1_near_dedup(spark, sf_dir):
    from storefront.llm.common import table
    return (near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
            .select("doc_id", "n_shingles", "component_id", "kept"))
