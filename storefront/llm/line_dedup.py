"""Reversible line dedup on sharded cuckoo filters (operator 8).

An index holds, for every line key, exact reference counts: which documents
have it (``refs``) and how many and which is the last (``counts``). A key in at
least ``min_docs`` documents is repeated; each shard of the key space has a
cuckoo filter of its repeated keys. ``insert`` and ``delete`` of documents
change the exact tables of the touched keys, and put keys into the filters or
take them out as they cross the threshold, so a deletion restores lines.

Rewriting a text drops the lines of repeated keys except in the key's last
document. A line's shard asks its filter first; only hits are looked up in the
exact table. Keys that hold a ten-thousandth of all references or more are at
most ten thousand keys, so they are known to every task and their lines never
meet in one shard. Keys are 128-bit digests of the normalised line.

Cases: null or empty text is one empty line; keys below ``min_chars`` code
points are never dropped; a key counts once per doc_id, however many of its
lines or rows have it; documents without id count as one document; repeated
rows are rewritten alike; an empty table gives an empty index and result;
extra columns are ignored (``drop_repeated_lines`` keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storefront.llm.common import bounded_batches, pieces, raw_texts, same, table, written
from storefront.llm.cuckoo import CuckooFilter, FilterFull, filter_of

MIN_CHARS, MIN_DOCS = 20, 3
#: A key with at least this share of all references is known to every task.
HOT_SHARE = 10_000
REFS_PER_SHARD = 100_000
KEY = ["k1", "k2"]


def line_key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """128-bit key of a line, or None for a short one."""
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    digest = xxhash.xxh3_128_intdigest(key)
    a, b = digest >> 64, digest & 0xFFFFFFFFFFFFFFFF
    return (a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b)


def _keys_of(batch: pa.RecordBatch, min_chars: int) -> list[tuple]:
    """Distinct (doc_id, k1, k2) of a batch's rows."""
    out = []
    for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch, "text")):
        out.extend((doc_id, *k) for k in {line_key(x, min_chars) for x in text.split(b"\n")} if k is not None)
    return out


def _longs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def _source(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def line_references(docs: DataFrame, min_chars: int) -> DataFrame:
    """Distinct (doc_id, k1, k2)."""
    def run(batches):
        for batch in pieces(batches, "text"):
            yield _longs(_keys_of(batch, min_chars), ["doc_id", *KEY])
    return _source(docs).mapInArrow(run, "doc_id long, k1 long, k2 long").distinct()


@dataclass
class LineIndex:
    """Exact tables and filters; ``shards`` is fixed when the index is built."""
    refs: DataFrame      # doc_id, k1, k2
    counts: DataFrame    # k1, k2, docs, last
    filters: DataFrame   # shard, slots
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    def repeated(self) -> DataFrame:
        return _sharded(self.counts.filter(F.col("docs") >= self.min_docs), self.shards)


def _sharded(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))


def _counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return pdf["k1"].to_numpy(np.int64), pdf["k2"].to_numpy(np.int64)


def _build_filter(key, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [key[0]], "slots": [filter_of(*_arrays(pdf)).to_bytes()]})


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    refs = written(line_references(docs, min_chars), "line-refs")
    shards = max(64, -(-refs.count() // REFS_PER_SHARD))
    counts = written(_counts(refs), "line-counts")
    repeated = _sharded(counts.filter(F.col("docs") >= min_docs), shards)
    filters = written(repeated.select("shard", *KEY).groupBy("shard").applyInPandas(_build_filter, "shard int, slots binary"),
                      "line-filters")
    return LineIndex(refs, counts, filters, shards, min_chars, min_docs)


def _changed_filters(index: LineIndex, counts: DataFrame, changes: DataFrame) -> DataFrame:
    """Filters after ``changes`` (k1, k2, now: whether the key is repeated now)."""
    after = _sharded(counts.filter(F.col("docs") >= index.min_docs), index.shards)
    touched = _sharded(changes, index.shards).withColumn("kind", F.lit(1))
    whole = (after.select("shard", *KEY).join(touched.select("shard").distinct(), "shard", "left_semi")
             .withColumn("now", F.lit(True)).withColumn("kind", F.lit(0)))

    def update(key, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) == 0:
            return old
        change, all_keys = rows[rows.kind == 1], rows[rows.kind == 0]
        found = CuckooFilter(slots=old["slots"].iloc[0]) if len(old) else filter_of(*_arrays(all_keys.iloc[:0]))
        try:
            found.delete(*_arrays(change[~change.now.astype(bool)]))
            found.insert(*_arrays(change[change.now.astype(bool)]))
        except FilterFull:
            found = filter_of(*_arrays(all_keys))
        return pd.DataFrame({"shard": [key[0]], "slots": [found.to_bytes()]})

    rows = whole.unionByName(touched.select("shard", *KEY, "now", "kind"))
    return (index.filters.groupBy("shard").cogroup(rows.groupBy("shard"))
            .applyInPandas(update, "shard int, slots binary"))


def _after(index: LineIndex, refs: DataFrame, touched: DataFrame, label: str) -> LineIndex:
    """The index with ``refs``, of which only the keys of ``touched`` changed."""
    refs = written(refs, f"line-refs-{label}")
    fresh = _counts(refs.join(touched, KEY, "left_semi"))
    counts = written(index.counts.join(touched, KEY, "left_anti").unionByName(fresh), f"line-counts-{label}")
    was = index.counts.join(touched, KEY, "left_semi").select(*KEY, F.col("docs").alias("was"))
    changes = (touched.join(was, KEY, "left").join(fresh.select(*KEY, "docs"), KEY, "left")
               .select(*KEY, (F.coalesce("was", F.lit(0)) >= index.min_docs).alias("before"),
                       (F.coalesce("docs", F.lit(0)) >= index.min_docs).alias("now"))
               .filter("before != now").select(*KEY, "now"))
    filters = written(_changed_filters(index, counts, changes), f"line-filters-{label}")
    return LineIndex(refs, counts, filters, index.shards, index.min_chars, index.min_docs)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """Add documents; a doc_id that is there already gains the lines it lacked."""
    new = line_references(docs, index.min_chars)
    new = written(new.join(index.refs, same(new, index.refs, ["doc_id", *KEY]), "left_anti"), "line-new")
    return _after(index, index.refs.unionByName(new), new.select(*KEY).distinct(), "in")


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """Take documents out (column doc_id); lines that are no longer repeated come back."""
    ids = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    gone = same(index.refs, ids, ["doc_id"])
    touched = written(index.refs.join(ids, gone, "left_semi").select(*KEY).distinct(), "line-gone")
    return _after(index, index.refs.join(ids, gone, "left_anti"), touched, "out")


def _look_up(min_chars: int, hot):
    """Lines of hot keys are decided here; the others go to their shard."""
    def run(batches):
        last = hot.value
        for batch in pieces(batches, "text"):
            rows = []
            for doc_id, k1, k2 in _keys_of(batch, min_chars):
                if (k1, k2) not in last:
                    rows.append((doc_id, k1, k2, 0))
                elif last[k1, k2] != doc_id:
                    rows.append((doc_id, k1, k2, 1))
            yield _longs(rows, ["doc_id", *KEY, "hot"])
    return run


def _in_shard(key, lines: pd.DataFrame, exact: pd.DataFrame) -> pd.DataFrame:
    """Of a shard's lines, those to drop: the filter first, then the exact table."""
    none = lines.iloc[:0][["doc_id", "no_id", *KEY]]
    if len(lines) == 0 or len(exact) == 0:
        return none
    kept = CuckooFilter(slots=exact.loc[exact.slots.notna(), "slots"].iloc[0])
    lines = lines[kept.contains(*_arrays(lines))]
    known = exact[exact.slots.isna()][[*KEY, "last", "no_last"]]
    met = lines.merge(known, on=KEY, how="inner")
    same_doc = (met["doc_id"] == met["last"]) & (met["no_id"] == met["no_last"])
    return met.loc[~same_doc, ["doc_id", "no_id", *KEY]]


def dropped_keys(docs: DataFrame, index: LineIndex) -> DataFrame:
    """(doc_id, k1, k2) of the keys whose lines a document loses."""
    spark = docs.sparkSession
    total = index.counts.agg(F.sum("docs")).first()[0] or 0
    repeated = index.repeated()
    is_hot = F.col("docs") >= max(index.min_docs, -(-total // HOT_SHARE))
    hot_rows = repeated.filter(is_hot).select(*KEY, "last").collect()  # at most HOT_SHARE keys
    hot = spark.sparkContext.broadcast({(r.k1, r.k2): r.last for r in hot_rows})
    lines = _source(docs).mapInArrow(_look_up(index.min_chars, hot), "doc_id long, k1 long, k2 long, hot long")
    lines = written(lines, "line-lookups")
    # Ids go to pandas without nulls: nullable integers would lose digits there.
    known = repeated.filter(~is_hot).select("shard", *KEY, F.coalesce("last", F.lit(0)).alias("last"),
                                            F.col("last").isNull().alias("no_last"), F.lit(None).cast("binary").alias("slots"))
    zero = F.lit(0).cast("long")
    exact = known.union(index.filters.select("shard", zero, zero, zero, F.lit(False), "slots"))
    cold = _sharded(lines.filter("hot = 0"), index.shards).select(
        "shard", *KEY, F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"))
    found = (cold.groupBy("shard").cogroup(exact.groupBy("shard"))
             .applyInPandas(_in_shard, "doc_id long, no_id boolean, k1 long, k2 long")
             .select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), *KEY))
    return lines.filter("hot = 1").select("doc_id", *KEY).unionByName(found).distinct()


def rewrite(docs: DataFrame, index: LineIndex) -> DataFrame:
    """``docs`` (all columns) with ``text`` replaced by the lines that stay,
    and line_count and dropped_count added."""
    drops = (dropped_keys(docs, index).groupBy(F.col("doc_id").alias("_doc"))
             .agg(F.collect_list(F.struct(*KEY)).alias("_drops")))
    joined = docs.join(drops, docs["doc_id"].cast("long").eqNullSafe(drops["_doc"]), "left").drop("_doc")
    names = docs.columns
    at = names.index("text")
    fields = [T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema]
    schema = T.StructType([*fields, T.StructField("line_count", T.LongType()), T.StructField("dropped_count", T.LongType())])
    min_chars = index.min_chars

    def run(batches):
        for batch in pieces(batches, "text"):
            texts, counts, gone = [], [], []
            for text, drop in zip(raw_texts(batch, "text"), batch.column(len(names)).to_pylist()):
                lines = text.split(b"\n")
                stay = lines
                if drop:
                    out = {(d["k1"], d["k2"]) for d in drop}
                    stay = [x for x in lines if line_key(x, min_chars) not in out]
                texts.append(b"\n".join(stay))
                counts.append(len(lines))
                gone.append(len(lines) - len(stay))
            cols = [batch.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs``, same columns, without the lines that other
    documents repeat. ``n_chars``, if there, is counted anew."""
    out = rewrite(docs, build_index(docs, min_chars, min_docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op8_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rewrite(docs, build_index(docs)).select(
        "doc_id", F.col("line_count").alias("n_lines"), F.col("dropped_count").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
