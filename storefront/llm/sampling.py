"""Bounded training samples for the classifiers of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents longer than this take no part in training (they are scored whole).
MAX_TRAIN_CHARS = 40_000


def by_key(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """The ``size`` rows whose doc_id has the least keyed hash: a fixed sample."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(size)


def class_sample(docs: DataFrame, labels: DataFrame, per_class: dict[int, int], seed: int = 11) -> tuple[list, dict]:
    """At most ``per_class[c]`` training rows of each class c, 0 and 1.

    ``docs``: doc_id, text of rows that may be learned from. ``labels``: doc_id,
    label. Of several labels of a doc_id the largest counts; null labels and
    ids don't. Returns the rows (text, label) and, by class, how many labelled
    rows one sampled row stands for.
    """
    known = (labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
             .join(docs.filter("doc_id is not null").select("doc_id").distinct(), "doc_id"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for label in sorted(totals):
        part = by_key(known.filter(F.col("label") == label), per_class[label], seed)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return [], {}
    # At most sum(per_class) rows: their size is bounded, so they are broadcast.
    rows = (docs.join(F.broadcast(chosen), "doc_id").filter(F.length("text") <= MAX_TRAIN_CHARS)
            .select("doc_id", "text", "label").dropDuplicates(["doc_id"]).collect())
    rows.sort(key=lambda r: r["doc_id"])
    return rows, {label: max(1.0, n / per_class[label]) for label, n in totals.items()}
