"""Corpus pipeline over ``documents``.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), works on
all rows its predecessor kept and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``; the last one returns the token ids.

Every stage calls one operator of ``storefront.llm``; see there for how nulls,
empty and very long texts, ties, repeated rows, empty tables and extra columns
are handled. Every row stays or goes by its own verdict, whatever its doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storefront.llm.byte_bpe import round_trip
from storefront.llm.common import table, written
from storefront.llm.decontaminate import clean_rows
from storefront.llm.line_dedup import drop_repeated_lines
from storefront.llm.near_dedup import keep_first
from storefront.llm.toxicity import drop_toxic

#: A document goes if more than this share of its words lies in benchmark
#: windows; 0: if any window occurs in it.
MAX_BENCHMARK_SHARE = 0.0


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects (score 0.5 or more) go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the last one only;
    ``text`` and ``n_chars`` change, no row goes."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or
    more) one row stays, that with the least doc_id."""
    return keep_first(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    return clean_rows(docs, table(spark, sf_dir, "benchmark"), MAX_BENCHMARK_SHARE)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text read back from them: doc_id,
    lang, source, n_tokens, ids, text."""
    keys = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    out = round_trip(keys, key_col="row")
    return out.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.decode("decoded", "UTF-8").alias("text"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("benchmark decontamination", decontamination), ("byte-level BPE", tokenise)]

#: Trained scoring and sketches have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
