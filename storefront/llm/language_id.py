"""Language identification by a bidirectional GRU over bytes (operator 6).

The network (see ``gru``) is trained on a bounded sample: at most ``per_language``
documents of every language, fewer if there are very many languages. Every
document is read whole, in segments of 64 bytes; each letter position gets
label probabilities, and the mean log-probabilities over all of them are the
document's.

Cases: ``und`` with score 0 if the text is null or has no letter; without
labelled rows every document is ``und``; repeated rows are labelled alike; a
null doc_id is labelled too but not learned from; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storefront.llm import gru
from storefront.llm.common import bounded_batches, pieces, raw_texts, remainder, table
from storefront.llm.sampling import MAX_TRAIN_CHARS

#: Bound of the training sample, in documents: with many languages each gets
#: fewer, but at least one.
MAX_SAMPLE = 64 * 300
#: Languages that the network's smallest size and shortest training are for.
FEW_LANGUAGES = 64
UNKNOWN = "und"
_SPAN = 1 << 30


def language_sample(docs: DataFrame, per_language: int) -> list:
    """At most ``per_language`` rows (text, lang) of every language, those with
    the least keyed hash; of a text of more than MAX_TRAIN_CHARS, a piece."""
    usable = docs.filter("doc_id is not null and lang is not null and text is not null").filter(F.length("text") >= 1)
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = counts.count()
    if not languages:
        return []
    per_language = max(1, min(per_language, MAX_SAMPLE // languages))
    # So many rows pass the hash threshold of their language that enough do.
    enough = 1.2 * per_language + 4 * per_language ** 0.5 + 20
    wanted = counts.select("lang", (F.least(F.lit(1.0), F.lit(enough) / F.col("n")) * F.lit(float(_SPAN))).alias("wanted"))
    at = F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(_SPAN))
    start = F.pmod(F.xxhash64("doc_id", "text", F.lit(29)), F.greatest(F.lit(1), F.length("text") - F.lit(MAX_TRAIN_CHARS - 1))) + 1
    piece = F.substring(F.col("text"), start.cast("int"), F.lit(MAX_TRAIN_CHARS))
    rows = (usable.withColumn("at", at).join(F.broadcast(wanted), "lang").filter(F.col("at") < F.col("wanted"))
            .select("doc_id", piece.alias("text"), "lang", "at").collect())
    rows.sort(key=lambda r: (r["lang"], r["at"], r["doc_id"]))
    taken, out = {}, []
    for r in rows:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_language:
            out.append(r)
    return out


def fit_languages(docs: DataFrame, per_language: int = 300, rounds: int = 500) -> tuple[list[str], dict] | None:
    """Languages and network learned from ``docs`` (doc_id, text, lang). Beyond
    FEW_LANGUAGES the network and its training grow with the languages."""
    rows = language_sample(docs, per_language)
    names = sorted({r["lang"] for r in rows})
    if not names:
        return None
    number = {name: i for i, name in enumerate(names)}
    more = max(1.0, len(names) / FEW_LANGUAGES)
    return names, gru.train([r["text"].encode() for r in rows], [number[r["lang"]] for r in rows], len(names),
                            round(rounds * more), hidden=round(gru.HIDDEN * more))


def identify(docs: DataFrame, model: tuple[list[str], dict] | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches):
        for batch in pieces(batches, "text", 2 << 20):
            texts = raw_texts(batch, "text")
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            lettered = [i for i, t in enumerate(texts) if any(c.isalpha() for c in t.decode("utf-8", "replace"))]
            if shared.value is not None and lettered:
                names, net = shared.value
                y = np.exp(gru.document_log_probabilities(net, [texts[i] for i in lettered]))
                y /= y.sum(axis=1, keepdims=True)
                for i, row in zip(lettered, y):
                    best = int(np.argmax(row))
                    lang[i], score[i] = names[best], float(row[best])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return src.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.select("doc_id", "text", "lang").filter(remainder("doc_id", 4) != 2))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
