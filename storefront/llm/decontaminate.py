"""Benchmark decontamination by a prefix-filtered set join (operator 10),
DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item, or the whole item
if it is shorter. The tokens of the join are the two-word shingles of a window
(its only word, for one-word windows). Tokens are ordered by rarity, counted
over all documents. Whole containment needs every token, so the necessary
prefix of a window is its rarest token: only documents positions that hold it
are candidates. A candidate must leave room for the whole window before and
after (length and positional bounds), and the window's words are then compared
one by one with the document's words.

The benchmark's tokens are broadcast only if they are counted to be at most
``broadcast_tokens``; beyond that the same join shuffles. Windows that share a
token travel as one array, so a passage that very many documents contain gives
a few rows per document, not one per window.

Cases: null text has no words; documents without words and items without words
match nothing; repeated benchmark rows and windows count once; an item without
id is reported with an empty id; rows with one doc_id are checked each against
their own words; an empty table on either side gives no hits; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storefront.llm.common import lower_ascii, same, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def words_of(text: Column) -> Column:
    """Lower-cased words (A-Z only) of a text; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(lower_ascii(text))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _pair_token(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: words, length, items (array of item ids as text)."""
    items = (benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                              words_of(F.col("text")).alias("w"))
             .filter(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(window))))
    rows = items.select("item", "length", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("at"))
    return (rows.select("item", "length", F.slice("w", F.col("at"), F.col("length")).alias("words"))
            .groupBy("words", "length").agg(F.sort_array(F.collect_set("item")).alias("items")))


def _tokens_of_windows(windows: DataFrame) -> DataFrame:
    """(window columns, offset, token) for every token of a window."""
    pair = windows.filter("length > 1").withColumn(
        "t", F.explode(F.transform(F.sequence(F.lit(0), F.col("length") - 2), lambda i: F.struct(
            i.alias("offset"), _pair_token(F.get(F.col("words"), i), F.get(F.col("words"), i + 1)).alias("token")))))
    single = windows.filter("length = 1").withColumn(
        "t", F.struct(F.lit(0).alias("offset"), F.xxhash64(F.get(F.col("words"), F.lit(0))).alias("token")))
    return pair.unionByName(single).select("words", "length", "items", "t.offset", "t.token")


def _document_tokens(docs: DataFrame, single: bool) -> DataFrame:
    """(doc_id, n_words, pos, token) of documents."""
    d = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    if single:
        rows = d.select("doc_id", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "a"))
        return rows.select("doc_id", "n_words", "pos", F.xxhash64("a").alias("token"))
    nexts = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    rows = d.select("doc_id", F.size("w").alias("n_words"),
                    F.posexplode(F.arrays_zip(F.col("w").alias("a"), nexts.alias("b"))).alias("pos", "p"))
    return rows.filter("p.b is not null").select("doc_id", "n_words", "pos", _pair_token(F.col("p.a"), F.col("p.b")).alias("token"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  broadcast_tokens: int = 2_000_000, carry: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside an
    occurrence of a window), items (ids of the items hit, sorted as text),
    spans (array of start, length in words), contaminated, and the column
    ``carry``, if given."""
    more = [carry] if carry else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    windows = written(benchmark_windows(benchmark, window), "windows")
    tokens = _tokens_of_windows(windows)
    keys = written(tokens.select("token", (F.col("length") == 1).alias("single")).distinct(), "tokens")
    counts = {r["single"]: r["n"] for r in keys.groupBy("single").agg(F.count(F.lit(1)).alias("n")).collect()}

    # Occurrences of benchmark tokens in all documents: one pass over the texts.
    occurrences = None
    for single in (False, True):
        if single and single not in counts:
            continue
        side = keys.filter(F.col("single") == single).select("token")
        if counts.get(single, 0) <= broadcast_tokens:
            side = F.broadcast(side)
        rows = _document_tokens(docs, single).join(side, "token").withColumn("single", F.lit(single))
        occurrences = rows if occurrences is None else occurrences.unionByName(rows)
    occurrences = written(occurrences, "occurrences")

    # The rarest token of each window, ties to the leftmost.
    rarity = occurrences.groupBy("token", "single").agg(F.count(F.lit(1)).alias("n"))
    ranked = (tokens.withColumn("single", F.col("length") == 1).join(rarity, ["token", "single"], "left")
              .groupBy("words", "length", "items", "single")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "token")).alias("first")))
    anchors = (ranked.filter("first.n > 0")
               .groupBy(F.col("first.token").alias("token"), "single")
               .agg(F.collect_list(F.struct(F.col("first.offset").alias("offset"), "length", "words", "items")).alias("windows")))
    anchors = written(anchors, "anchors")

    near = occurrences.join(anchors, ["token", "single"]).select(
        "doc_id", "pos", F.filter("windows", lambda w: (F.col("pos") >= w["offset"])
                                  & (F.col("pos") - w["offset"] + w["length"] <= F.col("n_words"))).alias("windows"))
    per_doc = (near.filter(F.size("windows") > 0).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "windows")).alias("near")))

    joined = docs.join(per_doc, same(docs, per_doc, ["doc_id"]), "left").select(
        docs["doc_id"], words_of(docs["text"]).alias("w"), "near", *more)
    candidates = F.flatten(F.transform(F.coalesce("near", F.array().cast(per_doc.schema["near"].dataType)), lambda c: F.transform(
        c["windows"], lambda x: F.struct((c["pos"] - x["offset"]).alias("start"), x["length"].alias("length"),
                                         x["words"].alias("words"), x["items"].alias("items")))))
    found = joined.select("doc_id", *more, F.size("w").cast("long").alias("n_words"), F.filter(
        candidates, lambda c: F.slice(F.col("w"), c["start"] + 1, c["length"]) == c["words"]).alias("found"))
    spans = F.array_sort(F.array_distinct(F.transform("found", lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length")))))
    end = lambda s: s["start"] + s["length"]
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], end(s)).alias("end"),
                                (acc["n"] + F.greatest(F.lit(0), end(s) - F.greatest(acc["end"], s["start"]))).cast("long").alias("n")),
        lambda acc: acc["n"])
    return (found.select("doc_id", *more, "n_words", spans.alias("spans"),
                         F.array_sort(F.array_distinct(F.flatten(F.col("found.items")))).alias("items"))
            .select("doc_id", "n_words", covered.alias("n_hit"), "items", "spans", (F.size("spans") > 0).alias("contaminated"), *more))


def clean_documents(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, without every doc_id of which a row's
    share of hit words is above ``max_share`` (``clean_rows`` goes by row)."""
    bad = (contamination(docs, benchmark, window).filter(F.col("n_hit") > F.lit(max_share) * F.col("n_words"))
           .select(F.col("doc_id").alias("_bad")).distinct())
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]), "left_anti")


def clean_rows(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, whose own share of hit words is at most ``max_share``."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    found = contamination(whole, benchmark, window, carry="_row")
    return found.filter(F.col("n_hit") <= F.lit(max_share) * F.col("n_words")).select("_row.*")


def op10_decontamination(spark, sf_dir):
    from storefront.llm.common import table
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM bi),
di AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l),
dg AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS s FROM di),
hit AS (SELECT doc_id, l, i, item_id FROM dg JOIN bw USING (l, s)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
