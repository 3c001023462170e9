"""Windowed and stateful streams.

* R4: tumbling hourly volume by outcome, append mode: a window is emitted once
  the watermark (latest event time - delay) passes its end.
* R5: sliding-window alert expressions (M13 failure share, M14 pending count).
* R3: pending timeout as a watermarked stream-stream left outer join: a
  request with no callback within the time bound is emitted with NULL
  callback columns once the watermark passes, and flagged TIMEOUT.
* R6: running product rating (update mode), upserted into the products table
  in foreachBatch, one change set per batch id.
The state of R3-R5 is bounded by the watermarks, that of R6 by the number of
products; nothing is collected. A window is emitted when the watermark passes
its end: a source that ends sends a closing row a day later, which the reader
of the output leaves out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storefront.operators.payments import FAILURE_RATE_ALERT, OK, PENDING_ALERT
from storefront.sources.sinks import compact_if_large, newest_manifest, rows_for, start_log, write_snapshot
from storefront.streaming.common import event_time, wall_clock


def hourly_stream(txns: DataFrame, delay: str = "10 minutes", ts: str = "created_at") -> DataFrame:
    """Per hour: total, completed, failed, pending, amount (M6 as a stream)."""
    x = txns.withColumn("_et", event_time(ts)).withWatermark("_et", delay)
    g = x.groupBy(F.window("_et", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col("status") == "completed").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.sum("amount").cast("decimal(38,2)").alias("total_amount"))
    return g.select(wall_clock(F.col("w.start")).alias("hour"), "total_transactions", "successful", "failed",
                    "pending", "total_amount")


def alert_stream(txns: DataFrame, length: str = "1 hour", slide: str = "5 minutes", delay: str = "10 minutes",
                 pending_threshold: int = 50, ts: str = "created_at") -> DataFrame:
    """Per sliding window: counts, the failure-rate alert (failed share >
    10 %) and the pending alert (more than ``pending_threshold`` transactions
    pending that are older than 5 minutes at the window's end)."""
    x = txns.withColumn("_et", event_time(ts)).withWatermark("_et", delay)
    x = x.withColumn("w", F.window("_et", length, slide))
    g = x.groupBy("w").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if((F.col("status") == "pending") & (F.col("_et") < F.col("w.end") - F.expr("INTERVAL 5 MINUTES")))
        .alias("old"))
    head, tail = PENDING_ALERT.split("{n}")
    return g.select(
        wall_clock(F.col("w.start")).alias("window_start"), wall_clock(F.col("w.end")).alias("window_end"),
        "n", "failed", "pending",
        F.when((F.col("n") > 0) & (F.col("failed") * 10 > F.col("n")), F.lit(FAILURE_RATE_ALERT))
        .otherwise(F.lit(OK)).alias("failure_rate_alert"),
        F.when(F.col("old") > pending_threshold,
               F.concat(F.lit(head), F.col("old").cast("string"), F.lit(tail)))
        .otherwise(F.lit(OK)).alias("pending_alert"))


def timeouts(requests: DataFrame, callbacks: DataFrame, within: str = "30 minutes", delay: str = "10 minutes",
             req_ts: str = "created_at", cb_ts: str = "received_at") -> DataFrame:
    """Every request (checkout_request_id, created_at) joined to its
    callback (checkout_request_id, received_at) arriving within ``within``;
    requests without one come out with timed_out = true after the watermark."""
    r = (requests.select(F.col("checkout_request_id").alias("req_id"), F.col(req_ts).alias("created_at"),
                         event_time(req_ts).alias("_rt")).withWatermark("_rt", delay))
    c = (callbacks.select(F.col("checkout_request_id").alias("cb_id"), event_time(cb_ts).alias("_ct"),
                          F.col(cb_ts).alias("received_at")).withWatermark("_ct", delay))
    cond = ((F.col("req_id") == F.col("cb_id")) & (F.col("_ct") >= F.col("_rt"))
            & (F.col("_ct") <= F.col("_rt") + F.expr(f"INTERVAL {within}")))
    j = r.join(c, cond, "left_outer")
    return j.select(F.col("req_id").alias("checkout_request_id"), "created_at", "received_at",
                    F.col("cb_id").isNull().alias("timed_out"),
                    F.when(F.col("cb_id").isNull(), F.lit("TIMEOUT")).alias("result_code"))


def rating_stream(reviews: DataFrame) -> DataFrame:
    """Running review count and rating sum per product (update mode);
    ``apply_ratings`` turns a micro-batch of it into product rows."""
    return reviews.groupBy("product_id").agg(F.count(F.lit(1)).alias("review_count_all"),
                                             F.sum("rating").alias("rating_sum"))


def apply_ratings(products: DataFrame, batch: DataFrame, as_of=None) -> DataFrame:
    """R6 upsert: products in the batch get rating = sum / count rounded half
    up to 2 places (decimal(3,2)) and the count; updated_at = as_of."""
    from storefront.functions.scalar import ratio2, ts_lit
    b = batch.select("product_id", ratio2(F.col("rating_sum"), F.col("review_count_all")).cast("decimal(3,2)").alias(
        "_r"), F.col("review_count_all").cast("int").alias("_n"))
    p = products.join(b, "product_id", "left")
    hit = F.col("_n").isNotNull()
    p = p.withColumn("rating", F.when(hit, F.col("_r")).otherwise(F.col("rating"))).withColumn(
        "review_count", F.when(hit, F.col("_n")).otherwise(F.col("review_count")))
    if as_of is not None and "updated_at" in p.columns:
        p = p.withColumn("updated_at", F.when(hit, ts_lit(as_of)).otherwise(F.col("updated_at")))
    return p.drop("_r", "_n").select(*products.columns)


PRODUCT_KEY = {"products": "product_id"}


def ingest_ratings(reviews: DataFrame, products: DataFrame, root: str, checkpoint: str, as_of=None, buckets: int = 16) -> str:
    """R6 as a stream: each micro-batch of running totals becomes the changed
    product rows, published under ``root`` as one change set per batch id of a
    change log that starts from ``products``, bucketed by product. A batch reads
    the buckets of its products only; one that was published before a crash is
    skipped when it is replayed."""
    spark = products.sparkSession
    start_log({"products": products}, root, PRODUCT_KEY, PRODUCT_KEY, buckets)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        state = newest_manifest(spark, root)
        if batch_id <= state["version"]:
            batch.write.format("noop").mode("overwrite").save()  # the running totals must still be committed
            return
        # update mode: the batch holds only the products whose totals changed
        changed = apply_ratings(rows_for(spark, root, "products", batch, state), batch, as_of)
        write_snapshot({"products": changed}, root, batch_id, keys=PRODUCT_KEY)
        compact_if_large(spark, root)

    q = (rating_stream(reviews).writeStream.outputMode("update").foreachBatch(on_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return root
