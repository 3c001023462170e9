"""Streaming queries, run with availableNow over file sources and read back.

Inputs are the driver tables read as streams (events.parquet through
pathGlobFilter) or documents Spark derives from them and writes to the
shared checkpoint folder first (callback JSON).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from storefront.plans.registry import EVENTS_AS_OF, query
from storefront.session import scratch_path
from storefront.sources.views import transactions_from_events
from storefront.streaming import callbacks as CB
from storefront.streaming import windows as W
from storefront.streaming.common import run_available_now, table_stream

def _tx_stream(t):
    """The transactions as a stream that ends with a closing row one day after
    the data: the watermark then passes every window that holds a transaction."""
    tx = transactions_from_events(table_stream(t.spark, t.sf_dir, "events"))
    last = t["mpesa_transactions"].select(F.max("created_at")).scalar()
    folder = scratch_path(t.spark, "closing-row")
    none = t["mpesa_transactions"].limit(0)
    row = t.spark.range(1).select(*[(last + F.expr("INTERVAL 1 DAY") if f.name == "created_at" else F.lit(None))
                                    .cast(f.dataType).alias(f.name) for f in none.schema])
    row.write.parquet(folder)
    return tx.unionByName(t.spark.readStream.schema(none.schema).parquet(folder))


@query("hourly_stream", """
SELECT date_trunc('hour', created_at) AS hour, count(*) AS total_transactions,
       count_if(status = 'completed') AS successful, count_if(status = 'failed') AS failed,
       count_if(status = 'pending') AS pending, CAST(sum(amount) AS DECIMAL(38,2)) AS total_amount
FROM shop_transactions GROUP BY 1""")
def _r4(t):
    """Hourly windows closed by a 10-minute watermark (append mode); the
    closing row's own window never closes and is not emitted."""
    return run_available_now(W.hourly_stream(_tx_stream(t), "10 minutes"), "hourly")


@query("alert_stream", """
WITH w AS (
  SELECT time_bucket(INTERVAL 5 MINUTE, created_at) - k * INTERVAL 5 MINUTE AS window_start, status, created_at
  FROM shop_transactions, range(0, 12) r(k)),
c AS (
  SELECT window_start, count(*) AS n, count_if(status = 'failed') AS failed, count_if(status = 'pending') AS pending,
         count_if(status = 'pending' AND created_at < window_start + INTERVAL 55 MINUTE) AS old
  FROM w GROUP BY window_start)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, n, failed, pending,
       CASE WHEN failed * 10 > n THEN 'ALERT: High M-Pesa failure rate (>10%) in last hour' ELSE 'OK' END AS failure_rate_alert,
       CASE WHEN old > 50 THEN 'ALERT: ' || CAST(old AS VARCHAR) || ' pending transactions older than 5 minutes'
            ELSE 'OK' END AS pending_alert
FROM c""")
def _r5(t):
    """1-hour windows sliding by 5 minutes, closed by a 10-minute watermark."""
    return run_available_now(W.alert_stream(_tx_stream(t)), "alerts")


def _callback_docs(t):
    tx = t["mpesa_transactions"].where(F.col("status") == "pending")
    even = F.col("transaction_id") % 2 == 0
    docs = CB.callback_json(tx, even, F.when(even, F.lit("0")).otherwise(F.lit("1032")),
                            F.when(even, F.lit("The service request is processed successfully."))
                            .otherwise(F.lit("Request cancelled by user")))
    unknown = (CB.callback_json(tx.where(F.col("transaction_id") % 5 == 0)
                                .withColumn("checkout_request_id", F.concat("checkout_request_id", F.lit("_x"))),
                                F.lit(True), F.lit("0"), F.lit("ok"))
               .withColumn("seq", F.col("seq") + 1_000_000_000))
    broken = (docs.where(F.col("seq") % 7 == 0)
              .select((F.col("seq") + 2_000_000_000).alias("seq"), F.substring("value", 1, 40).alias("value")))
    src = scratch_path(t.spark, "callbacks-in")
    docs.unionByName(unknown).unionByName(broken).write.json(src)
    return src


CB_SQL = """
SELECT checkout_request_id, CASE WHEN transaction_id % 2 = 0 THEN '0' ELSE '1032' END AS result_code,
       transaction_id % 2 = 0 AS success,
       CASE WHEN transaction_id % 2 = 0 THEN amount END AS callback_amount,
       CASE WHEN transaction_id % 2 = 0 THEN 'Q' || CAST(transaction_id AS VARCHAR) END AS mpesa_receipt_number,
       CASE WHEN transaction_id % 2 = 0 THEN CAST(strftime(created_at, '%Y%m%d%H%M%S') AS BIGINT) END AS transaction_date
FROM shop_transactions WHERE status = 'pending'"""


@query("callbacks_parsed", CB_SQL + """
UNION ALL
SELECT checkout_request_id || '_x', '0', true, amount, 'Q' || CAST(transaction_id AS VARCHAR),
       CAST(strftime(created_at, '%Y%m%d%H%M%S') AS BIGINT)
FROM shop_transactions WHERE status = 'pending' AND transaction_id % 5 = 0""")
def _r1(t):
    """Callback JSON (success, failure, unknown ids, malformed lines) parsed
    as a stream; the good rows."""
    src = _callback_docs(t)
    raw = t.spark.readStream.schema("seq long, value string").json(src)
    parsed = CB.parse_callbacks(raw, seq="seq").good.select(
        "checkout_request_id", "result_code", "success", "callback_amount", "mpesa_receipt_number",
        "transaction_date")
    return run_available_now(parsed, "callbacks-parsed")


@query("callbacks_applied", """
SELECT transaction_id,
       CASE WHEN status <> 'pending' THEN status WHEN transaction_id % 2 = 0 THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN status <> 'pending' THEN result_code WHEN transaction_id % 2 = 0 THEN '0' ELSE '1032' END AS result_code,
       CASE WHEN status = 'pending' AND transaction_id % 2 = 0 THEN 'Q' || CAST(transaction_id AS VARCHAR)
            ELSE mpesa_receipt_number END AS mpesa_receipt_number
FROM shop_transactions""")
def _r2(t):
    """R2: the callback stream applied to transactions, payments and orders in
    foreachBatch, each batch's changed rows published as a change set; the
    resulting transactions (base merged with the change sets)."""
    return _after_callbacks(t)["mpesa_transactions"].select(
        "transaction_id", "status", "result_code", "mpesa_receipt_number")


def _ingested(t) -> str:
    root = scratch_path(t.spark, "callbacks-state")
    return CB.ingest_callbacks(t.spark, _callback_docs(t), t, root, EVENTS_AS_OF, scratch_path(t.spark, "callbacks-ckpt"))


def _after_callbacks(t):
    from storefront.sources.sinks import read_current
    return read_current(t.spark, {k: t[k] for k in CB.CALLBACK_KEYS}, _ingested(t), CB.CALLBACK_KEYS)


@query("callback_payments", f"""
WITH ok AS (SELECT order_id, max_by('Q' || CAST(transaction_id AS VARCHAR), transaction_id) AS receipt FROM shop_transactions
            WHERE status = 'pending' AND transaction_id % 2 = 0 GROUP BY order_id)
SELECT p.payment_id, CASE WHEN ok.order_id IS NULL THEN p.is_confirmed ELSE true END AS is_confirmed,
       ok.receipt AS mpesa_code, CASE WHEN ok.order_id IS NOT NULL THEN TIMESTAMP '{EVENTS_AS_OF}' END AS confirmed_at
FROM shop_payments p LEFT JOIN ok ON ok.order_id = p.order_id AND p.method = 'mpesa'""")
def _r2_payments(t):
    """R2: the payments after the callback stream."""
    return _after_callbacks(t)["payments"].select("payment_id", "is_confirmed", "mpesa_code", "confirmed_at")


@query("callback_orders", """
WITH cb AS (SELECT order_id, max(transaction_id) AS last, max_by(transaction_id % 2 = 0, transaction_id) AS ok
            FROM shop_transactions WHERE status = 'pending' GROUP BY order_id)
SELECT o.order_id, CASE WHEN cb.ok THEN 'processing' WHEN NOT cb.ok THEN 'failed' ELSE o.status END AS status,
       CASE WHEN NOT cb.ok THEN coalesce(o.notes, '') || ' | Payment failed: Request cancelled by user' ELSE o.notes END AS notes
FROM shop_orders o LEFT JOIN cb ON cb.order_id = o.order_id""")
def _r2_orders(t):
    """R2: the orders after the callback stream."""
    return _after_callbacks(t)["orders"].select("order_id", "status", "notes")


@query("callbacks_dead_letters", """
SELECT 1000000000 + transaction_id AS seq, 'unknown checkout id' AS reason FROM shop_transactions
WHERE status = 'pending' AND transaction_id % 5 = 0
UNION ALL
SELECT 2000000000 + transaction_id, 'malformed' FROM shop_transactions WHERE status = 'pending' AND transaction_id % 7 = 0""")
def _r1_dead(t):
    """Dead letters of the callback stream: unknown checkout ids and lines cut short."""
    return t.spark.read.parquet(f"{_ingested(t)}/dead_letters").select("seq", "reason")


@query("rating_stream", """
SELECT p.product_id, CAST(CASE WHEN count(r.review_id) = 0 THEN NULL
         ELSE CAST((sum(r.rating) * 200 + count(r.review_id)) // (count(r.review_id) * 2) AS DECIMAL(36,0)) * 0.01 END
         AS DECIMAL(3,2)) AS rating,
       CASE WHEN count(r.review_id) = 0 THEN NULL ELSE CAST(count(r.review_id) AS INT) END AS review_count
FROM shop_products p LEFT JOIN shop_reviews r ON p.product_id = r.product_id GROUP BY p.product_id""")
def _r6(t):
    """Review stream (view events) -> running per-product rating (update
    mode) -> the changed product rows published per micro-batch and merged on
    read."""
    from storefront.sources.sinks import read_current
    ev = table_stream(t.spark, t.sf_dir, "events").where(F.col("event_type") == "view")
    n_parts = t.raw("part").select(F.count(F.lit(1))).scalar()
    reviews = ev.select((F.col("event_id") % n_parts).alias("product_id"), (1 + F.col("event_id") % 5).cast("int")
                        .alias("rating"))
    root = W.ingest_ratings(reviews, t["products"], scratch_path(t.spark, "ratings-state"),
                            scratch_path(t.spark, "ratings-ckpt"), EVENTS_AS_OF)
    return read_current(t.spark, {"products": t["products"]}, root, {"products": "product_id"})["products"].select(
        "product_id", "rating", "review_count")


@query("timeout_stream", """
WITH req AS (SELECT checkout_request_id, created_at, transaction_id FROM shop_transactions WHERE status = 'pending'),
cb AS (SELECT checkout_request_id AS cb_id, created_at + (transaction_id % 50) * INTERVAL 1 MINUTE AS received_at
       FROM shop_transactions WHERE status = 'pending' AND transaction_id % 3 <> 0)
SELECT r.checkout_request_id, r.created_at, c.received_at, c.cb_id IS NULL AS timed_out,
       CASE WHEN c.cb_id IS NULL THEN 'TIMEOUT' END AS result_code
FROM req r LEFT JOIN cb c ON r.checkout_request_id = c.cb_id AND c.received_at >= r.created_at
  AND c.received_at <= r.created_at + INTERVAL 30 MINUTE""")
def _r3(t):
    """Pending requests against callbacks arriving 0-49 minutes later (none
    for every third); a stream-stream left outer join with a 30-minute bound.
    A closing marker row one day after the data on each side moves the
    watermarks past every window, so every request is decided; the markers
    are dropped from the output."""
    spark = t.spark
    tx = t["mpesa_transactions"].where(F.col("status") == "pending")
    last = t["mpesa_transactions"].select(F.max("created_at")).scalar()
    req = tx.select("checkout_request_id", "created_at")
    cb = tx.where(F.col("transaction_id") % 3 != 0).select(
        "checkout_request_id",
        (F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("transaction_id") % 50).cast("int")))
        .alias("received_at"))
    marker_req = spark.range(1).select(F.lit("__close__").alias("checkout_request_id"),
                                       (last + F.expr("INTERVAL 1 DAY")).alias("created_at"))
    marker_cb = spark.range(1).select(F.lit("__close__").alias("checkout_request_id"),
                                      (last + F.expr("INTERVAL 1 DAY")).alias("received_at"))
    req_dir, cb_dir = scratch_path(spark, "timeout-req"), scratch_path(spark, "timeout-cb")
    req.write.parquet(req_dir)
    marker_req.write.mode("append").parquet(req_dir)
    cb.write.parquet(cb_dir)
    marker_cb.write.mode("append").parquet(cb_dir)
    rs = spark.readStream.schema("checkout_request_id string, created_at timestamp_ntz").parquet(req_dir)
    cs = spark.readStream.schema("checkout_request_id string, received_at timestamp_ntz").parquet(cb_dir)
    out = run_available_now(W.timeouts(rs, cs, "30 minutes", "10 minutes"), "timeouts")
    return out.where(F.col("checkout_request_id") != "__close__")
