"""Payment monitoring: reports, alerts, archive split, table functions.

Every report takes the clock ``as_of`` (D1). Windows keep the reference's
bounds: ``NOW() - interval`` is :func:`ago`, ``CURRENT_DATE - interval`` is
:func:`date_ago`, and comparisons stay strict where the reference is strict
(D2). Filters on ``created_at`` reach the parquet scan as pushed filters
(on a stored transactions table the ``status`` test is pushed too; in the
driver views status is derived per row, so it runs right after the scan).
Global top-n uses TakeOrderedAndProject; grouped reports are partial
aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storefront.functions.scalar import (
    ago, asc_pg, avg2, date_ago, desc_pg, hour_start, idiv, normalise_phone, pct, seconds_between, topk, ts_lit)

Tables = Mapping[str, DataFrame]

# Alert texts.
FAILURE_RATE_ALERT = "ALERT: High M-Pesa failure rate (>10%) in last hour"
PENDING_ALERT = "ALERT: {n} pending transactions older than 5 minutes"
UNUSUAL_AMOUNT_ALERT = "ALERT: Unusually large transaction detected"
OK = "OK"


def _orders_for(t: Tables) -> DataFrame:
    return t["orders"].select("order_id", "user_id", F.col("status").alias("order_status"), "total_amount")


def recent_transactions(t: Tables, n: int = 20) -> DataFrame:
    """M1: newest n transactions that have an order, with order columns.

    The semi join keeps the inner-join meaning; the n newest are taken before
    the order columns are joined, so the wide join sees n rows.
    """
    tx = t["mpesa_transactions"].join(t["orders"].select("order_id"), "order_id", "left_semi")
    top = topk(tx, [desc_pg("created_at")], n, key=["transaction_id"])
    return (top.join(_orders_for(t), "order_id")
            .select("transaction_id", "checkout_request_id", "phone_number", "amount", "status",
                    "mpesa_receipt_number", "result_code", "result_desc", "order_id", "order_status",
                    "total_amount", "created_at")
            .orderBy(desc_pg("created_at"), "transaction_id"))


def pending_recent(t: Tables, as_of) -> DataFrame:
    """M2: pending transactions of the last hour (strict) with fractional seconds pending."""
    tx = t["mpesa_transactions"].where((F.col("status") == "pending") & (F.col("created_at") > ago(as_of, hours=1)))
    return (tx.join(_orders_for(t), "order_id")
            .select("transaction_id", "order_id", "checkout_request_id", "phone_number", "amount", "user_id",
                    "total_amount", seconds_between(ts_lit(as_of), F.col("created_at")).alias("seconds_pending"),
                    "created_at")
            .orderBy(desc_pg("created_at"), "transaction_id").drop("created_at"))


def outcome_rate(txns: DataFrame, as_of, days: int = 7) -> DataFrame:
    """M3: count, share of all (W1) and average amount by status since the
    start of the day ``days`` before as_of.

    The share uses ``sum(count) over ()`` on the grouped rows; there is one
    row per status value (an enum), so the unpartitioned window sees a handful
    of rows.
    """
    g = (txns.where(F.col("created_at") > date_ago(as_of, days=days)).groupBy("status")
         .agg(F.count(F.lit(1)).alias("count"), avg2("amount").alias("avg_amount")))
    all_rows = F.sum("count").over(Window.partitionBy())
    return (g.select("status", "count", pct(F.col("count"), all_rows).alias("percentage"), "avg_amount")
            .orderBy(desc_pg("count"), asc_pg("status")))


def failure_analysis(txns: DataFrame, as_of, days: int = 30) -> DataFrame:
    """M4: failed transactions by code and text (NULL code is a group)."""
    f = txns.where((F.col("status") == "failed") & (F.col("created_at") > date_ago(as_of, days=days)))
    return (f.groupBy("result_code", "result_desc")
            .agg(F.count(F.lit(1)).alias("occurrences"), avg2("amount").alias("avg_amount"),
                 F.max("created_at").alias("last_occurrence"))
            .orderBy(desc_pg("occurrences"), asc_pg("result_code"), asc_pg("result_desc")))


def daily_payments(txns: DataFrame, as_of, days: int = 30) -> DataFrame:
    """M5: per day: count, sum (all statuses), average, completed, failed."""
    x = txns.where(F.col("created_at") > date_ago(as_of, days=days))
    return (x.groupBy(F.to_date("created_at").alias("transaction_date"))
            .agg(F.count(F.lit(1)).alias("transaction_count"),
                 F.sum("amount").cast("decimal(38,2)").alias("total_revenue"),
                 avg2("amount").alias("avg_transaction"),
                 F.count_if(F.col("status") == "completed").alias("completed_count"),
                 F.count_if(F.col("status") == "failed").alias("failed_count"))
            .orderBy(desc_pg("transaction_date")))


def hourly_payments(txns: DataFrame, as_of, days: int = 7) -> DataFrame:
    """M6: per hour of the last 7 days: count by outcome and amount."""
    x = txns.where(F.col("created_at") > ago(as_of, days=days))
    return (x.groupBy(hour_start("created_at").alias("hour"))
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 F.count_if(F.col("status") == "completed").alias("successful"),
                 F.count_if(F.col("status") == "failed").alias("failed"),
                 F.count_if(F.col("status") == "pending").alias("pending"),
                 F.sum("amount").cast("decimal(38,2)").alias("total_amount"))
            .orderBy(desc_pg("hour")))


def top_phones(txns: DataFrame, as_of, n: int = 20, days: int = 30, normalise: bool = False) -> DataFrame:
    """M7: phones with more than one transaction: count, successes, completed
    spend (NULL if none), last transaction; top n by count (ties: phone).

    The reference groups the raw phone text; ``normalise=True`` groups the
    F1-normalised number instead.
    """
    x = txns.where(F.col("created_at") > date_ago(as_of, days=days))
    if normalise:
        x = x.withColumn("phone_number", normalise_phone("phone_number"))
    done = F.col("status") == "completed"
    g = (x.groupBy("phone_number")
         .agg(F.count(F.lit(1)).alias("transaction_count"), F.count_if(done).alias("successful"),
              F.sum(F.when(done, F.col("amount"))).cast("decimal(38,2)").alias("total_spent"),
              F.max("created_at").alias("last_transaction"))
         .where(F.col("transaction_count") > 1))
    return topk(g, [desc_pg("transaction_count")], n, key=["phone_number"])


def outstanding(t: Tables, as_of, minutes: int = 10) -> DataFrame:
    """M8: pending for more than ``minutes``, whole seconds waiting (rounded half up), oldest first."""
    tx = t["mpesa_transactions"].where(
        (F.col("status") == "pending") & (F.col("created_at") < ago(as_of, minutes=minutes)))
    us = F.timestamp_diff("MICROSECOND", F.col("created_at"), ts_lit(as_of))
    return (tx.join(_orders_for(t), "order_id")
            .select("transaction_id", "order_id", "checkout_request_id", "phone_number", "amount",
                    idiv(us + 500000, F.lit(1000000)).cast("long").alias("seconds_waiting"), "user_id", "created_at")
            .orderBy(asc_pg("created_at"), "transaction_id").drop("created_at"))


def reconciliation(t: Tables, as_of, days: int = 1) -> DataFrame:
    """M9: completed since the start of yesterday whose order is not
    processing/shipped/delivered (so every row is NEEDS_UPDATE, D14)."""
    tx = t["mpesa_transactions"].where(
        (F.col("status") == "completed") & (F.col("created_at") > date_ago(as_of, days=days)))
    o = _orders_for(t).where(~F.col("order_status").isin("processing", "shipped", "delivered"))
    return (tx.join(o, "order_id")
            .select("transaction_id", "order_id", "mpesa_receipt_number", "amount", "created_at", "order_status",
                    F.when(F.col("order_status") != "processing", "NEEDS_UPDATE").otherwise("OK")
                    .alias("reconciliation_status"))
            .orderBy(desc_pg("created_at"), "transaction_id"))


def method_stats(t: Tables, as_of, days: int = 30) -> DataFrame:
    """An M-Pesa row from the transactions and an all-methods row from the
    payments (success = is_confirmed) over the last ``days`` days; rates over an
    empty set are NULL (D8)."""
    since = date_ago(as_of, days=days)

    def stats(df: DataFrame, label: str, ok: F.Column) -> DataFrame:
        return df.where(F.col("created_at") > since).agg(
            F.count(F.lit(1)).alias("total_transactions"), F.count_if(ok).alias("successful"),
            F.round(F.sum("amount"), 2).cast("decimal(38,2)").alias("total_amount"),
            avg2("amount").alias("avg_transaction")).select(
            F.lit(label).alias("payment_method"), "total_transactions", "successful",
            pct(F.col("successful"), F.col("total_transactions")).alias("success_rate"), "total_amount",
            "avg_transaction")

    return stats(t["mpesa_transactions"], "M-Pesa", F.col("status") == "completed").unionByName(
        stats(t["payments"], "All Methods", F.col("is_confirmed") == F.lit(True)))


def pending_summary(txns: DataFrame, as_of) -> DataFrame:
    """Pending count, amount and age of the oldest (seconds)."""
    p = txns.where(F.col("status") == "pending")
    return p.agg(F.count(F.lit(1)).cast("int").alias("pending_count"),
                 F.sum("amount").cast("decimal(38,2)").alias("total_pending_amount"),
                 F.min("created_at").alias("oldest")).select(
        "pending_count", "total_pending_amount",
        seconds_between(ts_lit(as_of), F.col("oldest")).alias("oldest_pending_age_seconds"))


def transaction_details(txns: DataFrame, keys: DataFrame | None, as_of) -> DataFrame:
    """Transactions (all, or those whose id is in ``keys``) with time pending in seconds."""
    x = txns if keys is None else txns.join(keys.select("transaction_id").dropDuplicates(), "transaction_id",
                                             "left_semi")
    return x.select("transaction_id", "order_id", "phone_number", "amount", "status", "mpesa_receipt_number",
                    "result_code", "result_desc", "created_at",
                    seconds_between(ts_lit(as_of), F.col("created_at")).alias("time_pending_seconds"))


def failure_rate_alert(txns: DataFrame, as_of) -> DataFrame:
    """Alert when more than 10 % of the last hour's transactions failed;
    an empty hour is OK (D8). Compared in integers: failed * 10 > all."""
    x = txns.where(F.col("created_at") > ago(as_of, hours=1))
    a = x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("failed"))
    return a.select(F.when((F.col("n") > 0) & (F.col("failed") * 10 > F.col("n")), F.lit(FAILURE_RATE_ALERT))
                    .otherwise(F.lit(OK)).alias("failure_rate_alert"))


def pending_alert(txns: DataFrame, as_of, threshold: int = 50) -> DataFrame:
    """Alert with the count when more than 50 are pending for over 5 minutes."""
    x = txns.where((F.col("status") == "pending") & (F.col("created_at") < ago(as_of, minutes=5)))
    a = x.agg(F.count(F.lit(1)).alias("n"))
    head, tail = PENDING_ALERT.split("{n}")
    return a.select(F.when(F.col("n") > threshold, F.concat(F.lit(head), F.col("n").cast("string"), F.lit(tail)))
                    .otherwise(F.lit(OK)).alias("pending_alert"))


def unusual_amount_alert(txns: DataFrame, as_of, factor: int = 3) -> DataFrame:
    """Alert when the largest amount of the last hour exceeds 3 x the
    7-day average. One scan with two filtered aggregates; compared exactly as
    max * n > 3 * sum. An empty hour (or week) is OK."""
    ts = F.col("created_at")
    x = txns.where(ts > ago(as_of, days=7))
    a = x.agg(F.max(F.when(ts > ago(as_of, hours=1), F.col("amount"))).alias("mx"),
              F.sum(F.when(ts > ago(as_of, days=7), F.col("amount"))).alias("s"),
              F.count(F.when(ts > ago(as_of, days=7), F.col("amount"))).alias("n"))
    hit = (F.col("n") > 0) & (F.col("mx") * F.col("n") > F.col("s") * factor)
    return a.select(F.when(F.coalesce(hit, F.lit(False)), F.lit(UNUSUAL_AMOUNT_ALERT)).otherwise(F.lit(OK))
                    .alias("unusual_amount_alert"))


def system_alerts(t: Tables, as_of, low_stock: int = 10) -> DataFrame:
    """Up to five alert rows (type, category, message, count), only where count > 0."""
    s = F.col("stock")

    def one(df: DataFrame, cond: F.Column, kind: str, category: str, text: str) -> DataFrame:
        return df.agg(F.count_if(cond).alias("count")).select(
            F.lit(kind).alias("type"), F.lit(category).alias("category"),
            F.concat(F.col("count").cast("string"), F.lit(text)).alias("message"), "count")

    parts = [
        one(t["products"], (s <= low_stock) & (s > 0), "warning", "inventory",
            f" products have low stock (≤{low_stock} units)"),
        one(t["products"], s == 0, "error", "inventory", " products are out of stock"),
        one(t["orders"], F.col("status") == "pending", "info", "orders", " orders are pending processing"),
        one(t["payments"], F.col("is_confirmed") == F.lit(False), "warning", "payments",
            " payments are pending confirmation"),
        one(t["special_offers"], (F.col("is_active") == F.lit(True)) & (F.col("valid_until") < ts_lit(as_of)),
            "warning", "offers", " active offers have expired"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("count") > 0)


class Split(NamedTuple):
    archive: DataFrame
    keep: DataFrame


def archive_split(txns: DataFrame, as_of, days: int = 90) -> Split:
    """Settled transactions older than ``days`` days (from the start of
    as_of's day) go to the archive, the rest stay. The predicate is one
    boolean column, so keep + archive = input exactly (NULL status stays)."""
    flag = F.coalesce((F.col("created_at") < date_ago(as_of, days=days))
                      & F.col("status").isin("completed", "failed", "cancelled"), F.lit(False))
    marked = txns.withColumn("_archive", flag)
    return Split(marked.where(F.col("_archive")).drop("_archive"), marked.where(~F.col("_archive")).drop("_archive"))


def register_table_functions(spark: SparkSession, txns: DataFrame, as_of, view: str = "mpesa_transactions") -> None:
    """SQL table functions over a temporary view of the transactions.

    ``get_transaction_details(id)`` and ``count_pending_transactions()`` are
    SQL-bodied temporary functions (the clock is fixed into their text).
    """
    txns.createOrReplaceTempView(view)
    ts = f"TIMESTAMP_NTZ '{ts_text(as_of)}'"
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION get_transaction_details(p_transaction_id BIGINT)
RETURNS TABLE (transaction_id BIGINT, order_id BIGINT, phone_number STRING, amount DECIMAL(12,2), status STRING,
               mpesa_receipt_number STRING, result_code STRING, result_desc STRING, created_at TIMESTAMP_NTZ,
               time_pending_seconds DECIMAL(38,6))
RETURN SELECT t.transaction_id, t.order_id, t.phone_number, t.amount, t.status, t.mpesa_receipt_number,
              t.result_code, t.result_desc, t.created_at,
              CAST(CAST(timestampdiff(MICROSECOND, t.created_at, {ts}) AS DECIMAL(38,0)) / 1000000 AS DECIMAL(38,6))
       FROM {view} t WHERE t.transaction_id = p_transaction_id""")
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION count_pending_transactions()
RETURNS TABLE (pending_count INT, total_pending_amount DECIMAL(38,2), oldest_pending_age_seconds DECIMAL(38,6))
RETURN SELECT CAST(count(*) AS INT), CAST(sum(amount) AS DECIMAL(38,2)),
              CAST(CAST(timestampdiff(MICROSECOND, min(created_at), {ts}) AS DECIMAL(38,0)) / 1000000 AS DECIMAL(38,6))
       FROM {view} WHERE status = 'pending'""")


def ts_text(as_of) -> str:
    from storefront.functions.scalar import as_datetime
    return as_datetime(as_of).strftime("%Y-%m-%d %H:%M:%S.%f")
