"""Payment monitoring queries at the events clock (method statistics at the orders clock)."""

from __future__ import annotations

from storefront.operators import payments as P
from storefront.plans.registry import EVENTS_AS_OF, EVENTS_MIDWAY, ORDERS_AS_OF, query
from storefront.plans.sqltext import avg2, pct

EA = f"TIMESTAMP '{EVENTS_AS_OF}'"
OA = f"TIMESTAMP '{ORDERS_AS_OF}'"
EDAY = f"date_trunc('day', {EA})"
MID = f"TIMESTAMP '{EVENTS_MIDWAY}'"
ODAY = f"date_trunc('day', {OA})"


def secs(earlier: str, later: str = EA) -> str:
    return f"CAST(CAST(date_diff('microsecond', {earlier}, {later}) AS DECIMAL(38,0)) * 0.000001 AS DECIMAL(38,6))"


@query("recent_transactions", """
SELECT t.transaction_id, t.checkout_request_id, t.phone_number, t.amount, t.status, t.mpesa_receipt_number,
       t.result_code, t.result_desc, o.order_id, o.status AS order_status, o.total_amount, t.created_at
FROM shop_transactions t JOIN shop_orders o ON t.order_id = o.order_id
ORDER BY t.created_at DESC NULLS FIRST, t.transaction_id LIMIT 20""")
def _m1(t):
    """M1, newest 20."""
    return P.recent_transactions(t, 20)


@query("pending_recent", f"""
SELECT t.transaction_id, t.order_id, t.checkout_request_id, t.phone_number, t.amount, o.user_id, o.total_amount,
       {secs('t.created_at', MID)} AS seconds_pending
FROM shop_transactions t JOIN shop_orders o ON t.order_id = o.order_id
WHERE t.status = 'pending' AND t.created_at > {MID} - INTERVAL 1 HOUR""")
def _m2(t):
    """M2 midway through the events (their last orders don't exist)."""
    return P.pending_recent(t, EVENTS_MIDWAY)


@query("outcome_rate", f"""
SELECT status, count(*) AS count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage,
       {avg2('amount')} AS avg_amount
FROM shop_transactions WHERE created_at > {EDAY} - INTERVAL 7 DAY GROUP BY status""")
def _m3(t):
    """M3, 7 days."""
    return P.outcome_rate(t["mpesa_transactions"], EVENTS_AS_OF)


@query("failure_analysis", f"""
SELECT result_code, result_desc, count(*) AS occurrences, {avg2('amount')} AS avg_amount,
       max(created_at) AS last_occurrence
FROM shop_transactions WHERE status = 'failed' AND created_at > {EDAY} - INTERVAL 30 DAY
GROUP BY result_code, result_desc""")
def _m4(t):
    """M4, 30 days."""
    return P.failure_analysis(t["mpesa_transactions"], EVENTS_AS_OF)


@query("daily_payments", f"""
SELECT CAST(created_at AS DATE) AS transaction_date, count(*) AS transaction_count,
       CAST(sum(amount) AS DECIMAL(38,2)) AS total_revenue, {avg2('amount')} AS avg_transaction,
       count_if(status = 'completed') AS completed_count, count_if(status = 'failed') AS failed_count
FROM shop_transactions WHERE created_at > {EDAY} - INTERVAL 30 DAY GROUP BY ALL""")
def _m5(t):
    """M5, 30 days."""
    return P.daily_payments(t["mpesa_transactions"], EVENTS_AS_OF)


@query("hourly_payments", f"""
SELECT date_trunc('hour', created_at) AS hour, count(*) AS total_transactions,
       count_if(status = 'completed') AS successful, count_if(status = 'failed') AS failed,
       count_if(status = 'pending') AS pending, CAST(sum(amount) AS DECIMAL(38,2)) AS total_amount
FROM shop_transactions WHERE created_at > {EA} - INTERVAL 7 DAY GROUP BY ALL""")
def _m6(t):
    """M6, 7 days."""
    return P.hourly_payments(t["mpesa_transactions"], EVENTS_AS_OF)


@query("top_phones", f"""
SELECT phone_number, count(*) AS transaction_count, count_if(status = 'completed') AS successful,
       CAST(sum(amount) FILTER (WHERE status = 'completed') AS DECIMAL(38,2)) AS total_spent,
       max(created_at) AS last_transaction
FROM shop_transactions WHERE created_at > {EDAY} - INTERVAL 30 DAY
GROUP BY phone_number HAVING count(*) > 1
ORDER BY transaction_count DESC NULLS FIRST, phone_number LIMIT 20""")
def _m7(t):
    """M7, top 20 phones (raw text)."""
    return P.top_phones(t["mpesa_transactions"], EVENTS_AS_OF, 20)


@query("outstanding", f"""
SELECT t.transaction_id, t.order_id, t.checkout_request_id, t.phone_number, t.amount,
       (date_diff('microsecond', t.created_at, {EA}) + 500000) // 1000000 AS seconds_waiting, o.user_id
FROM shop_transactions t JOIN shop_orders o ON t.order_id = o.order_id
WHERE t.status = 'pending' AND t.created_at < {EA} - INTERVAL 10 MINUTE""")
def _m8(t):
    """M8, pending over 10 minutes."""
    return P.outstanding(t, EVENTS_AS_OF)


@query("reconciliation", f"""
SELECT t.transaction_id, t.order_id, t.mpesa_receipt_number, t.amount, t.created_at, o.status AS order_status,
       CASE WHEN o.status <> 'processing' THEN 'NEEDS_UPDATE' ELSE 'OK' END AS reconciliation_status
FROM shop_transactions t JOIN shop_orders o ON t.order_id = o.order_id
WHERE t.status = 'completed' AND t.created_at > date_trunc('day', {MID}) - INTERVAL 1 DAY
  AND o.status NOT IN ('processing', 'shipped', 'delivered')""")
def _m9(t):
    """M9 midway through the events."""
    return P.reconciliation(t, EVENTS_MIDWAY)


@query("method_stats", f"""
SELECT 'M-Pesa' AS payment_method, count(*) AS total_transactions, count_if(status = 'completed') AS successful,
       {pct("count_if(status = 'completed')", 'count(*)')} AS success_rate,
       CAST(round(sum(amount), 2) AS DECIMAL(38,2)) AS total_amount, {avg2('amount')} AS avg_transaction
FROM shop_transactions WHERE created_at > {ODAY} - INTERVAL 30 DAY
UNION ALL
SELECT 'All Methods', count(*), count_if(is_confirmed), {pct('count_if(is_confirmed)', 'count(*)')},
       CAST(round(sum(amount), 2) AS DECIMAL(38,2)), {avg2('amount')}
FROM shop_payments WHERE created_at > {ODAY} - INTERVAL 30 DAY""")
def _m10(t):
    """M10 at the orders clock (both rows non-empty)."""
    return P.method_stats(t, ORDERS_AS_OF)


@query("pending_summary", f"""
SELECT CAST(count(*) AS INT) AS pending_count, CAST(sum(amount) AS DECIMAL(38,2)) AS total_pending_amount,
       {secs('min(created_at)')} AS oldest_pending_age_seconds
FROM shop_transactions WHERE status = 'pending'""")
def _m11(t):
    """M11."""
    return P.pending_summary(t["mpesa_transactions"], EVENTS_AS_OF)


@query("transaction_details", f"""
SELECT transaction_id, order_id, phone_number, amount, status, mpesa_receipt_number, result_code, result_desc,
       created_at, {secs('created_at')} AS time_pending_seconds
FROM shop_transactions WHERE transaction_id IN (SELECT transaction_id FROM shop_transactions WHERE status = 'pending')""")
def _m12(t):
    """M12 for the ids of all pending transactions."""
    tx = t["mpesa_transactions"]
    return P.transaction_details(tx, tx.where("status = 'pending'"), EVENTS_AS_OF)


@query("failure_rate_alert", f"""
SELECT CASE WHEN count(*) > 0 AND count_if(status = 'failed') * 10 > count(*)
            THEN 'ALERT: High M-Pesa failure rate (>10%) in last hour' ELSE 'OK' END AS failure_rate_alert
FROM shop_transactions WHERE created_at > {EA} - INTERVAL 1 HOUR""")
def _m13(t):
    """M13."""
    return P.failure_rate_alert(t["mpesa_transactions"], EVENTS_AS_OF)


@query("pending_alert", f"""
SELECT CASE WHEN count(*) > 50 THEN 'ALERT: ' || CAST(count(*) AS VARCHAR) || ' pending transactions older than 5 minutes'
            ELSE 'OK' END AS pending_alert
FROM shop_transactions WHERE status = 'pending' AND created_at < {EA} - INTERVAL 5 MINUTE""")
def _m14(t):
    """M14."""
    return P.pending_alert(t["mpesa_transactions"], EVENTS_AS_OF)


@query("unusual_amount_alert", f"""
SELECT CASE WHEN max(amount) > (SELECT avg(amount) * 3 FROM shop_transactions WHERE created_at > {EA} - INTERVAL 7 DAY)
            THEN 'ALERT: Unusually large transaction detected' ELSE 'OK' END AS unusual_amount_alert
FROM shop_transactions WHERE created_at > {EA} - INTERVAL 1 HOUR""")
def _m15(t):
    """M15."""
    return P.unusual_amount_alert(t["mpesa_transactions"], EVENTS_AS_OF)


@query("system_alerts", f"""
SELECT * FROM (
  SELECT 'warning' AS type, 'inventory' AS category,
         CAST(count(*) AS VARCHAR) || ' products have low stock (≤10 units)' AS message, count(*) AS count
  FROM shop_products WHERE stock <= 10 AND stock > 0
  UNION ALL SELECT 'error', 'inventory', CAST(count(*) AS VARCHAR) || ' products are out of stock', count(*)
  FROM shop_products WHERE stock = 0
  UNION ALL SELECT 'info', 'orders', CAST(count(*) AS VARCHAR) || ' orders are pending processing', count(*)
  FROM shop_orders WHERE status = 'pending'
  UNION ALL SELECT 'warning', 'payments', CAST(count(*) AS VARCHAR) || ' payments are pending confirmation', count(*)
  FROM shop_payments WHERE is_confirmed = false
  UNION ALL SELECT 'warning', 'offers', CAST(count(*) AS VARCHAR) || ' active offers have expired', count(*)
  FROM shop_offers WHERE is_active = true AND valid_until < {EA}) a
WHERE count > 0""")
def _m16(t):
    """M16 at the events clock."""
    return P.system_alerts(t, EVENTS_AS_OF)


ARCHIVE = f"created_at < {EDAY} - INTERVAL 14 DAY AND status IN ('completed', 'failed', 'cancelled')"


@query("archive_rows", f"""
SELECT transaction_id, order_id, status, created_at FROM shop_transactions WHERE {ARCHIVE}""")
def _u2a(t):
    """U2 archive part, 14 days (the events span 30 days)."""
    return P.archive_split(t["mpesa_transactions"], EVENTS_AS_OF, 14).archive.select(
        "transaction_id", "order_id", "status", "created_at")


@query("archive_keep", f"""
SELECT transaction_id, order_id, status, created_at FROM shop_transactions WHERE NOT coalesce({ARCHIVE}, false)""")
def _u2k(t):
    """U2 keep part, 14 days."""
    return P.archive_split(t["mpesa_transactions"], EVENTS_AS_OF, 14).keep.select(
        "transaction_id", "order_id", "status", "created_at")


@query("count_pending_transactions_fn", f"""
SELECT CAST(count(*) AS INT) AS pending_count, CAST(sum(amount) AS DECIMAL(38,2)) AS total_pending_amount,
       {secs('min(created_at)')} AS oldest_pending_age_seconds
FROM shop_transactions WHERE status = 'pending'""")
def _x2(t):
    """X2 through the SQL table function."""
    tx = t["mpesa_transactions"]
    P.register_table_functions(tx.sparkSession, tx, EVENTS_AS_OF)
    return tx.sparkSession.sql("SELECT * FROM count_pending_transactions()")


@query("transaction_details_fn", f"""
SELECT transaction_id, order_id, phone_number, amount, status, mpesa_receipt_number, result_code, result_desc,
       created_at, {secs('created_at')} AS time_pending_seconds
FROM shop_transactions WHERE status = 'failed'""")
def _x1(t):
    """X1 through the SQL table function, called laterally for every failed transaction."""
    tx = t["mpesa_transactions"]
    spark = tx.sparkSession
    P.register_table_functions(spark, tx, EVENTS_AS_OF)
    tx.where("status = 'failed'").select("transaction_id").createOrReplaceTempView("failed_transaction_ids")
    return spark.sql("SELECT d.* FROM failed_transaction_ids f, LATERAL get_transaction_details(f.transaction_id) d")


NORM = """CASE WHEN regexp_replace(phone_number, '[^0-9]', '', 'g') LIKE '0%'
                 THEN '254' || substr(regexp_replace(phone_number, '[^0-9]', '', 'g'), 2)
            WHEN regexp_replace(phone_number, '[^0-9]', '', 'g') LIKE '254%' THEN regexp_replace(phone_number, '[^0-9]', '', 'g')
            WHEN length(regexp_replace(phone_number, '[^0-9]', '', 'g')) = 9
                 THEN '254' || regexp_replace(phone_number, '[^0-9]', '', 'g')
            ELSE regexp_replace(phone_number, '[^0-9]', '', 'g') END"""


@query("top_phones_normalised", f"""
SELECT {NORM} AS phone_number, count(*) AS transaction_count, count_if(status = 'completed') AS successful,
       CAST(sum(amount) FILTER (WHERE status = 'completed') AS DECIMAL(38,2)) AS total_spent,
       max(created_at) AS last_transaction
FROM shop_transactions WHERE created_at > {EDAY} - INTERVAL 30 DAY
GROUP BY 1 HAVING count(*) > 1
ORDER BY transaction_count DESC NULLS FIRST, phone_number LIMIT 20""")
def _m7n(t):
    """M7 grouped by the F1-normalised phone number, top 20."""
    return P.top_phones(t["mpesa_transactions"], EVENTS_AS_OF, 20, normalise=True)
