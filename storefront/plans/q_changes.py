"""Table-change queries. Each change set is derived from the driver tables;
the query returns the changed table (or the decisions) and its SQL twin
computes the same outcome independently."""

from __future__ import annotations

from pyspark.sql import functions as F

from storefront.operators import changes as C
from storefront.operators.enrich import flagged_reviews
from storefront.plans.registry import EVENTS_AS_OF, ORDERS_AS_OF, query

EA = f"TIMESTAMP '{EVENTS_AS_OF}'"


def _order_status_changes(t):
    tx = t["mpesa_transactions"].where(F.col("status").isin("completed", "failed"))
    return tx.select("order_id", F.col("transaction_id").alias("seq"),
                     F.when(F.col("status") == "completed", "processing").otherwise("failed").alias("status"),
                     F.array(F.lit("status")).alias("changed"))


@query("patch_orders_from_transactions", """
WITH ch AS (SELECT order_id, CASE WHEN status = 'completed' THEN 'processing' ELSE 'failed' END AS new_status,
                   row_number() OVER (PARTITION BY order_id ORDER BY transaction_id DESC) AS rk
            FROM shop_transactions WHERE status IN ('completed', 'failed'))
SELECT o.order_id, coalesce(ch.new_status, o.status) AS status
FROM shop_orders o LEFT JOIN ch ON o.order_id = ch.order_id AND ch.rk = 1""")
def _t2(t):
    """Order status patched from settled transactions (latest transaction wins)."""
    return C.patch(t["orders"], _order_status_changes(t), "order_id", "present", as_of=EVENTS_AS_OF).table.select(
        "order_id", "status")


@query("patch_rejected_keys", """
SELECT DISTINCT order_id FROM shop_transactions
WHERE status IN ('completed', 'failed') AND order_id NOT IN (SELECT order_id FROM shop_orders)""")
def _t2_rej(t):
    """Change rows whose order does not exist."""
    return C.patch(t["orders"], _order_status_changes(t), "order_id", "present").rejected.select(
        "order_id").dropDuplicates()


@query("bulk_cancel_unknown_payments", """
SELECT o.order_id, CASE WHEN p.order_id IS NOT NULL THEN 'cancelled' ELSE o.status END AS status
FROM shop_orders o LEFT JOIN (SELECT DISTINCT order_id FROM shop_payments WHERE is_confirmed IS NULL) p
  ON o.order_id = p.order_id""")
def _t3(t):
    """Orders whose payment state is unknown are cancelled."""
    ids = t["payments"].where(F.col("is_confirmed").isNull()).select("order_id")
    return C.bulk_update(t["orders"], ids, {"status": "cancelled"}, "order_id", as_of=ORDERS_AS_OF).table.select(
        "order_id", "status")


@query("seller_status_roles", """
SELECT u.user_id, CASE WHEN s.seller_id IS NULL THEN u.role WHEN s.seller_id % 2 = 0 THEN 'seller' ELSE 'guest' END AS role
FROM shop_users u LEFT JOIN shop_sellers s ON s.user_id = u.user_id""")
def _t4(t):
    """T4: even sellers approved, odd ones suspended."""
    actions = t["sellers"].select("seller_id", F.col("seller_id").alias("seq"),
                                  F.when(F.col("seller_id") % 2 == 0, "approve").otherwise("suspend").alias("action"))
    return C.set_seller_status(t, actions).table.select("user_id", "role")


@query("delete_flagged_reviews", """
SELECT r.review_id, r.product_id FROM shop_reviews r
WHERE NOT EXISTS (SELECT 1 FROM shop_users u JOIN shop_products p ON true
                  WHERE u.user_id = r.user_id AND p.product_id = r.product_id
                    AND (r.rating <= 2 OR r.comment ILIKE '%scam%' OR r.comment ILIKE '%fake%' OR r.comment ILIKE '%fraud%'))""")
def _t5(t):
    """T5: flagged reviews (P4) removed."""
    return C.bulk_delete(t["reviews"], flagged_reviews(t).select("review_id"), "review_id").table.select(
        "review_id", "product_id")


@query("cascade_delete_customers", """
WITH blocked AS (SELECT DISTINCT user_id FROM shop_orders),
d AS (SELECT user_id FROM shop_users WHERE role = 'customer' AND user_id NOT IN (SELECT user_id FROM blocked)),
dc AS (SELECT cart_id FROM shop_carts WHERE user_id IN (SELECT user_id FROM d))
SELECT * FROM (
  SELECT 'users' AS table_name, count(*) AS deleted_rows FROM d
  UNION ALL SELECT 'carts', count(*) FROM dc
  UNION ALL SELECT 'cart_items', count(*) FROM shop_cart_items WHERE cart_id IN (SELECT cart_id FROM dc)
  UNION ALL SELECT 'addresses', count(*) FROM shop_addresses WHERE user_id IN (SELECT user_id FROM d)
  UNION ALL SELECT 'reviews', count(*) FROM shop_reviews WHERE user_id IN (SELECT user_id FROM d)
  UNION ALL SELECT 'blocked_roots', count(DISTINCT u.user_id) FROM shop_users u JOIN blocked b ON u.user_id = b.user_id
            WHERE u.role = 'customer') x
WHERE deleted_rows > 0""")
def _t6(t):
    """Delete every customer; customers with orders are blocked by the
    RESTRICT keys and skipped, the rest cascade to carts, cart items,
    addresses and reviews. Rows deleted per table."""
    ids = t["users"].where(F.col("role") == "customer").select("user_id")
    res = C.cascade_delete(t, "users", ids, on_blocked="skip")
    parts = [d.agg(F.count(F.lit(1)).alias("deleted_rows")).select(F.lit(n).alias("table_name"), "deleted_rows")
             for n, d in res.deleted.items()]
    parts.append(res.blocked.agg(F.count_distinct("root_id").alias("deleted_rows")).select(
        F.lit("blocked_roots").alias("table_name"), "deleted_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("deleted_rows") > 0)


@query("merge_categories", """
WITH tgt AS (SELECT min(category_id) AS t FROM shop_categories WHERE featured),
pairs AS (SELECT category_id AS source_id FROM shop_categories WHERE NOT featured)
SELECT CASE WHEN p.category_id IN (SELECT source_id FROM pairs) THEN (SELECT t FROM tgt) ELSE p.category_id END
         AS category_id, count(*) AS product_count
FROM shop_products p GROUP BY 1""")
def _t7(t):
    """Every non-featured category merged into the first featured one;
    products per category afterwards (no product lost)."""
    cats = t["categories"]
    target = cats.where("featured").select(F.min("category_id")).scalar()
    pairs = cats.where(~F.col("featured")).select(F.col("category_id").alias("source_id"),
                                                  target.alias("target_id"))
    out, _ = C.merge_categories(t, pairs)
    return out["products"].groupBy("category_id").agg(F.count(F.lit(1)).alias("product_count"))


ADDS_SQL = "SELECT event_id AS seq, user_id AS cart_id, (user_id * 7 + event_id % 7) % (SELECT count(*) FROM part) AS product_id, " \
           "CAST(1 + event_id % 13 AS INT) AS quantity FROM events WHERE event_type = 'purchase'"


def _cart_adds(t):
    """Every purchase event as a cart add; a cart meets seven products, all carts meet all of them."""
    n_parts = t.raw("part").select(F.count(F.lit(1))).scalar()
    e = t.raw("events").where(F.col("event_type") == "purchase")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("cart_id"),
                    ((F.col("user_id") * 7 + F.col("event_id") % 7) % n_parts).alias("product_id"),
                    (1 + F.col("event_id") % 13).cast("int").alias("quantity"))


@query("cart_add_decisions", f"""
WITH RECURSIVE adds AS ({ADDS_SQL}),
keyed AS (
  SELECT a.seq, a.cart_id, a.product_id, a.quantity, p.stock, coalesce(ci.quantity, 0) AS have,
         row_number() OVER (PARTITION BY a.cart_id, a.product_id ORDER BY a.seq) AS rn
  FROM adds a JOIN shop_products p ON a.product_id = p.product_id
  LEFT JOIN shop_cart_items ci ON ci.cart_id = a.cart_id AND ci.product_id = a.product_id),
fold(cart_id, product_id, rn, cur, seq, accepted) AS (
  SELECT cart_id, product_id, rn, CASE WHEN have + quantity <= stock THEN have + quantity ELSE have END, seq,
         have + quantity <= stock FROM keyed WHERE rn = 1
  UNION ALL
  SELECT k.cart_id, k.product_id, k.rn, CASE WHEN f.cur + k.quantity <= k.stock THEN f.cur + k.quantity ELSE f.cur END,
         k.seq, f.cur + k.quantity <= k.stock
  FROM fold f JOIN keyed k ON k.cart_id = f.cart_id AND k.product_id = f.product_id AND k.rn = f.rn + 1)
SELECT a.seq, a.cart_id, a.product_id, a.quantity, coalesce(f.accepted, false) AS accepted,
       CASE WHEN p.product_id IS NULL THEN 'Product not found' WHEN NOT f.accepted THEN 'Insufficient stock' END AS reason
FROM adds a LEFT JOIN fold f ON a.seq = f.seq LEFT JOIN shop_products p ON a.product_id = p.product_id""")
def _t8(t):
    """Purchase events replayed as cart adds; per add accepted or refused."""
    return C.apply_cart_adds(t, _cart_adds(t), EVENTS_AS_OF).decisions.select(
        "seq", "cart_id", "product_id", "quantity", "accepted", "reason")


@query("cart_lines_after_adds", f"""
WITH RECURSIVE adds AS ({ADDS_SQL}),
keyed AS (
  SELECT a.seq, a.cart_id, a.product_id, a.quantity, p.stock, coalesce(ci.quantity, 0) AS have,
         row_number() OVER (PARTITION BY a.cart_id, a.product_id ORDER BY a.seq) AS rn
  FROM adds a JOIN shop_products p ON a.product_id = p.product_id
  LEFT JOIN shop_cart_items ci ON ci.cart_id = a.cart_id AND ci.product_id = a.product_id),
fold(cart_id, product_id, rn, cur, seq, accepted) AS (
  SELECT cart_id, product_id, rn, CASE WHEN have + quantity <= stock THEN have + quantity ELSE have END, seq,
         have + quantity <= stock FROM keyed WHERE rn = 1
  UNION ALL
  SELECT k.cart_id, k.product_id, k.rn, CASE WHEN f.cur + k.quantity <= k.stock THEN f.cur + k.quantity ELSE f.cur END,
         k.seq, f.cur + k.quantity <= k.stock
  FROM fold f JOIN keyed k ON k.cart_id = f.cart_id AND k.product_id = f.product_id AND k.rn = f.rn + 1),
fin AS (SELECT cart_id, product_id, max(cur) AS quantity, bool_or(accepted) AS any_ok FROM fold GROUP BY ALL)
SELECT coalesce(ci.cart_id, fin.cart_id) AS cart_id, coalesce(ci.product_id, fin.product_id) AS product_id,
       CAST(CASE WHEN fin.any_ok THEN fin.quantity ELSE ci.quantity END AS INT) AS quantity,
       CASE WHEN fin.any_ok THEN coalesce(p.sale_price, p.price) ELSE ci.unit_price END AS unit_price
FROM shop_cart_items ci FULL JOIN (SELECT * FROM fin WHERE any_ok) fin
  ON ci.cart_id = fin.cart_id AND ci.product_id = fin.product_id
LEFT JOIN shop_products p ON p.product_id = coalesce(ci.product_id, fin.product_id)""")
def _t8_lines(t):
    """Cart lines after the adds (quantities folded, price refreshed on accepted adds)."""
    return C.apply_cart_adds(t, _cart_adds(t), EVENTS_AS_OF).cart_items.select("cart_id", "product_id", "quantity",
                                                                     "unit_price")


@query("claim_guest_carts", """
SELECT c.cart_id, CASE WHEN c.user_id IS NULL AND u.user_id IS NOT NULL THEN u.user_id ELSE c.user_id END AS user_id,
       CASE WHEN c.user_id IS NULL AND u.user_id IS NOT NULL THEN NULL ELSE c.session_id END AS session_id
FROM shop_carts c LEFT JOIN shop_users u ON c.session_id = 'guest_' || CAST(u.user_id AS VARCHAR)""")
def _t10(t):
    """Every guest session 'guest_<n>' claimed by user n (when user n exists)."""
    claims = t["users"].select(F.concat(F.lit("guest_"), F.col("user_id").cast("string")).alias("session_id"),
                               "user_id", F.col("user_id").alias("seq"))
    return C.claim_carts(t, claims).table.select("cart_id", "user_id", "session_id")


@query("confirm_unconfirmed_payments", """
SELECT o.order_id,
       CASE WHEN p.payment_id IS NULL THEN o.status WHEN o.status = 'delivered' THEN 'processing' ELSE 'failed' END AS status,
       CASE WHEN p.payment_id IS NULL THEN o.notes
            ELSE coalesce(o.notes, '') || ' | ' || CASE WHEN o.status = 'delivered' THEN 'Admin note: delivered' ELSE '' END
       END AS notes
FROM shop_orders o LEFT JOIN (SELECT * FROM shop_payments WHERE is_confirmed = false) p ON o.order_id = p.order_id""")
def _t11(t):
    """Unconfirmed payments confirmed when the order was delivered
    (note 'delivered'), rejected otherwise (no note)."""
    out, _ = C.confirm_payments(t, _payment_decisions(t), ORDERS_AS_OF)
    return out["orders"].select("order_id", "status", "notes")


def _payment_decisions(t):
    p = t["payments"].where(F.col("is_confirmed") == F.lit(False)).join(
        t["orders"].select("order_id", "status"), "order_id")
    return p.select("payment_id", F.col("payment_id").alias("seq"), (F.col("status") == "delivered").alias("is_confirmed"),
                    F.when(F.col("status") == "delivered", "delivered").alias("notes"))


@query("new_reviews_ratings", """
WITH cr AS (SELECT event_id AS seq, user_id, event_id % (SELECT count(*) FROM part) AS product_id,
                   CAST(1 + (event_id * 7) % 5 AS INT) AS rating FROM events WHERE event_type = 'purchase'),
ok AS (SELECT * FROM cr WHERE NOT EXISTS (SELECT 1 FROM shop_reviews r WHERE r.user_id = cr.user_id AND r.product_id = cr.product_id)
       QUALIFY row_number() OVER (PARTITION BY user_id, product_id ORDER BY seq) = 1),
allr AS (SELECT product_id, rating FROM shop_reviews UNION ALL SELECT product_id, rating FROM ok),
touched AS (SELECT DISTINCT product_id FROM ok)
SELECT p.product_id,
       CAST(CASE WHEN tt.product_id IS NULL THEN NULL ELSE coalesce(
         (SELECT CAST((sum(rating) * 200 + count(*)) // (count(*) * 2) AS DECIMAL(36,0)) * 0.01 FROM allr a
          WHERE a.product_id = p.product_id), 0) END AS DECIMAL(3,2)) AS rating,
       CASE WHEN tt.product_id IS NULL THEN NULL
            ELSE CAST((SELECT count(*) FROM allr a WHERE a.product_id = p.product_id) AS INT) END AS review_count
FROM shop_products p LEFT JOIN touched tt ON p.product_id = tt.product_id""")
def _t12(t):
    """Purchase events become review creates; products that got a review get
    the new rating and count (others keep theirs)."""
    e = t.raw("events").where(F.col("event_type") == "purchase")
    n_parts = t.raw("part").select(F.count(F.lit(1))).scalar()
    ch = e.select(F.lit("create").alias("op"), F.col("event_id").alias("seq"), F.lit(None).cast("long").alias("review_id"),
                  "user_id", (F.col("event_id") % n_parts).alias("product_id"),
                  (1 + (F.col("event_id") * 7) % 5).cast("int").alias("rating"), F.lit(None).cast("string").alias("comment"))
    return C.apply_reviews(t, ch, EVENTS_AS_OF).products.select("product_id", "rating", "review_count")


@query("sweep_stale_transactions", f"""
SELECT transaction_id,
       CASE WHEN status = 'pending' AND created_at < {EA} - INTERVAL 30 MINUTE THEN 'failed' ELSE status END AS status,
       CASE WHEN status = 'pending' AND created_at < {EA} - INTERVAL 30 MINUTE THEN 'TIMEOUT' ELSE result_code END AS result_code,
       CASE WHEN status = 'pending' AND created_at < {EA} - INTERVAL 30 MINUTE
            THEN 'Transaction timeout - no response from M-Pesa' ELSE result_desc END AS result_desc,
       CASE WHEN status = 'pending' AND created_at < {EA} - INTERVAL 30 MINUTE THEN {EA} ELSE updated_at END AS updated_at
FROM shop_transactions""")
def _t14(t):
    """T14, 30 minutes."""
    return C.sweep_stale(t["mpesa_transactions"], EVENTS_AS_OF).table.select(
        "transaction_id", "status", "result_code", "result_desc", "updated_at")


@query("transaction_status_updates", f"""
SELECT transaction_id, CASE WHEN status = 'pending' THEN 'cancelled' ELSE status END AS status,
       result_code, CASE WHEN status = 'pending' THEN 'Expired' ELSE result_desc END AS result_desc,
       CASE WHEN status = 'pending' THEN {EA} ELSE updated_at END AS updated_at
FROM shop_transactions""")
def _t15(t):
    """Every pending transaction cancelled with text 'Expired' (code kept)."""
    tx = t["mpesa_transactions"]
    up = tx.where(F.col("status") == "pending").select(
        "checkout_request_id", F.col("transaction_id").alias("seq"), F.lit("cancelled").alias("status"),
        F.lit(None).cast("string").alias("mpesa_receipt_number"), F.lit(None).cast("string").alias("result_code"),
        F.lit("Expired").alias("result_desc"))
    table, _ = C.update_transaction_status(tx, up, EVENTS_AS_OF)
    return table.select("transaction_id", "status", "result_code", "result_desc", "updated_at")


@query("payment_request_outcomes", """
WITH req AS (SELECT o.order_id AS request_id, o.order_id, u.phone AS phone_number,
                    CASE WHEN o.order_id % 3 = 0 THEN o.total_amount + 1 ELSE o.total_amount END AS amount
             FROM shop_orders o JOIN shop_users u ON o.user_id = u.user_id)
SELECT request_id, CASE WHEN phone_number IS NULL OR phone_number = '' OR amount IS NULL OR amount = 0 THEN
                          'Phone number, amount, and order ID are required'
                        WHEN NOT regexp_full_match(phone_number, '(\\+?254|0)[17][0-9]{8}') THEN 'Invalid phone number format'
                        WHEN amount < 1 THEN 'Amount must be at least KSh 1'
                        WHEN abs(r.amount - o.total_amount) > 0.01 THEN 'Payment amount does not match order total'
                   END AS reason
FROM req r JOIN shop_orders o USING (order_id)""")
def _t16(t):
    """One payment request per order from the customer's phone; every third
    order sends its total + 1 (rejected). Outcome per request (NULL = registered)."""
    ch = C.register_payments(t, _payment_requests(t), EVENTS_AS_OF)
    return ch.affected.select(F.col("order_id").alias("request_id"), F.lit(None).cast("string").alias("reason")) \
        .unionByName(ch.rejected.select("request_id", "reason"))


def _payment_requests(t):
    return (t["orders"].join(t["users"].select("user_id", F.col("phone").alias("phone_number")), "user_id")
            .select(F.col("order_id").alias("request_id"), "order_id", "phone_number",
                    F.when(F.col("order_id") % 3 == 0, F.col("total_amount") + 1).otherwise(F.col("total_amount"))
                    .alias("amount"),
                    F.concat(F.lit("ws_CO_req_"), F.col("order_id").cast("string")).alias("checkout_request_id"),
                    F.concat(F.lit("mr_"), F.col("order_id").cast("string")).alias("merchant_request_id")))


@query("cascade_delete_abandoned_carts", """
SELECT * FROM (
  SELECT 'carts' AS table_name, count(*) AS deleted_rows FROM shop_carts WHERE status = 'abandoned'
  UNION ALL SELECT 'cart_items', count(*) FROM shop_cart_items
            WHERE cart_id IN (SELECT cart_id FROM shop_carts WHERE status = 'abandoned')) x
WHERE deleted_rows > 0""")
def _t6_carts(t):
    """Abandoned carts deleted with their lines (cascade); rows deleted per table."""
    ids = t["carts"].where(F.col("status") == "abandoned").select("cart_id")
    res = C.cascade_delete(t, "carts", ids)
    parts = [d.agg(F.count(F.lit(1)).alias("deleted_rows")).select(F.lit(n).alias("table_name"), "deleted_rows")
             for n, d in res.deleted.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("deleted_rows") > 0)


@query("cart_quantity_updates", """
SELECT ci.cart_item_id, CAST(CASE WHEN ci.quantity * 3 <= p.stock THEN ci.quantity * 3 ELSE ci.quantity END AS INT) AS quantity,
       ci.quantity * 3 <= p.stock AS accepted
FROM shop_cart_items ci JOIN shop_products p ON ci.product_id = p.product_id""")
def _t9(t):
    """Every cart line asks for three times its quantity; refused above stock."""
    items = t["cart_items"]
    sets = items.select("cart_item_id", F.col("cart_item_id").alias("seq"), (F.col("quantity") * 3).alias("quantity"))
    res = C.set_cart_quantities(t, sets, EVENTS_AS_OF)
    return res.cart_items.join(res.decisions.select("cart_item_id", "accepted"), "cart_item_id").select(
        "cart_item_id", "quantity", "accepted")


@query("patch_invalid_values", """
SELECT product_id, CAST(CASE WHEN (product_id * 7) % 50 >= 10 THEN (product_id * 7) % 50 - 10 ELSE stock END AS INT) AS stock,
       CASE WHEN (product_id * 7) % 50 < 10 THEN 'stock_non_negative' END AS reason
FROM shop_products""")
def _t2_invalid(t):
    """Every product's stock lowered by ten; a change below zero is refused
    and the product keeps its stock."""
    ch = t["products"].select("product_id", F.col("product_id").alias("seq"), (F.col("stock") - 10).alias("stock"),
                              F.array(F.lit("stock")).alias("changed"))
    res = C.patch(t["products"], ch, "product_id", name="products")
    return res.table.select("product_id", "stock").join(res.rejected.select("product_id", "reason"), "product_id", "left")


@query("bulk_update_invalid_values", """
SELECT product_id, CASE WHEN product_id % 3 = 0 THEN price ELSE CAST(0.5 AS DECIMAL(10,2)) END AS price,
       CASE WHEN product_id % 3 = 0 THEN 'price_positive' END AS reason FROM shop_products""")
def _t3_invalid(t):
    """A price of 0.50 for all products, 0 for those with a sale price; the
    latter are refused."""
    price = F.when(F.col("sale_price").isNull(), F.lit(0.5)).otherwise(F.lit(0))
    res = C.bulk_update(t["products"], t["products"].select("product_id"), {"price": price}, "product_id", name="products")
    return res.table.select("product_id", "price").join(res.rejected.select("product_id", "reason"), "product_id", "left")


def _new_orders(t):
    """Every order placed again; every seventh by an unknown user, every
    eleventh without an amount."""
    o = F.col("order_id")
    return t["orders"].select(
        o.alias("seq"), F.when(o % 7 == 0, F.col("user_id") + 100_000_000).otherwise(F.col("user_id")).alias("user_id"),
        "address_id", F.when(o % 11 == 0, F.lit(0)).otherwise(F.col("total_amount")).cast("decimal(12,2)").alias("total_amount"))


@query("orders_inserted", """
SELECT (SELECT max(order_id) FROM shop_orders) + row_number() OVER (ORDER BY o.order_id) AS order_id, o.user_id, o.total_amount,
       'pending' AS status
FROM shop_orders o JOIN shop_users u ON u.user_id = o.user_id JOIN shop_addresses a ON a.address_id = o.address_id
WHERE o.order_id % 7 <> 0 AND o.order_id % 11 <> 0 AND o.total_amount > 0""")
def _t1(t):
    """The new orders that pass, with defaults and new keys."""
    res = C.insert_rows(t["orders"], _new_orders(t), "orders", {"status": "pending", "created_at": "as_of"}, ORDERS_AS_OF, parents=t)
    return res.affected.select("order_id", "user_id", "total_amount", "status")


@query("orders_insert_rejected", """
SELECT o.order_id AS seq, CASE WHEN o.order_id % 11 = 0 OR NOT o.total_amount > 0 THEN 'total_amount_positive'
         WHEN o.order_id % 7 = 0 OR u.user_id IS NULL THEN 'missing users' ELSE 'missing addresses' END AS reason
FROM shop_orders o LEFT JOIN shop_users u ON u.user_id = o.user_id LEFT JOIN shop_addresses a ON a.address_id = o.address_id
WHERE o.order_id % 11 = 0 OR o.order_id % 7 = 0 OR NOT o.total_amount > 0 OR u.user_id IS NULL OR a.address_id IS NULL""")
def _t1_rejected(t):
    """The new orders that are refused, with the reason."""
    res = C.insert_rows(t["orders"], _new_orders(t), "orders", {"status": "pending", "created_at": "as_of"}, ORDERS_AS_OF, parents=t)
    return res.rejected.select("seq", "reason")


def _review_changes(t):
    """Every fifth review deleted and written again right after, the next ones
    updated to ratings from 0 to 7, the next ones updated by someone else."""
    r, e = t["reviews"], F.col("review_id")
    none = F.lit(None).cast("string")
    parts = [
        r.where(e % 5 == 0).select(F.lit("delete").alias("op"), (e * 10 + 1).alias("seq"), "review_id", "user_id", "product_id",
                                   F.lit(None).cast("int").alias("rating"), none.alias("comment")),
        r.where(e % 5 == 0).select(F.lit("create").alias("op"), (e * 10 + 2).alias("seq"), F.lit(None).cast("long").alias("review_id"),
                                   "user_id", "product_id", (1 + e % 4).cast("int").alias("rating"), none.alias("comment")),
        r.where(e % 5 == 1).select(F.lit("update").alias("op"), (e * 10 + 3).alias("seq"), "review_id", "user_id", "product_id",
                                   (e % 8).cast("int").alias("rating"), none.alias("comment")),
        r.where(e % 5 == 2).select(F.lit("update").alias("op"), (e * 10 + 3).alias("seq"), "review_id", (F.col("user_id") + 1).alias("user_id"),
                                   "product_id", F.lit(1).alias("rating"), none.alias("comment"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


_PAIRS = """
pairs AS (SELECT user_id, product_id, count_if(review_id % 5 <> 0) AS stay, max(review_id) AS last FROM shop_reviews
          GROUP BY user_id, product_id),
again AS (SELECT r.review_id, r.user_id, r.product_id, p.stay = 0 AND p.last = r.review_id AS free,
                 u.user_id IS NOT NULL AS known
          FROM shop_reviews r JOIN pairs p ON p.user_id = r.user_id AND p.product_id = r.product_id
          LEFT JOIN shop_users u ON u.user_id = r.user_id WHERE r.review_id % 5 = 0)"""


@query("review_changes", f"""
WITH {_PAIRS}
SELECT review_id, user_id, product_id, CAST(CASE WHEN review_id % 5 = 1 AND review_id % 8 BETWEEN 1 AND 5 THEN review_id % 8
                                                 ELSE rating END AS INT) AS rating
FROM shop_reviews WHERE review_id % 5 <> 0
UNION ALL
SELECT (SELECT max(review_id) FROM shop_reviews) + row_number() OVER (ORDER BY review_id), user_id, product_id,
       CAST(1 + review_id % 4 AS INT) FROM again WHERE free AND known""")
def _t12_changes(t):
    """Deletes, re-creates and updates in seq order; the reviews afterwards."""
    return C.apply_reviews(t, _review_changes(t), EVENTS_AS_OF).reviews.select("review_id", "user_id", "product_id", "rating")


@query("review_changes_rejected", f"""
WITH {_PAIRS}
SELECT review_id * 10 + 3 AS seq, 'rating_range' AS reason FROM shop_reviews
WHERE review_id % 5 = 1 AND NOT review_id % 8 BETWEEN 1 AND 5
UNION ALL SELECT review_id * 10 + 3, 'not the author' FROM shop_reviews WHERE review_id % 5 = 2
UNION ALL SELECT review_id * 10 + 2, CASE WHEN NOT known THEN 'missing users' ELSE 'duplicate user_id,product_id' END
FROM again WHERE NOT (free AND known)""")
def _t12_rejected(t):
    """The refused review changes and why."""
    return C.apply_reviews(t, _review_changes(t), EVENTS_AS_OF).rejected.select("seq", "reason")


@query("cart_sets_in_order", """
WITH s AS (
  SELECT ci.cart_item_id * 3 + k AS seq, ci.cart_item_id, k, p.stock,
         CASE k WHEN 0 THEN ci.quantity * 2 WHEN 1 THEN ci.quantity + 100000 ELSE 0 END AS quantity
  FROM shop_cart_items ci JOIN shop_products p ON p.product_id = ci.product_id, range(0, 3) r(k))
SELECT seq, cart_item_id, CAST(quantity AS INT) AS quantity,
       CASE WHEN quantity <= 0 THEN 'Quantity must be positive' WHEN quantity > stock THEN 'Insufficient stock' END AS reason
FROM s""")
def _t9_order(t):
    """Three requests per line (twice the quantity, far too much, zero),
    each decided by itself."""
    return C.set_cart_quantities(t, _three_sets(t), EVENTS_AS_OF).decisions.select("seq", "cart_item_id", "quantity", "reason")


def _three_sets(t):
    i, q = F.col("cart_item_id"), F.col("quantity")
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    return t["cart_items"].select(i, q, k.alias("k")).select(
        (i * 3 + F.col("k")).alias("seq"), "cart_item_id",
        F.when(F.col("k") == 0, q * 2).when(F.col("k") == 1, q + 100_000).otherwise(0).cast("int").alias("quantity"))


@query("cart_lines_after_sets", """
SELECT ci.cart_item_id, CAST(CASE WHEN ci.quantity * 2 <= p.stock THEN ci.quantity * 2 ELSE ci.quantity END AS INT) AS quantity
FROM shop_cart_items ci JOIN shop_products p ON p.product_id = ci.product_id""")
def _t9_lines(t):
    """The lines after those requests: the last valid one stands."""
    return C.set_cart_quantities(t, _three_sets(t), EVENTS_AS_OF).cart_items.select("cart_item_id", "quantity")


@query("cart_line_removals", f"""
SELECT c.cart_id, CASE WHEN c.cart_id IN (SELECT cart_id FROM shop_cart_items WHERE cart_item_id % 4 = 0) THEN {EA}
                       ELSE c.updated_at END AS updated_at,
       (SELECT count(*) FROM shop_cart_items ci WHERE ci.cart_id = c.cart_id AND ci.cart_item_id % 4 <> 0) AS line_count
FROM shop_carts c""")
def _t9_remove(t):
    """Every fourth line removed; its cart is touched."""
    ids = t["cart_items"].where(F.col("cart_item_id") % 4 == 0).select("cart_item_id")
    res = C.remove_cart_items(t, ids, EVENTS_AS_OF)
    lines = res.cart_items.groupBy("cart_id").agg(F.count(F.lit(1)).alias("line_count"))
    return res.carts.select("cart_id", "updated_at").join(lines, "cart_id", "left").fillna(0, ["line_count"])


@query("confirmed_payments", f"""
SELECT p.payment_id, CASE WHEN p.is_confirmed = false THEN o.status = 'delivered' ELSE p.is_confirmed END AS is_confirmed,
       CASE WHEN p.is_confirmed = false AND o.status = 'delivered' THEN TIMESTAMP '{ORDERS_AS_OF}' END AS confirmed_at
FROM shop_payments p JOIN shop_orders o ON o.order_id = p.order_id""")
def _t11_payments(t):
    """The payments after the decisions of ``confirm_unconfirmed_payments``."""
    return C.confirm_payments(t, _payment_decisions(t), ORDERS_AS_OF)[0]["payments"].select(
        "payment_id", "is_confirmed", "confirmed_at")


@query("payments_confirmed_by_order", f"""
SELECT payment_id, CASE WHEN order_id % 3 = 0 THEN order_id % 2 = 0 ELSE is_confirmed END AS is_confirmed,
       CASE WHEN order_id % 3 = 0 AND order_id % 2 = 0 THEN TIMESTAMP '{ORDERS_AS_OF}' END AS confirmed_at FROM shop_payments""")
def _t11_by_order(t):
    """T11 by order: every third order's payment set, the payment table only."""
    dec = t["orders"].where(F.col("order_id") % 3 == 0).select("order_id", F.col("order_id").alias("seq"),
                                                             (F.col("order_id") % 2 == 0).alias("is_confirmed"))
    return C.confirm_payments_by_order(t, dec, ORDERS_AS_OF).table.select("payment_id", "is_confirmed", "confirmed_at")


def _repeated_requests(t):
    """The requests of ``payment_request_outcomes``, every tenth sent twice with one checkout id."""
    req = _payment_requests(t)
    return req.unionByName(req.where(F.col("order_id") % 10 == 0).withColumn("request_id", F.col("request_id") + 10**12))


@query("payment_requests_registered", f"""
WITH good AS (
  SELECT o.order_id, o.total_amount AS amount FROM shop_orders o JOIN shop_users u ON o.user_id = u.user_id
  WHERE o.order_id % 3 <> 0 AND o.total_amount >= 1 AND regexp_full_match(u.phone, '(\\+?254|0)[17][0-9]{{8}}'))
SELECT (SELECT max(transaction_id) FROM shop_transactions) + row_number() OVER (ORDER BY order_id) AS transaction_id, order_id,
       'ws_CO_req_' || CAST(order_id AS VARCHAR) AS checkout_request_id, amount, 'pending' AS status FROM good""")
def _t16_rows(t):
    """The transactions that the requests add; a repeated checkout id adds one."""
    return C.register_payments(t, _repeated_requests(t), EVENTS_AS_OF).affected.select(
        "transaction_id", "order_id", "checkout_request_id", "amount", "status")


@query("payment_requests_repeated", """
SELECT o.order_id + 1000000000000 AS request_id,
       CASE WHEN o.order_id % 3 = 0 THEN 'Payment amount does not match order total'
            ELSE 'duplicate checkout_request_id in batch' END AS reason
FROM shop_orders o JOIN shop_users u ON o.user_id = u.user_id WHERE o.order_id % 10 = 0""")
def _t16_repeated(t):
    """What becomes of the repeated requests."""
    return C.register_payments(t, _repeated_requests(t), EVENTS_AS_OF).rejected.where(
        F.col("request_id") >= 10**12).select("request_id", "reason")


@query("merge_category_chain", """
SELECT CASE WHEN category_id <= 6 THEN 7 ELSE category_id END AS category_id, count(*) AS product_count
FROM shop_products GROUP BY 1""")
def _t7_chain(t):
    """1 -> 2 -> .. -> 7, a chain that ends in the last category."""
    pairs = t["categories"].where(F.col("category_id") < 7).select(F.col("category_id").alias("source_id"),
                                                                   (F.col("category_id") + 1).alias("target_id"))
    out, _ = C.merge_categories(t, pairs, EVENTS_AS_OF)
    return out["products"].groupBy("category_id").agg(F.count(F.lit(1)).alias("product_count"))


# ---------------------------------------------------------------- decided in order, checked

def _cart_patches(t):
    """Per cart, in order: a status, a session id (breaks the owner rule of a
    user's cart), no user (breaks it as well), and for even carts a session
    instead of the user."""
    c = F.col("cart_id")
    carts = t["carts"].select("cart_id")

    def change(k, rows, status=None, user=None, session=None, names=()):
        return rows.select("cart_id", (c * 4 + k).alias("seq"), F.lit(status).cast("string").alias("status"), F.lit(user).cast("long").alias("user_id"),
                           (F.concat(F.lit(session), c.cast("string")) if session else F.lit(None).cast("string")).alias("session_id"),
                           F.array(*map(F.lit, names)).alias("changed"))
    return (change(0, carts, status="converted", names=["status"]).unionByName(change(1, carts, session="late_", names=["session_id"]))
            .unionByName(change(2, carts, names=["user_id"]))
            .unionByName(change(3, carts.where(c % 2 == 0), session="moved_", names=["user_id", "session_id"])))


@query("patch_in_order", """
SELECT cart_id, cart_id * 4 + k AS seq, CASE WHEN k IN (1, 2) AND cart_id % 4 <> 0 THEN 'cart_owner' END AS reason
FROM shop_carts, range(0, 4) r(k) WHERE k < 3 OR cart_id % 2 = 0""")
def _t2_order(t):
    """Changes decided one after the other; the reason of the refused ones."""
    changes = _cart_patches(t)
    refused = C.patch(t["carts"], changes, "cart_id", name="carts").rejected.select("cart_id", "seq", "reason")
    return changes.select("cart_id", "seq").join(refused, ["cart_id", "seq"], "left")


@query("patch_in_order_carts", """
SELECT cart_id, CASE WHEN cart_id % 2 = 0 THEN NULL ELSE user_id END AS user_id,
       CASE WHEN cart_id % 2 = 0 THEN 'moved_' || CAST(cart_id AS VARCHAR) ELSE session_id END AS session_id, 'converted' AS status
FROM shop_carts""")
def _t2_order_carts(t):
    """The carts after those changes: what was valid at its turn stays."""
    return C.patch(t["carts"], _cart_patches(t), "cart_id", name="carts").table.select("cart_id", "user_id", "session_id", "status")


@query("cart_claims_checked", """
WITH claims AS (
  SELECT 'guest_' || CAST(cart_id AS VARCHAR) AS session_id, cart_id * 2 AS seq,
         CASE cart_id % 3 WHEN 0 THEN 888888888 WHEN 1 THEN NULL ELSE cart_id END AS user_id FROM shop_carts
  UNION ALL SELECT 'guest_' || CAST(cart_id AS VARCHAR), cart_id * 2 + 1, cart_id + 1 FROM shop_carts WHERE cart_id % 8 = 0)
SELECT c.session_id, c.seq, CASE WHEN g.session_id IS NULL THEN 'Cart not found' WHEN c.user_id IS NULL THEN 'user_id is required'
                                 WHEN u.user_id IS NULL THEN 'missing users' END AS reason
FROM claims c LEFT JOIN shop_carts g ON g.session_id = c.session_id AND g.user_id IS NULL
LEFT JOIN shop_users u ON u.user_id = c.user_id""")
def _t10_checked(t):
    """Claims without a user, by unknown users, of carts that are nobody's
    guest cart; the reason of each claim (NULL: valid)."""
    claims = _claims(t)
    refused = C.claim_carts(t, claims, EVENTS_AS_OF).rejected.select("seq", "reason")
    return claims.select("session_id", "seq").join(refused, "seq", "left")


def _claims(t):
    c = F.col("cart_id")
    session = F.concat(F.lit("guest_"), c.cast("string")).alias("session_id")
    user = F.when(c % 3 == 0, F.lit(888888888)).when(c % 3 == 2, c).cast("long")
    return t["carts"].select(session, (c * 2).alias("seq"), user.alias("user_id")).unionByName(
        t["carts"].where(c % 8 == 0).select(session, (c * 2 + 1).alias("seq"), (c + 1).alias("user_id")))


@query("cart_claims_applied", f"""
WITH ok AS (
  SELECT 'guest_' || CAST(cart_id AS VARCHAR) AS session_id, cart_id + 1 AS user_id, 1 AS k FROM shop_carts WHERE cart_id % 8 = 0
  UNION ALL SELECT 'guest_' || CAST(cart_id AS VARCHAR), cart_id, 0 FROM shop_carts WHERE cart_id % 3 = 2),
won AS (SELECT session_id, max_by(ok.user_id, k) AS user_id FROM ok JOIN shop_users u ON u.user_id = ok.user_id GROUP BY session_id)
SELECT c.cart_id, CASE WHEN c.user_id IS NULL AND w.user_id IS NOT NULL THEN w.user_id ELSE c.user_id END AS user_id,
       CASE WHEN c.user_id IS NULL AND w.user_id IS NOT NULL THEN NULL ELSE c.session_id END AS session_id,
       CASE WHEN c.user_id IS NULL AND w.user_id IS NOT NULL THEN {EA} ELSE c.updated_at END AS updated_at
FROM shop_carts c LEFT JOIN won w ON w.session_id = c.session_id""")
def _t10_applied(t):
    """The carts after those claims."""
    return C.claim_carts(t, _claims(t), EVENTS_AS_OF).table.select("cart_id", "user_id", "session_id", "updated_at")


@query("review_changes_products", f"""
WITH {_PAIRS},
after AS (
  SELECT product_id, CAST(CASE WHEN review_id % 5 = 1 AND review_id % 8 BETWEEN 1 AND 5 THEN review_id % 8 ELSE rating END AS INT) AS rating
  FROM shop_reviews WHERE review_id % 5 <> 0
  UNION ALL SELECT product_id, CAST(1 + review_id % 4 AS INT) FROM again WHERE free AND known),
touched AS (
  SELECT product_id FROM shop_reviews WHERE review_id % 5 = 0 OR (review_id % 5 = 1 AND review_id % 8 BETWEEN 1 AND 5)),
stats AS (SELECT product_id, count(*) AS n, sum(rating) AS total FROM after GROUP BY product_id)
SELECT p.product_id,
       CAST(CASE WHEN p.product_id IN (SELECT product_id FROM touched)
            THEN coalesce(CAST((total * 200 + n) // (n * 2) AS DECIMAL(36,0)) * 0.01, 0) END AS DECIMAL(3,2)) AS rating,
       CAST(CASE WHEN p.product_id IN (SELECT product_id FROM touched) THEN coalesce(n, 0) END AS INT) AS review_count,
       CASE WHEN p.product_id IN (SELECT product_id FROM touched) THEN {EA} ELSE p.updated_at END AS updated_at
FROM shop_products p LEFT JOIN stats s ON s.product_id = p.product_id""")
def _t12_products(t):
    """The products after those review changes (and an unknown operation on
    every review): refused changes touch nothing."""
    changes = _review_changes(t).unionByName(t["reviews"].select(
        F.lit("merge").alias("op"), (F.col("review_id") * 10 + 9).alias("seq"), "review_id", "user_id", "product_id", "rating", "comment"))
    return C.apply_reviews(t, changes, EVENTS_AS_OF).products.select("product_id", "rating", "review_count", "updated_at")


def _status_updates(t):
    """Updates of every transaction: every fourth to an unknown status, every
    fifth with a code of 20 characters, every seventh under an unknown id."""
    x, tx = F.col("transaction_id"), t["mpesa_transactions"]
    none = F.lit(None).cast("string")
    return tx.select(
        F.when(x % 7 == 0, F.concat("checkout_request_id", F.lit("_x"))).otherwise(F.col("checkout_request_id")).alias("checkout_request_id"),
        x.alias("seq"), F.when(x % 4 == 0, "bogus").otherwise("cancelled").alias("status"), none.alias("mpesa_receipt_number"),
        F.when(x % 5 == 0, F.lit("1" * 20)).alias("result_code"), F.lit("Expired").alias("result_desc"))


_REFUSED = """CASE WHEN transaction_id % 5 = 0 AND transaction_id % 4 = 0 THEN 'result_code_max_length_10,status_allowed'
                   WHEN transaction_id % 5 = 0 THEN 'result_code_max_length_10' WHEN transaction_id % 4 = 0 THEN 'status_allowed' END"""


@query("transaction_status_invalid", f"""
SELECT transaction_id AS seq, CASE WHEN transaction_id % 7 <> 0 THEN transaction_id END AS transaction_id,
       transaction_id % 7 <> 0 AND transaction_id % 5 <> 0 AND transaction_id % 4 <> 0 AS success,
       CASE WHEN transaction_id % 7 = 0 THEN 'Transaction not found'
            ELSE coalesce('Transaction update refused: ' || {_REFUSED}, 'Transaction updated successfully') END AS message
FROM shop_transactions""")
def _t15_invalid(t):
    """The result of every update, forbidden values refused."""
    return C.update_transaction_status(t["mpesa_transactions"], _status_updates(t), EVENTS_AS_OF)[1].select(
        "seq", "transaction_id", "success", "message")


@query("transaction_status_checked", f"""
WITH ok AS (SELECT transaction_id FROM shop_transactions WHERE transaction_id % 7 <> 0 AND transaction_id % 5 <> 0 AND transaction_id % 4 <> 0)
SELECT t.transaction_id, CASE WHEN ok.transaction_id IS NULL THEN status ELSE 'cancelled' END AS status, result_code,
       CASE WHEN ok.transaction_id IS NULL THEN result_desc ELSE 'Expired' END AS result_desc,
       CASE WHEN ok.transaction_id IS NULL THEN updated_at ELSE {EA} END AS updated_at
FROM shop_transactions t LEFT JOIN ok ON ok.transaction_id = t.transaction_id""")
def _t15_checked(t):
    """The transactions after those updates."""
    return C.update_transaction_status(t["mpesa_transactions"], _status_updates(t), EVENTS_AS_OF)[0].select(
        "transaction_id", "status", "result_code", "result_desc", "updated_at")
