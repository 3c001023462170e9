"""Joined views, listings, lookups and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from storefront.operators import enrich as E
from storefront.plans.registry import query


@query("product_catalog", """
SELECT p.product_id, p.title, p.price, p.sale_price, p.stock, c.name AS category_name, u.name AS seller_name,
       p.created_at, p.updated_at
FROM shop_products p JOIN shop_categories c ON p.category_id = c.category_id
JOIN shop_sellers s ON p.seller_id = s.seller_id JOIN shop_users u ON s.user_id = u.user_id""")
def _j1(t):
    """J1 (columns the driver data fills)."""
    return E.product_catalog(t).select("product_id", "title", "price", "sale_price", "stock", "category_name",
                                       "seller_name", "created_at", "updated_at")


@query("products_by_category", """
SELECT p.product_id, p.title, p.price, c.name AS category_name, u.name AS seller_name
FROM shop_products p JOIN shop_categories c ON p.category_id = c.category_id
JOIN shop_sellers s ON p.seller_id = s.seller_id JOIN shop_users u ON s.user_id = u.user_id
WHERE c.name ILIKE '%Ar%'""")
def _p3(t):
    """P3 with the search text 'Ar'."""
    return E.products_by_category(t, "Ar").select("product_id", "title", "price", "category_name", "seller_name")


@query("order_lines", """
SELECT o.order_id, oi.order_item_id, o.user_id, o.total_amount, o.status, o.created_at, u.name AS user_name,
       p.product_id, p.title AS product_name, p.price AS product_price, oi.quantity AS product_quantity,
       a.city, a.street
FROM shop_orders o JOIN shop_users u ON o.user_id = u.user_id JOIN shop_addresses a ON o.address_id = a.address_id
JOIN shop_order_items oi ON o.order_id = oi.order_id JOIN shop_products p ON oi.product_id = p.product_id""")
def _j2(t):
    """J2 (columns the driver data fills)."""
    return E.order_lines(t).select("order_id", "order_item_id", "user_id", "total_amount", "status", "created_at",
                                   "user_name", "product_id", "product_name", "product_price", "product_quantity",
                                   "city", "street")


@query("order_documents", """
WITH it AS (SELECT order_id, count(*) AS item_count, CAST(sum(quantity * unit_price) AS DECIMAL(38,2)) AS items_total
            FROM shop_order_items GROUP BY order_id)
SELECT o.order_id, o.status, u.name AS customer_name, a.city, coalesce(it.item_count, 0) AS item_count,
       coalesce(it.items_total, CAST(0 AS DECIMAL(38,2))) AS items_total, pay.method AS payment_method,
       pay.is_confirmed AS payment_confirmed
FROM shop_orders o LEFT JOIN shop_users u ON o.user_id = u.user_id LEFT JOIN shop_addresses a ON o.address_id = a.address_id
LEFT JOIN it ON o.order_id = it.order_id LEFT JOIN shop_payments pay ON o.order_id = pay.order_id""")
def _j3(t):
    """J3 headers for every order (item count and total summarise the child rows)."""
    d = E.order_documents(t)
    return d.header.select("order_id", "status", "customer_name", "city", "item_count", "items_total",
                           F.col("payment.method").alias("payment_method"),
                           F.col("payment.is_confirmed").alias("payment_confirmed"))


@query("order_document_items", """
SELECT oi.order_item_id, oi.order_id, p.title AS product_title, c.name AS category_name, s.business_name,
       CAST(oi.quantity * oi.unit_price AS DECIMAL(38,2)) AS line_total
FROM shop_order_items oi LEFT JOIN shop_products p ON oi.product_id = p.product_id
LEFT JOIN shop_categories c ON p.category_id = c.category_id LEFT JOIN shop_sellers s ON p.seller_id = s.seller_id""")
def _j3_items(t):
    """J3 child rows: every order line with product, category and seller."""
    return E.order_documents(t).children["items"].select(
        "order_item_id", "order_id", "product_title", "category_name", "business_name",
        F.col("line_total").cast("decimal(38,2)").alias("line_total"))


@query("product_documents", """
WITH s AS (SELECT product_id, count(order_item_id) AS times_ordered, CAST(sum(quantity) AS BIGINT) AS units_sold,
                  CAST(sum(quantity * unit_price) AS DECIMAL(38,2)) AS revenue FROM shop_order_items GROUP BY product_id),
     r AS (SELECT product_id, count(*) AS n FROM shop_reviews GROUP BY product_id),
     i AS (SELECT product_id, count(*) AS n FROM shop_product_images GROUP BY product_id)
SELECT p.product_id, p.title, c.name AS category_name, u.name AS seller_name, s.times_ordered, s.units_sold, s.revenue,
       coalesce(r.n, 0) AS reviews_found, coalesce(i.n, 0) AS image_count
FROM shop_products p LEFT JOIN shop_categories c ON p.category_id = c.category_id
LEFT JOIN (shop_sellers se JOIN shop_users u ON se.user_id = u.user_id) ON p.seller_id = se.seller_id
LEFT JOIN s ON p.product_id = s.product_id LEFT JOIN r ON p.product_id = r.product_id
LEFT JOIN i ON p.product_id = i.product_id""")
def _j4(t):
    """J4 headers for every product."""
    return E.product_documents(t).header.select("product_id", "title", "category_name", "seller_name",
                                                "times_ordered", "units_sold", "revenue",
                                                F.col("reviews_found").cast("long").alias("reviews_found"), "image_count")


@query("seller_documents", """
WITH so AS (SELECT p.seller_id, o.order_id, sum(oi.quantity * oi.unit_price) AS rev, count(*) AS lines
            FROM shop_products p JOIN shop_order_items oi ON p.product_id = oi.product_id
            JOIN shop_orders o ON oi.order_id = o.order_id WHERE o.status NOT IN ('cancelled','failed')
            GROUP BY p.seller_id, o.order_id),
     ss AS (SELECT seller_id, count(*) AS total_orders, sum(rev) AS rev, sum(lines) AS lines FROM so GROUP BY seller_id),
     pc AS (SELECT seller_id, count(*) AS n FROM shop_products GROUP BY seller_id)
SELECT s.seller_id, s.business_name, u.name, u.email, coalesce(pc.n, 0) AS product_count,
       coalesce(ss.total_orders, 0) AS total_orders,
       CAST(coalesce(ss.rev, 0) AS DECIMAL(38,2)) AS total_revenue
FROM shop_sellers s LEFT JOIN shop_users u ON s.user_id = u.user_id LEFT JOIN pc ON s.seller_id = pc.seller_id
LEFT JOIN ss ON s.seller_id = ss.seller_id""")
def _j5(t):
    """J5 headers for every seller."""
    return E.seller_documents(t).header.select("seller_id", "business_name", "name", "email", "product_count",
                                               "total_orders", "total_revenue")


@query("review_feed", """
SELECT r.review_id, r.user_id, r.product_id, r.rating, r.comment, r.created_at, u.name AS user_name,
       u.email AS user_email, p.title AS product_title
FROM shop_reviews r JOIN shop_users u ON r.user_id = u.user_id JOIN shop_products p ON r.product_id = p.product_id""")
def _j6(t):
    """J6, all reviews."""
    return E.review_feed(t)


@query("recent_reviews", """
SELECT r.review_id, r.user_id, r.product_id, r.rating, r.comment, r.created_at, u.name AS user_name,
       u.email AS user_email, p.title AS product_title
FROM shop_reviews r JOIN shop_users u ON r.user_id = u.user_id JOIN shop_products p ON r.product_id = p.product_id
ORDER BY r.created_at DESC NULLS FIRST, r.review_id LIMIT 20""")
def _j6_top(t):
    """J6, newest 20."""
    return E.review_feed(t, 20)


@query("payments_view", """
SELECT p.payment_id, p.method, p.amount, p.is_confirmed, o.order_id, o.user_id, o.total_amount, o.status,
       o.created_at AS order_created_at, p.created_at AS payment_created_at
FROM shop_payments p JOIN shop_orders o ON p.order_id = o.order_id""")
def _j7(t):
    """J7 (columns the driver data fills)."""
    return E.payments_view(t).select("payment_id", "method", "amount", "is_confirmed", "order_id", "user_id",
                                     "total_amount", "status", "order_created_at", "payment_created_at")


@query("pending_payments", """
SELECT p.payment_id, p.order_id, p.method, p.amount, p.created_at, o.total_amount AS order_total,
       o.status AS order_status, u.name AS customer_name, u.email AS customer_email, u.phone AS customer_phone
FROM shop_payments p JOIN shop_orders o ON p.order_id = o.order_id JOIN shop_users u ON o.user_id = u.user_id
WHERE p.is_confirmed = false""")
def _j8(t):
    """J8."""
    return E.pending_payments(t).select("payment_id", "order_id", "method", "amount", "created_at", "order_total",
                                        "order_status", "customer_name", "customer_email", "customer_phone")


@query("cart_lines", """
SELECT ci.cart_item_id, ci.cart_id, ci.product_id, ci.quantity, ci.unit_price, ci.added_at, p.title AS product_title,
       p.price AS current_price, p.sale_price AS current_sale_price, p.stock AS available_stock,
       c.name AS category_name, CAST(ci.quantity * ci.unit_price AS DECIMAL(38,2)) AS subtotal
FROM shop_cart_items ci JOIN shop_products p ON ci.product_id = p.product_id
JOIN shop_categories c ON p.category_id = c.category_id""")
def _j9(t):
    """J9."""
    return E.cart_lines(t).select("cart_item_id", "cart_id", "product_id", "quantity", "unit_price", "added_at",
                                  "product_title", "current_price", "current_sale_price", "available_stock",
                                  "category_name", F.col("subtotal").cast("decimal(38,2)").alias("subtotal"))


@query("user_profiles", """
SELECT u.user_id, u.name, u.email, u.phone, u.role, u.created_at, a.address_id, a.city, a.street, a.is_default
FROM shop_users u LEFT JOIN shop_addresses a ON u.user_id = a.user_id""")
def _j10(t):
    """J10."""
    return E.user_profiles(t).select("user_id", "name", "email", "phone", "role", "created_at", "address_id", "city",
                                     "street", "is_default")


@query("seller_directory", """
SELECT s.seller_id, u.user_id, u.name, u.email, u.phone, s.business_name, s.total_sales, s.created_at
FROM shop_sellers s JOIN shop_users u ON s.user_id = u.user_id""")
def _j11(t):
    """J11 seller directory."""
    return E.seller_directory(t).select("seller_id", "user_id", "name", "email", "phone", "business_name",
                                        "total_sales", "created_at")


@query("users_with_seller", """
SELECT u.user_id, u.name, u.role, s.seller_id, s.business_name
FROM shop_users u LEFT JOIN shop_sellers s ON u.user_id = s.user_id AND u.role = 'seller'""")
def _j11b(t):
    """J11 users with seller details."""
    return E.users_with_seller(t).select("user_id", "name", "role", "seller_id", "business_name")


@query("offer_links", """
SELECT po.product_id, po.offer_id, p.title AS product_name, o.title AS offer_title
FROM shop_product_offers po JOIN shop_products p ON po.product_id = p.product_id
JOIN shop_offers o ON po.offer_id = o.offer_id""")
def _j12(t):
    """J12."""
    return E.offer_links(t)


@query("low_stock", """
SELECT p.product_id, p.title, p.stock, p.price, c.name AS category_name, s.business_name AS seller_name,
       u.email AS seller_email
FROM shop_products p JOIN shop_categories c ON p.category_id = c.category_id
JOIN shop_sellers s ON p.seller_id = s.seller_id JOIN shop_users u ON s.user_id = u.user_id
WHERE p.stock <= 10 AND p.stock > 0""")
def _j13(t):
    """J13, threshold 10."""
    return E.low_stock(t, 10)


@query("out_of_stock", """
SELECT p.product_id, p.title, p.price, c.name AS category_name, s.business_name AS seller_name,
       u.email AS seller_email, p.updated_at AS last_updated
FROM shop_products p JOIN shop_categories c ON p.category_id = c.category_id
JOIN shop_sellers s ON p.seller_id = s.seller_id JOIN shop_users u ON s.user_id = u.user_id
WHERE p.stock = 0""")
def _j14(t):
    """J14."""
    return E.out_of_stock(t)


@query("user_listing", """
SELECT user_id, role, name, email, phone, created_at FROM shop_users""")
def _p1(t):
    """P1 for users (no password hash; columns the driver data fills)."""
    return E.user_listing(t).select("user_id", "role", "name", "email", "phone", "created_at")


@query("transaction_orders_found", """
SELECT * FROM shop_orders WHERE order_id IN (SELECT order_id FROM shop_transactions)""")
def _p2_found(t):
    """Orders referenced by payment transactions."""
    return E.lookup(t["orders"], t["mpesa_transactions"], "order_id").found.select(
        "order_id", "user_id", "address_id", "total_amount", "status", "notes", "created_at")


@query("transaction_orders_missing", """
SELECT DISTINCT order_id FROM shop_transactions WHERE order_id NOT IN (SELECT order_id FROM shop_orders)""")
def _p2_missing(t):
    """Order keys of payment transactions that match no order."""
    return E.lookup(t["orders"], t["mpesa_transactions"], "order_id").missing


@query("flagged_reviews", """
SELECT r.review_id, r.user_id, r.product_id, r.rating, r.comment, r.created_at, u.name AS user_name,
       u.email AS user_email, p.title AS product_title
FROM shop_reviews r JOIN shop_users u ON r.user_id = u.user_id JOIN shop_products p ON r.product_id = p.product_id
WHERE r.rating <= 2 OR r.comment ILIKE '%scam%' OR r.comment ILIKE '%fake%' OR r.comment ILIKE '%fraud%'""")
def _p4(t):
    """P4."""
    return E.flagged_reviews(t)


@query("active_carts", """
WITH it AS (SELECT cart_id, count(*) AS item_count, sum(quantity * unit_price) AS amt FROM shop_cart_items GROUP BY cart_id)
SELECT c.cart_id, c.user_id, c.session_id, c.status, c.created_at, c.updated_at, coalesce(it.item_count, 0) AS item_count,
       CAST(coalesce(it.amt, 0) AS DECIMAL(38,2)) AS total_amount,
       CASE WHEN c.user_id IS NOT NULL THEN 'user' ELSE 'session' END AS owner_kind
FROM shop_carts c LEFT JOIN it ON c.cart_id = it.cart_id
WHERE c.status = 'active'
QUALIFY row_number() OVER (PARTITION BY CASE WHEN c.user_id IS NOT NULL THEN 'user' ELSE 'session' END,
                           coalesce(CAST(c.user_id AS VARCHAR), c.session_id)
                           ORDER BY c.created_at DESC NULLS FIRST, c.cart_id) = 1""")
def _p5(t):
    """P5 for every owner."""
    return E.active_cart(t)


@query("payment_status", """
SELECT checkout_request_id, transaction_id, status, result_code, result_desc, mpesa_receipt_number,
       status <> 'pending' AS cached, status = 'pending' AS needs_query
FROM shop_transactions""")
def _p6(t):
    """P6 over every checkout id of the transactions."""
    return E.payment_status(t["mpesa_transactions"], t["mpesa_transactions"]).found


@query("offer_listing", """
SELECT offer_id, title, discount_percent, is_active, valid_until FROM shop_offers""")
def _p1_offers(t):
    """P1 for special offers (newest first; ties by id)."""
    return E.listing(t["special_offers"], ["offer_id", "title", "discount_percent", "is_active", "valid_until",
                                           "created_at"], "created_at", ["offer_id"]).drop("created_at")


@query("order_item_listing", """
SELECT order_item_id, order_id, product_id, quantity, unit_price, discount FROM shop_order_items""")
def _p1_items(t):
    """P1 for order lines, highest line id first."""
    return E.listing(t["order_items"], ["order_item_id", "order_id", "product_id", "quantity", "unit_price",
                                        "discount"], "order_item_id")


@query("address_listing", """
SELECT address_id, user_id, city, street, is_default FROM shop_addresses""")
def _p1_addresses(t):
    """P1 for addresses (newest first; ties by id)."""
    return E.listing(t["addresses"], ["address_id", "user_id", "city", "street", "is_default", "created_at"],
                     "created_at", ["address_id"]).drop("created_at")
