"""Admin dashboard queries: KPIs, trends, rankings, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from storefront.operators import metrics as M
from storefront.operators import ranking as R
from storefront.plans.registry import ORDERS_AS_OF, EVENTS_AS_OF, query
from storefront.plans.sqltext import avg2, ratio2
from storefront.sources.views import categories_of_parts

OA = f"TIMESTAMP '{ORDERS_AS_OF}'"
EA = f"TIMESTAMP '{EVENTS_AS_OF}'"
OK = "status NOT IN ('cancelled', 'failed')"
Z2 = "CAST(0 AS DECIMAL(38,2))"


@query("user_stats", f"""
SELECT count(*) AS total_users, count_if(role = 'customer') AS total_customers,
       count_if(role = 'seller') AS total_sellers, count_if(role = 'admin') AS total_admins,
       count_if(created_at >= {OA} - INTERVAL 30 DAY) AS new_users_last_30_days,
       count_if(created_at >= {OA} - INTERVAL 7 DAY) AS new_users_last_7_days
FROM shop_users""")
def _user_stats(t):
    """A1 at the orders clock."""
    return M.user_stats(t["users"], ORDERS_AS_OF)


@query("product_stats", f"""
SELECT count(*) AS total_products, count_if(stock > 0) AS in_stock_products,
       count_if(stock = 0) AS out_of_stock_products, count_if(stock <= 10 AND stock > 0) AS low_stock_products,
       coalesce({avg2('price')}, {Z2}) AS average_price,
       CAST(coalesce(sum(stock), 0) AS BIGINT) AS total_stock_units
FROM shop_products""")
def _product_stats(t):
    """A2."""
    return M.product_stats(t["products"])


@query("order_stats", f"""
SELECT count(*) AS total_orders, count_if(status = 'pending') AS pending_orders,
       count_if(status = 'processing') AS processing_orders, count_if(status = 'shipped') AS shipped_orders,
       count_if(status = 'delivered') AS delivered_orders, count_if(status = 'cancelled') AS cancelled_orders,
       count_if(status = 'failed') AS failed_orders,
       count_if(created_at >= {OA} - INTERVAL 30 DAY) AS orders_last_30_days,
       count_if(created_at >= {OA} - INTERVAL 7 DAY) AS orders_last_7_days
FROM shop_orders""")
def _order_stats(t):
    """A3."""
    return M.order_stats(t["orders"], ORDERS_AS_OF)


@query("revenue_stats", f"""
SELECT CAST(coalesce(sum(total_amount), 0) AS DECIMAL(38,2)) AS total_revenue,
       CAST(coalesce(sum(CASE WHEN created_at >= {OA} - INTERVAL 30 DAY THEN total_amount END), 0) AS DECIMAL(38,2))
         AS revenue_last_30_days,
       CAST(coalesce(sum(CASE WHEN created_at >= {OA} - INTERVAL 7 DAY THEN total_amount END), 0) AS DECIMAL(38,2))
         AS revenue_last_7_days,
       coalesce({avg2('total_amount')}, {Z2}) AS average_order_value
FROM shop_orders WHERE {OK}""")
def _revenue_stats(t):
    """A4."""
    return M.revenue_stats(t["orders"], ORDERS_AS_OF)


@query("payment_stats", """
SELECT count(*) AS total_payments, count_if(is_confirmed = true) AS confirmed_payments,
       count_if(is_confirmed = false) AS pending_payments, count_if(method = 'mpesa') AS mpesa_payments,
       count_if(method = 'cash') AS cash_payments,
       CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS total_payment_amount
FROM shop_payments""")
def _payment_stats(t):
    """A5."""
    return M.payment_stats(t["payments"])


@query("category_stats", """
WITH found AS (SELECT DISTINCT CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'PROMO' THEN 2 WHEN 'ECONOMY' THEN 3 WHEN 'MEDIUM' THEN 4
                                       WHEN 'SMALL' THEN 5 ELSE 6 END AS category_id FROM part)
SELECT count(*) AS total_categories, count_if(featured = true) AS featured_categories FROM shop_categories
WHERE category_id = 7 OR category_id IN (SELECT category_id FROM found)""")
def _category_stats(t):
    """A6 over the categories that the parts name (and the empty one)."""
    return M.category_stats(categories_of_parts(t.raw("part")))


@query("review_stats", f"""
SELECT count(*) AS total_reviews, coalesce({avg2('rating')}, {Z2}) AS average_rating,
       count_if(rating = 5) AS five_star_reviews, count_if(rating = 4) AS four_star_reviews,
       count_if(rating = 3) AS three_star_reviews, count_if(rating = 2) AS two_star_reviews,
       count_if(rating = 1) AS one_star_reviews
FROM shop_reviews""")
def _review_stats(t):
    """A7."""
    return M.review_stats(t["reviews"])


@query("cart_stats", """
SELECT count(*) AS total_carts, count_if(status = 'active') AS active_carts,
       count_if(status = 'abandoned') AS abandoned_carts, count_if(user_id IS NOT NULL) AS user_carts,
       count_if(session_id IS NOT NULL) AS guest_carts
FROM shop_carts""")
def _cart_stats(t):
    """A8."""
    return M.cart_stats(t["carts"])


@query("offer_stats", f"""
SELECT count(*) AS total_offers, count_if(is_active = true) AS active_offers,
       count_if(valid_until >= {EA}) AS valid_offers
FROM shop_offers""")
def _offer_stats(t):
    """A9 at the events clock."""
    return M.offer_stats(t["special_offers"], EVENTS_AS_OF)


@query("dashboard_stats", f"""
SELECT u.*, p.*, o.*, r.*, pay.*, c.*, rv.*, ca.*, so.* FROM
 (SELECT count(*) AS total_users, count_if(role = 'customer') AS total_customers,
         count_if(role = 'seller') AS total_sellers, count_if(role = 'admin') AS total_admins,
         count_if(created_at >= {OA} - INTERVAL 30 DAY) AS new_users_last_30_days,
         count_if(created_at >= {OA} - INTERVAL 7 DAY) AS new_users_last_7_days FROM shop_users) u,
 (SELECT count(*) AS total_products, count_if(stock > 0) AS in_stock_products,
         count_if(stock = 0) AS out_of_stock_products, count_if(stock <= 10 AND stock > 0) AS low_stock_products,
         coalesce({avg2('price')}, {Z2}) AS average_price,
         CAST(coalesce(sum(stock), 0) AS BIGINT) AS total_stock_units FROM shop_products) p,
 (SELECT count(*) AS total_orders, count_if(status = 'pending') AS pending_orders,
         count_if(status = 'processing') AS processing_orders, count_if(status = 'shipped') AS shipped_orders,
         count_if(status = 'delivered') AS delivered_orders, count_if(status = 'cancelled') AS cancelled_orders,
         count_if(status = 'failed') AS failed_orders,
         count_if(created_at >= {OA} - INTERVAL 30 DAY) AS orders_last_30_days,
         count_if(created_at >= {OA} - INTERVAL 7 DAY) AS orders_last_7_days FROM shop_orders) o,
 (SELECT CAST(coalesce(sum(total_amount), 0) AS DECIMAL(38,2)) AS total_revenue,
         CAST(coalesce(sum(CASE WHEN created_at >= {OA} - INTERVAL 30 DAY THEN total_amount END), 0) AS DECIMAL(38,2))
           AS revenue_last_30_days,
         CAST(coalesce(sum(CASE WHEN created_at >= {OA} - INTERVAL 7 DAY THEN total_amount END), 0) AS DECIMAL(38,2))
           AS revenue_last_7_days,
         coalesce({avg2('total_amount')}, {Z2}) AS average_order_value FROM shop_orders WHERE {OK}) r,
 (SELECT count(*) AS total_payments, count_if(is_confirmed = true) AS confirmed_payments,
         count_if(is_confirmed = false) AS pending_payments, count_if(method = 'mpesa') AS mpesa_payments,
         count_if(method = 'cash') AS cash_payments,
         CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS total_payment_amount FROM shop_payments) pay,
 (SELECT count(*) AS total_categories, count_if(featured = true) AS featured_categories FROM shop_categories) c,
 (SELECT count(*) AS total_reviews, coalesce({avg2('rating')}, {Z2}) AS average_rating,
         count_if(rating = 5) AS five_star_reviews, count_if(rating = 4) AS four_star_reviews,
         count_if(rating = 3) AS three_star_reviews, count_if(rating = 2) AS two_star_reviews,
         count_if(rating = 1) AS one_star_reviews FROM shop_reviews) rv,
 (SELECT count(*) AS total_carts, count_if(status = 'active') AS active_carts,
         count_if(status = 'abandoned') AS abandoned_carts, count_if(user_id IS NOT NULL) AS user_carts,
         count_if(session_id IS NOT NULL) AS guest_carts FROM shop_carts) ca,
 (SELECT count(*) AS total_offers, count_if(is_active = true) AS active_offers,
         count_if(valid_until >= {OA}) AS valid_offers FROM shop_offers) so""")
def _dashboard(t):
    """A10 at the orders clock, the nine structs flattened into one row."""
    d = M.dashboard_stats(t, ORDERS_AS_OF)
    return d.select(*[F.col(f"{p}.*") for p in M.DASHBOARD_PARTS])


@query("revenue_trends", f"""
SELECT strftime(created_at, '%b %Y') AS month, CAST(year(created_at) AS INT) AS year,
       CAST(month(created_at) AS INT) AS month_number, count(*) AS order_count,
       CAST(coalesce(sum(total_amount), 0) AS DECIMAL(38,2)) AS revenue,
       coalesce({avg2('total_amount')}, {Z2}) AS average_order_value
FROM shop_orders WHERE {OK} AND created_at >= {OA} - INTERVAL 12 MONTH
GROUP BY ALL ORDER BY year DESC NULLS FIRST, month_number DESC NULLS FIRST""")
def _revenue_trends(t):
    """A11, 12 months back from the orders clock."""
    return M.revenue_trends(t["orders"], ORDERS_AS_OF, 12)


@query("daily_revenue", f"""
SELECT CAST(created_at AS DATE) AS date, count(*) AS order_count,
       CAST(coalesce(sum(total_amount), 0) AS DECIMAL(38,2)) AS revenue
FROM shop_orders WHERE {OK} AND created_at >= date_trunc('month', {OA})
GROUP BY ALL ORDER BY date""")
def _daily_revenue(t):
    """A12."""
    return M.daily_revenue(t["orders"], ORDERS_AS_OF)


@query("top_products", """
SELECT p.product_id, p.title, p.price, p.sale_price, p.stock, c.name AS category_name,
       count(oi.order_item_id) AS times_ordered, CAST(sum(oi.quantity) AS BIGINT) AS units_sold,
       CAST(coalesce(sum(oi.quantity * oi.unit_price), 0) AS DECIMAL(38,2)) AS revenue
FROM shop_products p LEFT JOIN shop_categories c ON p.category_id = c.category_id
LEFT JOIN shop_order_items oi ON p.product_id = oi.product_id
GROUP BY p.product_id, p.title, p.price, p.sale_price, p.stock, c.name
ORDER BY units_sold DESC NULLS LAST, p.product_id LIMIT 10""")
def _top_products(t):
    """A13, top 10."""
    return R.top_products(t, 10)


@query("top_customers", f"""
SELECT u.user_id, u.name, u.email, u.phone, count(o.order_id) AS total_orders,
       CAST(coalesce(sum(o.total_amount), 0) AS DECIMAL(38,2)) AS total_spent,
       coalesce({avg2('o.total_amount')}, {Z2}) AS average_order_value, max(o.created_at) AS last_order_date
FROM shop_users u JOIN shop_orders o ON u.user_id = o.user_id
WHERE o.{OK}
GROUP BY u.user_id, u.name, u.email, u.phone
ORDER BY total_spent DESC NULLS FIRST, u.user_id LIMIT 10""")
def _top_customers(t):
    """A14, top 10."""
    return R.top_customers(t, 10)


@query("top_sellers", f"""
WITH lp AS (
  SELECT oi.product_id, (o.status IS NULL OR o.status NOT IN ('cancelled','failed')) AS pass, o.status, oi.order_id,
         oi.quantity * oi.unit_price AS amount
  FROM shop_order_items oi LEFT JOIN shop_orders o ON oi.order_id = o.order_id),
pp AS (SELECT product_id, sum(CASE WHEN pass THEN amount END) AS rev, bool_or(pass) AS any_pass FROM lp GROUP BY product_id),
pr AS (SELECT product_id, count(*) AS nr, sum(rating) AS sr FROM shop_reviews GROUP BY product_id),
prod AS (
  SELECT p.product_id, p.seller_id, pp.rev, pr.nr, pr.sr, (pp.any_pass IS NULL OR pp.any_pass) AS survives
  FROM shop_products p LEFT JOIN pp ON p.product_id = pp.product_id LEFT JOIN pr ON p.product_id = pr.product_id),
ps AS (
  SELECT seller_id, count(*) AS n_products, count_if(survives) AS total_products,
         sum(CASE WHEN survives THEN rev END) AS rev, sum(CASE WHEN survives THEN nr END) AS nr,
         sum(CASE WHEN survives THEN sr END) AS sr
  FROM prod GROUP BY seller_id),
so AS (
  SELECT p.seller_id, count(DISTINCT lp.order_id) AS total_orders
  FROM lp JOIN shop_products p ON lp.product_id = p.product_id
  WHERE lp.pass AND lp.status IS NOT NULL GROUP BY p.seller_id)
SELECT s.seller_id, s.business_name, u.name AS owner_name, u.email,
       coalesce(ps.total_products, 0) AS total_products, coalesce(so.total_orders, 0) AS total_orders,
       CAST(coalesce(ps.rev, 0) AS DECIMAL(38,2)) AS revenue,
       coalesce({ratio2('ps.sr', 'ps.nr')}, {Z2}) AS average_rating, CAST(coalesce(ps.nr, 0) AS BIGINT) AS review_count
FROM shop_sellers s JOIN shop_users u ON s.user_id = u.user_id
LEFT JOIN ps ON s.seller_id = ps.seller_id LEFT JOIN so ON s.seller_id = so.seller_id
WHERE ps.n_products IS NULL OR ps.total_products > 0
ORDER BY revenue DESC NULLS FIRST, s.seller_id LIMIT 10""")
def _top_sellers(t):
    """A15 default (pre-aggregated branches), top 10."""
    return R.top_sellers(t, 10)


# Twins of the joined numbers: both branches reduced to (product, how often), then
# multiplied by the size of the other branch; written against the definition, with
# one row per product, where the operator works with nullable totals.
@query("top_sellers_compat", f"""
WITH branch AS (
  SELECT oi.product_id, 'line' AS kind, oi.quantity * oi.unit_price AS amount, oi.order_id,
         NOT coalesce(o.status IN ('cancelled', 'failed'), false) AS counts
  FROM shop_order_items oi LEFT JOIN shop_orders o USING (order_id)
  UNION ALL SELECT product_id, 'review', rating, NULL, true FROM shop_reviews),
per AS (
  SELECT product_id, count(*) FILTER (kind = 'line') AS all_lines, count(*) FILTER (kind = 'line' AND counts) AS good_lines,
         count(*) FILTER (kind = 'review') AS reviews, coalesce(sum(amount) FILTER (kind = 'line' AND counts), 0) AS money,
         coalesce(sum(amount) FILTER (kind = 'review'), 0) AS stars
  FROM branch GROUP BY product_id),
kept AS (
  SELECT p.seller_id, p.product_id, coalesce(reviews, 0) AS reviews, coalesce(money, 0) * greatest(coalesce(reviews, 0), 1) AS money,
         CAST(coalesce(stars, 0) AS BIGINT) * greatest(coalesce(good_lines, 0), 1) AS stars,
         coalesce(reviews, 0) * greatest(coalesce(good_lines, 0), 1) AS votes
  FROM shop_products p LEFT JOIN per USING (product_id) WHERE coalesce(all_lines, 0) = 0 OR good_lines > 0),
bought AS (SELECT p.seller_id, count(DISTINCT b.order_id) AS n FROM branch b JOIN shop_products p USING (product_id)
           WHERE kind = 'line' AND counts GROUP BY p.seller_id),
whole AS (
  SELECT seller_id, count(*) AS total_products, sum(reviews) AS review_count, sum(money) AS money, sum(stars) AS stars,
         sum(votes) AS votes FROM kept GROUP BY seller_id)
SELECT s.seller_id, s.business_name, u.name AS owner_name, u.email, coalesce(total_products, 0) AS total_products,
       coalesce(bought.n, 0) AS total_orders, CAST(coalesce(money, 0) AS DECIMAL(38,2)) AS revenue,
       coalesce({ratio2('stars', 'votes')}, {Z2}) AS average_rating, CAST(coalesce(review_count, 0) AS BIGINT) AS review_count
FROM shop_sellers s JOIN shop_users u ON s.user_id = u.user_id LEFT JOIN whole USING (seller_id) LEFT JOIN bought USING (seller_id)
WHERE total_products IS NOT NULL OR s.seller_id NOT IN (SELECT seller_id FROM shop_products)
ORDER BY revenue DESC NULLS FIRST, s.seller_id LIMIT 10""")
def _top_sellers_compat(t):
    """A15 with the reference's joined (fanned-out) numbers, top 10."""
    return R.top_sellers(t, 10, compat=True)


@query("category_performance", f"""
WITH s AS (SELECT product_id, count(*) AS lines, sum(quantity) AS units, sum(quantity * unit_price) AS rev
           FROM shop_order_items GROUP BY product_id),
     r AS (SELECT product_id, count(*) AS nr, sum(rating) AS sr FROM shop_reviews GROUP BY product_id),
     pc AS (SELECT p.category_id, count(*) AS product_count, sum(s.lines) AS times_ordered, sum(s.units) AS units_sold,
                   sum(s.rev) AS revenue, sum(r.nr) AS nr, sum(r.sr) AS sr
            FROM shop_products p LEFT JOIN s ON p.product_id = s.product_id LEFT JOIN r ON p.product_id = r.product_id
            GROUP BY p.category_id)
SELECT c.category_id, c.name AS category_name, coalesce(pc.product_count, 0) AS product_count,
       CAST(coalesce(pc.times_ordered, 0) AS BIGINT) AS times_ordered, CAST(coalesce(pc.units_sold, 0) AS BIGINT) AS units_sold,
       CAST(coalesce(pc.revenue, 0) AS DECIMAL(38,2)) AS revenue,
       coalesce({ratio2('pc.sr', 'pc.nr')}, {Z2}) AS average_rating, CAST(coalesce(pc.nr, 0) AS BIGINT) AS review_count
FROM shop_categories c LEFT JOIN pc ON c.category_id = pc.category_id
ORDER BY revenue DESC NULLS FIRST, c.category_id""")
def _category_performance(t):
    """A16 default (pre-aggregated branches)."""
    return R.category_performance(t)


@query("category_performance_compat", f"""
WITH branch AS (
  SELECT product_id, quantity AS units, quantity * unit_price AS money, NULL AS stars FROM shop_order_items
  UNION ALL SELECT product_id, NULL, NULL, rating FROM shop_reviews),
per AS (
  SELECT product_id, count(units) AS lines, count(stars) AS reviews, coalesce(sum(units), 0) AS units,
         coalesce(sum(money), 0) AS money, coalesce(sum(stars), 0) AS stars FROM branch GROUP BY product_id),
whole AS (
  SELECT p.category_id, count(*) AS product_count, sum(lines) AS times_ordered, sum(units * greatest(reviews, 1)) AS units_sold,
         sum(money * greatest(reviews, 1)) AS money, sum(stars * greatest(lines, 1)) AS stars,
         sum(reviews * greatest(lines, 1)) AS votes, sum(reviews) AS review_count
  FROM shop_products p LEFT JOIN per USING (product_id) GROUP BY p.category_id)
SELECT c.category_id, c.name AS category_name, coalesce(product_count, 0) AS product_count,
       CAST(coalesce(times_ordered, 0) AS BIGINT) AS times_ordered, CAST(coalesce(units_sold, 0) AS BIGINT) AS units_sold,
       CAST(coalesce(money, 0) AS DECIMAL(38,2)) AS revenue, coalesce({ratio2('stars', 'votes')}, {Z2}) AS average_rating,
       CAST(coalesce(review_count, 0) AS BIGINT) AS review_count
FROM shop_categories c LEFT JOIN whole USING (category_id) ORDER BY revenue DESC NULLS FIRST, c.category_id""")
def _category_performance_compat(t):
    """A16 with the reference's joined numbers."""
    return R.category_performance(t, compat=True)


@query("recent_orders", """
SELECT o.order_id, o.total_amount, o.status, o.created_at, u.name AS customer_name, u.email AS customer_email,
       u.phone AS customer_phone, count(oi.order_item_id) AS item_count
FROM shop_orders o JOIN shop_users u ON o.user_id = u.user_id
LEFT JOIN shop_order_items oi ON o.order_id = oi.order_id
GROUP BY o.order_id, o.total_amount, o.status, o.created_at, u.name, u.email, u.phone
ORDER BY o.created_at DESC NULLS FIRST, o.order_id LIMIT 20""")
def _recent_orders(t):
    """A17, newest 20."""
    return R.recent_orders(t, 20)


@query("recent_users", """
SELECT u.user_id, u.name, u.email, u.phone, u.role, u.created_at, count(o.order_id) AS order_count,
       CAST(coalesce(sum(o.total_amount), 0) AS DECIMAL(38,2)) AS total_spent
FROM shop_users u LEFT JOIN shop_orders o ON u.user_id = o.user_id
GROUP BY u.user_id, u.name, u.email, u.phone, u.role, u.created_at
ORDER BY u.created_at DESC NULLS FIRST, u.user_id LIMIT 20""")
def _recent_users(t):
    """A18, newest 20."""
    return R.recent_users(t, 20)


@query("products_per_category", """
SELECT c.category_id, c.name AS category_name, count(p.product_id) AS product_count
FROM shop_categories c LEFT JOIN shop_products p ON c.category_id = p.category_id
GROUP BY c.category_id, c.name""")
def _products_per_category(t):
    """A19."""
    return M.products_per_category(t)


@query("product_ratings", f"""
SELECT p.product_id, CAST(coalesce({avg2('r.rating')}, 0) AS DECIMAL(3,2)) AS rating,
       CAST(count(r.review_id) AS INT) AS review_count
FROM shop_products p LEFT JOIN shop_reviews r ON p.product_id = r.product_id GROUP BY p.product_id""")
def _product_ratings(t):
    """G2 over every product (0 when a product has no review)."""
    return M.product_ratings(t["reviews"], t["products"])


@query("product_sales", """
SELECT product_id, count(order_item_id) AS times_ordered, CAST(sum(quantity) AS BIGINT) AS units_sold,
       CAST(sum(quantity * unit_price) AS DECIMAL(38,2)) AS revenue
FROM shop_order_items GROUP BY product_id""")
def _product_sales(t):
    """G3."""
    return M.product_sales(t["order_items"])


@query("table_counts", """
SELECT 'users' AS table_name, count(*) AS row_count FROM shop_users
UNION ALL SELECT 'sellers', count(*) FROM shop_sellers
UNION ALL SELECT 'categories', count(*) FROM shop_categories
UNION ALL SELECT 'products', count(*) FROM shop_products
UNION ALL SELECT 'addresses', count(*) FROM shop_addresses
UNION ALL SELECT 'orders', count(*) FROM shop_orders
UNION ALL SELECT 'order_items', count(*) FROM shop_order_items
UNION ALL SELECT 'payments', count(*) FROM shop_payments
UNION ALL SELECT 'mpesa_transactions', count(*) FROM shop_transactions
UNION ALL SELECT 'reviews', count(*) FROM shop_reviews
UNION ALL SELECT 'carts', count(*) FROM shop_carts
UNION ALL SELECT 'cart_items', count(*) FROM shop_cart_items
UNION ALL SELECT 'special_offers', count(*) FROM shop_offers
UNION ALL SELECT 'product_offers', count(*) FROM shop_product_offers
UNION ALL SELECT 'product_images', count(*) FROM shop_product_images
UNION ALL SELECT 'delivery_pricing', count(*) FROM shop_delivery_pricing
UNION ALL SELECT 'customers', count(*) FROM shop_users WHERE role = 'customer'""")
def _table_counts(t):
    """S5."""
    return M.table_counts(t)
