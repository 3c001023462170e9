"""Seller dashboard queries (all sellers at once) and cart totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from storefront.operators import sellers as S
from storefront.plans.registry import ORDERS_AS_OF, query
from storefront.plans.sqltext import avg2

OA = f"TIMESTAMP '{ORDERS_AS_OF}'"
Z2 = "CAST(0 AS DECIMAL(38,2))"

# (seller, order) pairs of the reference's three-way join, shared by several twins.
SO = """so AS (
  SELECT p.seller_id, o.order_id, o.user_id, o.status, o.total_amount, o.created_at,
         sum(oi.quantity * oi.unit_price) AS revenue, count(*) AS lines
  FROM shop_orders o JOIN shop_order_items oi ON o.order_id = oi.order_id
  JOIN shop_products p ON oi.product_id = p.product_id
  GROUP BY p.seller_id, o.order_id, o.user_id, o.status, o.total_amount, o.created_at)"""


@query("seller_product_stats", """
SELECT s.seller_id, count(p.product_id) AS total_products, count_if(p.stock > 0) AS in_stock_products,
       count_if(p.stock = 0) AS out_of_stock_products
FROM shop_sellers s LEFT JOIN shop_products p ON s.seller_id = p.seller_id GROUP BY s.seller_id""")
def _g10(t):
    """G10."""
    return S.seller_product_stats(t)


@query("seller_order_stats", """
WITH one AS (  -- one row per seller and order
  SELECT p.seller_id, oi.order_id, any_value(o.status) AS status, sum(oi.quantity * oi.unit_price) AS money
  FROM shop_order_items oi JOIN shop_products p USING (product_id) JOIN shop_orders o USING (order_id)
  GROUP BY p.seller_id, oi.order_id),
per AS (
  SELECT seller_id, count(*) AS n, sum(money) AS money, map_from_entries(list((status, k))) AS by_status
  FROM (SELECT seller_id, status, count(*) AS k, sum(money) AS money FROM one GROUP BY seller_id, status) GROUP BY seller_id)
SELECT s.seller_id, CAST(coalesce((SELECT count(*) FROM one WHERE one.seller_id = s.seller_id), 0) AS BIGINT) AS total_orders,
       CAST(coalesce(money, 0) AS DECIMAL(38,2)) AS total_revenue,
       coalesce(by_status['pending'], 0) AS pending_orders, coalesce(by_status['processing'], 0) AS processing_orders,
       coalesce(by_status['shipped'], 0) AS shipped_orders, coalesce(by_status['delivered'], 0) AS delivered_orders,
       coalesce(by_status['cancelled'], 0) AS cancelled_orders
FROM shop_sellers s LEFT JOIN per USING (seller_id)""")
def _g11(t):
    """G11."""
    return S.seller_order_stats(t)


@query("seller_recent_revenue", f"""
SELECT s.seller_id, CAST(coalesce(sum(oi.quantity * oi.unit_price), 0) AS DECIMAL(38,2)) AS revenue_last_30_days
FROM shop_sellers s LEFT JOIN (shop_products p JOIN shop_order_items oi ON oi.product_id = p.product_id
                               JOIN shop_orders o ON o.order_id = oi.order_id
                               AND o.created_at >= {OA} - INTERVAL 30 DAY) ON p.seller_id = s.seller_id
GROUP BY s.seller_id""")
def _g12(t):
    """G12, 30 days before the orders clock."""
    return S.seller_recent_revenue(t, ORDERS_AS_OF, 30)


@query("seller_review_stats", f"""
SELECT s.seller_id, count(r.review_id) AS total_reviews, coalesce({avg2('r.rating')}, {Z2}) AS average_rating,
       count_if(r.rating = 5) AS five_star, count_if(r.rating = 4) AS four_star, count_if(r.rating = 3) AS three_star,
       count_if(r.rating = 2) AS two_star, count_if(r.rating = 1) AS one_star
FROM shop_sellers s LEFT JOIN (shop_reviews r JOIN shop_products p ON r.product_id = p.product_id)
  ON p.seller_id = s.seller_id GROUP BY s.seller_id""")
def _g13(t):
    """G13."""
    return S.seller_review_stats(t)


@query("seller_monthly_revenue", f"""
SELECT p.seller_id, CAST(year(o.created_at) AS INT) AS year, CAST(month(o.created_at) AS INT) AS month_number,
       strftime(o.created_at, '%b %Y') AS month, CAST(sum(oi.quantity * oi.unit_price) AS DECIMAL(38,2)) AS revenue
FROM shop_orders o JOIN shop_order_items oi ON o.order_id = oi.order_id JOIN shop_products p ON oi.product_id = p.product_id
WHERE o.created_at >= {OA} - INTERVAL 6 MONTH
GROUP BY ALL""")
def _g14(t):
    """G14, 6 months before the orders clock."""
    return S.seller_monthly_revenue(t, ORDERS_AS_OF, 6)


@query("seller_top_products", """
SELECT p.seller_id, p.product_id, p.title, p.price, p.sale_price, CAST(sum(oi.quantity) AS BIGINT) AS units_sold,
       CAST(sum(oi.quantity * oi.unit_price) AS DECIMAL(38,2)) AS revenue,
       CAST(row_number() OVER (PARTITION BY p.seller_id ORDER BY sum(oi.quantity) DESC, p.product_id) AS INT) AS rank
FROM shop_products p JOIN shop_order_items oi ON p.product_id = oi.product_id
GROUP BY p.seller_id, p.product_id, p.title, p.price, p.sale_price
QUALIFY rank <= 5""")
def _w2(t):
    """W2, top 5 per seller."""
    return S.seller_top_products(t, 5)


@query("seller_recent_orders", f"""
WITH {SO}
SELECT so.seller_id, so.order_id, so.total_amount, so.status, so.created_at, u.name AS customer_name,
       u.email AS customer_email,
       CAST(row_number() OVER (PARTITION BY so.seller_id ORDER BY so.created_at DESC NULLS FIRST, so.order_id) AS INT) AS rank
FROM so JOIN shop_users u ON so.user_id = u.user_id
QUALIFY rank <= 10""")
def _w3(t):
    """W3, newest 10 per seller."""
    return S.seller_recent_orders(t, 10)


@query("seller_low_stock", """
SELECT seller_id, product_id, title, stock, price,
       CAST(row_number() OVER (PARTITION BY seller_id ORDER BY stock, product_id) AS INT) AS rank
FROM shop_products WHERE stock <= 10 AND stock > 0 QUALIFY rank <= 10""")
def _w4(t):
    """W4, lowest 10 per seller."""
    return S.seller_low_stock(t, 10)


@query("seller_sales", f"""
SELECT s.seller_id, count(DISTINCT o.order_id) AS total_orders,
       CAST(coalesce(sum(oi.quantity * oi.unit_price), 0) AS DECIMAL(38,2)) AS total_revenue,
       coalesce({avg2('oi.quantity * oi.unit_price')}, {Z2}) AS average_order_value
FROM shop_sellers s LEFT JOIN (shop_products p JOIN shop_order_items oi ON p.product_id = oi.product_id
  JOIN shop_orders o ON oi.order_id = o.order_id AND o.status NOT IN ('cancelled', 'failed')) ON p.seller_id = s.seller_id
GROUP BY s.seller_id""")
def _g16(t):
    """G16."""
    return S.seller_sales(t)


@query("seller_dashboards", f"""
WITH {SO},
g10 AS (SELECT s.seller_id, count(p.product_id) AS total_products, count_if(p.stock > 0) AS in_stock_products,
               count_if(p.stock = 0) AS out_of_stock_products
        FROM shop_sellers s LEFT JOIN shop_products p ON s.seller_id = p.seller_id GROUP BY s.seller_id),
g11 AS (SELECT seller_id, count(*) AS total_orders, sum(revenue) AS total_revenue,
               sum(CASE WHEN created_at >= {OA} - INTERVAL 30 DAY THEN revenue END) AS rev30,
               count_if(status = 'pending') AS pending_orders, count_if(status = 'cancelled') AS cancelled_orders
        FROM so GROUP BY seller_id),
g13 AS (SELECT p.seller_id, count(*) AS total_reviews, {avg2('r.rating')} AS average_rating
        FROM shop_reviews r JOIN shop_products p ON r.product_id = p.product_id GROUP BY p.seller_id),
w2 AS (SELECT seller_id, count(*) AS n_top, sum(units) AS top_units FROM (
         SELECT p.seller_id, sum(oi.quantity) AS units,
                row_number() OVER (PARTITION BY p.seller_id ORDER BY sum(oi.quantity) DESC, p.product_id) AS rk
         FROM shop_products p JOIN shop_order_items oi ON p.product_id = oi.product_id
         GROUP BY p.seller_id, p.product_id QUALIFY rk <= 5) GROUP BY seller_id),
w3 AS (SELECT seller_id, count(*) AS n_recent, sum(order_id) AS recent_order_sum FROM (
         SELECT so.seller_id, so.order_id,
                row_number() OVER (PARTITION BY so.seller_id ORDER BY so.created_at DESC, so.order_id) AS rk
         FROM so JOIN shop_users u ON so.user_id = u.user_id QUALIFY rk <= 10) GROUP BY seller_id),
w4 AS (SELECT seller_id, count(*) AS n_low, sum(stock) AS low_stock_units FROM (
         SELECT seller_id, stock, row_number() OVER (PARTITION BY seller_id ORDER BY stock, product_id) AS rk
         FROM shop_products WHERE stock <= 10 AND stock > 0 QUALIFY rk <= 10) GROUP BY seller_id),
g14 AS (SELECT seller_id, count(DISTINCT year(created_at) * 12 + month(created_at)) AS n_months
        FROM so WHERE created_at >= {OA} - INTERVAL 6 MONTH GROUP BY seller_id)
SELECT g10.seller_id, g10.total_products, g10.in_stock_products, g10.out_of_stock_products,
       coalesce(g11.total_orders, 0) AS total_orders,
       CAST(coalesce(g11.total_revenue, 0) AS DECIMAL(38,2)) AS total_revenue,
       CAST(coalesce(g11.rev30, 0) AS DECIMAL(38,2)) AS revenue_last_30_days,
       coalesce(g11.pending_orders, 0) AS pending_orders, coalesce(g11.cancelled_orders, 0) AS cancelled_orders,
       coalesce(g13.total_reviews, 0) AS total_reviews, coalesce(g13.average_rating, {Z2}) AS average_rating,
       coalesce(w2.n_top, 0) AS n_top_products, CAST(coalesce(w2.top_units, 0) AS BIGINT) AS top_units,
       coalesce(w3.n_recent, 0) AS n_recent_orders, CAST(coalesce(w3.recent_order_sum, 0) AS BIGINT) AS recent_order_sum,
       coalesce(w4.n_low, 0) AS n_low_stock, CAST(coalesce(w4.low_stock_units, 0) AS BIGINT) AS low_stock_units,
       coalesce(g14.n_months, 0) AS n_months
FROM g10 LEFT JOIN g11 ON g10.seller_id = g11.seller_id LEFT JOIN g13 ON g10.seller_id = g13.seller_id
LEFT JOIN w2 ON g10.seller_id = w2.seller_id LEFT JOIN w3 ON g10.seller_id = w3.seller_id
LEFT JOIN w4 ON g10.seller_id = w4.seller_id LEFT JOIN g14 ON g10.seller_id = g14.seller_id""")
def _g15(t):
    """G15 summarised: scalar columns plus list sizes and sums of the nested lists."""
    d = S.seller_dashboards(t, ORDERS_AS_OF)

    def n(c):
        return F.coalesce(F.size(c), F.lit(0)).cast("long")

    def s(c, f):
        return F.coalesce(F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, x: a + x[f].cast("long")),
                          F.lit(0).cast("long"))
    return d.select(
        "seller_id", "total_products", "in_stock_products", "out_of_stock_products", "total_orders", "total_revenue",
        "revenue_last_30_days", "pending_orders", "cancelled_orders", "total_reviews", "average_rating",
        n("top_products").alias("n_top_products"), s("top_products", "units_sold").alias("top_units"),
        n("recent_orders").alias("n_recent_orders"), s("recent_orders", "order_id").alias("recent_order_sum"),
        n("low_stock").alias("n_low_stock"), s("low_stock", "stock").alias("low_stock_units"),
        n("monthly_revenue").alias("n_months"))


@query("seller_dashboard_counts", f"""
WITH {SO},
g11 AS (SELECT seller_id, {', '.join(f"count_if(status = '{s}') AS {s}_orders" for s in ("processing", "shipped", "delivered"))}
        FROM so GROUP BY seller_id),
g13 AS (SELECT p.seller_id, {', '.join(f"count_if(r.rating = {k}) AS {w}_star" for k, w in S.STARS)}
        FROM shop_reviews r JOIN shop_products p ON r.product_id = p.product_id GROUP BY p.seller_id)
SELECT s.seller_id, {', '.join(f"coalesce(g11.{s}_orders, 0) AS {s}_orders" for s in ("processing", "shipped", "delivered"))},
       {', '.join(f"coalesce(g13.{w}_star, 0) AS {w}_star" for _, w in S.STARS)}
FROM shop_sellers s LEFT JOIN g11 ON g11.seller_id = s.seller_id LEFT JOIN g13 ON g13.seller_id = s.seller_id""")
def _g15_counts(t):
    """The status counts and stars of every seller's dashboard."""
    return S.seller_dashboards(t, ORDERS_AS_OF).select(
        "seller_id", "processing_orders", "shipped_orders", "delivered_orders", *[f"{w}_star" for _, w in S.STARS])


@query("seller_dashboard_lists", f"""
WITH {SO},
top AS (SELECT p.seller_id, p.product_id, p.title, p.price, p.sale_price, sum(oi.quantity) AS units,
               sum(oi.quantity * oi.unit_price) AS revenue,
               row_number() OVER (PARTITION BY p.seller_id ORDER BY sum(oi.quantity) DESC, p.product_id) AS rk
        FROM shop_products p JOIN shop_order_items oi ON p.product_id = oi.product_id
        GROUP BY p.seller_id, p.product_id, p.title, p.price, p.sale_price QUALIFY rk <= 5),
recent AS (SELECT so.*, u.name, u.email, row_number() OVER (PARTITION BY so.seller_id ORDER BY so.created_at DESC, so.order_id) AS rk
           FROM so JOIN shop_users u ON so.user_id = u.user_id QUALIFY rk <= 10),
low AS (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY stock, product_id) AS rk
        FROM shop_products WHERE stock <= 10 AND stock > 0 QUALIFY rk <= 10),
months AS (SELECT seller_id, strftime(created_at, '%b %Y') AS month, sum(revenue) AS revenue,
                  row_number() OVER (PARTITION BY seller_id ORDER BY min(created_at) DESC) AS rk
           FROM so WHERE created_at >= {OA} - INTERVAL 6 MONTH GROUP BY seller_id, strftime(created_at, '%b %Y'))
SELECT seller_id, 'top_products' AS list, rk AS place, product_id AS item, title AS label, CAST(revenue AS DECIMAL(38,2)) AS amount,
       CAST(units AS BIGINT) AS quantity, CAST(coalesce(sale_price, price) AS VARCHAR) AS detail FROM top
UNION ALL SELECT seller_id, 'recent_orders', rk, order_id, name || ' ' || email, CAST(total_amount AS DECIMAL(38,2)), NULL,
       status || ' ' || strftime(created_at, '%Y-%m-%d %H:%M:%S') FROM recent
UNION ALL SELECT seller_id, 'low_stock', rk, product_id, title, CAST(price AS DECIMAL(38,2)), CAST(stock AS BIGINT), NULL FROM low
UNION ALL SELECT seller_id, 'monthly_revenue', rk, NULL, month, CAST(revenue AS DECIMAL(38,2)), NULL, NULL FROM months""")
def _g15_lists(t):
    """The contents of the four lists of every seller's dashboard, one row per entry."""
    d = S.seller_dashboards(t, ORDERS_AS_OF)
    none, text = F.lit(None), lambda c: c.cast("string")

    def entries(name, item, label, amount, quantity, detail):
        rows = d.select("seller_id", F.posexplode(name).alias("pos", "x"))
        return rows.select("seller_id", F.lit(name).alias("list"), (F.col("pos") + 1).cast("long").alias("place"),
                           item.cast("long").alias("item"), label.alias("label"), amount.cast("decimal(38,2)").alias("amount"),
                           quantity.cast("long").alias("quantity"), text(detail).alias("detail"))
    x = F.col("x")
    return (entries("top_products", x["product_id"], x["title"], x["revenue"], x["units_sold"], F.coalesce(x["sale_price"], x["price"]))
            .unionByName(entries("recent_orders", x["order_id"], F.concat_ws(" ", x["customer_name"], x["customer_email"]), x["total_amount"],
                                 none, F.concat_ws(" ", x["status"], F.date_format(x["created_at"], "yyyy-MM-dd HH:mm:ss"))))
            .unionByName(entries("low_stock", x["product_id"], x["title"], x["price"], x["stock"], none))
            .unionByName(entries("monthly_revenue", none, x["month"], x["revenue"], none, none)))


@query("cart_totals", """
SELECT c.cart_id, c.user_id, c.session_id, c.status, c.created_at, c.updated_at, u.name AS user_name,
       u.email AS user_email, count(ci.cart_item_id) AS item_count,
       CAST(coalesce(sum(ci.quantity * ci.unit_price), 0) AS DECIMAL(38,2)) AS total_amount
FROM shop_carts c LEFT JOIN shop_users u ON c.user_id = u.user_id LEFT JOIN shop_cart_items ci ON c.cart_id = ci.cart_id
GROUP BY c.cart_id, c.user_id, c.session_id, c.status, c.created_at, c.updated_at, u.name, u.email""")
def _g1(t):
    """G1."""
    return S.cart_totals(t)
