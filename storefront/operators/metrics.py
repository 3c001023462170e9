"""Dashboard KPIs (A1-A12, A19), product ratings and sales (G2, G3), table counts.

Each KPI set is one scan of one table with several conditional aggregates
(``count_if`` / ``sum(when)``); Spark computes them as partial aggregates on
every partition and merges one row per partition, so nothing large meets in
one task. Group-bys shuffle only pre-aggregated rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storefront.functions.scalar import (
    ago, asc_pg, avg2, desc_pg, line_amount, month_start, months_back, ok_order, total, ts_lit)

Tables = Mapping[str, DataFrame]


def _count_eq(col: str, value) -> F.Column:
    return F.count_if(F.col(col) == F.lit(value))


def user_stats(users: DataFrame, as_of) -> DataFrame:
    """A1: totals by role and new users in the last 30 / 7 days (inclusive bound)."""
    return users.agg(
        F.count(F.lit(1)).alias("total_users"),
        _count_eq("role", "customer").alias("total_customers"),
        _count_eq("role", "seller").alias("total_sellers"),
        _count_eq("role", "admin").alias("total_admins"),
        F.count_if(F.col("created_at") >= ago(as_of, days=30)).alias("new_users_last_30_days"),
        F.count_if(F.col("created_at") >= ago(as_of, days=7)).alias("new_users_last_7_days"))


def product_stats(products: DataFrame, low_stock: int = 10) -> DataFrame:
    """A2: stock buckets, average price, stock units."""
    s = F.col("stock")
    return products.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(s > 0).alias("in_stock_products"),
        F.count_if(s == 0).alias("out_of_stock_products"),
        F.count_if((s <= low_stock) & (s > 0)).alias("low_stock_products"),
        F.coalesce(avg2("price"), F.lit(0).cast("decimal(38,2)")).alias("average_price"),
        F.coalesce(F.sum(s), F.lit(0)).cast("long").alias("total_stock_units"))


# The order statuses counted by the order KPIs.
ORDER_STATUSES = ("pending", "processing", "shipped", "delivered", "cancelled", "failed")


def order_stats(orders: DataFrame, as_of) -> DataFrame:
    """A3: order counts by status and for the last 30 / 7 days."""
    return orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        *[_count_eq("status", st).alias(f"{st}_orders") for st in ORDER_STATUSES],
        F.count_if(F.col("created_at") >= ago(as_of, days=30)).alias("orders_last_30_days"),
        F.count_if(F.col("created_at") >= ago(as_of, days=7)).alias("orders_last_7_days"))


def revenue_stats(orders: DataFrame, as_of) -> DataFrame:
    """A4: revenue of orders not cancelled/failed: total, 30 / 7 days, average."""
    o = orders.where(ok_order())
    amt, ts = F.col("total_amount"), F.col("created_at")
    return o.agg(
        total(amt).alias("total_revenue"),
        total(F.when(ts >= ago(as_of, days=30), amt)).alias("revenue_last_30_days"),
        total(F.when(ts >= ago(as_of, days=7), amt)).alias("revenue_last_7_days"),
        F.coalesce(avg2(amt), F.lit(0).cast("decimal(38,2)")).alias("average_order_value"))


def payment_stats(payments: DataFrame) -> DataFrame:
    """A5: confirmed (= true), pending (= false; NULL in neither), mpesa, cash, amount."""
    c = F.col("is_confirmed")
    return payments.agg(
        F.count(F.lit(1)).alias("total_payments"),
        F.count_if(c == F.lit(True)).alias("confirmed_payments"),
        F.count_if(c == F.lit(False)).alias("pending_payments"),
        _count_eq("method", "mpesa").alias("mpesa_payments"),
        _count_eq("method", "cash").alias("cash_payments"),
        total("amount").alias("total_payment_amount"))


def category_stats(categories: DataFrame) -> DataFrame:
    """A6."""
    return categories.agg(F.count(F.lit(1)).alias("total_categories"),
                          F.count_if(F.col("featured") == F.lit(True)).alias("featured_categories"))


# Star ratings and their column-name words.
STAR_NAMES = ((5, "five"), (4, "four"), (3, "three"), (2, "two"), (1, "one"))


def review_stats(reviews: DataFrame) -> DataFrame:
    """Total, average rating and star distribution."""
    return reviews.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.coalesce(avg2("rating"), F.lit(0).cast("decimal(38,2)")).alias("average_rating"),
        *[_count_eq("rating", k).alias(f"{w}_star_reviews") for k, w in STAR_NAMES])


def cart_stats(carts: DataFrame) -> DataFrame:
    """A8: 'converted' carts count only in the total."""
    return carts.agg(
        F.count(F.lit(1)).alias("total_carts"),
        _count_eq("status", "active").alias("active_carts"),
        _count_eq("status", "abandoned").alias("abandoned_carts"),
        F.count_if(F.col("user_id").isNotNull()).alias("user_carts"),
        F.count_if(F.col("session_id").isNotNull()).alias("guest_carts"))


def offer_stats(offers: DataFrame, as_of) -> DataFrame:
    """valid = valid_until >= as_of, whatever is_active says."""
    return offers.agg(
        F.count(F.lit(1)).alias("total_offers"),
        F.count_if(F.col("is_active") == F.lit(True)).alias("active_offers"),
        F.count_if(F.col("valid_until") >= ts_lit(as_of)).alias("valid_offers"))


def order_and_revenue_stats(orders: DataFrame, as_of) -> DataFrame:
    """A3 and A4 in one aggregate: two structs, ``orders`` and ``revenue``."""
    ok, amt, ts = ok_order(), F.col("total_amount"), F.col("created_at")
    both = orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        *[_count_eq("status", st).alias(f"{st}_orders") for st in ORDER_STATUSES],
        F.count_if(ts >= ago(as_of, days=30)).alias("orders_last_30_days"),
        F.count_if(ts >= ago(as_of, days=7)).alias("orders_last_7_days"),
        total(F.when(ok, amt)).alias("total_revenue"),
        total(F.when(ok & (ts >= ago(as_of, days=30)), amt)).alias("revenue_last_30_days"),
        total(F.when(ok & (ts >= ago(as_of, days=7)), amt)).alias("revenue_last_7_days"),
        F.coalesce(avg2(F.when(ok, amt)), F.lit(0).cast("decimal(38,2)")).alias("average_order_value"))
    cut = both.columns.index("total_revenue")
    return both.select(F.struct(*both.columns[:cut]).alias("orders"), F.struct(*both.columns[cut:]).alias("revenue"))


DASHBOARD_PARTS = ("users", "products", "orders", "revenue", "payments", "categories", "reviews", "carts", "offers")


def dashboard_stats(t: Tables, as_of) -> DataFrame:
    """A10: A1-A9 as one row of nine structs.

    One conditional aggregate per table (the orders' counts and revenue share
    theirs); the other tables' one-row results are scalar subqueries of that row,
    so it is assembled without any join.
    """
    parts = {
        "users": user_stats(t["users"], as_of), "products": product_stats(t["products"]),
        "payments": payment_stats(t["payments"]), "categories": category_stats(t["categories"]),
        "reviews": review_stats(t["reviews"]), "carts": cart_stats(t["carts"]),
        "offers": offer_stats(t["special_offers"], as_of),
    }
    cols = [df.select(F.struct(*df.columns)).scalar().alias(k) for k, df in parts.items()]
    return order_and_revenue_stats(t["orders"], as_of).select("orders", "revenue", *cols).select(*DASHBOARD_PARTS)


def _month_label(ts: F.Column) -> F.Column:
    return F.date_format(ts, "MMM yyyy")


def revenue_trends(orders: DataFrame, as_of, months: int = 12) -> DataFrame:
    """Monthly revenue of ok orders since as_of - n months (time of day kept), newest first."""
    since = ts_lit(months_back(as_of, months))
    o = orders.where(ok_order() & (F.col("created_at") >= since))
    out = o.groupBy(
        F.year("created_at").alias("year"), F.month("created_at").alias("month_number"),
        _month_label(F.col("created_at")).alias("month")).agg(
        F.count(F.lit(1)).alias("order_count"), total("total_amount").alias("revenue"),
        F.coalesce(avg2("total_amount"), F.lit(0).cast("decimal(38,2)")).alias("average_order_value"))
    return out.orderBy(desc_pg("year"), desc_pg("month_number"))


def daily_revenue(orders: DataFrame, as_of) -> DataFrame:
    """Revenue per day since the first of as_of's month."""
    o = orders.where(ok_order() & (F.col("created_at") >= month_start(as_of)))
    return (o.groupBy(F.to_date("created_at").alias("date"))
            .agg(F.count(F.lit(1)).alias("order_count"), total("total_amount").alias("revenue"))
            .orderBy(asc_pg("date")))


def products_per_category(t: Tables) -> DataFrame:
    """Products per category, empty categories kept with 0.

    Products are counted per category first (partial aggregate), then the
    small per-category result is joined to the categories.
    """
    counts = t["products"].groupBy("category_id").agg(F.count("product_id").alias("product_count"))
    return (t["categories"].join(counts, "category_id", "left")
            .select("category_id", F.col("name").alias("category_name"),
                    F.coalesce("product_count", F.lit(0)).alias("product_count")))


def product_ratings(reviews: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Average rating (rounded to 2 places, decimal(3,2)) and review count per product.

    With ``products`` given, every product is returned and one without reviews
    gets rating 0 and count 0.
    """
    r = reviews.groupBy("product_id").agg(
        avg2("rating").cast("decimal(3,2)").alias("rating"), F.count(F.lit(1)).cast("int").alias("review_count"))
    if products is None:
        return r
    return products.select("product_id").join(r, "product_id", "left").select(
        "product_id", F.coalesce("rating", F.lit(0).cast("decimal(3,2)")).alias("rating"),
        F.coalesce("review_count", F.lit(0)).alias("review_count"))


def product_sales(order_items: DataFrame) -> DataFrame:
    """Per product: times ordered, units, revenue."""
    return order_items.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("times_ordered"), F.sum("quantity").cast("long").alias("units_sold"),
        F.sum(line_amount()).cast("decimal(38,2)").alias("revenue"))


def table_counts(t: Tables) -> DataFrame:
    """Row count of every shop table, plus customers (role = customer).

    One count per table (Spark answers ``count`` from per-partition partial
    counts) united by name.
    """
    frames = [t[name].agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), "row_count") for name in t]
    frames.append(t["users"].where(F.col("role") == "customer").agg(F.count(F.lit(1)).alias("row_count"))
                  .select(F.lit("customers").alias("table_name"), "row_count"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
