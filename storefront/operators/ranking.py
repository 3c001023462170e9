"""Rankings: top products, customers, sellers, category performance, recent
orders and users (A13-A18).

Aggregate first, join after: order lines and reviews are reduced to one row
per product before they meet (no order_items x reviews fan-out, D5), and the
recent-* reports take their n rows before joining the large side.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storefront.functions.scalar import (
    avg2, desc_pg, line_amount, ok_order, ratio2, topk, total, zero2)

Tables = Mapping[str, DataFrame]


def _lines_without(t: Tables, exclude_status: tuple[str, ...]) -> DataFrame:
    """Order lines, minus those whose order has one of ``exclude_status``."""
    lines = t["order_items"]
    if not exclude_status:
        return lines
    drop = t["orders"].where(F.col("status").isin(*exclude_status)).select("order_id")
    return lines.join(drop, "order_id", "left_anti")


def top_products(t: Tables, n: int | None = 10, exclude_status: tuple[str, ...] = ()) -> DataFrame:
    """Products by units sold (never-sold products last); any order status
    unless ``exclude_status`` names statuses to leave out (D13)."""
    # order_item_id is the NOT NULL key, so count(order_item_id) = count(*);
    # counting rows lets Catalyst prune the key's computation.
    sales = _lines_without(t, exclude_status).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("times_ordered"), F.sum("quantity").cast("long").alias("units_sold"),
        F.sum(line_amount()).alias("rev"))
    cats = t["categories"].select("category_id", F.col("name").alias("category_name"))
    out = (t["products"].join(cats, "category_id", "left").join(sales, "product_id", "left")
           .select("product_id", "title", "price", "sale_price", "stock", "category_name",
                   F.coalesce("times_ordered", F.lit(0)).alias("times_ordered"), "units_sold",
                   F.coalesce(F.col("rev"), F.lit(0)).cast("decimal(38,2)").alias("revenue")))
    return topk(out, [F.col("units_sold").desc_nulls_last()], n, key=["product_id"])


def top_customers(t: Tables, n: int | None = 10) -> DataFrame:
    """Customers by spend over orders not cancelled/failed, with last order date."""
    spend = t["orders"].where(ok_order()).groupBy("user_id").agg(
        F.count("order_id").alias("total_orders"), total("total_amount").alias("total_spent"),
        F.coalesce(avg2("total_amount"), zero2()).alias("average_order_value"),
        F.max("created_at").alias("last_order_date"))
    out = t["users"].select("user_id", "name", "email", "phone").join(spend, "user_id")
    return topk(out, [desc_pg("total_spent")], n, key=["user_id"])


def _line_pass(t: Tables) -> DataFrame:
    """Order lines with the order's status test of the reference's WHERE clause:
    the line passes when its order is missing or not cancelled/failed."""
    o = t["orders"].select("order_id", "status")
    return (t["order_items"].select("order_id", "product_id", "quantity", "unit_price")
            .join(o, "order_id", "left")
            .withColumn("pass", F.col("status").isNull() | ok_order())
            .withColumn("amount", line_amount()))


def top_sellers(t: Tables, n: int | None = 10, compat: bool = False) -> DataFrame:
    """Sellers by revenue with distinct products and orders, rating, review count.

    Default: order lines and reviews are aggregated per product separately and
    then summed per seller (true totals, plain average rating). ``compat=True``
    gives the numbers of the reference's single join of lines and reviews,
    where each branch counts once per row of the other, from the same totals
    per product: its line sum times its reviews (at least one), its ratings
    times its lines (at least one).
    """
    owners = t["sellers"].join(t["users"].select("user_id", F.col("name").alias("owner_name"), "email"), "user_id")
    owners = owners.select("seller_id", "business_name", "owner_name", "email")
    products = t["products"].select("product_id", "seller_id")
    lines = _line_pass(t)
    per_product = lines.groupBy("product_id").agg(
        F.sum(F.when(F.col("pass"), F.col("amount"))).alias("rev"), F.count_if("pass").alias("nl"),
        F.max(F.col("pass").cast("int")).alias("any_pass"))
    per_review = t["reviews"].groupBy("product_id").agg(
        F.count(F.lit(1)).alias("nr"), F.sum("rating").alias("sr"))
    prod = (products.join(per_product, "product_id", "left").join(per_review, "product_id", "left")
            .withColumn("survives", F.col("any_pass").isNull() | (F.col("any_pass") == 1)))
    if compat:
        prod = _fanned_out(prod, "rev")
    per_seller = prod.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("n_products"),
        F.count_if("survives").alias("total_products"),
        F.sum(F.when(F.col("survives"), F.col("rev"))).alias("rev"),
        F.sum(F.when(F.col("survives"), F.col("nr"))).alias("nr"),
        F.sum(F.when(F.col("survives"), F.col("sr"))).alias("sr"),
        F.sum(F.when(F.col("survives"), F.col("wr" if compat else "nr"))).alias("wr"))
    # The joined statement also counts orders that lines name but that do not exist.
    orders_per_seller = (lines.where(F.col("pass") if compat else F.col("pass") & F.col("status").isNotNull())
                         .join(products, "product_id")
                         .groupBy("seller_id").agg(F.count_distinct("order_id").alias("total_orders")))
    out = (owners.join(per_seller, "seller_id", "left").join(orders_per_seller, "seller_id", "left")
           .where(F.col("n_products").isNull() | (F.col("total_products") > 0))
           .select("seller_id", "business_name", "owner_name", "email",
                   F.coalesce("total_products", F.lit(0)).alias("total_products"),
                   F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
                   F.coalesce(F.col("rev"), F.lit(0)).cast("decimal(38,2)").alias("revenue"),
                   F.coalesce(ratio2(F.col("sr"), F.col("wr")), zero2()).alias("average_rating"),
                   F.coalesce("nr", F.lit(0)).alias("review_count")))
    return topk(out, [desc_pg("revenue")], n, key=["seller_id"])


def _fanned_out(prod: DataFrame, *sums: str) -> DataFrame:
    """Per-product totals as a join of lines (nl) and reviews (nr, sr) would
    count them: line sums once per review, ratings once per line (wr: how often
    a rating counts)."""
    times_reviews = F.greatest(F.coalesce("nr", F.lit(0)), F.lit(1))
    times_lines = F.greatest(F.coalesce("nl", F.lit(0)), F.lit(1))
    for c in sums:
        prod = prod.withColumn(c, F.col(c) * times_reviews)
    return prod.withColumn("sr", F.col("sr") * times_lines).withColumn("wr", F.col("nr") * times_lines)


def category_performance(t: Tables, compat: bool = False, exclude_status: tuple[str, ...] = ()) -> DataFrame:
    """Per category: products, lines, units, revenue, rating, reviews;
    empty categories kept with zeros; highest revenue first.

    Lines and reviews are aggregated per product before joining; ``compat``
    gives the reference's joined numbers from the same totals. ``exclude_status`` leaves out
    lines of orders in those statuses (none by default, as the reference; D13).
    """
    cats = t["categories"].select("category_id", F.col("name").alias("category_name"))
    products = t["products"].select("product_id", "category_id")
    sales = _lines_without(t, exclude_status).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"), F.sum(line_amount()).alias("rev"))
    revs = t["reviews"].groupBy("product_id").agg(F.count(F.lit(1)).alias("nr"), F.sum("rating").alias("sr"))
    prod = products.join(sales, "product_id", "left").join(revs, "product_id", "left")
    if compat:
        prod = _fanned_out(prod.withColumn("nl", F.col("lines")), "units", "rev")
    per_cat = prod.groupBy("category_id").agg(
        F.count(F.lit(1)).alias("product_count"), F.sum("lines").alias("times_ordered"),
        F.sum("units").alias("units_sold"), F.sum("rev").alias("revenue"),
        F.sum("nr").alias("nr"), F.sum("sr").alias("sr"), F.sum("wr" if compat else "nr").alias("wr"))
    out = cats.join(per_cat, "category_id", "left").select(
        "category_id", "category_name",
        F.coalesce("product_count", F.lit(0)).alias("product_count"),
        F.coalesce("times_ordered", F.lit(0)).alias("times_ordered"),
        F.coalesce("units_sold", F.lit(0)).cast("long").alias("units_sold"),
        F.coalesce(F.col("revenue"), F.lit(0)).cast("decimal(38,2)").alias("revenue"),
        F.coalesce(ratio2(F.col("sr"), F.col("wr")), zero2()).alias("average_rating"),
        F.coalesce("nr", F.lit(0)).alias("review_count"))
    return out.orderBy(desc_pg("revenue"), "category_id")


def recent_orders(t: Tables, n: int = 20) -> DataFrame:
    """Newest n orders (with a valid user) and their item counts.

    The n orders are chosen first (semi join on users keeps the inner-join
    meaning), so only n orders meet the users and order_items joins.
    """
    users = t["users"].select("user_id", F.col("name").alias("customer_name"),
                              F.col("email").alias("customer_email"), F.col("phone").alias("customer_phone"))
    o = t["orders"].select("order_id", "user_id", "total_amount", "status", "created_at")
    top = topk(o.join(users.select("user_id"), "user_id", "left_semi"), [desc_pg("created_at")], n, key=["order_id"])
    items = (t["order_items"].select("order_id").join(top.select("order_id"), "order_id", "left_semi")
             .groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count")))
    return (top.join(users, "user_id").join(items, "order_id", "left")
            .select("order_id", "total_amount", "status", "created_at", "customer_name", "customer_email",
                    "customer_phone", F.coalesce("item_count", F.lit(0)).alias("item_count"))
            .orderBy(desc_pg("created_at"), "order_id"))


def recent_users(t: Tables, n: int = 20) -> DataFrame:
    """Newest n users with order count and spend over all statuses."""
    top = topk(t["users"].select("user_id", "name", "email", "phone", "role", "created_at"),
               [desc_pg("created_at")], n, key=["user_id"])
    spend = (t["orders"].select("user_id", "order_id", "total_amount").join(top.select("user_id"), "user_id", "left_semi")
             .groupBy("user_id").agg(F.count("order_id").alias("order_count"), total("total_amount").alias("total_spent")))
    return (top.join(spend, "user_id", "left")
            .select("user_id", "name", "email", "phone", "role", "created_at",
                    F.coalesce("order_count", F.lit(0)).alias("order_count"),
                    F.coalesce(F.col("total_spent"), zero2()).alias("total_spent"))
            .orderBy(desc_pg("created_at"), "user_id"))
