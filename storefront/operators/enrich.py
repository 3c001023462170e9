"""Denormalised views, listings, lookups and documents.

All joins are equi-joins. Small dimensions (categories, offers, the n rows of
a lookup) are broadcast by AQE when their measured size is under the
broadcast threshold; otherwise Spark falls back to a sort-merge join, so no
side is broadcast on trust. Lookups are semi/anti joins, never
``collect()`` + ``isin``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storefront.functions.scalar import asc_pg, desc_pg, line_amount, topk, zero2
from storefront.operators.metrics import product_ratings, product_sales
from storefront.operators.sellers import seller_sales

Tables = Mapping[str, DataFrame]


# ------------------------------------------------------------------ P1 / P2

def listing(df: DataFrame, cols: Iterable[str] | None = None, order: str = "created_at",
            key: Iterable[str] = ()) -> DataFrame:
    """Public columns, newest first (NULL times first, as in Postgres)."""
    out = df.select(*cols) if cols else df
    return out.orderBy(desc_pg(order), *[F.col(k).asc() for k in key])


PUBLIC_USER_COLUMNS = ("user_id", "role", "name", "email", "phone", "verified", "created_at", "updated_at",
                       "last_login", "terms", "newsletter")


def user_listing(t: Tables) -> DataFrame:
    """P1 for users: every column but the password hash."""
    return listing(t["users"], PUBLIC_USER_COLUMNS, "created_at", ["user_id"])


class Lookup(NamedTuple):
    found: DataFrame
    missing: DataFrame


def lookup(view: DataFrame, keys: DataFrame, on: str | list[str]) -> Lookup:
    """Rows of ``view`` whose key is in ``keys`` and the keys not found.

    ``keys`` is a DataFrame (any size): a semi join gives the found rows, an
    anti join the missing keys. Duplicate keys are looked up once.
    """
    on = [on] if isinstance(on, str) else list(on)
    k = keys.select(*on).dropDuplicates()
    return Lookup(view.join(k, on, "left_semi"), k.join(view.select(*on), on, "left_anti"))


# ------------------------------------------------------------------ J views

def _cat_names(t: Tables) -> DataFrame:
    return t["categories"].select("category_id", F.col("name").alias("category_name"))


def _seller_people(t: Tables) -> DataFrame:
    """seller_id -> business name, owner name and e-mail (sellers.user_id = users.user_id, D6)."""
    return t["sellers"].select("seller_id", "user_id", "business_name").join(
        t["users"].select("user_id", F.col("name").alias("seller_name"), F.col("email").alias("seller_email")),
        "user_id")


def product_catalog(t: Tables) -> DataFrame:
    """Products with category and seller (owner) name, newest first."""
    return (t["products"].join(_cat_names(t), "category_id").join(_seller_people(t), "seller_id")
            .select("product_id", "title", "description", "price", "sale_price", "stock", "specs", "rating",
                    "review_count", "category_name", "seller_name", "created_at", "updated_at")
            .orderBy(desc_pg("created_at"), "product_id"))


def products_by_category(t: Tables, text: str) -> DataFrame:
    """J1 rows whose category name contains ``text`` (case-insensitive;
    ``%`` and ``_`` in the text act as wildcards, as in the reference)."""
    return product_catalog(t).where(F.col("category_name").ilike(f"%{text}%"))


def order_lines(t: Tables) -> DataFrame:
    """One row per order line with customer, address and product columns."""
    o = t["orders"].select("order_id", "user_id", "address_id", "total_amount", "status", "notes", "created_at",
                           "updated_at")
    return (o.join(t["users"].select("user_id", F.col("name").alias("user_name")), "user_id")
            .join(t["addresses"].select("address_id", "city", "street", "building", "postal_code"), "address_id")
            .join(t["order_items"].select("order_id", "order_item_id", "product_id",
                                          F.col("quantity").alias("product_quantity")), "order_id")
            .join(t["products"].select("product_id", F.col("title").alias("product_name"),
                                       F.col("price").alias("product_price")), "product_id")
            .select("order_id", "order_item_id", "user_id", "total_amount", "status", "notes", "created_at",
                    "updated_at", "user_name", "product_id", "product_name", "product_price", "product_quantity",
                    "city", "street", "building", "postal_code")
            .orderBy(desc_pg("created_at"), "order_id", "order_item_id"))


class Document(NamedTuple):
    """A document as a header row per parent plus child rows keyed by the parent.

    Children are not gathered into arrays: one parent may own an unbounded
    number of children, and an array would put them all into one row. Each
    child frame carries the parent key and its sort columns.
    """
    header: DataFrame
    children: dict[str, DataFrame]


def _restrict(df: DataFrame, keys: DataFrame | None, on: str) -> DataFrame:
    return df if keys is None else df.join(keys.select(on).dropDuplicates(), on, "left_semi")


def order_documents(t: Tables, keys: DataFrame | None = None) -> Document:
    """Order + customer + address + payment (or NULL) in the header with item
    count and total; items (with category and seller) as child rows."""
    o = _restrict(t["orders"], keys, "order_id")
    items = (t["order_items"].join(o.select("order_id"), "order_id", "left_semi")
             .join(t["products"].select("product_id", F.col("title").alias("product_title"), "category_id",
                                        "seller_id"), "product_id", "left")
             .join(_cat_names(t), "category_id", "left")
             .join(t["sellers"].select("seller_id", "business_name"), "seller_id", "left")
             .withColumn("line_total", line_amount()))
    per = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"),
                                        F.sum("line_total").cast("decimal(38,2)").alias("items_total"))
    pay = t["payments"].select("order_id", F.struct("payment_id", "method", "amount", "is_confirmed",
                                                    "confirmed_at").alias("payment"))
    header = (o.join(t["users"].select("user_id", F.col("name").alias("customer_name"),
                                       F.col("email").alias("customer_email"),
                                       F.col("phone").alias("customer_phone")), "user_id", "left")
              .join(t["addresses"].select("address_id", "city", "street", "building", "postal_code"), "address_id",
                    "left")
              .join(per, "order_id", "left").join(pay, "order_id", "left")
              .withColumn("item_count", F.coalesce("item_count", F.lit(0)))
              .withColumn("items_total", F.coalesce("items_total", zero2())))
    return Document(header, {"items": items.orderBy("order_id", "order_item_id")})


def product_documents(t: Tables, keys: DataFrame | None = None) -> Document:
    """Product + category + seller + sales (G3) + rating counts in the header;
    images (primary first, then sort_order) and reviews (newest first) as children."""
    p = _restrict(t["products"], keys, "product_id")
    images = (t["product_images"].join(p.select("product_id"), "product_id", "left_semi")
              .orderBy("product_id", F.col("is_primary").desc_nulls_last(), asc_pg("sort_order"), "image_id"))
    reviews = (t["reviews"].join(p.select("product_id"), "product_id", "left_semi")
               .join(t["users"].select("user_id", F.col("name").alias("user_name")), "user_id", "left")
               .orderBy("product_id", desc_pg("created_at"), "review_id"))
    n_img = t["product_images"].groupBy("product_id").agg(F.count(F.lit(1)).alias("image_count"))
    n_rev = product_ratings(t["reviews"]).select("product_id", F.col("review_count").alias("reviews_found"),
                                                 F.col("rating").alias("reviews_rating"))
    header = (p.join(_cat_names(t), "category_id", "left").join(_seller_people(t), "seller_id", "left")
              .join(product_sales(t["order_items"]), "product_id", "left")
              .join(n_img, "product_id", "left").join(n_rev, "product_id", "left")
              .withColumn("image_count", F.coalesce("image_count", F.lit(0)))
              .withColumn("reviews_found", F.coalesce("reviews_found", F.lit(0))))
    return Document(header, {"images": images, "reviews": reviews})


def seller_documents(t: Tables, keys: DataFrame | None = None) -> Document:
    """Seller + owner + product count + sales statistics (G16); products as children."""
    s = _restrict(t["sellers"], keys, "seller_id")
    products = t["products"].join(s.select("seller_id"), "seller_id", "left_semi").orderBy(
        "seller_id", desc_pg("created_at"), "product_id")
    n_prod = t["products"].groupBy("seller_id").agg(F.count(F.lit(1)).alias("product_count"))
    header = (s.join(t["users"].select("user_id", "name", "email", "phone"), "user_id", "left")
              .join(n_prod, "seller_id", "left").join(seller_sales(t), "seller_id", "left")
              .withColumn("product_count", F.coalesce("product_count", F.lit(0))))
    return Document(header, {"products": products})


def review_feed(t: Tables, n: int | None = None, products: DataFrame | None = None) -> DataFrame:
    """Reviews with author and product, newest first; optional top n or product set."""
    r = _restrict(t["reviews"], products, "product_id")
    out = (r.select("review_id", "user_id", "product_id", "rating", "comment", "created_at")
           .join(t["users"].select("user_id", F.col("name").alias("user_name"), F.col("email").alias("user_email")),
                 "user_id")
           .join(t["products"].select("product_id", F.col("title").alias("product_title")), "product_id"))
    return topk(out, [desc_pg("created_at")], n, key=["review_id"])


def payments_view(t: Tables, users: DataFrame | None = None) -> DataFrame:
    """Payments with their order's columns, newest payment first; optional user set."""
    o = _restrict(t["orders"], users, "user_id").select(
        "order_id", "user_id", "total_amount", "status", F.col("created_at").alias("order_created_at"))
    return (t["payments"].join(o, "order_id")
            .select("payment_id", "method", "amount", "mpesa_code", "mpesa_phone", "transaction_reference",
                    "is_confirmed", "confirmed_at", "order_id", "user_id", "total_amount", "status",
                    "order_created_at", F.col("created_at").alias("payment_created_at"))
            .orderBy(desc_pg("payment_created_at"), "payment_id"))


def pending_payments(t: Tables) -> DataFrame:
    """Unconfirmed payments (is_confirmed = false; NULL is not pending) with order and customer."""
    p = t["payments"].where(F.col("is_confirmed") == F.lit(False))
    o = t["orders"].select("order_id", "user_id", F.col("total_amount").alias("order_total"),
                           F.col("status").alias("order_status"))
    u = t["users"].select("user_id", F.col("name").alias("customer_name"), F.col("email").alias("customer_email"),
                          F.col("phone").alias("customer_phone"))
    return p.join(o, "order_id").join(u, "user_id").drop("user_id").orderBy(desc_pg("created_at"), "payment_id")


def cart_lines(t: Tables) -> DataFrame:
    """Cart items with current price, stock, rating, category and subtotal, newest first."""
    p = t["products"].select("product_id", "category_id", F.col("title").alias("product_title"),
                             F.col("description").alias("product_description"), F.col("price").alias("current_price"),
                             F.col("sale_price").alias("current_sale_price"), F.col("stock").alias("available_stock"),
                             "rating")
    return (t["cart_items"].join(p, "product_id").join(_cat_names(t), "category_id")
            .withColumn("subtotal", line_amount()).drop("category_id")
            .orderBy("cart_id", desc_pg("added_at"), "cart_item_id"))


def user_profiles(t: Tables) -> DataFrame:
    """Users with their addresses; a user without an address is kept once."""
    return (t["users"].select("user_id", "name", "email", "phone", "role", "created_at")
            .join(t["addresses"].select("user_id", "address_id", "city", "street", "building", "postal_code",
                                        "is_default"), "user_id", "left"))


def seller_directory(t: Tables) -> DataFrame:
    """Sellers with their user's contact columns, newest first."""
    return (t["sellers"].join(t["users"].select("user_id", "name", "email", "phone"), "user_id")
            .select("seller_id", "user_id", "name", "email", "phone", "business_name", "tax_id", "business_license",
                    "total_sales", "created_at")
            .orderBy(desc_pg("created_at"), "seller_id"))


def users_with_seller(t: Tables) -> DataFrame:
    """Every user; seller columns only when the user's role is seller."""
    u = t["users"].select("user_id", "name", "email", "phone", "role", "terms", "newsletter", "last_login",
                          "created_at")
    s = t["sellers"].select(F.col("user_id").alias("s_user_id"), "seller_id", "business_name", "tax_id",
                            "business_license", "total_sales")
    cond = (F.col("user_id") == F.col("s_user_id")) & (F.col("role") == "seller")
    return u.join(s, cond, "left").drop("s_user_id")


def offer_links(t: Tables) -> DataFrame:
    """Product-offer links with both titles, ordered by product then offer title."""
    return (t["product_offers"].join(t["products"].select("product_id", F.col("title").alias("product_name")),
                                     "product_id")
            .join(t["special_offers"].select("offer_id", F.col("title").alias("offer_title")), "offer_id")
            .select("product_id", "offer_id", "product_name", "offer_title")
            .orderBy(asc_pg("product_name"), asc_pg("offer_title"), "product_id", "offer_id"))


def _stock_view(t: Tables) -> DataFrame:
    return (t["products"].select("product_id", "seller_id", "category_id", "title", "stock", "price", "updated_at")
            .join(_cat_names(t), "category_id").join(_seller_people(t), "seller_id"))


def low_stock(t: Tables, threshold: int = 10) -> DataFrame:
    """Products with 0 < stock <= threshold, lowest first, with category and seller contact."""
    return (_stock_view(t).where((F.col("stock") <= threshold) & (F.col("stock") > 0))
            .select("product_id", "title", "stock", "price", "category_name",
                    F.col("business_name").alias("seller_name"), "seller_email")
            .orderBy(asc_pg("stock"), "product_id"))


def out_of_stock(t: Tables) -> DataFrame:
    """Products with stock 0, last updated first."""
    return (_stock_view(t).where(F.col("stock") == 0)
            .select("product_id", "title", "price", "category_name", F.col("business_name").alias("seller_name"),
                    "seller_email", F.col("updated_at").alias("last_updated"))
            .orderBy(desc_pg("last_updated"), "product_id"))


class Access(NamedTuple):
    allowed: DataFrame
    denied: DataFrame


def owned_images(t: Tables, requests: DataFrame) -> Access:
    """Requests (image_id, user_id) split by ownership: the image's product
    belongs to a seller whose user is the requester. Unknown images are denied."""
    owner = (t["product_images"].select("image_id", "product_id")
             .join(t["products"].select("product_id", "seller_id"), "product_id")
             .join(t["sellers"].select("seller_id", F.col("user_id").alias("owner_user_id")), "seller_id")
             .select("image_id", "owner_user_id"))
    cond = (F.col("r.image_id") == F.col("o.image_id")) & (F.col("r.user_id") == F.col("o.owner_user_id"))
    r, o = requests.alias("r"), owner.alias("o")
    return Access(r.join(o, cond, "left_semi"), r.join(o, cond, "left_anti"))


def image_manifest(t: Tables) -> DataFrame:
    """Images per product, primary first then sort_order; missing or empty
    alt text becomes 'Product image n' and a missing or zero sort order becomes
    n - 1 (n = position; both as the reference's falsy values do), with the
    product's image count.

    The position is a row_number over the product's images; the count is a
    window count over the same partition.
    """
    w = Window.partitionBy("product_id").orderBy(F.col("is_primary").desc_nulls_last(), asc_pg("sort_order"),
                                                 F.col("image_id").asc())
    counts = t["product_images"].groupBy("product_id").agg(F.count(F.lit(1)).alias("image_count"))
    return (t["product_images"].withColumn("position", F.row_number().over(w))
            .withColumn("alt_text", F.coalesce(F.nullif(F.col("alt_text"), F.lit("")),
                                               F.concat(F.lit("Product image "), F.col("position").cast("string"))))
            .withColumn("sort_order", F.coalesce(F.nullif(F.col("sort_order"), F.lit(0)), (F.col("position") - 1).cast("int")))
            .join(counts, "product_id"))


# ------------------------------------------------------------------ P4 - P6

# Words that flag a review comment.
FLAG_WORDS = ("scam", "fake", "fraud")


def flagged_reviews(t: Tables, words: Iterable[str] = FLAG_WORDS, max_rating: int = 2) -> DataFrame:
    """Reviews rated <= max_rating or whose comment contains a flag word
    (case-insensitive); a NULL comment leaves only the rating test."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.coalesce(F.col("comment").ilike(f"%{w}%"), F.lit(False))
    r = t["reviews"].where((F.col("rating") <= max_rating) | hit)
    return (r.join(t["users"].select("user_id", F.col("name").alias("user_name"), F.col("email").alias("user_email")),
                   "user_id")
            .join(t["products"].select("product_id", F.col("title").alias("product_title")), "product_id")
            .orderBy(desc_pg("created_at"), "review_id"))


def active_cart(t: Tables) -> DataFrame:
    """P5: for every owner (user, or guest session) the newest active cart with
    its totals. ``row_number() = 1`` per owner is planned as a WindowGroupLimit,
    so each map partition keeps one cart per owner before the shuffle."""
    from storefront.operators.sellers import cart_totals
    c = (t["carts"].where(F.col("status") == "active")
         .withColumn("owner_kind", F.when(F.col("user_id").isNotNull(), "user").otherwise("session"))
         .withColumn("owner", F.coalesce(F.col("user_id").cast("string"), F.col("session_id"))))
    w = Window.partitionBy("owner_kind", "owner").orderBy(desc_pg("created_at"), F.col("cart_id").asc())
    newest = c.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).select("cart_id", "owner_kind")
    totals = cart_totals(t).select("cart_id", "user_id", "session_id", "status", "created_at", "updated_at",
                                   "item_count", "total_amount")
    return totals.join(newest, "cart_id")


def payment_status(txns: DataFrame, checkout_ids: DataFrame) -> Lookup:
    """Status for a set of checkout ids: settled transactions return their
    stored result (``cached``), pending ones are flagged for a re-query."""
    found = lookup(txns, checkout_ids, "checkout_request_id")
    f = found.found.select("checkout_request_id", "transaction_id", "status", "result_code", "result_desc",
                           "mpesa_receipt_number",
                           (F.col("status") != "pending").alias("cached"),
                           (F.col("status") == "pending").alias("needs_query"))
    return Lookup(f, found.missing)
