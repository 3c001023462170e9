"""Images, specs, checked loading, delivery prices and the archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from storefront.functions.scalar import spec_value, specs_map, specs_with
from storefront.operators import changes as C
from storefront.operators import enrich as E
from storefront.operators import payments as P
from storefront.plans.registry import EVENTS_AS_OF, query
from storefront.session import scratch_path
from storefront.sources.schemas import load_checked
from storefront.sources.sinks import read_archive, write_archive

EDAY = f"date_trunc('day', TIMESTAMP '{EVENTS_AS_OF}')"
IMAGE_ORDER = "is_primary DESC NULLS LAST, sort_order ASC NULLS LAST, image_id"


@query("image_manifest", f"""
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {IMAGE_ORDER}) AS place,
                       count(*) OVER (PARTITION BY product_id) AS image_count FROM shop_product_images)
SELECT image_id, product_id, image_url, coalesce(nullif(alt_text, ''), 'Product image ' || CAST(place AS VARCHAR)) AS alt_text,
       is_primary, CAST(coalesce(nullif(sort_order, 0), place - 1) AS INT) AS sort_order, CAST(place AS INT) AS position, image_count
FROM placed""")
def _j16(t):
    """Every product's images in order, with default texts and places."""
    return E.image_manifest(t).select("image_id", "product_id", "image_url", "alt_text", "is_primary", "sort_order",
                                      "position", "image_count")


IMAGE_REQUESTS = """requests AS (
  SELECT i.image_id, CASE WHEN i.image_id % 3 = 0 THEN s.user_id + 1 ELSE s.user_id END AS user_id
  FROM shop_product_images i JOIN shop_products p ON p.product_id = i.product_id JOIN shop_sellers s ON s.seller_id = p.seller_id
  UNION ALL SELECT -image_id - 1, 1 FROM shop_product_images WHERE image_id % 10 = 0)"""


def _image_requests(t):
    """One request per image by its seller's user, every third by the next user;
    every tenth also for an image that does not exist."""
    owned = (t["product_images"].select("image_id", "product_id").join(t["products"].select("product_id", "seller_id"), "product_id")
             .join(t["sellers"].select("seller_id", "user_id"), "seller_id"))
    image = F.col("image_id")
    return owned.select(image, F.when(image % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id")).unionByName(
        t["product_images"].where(image % 10 == 0).select((-image - 1).alias("image_id"), F.lit(1).cast("long").alias("user_id")))


@query("image_access", f"""
WITH {IMAGE_REQUESTS}
SELECT r.image_id, r.user_id, coalesce(s.user_id = r.user_id, false) AS allowed
FROM requests r LEFT JOIN shop_product_images i ON i.image_id = r.image_id LEFT JOIN shop_products p ON p.product_id = i.product_id
LEFT JOIN shop_sellers s ON s.seller_id = p.seller_id""")
def _j15(t):
    """Requests for images, allowed for the owner only."""
    access = E.owned_images(t, _image_requests(t))
    return access.allowed.withColumn("allowed", F.lit(True)).unionByName(access.denied.withColumn("allowed", F.lit(False)))


PRIMARY_REQUESTS = """requests AS (
  SELECT image_id AS seq, image_id, product_id FROM shop_product_images WHERE image_id % 2 = 1
  UNION ALL SELECT image_id + 1000000000000, image_id, product_id + 1 FROM shop_product_images WHERE image_id % 5 = 0)"""


def _primary_requests(t):
    """Every second image is to be primary; every fifth is asked for under the wrong product."""
    image, images = F.col("image_id"), t["product_images"]
    return images.where(image % 2 == 1).select(image.alias("seq"), "image_id", "product_id").unionByName(
        images.where(image % 5 == 0).select((image + 10**12).alias("seq"), "image_id", (F.col("product_id") + 1).alias("product_id")))


@query("primary_images_set", f"""
WITH {PRIMARY_REQUESTS},
chosen AS (SELECT r.product_id, max_by(r.image_id, r.seq) AS image_id FROM requests r
           JOIN shop_product_images i ON i.image_id = r.image_id AND i.product_id = r.product_id GROUP BY r.product_id)
SELECT i.image_id, i.product_id, CASE WHEN c.product_id IS NULL THEN i.is_primary ELSE i.image_id = c.image_id END AS is_primary
FROM shop_product_images i LEFT JOIN chosen c ON c.product_id = i.product_id""")
def _t13(t):
    """The images after the requests: one primary image for each product asked for."""
    return C.set_primary_images(t["product_images"], _primary_requests(t)).table.select("image_id", "product_id", "is_primary")


@query("primary_images_refused", f"""
WITH {PRIMARY_REQUESTS}
SELECT r.seq, r.image_id, r.product_id FROM requests r
WHERE NOT EXISTS (SELECT 1 FROM shop_product_images i WHERE i.image_id = r.image_id AND i.product_id = r.product_id)""")
def _t13_refused(t):
    """The requests for an image of another product."""
    return C.set_primary_images(t["product_images"], _primary_requests(t)).rejected.select("seq", "image_id", "product_id")


@query("product_document_images", f"""
SELECT i.product_id, i.image_id, i.image_url, i.alt_text, i.is_primary, i.sort_order,
       row_number() OVER (PARTITION BY i.product_id ORDER BY {IMAGE_ORDER}) AS place,
       count(*) OVER (PARTITION BY i.product_id) AS image_count
FROM shop_product_images i JOIN shop_products p ON p.product_id = i.product_id""")
def _j4_images(t):
    """J4 child rows: every product's images, primary first; the header's count
    beside them. ``place`` numbers the child rows as they come out."""
    doc = E.product_documents(t)
    order = F.struct(~F.col("is_primary"), F.col("sort_order").isNull(), "sort_order", "image_id")
    lists = doc.children["images"].groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct(
        order.alias("o"), "image_id", "image_url", "alt_text", "is_primary", "sort_order"))).alias("images"))
    rows = lists.select("product_id", F.posexplode("images")).select(
        "product_id", "col.image_id", "col.image_url", "col.alt_text", "col.is_primary", "col.sort_order",
        (F.col("pos") + 1).cast("long").alias("place"))
    return rows.join(doc.header.select("product_id", "image_count"), "product_id")


@query("product_document_reviews", """
SELECT r.review_id, r.product_id, r.rating, r.comment, r.created_at, u.name AS user_name
FROM shop_reviews r JOIN shop_products p ON p.product_id = r.product_id LEFT JOIN shop_users u ON u.user_id = r.user_id""")
def _j4_reviews(t):
    """J4 child rows: every product's reviews with their authors."""
    return E.product_documents(t).children["reviews"].select("review_id", "product_id", "rating", "comment", "created_at", "user_name")


@query("seller_document_products", """
SELECT p.product_id, p.seller_id, p.title, p.price, p.sale_price, p.stock, p.created_at FROM shop_products p
JOIN shop_sellers s ON s.seller_id = p.seller_id""")
def _j5_products(t):
    """J5 child rows: every seller's products."""
    return E.seller_documents(t).children["products"].select("product_id", "seller_id", "title", "price", "sale_price", "stock", "created_at")


@query("delivery_price_lookup", """
SELECT a.address_id, a.city, d.standard_fee, d.min_free_delivery FROM shop_addresses a
JOIN shop_delivery_pricing d ON d.city = a.city WHERE d.is_active""")
def _delivery(t):
    """P1/P2 on delivery prices: the active rule of every address's city."""
    rules = t["delivery_pricing"].where("is_active").select("city", "standard_fee", "min_free_delivery")
    return t["addresses"].select("address_id", "city").join(rules, "city")


def _event_specs(t):
    """The events' attributes with a second one, a missing one, a wrong type and cut-off text, by event number."""
    e, props = F.col("event_id"), F.col("props")
    specs = (F.when(e % 7 == 0, F.expr("substring(props, 1, length(props) - 1)"))
             .when(e % 7 == 1, F.concat(F.lit('{"colour": "c'), (e % 3).cast("string"), F.lit('", '), F.expr("substring(props, 2)")))
             .when(e % 7 == 2, F.lit("{}")).when(e % 7 == 3, F.lit('{"k": "many", "colour": null}')).when(e % 7 == 4, F.lit(None).cast("string"))
             .otherwise(props))
    return t.raw("events").select(e, specs.alias("specs"))


@query("event_specs", """
WITH given AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, event_id % 7 NOT IN (0, 4) AS well_formed,
       CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN NULL ELSE 1 END::INT AS attributes,
       CASE WHEN event_id % 7 IN (1, 5, 6) THEN CAST(k AS VARCHAR) WHEN event_id % 7 = 3 THEN 'many' END AS k_text,
       CASE WHEN event_id % 7 IN (1, 5, 6) THEN k END AS k_number,
       CASE WHEN event_id % 7 = 1 THEN 'c' || CAST(event_id % 3 AS VARCHAR) END AS colour,
       event_id % 7 = 1 AND event_id % 3 = 2 AS is_c2
FROM given""")
def _f9(t):
    """keys present, missing, of another type and in malformed text, as a
    map and as typed values."""
    specs = _event_specs(t).withColumn("m", specs_map("specs"))
    return specs.select(
        "event_id", F.col("m").isNotNull().alias("well_formed"), F.when(F.col("m").isNotNull(), F.size("m")).alias("attributes"),
        F.col("m")["k"].alias("k_text"), spec_value("specs", "k", "int").alias("k_number"), F.col("m")["colour"].alias("colour"),
        specs_with("m", {"colour": "c2"}).alias("is_c2"))


def _broken_orders(t):
    """The orders as csv lines; every ninth has text for its amount, every
    eleventh no user."""
    o = F.col("order_id")
    return t["orders"].select(
        o.cast("string").alias("order_id"), F.when(o % 11 == 0, F.lit(None)).otherwise(F.col("user_id")).cast("string").alias("user_id"),
        F.lit(None).cast("string").alias("cart_id"), F.col("address_id").cast("string").alias("address_id"),
        F.when(o % 9 == 0, F.lit("a lot")).otherwise(F.col("total_amount").cast("string")).alias("total_amount"),
        "status", "notes", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.lit(None).cast("string").alias("updated_at"))


@query("orders_load_checked", """
SELECT order_id, CASE WHEN order_id % 9 = 0 THEN 'does not fit the schema' WHEN order_id % 11 = 0 THEN 'missing user_id' END AS reason,
       CASE WHEN order_id % 9 <> 0 AND order_id % 11 <> 0 THEN total_amount END AS total_amount
FROM shop_orders""")
def _s1(t):
    """Every order written as csv, some lines broken, and loaded with
    quarantine: good and quarantined rows together are the input."""
    path = scratch_path(t.spark, "orders-csv")
    _broken_orders(t).write.csv(path)
    loaded = load_checked(t.spark, path, "orders", "csv")
    # A line the parser refused is raw csv; a row that lacks a column is JSON text.
    key = F.coalesce(F.get_json_object("raw", "$.order_id"), F.split_part("raw", F.lit(","), F.lit(1))).cast("long")
    return loaded.rows.select("order_id", F.lit(None).cast("string").alias("reason"), "total_amount").unionByName(
        loaded.quarantined.select(key.alias("order_id"), "reason", F.lit(None).cast("decimal(12,2)").alias("total_amount")))


@query("archive_round_trip", f"""
SELECT transaction_id, order_id, status, amount, created_at FROM shop_transactions
WHERE created_at < {EDAY} - INTERVAL 14 DAY AND status IN ('completed', 'failed', 'cancelled')""")
def _s4(t):
    """Two batches archived, the first one twice, and read back by month:
    nothing doubles."""
    rows = P.archive_split(t["mpesa_transactions"], EVENTS_AS_OF, 14).archive
    path = scratch_path(t.spark, "archive")
    for batch in (0, 1, 0):
        write_archive(rows.where(F.col("transaction_id") % 2 == batch), path, batch)
    return read_archive(t.spark, path, "2024-01", "2024-01").select("transaction_id", "order_id", "status", "amount", "created_at")
