"""The canonical shop tables with fixed schemas.

Every table is a DataFrame with an explicit StructType; nothing is inferred.
Keys are bigint, money is decimal, times are timestamp_ntz in batch.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storefront.session import scratch_path

LONG, INT, STR, BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
TS = T.TimestampNTZType()


def _dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


def _schema(*cols: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


SCHEMAS: dict[str, T.StructType] = {
    "users": _schema(
        ("user_id", LONG, False), ("role", STR, False), ("name", STR, False), ("email", STR, False),
        ("phone", STR, True), ("verified", BOOL, True), ("password_hash", STR, True), ("created_at", TS, True),
        ("updated_at", TS, True), ("last_login", TS, True), ("terms", BOOL, True), ("newsletter", BOOL, True)),
    "sellers": _schema(
        ("seller_id", LONG, False), ("user_id", LONG, False), ("business_name", STR, False), ("tax_id", STR, True),
        ("business_license", STR, True), ("total_sales", _dec(12, 2), True), ("created_at", TS, True)),
    "carts": _schema(
        ("cart_id", LONG, False), ("user_id", LONG, True), ("session_id", STR, True), ("status", STR, False),
        ("created_at", TS, True), ("updated_at", TS, True)),
    "addresses": _schema(
        ("address_id", LONG, False), ("user_id", LONG, False), ("city", STR, False), ("street", STR, False),
        ("building", STR, True), ("postal_code", STR, True), ("is_default", BOOL, True), ("created_at", TS, True)),
    "categories": _schema(
        ("category_id", LONG, False), ("name", STR, False), ("description", STR, True), ("featured", BOOL, True),
        ("icon_path", STR, True), ("created_at", TS, True)),
    "products": _schema(
        ("product_id", LONG, False), ("seller_id", LONG, False), ("category_id", LONG, False), ("title", STR, False),
        ("description", STR, True), ("price", _dec(10, 2), False), ("sale_price", _dec(10, 2), True),
        ("stock", INT, False), ("specs", T.MapType(STR, STR), True), ("rating", _dec(3, 2), True),
        ("review_count", INT, True), ("created_at", TS, True), ("updated_at", TS, True)),
    "product_images": _schema(
        ("image_id", LONG, False), ("product_id", LONG, False), ("image_url", STR, False), ("alt_text", STR, True),
        ("is_primary", BOOL, True), ("sort_order", INT, True)),
    "cart_items": _schema(
        ("cart_item_id", LONG, False), ("cart_id", LONG, False), ("product_id", LONG, False), ("quantity", INT, False),
        ("added_at", TS, True), ("unit_price", _dec(10, 2), False)),
    "orders": _schema(
        ("order_id", LONG, False), ("user_id", LONG, False), ("cart_id", LONG, True), ("address_id", LONG, False),
        ("total_amount", _dec(12, 2), False), ("status", STR, False), ("notes", STR, True), ("created_at", TS, True),
        ("updated_at", TS, True)),
    "order_items": _schema(
        ("order_item_id", LONG, False), ("order_id", LONG, False), ("product_id", LONG, False), ("quantity", INT, False),
        ("unit_price", _dec(10, 2), False), ("discount", _dec(10, 2), True)),
    "payments": _schema(
        ("payment_id", LONG, False), ("order_id", LONG, False), ("method", STR, False), ("amount", _dec(12, 2), False),
        ("mpesa_code", STR, True), ("mpesa_phone", STR, True), ("transaction_reference", STR, True),
        ("is_confirmed", BOOL, True), ("confirmed_at", TS, True), ("created_at", TS, True)),
    "reviews": _schema(
        ("review_id", LONG, False), ("user_id", LONG, False), ("product_id", LONG, False), ("rating", INT, False),
        ("comment", STR, True), ("created_at", TS, True)),
    "delivery_pricing": _schema(
        ("rule_id", LONG, False), ("city", STR, False), ("min_free_delivery", _dec(10, 2), True),
        ("standard_fee", _dec(10, 2), False), ("is_active", BOOL, True), ("created_at", TS, True)),
    "special_offers": _schema(
        ("offer_id", LONG, False), ("title", STR, False), ("description", STR, True),
        ("discount_percent", _dec(5, 2), True), ("banner_image_url", STR, True), ("valid_from", TS, True),
        ("valid_until", TS, True), ("is_active", BOOL, True), ("created_at", TS, True)),
    "product_offers": _schema(("product_id", LONG, False), ("offer_id", LONG, False)),
    "mpesa_transactions": _schema(
        ("transaction_id", LONG, False), ("order_id", LONG, False), ("checkout_request_id", STR, False),
        ("merchant_request_id", STR, True), ("phone_number", STR, False), ("amount", _dec(12, 2), False),
        ("mpesa_receipt_number", STR, True), ("transaction_date", LONG, True), ("status", STR, True),
        ("result_code", STR, True), ("result_desc", STR, True), ("created_at", TS, True), ("updated_at", TS, True)),
}

# Primary keys (fixed by the DDL).
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "users": ("user_id",), "sellers": ("seller_id",), "carts": ("cart_id",), "addresses": ("address_id",),
    "categories": ("category_id",), "products": ("product_id",), "product_images": ("image_id",),
    "cart_items": ("cart_item_id",), "orders": ("order_id",), "order_items": ("order_item_id",),
    "payments": ("payment_id",), "reviews": ("review_id",), "delivery_pricing": ("rule_id",),
    "special_offers": ("offer_id",), "product_offers": ("product_id", "offer_id"),
    "mpesa_transactions": ("transaction_id",),
}

# The enum types of the DDL (plus 'guest', which the code uses).
ENUMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("users", "role"): ("customer", "seller", "admin", "guest"),
    ("orders", "status"): ("pending", "processing", "shipped", "delivered", "cancelled", "failed"),
    ("payments", "method"): ("mpesa", "card", "cash_on_delivery", "cash"),
    ("carts", "status"): ("active", "abandoned", "converted"),
    ("mpesa_transactions", "status"): ("pending", "completed", "failed", "cancelled"),
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the canonical schema: missing columns become typed NULLs, order fixed."""
    have = set(df.columns)
    return df.selectExpr(*[f"CAST({f'`{f.name}`' if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`"
                           for f in SCHEMAS[name].fields])


def load(spark: SparkSession, path: str, name: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read one canonical table with its fixed schema (parquet, csv, json or orc).

    For a live database use ``spark.read.format("jdbc")`` and pass the result to
    :func:`conform`.
    """
    reader = spark.read.schema(SCHEMAS[name]).options(**options)
    return reader.format(fmt).load(path)


class Loaded(NamedTuple):
    rows: DataFrame
    quarantined: DataFrame


def load_checked(spark: SparkSession, path: str, name: str, fmt: str = "csv", **options) -> Loaded:
    """S1 with quarantine: rows that fit the table's schema, and the others with
    their raw text and the reason (a value or line that does not parse, or a
    column that must not be NULL and is). Good and quarantined rows together are
    the input rows.

    The raw files are read once into a staged Parquet table below the shared
    checkpoint folder: a parser that is asked for fewer columns later would
    overlook broken values in the others.
    """
    schema = SCHEMAS[name]
    raw = "_raw_text"
    if fmt in ("csv", "json"):
        wide = T.StructType([*schema.fields, T.StructField(raw, STR, True)])
        df = (spark.read.schema(wide).options(**options).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", raw).format(fmt).load(path))
        broken = F.col(raw).isNotNull()
    else:  # typed formats parse or fail as a whole
        df = spark.read.schema(schema).options(**options).format(fmt).load(path).withColumn(raw, F.lit(None).cast(STR))
        broken = F.lit(False)
    missing = F.concat_ws(",", *[F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in schema.fields if not f.nullable])
    df = df.withColumn("_reason", F.when(broken, "does not fit the schema")
                       .when(missing != "", F.concat(F.lit("missing "), missing)))
    staged = scratch_path(spark, f"load-{name}")
    df.write.parquet(staged)
    df = spark.read.schema(df.schema).parquet(staged)
    bad = df.where(F.col("_reason").isNotNull())
    text = F.coalesce(F.col(raw), F.to_json(F.struct(*schema.names)))
    return Loaded(df.where(F.col("_reason").isNull()).select(*schema.names),
                  bad.select(text.alias("raw"), F.col("_reason").alias("reason")))


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
