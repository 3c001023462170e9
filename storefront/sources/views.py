"""Canonical shop tables derived from the driver's TPC-H-style tables.

The mapping rules are fixed by the test plan (customers become users,
suppliers sellers, parts products, lineitems order items, events payment
transactions, reviews, carts and cart items). Each view is a lazy DataFrame;
Catalyst prunes the columns and pushes filters into the parquet scans.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storefront.sources.schemas import SCHEMAS, conform

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")

SHOP_TABLES = ("users", "sellers", "categories", "products", "addresses", "orders", "order_items", "payments",
               "mpesa_transactions", "reviews", "carts", "cart_items", "special_offers", "product_offers",
               "product_images", "delivery_pricing")

EPOCH_SQL = "TIMESTAMP_NTZ '1995-01-01 00:00:00'"

# Category rows (id, name, featured); parts map to them by p_type.
CATEGORY_ROWS = [(1, "STANDARD", True), (2, "PROMO", False), (3, "ECONOMY", True), (4, "MEDIUM", False),
                 (5, "SMALL", True), (6, "LARGE", False), (7, "EMPTY", False)]


# Columns of the driver tables. Reading with the schema needs no
# footer scan, so nothing has to be remembered between queries.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
}

#: A link of a page: its address and its text.
LINK = '<a href="([^"]*)">([^<]*)</a>'


def _shop(df: DataFrame, table: str, /, **exprs: str) -> DataFrame:
    """The canonical ``table`` from SQL expressions over ``df``, in one
    projection; columns without one are typed NULLs. (A text is one call to the
    JVM, a tree of Column objects one per node: this is most of the time that
    building a query takes.)"""
    return df.selectExpr(*[f"CAST({exprs.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in SCHEMAS[table]])


class ShopTables(Mapping):
    """Lazily built shop tables over one driver directory: ``t["orders"]``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}
        self._extra: dict[str, DataFrame] = {}
        self._raw: dict[str, DataFrame] = {}

    # driver tables
    def raw(self, name: str) -> DataFrame:
        """A driver table, read once per ``ShopTables`` object."""
        if name not in self._raw:
            self._raw[name] = self.spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    # Mapping protocol
    def __getitem__(self, name: str) -> DataFrame:
        if name in self._extra:
            return self._extra[name]
        if name not in self._cache:
            if name not in SHOP_TABLES:
                raise KeyError(name)
            self._cache[name] = getattr(self, f"_{name}")()
        return self._cache[name]

    def __iter__(self) -> Iterator[str]:
        return iter(SHOP_TABLES + tuple(k for k in self._extra if k not in SHOP_TABLES))

    def __len__(self) -> int:
        return len(tuple(iter(self)))

    def with_tables(self, **tables: DataFrame) -> "ShopTables":
        """A copy where some tables are replaced (e.g. the output of a change)."""
        out = ShopTables(self.spark, self.sf_dir)
        out._cache, out._raw, out._extra = self._cache, self._raw, {**self._extra, **tables}
        return out

    # ------------------------------------------------------------------ views
    def _n_suppliers(self) -> F.Column:
        return self.raw("supplier").select(F.count(F.lit(1))).scalar()

    def _n_parts(self) -> F.Column:
        return self.raw("part").select(F.count(F.lit(1))).scalar()

    def _users(self) -> DataFrame:
        first = self.raw("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
        cust = self.raw("customer").join(first, F.col("o_custkey") == F.col("c_custkey"), "left")
        return _shop(cust, "users", user_id="c_custkey", role="CASE WHEN c_custkey % 500 = 0 THEN 'admin' ELSE 'customer' END",
                     name="c_name", email="concat('c', c_custkey, '@example.com')",
                     phone="concat('+2547', lpad(CAST(c_custkey AS STRING), 8, '0'))",
                     created_at=f"coalesce(first_order, {EPOCH_SQL})").union(
            _shop(self.raw("supplier"), "users", user_id="10000000 + s_suppkey", role="'seller'", name="s_name",
                  email="concat('s', s_suppkey, '@example.com')", phone="concat('+2541', lpad(CAST(s_suppkey AS STRING), 8, '0'))",
                  created_at=EPOCH_SQL))

    def _sellers(self) -> DataFrame:
        return _shop(self.raw("supplier"), "sellers", seller_id="s_suppkey", user_id="10000000 + s_suppkey", business_name="s_name",
                     total_sales="0", created_at=EPOCH_SQL)

    def _categories(self) -> DataFrame:
        return conform(self.spark.createDataFrame(CATEGORY_ROWS, "category_id long, name string, featured boolean"), "categories")

    def _products(self) -> DataFrame:
        ship = self.raw("lineitem").groupBy("l_partkey").agg(
            F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
        parts = (self.raw("part").join(ship, F.col("l_partkey") == F.col("p_partkey"), "left")
                 .withColumn("suppliers", self._n_suppliers()))
        price = "CAST(p_retailprice AS DECIMAL(10,2))"
        return _shop(parts, "products", product_id="p_partkey", seller_id="p_partkey % suppliers",
                     category_id="CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'PROMO' THEN 2 WHEN 'ECONOMY' THEN 3 WHEN 'MEDIUM' THEN 4 "
                                 "WHEN 'SMALL' THEN 5 ELSE 6 END",
                     title="p_name", price=price, sale_price=f"CASE WHEN p_partkey % 3 = 0 THEN {price} - 100 END",
                     stock="(p_partkey * 7) % 50", created_at="first_ship", updated_at="last_ship")

    def _addresses(self) -> DataFrame:
        cust = self.raw("customer").join(self.raw("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        return _shop(cust, "addresses", address_id="c_custkey", user_id="c_custkey", city="n_name",
                     street="concat('Street ', c_custkey % 100)", is_default="c_custkey % 2 = 0")

    def _orders(self) -> DataFrame:
        return _shop(self.raw("orders"), "orders", order_id="o_orderkey", user_id="o_custkey", address_id="o_custkey",
                     total_amount="CAST(o_totalprice AS DECIMAL(12,2))",
                     status="CASE o_orderpriority WHEN '1-URGENT' THEN 'processing' WHEN '2-HIGH' THEN 'shipped' "
                            "WHEN '3-MEDIUM' THEN 'delivered' WHEN '4-NOT SPECIFIED' THEN 'pending' "
                            "ELSE CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'cancelled' END END",
                     created_at="o_orderdate")

    def _order_items(self) -> DataFrame:
        # Lines have no natural key; number them inside their order (a window
        # partitioned by order key: bounded groups, no global sort).
        li = self.raw("lineitem").selectExpr(
            "*", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, "
                 "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn")
        lines = li.join(self.raw("part"), F.col("p_partkey") == F.col("l_partkey"))
        return _shop(lines, "order_items", order_item_id="l_orderkey * 100 + rn", order_id="l_orderkey", product_id="l_partkey",
                     quantity="CAST(l_quantity AS INT)", unit_price="CAST(p_retailprice AS DECIMAL(10,2))", discount="0")

    def _payments(self) -> DataFrame:
        return _shop(self.raw("orders"), "payments", payment_id="o_orderkey", order_id="o_orderkey",
                     method="CASE o_orderkey % 4 WHEN 2 THEN 'cash' WHEN 3 THEN 'card' ELSE 'mpesa' END",
                     amount="CAST(o_totalprice AS DECIMAL(12,2))",
                     is_confirmed="CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey % 5 <> 0 END", created_at="o_orderdate")

    def _mpesa_transactions(self) -> DataFrame:
        return transactions_from_events(self.raw("events"))

    def _reviews(self) -> DataFrame:
        views = self.raw("events").where("event_type = 'view'").withColumn("parts", self._n_parts())
        return _shop(views, "reviews", review_id="event_id", user_id="user_id", product_id="event_id % parts", rating="1 + event_id % 5",
                     comment="CASE event_id % 11 WHEN 0 THEN 'Looks like a SCAM' WHEN 1 THEN 'fake item' WHEN 2 THEN 'Fraudulent seller' "
                             "WHEN 3 THEN NULL ELSE 'fine' END", created_at="ts")

    def _carts(self) -> DataFrame:
        seen = self.raw("events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        return _shop(seen, "carts", cart_id="user_id", user_id="CASE WHEN user_id % 4 <> 0 THEN user_id END",
                     session_id="CASE WHEN user_id % 4 = 0 THEN concat('guest_', user_id) END",
                     status="CASE user_id % 3 WHEN 0 THEN 'abandoned' WHEN 1 THEN 'active' ELSE 'converted' END",
                     created_at="first_ts", updated_at="last_ts")

    def _cart_items(self) -> DataFrame:
        e = F.col("event_id")
        clicks = (self.raw("events").where("event_type = 'click'")
                  .groupBy(F.col("user_id").alias("cart"), (e % self._n_parts()).alias("product"))
                  .agg(F.min(e).alias("item"), F.count(F.lit(1)).alias("n"), F.min(900 + e % 100).alias("price"), F.min("ts").alias("first_ts")))
        return _shop(clicks, "cart_items", cart_item_id="item", cart_id="cart", product_id="product", quantity="n", added_at="first_ts",
                     unit_price="price")

    def _special_offers(self) -> DataFrame:
        return _shop(self.raw("nation"), "special_offers", offer_id="n_nationkey", title="n_name", discount_percent="5 + n_nationkey",
                     valid_until="CASE n_nationkey % 3 WHEN 0 THEN TIMESTAMP_NTZ '2023-12-31 00:00:00' "
                                 "WHEN 1 THEN TIMESTAMP_NTZ '2024-06-30 00:00:00' END", is_active="n_nationkey % 2 = 0")

    def _product_images(self) -> DataFrame:
        # The links of a page, in page order, stand for the images of a product.
        links = self.raw("pages").selectExpr(
            "page_id", f"posexplode(arrays_zip(regexp_extract_all(html, '{LINK}', 1), regexp_extract_all(html, '{LINK}', 2))) AS (pos, link)")
        links = links.withColumn("parts", self._n_parts())
        return _shop(links, "product_images", image_id="page_id * 100000 + pos", product_id="page_id % parts",
                     image_url="concat('/uploads/products', link['0'])", alt_text="CASE WHEN pos % 3 <> 1 THEN link['1'] END",
                     is_primary="pos = page_id % 4", sort_order="CASE WHEN pos % 4 <> 3 THEN (pos * 7 + page_id) % 5 END")

    def _delivery_pricing(self) -> DataFrame:
        return _shop(self.raw("nation"), "delivery_pricing", rule_id="n_nationkey + 1", city="n_name",
                     min_free_delivery="CASE WHEN n_nationkey % 4 <> 0 THEN 1000 + 100 * n_nationkey END",
                     standard_fee="150 + 10 * n_nationkey", is_active="n_nationkey % 5 <> 0", created_at=EPOCH_SQL)

    def _product_offers(self) -> DataFrame:
        return _shop(self.raw("part").where("p_partkey % 4 = 0"), "product_offers", product_id="p_partkey", offer_id="p_partkey % 25")


def transactions_from_events(events: DataFrame) -> DataFrame:
    """Payment transactions from event rows; a per-row projection, so it also
    works on a streaming DataFrame."""
    paid = "event_type IN ('purchase', 'view')"
    return _shop(
        events, "mpesa_transactions", transaction_id="event_id", order_id="event_id * 2", checkout_request_id="concat('ws_CO_', event_id)",
        phone_number="concat('2547', lpad(CAST(user_id AS STRING), 8, '0'))", amount="CAST(value AS DECIMAL(12,2))",
        status=f"CASE WHEN {paid} THEN 'completed' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'pending' "
               "ELSE 'cancelled' END",
        result_code=f"CASE WHEN {paid} THEN '0' WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '1032' END END",
        result_desc="CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'Insufficient funds' WHEN 1 THEN 'Cancelled by user' END END",
        mpesa_receipt_number=f"CASE WHEN {paid} THEN concat('R', event_id) END", created_at="ts", updated_at="ts")


def categories_of_parts(part: DataFrame) -> DataFrame:
    """The categories that the parts' types name, and the empty one: what the
    fixed rows are for parts of every type."""
    kind = F.col("p_type")
    number = F.when(kind == "STANDARD", 1)
    for i, name in enumerate(("PROMO", "ECONOMY", "MEDIUM", "SMALL"), start=2):
        number = number.when(kind == name, i)
    found = part.select(number.otherwise(6).alias("category_id")).distinct()
    rows = part.sparkSession.createDataFrame(CATEGORY_ROWS, "category_id long, name string, featured boolean")
    return conform(rows.join(found, "category_id", "left_semi").unionByName(rows.where("category_id = 7")), "categories")


def shop_views(spark: SparkSession, sf_dir: str) -> ShopTables:
    """S2 entry point: the canonical shop tables over one driver directory as
    its files are now. Keep the returned object to reuse its DataFrames."""
    return ShopTables(spark, sf_dir)
