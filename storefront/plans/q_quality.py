"""Data quality queries over the whole shop."""

from __future__ import annotations

from pyspark.sql import functions as F

from storefront.operators import quality as Q
from storefront.plans.registry import query
from storefront.sources.schemas import ENUMS, PRIMARY_KEYS

VIEWS = {"users": "shop_users", "sellers": "shop_sellers", "carts": "shop_carts", "addresses": "shop_addresses",
         "categories": "shop_categories", "products": "shop_products", "product_images": "shop_product_images",
         "cart_items": "shop_cart_items", "orders": "shop_orders", "order_items": "shop_order_items", "payments": "shop_payments",
         "reviews": "shop_reviews", "delivery_pricing": "shop_delivery_pricing", "special_offers": "shop_offers",
         "product_offers": "shop_product_offers", "mpesa_transactions": "shop_transactions"}

# Columns of the rules and keys that the driver data does not fill: NULL in every row.
UNFILLED = {"users": ("password_hash",), "sellers": ("tax_id", "business_license"), "addresses": ("building", "postal_code"),
            "categories": ("icon_path",), "products": ("rating", "review_count"), "orders": ("cart_id",),
            "payments": ("mpesa_code", "mpesa_phone", "transaction_reference"), "special_offers": ("banner_image_url",),
            "mpesa_transactions": ("merchant_request_id",)}
NUMERIC = ("rating", "review_count", "cart_id")


def _rows(name: str) -> str:
    """The table with its unfilled columns as typed NULLs."""
    more = "".join(f", CAST(NULL AS {'DECIMAL(10,2)' if c in NUMERIC else 'VARCHAR'}) AS {c}" for c in UNFILLED.get(name, ()))
    return f"(SELECT *{more} FROM {VIEWS[name]})"


def _key(name: str, of: str = "") -> str:
    return " || '|' || ".join(f"CAST({of}{k} AS VARCHAR)" for k in PRIMARY_KEYS[name])


def _rules_sql(name: str) -> str:
    rules = [(f"{c}_not_null", f"{c} IS NOT NULL") for c in Q.NOT_NULL.get(name, ())]
    rules += [(f"{c}_max_length_{n}", f"length({c}) <= {n}") for c, n in Q.MAX_LENGTH.get(name, {}).items()]
    rules += [(f"{c}_allowed", f"{c} IN ({', '.join(repr(v) for v in values)})") for (tbl, c), values in ENUMS.items() if tbl == name]
    rules += list(Q.CHECKS.get(name, ()))
    broken = ", ".join(f"CASE WHEN NOT coalesce({ok}, true) THEN '{rule}' END" for rule, ok in rules)
    return (f"SELECT '{name}' AS table_name, {_key(name)} AS row_key, concat_ws(',', {broken}) AS broken_rules "
            f"FROM {_rows(name)} x WHERE concat_ws(',', {broken}) <> ''")


@query("rejected_rows", "\nUNION ALL\n".join(_rules_sql(n) for n in VIEWS))
def _q1(t):
    """Q1 over all sixteen tables, every rule (every transaction lacks a merchant
    request id, which the DDL requires)."""
    return Q.rejected_rows(t, VIEWS)


def _fk_sql() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{child}.{col} -> {parent}.{pcol}' AS foreign_key, '{child}' AS child_table, {_key(child, 'c.')} AS child_key, "
        f"CAST(c.{col} AS BIGINT) AS missing_key FROM {_rows(child)} c WHERE c.{col} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {VIEWS[parent]} p WHERE p.{pcol} = c.{col})" for child, col, parent, pcol, _ in Q.FOREIGN_KEYS)


@query("orphans", _fk_sql())
def _q2(t):
    """Q2 over every foreign key of the schema."""
    return Q.orphans(t)


def _unique_sql(name: str, cols: tuple[str, ...]) -> str:
    return (f"SELECT '{name}' AS table_name, '{','.join(cols)}' AS key_columns, "
            f"{' || chr(124) || '.join(f'CAST({c} AS VARCHAR)' for c in cols)} AS key_value, count(*) AS row_count FROM {_rows(name)} x "
            f"WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)} GROUP BY {', '.join(cols)} HAVING count(*) > 1")


@query("duplicate_keys", "\nUNION ALL\n".join(_unique_sql(n, k) for n in VIEWS for k in (PRIMARY_KEYS[n], *Q.UNIQUE.get(n, ()))))
def _q3_all(t):
    """Q3 for all sixteen tables, every primary and unique key."""
    return Q.duplicates(t)


@query("duplicates", """
SELECT 'reviews' AS table_name, 'user_id,product_id' AS key_columns,
       CAST(user_id AS VARCHAR) || '|' || CAST(product_id AS VARCHAR) AS key_value, count(*) AS row_count
FROM shop_reviews GROUP BY user_id, product_id HAVING count(*) > 1
UNION ALL
SELECT 'cart_items', 'cart_id,product_id', CAST(cart_id AS VARCHAR) || '|' || CAST(product_id AS VARCHAR), count(*)
FROM shop_cart_items GROUP BY cart_id, product_id HAVING count(*) > 1
UNION ALL
SELECT 'order_items', 'order_item_id', CAST(order_item_id AS VARCHAR), count(*)
FROM shop_order_items GROUP BY order_item_id HAVING count(*) > 1
UNION ALL
SELECT 'users', 'email', email, count(*) FROM shop_users GROUP BY email HAVING count(*) > 1""")
def _q3(t):
    """Q3 for reviews, cart items, order lines (primary and unique keys) and user e-mail."""
    return Q.duplicates(t, ("reviews", "cart_items", "order_items")).unionByName(
        Q.duplicates(t, ("users",)).where(F.col("key_columns") == "email"))


@query("account_conflicts", """
SELECT DISTINCT r.request_id, u.user_id AS conflict_user_id, 'email' AS field
FROM (SELECT user_id AS request_id, email FROM shop_users) r JOIN shop_users u ON r.email = u.email
UNION
SELECT DISTINCT r.request_id, u.user_id, 'phone'
FROM (SELECT user_id AS request_id, phone FROM shop_users) r JOIN shop_users u ON r.phone = u.phone""")
def _q4(t):
    """Q4: every existing account submitted again as a new registration."""
    reqs = t["users"].select(F.col("user_id").alias("request_id"), F.lit(None).cast("long").alias("user_id"),
                             "email", "phone")
    return Q.account_conflicts(t["users"], reqs)
