"""Data quality: row rules, referential integrity, uniqueness, account conflicts (Q1-Q4).

Rules follow SQL CHECK semantics: a rule fails only when it is false, so a
NULL passes unless there is a NOT NULL rule. Orphans are anti joins (never
``LEFT JOIN .. IS NULL``); duplicates are group-bys with a count filter;
conflicts are two equi-joins united, never an OR join (which would become a
nested loop).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storefront.sources.schemas import ENUMS, PRIMARY_KEYS

Tables = Mapping[str, DataFrame]

# ---------------------------------------------------------------- fixed values
# Constraints of the shop DDL. NOT NULL columns; maximum text lengths;
# CHECK rules as SQL text over the table's own columns.
NOT_NULL: dict[str, tuple[str, ...]] = {
    "users": ("role", "name", "email"),
    "sellers": ("user_id", "business_name"),
    "carts": ("status",),
    "addresses": ("user_id", "city", "street"),
    "categories": ("name",),
    "products": ("seller_id", "category_id", "title", "price", "stock"),
    "product_images": ("product_id", "image_url"),
    "cart_items": ("cart_id", "product_id", "quantity", "unit_price"),
    "orders": ("user_id", "address_id", "total_amount", "status"),
    "order_items": ("order_id", "product_id", "quantity", "unit_price"),
    "payments": ("order_id", "method", "amount"),
    "reviews": ("user_id", "product_id", "rating"),
    "delivery_pricing": ("city", "standard_fee"),
    "special_offers": ("title",),
    "product_offers": ("product_id", "offer_id"),
    "mpesa_transactions": ("order_id", "checkout_request_id", "merchant_request_id", "phone_number", "amount"),
}

MAX_LENGTH: dict[str, dict[str, int]] = {
    "users": {"name": 100, "email": 100, "phone": 13, "password_hash": 255},
    "sellers": {"business_name": 100, "tax_id": 50, "business_license": 100},
    "carts": {"session_id": 100},
    "addresses": {"city": 50, "street": 255, "building": 50, "postal_code": 20},
    "categories": {"name": 50, "icon_path": 255},
    "products": {"title": 100},
    "product_images": {"image_url": 255, "alt_text": 100},
    "payments": {"mpesa_code": 20, "mpesa_phone": 13, "transaction_reference": 100},
    "delivery_pricing": {"city": 50},
    "special_offers": {"title": 100, "banner_image_url": 255},
    "mpesa_transactions": {"checkout_request_id": 100, "merchant_request_id": 100, "phone_number": 15,
                           "mpesa_receipt_number": 50, "status": 20, "result_code": 10},
}

CHECKS: dict[str, tuple[tuple[str, str], ...]] = {
    "users": (("phone_prefix", "phone LIKE '+254%'"),),
    "carts": (("cart_owner", "(user_id IS NOT NULL AND session_id IS NULL) OR (user_id IS NULL AND session_id IS NOT NULL)"),),
    "products": (("price_positive", "price > 0"), ("sale_price_positive", "sale_price > 0"),
                 ("stock_non_negative", "stock >= 0"), ("rating_range", "rating >= 0 AND rating <= 5"),
                 ("review_count_non_negative", "review_count >= 0")),
    "cart_items": (("quantity_positive", "quantity > 0"), ("unit_price_positive", "unit_price > 0")),
    "orders": (("total_amount_positive", "total_amount > 0"),),
    "order_items": (("quantity_positive", "quantity > 0"), ("unit_price_positive", "unit_price > 0")),
    "payments": (("amount_positive", "amount > 0"), ("mpesa_phone_prefix", "mpesa_phone LIKE '+254%'")),
    "reviews": (("rating_range", "rating >= 1 AND rating <= 5"),),
    "special_offers": (("discount_range", "discount_percent > 0 AND discount_percent <= 100"),),
    "mpesa_transactions": (("amount_positive", "amount > 0"),),
}

# The rules that read several columns, as functions of a row (a dict): what a
# fold over the changes of one row asks. table -> rule -> (columns, holds).
ROW_RULES: dict[str, dict[str, tuple[tuple[str, ...], Callable[[dict], bool]]]] = {
    "carts": {"cart_owner": (("user_id", "session_id"), lambda row: (row["user_id"] is None) != (row["session_id"] is None))},
}

# Unique constraints besides the primary keys.
UNIQUE: dict[str, tuple[tuple[str, ...], ...]] = {
    "users": (("email",), ("phone",)),
    "sellers": (("user_id",),),
    "categories": (("name",),),
    "cart_items": (("cart_id", "product_id"),),
    "payments": (("order_id",),),
    "reviews": (("user_id", "product_id"),),
    "delivery_pricing": (("city",),),
    "mpesa_transactions": (("checkout_request_id",),),
}

# Foreign keys: (child table, child column, parent table, parent column, on delete).
FOREIGN_KEYS: tuple[tuple[str, str, str, str, str], ...] = (
    ("sellers", "user_id", "users", "user_id", "cascade"),
    ("carts", "user_id", "users", "user_id", "cascade"),
    ("addresses", "user_id", "users", "user_id", "cascade"),
    ("reviews", "user_id", "users", "user_id", "cascade"),
    ("orders", "user_id", "users", "user_id", "restrict"),
    ("products", "seller_id", "sellers", "seller_id", "cascade"),
    ("products", "category_id", "categories", "category_id", "restrict"),
    ("product_images", "product_id", "products", "product_id", "cascade"),
    ("cart_items", "product_id", "products", "product_id", "cascade"),
    ("reviews", "product_id", "products", "product_id", "cascade"),
    ("product_offers", "product_id", "products", "product_id", "cascade"),
    ("order_items", "product_id", "products", "product_id", "restrict"),
    ("cart_items", "cart_id", "carts", "cart_id", "cascade"),
    ("orders", "cart_id", "carts", "cart_id", "no action"),
    ("orders", "address_id", "addresses", "address_id", "restrict"),
    ("order_items", "order_id", "orders", "order_id", "cascade"),
    ("payments", "order_id", "orders", "order_id", "cascade"),
    ("mpesa_transactions", "order_id", "orders", "order_id", "cascade"),
    ("product_offers", "offer_id", "special_offers", "offer_id", "cascade"),
)


def table_rules(name: str, columns: Iterable[str]) -> list[tuple[str, Column]]:
    """Every rule of one table as (rule name, boolean column; NULL = pass)."""
    cols = set(columns)
    rules: list[tuple[str, Column]] = []
    for c in NOT_NULL.get(name, ()):
        if c in cols:
            rules.append((f"{c}_not_null", F.col(c).isNotNull()))
    for c, n in MAX_LENGTH.get(name, {}).items():
        if c in cols:
            rules.append((f"{c}_max_length_{n}", F.length(c) <= n))
    for (tbl, c), allowed in ENUMS.items():
        if tbl == name and c in cols:
            rules.append((f"{c}_allowed", F.col(c).isin(*allowed)))
    for rule_name, sql in CHECKS.get(name, ()):
        rules.append((rule_name, F.expr(sql)))
    return rules


class Checked(NamedTuple):
    valid: DataFrame
    rejects: DataFrame


def check_rows(df: DataFrame, rules: list[tuple[str, Column]]) -> Checked:
    """Q1: split rows into valid ones and rejects with the list of broken rules.

    A per-row projection (no shuffle): ``broken_rules`` is computed once and
    both outputs filter on it.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(True)), F.lit(n)) for n, r in rules])) \
        if rules else F.array().cast("array<string>")
    marked = df.withColumn("broken_rules", broken)
    return Checked(marked.where(F.size("broken_rules") == 0).drop("broken_rules"),
                   marked.where(F.size("broken_rules") > 0))


def check_table(t: Tables, name: str) -> Checked:
    df = t[name]
    return check_rows(df, table_rules(name, df.columns))


def _key_text(name: str) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in PRIMARY_KEYS[name]])


def rejected_rows(t: Tables, tables: Iterable[str]) -> DataFrame:
    """Q1 over several tables: (table_name, row_key, broken_rules as text)."""
    out = None
    for name in tables:
        r = check_table(t, name).rejects.select(
            F.lit(name).alias("table_name"), _key_text(name).alias("row_key"),
            F.array_join("broken_rules", ",").alias("broken_rules"))
        out = r if out is None else out.unionByName(r)
    return out


def orphans(t: Tables, keys=FOREIGN_KEYS) -> DataFrame:
    """Q2: child rows whose (non-NULL) foreign key has no parent, for every key.

    Per parent, the references of all its children are united and anti-joined
    with the parent's keys once; the parent is not de-duplicated first. A
    reference is a few numbers; names and key texts are made for the misses.
    """
    names = [f"{child}.{col} -> {parent}.{pcol}" for child, col, parent, pcol, _ in keys]
    by_parent: dict[tuple[str, str], DataFrame] = {}
    for i, (child, col, parent, pcol, _) in enumerate(keys):
        own = [F.col(k).cast("long") for k in PRIMARY_KEYS[child]]
        refs = t[child].where(F.col(col).isNotNull()).select(
            F.lit(i).alias("_fk"), own[0].alias("_k1"), (own[1] if len(own) > 1 else F.lit(None).cast("long")).alias("_k2"),
            F.col(col).cast("long").alias("missing_key"))
        at = (parent, pcol)
        by_parent[at] = by_parent[at].unionByName(refs) if at in by_parent else refs
    out = None
    for (parent, pcol), refs in by_parent.items():
        miss = refs.join(t[parent].select(F.col(pcol).cast("long").alias("missing_key")), "missing_key", "left_anti")
        out = miss if out is None else out.unionByName(miss)
    named = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k[0]).alias("c")) for n, k in zip(names, keys)])
    return out.select(named[F.col("_fk")]["n"].alias("foreign_key"), named[F.col("_fk")]["c"].alias("child_table"),
                      F.concat_ws("|", F.col("_k1").cast("string"), F.col("_k2").cast("string")).alias("child_key"), "missing_key")


def duplicates(t: Tables, tables: Iterable[str] | None = None) -> DataFrame:
    """Q3: key values held by more than one row, for primary and unique keys
    (rows with a NULL in the key are excluded, as SQL UNIQUE does). A table is
    scanned once: its keys are grouping sets of one aggregate, each counted in
    partial aggregates."""
    out = None
    for name in tables or PRIMARY_KEYS:
        sets = [list(k) for k in (PRIMARY_KEYS[name], *UNIQUE.get(name, ()))]
        cols = list(dict.fromkeys(c for k in sets for c in k))
        if len(sets) == 1:
            found = t[name].groupBy(*cols).agg(F.count(F.lit(1)).alias("row_count"), F.lit(0).cast("long").alias("_set"))
        else:
            found = t[name].groupingSets([[F.col(c) for c in k] for k in sets], *cols).agg(
                F.count(F.lit(1)).alias("row_count"), F.grouping_id(*cols).alias("_set"))
        found = found.where(F.col("row_count") > 1)
        for k in sets:
            # grouping_id has a one for every column that is not in the set
            bits = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in k) if len(sets) > 1 else 0
            held = F.col("_set") == bits
            for c in k:
                held = held & F.col(c).isNotNull()
            key_text = F.concat_ws("|", *[F.col(c).cast("string") for c in k])
            one = F.struct(F.lit(name).alias("table_name"), F.lit(",".join(k)).alias("key_columns"), key_text.alias("key_value"))
            found = found.withColumn("_row", F.when(held, one) if k is sets[0] else F.coalesce("_row", F.when(held, one)))
        d = found.where(F.col("_row").isNotNull()).select("_row.*", "row_count")
        out = d if out is None else out.unionByName(d)
    return out


def account_conflicts(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Q4: requests (request_id, user_id or NULL for a new account, email, phone)
    whose e-mail or phone is already used by another account.

    Two equi-joins (e-mail, phone) united and de-duplicated.
    """
    def by(field: str) -> DataFrame:
        u = users.select(F.col("user_id").alias("conflict_user_id"), F.col(field).alias("_v")).where(
            F.col("_v").isNotNull())
        r = requests.select("request_id", "user_id", F.col(field).alias("_v"))
        return (r.join(u, "_v")
                .where(F.col("user_id").isNull() | (F.col("user_id") != F.col("conflict_user_id")))
                .select("request_id", "conflict_user_id", F.lit(field).alias("field")))
    return by("email").unionByName(by("phone")).dropDuplicates()
