"""Independent SQL (DuckDB dialect) for the shop views, used by the oracle.

The view definitions are the fixed test-plan mapping from the driver tables;
they are written as SQL here and as DataFrame code in
``storefront.sources.views``, so the two sides of every check are built
independently. ``with_views`` prefixes a query with the CTEs it uses.
"""

from __future__ import annotations

import re

VIEW_SQL: dict[str, str] = {
    "shop_users": """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 500 = 0 THEN 'admin' ELSE 'customer' END AS role, c_name AS name,
       concat('c', CAST(c_custkey AS VARCHAR), '@example.com') AS email,
       concat('+2547', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) AS phone,
       coalesce(f.first_order, TIMESTAMP '1995-01-01 00:00:00') AS created_at
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) f
  ON o_custkey = c_custkey
UNION ALL
SELECT 10000000 + s_suppkey, 'seller', s_name, concat('s', CAST(s_suppkey AS VARCHAR), '@example.com'),
       concat('+2541', lpad(CAST(s_suppkey AS VARCHAR), 8, '0')), TIMESTAMP '1995-01-01 00:00:00'
FROM supplier""",
    "shop_sellers": """
SELECT s_suppkey AS seller_id, 10000000 + s_suppkey AS user_id, s_name AS business_name,
       CAST(0 AS DECIMAL(12,2)) AS total_sales, TIMESTAMP '1995-01-01 00:00:00' AS created_at FROM supplier""",
    "shop_categories": """
SELECT CAST(category_id AS BIGINT) AS category_id, name, featured
FROM (VALUES (1,'STANDARD',true),(2,'PROMO',false),(3,'ECONOMY',true),(4,'MEDIUM',false),(5,'SMALL',true),
  (6,'LARGE',false),(7,'EMPTY',false)) AS t(category_id, name, featured)""",
    "shop_products": """
SELECT p_partkey AS product_id, p_partkey % (SELECT count(*) FROM supplier) AS seller_id,
       CAST(CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'PROMO' THEN 2 WHEN 'ECONOMY' THEN 3 WHEN 'MEDIUM' THEN 4
                   WHEN 'SMALL' THEN 5 ELSE 6 END AS BIGINT) AS category_id,
       p_name AS title, CAST(p_retailprice AS DECIMAL(10,2)) AS price,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(10,2)) - 100 AS DECIMAL(10,2)) END AS sale_price,
       CAST((p_partkey * 7) % 50 AS INT) AS stock, s.created_at, s.updated_at
FROM part LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS created_at, max(l_shipdate) AS updated_at
                     FROM lineitem GROUP BY l_partkey) s ON l_partkey = p_partkey""",
    "shop_addresses": """
SELECT c_custkey AS address_id, c_custkey AS user_id, n_name AS city,
       concat('Street ', CAST(c_custkey % 100 AS VARCHAR)) AS street,
       (c_custkey % 2 = 0) AS is_default FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "shop_orders": """
SELECT o_orderkey AS order_id, o_custkey AS user_id, o_custkey AS address_id,
       CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'processing' WHEN '2-HIGH' THEN 'shipped' WHEN '3-MEDIUM' THEN 'delivered'
            WHEN '4-NOT SPECIFIED' THEN 'pending'
            ELSE CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'cancelled' END END AS status,
       CAST(NULL AS VARCHAR) AS notes, o_orderdate AS created_at FROM orders""",
    "shop_order_items": """
SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
         l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS order_item_id,
       l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity,
       CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price, CAST(0 AS DECIMAL(10,2)) AS discount
FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "shop_payments": """
SELECT o_orderkey AS payment_id, o_orderkey AS order_id,
       CASE o_orderkey % 4 WHEN 2 THEN 'cash' WHEN 3 THEN 'card' ELSE 'mpesa' END AS method,
       CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey % 5 <> 0 END AS is_confirmed,
       CAST(NULL AS TIMESTAMP) AS confirmed_at, o_orderdate AS created_at FROM orders""",
    "shop_transactions": """
SELECT event_id AS transaction_id, event_id * 2 AS order_id, concat('ws_CO_', CAST(event_id AS VARCHAR)) AS checkout_request_id,
       concat('2547', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS phone_number, CAST(value AS DECIMAL(12,2)) AS amount,
       CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'failed'
                       WHEN 'signup' THEN 'pending' ELSE 'cancelled' END AS status,
       CASE WHEN event_type IN ('purchase', 'view') THEN '0'
            WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN '1' WHEN 1 THEN '1032' END END AS result_code,
       CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'Insufficient funds'
                                                        WHEN 1 THEN 'Cancelled by user' END END AS result_desc,
       CASE WHEN event_type IN ('purchase', 'view') THEN concat('R', CAST(event_id AS VARCHAR)) END AS mpesa_receipt_number,
       ts AS created_at, ts AS updated_at FROM events""",
    "shop_reviews": """
SELECT event_id AS review_id, user_id, event_id % (SELECT count(*) FROM part) AS product_id,
       CAST(1 + event_id % 5 AS INT) AS rating,
       CASE event_id % 11 WHEN 0 THEN 'Looks like a SCAM' WHEN 1 THEN 'fake item' WHEN 2 THEN 'Fraudulent seller'
                          WHEN 3 THEN NULL ELSE 'fine' END AS comment,
       ts AS created_at FROM events WHERE event_type = 'view'""",
    "shop_carts": """
SELECT user_id AS cart_id, CASE WHEN user_id % 4 <> 0 THEN user_id END AS user_id,
       CASE WHEN user_id % 4 = 0 THEN concat('guest_', CAST(user_id AS VARCHAR)) END AS session_id,
       CASE user_id % 3 WHEN 0 THEN 'abandoned' WHEN 1 THEN 'active' ELSE 'converted' END AS status,
       min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY events.user_id""",
    "shop_cart_items": """
SELECT min(event_id) AS cart_item_id, user_id AS cart_id, event_id % (SELECT count(*) FROM part) AS product_id,
       CAST(count(*) AS INT) AS quantity, CAST(min(900 + event_id % 100) AS DECIMAL(10,2)) AS unit_price,
       min(ts) AS added_at
FROM events WHERE event_type = 'click' GROUP BY user_id, event_id % (SELECT count(*) FROM part)""",
    "shop_offers": """
SELECT CAST(n_nationkey AS BIGINT) AS offer_id, n_name AS title, CAST(5 + n_nationkey AS DECIMAL(5,2)) AS discount_percent,
       (n_nationkey % 2 = 0) AS is_active,
       CASE n_nationkey % 3 WHEN 0 THEN TIMESTAMP '2023-12-31 00:00:00' WHEN 1 THEN TIMESTAMP '2024-06-30 00:00:00' END
         AS valid_until FROM nation""",
    "shop_product_images": """
SELECT page_id * 100000 + pos AS image_id, page_id % (SELECT count(*) FROM part) AS product_id,
       '/uploads/products' || urls[pos + 1] AS image_url, CASE WHEN pos % 3 <> 1 THEN texts[pos + 1] END AS alt_text,
       pos = page_id % 4 AS is_primary, CAST(CASE WHEN pos % 4 <> 3 THEN (pos * 7 + page_id) % 5 END AS INT) AS sort_order
FROM (SELECT page_id, urls, texts, unnest(range(len(urls))) AS pos FROM (
  SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS urls,
         regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages) found) numbered""",
    "shop_delivery_pricing": """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS rule_id, n_name AS city,
       CAST(CASE WHEN n_nationkey % 4 <> 0 THEN 1000 + 100 * n_nationkey END AS DECIMAL(10,2)) AS min_free_delivery,
       CAST(150 + 10 * n_nationkey AS DECIMAL(10,2)) AS standard_fee, n_nationkey % 5 <> 0 AS is_active,
       TIMESTAMP '1995-01-01 00:00:00' AS created_at FROM nation""",
    "shop_product_offers": """
SELECT p_partkey AS product_id, p_partkey % 25 AS offer_id FROM part WHERE p_partkey % 4 = 0""",
}

_NAME = re.compile(r"\bshop_[a-z_]+\b")


def _bigint_counts(sql: str) -> str:
    """Wrap every ``count_if(..)`` in a BIGINT cast (DuckDB's count_if is
    HUGEINT; Spark's is BIGINT)."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k] + " AS BIGINT)")
        i = k


def with_views(body: str) -> str:
    """Prefix ``body`` with a CTE for every shop view it names."""
    body = _bigint_counts(body)
    used = [n for n in VIEW_SQL if re.search(rf"\b{n}\b", body)]
    if not used:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in used)
    body = body.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def avg2(x: str) -> str:
    """SQL twin of ``storefront.functions.scalar.avg2``: exact mean rounded half
    away from zero to two places, on integer cents."""
    cents = f"sum(CAST(({x}) * 100 AS BIGINT))"
    n = f"count({x})"
    return (f"(CASE WHEN {n} > 0 THEN CAST(sign({cents}) * ((abs({cents}) * 2 + {n}) // ({n} * 2)) "
            f"AS DECIMAL(36,0)) * 0.01 END)::DECIMAL(38,2)")


def pct(part: str, whole: str) -> str:
    """SQL twin of ``scalar.pct``: part / whole * 100 rounded half up to two
    places on integers, NULL when whole is 0 (both are non-negative counts)."""
    p, w = f"CAST({part} AS BIGINT)", f"CAST({whole} AS BIGINT)"
    return (f"(CASE WHEN {w} <> 0 THEN CAST(({p} * 20000 + {w}) // ({w} * 2) AS DECIMAL(36,0)) * 0.01 END)"
            f"::DECIMAL(38,2)")


def ratio2(num: str, den: str) -> str:
    """SQL twin of ``scalar.ratio2``."""
    n, d = f"CAST({num} AS BIGINT)", f"CAST({den} AS BIGINT)"
    return (f"(CASE WHEN {d} <> 0 THEN CAST(({n} * 200 + {d}) // ({d} * 2) AS DECIMAL(36,0)) * 0.01 END)"
            f"::DECIMAL(38,2)")


def mean2(total: str, n: str) -> str:
    """SQL twin of ``scalar.mean2`` (pre-aggregated sum of cents values and count)."""
    c, k = f"CAST(({total}) * 100 AS BIGINT)", f"CAST({n} AS BIGINT)"
    return (f"(CASE WHEN {k} > 0 THEN CAST(sign({c}) * ((abs({c}) * 2 + {k}) // ({k} * 2)) AS DECIMAL(36,0)) * 0.01 END)"
            f"::DECIMAL(38,2)")
