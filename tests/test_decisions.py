"""Changes decided in order, refused changes that touch nothing, exact means."""

from __future__ import annotations

import itertools
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from storefront.functions import scalar as S
from storefront.operators import changes as C
from storefront.operators import quality as Q

AS_OF = "2024-06-01 00:00:00"
REVIEWS = "op string, seq long, review_id long, user_id long, product_id long, rating int, comment string"


def _products(res):
    return {r.product_id: (r.rating, r.review_count, r.updated_at) for r in res.products.collect()}


def test_refused_review_changes_touch_nothing(seed, spark):
    before = {r.product_id: (r.rating, r.review_count, r.updated_at) for r in seed["products"].collect()}
    ch = spark.createDataFrame([("create", 1, None, 2, 4, 9, "bad rating"), ("create", 2, None, 999, 5, 4, "unknown user"),
                                ("update", 3, 2, 3, None, 9, None), ("update", 4, 77, 3, None, 2, None), ("merge", 5, 2, 3, 4, 2, None),
                                (None, 6, 2, 3, 4, 2, None)], REVIEWS)
    res = C.apply_reviews(seed, ch, AS_OF)
    assert _products(res) == before
    assert sorted((r.seq, r.reason) for r in res.rejected.collect()) == [
        (1, "rating_range"), (2, "missing users"), (3, "rating_range"), (4, "review not found"), (5, "unknown op"), (6, "unknown op")]
    assert sorted(map(str, res.reviews.collect())) == sorted(map(str, seed["reviews"].select(*res.reviews.columns).collect()))


def test_forbidden_status_updates_change_nothing(seed, spark):
    tx = seed["mpesa_transactions"]
    up = spark.createDataFrame([("ws_CO_2", 1, "bogus", None, None, "x"), ("ws_CO_2", 2, "failed", None, "1" * 20, None),
                                ("ws_CO_2", 3, "failed", "R" * 60, None, None), ("ws_CO_2", 4, "cancelled", None, None, "y"), ("nope", 5, "bogus", None, None, None)],
                               "checkout_request_id string, seq long, status string, mpesa_receipt_number string, result_code string, result_desc string")
    table, results = C.update_transaction_status(tx, up, AS_OF)
    r = table.where("transaction_id = 2").first()
    assert (r.status, r.result_code, r.result_desc) == ("cancelled", "0", "y")
    assert {x.seq: (x.success, x.message) for x in results.collect()} == {
        1: (False, "Transaction update refused: status_allowed"), 2: (False, "Transaction update refused: result_code_max_length_10"),
        3: (False, "Transaction update refused: mpesa_receipt_number_max_length_50"), 4: (True, "Transaction updated successfully"),
        5: (False, "Transaction not found")}


def test_claims_need_a_known_user_and_a_guest_cart(seed, spark):
    claims = spark.createDataFrame([("guest_session_abc123", 888888, 1), ("guest_session_abc123", None, 2), ("guest_session_abc123", 2, 3),
                                    ("nope", 2, 4), (None, 2, 5)], "session_id string, user_id long, seq long")
    ch = C.claim_carts(seed, claims, AS_OF)
    assert {r.seq: r.reason for r in ch.rejected.collect()} == {1: "missing users", 2: "user_id is required", 4: "Cart not found", 5: "Cart not found"}
    assert [(r.cart_id, r.user_id, r.session_id) for r in ch.affected.collect()] == [(3, 2, None)]
    assert ch.table.count() == seed["carts"].count()


def test_changes_of_a_row_are_decided_in_order(seed, spark):
    """One statement after the other: what is valid at its turn stays."""
    cart = seed["carts"].where("user_id IS NOT NULL").first()
    ch = spark.createDataFrame([
        (4, cart.cart_id, "abandoned", None, None, ["status"]), (5, cart.cart_id, None, None, "s1", ["session_id"]),
        (6, cart.cart_id, None, None, "s2", ["user_id", "session_id"]), (7, cart.cart_id, None, None, "s3", ["session_id"]),
        (8, cart.cart_id, None, 1, None, ["user_id"]), (9, 4242, None, None, None, ["session_id"]), (10, cart.cart_id, "bogus", None, None, ["status"])],
        "seq long, cart_id long, status string, user_id long, session_id string, changed array<string>")
    res = C.patch(seed["carts"], ch, "cart_id", name="carts")
    r = res.table.where(F.col("cart_id") == cart.cart_id).first()
    assert (r.status, r.user_id, r.session_id) == ("abandoned", None, "s3")
    assert {x.seq: x.reason for x in res.rejected.collect()} == {5: "cart_owner", 8: "cart_owner", 9: "not found", 10: "status_allowed"}


def test_many_changes_of_one_row(seed, spark):
    """A key with thousands of changes passes through one bounded fold."""
    cart = seed["carts"].where("user_id IS NOT NULL").first()
    n = 5000
    ch = spark.range(n).select(F.col("id").alias("seq"), F.lit(cart.cart_id).alias("cart_id"),
                               F.when(F.col("id") % 2 == 0, F.lit("s")).alias("session_id"), F.lit(None).cast("long").alias("user_id"),
                               F.when(F.col("id") == n - 1, F.array(F.lit("user_id"), F.lit("session_id"))).otherwise(F.array(F.lit("session_id"))).alias("changed"))
    res = C.patch(seed["carts"], ch, "cart_id", name="carts")
    # Every second change asks for a session beside the user; the last one would leave the cart without an owner.
    assert res.rejected.count() == n // 2 + 1 and {r.reason for r in res.rejected.select("reason").distinct().collect()} == {"cart_owner"}


@pytest.mark.parametrize("table", sorted(Q.ROW_RULES))
def test_row_rules_agree_with_their_sql(spark, table):
    for rule, (columns, holds) in Q.ROW_RULES[table].items():
        rows = [dict(zip(columns, v)) for v in itertools.product((None, "1"), repeat=len(columns))]
        df = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))
        got = df.select(*columns, F.expr(dict(Q.CHECKS[table])[rule]).alias("ok")).collect()
        assert all(bool(r.ok) == holds({c: r[c] for c in columns}) for r in got)


def test_an_add_to_a_product_without_stock_figure_has_a_reason(seed, spark):
    products = seed["products"].withColumn("stock", F.when(F.col("product_id") != 1, F.col("stock")))
    adds = spark.createDataFrame([(1, 1, 1, 2)], "seq long, cart_id long, product_id long, quantity int")
    d = C.apply_cart_adds(seed.with_tables(products=products), adds, AS_OF).decisions.first()
    assert (d.accepted, d.reason) == (False, "Insufficient stock")


def test_means_stay_exact_beyond_64_bits(spark):
    big = D("9999999999999.99")
    df = spark.range(20000).select(F.lit(big).cast("decimal(15,2)").alias("x"))
    wide = df.agg(S.avg2("x").alias("m")).first().m
    assert wide == big
    assert df.agg(F.sum("x").alias("s"), F.count("x").alias("n")).select(S.mean2(F.col("s"), F.col("n")).alias("m")).first().m == big
    mixed = spark.createDataFrame([(D("-0.01"),), (D("-0.02"),), (None,)], "x decimal(10,2)")
    assert mixed.agg(S.avg2("x").alias("m")).first().m == D("-0.02")  # -0.015, half away from zero


def test_specs_of_malformed_text(spark):
    texts = ['{"a": 1, "b": "x"}', "{}", '{"a": "many"}', '{"a": 1', "[1]", "7", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string")
    got = {r.i: (r.m, r.a, r.w) for r in df.select("i", S.specs_map("s").alias("m"), S.spec_value("s", "a", "int").alias("a"),
                                                  S.specs_with(S.specs_map("s"), {"b": "x"}).alias("w")).collect()}
    assert got == {0: ({"a": "1", "b": "x"}, 1, True), 1: ({}, None, False), 2: ({"a": "many"}, None, False),
                   **{i: (None, None, False) for i in range(3, 8)}}
