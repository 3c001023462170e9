"""Writes keep the shop's constraints and decide requests in order."""

from __future__ import annotations

import datetime as dt
import io
from contextlib import redirect_stdout
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from seed_data import tables_from

from storefront.operators import changes as C
from storefront.operators.ranking import category_performance, top_sellers
from storefront.sources import sinks
from storefront.sources.views import shop_views

AS_OF = dt.datetime(2023, 10, 31)
REVIEWS = "op string, seq long, review_id long, user_id long, product_id long, rating int, comment string"


def test_patch_refuses_forbidden_values(seed, spark):
    ch = spark.createDataFrame([(1, 1, -5, ["stock"]), (1, 2, 7, ["stock"]), (2, 3, -1, ["stock"]), (99, 4, 1, ["stock"])],
                               "product_id long, seq long, stock int, changed array<string>")
    old = {r.product_id: r.stock for r in seed["products"].collect()}
    res = C.patch(seed["products"], ch, "product_id", name="products", as_of=AS_OF)
    got = {r.product_id: r.stock for r in res.table.collect()}
    assert got == {**old, 1: 7}
    assert sorted((r.seq, r.reason) for r in res.rejected.collect()) == [
        (1, "stock_non_negative"), (3, "stock_non_negative"), (4, "not found")]


def test_patch_checks_rules_over_several_columns(seed, spark):
    ch = spark.createDataFrame([(1, 1, "guest_x", ["session_id"])], "cart_id long, seq long, session_id string, changed array<string>")
    res = C.patch(seed["carts"], ch, "cart_id", name="carts", as_of=AS_OF)
    assert res.table.exceptAll(seed["carts"]).isEmpty() and res.affected.isEmpty()
    assert [r.reason for r in res.rejected.collect()] == ["cart_owner"]


def test_bulk_update_refuses_forbidden_values(seed, spark):
    ids = spark.createDataFrame([(1,), (77,)], "product_id long")
    res = C.bulk_update(seed["products"], ids, {"price": -1}, "product_id", name="products")
    assert res.table.drop("specs").exceptAll(seed["products"].drop("specs")).isEmpty()
    assert sorted((r.product_id, r.reason) for r in res.rejected.collect()) == [(1, "price_positive"), (77, "not found")]


def test_inserts_need_their_parents(seed, spark):
    rows = spark.createDataFrame([(1, 999999, 1, 5), (2, 1, 888888, 5)], "seq long, user_id long, product_id long, rating int")
    res = C.insert_rows(seed["reviews"], rows, "reviews", parents=seed)
    assert sorted((r.seq, r.reason) for r in res.rejected.collect()) == [(1, "missing users"), (2, "missing products")]
    adds = spark.createDataFrame([(1, 777777, 1, 1)], "seq long, cart_id long, product_id long, quantity int")
    assert [r.reason for r in C.apply_cart_adds(seed, adds, AS_OF).decisions.collect()] == ["Cart not found"]


def test_last_valid_quantity_stands(seed, spark):
    sets = spark.createDataFrame([(1, 2, 2), (2, 2, 100000)], "seq long, cart_item_id long, quantity int")
    res = C.set_cart_quantities(seed, sets, AS_OF)
    assert {r.seq: r.reason for r in res.decisions.collect()} == {1: None, 2: "Insufficient stock"}
    assert res.cart_items.where("cart_item_id = 2").first().quantity == 2


def test_the_insert_of_reviews_reads_written_rows(seed, spark, monkeypatch):
    """The insert reads its rows several times in one stage: without the joins that decide them."""
    seen = []
    insert = C.insert_rows
    monkeypatch.setattr(C, "insert_rows", lambda base, rows, *a, **kw: (seen.append(rows), insert(base, rows, *a, **kw))[1])
    r = seed["reviews"].where("review_id = 3").first()
    ch = spark.createDataFrame([("create", 1, None, r.user_id, r.product_id, 2, None), ("create", 2, None, -1, r.product_id, 2, None)], REVIEWS)
    res = C.apply_reviews(seed, ch, AS_OF)
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert {x.seq for x in res.rejected.collect()} == {1, 2} and res.reviews.count() == seed["reviews"].count()


def test_reviews_follow_seq(seed, spark):
    r = seed["reviews"].where("review_id = 3").first()
    ch = spark.createDataFrame([
        ("create", 1, None, r.user_id, r.product_id, 2, "too early"), ("delete", 2, 3, r.user_id, None, None, None),
        ("update", 3, 3, r.user_id, None, 4, None), ("create", 4, None, r.user_id, r.product_id, 5, "again"),
        ("create", 5, None, r.user_id, r.product_id, 1, "twice"), ("update", 6, 2, 3, None, 9, None)], REVIEWS)
    res = C.apply_reviews(seed, ch, AS_OF)
    pair = res.reviews.where((F.col("user_id") == r.user_id) & (F.col("product_id") == r.product_id)).collect()
    assert [(x.review_id, x.rating, x.comment) for x in pair] == [(4, 5, "again")]
    assert sorted((x.seq, x.reason) for x in res.rejected.collect()) == [
        (1, "duplicate user_id,product_id"), (3, "review not found"), (5, "duplicate user_id,product_id in batch"), (6, "rating_range")]


def test_a_checkout_id_is_registered_once(seed, spark):
    req = spark.createDataFrame([(1, "0712345678", D("42999.00"), 3, "X1", "m1"), (2, "0712345678", D("42999.00"), 3, "X1", "m2")],
                                "request_id long, phone_number string, amount decimal(12,2), order_id long, "
                                "checkout_request_id string, merchant_request_id string")
    res = C.register_payments(seed, req, AS_OF)
    assert res.affected.count() == 1
    assert [(r.request_id, r.reason) for r in res.rejected.collect()] == [(2, "duplicate checkout_request_id in batch")]


def test_confirmations_need_a_value_and_keep_every_note(seed, spark):
    dec = spark.createDataFrame([(3, 1, True, "first"), (3, 2, None, "lost"), (3, 3, False, "second")],
                                "payment_id long, seq long, is_confirmed boolean, notes string")
    out, rej = C.confirm_payments(seed, dec, AS_OF)
    o = out["orders"].where("order_id = 3").first()
    assert (o.status, o.notes) == ("failed", " | Admin note: first | Admin note: second")
    assert [(r.seq, r.reason) for r in rej.collect()] == [(2, "is_confirmed is required")]
    by = C.confirm_payments_by_order(seed, spark.createDataFrame([(3, True, 1), (99, True, 2)], "order_id long, is_confirmed boolean, seq long"), AS_OF)
    p = by.table.where("order_id = 3").first()
    assert p.is_confirmed and p.confirmed_at == AS_OF and [r.reason for r in by.rejected.collect()] == ["payment not found"]


def test_a_removed_line_touches_its_cart(seed, spark):
    item = seed["cart_items"].where("cart_item_id = 1").first()
    res = C.remove_cart_items(seed, spark.createDataFrame([(1,), (99,)], "cart_item_id long"), AS_OF)
    assert res.cart_items.where("cart_item_id = 1").isEmpty()
    assert res.carts.where(F.col("cart_id") == item.cart_id).first().updated_at == AS_OF
    assert {r.cart_item_id: r.reason for r in res.decisions.collect()} == {1: None, 99: "Cart item not found"}


def test_long_category_chains_and_touch(spark):
    n = 200
    cats = [dict(category_id=i, name=f"c{i}", featured=True) for i in range(n + 1)]
    prods = [dict(product_id=i, seller_id=1, category_id=i, title="x", price=D("1.00"), stock=1) for i in (0, 7, n)]
    t = tables_from(spark, {"categories": cats, "products": prods})
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n)], "source_id long, target_id long")
    out, rej = C.merge_categories(t, pairs, AS_OF)
    assert rej.isEmpty()
    assert {(r.product_id, r.category_id, r.updated_at) for r in out["products"].collect()} == {
        (0, n, AS_OF), (7, n, AS_OF), (n, n, None)}


def test_skipping_repeats_until_nothing_is_blocked(seed, spark):
    # Order 1 blocks user 1; sparing user 1 spares cart 1, which an order of user 2 names.
    users = [dict(user_id=i, role="customer", name=f"u{i}", email=f"u{i}@x") for i in (1, 2)]
    carts = [dict(cart_id=1, user_id=1, status="active"), dict(cart_id=2, user_id=2, status="active")]
    orders = [dict(order_id=1, user_id=1, address_id=1, total_amount=D("1.00"), status="pending", cart_id=2)]
    t = tables_from(spark, {"users": users, "carts": carts, "orders": orders})
    keys = (("carts", "user_id", "users", "user_id", "cascade"), ("orders", "user_id", "users", "user_id", "cascade"),
            ("orders", "cart_id", "carts", "cart_id", "restrict"))
    res = C.cascade_delete(t, "users", spark.createDataFrame([(1,), (2,)], "user_id long"), "skip", keys)
    assert {r.user_id for r in res.deleted["users"].collect()} == {1, 2}
    res = C.cascade_delete(t, "users", spark.createDataFrame([(2,)], "user_id long"), "skip", keys)
    assert res.deleted["users"].isEmpty() and {r.root_id for r in res.blocked.collect()} == {2}


def test_the_cart_fold_runs_in_a_fixed_number_of_jobs(spark):
    adds = [(i, 1, 1, 100 - i) for i in range(90)]  # descending: one acceptance at a time
    a = spark.createDataFrame(adds, "seq long, cart_id long, product_id long, quantity long")
    cap = spark.createDataFrame([(1, 1, 150)], "cart_id long, product_id long, cap long")
    got = {r.seq: r.accepted for r in C.cart_add_decisions(a, cap).collect()}
    left = 150
    for seq, _, _, q in adds:
        assert got[seq] == (q <= left)
        left -= q if q <= left else 0


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_compat_rankings_do_not_multiply_rows(spark):
    t = shop_views(spark, "/root/testdata/sf0.001")
    assert "Expand" not in _plan(category_performance(t, compat=True))
    p = _plan(top_sellers(t, compat=True))
    assert p.count("events.parquet") <= 2 and "rating" in p


def test_views_see_new_files(spark, tmp_path):
    import shutil
    for name in ("orders", "customer"):
        (tmp_path / f"{name}.parquet").mkdir()
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet" / "a.parquet")
    before = shop_views(spark, str(tmp_path))["orders"].count()
    shutil.copy(tmp_path / "orders.parquet" / "a.parquet", tmp_path / "orders.parquet" / "b.parquet")
    assert shop_views(spark, str(tmp_path))["orders"].count() == 2 * before


def test_only_a_missing_path_means_nothing_published(spark, tmp_path):
    assert sinks.newest_manifest(spark, str(tmp_path / "none")) is None
    with pytest.raises(Exception):
        sinks.newest_manifest(spark, "nosuchscheme://x/y")


def test_compaction_ends_the_log(seed, spark, tmp_path):
    root, key = str(tmp_path / "s"), {"orders": "order_id"}
    base = {"orders": seed["orders"]}
    sinks.write_snapshot({"orders": seed["orders"].where("order_id = 1").withColumn("status", F.lit("shipped"))}, root, 0)
    sinks.compact(spark, base, root, key, str(tmp_path / "b"))
    assert sinks.published_changes(spark, root) == {} and sinks.is_published(spark, root, 0)
    sinks.write_snapshot({"orders": seed["orders"].where("order_id = 3").withColumn("status", F.lit("delivered"))}, root, 1)
    got = {r.order_id: r.status for r in sinks.read_current(spark, base, root, key)["orders"].collect()}
    assert got[1] == "shipped" and got[3] == "delivered" and len(got) == 3
    assert len(sinks.published_changes(spark, root)["orders"]) == 1


def test_a_replayed_rating_batch_is_skipped(seed, spark, tmp_path):
    from storefront.streaming import windows as W
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 5), (1, 4), (2, 3)], "product_id long, rating int").write.parquet(src)
    root = str(tmp_path / "state")
    stream = spark.readStream.schema("product_id long, rating int").parquet(src)
    for i in (1, 2):  # the second run has lost its checkpoint and sends batch 0 again
        W.ingest_ratings(stream, seed["products"], root, str(tmp_path / f"c{i}"), AS_OF)
    got = sinks.read_current(spark, {"products": seed["products"]}, root, {"products": "product_id"})["products"]
    assert {(r.product_id, r.rating, r.review_count) for r in got.where("product_id < 3").collect()} == {(1, D("4.50"), 2), (2, D("3.00"), 1)}


