"""Unit tests on the seed rows (hand-computed expectations) and edge rows."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from seed_data import SEED, tables_from, ts, with_rows
from storefront.functions import scalar as S
from storefront.operators import changes as C
from storefront.operators import enrich as E
from storefront.operators import metrics as M
from storefront.operators import payments as P
from storefront.operators import quality as Q
from storefront.operators import ranking as R
from storefront.operators import sellers as SL
from storefront.streaming import callbacks as CB

AS_OF = dt.datetime(2023, 10, 31, 0, 0, 0)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_top_products_units_nulls_last_and_ties(seed):
    out = R.top_products(seed, 10)
    got = rows(out, "product_id", "units_sold", "times_ordered", "revenue")
    # products 1 and 4 tie on 2 units (tie broken by id); 2 and 5 never sold: last
    assert [g[0] for g in got] == [1, 4, 3, 2, 5]
    assert got[0] == (1, 2, 2, D("85998.00"))
    assert got[3][1] is None and got[4][1] is None


def test_revenue_stats_seed_total(seed):
    r = M.revenue_stats(seed["orders"], AS_OF).first()
    assert r["total_revenue"] == D("184995.00")
    assert r["average_order_value"] == D("61665.00")


def test_cart_totals(seed):
    got = {r["cart_id"]: (r["item_count"], r["total_amount"]) for r in SL.cart_totals(seed).collect()}
    assert got[1] == (2, D("56997.00"))
    assert got[3] == (2, D("54998.00"))
    assert got[4] == (0, D("0.00"))


def test_product_ratings(seed):
    got = {r["product_id"]: (r["rating"], r["review_count"])
           for r in M.product_ratings(seed["reviews"], seed["products"]).collect()}
    assert got[1] == (D("5.00"), 1) and got[3] == (D("5.00"), 1) and got[4] == (D("4.00"), 1)
    assert got[2] == (D("0.00"), 0)


def test_avg2_half_up_exact(spark):
    df = spark.createDataFrame([(D("0.01"),), (D("0.02"),)], "x decimal(12,2)")
    assert df.agg(S.avg2("x").alias("a")).first()["a"] == D("0.02")  # 0.015 -> 0.02
    df = spark.createDataFrame([(D("-0.01"),), (D("-0.02"),)], "x decimal(12,2)")
    assert df.agg(S.avg2("x").alias("a")).first()["a"] == D("-0.02")  # half away from zero


def _fanout(spark):
    # product 1 gets a second line and a second review: the joined form double counts
    extra = with_rows(SEED,
                      order_items=[dict(order_item_id=5, order_id=2, product_id=1, quantity=3, unit_price=D("100.00"))],
                      reviews=[dict(review_id=4, user_id=3, product_id=1, rating=3, comment=None, created_at=ts(20))],
                      orders=[dict(order_id=4, user_id=3, address_id=3, total_amount=D("10.00"), status="cancelled",
                                   created_at=ts(21))])
    return tables_from(spark, extra)


def test_category_performance_default_vs_compat(spark):
    t = _fanout(spark)
    d = {r["category_id"]: r for r in R.category_performance(t).collect()}
    c = {r["category_id"]: r for r in R.category_performance(t, compat=True).collect()}
    # phones: product 1 has 3 lines (1+1+3 units) and 2 reviews (5, 3)
    assert d[1]["units_sold"] == 5 and d[1]["revenue"] == D("86298.00")
    assert d[1]["average_rating"] == D("4.00") and d[1]["review_count"] == 2
    assert c[1]["units_sold"] == 10 and c[1]["revenue"] == D("172596.00")
    assert c[1]["times_ordered"] == d[1]["times_ordered"] == 3
    assert d[5]["product_count"] == 0 and d[5]["revenue"] == D("0.00")  # empty category kept


def test_top_sellers_default_vs_compat(spark):
    t = _fanout(spark)
    d = {r["seller_id"]: r for r in R.top_sellers(t, None).collect()}
    c = {r["seller_id"]: r for r in R.top_sellers(t, None, compat=True).collect()}
    assert d[1]["total_products"] == c[1]["total_products"] == 3
    assert d[1]["total_orders"] == c[1]["total_orders"] == 3
    assert d[1]["review_count"] == c[1]["review_count"] == 2
    assert d[1]["revenue"] == D("86298.00")
    assert c[1]["revenue"] > d[1]["revenue"]


def test_low_stock_edges(spark):
    prods = [dict(product_id=10 + i, seller_id=1, category_id=1, title=f"p{s}", price=D("1.00"), stock=s)
             for i, s in enumerate((0, 1, 10, 11))]
    t = tables_from(spark, with_rows(SEED, products=prods))
    got = [r["stock"] for r in E.low_stock(t, 10).collect()]
    assert 0 not in got and 11 not in got and 1 in got and 10 in got
    assert got == sorted(got)
    assert [r["product_id"] for r in E.out_of_stock(t).collect()] == [10]


def test_pending_payments_null_excluded(spark):
    extra = with_rows(SEED, payments=[dict(payment_id=4, order_id=2, method="cash", amount=D("1.00"), is_confirmed=None)])
    t = tables_from(spark, extra)
    assert [r["payment_id"] for r in E.pending_payments(t).collect()] == [3]
    s = M.payment_stats(t["payments"]).first()
    assert (s["confirmed_payments"], s["pending_payments"], s["total_payments"]) == (2, 1, 4)


def test_flagged_reviews(spark):
    extra = with_rows(SEED, reviews=[
        dict(review_id=4, user_id=3, product_id=1, rating=5, comment="Looks like a SCAM", created_at=ts(20)),
        dict(review_id=5, user_id=3, product_id=2, rating=5, comment=None, created_at=ts(21)),
        dict(review_id=6, user_id=3, product_id=3, rating=2, comment=None, created_at=ts(22))])
    got = sorted(r["review_id"] for r in E.flagged_reviews(tables_from(spark, extra)).collect())
    assert got == [4, 6]


def test_revenue_trends_month_clamp(spark):
    orders = [dict(order_id=10, user_id=2, address_id=1, total_amount=D("10.00"), status="pending",
                   created_at=dt.datetime(2001, 6, 30, 12)),
              dict(order_id=11, user_id=2, address_id=1, total_amount=D("20.00"), status="pending",
                   created_at=dt.datetime(2001, 6, 30, 23, 59)),
              dict(order_id=12, user_id=2, address_id=1, total_amount=D("30.00"), status="failed",
                   created_at=dt.datetime(2001, 7, 5))]
    t = tables_from(spark, {"orders": orders})
    # as_of 2001-07-31 minus 1 month clamps to 2001-06-30 00:00 (time of day kept)
    got = rows(M.revenue_trends(t["orders"], "2001-07-31 00:00:00", 1), "month", "order_count", "revenue")
    assert got == [("Jun 2001", 2, D("30.00"))]
    assert S.months_back("2001-03-31 10:00:00", 1) == dt.datetime(2001, 2, 28, 10)


def test_window_edges_inclusive_vs_strict(spark):
    as_of = dt.datetime(2024, 1, 31)
    tx = [dict(transaction_id=i, order_id=1, checkout_request_id=f"c{i}", phone_number="2547", amount=D("1.00"),
               status="failed", created_at=as_of - dt.timedelta(hours=1)) for i in range(1, 3)]
    t = tables_from(spark, {"mpesa_transactions": tx})
    # M13 window is strict (> now - 1 hour): rows exactly at the edge are out
    assert P.failure_rate_alert(t["mpesa_transactions"], as_of).first()[0] == "OK"
    users = [dict(user_id=1, role="customer", name="a", email="a", created_at=as_of - dt.timedelta(days=7))]
    # A1 window is inclusive (>= now - 7 days)
    assert M.user_stats(tables_from(spark, {"users": users})["users"], as_of).first()["new_users_last_7_days"] == 1


def test_method_stats_empty_is_null(seed):
    out = {r["payment_method"]: r for r in P.method_stats(seed, "2030-01-01 00:00:00").collect()}
    assert out["M-Pesa"]["total_transactions"] == 0 and out["M-Pesa"]["success_rate"] is None


def test_phone_functions(spark):
    df = spark.createDataFrame([("0712 345 678",), ("+254712345678",), ("712345678",), ("254712345678",), ("12",)],
                               "p string")
    got = [r[0] for r in df.select(S.normalise_phone("p")).collect()]
    assert got == ["254712345678", "254712345678", "254712345678", "254712345678", "12"]
    ok = [r[0] for r in df.select(S.valid_phone("p")).collect()]
    assert ok == [False, True, False, True, False]


def test_compact_timestamp_roundtrip(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5),)], "t timestamp_ntz")
    r = df.select(S.compact_timestamp(F.col("t")).alias("c")).select(
        "c", S.parse_compact_timestamp(F.col("c")).alias("back")).first()
    assert r["c"] == 20240102030405 and r["back"] == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_image_manifest_and_ownership(spark):
    imgs = SEED["product_images"] + [dict(image_id=7, product_id=1, image_url="/x.jpg", alt_text=None,
                                          is_primary=False, sort_order=None)]
    t = tables_from(spark, with_rows({k: v for k, v in SEED.items() if k != "product_images"}, product_images=imgs))
    m = [r for r in E.image_manifest(t).orderBy("position").collect() if r["product_id"] == 1]
    assert m[0]["image_id"] == 1 and m[0]["is_primary"]
    assert [r["image_count"] for r in m] == [3, 3, 3]
    assert any(r["alt_text"] == "Product image 3" for r in m)
    req = spark.createDataFrame([(1, 4), (1, 5), (4, 5)], "image_id long, user_id long")
    acc = E.owned_images(t, req)
    assert sorted(tuple(r) for r in acc.allowed.collect()) == [(1, 4), (4, 5)]
    assert [tuple(r) for r in acc.denied.collect()] == [(1, 5)]
    ch = C.set_primary_images(t["product_images"], spark.createDataFrame([(1, 2, 1)], "seq long, image_id long, product_id long"))
    prim = {r["image_id"]: r["is_primary"] for r in ch.table.where("product_id = 1").collect()}
    assert prim == {1: False, 2: True, 7: False}


def test_patch_truthy_vs_present(seed, spark):
    ch = spark.createDataFrame([(1, 1, 0, ["stock"])], "seq long, product_id long, stock int, changed array<string>")
    truthy = C.patch(seed["products"], ch.drop("changed"), "product_id", "truthy")
    present = C.patch(seed["products"], ch, "product_id", "present", as_of=AS_OF)
    assert truthy.table.where("product_id = 1").first()["stock"] == 25  # 0 is skipped (falsy)
    r = present.table.where("product_id = 1").first()
    assert r["stock"] == 0 and r["updated_at"] == AS_OF
    unknown = spark.createDataFrame([(2, 99, 5, ["stock"])], "seq long, product_id long, stock int, changed array<string>")
    assert C.patch(seed["products"], unknown, "product_id").rejected.count() == 1


def test_patch_last_change_wins(seed, spark):
    ch = spark.createDataFrame([(2, 1, 7, ["stock"]), (1, 1, 9, ["stock"]), (3, 1, None, ["rating"])],
                               "seq long, product_id long, stock int, changed array<string>")
    ch = ch.withColumn("rating", F.lit(None).cast("decimal(3,2)"))
    r = C.patch(seed["products"], ch, "product_id").table.where("product_id = 1").first()
    assert r["stock"] == 7 and r["rating"] is None


def test_insert_rows_keys_and_duplicates(seed, spark):
    rows_ = spark.createDataFrame(
        [(1, "Phones", None), (2, "Drones", "air"), (3, "Drones", "dup"), (4, "Cameras", None)],
        "seq long, name string, description string")
    ch = C.insert_rows(seed["categories"], rows_, "categories", defaults={"featured": False})
    new = sorted((r["category_id"], r["name"]) for r in ch.affected.collect())
    assert new == [(7, "Drones"), (8, "Cameras")]
    assert sorted(r["reason"] for r in ch.rejected.collect()) == ["duplicate name", "duplicate name in batch"]
    assert ch.table.count() == 8


def test_cascade_delete(seed, spark):
    ids = spark.createDataFrame([(2,)], "product_id long")
    res = C.cascade_delete(seed, "products", ids)
    assert res.tables["products"].count() == 4
    assert res.deleted["product_images"].count() == 1
    assert [r["cart_item_id"] for r in res.deleted["cart_items"].collect()] == [4]
    assert res.deleted["product_offers"].count() == 1
    with pytest.raises(C.RestrictViolation):  # product 1 is on order lines (RESTRICT)
        C.cascade_delete(seed, "products", spark.createDataFrame([(1,), (2,)], "product_id long"))
    skip = C.cascade_delete(seed, "products", spark.createDataFrame([(1,), (2,)], "product_id long"), "skip")
    assert sorted(r["product_id"] for r in skip.deleted["products"].collect()) == [2]
    assert {r["root_id"] for r in skip.blocked.collect()} == {1}


def test_cascade_leaves_no_orphans(seed, spark):
    res = C.cascade_delete(seed, "carts", spark.createDataFrame([(3,), (4,)], "cart_id long"))
    t = seed.with_tables(**res.tables)
    keys = [k for k in Q.FOREIGN_KEYS if k[0] in ("cart_items",) and k[2] == "carts"]
    assert Q.orphans(t, keys).count() == 0
    assert res.deleted["cart_items"].count() == 2


def test_merge_categories_chain_and_reject(seed, spark):
    pairs = spark.createDataFrame([(4, 3), (3, 2), (5, 5), (9, 1)], "source_id long, target_id long")
    out, rej = C.merge_categories(seed, pairs)
    assert {r["category_id"] for r in out["categories"].collect()} == {1, 2, 5, 6}
    cats = {r["product_id"]: r["category_id"] for r in out["products"].collect()}
    assert cats[4] == 2 and cats[5] == 2 and out["products"].count() == 5
    assert sorted(r["reason"] for r in rej.collect()) == ["source equals target", "source not found"]
    loop = spark.createDataFrame([(1, 2), (2, 1)], "source_id long, target_id long")
    _, rej2 = C.merge_categories(seed, loop)
    assert sorted(r["reason"] for r in rej2.collect()) == ["cycle", "cycle"]


def test_cart_adds_fold(seed, spark):
    adds = spark.createDataFrame([(1, 1, 1, 20), (2, 1, 1, 10), (3, 1, 1, 4), (4, 1, 99, 1), (5, 2, 2, 18)],
                                 "seq long, cart_id long, product_id long, quantity int")
    res = C.apply_cart_adds(seed, adds, AS_OF)
    d = {r["seq"]: (r["accepted"], r["reason"]) for r in res.decisions.collect()}
    # product 1 stock 25, cart 1 already holds 1: 1+20 ok, +10 refused, +4 ok (=25)
    assert d == {1: (True, None), 2: (False, "Insufficient stock"), 3: (True, None),
                 4: (False, "Product not found"), 5: (True, None)}
    items = {(r["cart_id"], r["product_id"]): r for r in res.cart_items.collect()}
    assert items[(1, 1)]["quantity"] == 25 and items[(2, 2)]["quantity"] == 18
    assert items[(2, 2)]["unit_price"] == D("28999.00") and items[(2, 2)]["cart_item_id"] == 6
    touched = {r["cart_id"]: r["updated_at"] for r in res.carts.collect()}
    assert touched[1] == AS_OF and touched[2] == AS_OF and touched[3] != AS_OF


def test_confirm_payments_notes(seed, spark):
    dec = spark.createDataFrame([(3, 1, True, "paid cash"), (99, 2, True, None)],
                                "payment_id long, seq long, is_confirmed boolean, notes string")
    out, rej = C.confirm_payments(seed, dec, AS_OF)
    o = out["orders"].where("order_id = 3").first()
    assert o["status"] == "processing" and o["notes"] == " | Admin note: paid cash"
    p = out["payments"].where("payment_id = 3").first()
    assert p["is_confirmed"] and p["confirmed_at"] == AS_OF
    assert [r["payment_id"] for r in rej.collect()] == [99]


def test_sweep_and_status_update(seed, spark):
    ch = C.sweep_stale(seed["mpesa_transactions"], AS_OF)
    r = ch.table.where("transaction_id = 1").first()
    assert (r["status"], r["result_code"], r["updated_at"]) == ("failed", "TIMEOUT", AS_OF)
    up = spark.createDataFrame([("ws_CO_2", 1, "failed", None, None, "x"), ("nope", 2, "failed", None, None, None)],
                               "checkout_request_id string, seq long, status string, mpesa_receipt_number string, "
                               "result_code string, result_desc string")
    table, res = C.update_transaction_status(seed["mpesa_transactions"], up, AS_OF)
    r = table.where("transaction_id = 2").first()
    assert (r["status"], r["mpesa_receipt_number"], r["result_code"], r["result_desc"]) == ("failed", "NLJ9H2AK", "0", "x")
    assert {x["checkout_request_id"]: x["success"] for x in res.collect()} == {"ws_CO_2": True, "nope": False}


def test_register_payments_reasons(seed, spark):
    req = spark.createDataFrame([
        (1, "0712345678", D("42999.00"), 3, "c1", "m1"), (2, "12345", D("42999.00"), 3, "c2", "m2"),
        (3, "0712345678", D("0.50"), 3, "c3", "m3"), (4, "0712345678", D("10.00"), 77, "c4", "m4"),
        (5, "0712345678", D("42990.00"), 3, "c5", "m5"), (6, None, D("1.00"), 3, "c6", "m6")],
        "request_id long, phone_number string, amount decimal(12,2), order_id long, checkout_request_id string, "
        "merchant_request_id string")
    ch = C.register_payments(seed, req, AS_OF)
    reasons = {r["request_id"]: r["reason"] for r in ch.rejected.collect()}
    assert reasons == {2: "Invalid phone number format", 3: "Amount must be at least KSh 1", 4: "Order not found",
                       5: "Payment amount does not match order total",
                       6: "Phone number, amount, and order ID are required"}
    new = ch.affected.first()
    assert new["transaction_id"] == 3 and new["status"] == "pending" and new["phone_number"] == "0712345678"


def test_archive_split_partitions_input(seed):
    s = P.archive_split(seed["mpesa_transactions"], "2024-06-01 00:00:00", 90)
    assert s.archive.count() + s.keep.count() == seed["mpesa_transactions"].count()
    assert [r["transaction_id"] for r in s.archive.collect()] == [2]


def test_system_alerts(seed):
    got = {(r["type"], r["category"]): (r["message"], r["count"]) for r in P.system_alerts(seed, "2024-01-01").collect()}
    assert got[("warning", "payments")] == ("1 payments are pending confirmation", 1)
    assert got[("warning", "offers")] == ("2 active offers have expired", 2)
    assert ("error", "inventory") not in got


def test_account_conflicts(seed, spark):
    req = spark.createDataFrame([(1, None, "john@example.com", "+254000"), (2, 2, "john@example.com", "+254722333444"),
                                 (3, None, "new@x.com", "+254733444555")],
                                "request_id long, user_id long, email string, phone string")
    got = sorted(tuple(r) for r in Q.account_conflicts(seed["users"], req).collect())
    assert got == [(1, 2, "email"), (2, 3, "phone"), (3, 4, "phone")]


def test_check_rows_and_duplicates(spark):
    prods = [dict(product_id=1, seller_id=1, category_id=1, title="x", price=D("-1.00"), stock=-1),
             dict(product_id=1, seller_id=1, category_id=1, title="y", price=D("1.00"), sale_price=None, stock=0)]
    t = tables_from(spark, {"products": prods})
    chk = Q.check_table(t, "products")
    assert chk.valid.count() == 1
    assert chk.rejects.first()["broken_rules"] == ["price_positive", "stock_non_negative"]
    d = Q.duplicates(t, ["products"]).first()
    assert (d["key_columns"], d["key_value"], d["row_count"]) == ("product_id", "1", 2)


def _callback(code, cid="ws_CO_1", desc="done", items=True):
    meta = {"Item": [{"Name": "Amount", "Value": 1.00}, {"Name": "MpesaReceiptNumber", "Value": "R1"},
                     {"Name": "TransactionDate", "Value": 20240130120000},
                     {"Name": "PhoneNumber", "Value": 254711222333}]} if items else None
    cb = {"MerchantRequestID": "m", "CheckoutRequestID": cid, "ResultCode": code, "ResultDesc": desc}
    if meta:
        cb["CallbackMetadata"] = meta
    return json.dumps({"Body": {"stkCallback": cb}})


def test_callbacks_parse_route_apply(seed, spark):
    raw = spark.createDataFrame([(1, _callback(1032, desc="cancelled", items=False)), (2, _callback("0")),
                                 (3, _callback(0, cid="unknown")), (4, "{not json")], "seq long, value string")
    parsed = CB.parse_callbacks(raw, seq="seq")
    assert [r["seq"] for r in parsed.dead.collect()] == [4]
    good = {r["seq"]: r for r in parsed.good.collect()}
    assert good[2]["success"] and good[3]["success"] and not good[1]["success"]  # "0" and 0 both succeed
    assert good[2]["callback_amount"] == D("1.00") and good[2]["transaction_date"] == 20240130120000
    routed = CB.route_unknown(parsed.good, seed["mpesa_transactions"])
    assert [r["checkout_request_id"] for r in routed.dead.collect()] == ["unknown"]
    new = CB.apply_callbacks(seed, routed.good, AS_OF)  # seq 2 (success) is the latest for ws_CO_1
    tx = new["mpesa_transactions"].where("transaction_id = 1").first()
    assert (tx["status"], tx["mpesa_receipt_number"]) == ("completed", "R1")
    pay = new["payments"].where("order_id = 3").first()
    assert pay["is_confirmed"] and pay["mpesa_code"] == "R1" and pay["confirmed_at"] == AS_OF
    assert new["orders"].where("order_id = 3").first()["status"] == "processing"
    twice = CB.apply_callbacks({**dict(seed.items()), **new}, routed.good, AS_OF)
    assert sorted(map(tuple, twice["orders"].collect())) == sorted(map(tuple, new["orders"].collect()))


def test_callback_failure_note(seed, spark):
    raw = spark.createDataFrame([(1, _callback("1032", desc="Request cancelled by user", items=False))],
                                "seq long, value string")
    new = CB.apply_callbacks(seed, CB.parse_callbacks(raw, seq="seq").good, AS_OF)
    o = new["orders"].where("order_id = 3").first()
    assert o["status"] == "failed" and o["notes"] == " | Payment failed: Request cancelled by user"
    tx = new["mpesa_transactions"].where("transaction_id = 1").first()
    assert (tx["status"], tx["result_code"]) == ("failed", "1032")


def test_table_functions(seed, spark):
    P.register_table_functions(spark, seed["mpesa_transactions"], "2023-10-18 12:00:00", view="seed_transactions")
    r = spark.sql("SELECT * FROM count_pending_transactions()").first()
    assert r["pending_count"] == 1 and r["oldest_pending_age_seconds"] == D("86400.000000")
    d = spark.sql("SELECT * FROM get_transaction_details(2)").first()
    assert d["transaction_id"] == 2 and d["status"] == "completed"


def test_snapshot_publish_and_read(seed, spark, tmp_path):
    from storefront.sources.sinks import read_snapshot, write_snapshot, write_archive
    root = str(tmp_path / "snap")
    write_snapshot({"orders": seed["orders"], "payments": seed["payments"]}, root, 0)
    out, _ = C.confirm_payments(seed, spark.createDataFrame([(3, 1, False, None)],
                                                           "payment_id long, seq long, is_confirmed boolean, notes string"),
                                AS_OF)
    write_snapshot(out, root, 1)
    with pytest.raises(Exception):
        write_snapshot(out, root, 1)  # a published version is never replaced
    snap = read_snapshot(spark, root)
    assert snap["orders"].where("order_id = 3").first()["status"] == "failed"
    for _ in range(2):  # a rerun of a batch replaces it
        write_archive(seed["mpesa_transactions"], str(tmp_path / "arch"), 7)
    stored = spark.read.parquet(str(tmp_path / "arch"))
    assert stored.select("archive_month").distinct().count() == 1 and stored.count() == seed["mpesa_transactions"].count()


def test_set_and_clear_cart_quantities(seed, spark):
    sets = spark.createDataFrame([(1, 1, 30), (2, 2, 5), (3, 3, 0), (4, 99, 1)],
                                 "seq long, cart_item_id long, quantity int")
    res = C.set_cart_quantities(seed, sets, AS_OF)
    d = {r["cart_item_id"]: r["reason"] for r in res.decisions.collect()}
    assert d == {1: "Insufficient stock", 2: None, 3: "Quantity must be positive", 99: "Cart item not found"}
    q = {r["cart_item_id"]: r["quantity"] for r in res.cart_items.collect()}
    assert q[1] == 1 and q[2] == 5
    cleared = C.clear_carts(seed, spark.createDataFrame([(1,)], "cart_id long"), AS_OF)
    assert sorted(r["cart_item_id"] for r in cleared.cart_items.collect()) == [3, 4, 5]
    assert cleared.carts.where("cart_id = 1").first()["updated_at"] == AS_OF


def test_claim_and_seller_status(seed, spark):
    ch = C.claim_carts(seed, spark.createDataFrame([("guest_session_abc123", 3, 1), ("nope", 2, 2)],
                                                            "session_id string, user_id long, seq long"))
    r = ch.table.where("cart_id = 3").first()
    assert r["user_id"] == 3 and r["session_id"] is None
    assert [x["session_id"] for x in ch.rejected.collect()] == ["nope"]
    acts = spark.createDataFrame([(1, 1, "suspend"), (2, 2, "approve"), (3, 9, "approve"), (4, 2, "ban")],
                                 "seq long, seller_id long, action string")
    res = C.set_seller_status(seed, acts, AS_OF)
    roles = {r["user_id"]: r["role"] for r in res.table.collect()}
    assert roles[4] == "guest" and roles[5] == "seller"
    assert sorted(r["reason"] for r in res.rejected.collect()) == ["invalid action", "seller not found"]


def test_bulk_update_and_delete(seed, spark):
    ids = spark.createDataFrame([(1,), (3,), (42,)], "order_id long")
    ch = C.bulk_update(seed["orders"], ids, {"status": "shipped"}, "order_id", as_of=AS_OF)
    assert sorted(r["order_id"] for r in ch.affected.collect()) == [1, 3]
    assert [r["order_id"] for r in ch.rejected.collect()] == [42]
    d = C.bulk_delete(seed["reviews"], spark.createDataFrame([(2,), (7,)], "review_id long"), "review_id")
    assert d.table.count() == 2 and [r["review_id"] for r in d.rejected.collect()] == [7]


def test_apply_reviews(seed, spark):
    ch = spark.createDataFrame([
        ("create", 1, None, 3, 1, 1, "meh"),        # new review by user 3 on product 1
        ("create", 2, None, 2, 1, 4, "again"),      # user 2 already reviewed product 1
        ("update", 3, 2, 3, None, 2, None),         # author updates rating of review 2
        ("delete", 4, 3, 3, None, None, None),      # not the author of review 3
        ("delete", 5, 3, 2, None, None, None)],     # author deletes review 3
        "op string, seq long, review_id long, user_id long, product_id long, rating int, comment string")
    res = C.apply_reviews(seed, ch, AS_OF)
    ids = {r["review_id"]: (r["rating"], r["comment"]) for r in res.reviews.collect()}
    assert 3 not in ids and ids[2] == (2, "Good sound quality but could be more comfortable") and ids[4] == (1, "meh")
    p = {r["product_id"]: (r["rating"], r["review_count"]) for r in res.products.collect()}
    assert p[1] == (D("3.00"), 2) and p[3] == (D("0.00"), 0) and p[4] == (D("2.00"), 1)
    assert p[2] == (D("4.20"), 15)  # untouched product keeps its stored values
    assert sorted(r["reason"] for r in res.rejected.collect()) == ["duplicate user_id,product_id", "not the author"]


def test_callback_stream_two_batches_merge_on_read(seed, spark, tmp_path):
    import time as _time

    from storefront.sources.sinks import compact, published_changes, read_current
    src = tmp_path / "in"
    for i, desc in enumerate(("first try failed", "second try failed"), start=1):
        spark.createDataFrame([(i, _callback("1", desc=desc, items=False))], "seq long, value string") \
            .coalesce(1).write.json(str(src / f"f{i}"))
        _time.sleep(1.1)  # distinct modification times keep the file order
    root = str(tmp_path / "state")
    CB.ingest_callbacks(spark, str(src / "*"), seed, root, AS_OF, str(tmp_path / "ckpt"), max_files_per_trigger=1)
    pub = published_changes(spark, root)
    assert sorted(v for v, _ in pub["orders"]) == [0, 1]  # one change set per batch
    cur = read_current(spark, {k: seed[k] for k in CB.CALLBACK_KEYS}, root, CB.CALLBACK_KEYS)
    o = cur["orders"].where("order_id = 3").first()
    assert o["notes"] == " | Payment failed: first try failed | Payment failed: second try failed"
    assert cur["orders"].count() == 3 and cur["mpesa_transactions"].count() == 2
    tx = cur["mpesa_transactions"].where("transaction_id = 1").first()
    assert (tx["status"], tx["result_desc"]) == ("failed", "second try failed")
    paths = compact(spark, {k: seed[k] for k in CB.CALLBACK_KEYS}, root, CB.CALLBACK_KEYS, str(tmp_path / "base2"))
    assert spark.read.parquet(paths["orders"]).where("order_id = 3").first()["notes"] == o["notes"]


def test_exclude_status_option(spark):
    t = _fanout(spark)  # order 4 is cancelled; add a line on it
    extra = with_rows(SEED, orders=[dict(order_id=4, user_id=3, address_id=3, total_amount=D("10.00"),
                                          status="cancelled", created_at=ts(21))],
                      order_items=[dict(order_item_id=9, order_id=4, product_id=2, quantity=5, unit_price=D("1.00"))])
    t = tables_from(spark, extra)
    all_ = {r["product_id"]: r["units_sold"] for r in R.top_products(t, None).collect()}
    ok = {r["product_id"]: r["units_sold"] for r in R.top_products(t, None, exclude_status=("cancelled", "failed")).collect()}
    assert all_[2] == 5 and ok[2] is None
    c = {r["category_id"]: r["units_sold"] for r in R.category_performance(t, exclude_status=("cancelled",)).collect()}
    assert c[1] == 2
    s_all = {r["seller_id"]: r["total_orders"] for r in SL.seller_order_stats(t).collect()}
    s_ok = {r["seller_id"]: r["total_orders"] for r in SL.seller_order_stats(t, exclude_status=("cancelled",)).collect()}
    assert s_all[1] == s_ok[1] + 1


def test_insert_rows_without_seq(seed, spark):
    rows_ = spark.createDataFrame([("Drones",), ("Drones",), ("Phones",)], "name string")
    ch = C.insert_rows(seed["categories"], rows_, "categories", seq=None)
    assert [r["name"] for r in ch.affected.collect()] == ["Drones"]
    assert ch.rejected.count() == 2
