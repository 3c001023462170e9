"""Property tests: operators against plain-Python models on random inputs."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from seed_data import tables_from
from storefront.operators import changes as C
from storefront.operators import payments as P

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

adds_st = st.lists(st.tuples(st.integers(1, 3), st.integers(1, 2), st.integers(1, 9)), min_size=1, max_size=25)
stock_st = st.tuples(st.integers(0, 20), st.integers(0, 20))
have_st = st.dictionaries(st.tuples(st.integers(1, 3), st.integers(1, 2)), st.integers(1, 6), max_size=3)


def python_fold(adds, stock, have):
    cur = dict(have)
    out = {}
    for seq, (cart, prod, q) in enumerate(adds, start=1):
        c = cur.get((cart, prod), 0)
        if stock[prod] >= c + q:
            cur[(cart, prod)] = c + q
            out[seq] = True
        else:
            out[seq] = False
    return out, cur


@SETTINGS
@given(adds=adds_st, stocks=stock_st, have=have_st)
def test_cart_adds_equal_sequential_fold(spark, adds, stocks, have):
    stock = {1: stocks[0], 2: stocks[1]}
    products = [dict(product_id=p, seller_id=1, category_id=1, title=f"p{p}", price=D("5.00"), stock=s)
                for p, s in stock.items()]
    items = [dict(cart_item_id=i, cart_id=c, product_id=p, quantity=q, unit_price=D("1.00"))
             for i, ((c, p), q) in enumerate(sorted(have.items()), start=1)]
    carts = [dict(cart_id=c, user_id=c, status="active") for c in (1, 2, 3)]
    t = tables_from(spark, {"products": products, "cart_items": items, "carts": carts})
    df = spark.createDataFrame([(i, c, p, q) for i, (c, p, q) in enumerate(adds, start=1)],
                               "seq long, cart_id long, product_id long, quantity int")
    res = C.apply_cart_adds(t, df, dt.datetime(2024, 1, 1))
    want, cur = python_fold(adds, stock, have)
    got = {r["seq"]: r["accepted"] for r in res.decisions.collect()}
    assert got == want
    final = {(r["cart_id"], r["product_id"]): r["quantity"] for r in res.cart_items.collect()}
    assert final == cur
    assert all(final[k] <= stock[k[1]] or final[k] == have.get(k) for k in final)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 200), st.sampled_from(["pending", "completed", "failed", "cancelled", None])),
                min_size=1, max_size=30), st.integers(0, 100))
def test_archive_split_is_a_partition(spark, rows, days):
    base = dt.datetime(2024, 6, 1)
    tx = [dict(transaction_id=i, order_id=1, checkout_request_id=f"c{i}", phone_number="1", amount=D("1.00"),
               status=s, created_at=base - dt.timedelta(days=d)) for i, (d, s) in enumerate(rows)]
    t = tables_from(spark, {"mpesa_transactions": tx})
    s = P.archive_split(t["mpesa_transactions"], base, days)
    a = {r["transaction_id"] for r in s.archive.collect()}
    k = {r["transaction_id"] for r in s.keep.collect()}
    assert a.isdisjoint(k) and a | k == set(range(len(rows)))
    for i, (d, st_) in enumerate(rows):
        assert (i in a) == (d > days and st_ in ("completed", "failed", "cancelled"))


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 6)), min_size=1, max_size=6))
def test_merge_categories_keeps_every_product(spark, pairs):
    cats = [dict(category_id=i, name=f"c{i}", featured=True) for i in range(1, 7)]
    prods = [dict(product_id=i, seller_id=1, category_id=1 + i % 6, title="x", price=D("1.00"), stock=1)
             for i in range(12)]
    t = tables_from(spark, {"categories": cats, "products": prods})
    out, _ = C.merge_categories(t, spark.createDataFrame(pairs, "source_id long, target_id long"))
    p = out["products"].collect()
    assert len(p) == 12
    remaining = {r["category_id"] for r in out["categories"].collect()}
    assert all(r["category_id"] in remaining for r in p)


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 8), st.integers(1, 3)), min_size=1, max_size=8))
def test_primary_images_keep_rows_and_one_primary(spark, reqs):
    imgs = [dict(image_id=i, product_id=1 + (i - 1) % 3, image_url=f"/i{i}.jpg", is_primary=(i <= 3))
            for i in range(1, 9)]
    t = tables_from(spark, {"product_images": imgs})
    df = spark.createDataFrame([(s, img, prod) for s, (img, prod) in enumerate(reqs, start=1)],
                               "seq long, image_id long, product_id long")
    out = C.set_primary_images(t["product_images"], df).table.collect()
    assert len(out) == 8
    valid = {(img, prod) for img, prod in reqs if 1 + (img - 1) % 3 == prod}
    for prod in {p for _, p in valid}:
        last = [img for img, p in reqs if (img, p) in valid and p == prod][-1]
        prim = [r["image_id"] for r in out if r["product_id"] == prod and r["is_primary"]]
        assert prim == [last]
