"""Plan-shape guards for the scale design (checked on the formatted plans)."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest

SF = "/root/testdata/sf0.001"
RUNS_JOBS = {"hourly_stream", "alert_stream", "callbacks_parsed", "callbacks_applied", "rating_stream",
             "timeout_stream", "cart_add_decisions", "cart_lines_after_adds", "transaction_details_fn",
             "count_pending_transactions_fn", "merge_categories", "cascade_delete_customers",
             "cascade_delete_abandoned_carts", "seller_dashboards", "merge_category_chain", "callback_payments",
             "callback_orders", "callbacks_dead_letters"}


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _names():
    from storefront.plans.registry import queries
    return sorted(n for n in queries() if n not in RUNS_JOBS)


@pytest.mark.parametrize("name", _names())
def test_no_nested_loop_or_cartesian(spark, name):
    from __spark_entry__ import queries
    p = plan(queries()[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_per_seller_topk_limits_before_shuffle(spark):
    from __spark_entry__ import queries
    for name in ("seller_top_products", "seller_recent_orders", "seller_low_stock", "active_carts"):
        assert plan(queries()[name](spark, SF)).count("WindowGroupLimit (") == 2, name


def test_scan_reads_only_needed_columns(spark):
    from storefront.operators.metrics import product_stats
    from storefront.sources.views import shop_views
    p = plan(product_stats(shop_views(spark, SF)["products"]))
    assert "ReadSchema: struct<p_partkey:bigint,p_retailprice:double>" in p
    assert "lineitem" not in p  # the unused dates join of the view is removed


def test_filters_reach_the_scan(spark):
    from __spark_entry__ import queries
    p = plan(queries()["hourly_payments"](spark, SF))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in p


def test_top_products_skips_line_key_window(spark):
    from __spark_entry__ import queries
    assert "Window (" not in plan(queries()["top_products"](spark, SF))


def test_cascade_plans_stay_linear(spark):
    from pyspark.sql import functions as F

    from storefront.operators.changes import cascade_delete
    from storefront.sources.views import shop_views
    t = shop_views(spark, SF)
    res = cascade_delete(t, "users", t["users"].where(F.col("role") == "customer").select("user_id"), "skip")
    assert all(plan(d).count("Exchange (") < 20 for d in res.deleted.values())
