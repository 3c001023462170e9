"""The dashboard reads the orders' figures in one aggregate."""

from __future__ import annotations

from storefront.operators import metrics as M
from storefront.sources.views import shop_views

AS_OF = "2001-07-31 00:00:00"


def test_counts_and_revenue_share_one_scan(spark):
    t = shop_views(spark, "/root/testdata/sf0.001")
    both = M.order_and_revenue_stats(t["orders"], AS_OF)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    row = both.first()
    assert row.orders.asDict() == M.order_stats(t["orders"], AS_OF).first().asDict()
    assert row.revenue.asDict() == M.revenue_stats(t["orders"], AS_OF).first().asDict()
