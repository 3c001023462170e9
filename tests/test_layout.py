"""Bucketed layout: the order lines x orders join reads co-partitioned buckets."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from storefront.session import scale_conf
from storefront.sources.layout import read_layout, write_layout


def test_bucketed_join_skips_shuffle(spark, seed, tmp_path):
    names = write_layout({k: seed[k] for k in ("orders", "order_items", "mpesa_transactions")}, buckets=4,
                         prefix="layout_test_", root=str(tmp_path))
    t = read_layout(spark, names)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    prev_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        j = t["order_items"].join(t["orders"], "order_id").groupBy("order_id").agg(F.sum("quantity"))
        buf = io.StringIO()
        with redirect_stdout(buf):
            j.explain()
        assert "Exchange" not in buf.getvalue()
        assert j.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        spark.conf.set("spark.sql.adaptive.enabled", prev_aqe)
    tx = t["mpesa_transactions"]
    assert "created_date" not in tx.columns and tx.count() == 2


def test_scale_conf_sizes_partitions():
    c = scale_conf(100 << 40, cores=8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert scale_conf(1 << 20, cores=8)["spark.sql.shuffle.partitions"] == "16"
