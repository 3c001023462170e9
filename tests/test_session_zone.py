"""Results do not depend on the session time zone (batch NTZ, streams via epoch micros)."""

from __future__ import annotations

import pytest

from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
ZONED = ["hourly_stream", "alert_stream", "hourly_payments", "daily_payments", "revenue_trends", "timeout_stream",
         "pending_summary", "outstanding"]


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Kolkata"])
def test_queries_match_oracle_in_other_zones(spark, zone):
    from __spark_entry__ import oracle_sql, queries
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        con = duck(SF)
        for name in ZONED:
            r = compare(spark, con, name, queries()[name], oracle_sql()[name], SF)
            assert r["status"] == "ok", (zone, r)
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
