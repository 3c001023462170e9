"""S1 loading with fixed schemas; F9 spec parsing; S2 view schemas."""

from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import functions as F

from storefront.functions.scalar import specs_map
from storefront.sources.schemas import SCHEMAS, load
from storefront.sources.views import SHOP_TABLES, shop_views


def test_load_formats_with_fixed_schema(spark, seed, tmp_path):
    for fmt in ("parquet", "json", "orc"):
        path = str(tmp_path / f"orders.{fmt}")
        seed["orders"].write.format(fmt).save(path)
        df = load(spark, path, "orders", fmt)
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in SCHEMAS["orders"]]
        assert sorted(r["total_amount"] for r in df.collect()) == [D("42999.00"), D("56997.00"), D("84999.00")]
    path = str(tmp_path / "orders.csv")
    seed["orders"].write.option("header", True).csv(path)
    df = load(spark, path, "orders", "csv", header=True)
    assert df.schema.fieldNames() == SCHEMAS["orders"].fieldNames() and df.count() == 3


def test_specs_map(spark):
    df = spark.createDataFrame([('{"ram": "6GB", "storage": "128GB"}',), (None,)], "s string")
    got = [r[0] for r in df.select(specs_map("s")).collect()]
    assert got[0] == {"ram": "6GB", "storage": "128GB"} and got[1] is None


def test_views_have_canonical_schemas(spark):
    t = shop_views(spark, "/root/testdata/sf0.001")
    for name in SHOP_TABLES:
        assert t[name].schema.fieldNames() == SCHEMAS[name].fieldNames()
        assert [f.dataType for f in t[name].schema.fields] == [f.dataType for f in SCHEMAS[name].fields]
    assert t["product_images"].count() > 0 and t["delivery_pricing"].count() == 25
    assert t["orders"].where(F.col("status").isNull()).count() == 0
