"""Physical layout of the canonical tables for repeated analytics at scale.

* Order lines and orders are bucketed (and sorted) by ``order_id`` with the
  same bucket count, and products, reviews and cart lines by ``product_id``,
  so the big equi-joins of the reports (lines x orders, lines x products,
  reviews x products) read co-partitioned buckets and skip the shuffle.
* Payment transactions are partitioned by day of ``created_at``: every
  monitoring report filters on a time window, which then prunes whole
  partitions (PartitionFilters) before any file is opened.

Tables are written through the session catalog (``saveAsTable``), because
bucket metadata lives in the catalog; on a cluster the metastore holds it and
``path`` should point at the shared warehouse.

* The bases of a change log (``sources.sinks``) are bucketed by one column and
  partitioned by the bucket's number as well: a filter on the number prunes
  folders, and a join on the column needs no shuffle of the base.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed layout: table -> bucket column (None = not bucketed).
BUCKET_BY: dict[str, str] = {
    "orders": "order_id", "order_items": "order_id", "payments": "order_id",
    "products": "product_id", "reviews": "product_id", "cart_items": "product_id",
}
DAY_PARTITIONED = {"mpesa_transactions": "created_at"}


def save_bucketed(df: DataFrame, table: str, column: str, buckets: int, path: str | None = None) -> None:
    w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, column).sortBy(column)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)


def save_by_day(df: DataFrame, table: str, ts_col: str, path: str | None = None) -> None:
    w = (df.withColumn("created_date", F.to_date(ts_col)).write.mode("overwrite").format("parquet")
         .partitionBy("created_date"))
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)


#: The bucket's number as a column: Spark's own bucket hash, so a folder holds one bucket.
BUCKET = "_bucket"


def bucket_of(by: str, buckets: int) -> Column:
    """The number of the bucket that a value of column ``by`` falls into."""
    return F.pmod(F.hash(F.col(by)), F.lit(buckets))


def _catalog_name(path: str) -> str:
    return f"base_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def save_by_bucket(df: DataFrame, path: str, by: str, buckets: int) -> None:
    """Write ``df`` to ``path`` in ``buckets`` buckets of column ``by``, one folder and file each."""
    (df.withColumn(BUCKET, bucket_of(by, buckets)).repartition(buckets, by).write.format("parquet")
     .partitionBy(BUCKET).bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(_catalog_name(path)))


def open_bucketed(spark: SparkSession, path: str, by: str, buckets: int) -> DataFrame:
    """The table at ``path`` with its buckets known to the planner. A session
    whose catalog doesn't have it (a restart) registers it first."""
    name = _catalog_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (`{BUCKET}`) "
                  f"CLUSTERED BY (`{by}`) SORTED BY (`{by}`) INTO {buckets} BUCKETS LOCATION '{path}'")
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def write_layout(t: Mapping[str, DataFrame], buckets: int, prefix: str = "shop_",
                 root: str | None = None) -> dict[str, str]:
    """Write the tables of ``t`` with the layout above; returns table -> catalog name.

    ``buckets`` should be the same for every bucketed table (co-partitioning)
    and sized so one bucket file is a few hundred MB at the target scale.
    """
    names = {}
    for name in t:
        df = t[name]
        target = f"{prefix}{name}"
        path = f"{root.rstrip('/')}/{name}" if root else None
        if name in BUCKET_BY:
            save_bucketed(df, target, BUCKET_BY[name], buckets, path)
        elif name in DAY_PARTITIONED:
            save_by_day(df, target, DAY_PARTITIONED[name], path)
        else:
            w = df.write.mode("overwrite").format("parquet")
            if path:
                w = w.option("path", path)
            w.saveAsTable(target)
        names[name] = target
    return names


def read_layout(spark: SparkSession, names: Mapping[str, str]) -> dict[str, DataFrame]:
    """The tables written by :func:`write_layout`, read through the catalog so
    Spark sees their buckets (day partitions come back as ``created_date``,
    which is dropped)."""
    out = {}
    for name, table in names.items():
        df = spark.table(table)
        out[name] = df.drop("created_date") if name in DAY_PARTITIONED else df
    return out
