"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storefront.session import scratch_path

#: Rows per Arrow batch sent to a Python task; with whole texts this bounds a
#: task's memory better than Spark's default of 10,000 rows.
BATCH_ROWS = 2000
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size of the session to BATCH_ROWS if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: cuts
    the lineage, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, f"llm-{label}")
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text modulo ``mod``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def same(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> Column:
    """Null-safe equality of ``keys`` as a join condition."""
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


def raw_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x if x is not None else b"" for x in col.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], name: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of the text
    column ``name`` (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        col = batch.column(batch.schema.get_field_index(name))
        if col.nbytes <= limit:
            yield batch
            continue
        sizes = [len(x) if x is not None else 0 for x in col.cast(pa.binary()).to_pylist()]
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)


def dense_names(keys: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Distinct ``keys`` sorted by ``columns`` and numbered 0, 1, 2, ... in
    column ``name``. The numbers depend on the sort order only: rows are
    range-partitioned, numbered inside their partition, and shifted by the
    sizes of the partitions before (one row per partition)."""
    ranged = (keys.select(*columns).repartitionByRange(*columns).sortWithinPartitions(*columns)
              .withColumn("_at", F.monotonically_increasing_id()))
    ranged = written(ranged, label)
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return (ranged.withColumn("_part", part).join(shift, "_part")
            .select(*columns, (F.col("_shift") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("name")))
