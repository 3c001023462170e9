"""Stream helpers: sources, zone-free event time, availableNow runs.

Batch tables keep timestamp_ntz; ``withWatermark`` needs an instant
(timestamp). Conversion goes through epoch microseconds, treating the NTZ
wall clock as UTC, so results do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storefront.session import scratch_path
from storefront.sources.views import DRIVER_SCHEMAS


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def event_time(c: Column | str) -> Column:
    """timestamp_ntz -> timestamp (the same wall clock read as UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), c))


def wall_clock(c: Column | str) -> Column:
    """timestamp -> timestamp_ntz (UTC wall clock); inverse of :func:`event_time`."""
    c = F.col(c) if isinstance(c, str) else c
    secs = (F.unix_micros(c).cast("decimal(38,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return _epoch() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A driver table read as a file stream (one parquet file per table in the
    folder, chosen with pathGlobFilter)."""
    r = spark.readStream.schema(DRIVER_SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def run_available_now(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over all available input into a parquet sink under
    the shared checkpoint folder, wait for it, and return the sink as a batch
    DataFrame. (File sinks take append mode only.)"""
    spark = df.sparkSession
    out, ckpt = scratch_path(spark, f"{label}-out"), scratch_path(spark, f"{label}-ckpt")
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(df.schema).parquet(out)


def run_foreach_batch(df: DataFrame, label: str, fn, mode: str = "update") -> None:
    """Run ``fn(batch_df, batch_id)`` over all available input (availableNow)."""
    spark = df.sparkSession
    q = (df.writeStream.outputMode(mode).foreachBatch(fn)
         .option("checkpointLocation", scratch_path(spark, f"{label}-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
